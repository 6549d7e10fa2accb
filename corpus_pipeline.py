"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the scorer (class-conditional Kneser-Ney models) predicts toxic go;
2. line dedup: lines over the boilerplate ratio of their source are cut (``n_chars`` follows);
3. near dedup: of documents linked by SimHash, directly or through others, the one of least id stays;
4. mixing: rows are taken as often as their source's target weight asks (0 to 3 times);
5. SentencePiece: texts get ``ids`` and ``n_tokens``, segmented with seeded merge-dropout.

Defined results: a null or empty text scores what no evidence gives, is no boilerplate, is a near copy of other such
texts (one stays), has size 0 in the mix and null or no ids; rows with a null id stay through near dedup; of rows that
share an id the first by text hash stays; a null source is a site and a source of its own; repeated rows are copies; no
rows give no rows. All but the last stage return the columns of documents, further ones included; columns named ``ids``
or ``n_tokens`` are replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import lines, mixing, pieces, simhash, toxicity
from sedimenta.llm.common import table_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.labels_of(spark, sf_dir))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.drop_lines(docs, F.col("source"), counts=("_n_lines", "_n_dropped"))
    return cut.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_path()).withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: Toxicity, near dedup and SentencePiece are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = table_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
