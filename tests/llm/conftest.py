import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A maker of documents tables: rows of (doc_id, text[, source])."""

    def make(rows, extra: str = ""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for c in extra.split():
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture
def folder(tmp_path):
    """Writes tables as the driver's folders have them."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
