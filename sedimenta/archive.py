"""The archive: a DataFrame of records with a tree of derived values.

The DataFrame holds flat columns; the tree says which column is the value of which path, whether it is hidden, and how
many list levels it has. Values under ``a*`` are arrays aligned with ``a``, with nulls for elements that have none.
Nested structures are put together only for output, so Catalyst prunes what nobody reads.

Filters on metadata go below all derivations; a Python derivation that a filter has used is evaluated once (its UDF
is marked so that Spark doesn't duplicate it).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.batches import batched, cut, release
from sedimenta.operators.functions import LOADS, Func, Identity, Values
from sedimenta.operators.paths import Pointer, is_index, parse, show

ERROR = "__error"


@dataclass(frozen=True)
class Config:
    """``catch_exceptions``: a failing derivation gives null and an error, else it fails the job. ``include_errors``: show it in JSON.

    ``max_decompressed``: most bytes that a stored record may grow to (0: any). ``text_limit``: bytes of a payload that
    become text (0: all).
    """

    catch_exceptions: bool = True
    include_errors: bool = True
    max_decompressed: int = 0
    text_limit: int = 1 << 20


@dataclass(frozen=True)
class Field:
    column: str
    dtype: str
    depth: int = 0  # list levels of the column
    multi: bool = False  # the value itself is a list of values
    hidden: bool = False
    identity: bool = False


def _lift(f, depth: int):
    """``f`` on Columns, under ``depth`` list levels."""
    return f if depth == 0 else lambda c: F.transform(c, lambda x: _lift(f, depth - 1)(x))


class Archive:
    def __init__(self, df: DataFrame, record: list[str], tree: dict[tuple[str, ...], Field] | None = None, config: Config = Config(), root_func: Func | None = None, base: DataFrame | None = None, steps: tuple = ()):
        self.df, self.record, self.tree, self.config, self.root_func = df, list(record), dict(tree or {}), config, root_func
        #: ``df`` is ``base`` after ``steps``: derivations and filters on derived values, before which a filter on metadata is put
        self.base, self.steps = df if base is None else base, tuple(steps)

    # --- making one ---------------------------------------------------------------------------------------------------

    @staticmethod
    def of_pages(pages: DataFrame, url: str = "url", html: str = "html", config: Config = Config()) -> Archive:
        """Pages whose HTML is already a text column: it stands at ``payload.string``."""
        df = pages.withColumnsRenamed({url: "originalUrl"}) if url != "originalUrl" else pages
        record = [c for c in df.columns if c != html]
        return Archive(df, record, {parse("payload.string"): Field(html, "string", hidden=True)}, config)

    def _with(self, step=None, tree=None) -> Archive:
        """With one more step (DataFrame to DataFrame, columns by name) or another tree."""
        df, steps = (self.df, self.steps) if step is None else (step(self.df), (*self.steps, step))
        return Archive(df, self.record, self.tree if tree is None else tree, self.config, self.root_func, self.base, steps)

    def _anew(self, df: DataFrame) -> Archive:
        """From rows below which later filters must not go."""
        return Archive(df, self.record, self.tree, self.config, self.root_func)

    # --- paths --------------------------------------------------------------------------------------------------------

    def _find(self, path: tuple[str, ...]) -> tuple[str, ...]:
        if path[:1] == ("",):
            name = path[1]
            hit = next((k[: k.index(name) + 1] for k in self.tree if name in k), None)
            return (hit or (name,)) + path[2:]
        return path

    def has(self, pointer) -> bool:
        """Whether the plan has that place; nothing is derived."""
        return self._resolve(_path(pointer)) is not None

    exists = has

    def fields(self, hidden: bool = False) -> dict[str, str]:
        """The places of the tree in dot notation, each with its type; ``hidden``: those that aren't rendered too."""
        return {show(k): _arrays(f.dtype, f.depth) for k, f in sorted(self.tree.items()) if hidden or not f.hidden}

    def enrichments(self, pointer="") -> list[str]:
        """Names of what has been derived right below a place."""
        at = self._key(self._find(_path(pointer))) if pointer else ()
        return sorted({k[len(at)] for k in self.tree if len(k) > len(at) and k[: len(at)] == at and k[len(at)] != "*"})

    def is_enriched(self, func: Func) -> bool:
        return all((*self._key(func.base), f) in self.tree for f in func.fields)

    def _key(self, path: tuple[str, ...]) -> tuple[str, ...]:
        return tuple("*" if is_index(s) else s for s in path)

    def _resolve(self, path: tuple[str, ...]) -> tuple[Column, Field, int] | None:
        """Column of a path, its field, and its list levels."""
        path = self._find(path)
        if path and path[0].startswith("@"):
            name = path[0][1:]
            return (F.col(f"`{name}`"), Field(name, self.df.schema[name].dataType.simpleString()), 0) if name in self.df.columns else None
        if len(path) == 1 and path[0] in self.record:
            return F.col(f"`{path[0]}`"), Field(path[0], self.df.schema[path[0]].dataType.simpleString()), 0
        if len(path) == 2 and path[0] == "record" and path[1] in self.record:
            return self._resolve(path[1:])
        key, steps, level = [], [], 0
        for s in path:
            if s == "*" or is_index(s):
                here = self.tree.get(tuple(key))
                if here is not None and not here.multi:
                    # a scalar is a list of one on reading
                    if is_index(s) and s != "[0]":
                        return None
                    continue
                key.append("*")
                steps.append((level, s))
                level += 1
            else:
                key.append(s)
        f = self.tree.get(tuple(key))
        if f is None and key and key[-1] == "*":
            f = self.tree.get(tuple(key[:-1]))
            f = f and replace(f, depth=f.depth + 1, multi=False)
        if f is None:
            return None
        col, removed = F.col(f"`{f.column}`"), 0
        for lv, s in steps:
            if is_index(s):
                i = int(s[1:-1])
                col = _lift(lambda c, i=i: F.get(c, F.lit(i)), lv - removed)(col)
                removed += 1
        return col, f, f.depth - removed

    def column(self, pointer) -> Column:
        """The value's Column, aligned: elements without a value are null."""
        got = self._resolve(_path(pointer))
        if got is None:
            raise KeyError(f"no value at {show(_path(pointer))}")
        return got[0]

    def value(self, pointer) -> tuple[Archive, Column]:
        """The archive with the pointer derived, and its value: missing elements dropped, null if all are missing."""
        a = self.initialised(pointer)
        got = a._resolve(_path(pointer))
        if got is None:
            return a, F.lit(None).cast("string")
        col, _, depth = got
        if depth == 0:
            return a, col
        kept = F.filter(col, lambda x: x.isNotNull())
        return a, F.when(F.size(kept) > 0, kept)

    def initialised(self, pointer) -> Archive:
        func = pointer.func if isinstance(pointer, Pointer) else None
        return self._derive(func, hidden=True) if func is not None else self

    # --- derivation -----------------------------------------------------------------------------------------------------

    def enrich(self, func: Func) -> Archive:
        """Derive ``func``'s fields, with what they need (hidden). Derived once by field name; asking again un-hides."""
        a = self._with((lambda d: d.withColumn(ERROR, F.lit(None).cast("string"))) if ERROR in self.df.columns and not self.is_enriched(func) else None)
        return a._derive(func, hidden=False)

    def enrich_value(self, field: str, value) -> Archive:
        if (field,) in self.tree:
            return self
        name = f"v:{field}"
        a = self._with(lambda d: d.withColumn(name, value if isinstance(value, Column) else F.lit(value)))
        return a._with(tree=self.tree | {(field,): Field(name, a.df.schema[name].dataType.simpleString())})

    def _derive(self, func: Func, hidden: bool) -> Archive:
        a = self
        if isinstance(func, Values):
            for p in func.pointers:
                a = a.initialised(p)
        if func.source is not None:
            a = a.initialised(func.source)
        elif func.load in ("text", "bytes") and LOADS[func.load] not in a.tree:
            a = a._load(func.load)
        keys = [(*a._key(func.base), f) for f in func.fields]
        if any(k in a.tree for k in keys):
            tree = dict(a.tree)
            for k in keys:
                if k in tree and not hidden:
                    tree[k] = replace(tree[k], hidden=False)
            if not all(k in a.tree for k in keys):
                warnings.warn(f"{func!r}: a field of that name exists and stays", stacklevel=3)
            return a._with(tree=tree)
        source = func.source.path if func.source is not None else LOADS[func.load]
        if isinstance(func, Values):
            return a._combine(func, source, hidden)
        got = a._resolve(source)
        if got is None:
            raise KeyError(f"{func!r} reads {show(source)}, which this archive doesn't have")
        col, field, depth = got
        tree = dict(a.tree)
        if isinstance(func, Identity):
            name = field.column if depth == field.depth else f"v:{show(keys[0])}"
            tree[keys[0]] = Field(name, field.dtype, depth, field.multi, hidden, identity=True)
            return a._with((lambda d: d.withColumn(name, col)) if depth != field.depth else None, tree)
        names = {f: f"v:{show((*a._key(func.base), f))}" for f in func.fields}
        if func.expr is not None:
            extra = [F.col(f"`{c}`") for c in func.context if c in a.df.columns]
            step = lambda d: d.withColumns({names[f]: _lift(lambda c, f=f: func.expr(c, *extra)[f], depth)(col) for f in func.fields})
        else:
            step = a._python(func, col, depth, names)
        for k, (f, dtype) in zip(keys, func.fields.items()):
            tree[k] = Field(names[f], dtype, depth, f in func.multi_fields, hidden)
        return a._with(step, tree)

    def _load(self, load: str) -> Archive:
        """The record's text or bytes, resolved by the kind of record."""
        from sedimenta.operators.functions import StringContent

        if self.root_func is None:
            raise KeyError(f"this archive's records have no {load}")
        a = self._derive(self.root_func, hidden=True)
        return a._derive(StringContent(self.config.text_limit), hidden=True) if load == "text" else a

    def _python(self, func: Func, col: Column, depth: int, names: dict[str, str]):
        """A step with one Arrow-batched UDF for all fields; errors come along as one more field.

        Of a batch, only a slice at a time is made Python objects and handed back, so a worker's memory follows neither
        the table nor the batch.
        """
        kinds = {f: _arrays(dtype, depth) for f, dtype in func.fields.items()}
        out = T.StructType.fromDDL(", ".join(f"f{k} {d}" for k, d in enumerate(kinds.values())) + ", e string")
        py, setup, cleanup, catch = func.py, func.setup, func.cleanup, self.config.catch_exceptions
        fields = list(func.fields)
        arg = col
        if "@httpHeader" in func.context:
            header = self._resolve((*func.base[:-1], "httpHeader")) or self._resolve(("httpHeader",))
            arg = F.struct(col.alias("payload"), (header[0] if header else F.lit(None).cast("array<struct<k:string,v:string>>")).alias("httpHeader"))
        made: list = []

        def one(v):
            try:
                if setup is not None and not made:
                    made.append(setup())
                got = py(v, made[0]) if setup is not None else py(v)
                return tuple(got.get(f) for f in fields), None
            except Exception as e:
                if not catch:
                    raise
                return (None,) * len(fields), f"{type(e).__name__}: {e}"

        def lifted(v, d):
            if d == 0:
                return one(v)
            if v is None:
                return (None,) * len(fields), None
            rows = [lifted(x, d - 1) for x in v]
            return tuple([r[0][k] for r in rows] for k in range(len(fields))), next((r[1] for r in reversed(rows) if r[1]), None)

        import pyarrow as pa

        def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if cleanup is not None:
                made.clear()
            try:
                for value in values:
                    for part in cut(value):
                        rows = [lifted(v, depth) for v in part.to_pylist()]
                        yield pa.array([{**{f"f{k}": r[0][k] for k in range(len(fields))}, "e": r[1]} for r in rows], _arrow(out))
                        del rows
            finally:
                if cleanup is not None and made:
                    cleanup(made.pop())
                release()

        run.__annotations__ = {"values": Iterator[pa.Array], "return": Iterator[pa.Array]}
        udf = F.arrow_udf(run, out).asNondeterministic()

        def step(df: DataFrame) -> DataFrame:
            df = batched(df).withColumn("__d", udf(arg))
            df = df.withColumns({names[f]: F.col(f"__d.f{k}") for k, f in enumerate(fields)})
            old = F.col(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
            return df.withColumn(ERROR, F.coalesce(F.col("__d.e"), old)).drop("__d")

        return step

    def _combine(self, func: Values, source: tuple[str, ...], hidden: bool) -> Archive:
        """``Values``: members below the place it is attached to are taken element by element."""
        got = [self._resolve(p.path) for p in func.pointers]
        if any(g is None for g in got):
            missing = [show(p.path) for p, g in zip(func.pointers, got) if g is None]
            raise KeyError(f"no value at {', '.join(missing)}")
        each = source[-1:] == ("*",)
        key = self._key(source) if each else source
        if not each:
            cols = [c for c, _, _ in got]
            col, depth = func.combine(cols)[func.default], 0
        else:
            base = self._resolve(source)[0]
            aligned = [c for c, _, _ in got]
            below = [self._key(p.path)[: len(key)] == key for p in func.pointers]
            col = F.transform(F.sequence(F.lit(0), F.size(base) - 1), lambda i: func.combine([F.get(c, i) if b else c for c, b in zip(aligned, below)])[func.default])
            col, depth = F.when(F.size(base) > 0, col), 1
        k = (*key, func.default)
        name = f"v:{show(k)}"
        return self._with(lambda d: d.withColumn(name, col), self.tree | {k: Field(name, "array<string>", depth, False, hidden)})

    # --- filters --------------------------------------------------------------------------------------------------------

    def filter(self, condition) -> Archive:
        """By metadata: put before all derivations, so that it reaches the scan whenever it was written.

        A condition on anything else stays where it is.
        """
        if self.steps:
            try:
                base = df = self.base.filter(condition)
                for step in self.steps:
                    df = step(df)
                return Archive(df, self.record, self.tree, self.config, self.root_func, base, self.steps)
            except AnalysisException:
                pass
            return self._with(lambda d: d.filter(condition))
        return self._anew(self.df.filter(condition))

    def filter_exists(self, pointer) -> Archive:
        """Records that have the value already; nothing is derived."""
        got = self._resolve(_path(pointer))
        return self._with(lambda d: d.filter(F.lit(False) if got is None else _present(got)))

    def filter_value(self, pointer, predicate) -> Archive:
        """``predicate``: Column to Column; a missing value is null, and null counts as false."""
        a, col = self.value(pointer)
        return a._with(lambda d: d.filter(F.coalesce(predicate(col), F.lit(False))))

    def filter_non_empty(self, pointer) -> Archive:
        a, col = self.value(pointer)
        kind = a.df.select(col.alias("x")).schema["x"].dataType
        size = F.size(col) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(col) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(1)
        return a._with(lambda d: d.filter(col.isNotNull() & (size > 0)))

    def filter_no_exception(self) -> Archive:
        return self._with(lambda d: d.filter(F.col(ERROR).isNull())) if ERROR in self.df.columns else self

    def filter_in(self, column: str, keys: DataFrame, key: str) -> Archive:
        """Records whose ``column`` is among ``keys``: a semi-join, whose strategy is left to the sizes."""
        keys = keys.select(F.col(key).alias("__key")).distinct()
        return self._anew(self.df.join(keys, self.df[column] == F.col("__key"), "left_semi"))

    # --- values ---------------------------------------------------------------------------------------------------------

    def map_values(self, pointer) -> DataFrame:
        """(value) of the records that have one."""
        a, col = self.value(pointer)
        return a.df.select(col.alias("value")).filter("value is not null")

    def flat_map_values(self, pointer) -> DataFrame:
        a, col = self.value(pointer)
        return a.df.select(F.explode(col).alias("value"))

    def value_or_else(self, pointer, default) -> Column:
        return F.coalesce(self.value(pointer)[1], F.lit(default))

    def get_value(self, pointer) -> Column:
        """The value; a record that lacks it fails the job."""
        return F.coalesce(self.value(pointer)[1], F.raise_error(F.lit(f"no value at {show(_path(pointer))}")))

    def select(self, *columns: str, **pointers) -> DataFrame:
        """Record columns and named pointers as a DataFrame."""
        a, cols = self, {}
        for name, p in pointers.items():
            a = a.initialised(p)
        for name, p in pointers.items():
            cols[name] = a.value(p)[1]
        return a.df.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(n) for n, c in cols.items()])

    def distinct_value(self, key, order: list, keep_null_groups: bool = True) -> Archive:
        """One record for each value of ``key``: the first by ``order``, which should end in something unique.

        ``key``: a pointer or a record column. Records without the value form one group.
        """
        from pyspark.sql import Window

        if isinstance(key, str) and key in self.record:
            a, col = self, F.col(f"`{key}`")
        else:
            a, col = self.value(key)
        df = a.df.withColumn("__k", col)
        if not keep_null_groups:
            df = df.filter("__k is not null")
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).filter("__n = 1")
        return a._anew(df.drop("__k", "__n"))

    def distinct_by(self, key: str, reducer) -> DataFrame:
        """One record for each value of a record column by an arbitrary binary reducer of dicts. Slow: a group is folded in Python."""
        import pandas as pd

        schema = self.df.schema

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.to_dict("records")
            out = rows[0]
            for r in rows[1:]:
                out = reducer(out, r)
            return pd.DataFrame([out], columns=[f.name for f in schema])

        return self.df.groupBy(key).applyInPandas(fold, schema)

    def count_by_value(self, pointer) -> DataFrame:
        """(value, count), most frequent first."""
        return self.map_values(pointer).groupBy("value").count().orderBy(F.desc("count"), "value")

    def last_exception(self) -> str | None:
        if ERROR not in self.df.columns:
            return None
        row = self.df.filter(F.col(ERROR).isNotNull()).select(ERROR).first()
        return row[0] if row else None

    def persist(self) -> Archive:
        return self._anew(self.df.persist())

    def count(self) -> int:
        return self.df.count()

    # --- output ---------------------------------------------------------------------------------------------------------

    def _children(self, path: tuple[str, ...]) -> list[str]:
        seen = {}
        for k in self.tree:
            if len(k) > len(path) and k[: len(path)] == path and k[len(path)] != "*":
                seen[k[len(path)]] = True
        return list(seen)

    def _node(self, path: tuple[str, ...], at: list[Column], render: bool = True) -> Column | None:
        """The output of a place; ``at``: the current index of each ``*`` above."""
        f = self.tree.get(path)
        value = None
        if f is not None and not f.identity:
            value = F.col(f"`{f.column}`")
            for i in at:
                value = F.get(value, i)
            if render and f.dtype == "binary":
                value = F.when(value.isNotNull(), F.format_string("bytes(length: %d)", F.length(value)))
        kids = [(c, self._node((*path, c), at, render)) for c in self._children(path)]
        kids = [(c, k) for c, k in kids if k is not None]
        below = any(len(k) > len(path) + 1 and k[: len(path) + 1] == (*path, "*") and not self.tree[k].hidden for k in self.tree)
        own = value if f is not None and not f.hidden and not f.identity else None
        if f is not None and f.multi and below:
            elements = value
            each = lambda i: self._element(path, [*at, i], None if f.hidden else F.get(elements, i), render)
            listed = F.when(F.size(elements) > 0, F.transform(F.sequence(F.lit(0), F.size(elements) - 1), each))
            own = F.filter(listed, lambda x: x.isNotNull())
        if not kids:
            return own
        parts = [F.lit(None) if own is None else own, *[k for _, k in kids]]
        some = F.lit(False)
        for p in parts[own is None :]:
            some = some | p.isNotNull()
        return F.when(some, F.struct(*([own.alias("_")] if own is not None else []), *[k.alias(c) for c, k in kids]))

    def _element(self, path, at, own, render):
        path = (*path, "*")
        kids = [(c, self._node((*path, c), at, render)) for c in self._children(path)]
        kids = [(c, k) for c, k in kids if k is not None]
        if not kids:
            return own
        some = F.lit(False) if own is None else own.isNotNull()
        for _, k in kids:
            some = some | k.isNotNull()
        return F.when(some, F.struct(*([own.alias("_")] if own is not None else []), *[k.alias(c) for c, k in kids]))

    def tree_columns(self, render: bool = True) -> list[Column]:
        out = [F.struct(*[F.col(f"`{c}`") for c in self.record]).alias("record")]
        if self.config.include_errors and ERROR in self.df.columns:
            out.append(F.col(ERROR).alias("error"))
        for c in self._children(()):
            node = self._node((c,), [], render)
            if node is not None:
                out.append(node.alias(c))
        return out

    def to_df(self) -> DataFrame:
        """Nested, typed columns: ``record``, ``error``, and the visible tree."""
        return self.df.select(*self.tree_columns(render=False))

    def to_json(self, pretty: bool = False) -> DataFrame:
        """(value): one JSON text a record. Absent values have no key; a place with a value and children has it under ``_``."""
        return self.df.select(F.to_json(F.struct(*self.tree_columns()), {"pretty": "true"} if pretty else {}).alias("value"))

    def peek(self, i: int = 0):
        return self.df.offset(i).limit(1).first()

    def peek_json(self, i: int = 0) -> str | None:
        row = self.to_json(pretty=True).offset(i).limit(1).first()
        return row[0] if row else None

    def save_json(self, path: str) -> None:
        out = self.to_json().write
        (out.option("compression", "gzip") if path.endswith(".gz") else out).text(path)

    def schema(self) -> T.StructType:
        """What ``load_json`` needs to read back what ``save_json`` wrote."""
        return self.df.select(*self.tree_columns()).schema

    def _repr_html_(self) -> str:
        from html import escape

        return f"<pre>{escape(self.peek_json() or '')}</pre>"


def load_json(spark, path: str, schema: T.StructType) -> DataFrame:
    """Saved JSON with its schema (never inferred: a place may be a scalar in one file and an object in another)."""
    return spark.read.schema(schema).json(path)


def save_text(values: DataFrame, path: str) -> int:
    """One line a row of the string column ``value``; the number of lines."""
    from pyspark.sql import Observation

    seen = Observation("lines")
    values.select(F.col("value").cast("string")).observe(seen, F.count("*").alias("n")).write.text(path)
    return seen.get["n"]


def save_rows(df: DataFrame, path: str, separator: str = "\t", header: bool = False) -> None:
    """Flat columns as separated values, a tab by default; quoted where need be, a null is an empty field."""
    df.write.options(sep=separator, header=str(header).lower(), emptyValue='""', nullValue="", escape='"', compression="gzip" if path.endswith(".gz") else "none").csv(path)


def table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as tab-separated text, for a notebook's table display."""
    return "%table " + df.limit(rows).toPandas().to_csv(sep="\t", index=False)


def _path(pointer) -> tuple[str, ...]:
    return pointer.path if isinstance(pointer, Pointer) else parse(pointer)


def _present(got) -> Column:
    col, _, depth = got
    return col.isNotNull() if depth == 0 else F.exists(col, lambda x: x.isNotNull())


def _arrays(dtype: str, depth: int) -> str:
    return "array<" * depth + dtype + ">" * depth


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema)
