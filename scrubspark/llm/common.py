"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.session import checkpoint_dir

#: Fixed value: the ASCII white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters of text a task turns into arrays at once.
SLICE_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder of ``spark.checkpoint.dir`` and read again.

    Cuts the lineage: a lost executor costs no more than a re-read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` does not have (names are compared in lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def where_computed(df: DataFrame, cond: Column, columns: list[str]) -> DataFrame:
    """The rows of ``df`` that meet ``cond``, with ``columns``, where ``cond`` reads costly computed columns.

    A plain filter, or one inferred from a plain explode, would be pushed below them, which repeats their
    expressions inside the condition; a filter on the output of an outer explode stays above.
    """
    row = F.explode_outer(F.when(cond, F.array(F.struct(*[quoted(c) for c in columns])))).alias("kept_row")
    return df.select(row).where("kept_row is not null").select("kept_row.*")


def text_slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) runs of ``texts`` of about ``limit`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keys: list[str], text: str, fn: Callable[[list[str]], dict], fields: str) -> DataFrame:
    """Apply ``fn`` to runs of whole texts (NULL is the empty text) inside the tasks that hold them.

    ``fn`` gets a list of texts and returns {field: values, one per text}.  The result has the columns
    ``keys`` unchanged and the fields of the DDL string ``fields``.  Nothing is shuffled.
    """
    schema = T.StructType([f for k in keys for f in df.schema.fields if f.name == k]
                          + T.StructType.fromDDL(fields).fields)
    names = [f.name for f in T.StructType.fromDDL(fields).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            held = [t or "" for t in batch.column(len(keys)).to_pylist()]
            for a, b in text_slices(held):
                got = fn(held[a:b])
                cols = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(len(keys))]
                cols += [pa.array(got[n], arrow.field(len(keys) + j).type) for j, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*[quoted(k) for k in keys], quoted(text)).mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, target: str, rows: int, held_out: Column | None = None) -> DataFrame:
    """At most about ``rows`` labelled ids (``doc_id``, ``y``), chosen by a hash of the id.

    ``held_out`` marks rows of ``labels`` that training must not see.  The rate comes from a count, so
    the sample stays bounded however many labels there are; an id labelled twice counts once (largest label).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    if held_out is not None:
        usable = usable.where(~held_out)
    n = usable.count()
    if n > rows:
        share = int(rows / n * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) < share)
    return usable.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))


def thinned(rows: DataFrame, size, most: int) -> DataFrame:
    """``rows`` (doc_id, text) whose sizes add up to about ``most`` or less, chosen by a hash of id and text."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("thin"), "doc_id", "text"), F.lit(1 << 30)) < int(most / total * (1 << 30)))


def training_rows(docs: DataFrame, sample: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, y): the documents of a ``labelled_sample``, stored.

    Equal rows count once and at most about ``rows`` stay, however often an id is repeated; copies meet in the
    map-side half of the aggregate.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])
    return thinned(stored(found, "training-rows"), F.lit(1), rows)
