"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; a word is a maximal run of others.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Output rows per Arrow batch.
OUT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pagemill-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Lists that fresh_dir() enters its paths in while scratch() is on.
_recorders: list[list[str]] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for held in _recorders:
        held.append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of tables written meanwhile, for discard() when nothing reads them any more."""
    held: list[str] = []
    _recorders.append(held)
    try:
        yield held
    finally:
        _recorders.remove(held)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder, in whatever store it is."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes in an Arrow batch while a table is written; rows may hold shards of some megabytes.
BATCH_BYTES = 8 << 20


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what is executed meanwhile; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    with narrow_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """df written to the shared folder as a table bucketed by key and read back: joins on the key find its rows in place."""
    spark, name = df.sparkSession, f"pagemill_{what}_{uuid.uuid4().hex}"
    with narrow_batches(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", fresh_dir(spark, what)).bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan knows them and their buckets
    return found


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's schema of "name type, ...", known on executors too, where Spark's own parser is not."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in schema.split(","))])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, about a megabyte at a time: Spark bounds a batch's bytes, not what its rows weigh in Python."""
    step = max(1, min(256, (batch.num_rows << 20) // max(1, batch.nbytes)))
    for k in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, step).columns))


def column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values as a column; lists that are numpy arrays are taken as they are."""
    if pa.types.is_list(kind) and values and all(isinstance(v, np.ndarray) for v in values):
        ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind.value_type)).cast(kind)
    return pa.array(values, kind)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([column(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([column(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def by_row(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, size: int = OUT_ROWS) -> DataFrame:
    """Each row of df to any number of rows. make() runs once a task and returns the function of a row's values."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(schema)
        f = make()

        def rows() -> Iterator[tuple]:
            for batch in found:
                for values in rows_of(batch):
                    yield from f(*values)

        yield from batches(rows(), kind, size)

    return df.mapInArrow(run, schema)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; others of any name are left behind, missing ones are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(df[have[k.lower()]] if k.lower() in have else F.lit(None)).cast(v).alias(k) for k, v in kinds.items()])


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() breaks at exactly x20 and x09 to x0D."""
    return text.encode().split() if text else []


def require(names: Sequence[str], df: DataFrame) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def batches_where(df: DataFrame, at: int, make: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows of df of whose column at the function made once a task holds; all columns as they are."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = make()
        for batch in found:
            yield batch.filter(pa.array([holds(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
