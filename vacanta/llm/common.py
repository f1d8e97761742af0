"""Small shared helpers of the training-data operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A column-pruned scan of one input table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``; it goes with the application."""
    path = f"{ensure_checkpoint_dir(spark)}/vacanta-llm/{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once into a new shared folder and return a scan of it: the lineage
    ends there, so a lost executor re-reads files, and a later pass does not repeat
    the work."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name`` with underscores after it until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def least(df: DataFrame, order: Column, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows of ``df`` with the smallest ``order`` (a 64-bit hash), ties by columns.
    Only rows under a bound on the hash are sorted, about 2 k of all tasks together; the
    bound follows from the row count, and is dropped if fewer than ``k`` rows lie under it."""
    total = df.count()
    if total > 4 * k:
        near = df.where(order < int(-2 ** 63 + 2 ** 64 * 2 * k / total))
        if near.count() >= k:
            df = near
    return df.orderBy(order, *ties).limit(k)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str | T.StructType, setup: Callable | None = None) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; ``setup()`` runs once per task and
    its value is passed on as ``fn(batch, state)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            out = fn(batch, state) if setup else fn(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def in_slices(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold about ``max_bytes`` each
    (a single longer value is a range of its own)."""
    start, held = 0, 0
    sizes = pa.compute.binary_length(column).to_pylist()
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and held + n > max_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
