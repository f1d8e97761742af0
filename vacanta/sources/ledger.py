"""S-06 / T-01: appends that happen once, however often they are delivered.

A ``Ledger`` is a folder of tables that grow by batches; the folder's listing is the log
of the batch ids. All tables of a batch are written under a hidden folder of the attempt,
which one rename then gives the batch's name:

    <root>/_attempt-<uuid>/<table>/*.parquet   ->   <root>/<batch>/<table>/*.parquet

* A batch delivered again (a retried load, a restarted stream) finds its name taken and
  writes nothing.
* An attempt that fails between two tables leaves a hidden folder, which no reader sees
  (Spark's file sources skip such names too) and ``vacuum`` deletes.
* Of two attempts at one batch at the same time one gets the name; the other's files go.

The rename must be atomic and refuse a name that is taken, as on HDFS; an object store
without such a rename needs a table format instead.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def batches(self) -> list[str]:
        """The ids of all committed batches."""
        return [n for n in self._names() if not n.startswith(("_", "."))]

    def is_committed(self, batch: str | int) -> bool:
        return self._fs.exists(self._path(str(batch)))

    def append(self, batch: str | int, tables: Mapping[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> bool:
        """Write the tables of ``batch`` and commit them together; False, with nothing left,
        if the batch is there already. A table may be a function of those before it, as
        they were written."""
        for name in (str(batch), *tables):
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} cannot name a batch or a table")
        if self.is_committed(batch):
            return False
        attempt, written = f"_attempt-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            df = df(written) if callable(df) else df
            df.write.parquet(f"{self.root}/{attempt}/{name}")
            written[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{attempt}/{name}")
        return self._commit(attempt, str(batch))

    def _commit(self, attempt: str, batch: str) -> bool:
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(attempt), self._path(batch), none)
            return True
        except Exception:
            if not self.is_committed(batch):
                raise
            self._fs.delete(self._path(attempt), True)
            return False

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """The rows of ``table`` in all committed batches, columns by name: those of
        ``schema`` (null where a batch lacks one), else those of any batch. Empty with
        ``schema`` if no batch has the table."""
        held = [f"{self.root}/{b}/{table}" for b in self.batches() if table in self._names(b)]
        if not held:
            if schema is None:
                raise ValueError(f"no batch of {table} is committed in {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*held)

    def vacuum(self) -> list[str]:
        """Delete the folders of attempts that were never committed (none may be running);
        returns their names."""
        lost = [n for n in self._names() if n.startswith("_attempt-")]
        for name in lost:
            self._fs.delete(self._path(name), True)
        return lost
