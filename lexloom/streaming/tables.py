"""A keyed table kept as its first rows plus batches of changes, all plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.operators.merge import apply_changes, latest

#: What decides between two changes of a key: event order, then the file it came in, then the batch.
ORDER = ["seq", "file", "batch"]


class ChangeTable:
    """``base`` holds the rows it began with, ``changes`` one folder for each batch, as a partition.

    A batch is written under its own id, so a retried batch replaces itself; reading is one scan
    of both and :func:`apply_changes`. :meth:`fold` sums up the batches so far: later reads begin there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        self.log_schema = StructType.fromDDL(f"{schema}, seq long, file string, op string")
        self.read_schema = StructType([*self.log_schema.fields, *StructType.fromDDL("batch long").fields])

    def create(self, rows: DataFrame | None = None) -> None:
        """The rows to begin with; without any, none."""
        rows = rows if rows is not None else self.spark.createDataFrame([], self.schema)
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/base")
        self.append(self.spark.createDataFrame([], self.log_schema), -1)
        self.spark.createDataFrame([], "upto long").write.mode("overwrite").parquet(f"{self.path}/folds")

    def append(self, changes: DataFrame, batch_id: int) -> None:
        """Store one batch of changes (row columns, ``seq``, ``op``, optionally ``file``), reduced to the last per key."""
        named = changes if "file" in changes.columns else changes.withColumn("file", F.lit(""))
        last = latest(named.select(*self.log_schema.names), self.key, ORDER[:2])
        last.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def _parts(self, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows that no folded change touched, and the changes since: the last folded one of each key and the batches after it."""
        folded = self.spark.read.schema("upto long").parquet(f"{self.path}/folds").agg(F.max("upto")).first()[0]
        log = self.spark.read.schema(self.read_schema).parquet(f"{self.path}/changes")
        log = log if upto is None else log.where(F.col("batch") <= upto)
        if folded is None:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/base"), log
        at = f"{self.path}/folded/upto-{folded}"
        last = self.spark.read.schema(self.read_schema).parquet(f"{at}/last")
        return self.spark.read.schema(self.schema).parquet(f"{at}/base"), last.union(log.where(F.col("batch") > folded))

    def fold(self, upto_batch: int) -> None:
        """Sum up all batches to ``upto_batch``, which must be complete.

        The last change of each key stays, with its place in the order and also if it is a deletion, so
        an older change that arrives after the fold still loses. The note that makes later reads begin
        here is written last, so a fold that fails or runs beside a reader changes nothing.
        """
        base, log = self._parts(upto_batch)
        last = latest(log, self.key, ORDER)
        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        at = f"{self.path}/folded/upto-{upto_batch}"
        last.select(*self.read_schema.names).write.mode("overwrite").parquet(f"{at}/last")
        base.join(last.select(*keys), keys, "left_anti").select(*self.schema.names).write.mode("overwrite").parquet(f"{at}/base")
        self.spark.createDataFrame([(upto_batch,)], "upto long").write.mode("append").parquet(f"{self.path}/folds")

    def read(self) -> DataFrame:
        """Current content."""
        base, log = self._parts()
        return apply_changes(base, log, self.key, ORDER)
