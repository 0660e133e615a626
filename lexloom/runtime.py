"""Session helpers: shared staging area, literal dimension tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGE_FOLDER = "lexloom-stage"
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a private folder; a cluster
    without it is refused, because a machine-local folder would not survive
    the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    private = tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set("spark.checkpoint.dir", private)
    return private


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and lets several branches of a plan share one computation.
    The copy is columnar, so later branches still prune columns and push filters.
    Narrow rows shrink so far on disk that a split by bytes holds very many of them; with
    ``rows_per_file`` a file ends after so many, and as every file has its cost in a split,
    a later task gets a bounded number of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_STAGE_FOLDER}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if (owned := _staged.get()) is not None:
        owned.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove at the end all folders that :func:`stage` writes inside, also after a failure.

    A result that reads staged folders has to be written before the end. An inner ``staging``
    owns its own folders; those staged outside of any stay until the shared area is cleared.
    """
    owned: list[str] = []
    token = _staged.set(owned)
    try:
        yield
    finally:
        _staged.reset(token)
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for path in owned:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(settings).delete(folder, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """A table of at most ``most`` rows goes to every task, also where the planner's own limit is lower or off.

    Without that the table it meets would be exchanged and sorted. A larger one is left to the planner.
    """
    return F.broadcast(df) if df.count() <= most else df


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the optimizer from copying the expressions behind ``columns`` into later filters.

    Filters are pushed through projections by substitution; over a chain of nested expressions
    that multiplies the work. A generator in between stops the substitution.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*columns))))


def values_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table of literal rows that the optimizer knows the size of.

    Expressed as ``inline(array(struct(...)))`` so that no Python worker runs
    and the planner can broadcast it from its statistics.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    structs = [
        F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for f, value in zip(fields, row)])
        for row in rows
    ]
    one = spark.range(1)
    if not structs:
        return one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)
    return one.select(F.inline(F.array(*structs)))


def map_lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Look ``key`` up in a fixed mapping held as a literal map."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, default)


def blank_to_null(col: Column | str) -> Column:
    """Empty or whitespace-only text counts as missing."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.trim(col) != "", col)
