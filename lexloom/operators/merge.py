"""Change application: distinct inserts, upserts with tombstones, schema widening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest(changes: DataFrame, key: str | list[str], seq: str | list[str]) -> DataFrame:
    """The last change of each key; an aggregate, so hot keys are reduced before the shuffle."""
    order = F.struct(*_keys(seq))
    return changes.groupBy(*_keys(key)).agg(F.max_by(F.struct(*changes.columns), order).alias("_r")).select("_r.*")


def first(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(*_keys(key)).agg(
        F.min_by(F.struct(*rows.columns), F.struct(*_keys(order))).alias("_r")).select("_r.*")


def align_schema(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch rows under the target rows, with columns missing on either side filled with NULL."""
    return target.unionByName(batch, allowMissingColumns=True)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Add rows whose key is new; the first row of a key wins."""
    fresh = first(batch, key, order).join(target.select(*_keys(key)), _keys(key), "left_anti")
    return align_schema(target, fresh.select(*batch.columns))


def upsert(target: DataFrame, changes: DataFrame, key: str | list[str], seq: str | list[str]) -> DataFrame:
    """Replace or add whole rows; the last change of a key wins."""
    last = latest(changes, key, seq)
    drop = [c for c in _keys(seq) if c not in target.columns]
    return align_schema(target.join(last.select(*_keys(key)), _keys(key), "left_anti"), last.drop(*drop))


insert_replace = upsert


def append_versions(target: DataFrame, batch: DataFrame, order: str | list[str] | None = None) -> DataFrame:
    """Statute versions are unique on (article id, start date); repeats are ignored.

    An open start (NULL) is a start like any other. The first row of a version by ``order`` wins,
    without it the least row.
    """
    start = F.coalesce(F.col("date_debut").cast("string"), F.lit(""))
    key = ["legiarti", "_start"]
    fresh = first(batch.withColumn("_start", start), key, order or batch.columns)
    fresh = fresh.join(target.select("legiarti", start.alias("_start")), key, "left_anti")
    return align_schema(target, fresh.select(*batch.columns))


def apply_changes(target: DataFrame, log: DataFrame, key: str | list[str], seq: str | list[str],
                  op: str = "op") -> DataFrame:
    """Apply a log of create / modify / delete entries; deliveries may repeat.

    The log has the target's columns plus ``seq`` and ``op``.
    """
    last = latest(log, key, seq)
    alive = last.where(F.col(op) != "delete").select(*[c for c in target.columns if c in last.columns])
    return align_schema(target.join(last.select(*_keys(key)), _keys(key), "left_anti"), alive)


def change_actions(target: DataFrame, log: DataFrame, key: str | list[str], seq: str | list[str],
                   op: str = "op") -> DataFrame:
    """What each key of the log does to the target: inserted, updated, deleted or ignored."""
    known = target.select(*_keys(key)).distinct().withColumn("_known", F.lit(True))
    last = latest(log, key, seq).join(known, _keys(key), "left")
    deleted = F.col(op) == "delete"
    action = (
        F.when(deleted & F.col("_known"), "deleted").when(deleted, "ignored")
        .when(F.col("_known"), "updated").otherwise("inserted")
    )
    return last.select(*_keys(key), action.alias("action"))


def change_counts(actions: DataFrame) -> DataFrame:
    """Ingest counters per action."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))
