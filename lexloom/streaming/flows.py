"""Incremental flows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.joins import stable_id
from lexloom.operators.merge import first
from lexloom.operators.windows import retain_latest
from lexloom.streaming.tables import ChangeTable

# Usage days are counted at a fixed offset of two hours from UTC.
LOCAL_OFFSET = "INTERVAL 2 HOURS"
# How many buckets each usage series keeps.
RETENTION = {"days": 4000, "hours": 75, "days_tools": 400, "hours_tools": 75}


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now, remembering progress in the checkpoint folder."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(handle).start())


def stream_deltas(spark: SparkSession, path: str, schema: str, parse: Callable[..., DataFrame], target: ChangeTable,
                  checkpoint: str, row_tag: str | None = None, fmt: str = "xml", files_per_trigger: int = 1000) -> StreamingQuery:
    """Daily delta files of a collection, parsed and merged; later deliveries win.

    ``parse(raw, "_seq", "_file")`` projects records and passes the order through: the day that the
    path names, else the file's time, and then the file's name, because the files of an unpacked
    archive share one time. Replaying a day after a newer one changes nothing.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if row_tag:
        reader = reader.option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "_VALUE")
    named, day = F.col("_metadata.file_path"), r"^.*(?<!\d)(20\d{2})-?([01]\d)-?([0-3]\d)(?!\d)"
    delivered = F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(named, day, i) for i in (1, 2, 3)]), F.lit("yyyy-MM-dd"))
    raw = reader.option("recursiveFileLookup", "true").load(path).withColumn(
        "_seq", F.unix_millis(F.coalesce(delivered, F.col("_metadata.file_modification_time")))).withColumn("_file", named)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = parse(batch, "_seq", "_file").withColumnsRenamed({"_seq": "seq", "_file": "file"})
        target.append(rows.withColumn("op", F.lit("modify")), batch_id)

    return _run(raw, handle, checkpoint)


CHANGE = "seq long, tx_id string, id string, op string, ts timestamp"


def stream_change_log(spark: SparkSession, path: str, row_schema: str, target: ChangeTable, checkpoint: str,
                      id_source: Callable[[], DataFrame] | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """Transaction log whose pages overlap. Entries are ordered by their number, so repeats change
    nothing and an entry that arrives late, however late, still counts.

    ``row_schema`` adds the content columns. With ``id_source`` a re-issued decision keeps the
    id it is already known under.
    """
    reader = spark.readStream.schema(f"{CHANGE}, {row_schema}")
    log = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = stable_id(batch, id_source()) if id_source else batch
        target.append(changes, batch_id)

    return _run(log, handle, checkpoint)


def skip_complete(batch: DataFrame, target: DataFrame, id_col: str, text_col: str = "text", min_len: int = 100) -> DataFrame:
    """Rows of a batch whose id is not yet held with a usable text."""
    done = target.where(F.length(text_col) > min_len).select(id_col)
    return first(batch, id_col, batch.columns).join(done, id_col, "left_anti")


def local_time(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.expr(LOCAL_OFFSET)


def usage_counts(events: DataFrame, every: str, ts_col: str = "ts", tool_col: str | None = None) -> DataFrame:
    """Events per tumbling bucket (`1 day`, `1 hour`) in local time, optionally per tool. Works on streams too."""
    keys = [F.window(local_time(ts_col), every).alias("_w")] + ([F.col(tool_col).alias("tool")] if tool_col else [])
    pattern = "yyyy-MM-dd" if every == "1 day" else "yyyy-MM-dd'T'HH"
    counted = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.select(F.date_format("_w.start", pattern).alias("bucket"), *(["tool"] if tool_col else []), "n")


def usage_series(events: DataFrame, ts_col: str = "ts", tool_col: str = "event_type") -> dict[str, DataFrame]:
    """The four usage series over a table of events, each limited to its retention."""
    out = {}
    for name, keep in RETENTION.items():
        every = "1 day" if name.startswith("days") else "1 hour"
        counted = usage_counts(events, every, ts_col, tool_col if name.endswith("tools") else None)
        out[name] = retain_latest(counted, "bucket", keep)
    return out


def usage_counters(spark: SparkSession, path: str, schema: str, target: ChangeTable, checkpoint: str, every: str = "1 hour",
                   ts_col: str = "ts", tool_col: str = "event_type", late: str = "2 days", fmt: str = "parquet") -> StreamingQuery:
    """Usage counters kept current from a stream of events.

    Update mode emits the new count of every touched bucket; the sink replaces it, so a retried
    batch writes the same values. An event that is more than ``late`` older than the newest one of earlier
    batches is not counted any more: this bounds the counts that are kept open.
    """
    events = spark.readStream.schema(schema).format(fmt).load(path)
    typed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)
    # Local midnight is 22:00 UTC of the day before.
    start = "22 hours" if every == "1 day" else "0 seconds"
    window = F.window(ts_col, every, every, start).alias("_w")
    counted = typed.groupBy(window, F.col(tool_col).alias("tool")).agg(F.count("*").alias("n"))
    pattern = "yyyy-MM-dd" if every == "1 day" else "yyyy-MM-dd'T'HH"
    flat = counted.select(F.date_format(local_time(F.col("_w.start")), pattern).alias("bucket"), "tool", "n")

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("id", F.concat_ws("|", "bucket", "tool"))
        target.append(keyed.withColumn("seq", F.lit(batch_id).cast("long")).withColumn("op", F.lit("modify")), batch_id)

    return _run(flat, handle, checkpoint, mode="update")
