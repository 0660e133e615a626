import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lexloom.sources import xml
from lexloom.streaming import flows
from lexloom.streaming.tables import ChangeTable

ARTICLE = ("<ARTICLE><META><META_COMMUN><ID>{id}</ID></META_COMMUN><META_SPEC><META_ARTICLE><NUM>1</NUM><ETAT>VIGUEUR</ETAT></META_ARTICLE></META_SPEC></META>"
           "<BLOC_TEXTUEL><CONTENU><p>{text}</p></CONTENU></BLOC_TEXTUEL></ARTICLE>")


def put(folder, name, text, when=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text, encoding="utf8")
    if when:
        os.utime(path, (when, when))


def test_change_table_is_idempotent(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "id string, v string", "id")
    table.create(spark.createDataFrame([("a", "0"), ("b", "0")], "id string, v string"))
    change = lambda rows: spark.createDataFrame(rows, "id string, v string, seq long, op string")
    table.append(change([("a", "1", 1, "modify"), ("b", None, 2, "delete")]), 0)
    table.append(change([("c", "1", 3, "create"), ("a", "old", 0, "modify")]), 1)
    state = lambda: sorted((r.id, r.v) for r in table.read().collect())
    assert state() == [("a", "1"), ("c", "1")]
    table.append(change([("c", "1", 3, "create"), ("a", "old", 0, "modify")]), 1)  # the same batch again
    assert state() == [("a", "1"), ("c", "1")]
    folded = ChangeTable(spark, str(tmp_path / "u"), "id string, v string", "id")
    folded.create(table.read())
    assert sorted((r.id, r.v) for r in folded.read().collect()) == [("a", "1"), ("c", "1")]


def test_folds_change_nothing(spark, tmp_path):
    """Reads before, during (the base written, the note not) and after a fold agree; older changes still lose after it."""
    table = ChangeTable(spark, str(tmp_path / "t"), "id string, v string", "id")
    table.create(spark.createDataFrame([("a", "0"), ("b", "0"), ("z", "0")], "id string, v string"))
    change = lambda rows: spark.createDataFrame(rows, "id string, v string, seq long, op string")
    state = lambda: sorted((r.id, r.v) for r in table.read().collect())
    table.append(change([("a", "5", 5, "modify"), ("b", None, 6, "delete")]), 0)
    table.append(change([("c", "3", 3, "create")]), 1)
    before = state()
    assert before == [("a", "5"), ("c", "3"), ("z", "0")]
    (tmp_path / "t" / "folded" / "upto-1" / "base").mkdir(parents=True)  # a fold that never came to its note
    assert state() == before
    table.fold(1)
    assert state() == before
    table.append(change([("a", "old", 4, "modify"), ("b", "old", 1, "modify"), ("c", "9", 9, "modify")]), 2)
    assert state() == [("a", "5"), ("c", "9"), ("z", "0")]
    table.fold(2)
    table.append(change([("c", "8", 8, "modify"), ("b", "new", 10, "create")]), 3)
    assert state() == [("a", "5"), ("b", "new"), ("c", "9"), ("z", "0")]


def test_delta_files(spark, tmp_path):
    old, new = time.time() - 1000, time.time()
    put(tmp_path / "in", "1.xml", ARTICLE.format(id="L1", text="un"), old)
    put(tmp_path / "in", "2.xml", ARTICLE.format(id="L1", text="deux"), new)
    put(tmp_path / "in", "3.xml", ARTICLE.format(id="L2", text="trois"), old)
    schema = "legiarti string, legitext string, num string, titre_text string, etat string, date_debut string, date_fin string, texte string, nota string"
    table = ChangeTable(spark, str(tmp_path / "t"), schema, "legiarti")
    table.create()
    run = lambda: flows.stream_deltas(spark, str(tmp_path / "in"), xml.STATUTE_ARTICLE, xml.statute_articles, table, str(tmp_path / "cp"),
                                      row_tag="ARTICLE").awaitTermination()
    run()
    state = lambda: {r.legiarti: r.texte for r in table.read().collect()}
    assert state() == {"L1": "deux", "L2": "trois"}
    put(tmp_path / "in", "4.xml", ARTICLE.format(id="L2", text="quatre"), new + 10)
    run()  # resumes from the checkpoint with the new file only
    assert state() == {"L1": "deux", "L2": "quatre"}


def test_delta_files_of_one_archive(spark, tmp_path):
    """One time stamp for all: the delivery day in the path decides, then the file's name."""
    when = time.time()
    for day, name, text in (("20240102", "a.xml", "nouveau"), ("20240101", "b.xml", "ancien"), ("20240102", "b.xml", "dernier")):
        put(tmp_path / "in" / day, name, ARTICLE.format(id="L1", text=text), when)
    schema = "legiarti string, texte string"
    table = ChangeTable(spark, str(tmp_path / "t"), schema, "legiarti")
    table.create()
    flows.stream_deltas(spark, str(tmp_path / "in"), xml.STATUTE_ARTICLE, xml.statute_articles, table, str(tmp_path / "cp"), row_tag="ARTICLE").awaitTermination()
    assert [r.texte for r in table.read().collect()] == ["dernier"]


def test_late_change_log_entries_count(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "id string, v string", "id")
    table.create()
    for i, day in enumerate(("10", "05", "11")):
        put(tmp_path / "in", f"{i}.json", json.dumps({"seq": int(day), "tx_id": day, "id": f"d{i}", "op": "create", "ts": f"2024-01-{day}T00:00:00", "v": day}))
        flows.stream_change_log(spark, str(tmp_path / "in"), "v string", table, str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.v for r in table.read().collect()} == {"d0": "10", "d1": "05", "d2": "11"}


def test_change_log_keeps_ids_and_drops_repeats(spark, tmp_path):
    rows = [{"seq": 1, "tx_id": "t1", "id": "h1", "op": "create", "ts": "2024-01-01T00:00:00", "numero": "21/05835"},
            {"seq": 1, "tx_id": "t1", "id": "h1", "op": "create", "ts": "2024-01-01T00:00:00", "numero": "21/05835"},
            {"seq": 2, "tx_id": "t2", "id": "h2", "op": "create", "ts": "2024-01-01T01:00:00", "numero": "19/00001"}]
    put(tmp_path / "in", "a.json", "\n".join(map(json.dumps, rows)))
    table = ChangeTable(spark, str(tmp_path / "t"), "id string, numero string", "id")
    table.create(spark.createDataFrame([("JURITEXT1", "21/05835")], "id string, numero string"))
    flows.stream_change_log(spark, str(tmp_path / "in"), "numero string", table, str(tmp_path / "cp"), id_source=table.read).awaitTermination()
    assert sorted((r.id, r.numero) for r in table.read().collect()) == [("JURITEXT1", "21/05835"), ("h2", "19/00001")]


def test_usage_counters(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 21:59:00", "a"), ("2024-01-01 22:01:00", "a"), ("2024-01-02 10:00:00", "b")], "ts string, event_type string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    table = ChangeTable(spark, str(tmp_path / "t"), "id string, bucket string, tool string, n long", "id")
    table.create()
    flows.usage_counters(spark, str(tmp_path / "in"), events.schema, table, str(tmp_path / "cp"), every="1 day").awaitTermination()
    assert {(r.bucket, r.tool): r.n for r in table.read().collect()} == {("2024-01-01", "a"): 1, ("2024-01-02", "a"): 1, ("2024-01-02", "b"): 1}
    series = flows.usage_series(events)
    assert {r.bucket: r.n for r in series["days"].collect()} == {"2024-01-01": 1, "2024-01-02": 2}
    assert series["hours_tools"].columns == ["bucket", "tool", "n"]


def test_skip_complete(spark):
    held = spark.createDataFrame([(1, "x" * 200), (2, "court")], "id int, text string")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "id int, text string")
    assert sorted(r.id for r in flows.skip_complete(batch, held, "id").collect()) == [2, 3]


def test_large_archives_have_larger_files_not_more(spark, tmp_path, monkeypatch):
    from lexloom.registry import live

    class Written(Exception):
        pass

    def written(spark, path, *args, **options):
        raise Written(path)

    spark.range(20_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(live.flows, "stream_deltas", written)
    with pytest.raises(Written) as raised:
        live.daily_deltas(spark, str(tmp_path))
    largest = spark.read.text(f"{raised.value.args[0]}/20240101/good")
    # 512 records a file made 40 files; one trigger for every three never ends on large tables.
    assert len(largest.inputFiles()) <= live.ARCHIVE_FILES and largest.where(F.col("value").contains("<ARTICLE>")).count() == 20_000
