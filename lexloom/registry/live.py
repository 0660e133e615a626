"""Deliveries, resumed streams and folded tables, and the look-ups and orders that no other module reaches."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.dates import format_fr_date
from lexloom.functions.identifiers import appno_from_ecli
from lexloom.functions.queries import expand_court_aliases
from lexloom.operators import filters, windows
from lexloom.plans import collections
from lexloom.registry import Query, table
from lexloom.registry.bulk import RECORDS, write_xml
from lexloom.registry.changes import ORACLES as CHANGES
from lexloom.registry.changes import kept, log
from lexloom.runtime import shared_dir
from lexloom.sources import xml
from lexloom.streaming import flows
from lexloom.streaming.tables import ChangeTable

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Files of the largest archive of a delivery, where it is large.
ARCHIVE_FILES = 16


def _work(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom-live/{name}-{uuid.uuid4().hex}"


def daily_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as statute articles in deliveries of three days, written the newest first; the last day has two archives.

    Files meet in triggers of three, so one trigger holds several files of one archive and several days.
    An archive of more customers has larger files, not more of them, so the number of triggers stays bounded.
    """
    work, c, key = _work(spark, "deltas"), table(spark, folder, "customer"), F.col("c_custkey")
    records = max(RECORDS, 1 << (c.count() // ARCHIVE_FILES).bit_length())
    for day, every, text in (("20240103/b", 8, "quatre"), ("20240103/a", 4, "trois"), ("20240101", 1, "un"), ("20240102", 2, "deux")):
        article = F.struct(F.struct(F.concat(F.lit("A"), key.cast("string")).alias("ID")).alias("META_COMMUN"),
                           F.struct(F.struct(F.lit("1").alias("NUM"), F.lit("VIGUEUR").alias("ETAT")).alias("META_ARTICLE")).alias("META_SPEC"))
        write_xml(c.where(key % every == 0).repartition(2), f"{work}/in/{day}", "ARTICLE", article.alias("META"), F.struct(F.lit(text).alias("CONTENU")).alias("BLOC_TEXTUEL"), records=records)
    schema = "legiarti string, legitext string, num string, titre_text string, etat string, date_debut string, date_fin string, texte string, nota string"
    target = ChangeTable(spark, f"{work}/table", schema, "legiarti")
    target.create()
    flows.stream_deltas(spark, f"{work}/in", xml.STATUTE_ARTICLE, xml.statute_articles, target, f"{work}/cp", row_tag="ARTICLE", files_per_trigger=3).awaitTermination()
    return target.read().select("legiarti", "texte")


QUERIES["stream_deltas"] = daily_deltas
ORACLES["stream_deltas"] = """SELECT 'A' || c_custkey AS legiarti, CASE WHEN c_custkey % 8 = 0 THEN 'quatre' WHEN c_custkey % 4 = 0 THEN 'trois' WHEN c_custkey % 2 = 0 THEN 'deux' ELSE 'un' END AS texte FROM customer"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).withColumn("tx_id", F.concat_ws("-", "id", "seq")).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp")).withColumn(
        "id", F.col("id").cast("string")).select("seq", "tx_id", "id", "op", "ts", "v")


class _FailsOnce(ChangeTable):
    """Stores its second batch, and fails before the stream can note that it is done."""

    failed = False

    def append(self, changes: DataFrame, batch_id: int) -> None:
        super().append(changes, batch_id)
        if batch_id == 1 and not self.failed:
            self.failed = True
            raise RuntimeError("the second batch fails after its rows are stored")


def resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The change log in several batches; the sink fails in the second, and a new run goes on from the checkpoint."""
    work = _work(spark, "resume")
    _entries(spark, folder).repartition(6).write.json(f"{work}/in")
    target = _FailsOnce(spark, f"{work}/table", "id string, v string", "id")
    target.create(kept(spark, folder).withColumn("id", F.col("id").cast("string")))
    run = lambda: flows.stream_change_log(spark, f"{work}/in", "v string", target, f"{work}/cp", files_per_trigger=2).awaitTermination()
    try:
        run()
    except StreamingQueryException:
        run()
    batches = spark.read.parquet(f"{work}/table/changes").agg(F.max("batch").cast("long").alias("batches"))
    return target.read().select(F.col("id").cast("long").alias("id"), "v").crossJoin(F.broadcast(batches)).withColumn("failed", F.lit(target.failed))  # one row


QUERIES["stream_resume"] = resumed
ORACLES["stream_resume"] = f"SELECT *, 2 AS batches, true AS failed FROM ({CHANGES['apply_changes']})"


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """The change log in batches dealt at random, summed up twice on the way: older changes that come later still lose."""
    work, entries = _work(spark, "fold"), _entries(spark, folder).select("id", "v", "seq", "op")
    target = ChangeTable(spark, f"{work}/table", "id string, v string", "id")
    target.create(kept(spark, folder).withColumn("id", F.col("id").cast("string")))
    for batch in range(5):
        target.append(entries.where(F.pmod(F.xxhash64("id", "seq"), F.lit(5)) == batch), batch)
        if batch in (1, 3):
            target.fold(batch)
    return target.read().select(F.col("id").cast("long").alias("id"), "v")


QUERIES["fold_changes"] = folded
ORACLES["fold_changes"] = CHANGES["apply_changes"]


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as hits of the Council of State whose title tells the case, or whose extract does, or neither."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    number = (k + 100000).cast("string")
    title = F.when(k % 3 == 0, F.concat(F.lit("Section du contentieux, "), format_fr_date(day), F.lit(", N° "), number)).when(k % 3 == 1, "Conseil d'Etat").otherwise(" ")
    extract = F.when(k % 3 == 1, F.concat(F.lit("Impôts locaux.; N° "), number, F.lit(" ; ECLI:FR:CECHR:2019:"), number, F.lit(".20190304")))
    return filters.parse_ce_header(table(spark, folder, "orders").select("o_orderkey", title.alias("title"), extract.alias("extracts"))).select("o_orderkey", "title", "numero", "date", "ecli")


_MONTHS_SQL = "[" + ",".join(f"'{m}'" for m in dims.MONTHS) + "]"
QUERIES["council_headers"] = headers
ORACLES["council_headers"] = f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Section du contentieux, ' || day(o_orderdate) || ' ' || {_MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) || ', N° ' || (o_orderkey + 100000)
    WHEN 1 THEN 'Impôts locaux' ELSE 'Arrêt du Conseil d''État' END AS title,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey + 100000 AS VARCHAR) END AS numero, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN DATE '2019-01-01' END AS date,
  CASE WHEN o_orderkey % 3 = 1 THEN 'ECLI:FR:CECHR:2019:' || (o_orderkey + 100000) || '.20190304' END AS ecli FROM orders"""


def court_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Court acronyms in queries; those between quotes stay."""
    n = table(spark, folder, "nation")
    query = F.concat(F.lit('TGI "TJ Lyon" '), "n_name", F.lit(" CPH"))
    return n.select("n_nationkey", expand_court_aliases(query).alias("query"))


def _group(alias: str) -> str:
    names = dict.fromkeys([alias, *dims.COURT_ALIASES[alias]])
    return "(" + " OR ".join(f'"{n}"' if " " in n or "'" in n else n for n in names) + ")"


QUERIES["court_acronyms"] = court_acronyms
ORACLES["court_acronyms"] = "SELECT n_nationkey, '{0} \"TJ Lyon\" ' || n_name || ' {1}' AS query FROM nation".format(*[_group(a).replace("'", "''") for a in ("TGI", "CPH")])


def constit_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's number stands in an older and a newer decision, and in a yet newer one of another court."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    number = F.concat(F.lit("2020-"), "k")
    rows = [c.select(F.concat(F.lit(letter), "k").alias("id"), number.alias("numero"), F.lit(court).alias("juridiction"), F.lit(day).cast("date").alias("date"), F.lit("décision").alias("text"))
            for letter, court, day in (("A", "Conseil constitutionnel", "2001-01-01"), ("B", "Conseil constitutionnel", "2010-01-01"), ("C", "Cour de cassation", "2020-01-01"))]
    found = collections.constit_by_number(c.select(F.col("k").alias("query_id"), number.alias("number")), rows[0].union(rows[1]).union(rows[2]))
    return found.select("query_id", "id")


QUERIES["constit_by_number"] = constit_numbers
ORACLES["constit_by_number"] = "SELECT CAST(c_custkey AS VARCHAR) AS query_id, 'B' || c_custkey AS id FROM customer"


def ordered_names(spark: SparkSession, folder: str) -> DataFrame:
    """The first names of an order that ignores letter case."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    return windows.order_ci(table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", name, "p_partkey").alias("name")), "name").limit(50)


QUERIES["order_ci"] = ordered_names
ORACLES["order_ci"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END || ' ' || p_partkey AS name FROM part ORDER BY lower(name), name LIMIT 50"
QUERIES["appno_from_ecli"] = lambda spark, folder: table(spark, folder, "orders").select("o_orderkey", appno_from_ecli(F.when(
    F.col("o_orderkey") % 4 > 0, F.concat(F.lit("ECLI:CE:ECHR:2002:0101JUD"), F.lpad((F.col("o_orderkey") % 99999 + 1).cast("string"), 7, "0"), F.lit("02"))).otherwise("ECLI:FR:CE:2002:000414302")).alias("appno"))
ORACLES["appno_from_ecli"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 99999 + 1) || '/02' END AS appno FROM orders"
