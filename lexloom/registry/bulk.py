"""Bulk feeds as round trips: given tables become XML, nested JSON and thesaurus files, and the readers' rows are compared.

Files are written in parallel in the shared folder, next to files of broken records, and read back by the library's readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.plans.thesaurus import build_thesaurus, synonym_table
from lexloom.registry import Query, table
from lexloom.runtime import shared_dir, stage
from lexloom.sources import records, sinks, thesauri, xml

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Services in one object of a dump, records in one XML file (powers of two).
DUMPED, RECORDS = 256, 512


def _work(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom-bulk/{name}-{uuid.uuid4().hex}"


def _s(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _named(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _pages(values: DataFrame, path: str, head: str, tail: str, records: int = RECORDS) -> None:
    """Files of at most ``records`` values each (a power of two), between ``head`` and ``tail``: an XML file has one root."""
    page = F.shiftright(F.monotonically_increasing_id(), records.bit_length() - 1)
    whole = F.concat(F.lit(head), F.array_join(F.collect_list("value"), "\n"), F.lit(tail)).alias("value")
    values.withColumn("_page", page).groupBy("_page").agg(whole).select("value").write.option("maxRecordsPerFile", 1).text(path)


def write_xml(df: DataFrame, path: str, row_tag: str, *columns: Column, records: int = RECORDS) -> None:
    """One record of ``row_tag`` for each row, many in a file, and one file whose record closes its elements in the wrong order."""
    record = F.to_xml(F.struct(*columns), {"rowTag": row_tag, "attributePrefix": "_", "valueTag": "_VALUE"})
    _pages(df.select(record.alias("value")), f"{path}/good", "<FONDS>", "</FONDS>", records)
    df.sparkSession.range(1).select(F.lit(
        f"<FONDS><{row_tag}><META><META_COMMUN><ID>BROKEN</ID></META></META_COMMUN></{row_tag}></FONDS>").alias("value")).write.text(f"{path}/broken")


def _meta(id_: Column, nature: Column | str, **spec: Column) -> Column:
    return _named(META_COMMUN=_named(ID=id_, NATURE=nature), META_SPEC=_named(**spec)).alias("META")


def _statute_files(spark: SparkSession, folder: str) -> str:
    work, k = _work(spark, "statutes"), F.col("o_orderkey")
    article = _named(NUM=F.concat(F.lit(" L"), _s(k), F.lit(" ")), ETAT=F.col("o_orderstatus"), DATE_DEBUT=_s(F.col("o_orderdate").cast("date")),
                     DATE_FIN=F.when(k % 3 > 0, F.lit("2999-01-01")))
    title = F.array(_named(_c_titre_court=F.when(k % 2 == 0, F.concat(F.lit("Code "), "o_orderpriority")), _VALUE=F.concat(F.lit("Titre long & entier "), _s("o_custkey"))))
    write_xml(table(spark, folder, "orders"), work, "ARTICLE", _meta(F.concat(F.lit("LEGIARTI"), _s(k)), "Article", META_ARTICLE=article),
              _named(TEXTE=_named(_cid=F.concat(F.lit("LEGITEXT"), _s("o_custkey")), TITRE_TXT=title)).alias("CONTEXTE"),
              _named(CONTENU=F.concat(F.lit("<p>Alinéa "), _s(k), F.lit("<br/>de <b>suite</b>  &amp; fin</p>"))).alias("BLOC_TEXTUEL"),
              F.when(k % 5 == 0, _named(CONTENU="Voir <i>aussi</i>")).alias("NOTA"))
    return work


QUERIES["read_statutes"] = lambda spark, folder: xml.read_statutes(spark, _statute_files(spark, folder))
ORACLES["read_statutes"] = """SELECT 'LEGIARTI' || o_orderkey AS legiarti, 'LEGITEXT' || o_custkey AS legitext, 'L' || o_orderkey AS num,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Code ' || o_orderpriority ELSE 'Titre long & entier ' || o_custkey END AS titre_text, o_orderstatus AS etat,
  strftime(o_orderdate, '%Y-%m-%d') AS date_debut, CASE WHEN o_orderkey % 3 > 0 THEN '2999-01-01' ELSE '' END AS date_fin,
  'Alinéa ' || o_orderkey || ' de suite & fin' AS texte, CASE WHEN o_orderkey % 5 = 0 THEN 'Voir aussi' ELSE '' END AS nota FROM orders"""
QUERIES["read_broken_xml"] = lambda spark, folder: xml.read_broken(spark, _statute_files(spark, folder), "ARTICLE", xml.STATUTE_ARTICLE).select(
    F.regexp_extract("record", "<ID>(.*?)</ID>", 1).alias("id"), F.regexp_extract("_path", "/([a-z]+)/[^/]*$", 1).alias("part"),
    F.get_json_object("parsed", "$.BLOC_TEXTUEL.CONTENU").alias("body"))
ORACLES["read_broken_xml"] = "SELECT 'BROKEN' AS id, 'broken' AS part, NULL AS body WHERE (SELECT count(*) FROM orders) >= 0"


def _chronicle(df_key: Column) -> Column:
    return F.when(df_key % 3 > 0, _named(TITRE=F.concat(F.lit("Titre "), _s(df_key)), TITREFULL="Titre complet", NUM_JORF=F.concat(F.lit("J"), _s(df_key)), NOR="N1",
                                         DATE_PUBLI="2020-01-02", DATE_TEXTE="2019-12-31"))


def _version(df_key: Column, ministry: Column | str) -> Column:
    return F.when(df_key % 3 < 2, _named(ETAT="VIGUEUR", DATE_DEBUT="2020-02-01", DATE_FIN="2999-01-01", MINISTERE=ministry, TITRE=F.concat(F.lit("Version "), _s(df_key)),
                                         TITREFULL="Version complète"))


_CHRON, _VERS = "{k} % 3 > 0", "{k} % 3 < 2"


def _either(k: str, a: str, b: str | None = None) -> str:
    """The chronicle's value, else the version's, else nothing."""
    return f"CASE WHEN {k} % 3 > 0 THEN {a} ELSE {b or chr(39) * 2} END"


def statute_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as statute texts, a third of them without each of the two blocks."""
    work, k = _work(spark, "texts"), F.col("c_custkey")
    write_xml(table(spark, folder, "customer"), work, "TEXTELR", _meta(F.concat(F.lit("LEGITEXT"), _s(k)), "LOI", META_TEXTE_CHRONICLE=_chronicle(k), META_TEXTE_VERSION=_version(k, "M")))
    return xml.read_statute_texts(spark, work)


QUERIES["read_statute_texts"] = statute_texts
ORACLES["read_statute_texts"] = f"""SELECT 'LEGITEXT' || c_custkey AS legitext, {_either('c_custkey', "'Titre ' || c_custkey", "'Version ' || c_custkey")} AS titre,
  {_either('c_custkey', "'Titre complet'", "'Version complète'")} AS titre_long, 'LOI' AS nature, CASE WHEN c_custkey % 3 < 2 THEN 'VIGUEUR' ELSE '' END AS etat,
  CASE WHEN c_custkey % 3 < 2 THEN '2020-02-01' ELSE '' END AS date_debut, CASE WHEN c_custkey % 3 < 2 THEN '2999-01-01' ELSE '' END AS date_fin,
  {_either('c_custkey', "'2020-01-02'")} AS date_publi, {_either('c_custkey', "'J' || c_custkey")} AS num_jorf, {_either('c_custkey', "'N1'")} AS nor FROM customer"""

# Letters, digits and single blanks of a text: what survives every escape.
_PLAIN_SQL = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"


def _plain(col: str = "text") -> Column:
    return F.trim(F.regexp_replace(col, "[^A-Za-z0-9]+", " "))


def gazette(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as gazette texts; their structure files, in another folder, are passed over."""
    work, k, docs = _work(spark, "gazette"), F.col("doc_id"), table(spark, folder, "documents")
    body = [F.array(F.lit("<p>Vu</p>"), F.lit("autre")).alias("VISAS"), F.array(_plain()).alias("CORPS"), F.array(F.lit("Fait <b>à</b> Paris")).alias("TM")]
    write_xml(docs, f"{work}/texte/version", "TEXTE_VERSION", _meta(F.concat(F.lit("JORFTEXT"), _s(k)), F.col("lang"), META_TEXTE_CHRONICLE=_chronicle(k), META_TEXTE_VERSION=_version(k, F.col("source"))),
              *body, _named(CONTENU="note").alias("NOTA"))
    write_xml(docs, f"{work}/texte/struct", "TEXTE_VERSION", _meta(F.concat(F.lit("STRUCT"), _s(k)), F.col("lang"), META_TEXTE_CHRONICLE=_chronicle(k)))
    return xml.read_gazette(spark, work).withColumn("texte", F.md5("texte"))


QUERIES["read_gazette"] = gazette
ORACLES["read_gazette"] = f"""SELECT 'JORFTEXT' || doc_id AS jorftext, {_either('doc_id', "'Titre ' || doc_id", "'Version ' || doc_id")} AS titre,
  {_either('doc_id', "'Titre complet'", "'Version complète'")} AS titre_long, coalesce(lang, '') AS nature, {_either('doc_id', "'2020-01-02'")} AS date_publi,
  {_either('doc_id', "'2019-12-31'")} AS date_signature, {_either('doc_id', "'J' || doc_id")} AS num_jorf, {_either('doc_id', "'N1'")} AS nor,
  CASE WHEN doc_id % 3 < 2 THEN coalesce(source, '') ELSE '' END AS ministere, md5(regexp_replace('Vu ' || {_PLAIN_SQL} || ' Fait à Paris', ' +', ' ', 'g')) AS texte, 'note' AS nota FROM documents"""


def _decision_files(spark: SparkSession, folder: str) -> str:
    """Documents as court decisions; every fourth one has its text outside the usual block."""
    work, k = _work(spark, "decisions"), F.col("doc_id")
    juri = _named(TITRE=F.concat(F.lit("Arret "), _s(k)), DATE_DEC="2020-01-02", JURIDICTION=F.col("source"), NUMERO=_s(k), SOLUTION="Rejet", PRESIDENT="Mme P",
                  AVOCATS=_named(AVOCAT=F.array(F.lit("Me A"), F.col("lang"))))
    judi = _named(NUMEROS_AFFAIRES=_named(NUMERO_AFFAIRE=F.array(F.concat(F.lit("19-"), _s(k)), F.lit("x"))), FORMATION="CIV1", PUBLI_BULL=_named(_publie=F.when(k % 2 == 0, "oui").otherwise("non"), _VALUE=" "))
    block = F.when(k % 4 > 0, _named(CONTENU=_plain()))
    text = _named(BLOC_TEXTUEL=block, CONTENU=F.when(k % 4 == 0, _plain()), SOMMAIRE=_named(SCT=F.array(F.lit("PLAN A"), F.lit("PLAN B")), ANA=F.array(F.lit("Analyse <b>une</b>"))),
                  CITATION_JP=F.array(_named(CONTENU="Cf. 1990")))
    link = _named(_typelien="CITATION", _sens="source", _naturetexte="CODE", _num=_s(k), _VALUE="Code civil")
    write_xml(table(spark, folder, "documents"), f"{work}/cass", "TEXTE_JURI_JUDI", _meta(F.concat(F.lit("JURITEXT"), _s(k)), "ARRET", META_JURI=juri, META_JURI_JUDI=judi),
              text.alias("TEXTE"), _named(LIEN=F.array(link)).alias("LIENS"))
    return work


QUERIES["read_decisions"] = lambda spark, folder: xml.read_decisions(spark, _decision_files(spark, folder), "cass").select(
    "id", "juridiction", "date", "numero", "solution", "nature", "president", "avocats", "titre", "sommaire", F.md5("texte").alias("texte"))
ORACLES["read_decisions"] = f"""SELECT 'JURITEXT' || doc_id AS id, coalesce(source, '') AS juridiction, '2020-01-02' AS date, CAST(doc_id AS VARCHAR) AS numero, 'Rejet' AS solution, 'ARRET' AS nature,
  'Mme P' AS president, 'Me A ; ' || lang AS avocats, 'Arret ' || doc_id AS titre, 'PLAN A PLAN B Analyse une' AS sommaire, md5({_PLAIN_SQL}) AS texte FROM documents"""
QUERIES["read_decisions_enriched"] = lambda spark, folder: xml.read_decisions_enriched(spark, _decision_files(spark, folder), "cass").select(
    "id", "numero", "formation", "publi_bull", "abstrats", "resume", "renvois", "sommaire", "liens_textes", F.md5("text").alias("text"))
ORACLES["read_decisions_enriched"] = f"""SELECT 'JURITEXT' || doc_id AS id, '19-' || doc_id AS numero, 'CIV1' AS formation, CASE WHEN doc_id % 2 = 0 THEN 'oui' ELSE 'non' END AS publi_bull,
  'PLAN A' || chr(10) || 'PLAN B' AS abstrats, 'Analyse une' AS resume, 'Cf. 1990' AS renvois, 'PLAN A' || chr(10) || chr(10) || 'PLAN B' || chr(10) || chr(10) || 'Analyse une' AS sommaire,
  'CITATION|source|CODE|' || doc_id || ' :: Code civil' AS liens_textes, md5({_PLAIN_SQL}) AS text FROM documents"""


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as agreement texts; containers without the text block are dropped."""
    work, k = _work(spark, "agreements"), F.col("p_partkey")
    block = _named(IDCC=_s(k % 100), TITRE=F.col("p_name"), ETAT="VIGUEUR", DATE_PUBLI="2020-01-01", DATE_DEBUT=F.lit(None).cast("string"), DATE_FIN="2999-01-01")
    write_xml(table(spark, folder, "part"), work, "TEXTEKALI", _meta(F.concat(F.lit("KALITEXT"), _s(k)), "ACCORD", META_TEXTE_KALI=F.when(k % 3 == 0, block), META_CONVENTION_COLLECTIVE=F.when(k % 3 == 1, block)),
              F.when(k % 2 == 0, _named(CONTENU="<p>bloc</p>")).alias("BLOC_TEXTUEL"), F.concat(F.lit("texte "), "p_type").alias("CONTENU"))
    return xml.read_agreements(spark, work)


QUERIES["read_agreements"] = agreements
ORACLES["read_agreements"] = """SELECT 'KALITEXT' || p_partkey AS id, CAST(p_partkey % 100 AS VARCHAR) AS idcc, p_name AS titre, 'ACCORD' AS nature, 'VIGUEUR' AS etat, '2020-01-01' AS date_publi,
  '' AS date_debut, '2999-01-01' AS date_fin, CASE WHEN p_partkey % 2 = 0 THEN 'bloc' ELSE 'texte ' || p_type END AS texte FROM part WHERE p_partkey % 3 < 2"""


def deliberations(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as deliberations whose date stands in one of three tags of one of three blocks."""
    work, k = _work(spark, "deliberations"), F.col("p_partkey")
    block = lambda on, **dated: F.when(k % 3 == on, _named(NUMERO=F.concat(F.lit("2020-"), _s(k)), TITRE=F.col("p_name"), FORMATION="plénière", **dated))
    write_xml(table(spark, folder, "part"), work, "TEXTE_CNIL", _meta(F.concat(F.lit("CNILTEXT"), _s(k)), "D", META_CNIL=block(0, DATE_TEXTE="2020-01-01", DATE="2001-01-01"),
              META_TEXTE_CHRONICLE=block(1, DATE_PUBLI="2020-02-02"), META_JURI=block(2, DATE_DEC="2020-03-03")), _named(CONTENU="délibère").alias("TEXTE"))
    return xml.read_deliberations(spark, work)


QUERIES["read_deliberations"] = deliberations
ORACLES["read_deliberations"] = """SELECT 'CNILTEXT' || p_partkey AS id, '2020-' || p_partkey AS numero, p_name AS titre, '2020-0' || (p_partkey % 3 + 1) || '-0' || (p_partkey % 3 + 1) AS date,
  'plénière' AS formation, 'délibère' AS texte FROM part"""


def services(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as dumped local services, half of them of the justice system, at times by their second kind."""
    work, k = _work(spark, "services"), F.col("c_custkey")
    kind = lambda t: F.struct(t.alias("type_service_local"))
    justice = F.when(k % 4 == 0, F.lit(dims.JUSTICE_PIVOTS[0])).otherwise(F.lit("mairie"))
    service = F.struct(_s(k).alias("id"), F.concat(F.lit(" "), "c_name").alias("nom"), F.array(kind(F.when(k % 4 == 1, F.lit(dims.JUSTICE_PIVOTS[3])).otherwise(F.lit("autre"))), kind(justice)).alias("pivot"),
                       F.array(F.concat("c_mktsegment", F.lit("@x.fr")), F.lit(" ")).alias("adresse_courriel"), F.array(F.struct(F.lit("01").alias("valeur")), F.struct(F.lit("02").alias("valeur"))).alias("telephone"),
                       F.when(k % 3 > 0, F.array(F.struct(F.lit("u1").alias("valeur")))).alias("site_internet"))
    page = F.shiftright(F.monotonically_increasing_id(), DUMPED.bit_length() - 1)
    table(spark, folder, "customer").withColumn("_page", page).groupBy("_page").agg(F.collect_list(service).alias("service")).select("service").write.option("maxRecordsPerFile", 1).json(work)
    return records.read_services_json(spark, work).withColumn("mails", F.array_join("mails", "|"))


QUERIES["read_services"] = services
ORACLES["read_services"] = f"""SELECT CASE WHEN c_custkey % 4 = 1 THEN '{dims.JUSTICE_PIVOTS[3]}' ELSE '{dims.JUSTICE_PIVOTS[0]}' END AS type, c_name AS nom, c_mktsegment || '@x.fr' AS mails, '01;02' AS tel,
  CASE WHEN c_custkey % 3 > 0 THEN 'u1' ELSE '' END AS site, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 4 < 2"""


def api_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as contacts whose fields drift: text, a list, an object, or any of them written as text."""
    work, k = _work(spark, "contacts"), F.col("c_custkey")
    address = F.to_json(F.struct(F.lit("").alias("complement1"), F.lit("1 rue X").alias("numero_voie"), F.lit("75001").alias("code_postal"), F.col("c_mktsegment").alias("nom_commune")))
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)  # a JSON string
    mail = F.when(k % 4 == 0, F.lit('["a@x", ""]')).when(k % 4 == 1, F.lit('"b@x"')).when(k % 4 == 2, quoted(F.lit('["a@x"]'))).otherwise("null")
    phone = F.when(k % 2 == 0, F.lit('[{"valeur":"01"},{"valeur":"02"}]')).otherwise(F.lit('"03"'))
    place = F.when(k % 3 == 0, address).when(k % 3 == 1, quoted(F.concat(F.lit("["), address, F.lit("]")))).otherwise("null")
    pivot = F.when(k % 2 == 0, F.lit('[{"type_service_local":"mairie"}]')).otherwise("null")
    line = F.concat(F.lit('{"id":"'), _s(k), F.lit('","nom":'), quoted(F.col("c_name")), F.lit(',"adresse_courriel":'), mail, F.lit(',"telephone":'), phone, F.lit(',"adresse":'), place,
                    F.lit(',"pivot":'), pivot, F.lit("}"))
    table(spark, folder, "customer").select(line.alias("value")).write.text(work)
    return records.read_api_contacts(spark, work).select("id", "nom", F.array_join("mails", "|").alias("mails"), "telephone", "adresse", "pivot_kind")


QUERIES["read_api_contacts"] = api_contacts
ORACLES["read_api_contacts"] = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nom, CASE WHEN c_custkey % 4 = 1 THEN 'b@x' ELSE 'a@x' END AS mails,
  CASE WHEN c_custkey % 2 = 0 THEN '01 ; 02' ELSE '03' END AS telephone, CASE WHEN c_custkey % 3 < 2 THEN '1 rue X, 75001 ' || c_mktsegment ELSE '' END AS adresse,
  CASE WHEN c_custkey % 2 = 0 THEN 'mairie' ELSE 'chapeau' END AS pivot_kind FROM customer WHERE c_custkey % 4 < 3"""


def court_api(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as court decisions whose list fields are at times one text, or lists written as text."""
    work, k = _work(spark, "court"), F.col("doc_id")
    row = F.struct(_s(k).alias("id"), F.lit("arret").alias("type"), F.lit("tj").alias("jurisdiction"), F.concat(F.lit("tj"), _s(k % 7)).alias("location"), F.concat(F.lit("26/"), F.lpad(_s(k % 100000), 5, "0")).alias("number"),
                   F.lit("2026-07-02").alias("decision_date"), F.when(k % 2 == 0, F.concat(F.lit("<p>"), _plain(), F.lit("</p>"))).alias("text_html"), _plain().alias("text"))
    whole = F.to_json(row)
    themes = F.when(k % 3 == 0, F.lit('["un","deux"]')).when(k % 3 == 1, F.lit('"un"')).otherwise(F.lit('"[\\"un\\",\\"deux\\"]"'))
    docs = table(spark, folder, "documents").where("text is not null")
    docs.select(F.concat(F.substring(whole, 1, F.length(whole) - 1), F.lit(',"themes":'), themes, F.lit("}")).alias("value")).write.text(work)
    places = spark.range(7).where("id % 2 = 0").select(F.concat(F.lit("tj"), _s("id")).alias("location"), F.concat(F.lit("Tribunal judiciaire de Ville "), _s("id")).alias("name"))
    return records.map_court_api(records.read_court_api(spark, work), places).where("juridiction like '%Ville%'").select(
        "id", "titre", "juridiction", "numero", "abstrats", "numero_rg_norm", F.md5("text").alias("digest"))


QUERIES["read_court_api"] = court_api
ORACLES["read_court_api"] = f"""WITH d AS (SELECT *, '26/' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS rg, 'Tribunal judiciaire de Ville ' || (doc_id % 7) AS j FROM documents WHERE doc_id % 7 % 2 = 0 AND text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS id, j || ', 2026-07-02, n° ' || rg AS titre, j AS juridiction, rg AS numero, CASE WHEN doc_id % 3 = 1 THEN '["un"]' ELSE '["un","deux"]' END AS abstrats,
  rg || ' ' || replace(rg, '/', '-') || ' ' || replace(rg, '/', '') AS numero_rg_norm, md5({_PLAIN_SQL}) AS digest FROM d"""


def _skos_files(spark: SparkSession, folder: str) -> str:
    """Nations and customers as concepts under regions and nations; what is said of a customer is spread over a typed and a described node."""
    work = _work(spark, "skos")
    about = lambda kind, key: F.concat(F.lit(f' rdf:about="http://x/{kind}'), _s(key), F.lit('">'))
    label = lambda tag, lang, value: F.concat(F.lit(f'<skos:{tag} xml:lang="{lang}">'), value, F.lit(f"</skos:{tag}>"))
    link = lambda tag, kind, key: F.concat(F.lit(f'<skos:{tag} rdf:resource="http://x/{kind}'), _s(key), F.lit('"/>'))
    node = lambda tag, *parts: F.concat(F.lit(f"<{tag}"), *parts, F.lit(f"</{tag}>")).alias("value")
    concept = F.lit('<rdf:type rdf:resource="http://w#Concept"/>')
    r, n, c = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    parts = {
        "r": r.select(node("skos:Concept", about("r", "r_regionkey"), label("prefLabel", "fr", F.col("r_name")), label("prefLabel", "en", F.lit("no")))),
        "n": n.select(node("rdf:Description", about("n", "n_nationkey"), concept, label("prefLabel", "fr", F.col("n_name")), link("broader", "r", "n_regionkey"))),
        "c": c.select(node("skos:Concept", about("c", "c_custkey"), label("prefLabel", "fr", F.col("c_name")))),
        "d": c.select(node("rdf:Description", about("c", "c_custkey"), label("altLabel", "fr", F.concat("c_mktsegment", F.lit(" "), _s("c_custkey"))), link("broader", "n", "c_nationkey"))),
        "x": n.select(node("rdf:Description", about("x", "n_nationkey"), F.lit('<rdf:type rdf:resource="http://w#Other"/>'), label("prefLabel", "fr", F.lit("non")))),
    }
    for name, values in parts.items():
        _pages(values, f"{work}/{name}", '<rdf:RDF xmlns:rdf="r" xmlns:skos="s">', "</rdf:RDF>")
    return work


def skos_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return thesauri.read_skos(spark, _skos_files(spark, folder), "s", "all")[0].select("code", "label", "parent_code")


QUERIES["read_skos"] = skos_concepts
ORACLES["read_skos"] = """SELECT 'r' || r_regionkey AS code, r_name AS label, NULL AS parent_code FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer"""


def skos_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """The synonyms that a thesaurus built from the file offers for customers' names."""
    concepts, labels, _ = build_thesaurus([thesauri.read_skos(spark, _skos_files(spark, folder), "s", "all")])
    return synonym_table(stage(concepts, "concepts"), stage(labels, "labels")).where("label_normalized like 'CUSTOMER%'").select("label_normalized", "synonym")


QUERIES["skos_synonyms"] = skos_synonyms
ORACLES["skos_synonyms"] = "SELECT upper(c_name) AS label_normalized, c_mktsegment || ' ' || c_custkey AS synonym FROM customer"


def flat_themes(spark: SparkSession, folder: str) -> DataFrame:
    """One list of quoted themes for each region."""
    lists = table(spark, folder, "region").select(F.concat(F.lit("['"), "r_name", F.lit("', \""), "r_name", F.lit(" deux\"]")).alias("value"))
    return thesauri.themes_flat(lists, "t").select("code", "label", "depth")


QUERIES["themes_flat"] = flat_themes
ORACLES["themes_flat"] = "SELECT 'jc0001' AS code, r_name AS label, 1 AS depth FROM region UNION ALL SELECT 'jc0002', r_name || ' deux', 1 FROM region"


def theme_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Regions with their nations as two-level taxonomies, one object for each region."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    subs = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "n_regionkey", "n_nationkey"), "n_name"))).alias("subs"))
    trees = r.join(subs, "r_regionkey").select(F.to_json(F.create_map(_s("r_regionkey"), F.struct(F.col("r_name").alias("label"), "subs"))).alias("value"))
    concepts, edges = thesauri.themes_tree(trees, "t")
    return concepts.join(edges, concepts["code"] == edges["src_code"], "left").select("code", "label", "depth", "parent_code", "dst_code")


QUERIES["themes_tree"] = theme_tree
ORACLES["themes_tree"] = """SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS label, 1 AS depth, NULL AS parent_code, NULL AS dst_code FROM region
UNION ALL SELECT n_regionkey || '.' || n_nationkey, n_name, 2, CAST(n_regionkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation"""


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Written collections are fresh; one written an hour ago would not be."""
    work = _work(spark, "fresh")
    sinks.write_table(table(spark, folder, "orders").select("o_orderkey", _s(F.col("o_orderdate").cast("date")).alias("date")), f"{work}/orders")
    sinks.write_json(table(spark, folder, "customer"), f"{work}/customer")
    found = sinks.freshness(spark, {name: f"{work}/{name}" for name in ("orders", "customer")})
    return found.select("collection", (F.col("last_update") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("fresh"))


QUERIES["freshness"] = freshness
ORACLES["freshness"] = "SELECT 'orders' AS collection, count(*) > 0 AS fresh FROM orders UNION ALL SELECT 'customer', count(*) > 0 FROM customer"
