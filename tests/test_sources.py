import datetime
import json

from pyspark.sql import functions as F

from lexloom.plans import index
from lexloom.sources import html, records, sinks, thesauri, xml

ARTICLE = """<?xml version="1.0" encoding="UTF-8"?>
<ARTICLE><META><META_COMMUN><ID>LEGIARTI01</ID><NATURE>Article</NATURE></META_COMMUN>
<META_SPEC><META_ARTICLE><NUM>1128</NUM><ETAT>VIGUEUR</ETAT><DATE_DEBUT>2016-10-01</DATE_DEBUT><DATE_FIN>2999-01-01</DATE_FIN></META_ARTICLE></META_SPEC></META>
<CONTEXTE><TEXTE cid="LEGITEXT000006070721"><TITRE_TXT c_titre_court="Code civil" debut="1804-03-21">Code civil long</TITRE_TXT></TEXTE></CONTEXTE>
<NOTA><CONTENU><p>Voir &amp;c.</p></CONTENU></NOTA>
<BLOC_TEXTUEL><CONTENU><p>Sont n&#233;cessaires :<br/>1° Le <b>consentement</b></p></CONTENU></BLOC_TEXTUEL></ARTICLE>"""

DECISION = """<?xml version="1.0" encoding="UTF-8"?>
<TEXTE_JURI_JUDI><META><META_COMMUN><ID>JURITEXT01</ID><NATURE>ARRET</NATURE></META_COMMUN><META_SPEC>
<META_JURI><TITRE>Arret du jour</TITRE><DATE_DEC>2020-01-02</DATE_DEC><JURIDICTION>Cour de cassation</JURIDICTION><NUMERO>7</NUMERO><SOLUTION>Rejet</SOLUTION>
<AVOCATS><AVOCAT>Me A</AVOCAT><AVOCAT>Me B</AVOCAT></AVOCATS></META_JURI>
<META_JURI_JUDI><NUMEROS_AFFAIRES><NUMERO_AFFAIRE>19-14001</NUMERO_AFFAIRE><NUMERO_AFFAIRE>x</NUMERO_AFFAIRE></NUMEROS_AFFAIRES><FORMATION>CIV1</FORMATION><PUBLI_BULL publie="oui"/></META_JURI_JUDI>
</META_SPEC></META><TEXTE><BLOC_TEXTUEL><CONTENU>Vu <i>les</i> textes</CONTENU></BLOC_TEXTUEL>
<SOMMAIRE><SCT ID="1">PLAN A</SCT><SCT ID="2">PLAN B</SCT><ANA ID="3">Analyse <b>une</b></ANA></SOMMAIRE>
<CITATION_JP><CONTENU>Cf. 1990</CONTENU></CITATION_JP></TEXTE>
<LIENS><LIEN typelien="CITATION" sens="source" naturetexte="CODE" num="1128">Code civil</LIEN><LIEN/></LIENS></TEXTE_JURI_JUDI>"""


def put(folder, name, text):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf8")
    return str(folder)


def test_statutes(spark, tmp_path):
    put(tmp_path, "a/1.xml", ARTICLE)
    path = put(tmp_path, "a/bad.xml", "<ARTICLE><META>")
    row, = xml.read_statutes(spark, path).collect()
    assert (row.legiarti, row.legitext, row.num, row.titre_text, row.date_fin) == (
        "LEGIARTI01", "LEGITEXT000006070721", "1128", "Code civil", "2999-01-01")
    assert row.texte == "Sont nécessaires : 1° Le consentement" and row.nota == "Voir &c."


def test_broken_records_are_listed(spark, tmp_path):
    put(tmp_path, "a.xml", ARTICLE)
    path = put(tmp_path, "b.xml", "<F><ARTICLE><META><META_COMMUN><ID>X</ID></META></META_COMMUN></ARTICLE></F>")
    row, = xml.read_broken(spark, path, "ARTICLE", xml.STATUTE_ARTICLE).collect()
    assert row._path.endswith("b.xml") and "<ID>X</ID>" in row.record
    assert xml.read_statutes(spark, path).count() == 1


def test_fields_that_drift(spark, tmp_path):
    """The same field as text, list, object, list written as text, number, null, or missing."""
    lines = [{"id": "1", "nom": "n", "adresse_courriel": ["a@x", None], "telephone": {"valeur": "01"}}, {"id": 2, "nom": "n", "adresse_courriel": '["b@x"]', "telephone": 3},
             {"id": "3", "nom": None, "adresse_courriel": "c@x", "telephone": None, "pivot": "{"}, {"id": "4", "adresse_courriel": None}, {"id": "5"}]
    path = put(tmp_path / "c", "c.json", "\n".join(json.dumps(x) for x in lines))
    got = {r.id: (r.mails, r.telephone, r.pivot_kind) for r in records.read_api_contacts(spark, path).collect()}
    assert got == {"1": (["a@x"], "01", "chapeau"), "2": (["b@x"], "3", "chapeau"), "3": (["c@x"], "", "autre")}
    lines = [{"id": "1", "themes": ["a", "b"]}, {"id": "2", "themes": "a"}, {"id": "3", "themes": '["a","b"]'}, {"id": "4", "themes": None}, {"id": "5", "number": 7}]
    path = put(tmp_path / "d", "d.json", "\n".join(json.dumps(x) for x in lines))
    rows = {r.id: r for r in records.read_court_api(spark, path).collect()}
    assert [rows[str(i)].themes for i in range(1, 6)] == [["a", "b"], ["a"], ["a", "b"], None, None] and rows["5"].number == "7"


def test_statute_texts_gazette_agreements_deliberations(spark, tmp_path):
    meta = "<META><META_COMMUN><ID>{id}</ID><NATURE>LOI</NATURE></META_COMMUN><META_SPEC>{spec}</META_SPEC></META>"
    chron = "<META_TEXTE_CHRONICLE><TITRE>T</TITRE><NOR>N1</NOR><DATE_PUBLI>2020-01-01</DATE_PUBLI><DATE_TEXTE>2019-12-31</DATE_TEXTE></META_TEXTE_CHRONICLE>"
    p = put(tmp_path / "t", "x.xml", f"<TEXTELR>{meta.format(id='LEGITEXT1', spec=chron)}</TEXTELR>")
    t = xml.read_statute_texts(spark, p).first()
    assert (t.legitext, t.titre, t.nor, t.etat) == ("LEGITEXT1", "T", "N1", "")
    body = "<VISAS><p>Vu</p></VISAS><CORPS>le corps</CORPS><TM>fin</TM>"
    put(tmp_path / "g", "texte/version/x.xml", f"<TEXTE_VERSION>{meta.format(id='JORFTEXT1', spec=chron)}{body}</TEXTE_VERSION>")
    p = put(tmp_path / "g", "texte/struct/x.xml", f"<TEXTE_VERSION>{meta.format(id='JORFTEXT2', spec=chron)}</TEXTE_VERSION>")
    g, = xml.read_gazette(spark, p).collect()
    assert (g.jorftext, g.texte, g.date_signature) == ("JORFTEXT1", "Vu le corps fin", "2019-12-31")
    kali = "<META_TEXTE_KALI><IDCC>44</IDCC><TITRE>Chimie</TITRE></META_TEXTE_KALI>"
    put(tmp_path / "k", "a.xml", f"<TEXTEKALI>{meta.format(id='KALITEXT1', spec=kali)}<CONTENU>texte</CONTENU></TEXTEKALI>")
    p = put(tmp_path / "k", "b.xml", f"<TEXTEKALI>{meta.format(id='KALICONT1', spec='')}</TEXTEKALI>")
    k, = xml.read_agreements(spark, p).collect()
    assert (k.id, k.idcc, k.texte) == ("KALITEXT1", "44", "texte")
    cnil = "<META_CNIL><NUMERO>2020-1</NUMERO><DATE_TEXTE>2020-02-02</DATE_TEXTE></META_CNIL>"
    p = put(tmp_path / "c", "a.xml", f"<TEXTE_CNIL>{meta.format(id='CNILTEXT1', spec=cnil)}<BLOC_TEXTUEL><CONTENU>délibère</CONTENU></BLOC_TEXTUEL></TEXTE_CNIL>")
    c = xml.read_deliberations(spark, p).first()
    assert (c.numero, c.date, c.texte) == ("2020-1", "2020-02-02", "délibère")


def test_decisions(spark, tmp_path):
    path = put(tmp_path, "cass/1.xml", DECISION)
    d = xml.read_decisions(spark, path, "cass").first()
    assert (d.id, d.avocats, d.texte, d.solution) == ("JURITEXT01", "Me A ; Me B", "Vu les textes", "Rejet")
    e = xml.read_decisions_enriched(spark, path, "cass").first()
    assert (e.numero, e.formation, e.publi_bull) == ("19-14001", "CIV1", "oui")
    assert (e.abstrats, e.resume, e.renvois) == ("PLAN A\nPLAN B", "Analyse une", "Cf. 1990")
    assert e.sommaire == "PLAN A\n\nPLAN B\n\nAnalyse une" and e.liens_textes == "CITATION|source|CODE|1128 :: Code civil"
    assert len(e) == 25


def test_directory_feeds(spark, tmp_path):
    path = put(tmp_path / "csv", "d.csv", 'id;type;nom;mails;tel;site\n1;ta;"TA; Paris";a@x ; b@x;01;\n2;ta;Lyon;;;\n')
    schema = "id string, type string, nom string, mails string, tel string, site string"
    text = 'id;type;nom;mails;tel;site\n1;ta;"TA; Paris";"a@x ; b@x";01;\n2;ta;Lyon;;;\n'
    (tmp_path / "csv" / "d.csv").write_text(text, encoding="utf8")
    rows = {r.id: (r.nom, r.mails) for r in records.read_directory_csv(spark, path, schema).collect()}
    assert rows == {"1": ("TA; Paris", ["a@x", "b@x"]), "2": ("Lyon", [])}
    services = {"service": [
        {"id": "s1", "nom": " TJ ", "pivot": [{"type_service_local": "mairie"}, {"type_service_local": "tgi"}],
         "adresse_courriel": ["a@x", " "], "telephone": [{"valeur": "01"}, {"valeur": "02"}], "site_internet": [{"valeur": "u1"}, {"valeur": "u2"}]},
        {"id": "s2", "nom": "M", "pivot": [{"type_service_local": "mairie"}]}]}
    s, = records.read_services_json(spark, put(tmp_path / "js", "s.json", json.dumps(services))).collect()
    assert (s.type, s.nom, s.mails, s.tel, s.site) == ("tgi", "TJ", ["a@x"], "01;02", "u1")
    api = spark.createDataFrame([
        ("1", "n", None, '["a@x"]', '[{"valeur":"01"},{"valeur":"02"}]', "https://u", "t", None,
         '[{"complement1":"","numero_voie":"1 rue X","code_postal":"75001","nom_commune":"Paris"}]', '[{"type_service_local":"mairie"}]'),
        ("2", "n", None, "b@x", None, None, None, None, None, None), ("3", "n", None, None, None, None, None, None, None, "x")],
        "id string, nom string, sigle string, adresse_courriel string, telephone string, site_internet string, type_organisme string, hierarchie string, adresse string, pivot string")
    got = {r.id: r for r in records.flatten_api_contacts(api).collect()}
    assert set(got) == {"1", "2"} and got["1"].telephone == "01 ; 02" and got["1"].adresse == "1 rue X, 75001 Paris"
    assert (got["1"].pivot_kind, got["2"].pivot_kind, got["2"].mails) == ("mairie", "chapeau", ["b@x"])


def test_json_feeds(spark, tmp_path):
    hit = {"_source": {"Identification": "DTA_1_2.xml", "Numero_ECLI": "undefined", "Date_Lecture": "", "lastModified": "2023-01-02T03:04", "paragraph": "a $$$ $$$ b"}}
    h = records.read_admin_hits(spark, put(tmp_path / "h", "h.json", json.dumps(hit))).first()
    assert (h.id, h.ecli, h.date, h.texte) == ("DTA_1_2", None, "2023-01-02", "a\n\nb")
    court = spark.createDataFrame([("1", "tj", "tj02691", "26/00038", "2026-07-02", "t", None, ["th"]), ("2", "ca", "ca_lyon", None, "2020-01-01", "t", "<p>a</p><p>b</p>", None)],
                                  "id string, jurisdiction string, location string, number string, decision_date string, text string, text_html string, themes array<string>")
    for c, t in {"type": "string", "numbers": "array<string>", "solution": "string", "chamber": "string", "formation": "string", "ecli": "string", "president": "string",
                 "summary": "string", "resume": "string", "rapprochements": "array<string>", "rapporteur": "string", "publication": "array<string>", "nature": "string"}.items():
        court = court.withColumn(c, F.lit(None).cast(t))
    loc = spark.createDataFrame([("tj02691", "Tribunal judiciaire de Saint-Quentin")], "location string, name string")
    got = {r.id: r for r in records.map_court_api(court, loc).collect()}
    assert got["1"].titre == "Tribunal judiciaire de Saint-Quentin, 2026-07-02, n° 26/00038" and got["1"].numero_rg_norm == "26/00038 26-00038 2600038"
    assert got["1"].abstrats == '["th"]' and got["2"].text == "a\n\nb" and got["2"].juridiction == "Cour d'appel de Lyon"
    export = {"results": [{"id": "x", "themes": ["t1", "t2"], "jurisdiction": "cc"}, {"id": ""}]}
    e, = records.read_court_export(spark, put(tmp_path / "e", "e.json", json.dumps(export))).collect()
    assert (e.titre, e.juridiction) == ("t1", "Cour de cassation")
    listing = {"results": [{"columns": {"itemid": "001-1", "kpdate": "2020-01-02T00:00:00"}}]}
    assert records.read_echr_listing(spark, put(tmp_path / "l", "l.json", json.dumps(listing))).first().date == "2020-01-02"
    cj = {"results": {"bindings": [{"celex": {"value": "62021CJ0395"}, "type": {"value": "http://x/y/JUDG"}}]}}
    c = records.read_cjeu_bindings(spark, put(tmp_path / "b", "b.json", json.dumps(cj))).first()
    assert (c.ecli, c.type) == ("ECLI:EU:C:2021:395", "JUDG")
    tsv = records.read_patch_tsv(spark, put(tmp_path / "p", "p.tsv", 'J1\ta\\nb ⏎ c\\\\n "q\n'), "id string, text string").first()
    assert tsv.text == 'a\nb\nc\\n "q'


def test_toc(spark):
    toc = {"articles": [{"id": "A0", "num": "1"}], "sections": [{"title": "L1", "articles": [{"id": "A1", "num": "2"}],
                                                                "sections": [{"title": "C1", "articles": [{"id": "A2", "num": "3"}]}]}]}
    df = spark.createDataFrame([("T", json.dumps(toc))], "cid string, toc string")
    assert {r.id: r.path for r in records.flatten_toc(df).collect()} == {"A0": [], "A1": ["L1"], "A2": ["L1", "C1"]}
    deep = {"articles": [{"id": "D"}]}
    for i in range(15):
        deep = {"title": str(i), "sections": [deep]}
    assert [len(r.path) for r in records.flatten_toc(spark.createDataFrame([("T", json.dumps(deep))], "cid string, toc string")).collect()] == [15]


def test_html(spark):
    card = ('<div class="views-row"><h2 class="title"> <span>Mairie &amp; Co</span></h2><div class="field-name-pr-nom-prada"><div class="field-item even">M. X</div>'
            '<div class="field-name-field-adresse-complete"><div><p>1 rue<br/>Paris</p></div><a href="mailto:a@x">a</a><a href="mailto:a@x">a</a><a href="mailto:">-</a></article>')
    df = spark.createDataFrame([(1, f"<html><title>T &eacute;</title>{card}{card}</html>")], "id int, html string")
    rows = html.parse_contact_pages(df, "html", "id").collect()
    assert [(r.card_no, r.organisme, r.prada, r.adresse, r.courriels) for r in rows] == [(i, "Mairie & Co", "M. X", "1 rue | Paris", ["a@x"]) for i in (0, 1)]
    page = html.html_to_text(df).first()
    assert page.title == "T é" and page.text.startswith("Mairie & Co M. X 1 rue Paris")


SKOS = """<rdf:RDF xmlns:rdf="r" xmlns:skos="s">
<skos:Concept rdf:about="http://x/1"><skos:prefLabel xml:lang="fr">droit</skos:prefLabel><skos:prefLabel xml:lang="en">law</skos:prefLabel>
<skos:altLabel xml:lang="fr">loi</skos:altLabel><skos:narrower rdf:resource="http://x/2"/></skos:Concept>
<rdf:Description rdf:about="http://x/2"><rdf:type rdf:resource="http://w#Concept"/><skos:prefLabel xml:lang="fr">pénal</skos:prefLabel>
<skos:broader rdf:resource="http://x/1"/></rdf:Description>
<rdf:Description rdf:about="http://x/3"><rdf:type rdf:resource="http://w#Other"/><skos:prefLabel xml:lang="fr">non</skos:prefLabel></rdf:Description></rdf:RDF>"""


def test_thesaurus_sources(spark, tmp_path):
    concepts, labels, relations = thesauri.read_skos(spark, put(tmp_path, "s.rdf", SKOS), "eurovoc", "all")
    assert sorted((r.code, r.label, r.parent_code) for r in concepts.collect()) == [("1", "droit", None), ("2", "pénal", "1")]
    assert sorted((r.code, r.label_normalized, r.label_type) for r in labels.collect()) == [("1", "DROIT", "pref"), ("1", "LOI", "alt"), ("2", "PENAL", "pref")]
    assert sorted((r.src_code, r.dst_code, r.rel_type) for r in relations.collect()) == [("1", "2", "narrower"), ("2", "1", "broader")]
    flat = thesauri.themes_flat(spark.createDataFrame([("['a','b c']",)], "value string"), "judilibre_cass")
    assert [(r.code, r.label) for r in flat.collect()] == [("jc0001", "a"), ("jc0002", "b c")]
    tree, edges = thesauri.themes_tree(spark.createDataFrame([(json.dumps({"10": {"label": "A", "subs": {"10.1": "B"}}}),)], "value string"), "t")
    assert sorted((r.code, r.depth, r.parent_code) for r in tree.collect()) == [("10", 1, None), ("10.1", 2, "10")] and edges.count() == 1


def test_what_is_said_of_a_concept_meets(spark, tmp_path):
    split = """<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="http://x/1"><skos:altLabel xml:lang="fr">b</skos:altLabel></skos:Concept>
<rdf:Description rdf:about="http://x/1"><skos:prefLabel xml:lang="fr">a</skos:prefLabel><skos:related rdf:resource="http://x/2"/></rdf:Description>
<rdf:Description rdf:about="http://x/2"><skos:prefLabel xml:lang="fr">c</skos:prefLabel></rdf:Description></rdf:RDF>"""
    concepts, labels, relations = thesauri.read_skos(spark, put(tmp_path, "s.rdf", split), "e", "all")
    assert [(r.code, r.label) for r in concepts.collect()] == [("1", "a")]
    assert sorted((r.label, r.label_type) for r in labels.collect()) == [("a", "pref"), ("b", "alt")]
    assert [(r.dst_code, r.rel_type) for r in relations.collect()] == [("2", "related")]


def test_files_follow_the_data(spark, tmp_path):
    """One year with nearly all rows is cut by the advisory size; small years share a task."""
    advisory = 64 << 10
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        rows = spark.range(0, 60_000, 1, 200).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.when(F.col("id") % 100 > 0, "2020-05-01").otherwise(
            F.concat((2000 + F.col("id") / 100 % 19).cast("int").cast("string"), F.lit("-01-01"))).alias("date"))
        sinks.write_table(rows, str(tmp_path / "t"))
        files = {year: list((tmp_path / "t" / f"year={year}").glob("*.parquet")) for year in (2003, 2020)}
        shuffled = 60_000 * 100
        assert shuffled / advisory / 3 < len(files[2020]) < 2 * shuffled / advisory and len(files[2003]) == 1
        words = rows.select(F.lit("d").alias("collection"), F.when(F.col("date") == "2020-05-01", "le").otherwise(F.col("v")).alias("term"), F.col("v").alias("doc_id"), F.lit(1).alias("tf"))
        index.write_postings(words, "postings_of_one_word", 4)
        stored = index.read_postings(spark, "postings_of_one_word")
        hot = stored.where("term = 'le'").select(F.input_file_name().alias("f")).distinct().count()
        assert hot > 20 and stored.count() == 60_000 and len(stored.inputFiles()) <= 4 * (hot + 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], "2020-05-01"), ("a", [], "bad")], "id string, l array<string>, date string")
    sinks.write_csv_sorted(df, str(tmp_path / "c"), "id")
    back = spark.read.csv(str(tmp_path / "c"), sep=";", header=True)
    assert {r.id: r.l for r in back.collect()}["b"] == "x ; y"
    sinks.write_table(df, str(tmp_path / "t"))
    assert sorted(r.year for r in spark.read.parquet(str(tmp_path / "t")).select("year").distinct().collect()) == [0, 2020]
    sinks.write_json(df, str(tmp_path / "j"), df.agg(F.count("*").alias("n")))
    assert spark.read.json(str(tmp_path / "j" / "meta")).first().n == 2
    fresh = sinks.freshness(spark, {"t": str(tmp_path / "t")}).first()
    assert fresh.collection == "t" and fresh.last_update > datetime.datetime(2020, 1, 1)
