import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.functions import citations, dates, identifiers, queries, references, summaries, text

D = datetime.date


def test_fold(ev):
    assert ev(["Élève Çà", "éTÉ", "naïve Œuvre ß"], text.fold) == ["eleve ca", "ete", "naive œuvre ß"]
    assert ev([" Œuvre d’État "], text.fold_upper) == ["OEUVRE D'ETAT"]


def test_strip_markup(ev):
    html = "<p>A &amp; B&nbsp;<br/>C</p><script>var x='</p>';</script><style>p{}</style> &copy; &amp;lt; &#233;"
    assert ev([html, None], text.strip_markup) == ["A & B C © &lt; é", ""]
    assert ev(["<p>Un</p><p>deux<br>trois</p>\n\n\n\nx"], text.strip_markup_keep_paras) == ["Un\n\ndeux\ntrois\n\nx"]


def test_paragraphs(ev):
    body = "Vu la requête. Considérant que A ; Considérant ce qui suit. PAR CES MOTIFS, rejette"
    assert ev([body], text.split_paragraphs) == [
        "Vu la requête.\n\nConsidérant que A ;\n\nConsidérant ce qui suit.\n\nPAR CES MOTIFS, rejette"]
    long_text = body + " " + "mot " * 150
    assert ev([long_text], text.clean_residual_markup)[0].count("\n\n") == 3
    assert "\n" not in ev([body], text.clean_residual_markup)[0]


def test_small_text_helpers(ev):
    assert ev(["R. 772-8", " L 1 ", None], text.norm_article) == ["R772-8", "L1", ""]
    assert ev(["  Jean   DUPONT "], text.norm_name) == ["jean dupont"]
    assert ev([" .A.B@C.fr;"], text.norm_email) == ["a.b@c.fr"]
    assert ev(["un deux trois", "court"], lambda c: text.preview(c, 8)) == ["un deux…", "court"]
    assert ev(["a b\u0085c"], text.fix_line_separators) == ["a\nb\nc"]
    assert ev(["{3,5}un <em>mot</em>"], text.clean_highlights) == ["un mot"]


def test_decode_payload(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in df.select(text.decode_payload("b")).collect()] == ["é", "é"]


def test_dates(ev):
    assert ev(["Lecture du lundi 27 fév. 2024", "le 1er août 2019", "31 février 2020", "rien"],
              dates.parse_fr_date) == [D(2024, 2, 27), D(2019, 8, 1), None, None]
    assert ev(["2023-02-14", "2023-02", "x", None], dates.format_fr_date) == [
        "14 février 2023", "février 2023", "x", ""]
    assert ev(["2023-02-14T10:00", "0201-02-03", "", None], dates.clean_iso_date) == [D(2023, 2, 14), None, None, None]
    assert ev(["vu mars 2024"], dates.parse_month_year) == [D(2024, 3, 1)]


def test_dockets(ev):
    cases = {"11DA00333": "11DA00333", "1904411": "1904411", "n° 17BX02468": "17BX02468", "\t388902 ": "388902",
             "séance du 3 mai": None, " ": None, "JORFTEXT000031": None}
    assert ev(list(cases), identifiers.admin_docket) == list(cases.values())
    assert ev(["18/00777", "18-00777", "1800777", "sans"], identifiers.norm_rg) == ["18/00777", "18/00777", "18/00777", "sans"]
    assert ev(["18/00777"], identifiers.rg_key) == ["18/00777 18-00777 1800777"]
    assert ev(["N° RG : 18/00777 ; suite", "R.G n° 16-4321", "néant"], identifiers.extract_rg) == ["18/00777", "16/4321", None]
    assert ev(["20-18555", "20-18.555"], identifiers.appeal_variants) == [["20-18555", "20-18.555"]] * 2


def test_european_numbers(ev):
    assert ev(["62021CJ0395", "62012TJ0005", "x"], identifiers.celex_to_case) == ["C-395/21", "T-5/12", None]
    assert ev(["C-395/21", "T-5/98"], identifiers.case_to_celex) == ["62021CJ0395", "61998TJ0005"]
    assert ev(["62021CJ0395", "62021XX0395"], identifiers.celex_to_ecli) == ["ECLI:EU:C:2021:395", None]
    assert ev(["C-395/21"], identifiers.case_key) == ["C-395/21 C-395-21 C39521 C 395 21"]
    assert ev(["(Requête no 4143/02)", "Application no. 1/2", "APPNO: 12/34"], identifiers.extract_appno) == [
        "4143/02", None, "12/34"]
    assert ev(["ECLI:CE:ECHR:2011:0101JUD000414302"], identifiers.appno_from_ecli) == ["4143/02"]


def test_source_url(spark):
    """Every form of the table with an address of its own; dates, gazette texts and what has none."""
    samples = {"CONSTEXT7": "juri/id", "JURITEXT7": "juri/id", "0123456789abcdef01234567": "courdecassation.fr/decision", "DTA_7_20200101": "recherche/decision", "CETATEXT7": "ceta/id",
               "002-77": "fre?i=", "61999CJ0007": "uri=CELEX:", "ecli:eu:T:1999:7": "uri=ecli:", "ECLI:CE:ECHR:1999:7": "fre?i=", "ECLI:DE:BGH:1999:7": "uri=ecli:"}
    rows = [(i, "", "1999-12-31", f"{part}/{i}" if part[-1] not in ":=" else part + i) for i, part in samples.items()]
    rows += [("LEGIARTI7", "LEGITEXT1", "1999-12-31", "/codes/article_lc/LEGIARTI7/1999-12-31"), ("LEGIARTI7", "JORFTEXT1", None, "/loda/article_lc/LEGIARTI7"),
             ("LEGITEXT7", None, "31/12/1999", "/codes/texte_lc/LEGITEXT7"), (" JORFTEXT7 ", None, "1999-12-31", "/loda/id/JORFTEXT7/1999-12-31"),
             ("/Ariane_Web/AW_X/|7", None, "1999-12-31", "view-document//Ariane_Web/AW_X/%7C7")]
    df = spark.createDataFrame([r[:3] for r in rows], "i string, p string, d string")
    got = [r[0] for r in df.select(identifiers.source_url("i", F.col("p"), F.col("d"))).collect()]
    assert all(url.startswith("https://") and url.endswith(r[3]) for url, r in zip(got, rows)), list(zip(got, rows))
    none = ["", " ", "ecli:fr:X:1999:7", "ORTA_7", "JURI7", "|7", "LEGI7", "7", "0123456789ABCDEF01234567"]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in none], "i string").select(identifiers.source_url("i")).collect()] == [None] * len(none)


def test_families(ev):
    assert ev(["JURITEXT1", "CONSTEXT1", "DTA_1_2", "CETATEXT1", "|461534", "001-2", "62012CJ0131", "LEGIARTI1",
               "JORFTEXT1", "?"], identifiers.id_family) == [
        "judicial", "constitutional", "admin_open_data", "admin_bulk", "council_of_state", "human_rights",
        "eu_court", "statute_article", "statute_text", None]


SNIPPETS = [
    ("selon l'article 2224 du code civil, repris plus loin", [("CC", "2224")]),
    ("au visa de l'article L. 3245-1 du code du travail", [("CT", "L3245-1")]),
    ("les articles 311-1, 311-4 et 314-1 du code pénal", [("CP", "311-1"), ("CP", "311-4"), ("CP", "314-1")]),
    ("art. R. 611-7 du CJA", [("CJA", "R611-7")]),
    ("article 34 de la Constitution ; article 5 CEDH", [("CONST", "34"), ("CEDH", "5")]),
    ("l'article L.111-2 ; L.111-5 du CASF", [("CASF", "L111-2"), ("CASF", "L111-5")]),
    ("l'article premier de la Constitution", [("CONST", "1")]),
    ("D. 113-3 du code de la santé publique", [("CSP", "D113-3")]),
    ("articles 16, alinéa 3, et 15 al. 1 du code de procédure civile", [("CPC", "16"), ("CPC", "15")]),
    ("art. 455 c. pr. civ. puis art. 1103 c. civ., fin", [("CPC", "455"), ("CC", "1103")]),
    ("article 13 § 2 de la Convention européenne des droits de l'homme", [("CEDH", "13§2")]),
    ("L. 1, L. 2 du code du travail", [("CT", "L2")]),
    ("les articles 7 et suivants du code civil", []),
    ("article 9 et 10, code civil", []),
    ("en 2019 la chambre a statué", []),
    ("page 314 du recueil du code civil", []),
]


def test_citations_are_placed(spark):
    """Every combination of a generated list is found where it was put."""
    texts = []
    for i, numbers in enumerate((["12"], ["L. 12-3", "R. 4"], ["1", "2", "3-4"])):
        for name, code in (("code civil", "CC"), ("code de commerce", "C.com"), ("CPP", "CPP")):
            texts.append((len(texts), f"É{'x' * i} vu les articles {', '.join(numbers)} du {name}.", code, numbers))
    df = spark.createDataFrame([t[:2] for t in texts], "i int, t string")
    rows = citations.explode_citations(df, "i", "t", citations.ALL_NAMES).collect()
    for i, text, code, numbers in texts:
        mine = sorted((r for r in rows if r.i == i), key=lambda r: r.start)
        assert [(r.code, text[r.start:r.end]) for r in mine] == [(code, n) for n in numbers]


def test_citations_with_offsets(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SNIPPETS)], "i int, t string")
    rows = citations.explode_citations(df, "i", "t").collect()
    for i, (snippet, expected) in enumerate(SNIPPETS):
        mine = sorted((r for r in rows if r.i == i), key=lambda r: r.start)
        assert [(r.code, r.num) for r in mine] == expected, snippet
        assert all(a.end <= b.start for a, b in zip(mine, mine[1:]))
        assert all(any(ch.isdigit() for ch in snippet[r.start:r.end]) or snippet[r.start:r.end] == "premier"
                   for r in mine)


def test_citations_native_agrees(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SNIPPETS)], "i int, t string")
    rows = citations.cited_articles(df, "i", "t").collect()
    for i, (snippet, expected) in enumerate(SNIPPETS):
        assert sorted((r.code, r.num) for r in rows if r.i == i) == sorted(expected), snippet


def test_norm_mentions(spark):
    cases = [("règlement (CE) n° 883/2004", "REG-EU"), ("règlement (UE) 2016/679", "REG-EU"),
             ("directive 2000/78/CE", "DIR-EU"), ("directive (UE) 2016/679", "DIR-EU"),
             ("loi n° 2005-102 du 11 février 2005", "LOI"), ("décret n° 2021-1480", "DECRET"),
             ("ordonnance n° 2020-1304", "ORD")]
    df = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, t string")
    got = {r.i: r.kind for r in citations.explode_norm_mentions(df, "i", "t").collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_annotate(spark):
    df = spark.createDataFrame([("<b> l'article 9 du code civil & art. 1 CC",)], "t string")
    out = citations.annotate_citations(citations.with_citation_spans(df, "t"), "t", "spans").first().annotated
    assert out.startswith("&lt;b&gt; l&#x27;article <a href=\"/loi/CC/9\"") and out.count("<a ") == 2
    assert "&amp; art. <a" in out


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    out = references.parse_references(df, "q").withColumn("is_ref", references.is_reference()).orderBy("i").collect()
    return [(r, [(n.kind, n.value) for n in r.numeros]) for r in out]


def test_reference_parser(spark):
    cases = [
        ("RG 19/01234 le tribunal judiciaire de Mont-Louis", "tj", "Mont-Louis", None, [("rg", "19/01234")]),
        ("3 mars 2021 valence tj", "tj", "valence", D(2021, 3, 3), []),
        ("tcom annecy 30 avril 2019", "tcom", "annecy", D(2019, 4, 30), []),
        ("20-04567 tj mont-louis", "tj", "mont-louis", None, [("rg", "20-04567")]),
        ("cass 18-21.009", "cass", "", None, [("pourvoi", "18-21.009")]),
        ("C4007", "", "", None, [("tdc", "C4007")]),
        ("CJUE, T-77/09", "cjue", "", None, [("cjue", "T-77/09")]),
        ("le tribunal judiciaire de ladite commune, 5 mai 2022", "tj", "", D(2022, 5, 5), []),
        ("CAA Nantes, 4e ch., 6 déc. 2022, n° 21NT00017", "caa", "Nantes", D(2022, 12, 6), [("caa_ce", "21NT00017")]),
        ("Cour d'appel de Riom, 8 sept. 2020", "ca", "Riom", D(2020, 9, 8), []),
        ("2 octobre 2018, n° 412345", "", "", D(2018, 10, 2), [("dossier", "412345")]),
        ("TA Dijon, Martin c/ Ville, 2019-06-07", "ta", "Dijon", D(2019, 6, 7), []),
    ]
    for (row, numbers), (q, court, city, date, expected) in zip(parse(spark, *[c[0] for c in cases]), cases):
        assert (row.juri_type, row.juri_ville, row.ref_date, numbers) == (court, city, date, expected), q
    flags = [r.is_ref for r, _ in parse(spark, "tj", "cass 18-21.009", "ta dijon", "C4007")]
    assert flags == [False, True, False, True]
    assert parse(spark, cases[-1][0])[0][0].ref_text == "Martin c/ Ville"
    assert parse(spark, "CAA Nantes, 4e ch., notaire et nantissement, réf. n° 21NT00017")[0][0].ref_text.split() == ["notaire", "et", "nantissement"]


def test_intents(spark):
    cases = [("250123", "ariane_id"), ("17-11222", "pourvoi"), ("17-11.222", "pourvoi"), ("2001234", "dossier_admin"),
             ("15LY02020", "dossier_admin"), ("18/04321", "rg"), ("62019CJ0100", "celex"),
             ("ECLI:EU:C:2019:77", "ecli"), ("DTA_1901234_20200102", "dce_id"), ("002-12345", "itemid_hudoc"),
             ("JURITEXT000000000007", "juritext"), ("CONSTEXT000000000008", "juritext"),
             ('"droit au logement"', "phrase"), ("bail commercial", "fts"), ("", "empty")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string")
    got = queries.route(queries.classify_queries(df, "q"), list(queries.dims.SOURCE_CAPABILITIES)).orderBy("i").collect()
    assert [r.intent for r in got] == [c[1] for c in cases]
    assert got[0].sources == ["ariane", "admin"] and got[5].sources == ["dila"]
    assert set(got[13].sources) == {"ariane", "admin", "dila", "cedh", "cjue"} == set(got[14].sources)


def test_query_normalisation(ev):
    cases = {
        "bail ET loyer": "bail AND loyer", "bail&loyer": "bail AND loyer", "bail | vente": "bail OR vente", "bail ou vente": "bail OR vente",
        "vente SAUF immeuble": "vente NOT immeuble", "vente -immeuble": "vente NOT immeuble", "17-11222": '"17 11222"',
        "ECLI:EU:C:2019:77": '"ECLI EU C 2019 77"', '"droit ET devoir"': '"droit ET devoir"', "17- 11.222": '"17 11 222"', "loca*": "loca*",
        "(bail OR vente) and x": "(bail OR vente) and x",
    }
    assert ev(list(cases), queries.normalize_query) == list(cases.values())
    tj, cc = ev(["TJ Lyon", "CC 2020"], queries.normalize_query)
    assert '"Tribunal judiciaire"' in tj and "TGI" in tj and tj.endswith(" Lyon") and cc == "CC 2020"


def test_clauses(spark):
    df = spark.createDataFrame([(1, 'a "b c" (d OR e*) -f'), (2, "NOT (x OR y) z"), (3, "((**"), (4, 'g AND "h')],
                               "id int, q string")
    rows = queries.queries_to_clauses(df, "id", "q").orderBy("query_id", "atom_id").collect()
    got = [(r.query_id, r.clause_id, r.op, r.terms, r.is_phrase, r.is_prefix) for r in rows]
    assert got == [
        (1, 1, "must", ["a"], False, False), (1, 2, "must", ["b", "c"], True, False),
        (1, 3, "must", ["d"], False, False), (1, 3, "must", ["e"], False, True), (1, 4, "not", ["f"], False, False),
        (2, 1, "not", ["x"], False, False), (2, 1, "not", ["y"], False, False), (2, 2, "must", ["z"], False, False),
        (4, 1, "must", ["g"], False, False), (4, 2, "must", ["h"], False, False)]


def test_constitutional_ref(ev):
    got = ev(["2008-562 DC", '"2008 562" qpc', "2008-562"], queries.split_constitutional_ref)
    assert [tuple(g) if g else None for g in got] == [("2008-562", "DC"), ("2008-562", "QPC"), None]


def test_summary_sections(spark):
    s = ("39-02-005 MARCHÉS. - FORMATION. [art. R.111]. 68-03-02-08 L'article dit. 1. Cf. CE, 1990.")
    row = summaries.split_summary(spark.createDataFrame([(s,)], "s string"), "s").first()
    assert (row.abstrats, row.resume, row.renvois) == (
        "39-02-005 MARCHÉS. - FORMATION. [art. R.111]", "68-03-02-08 L'article dit.", "1. Cf. CE, 1990.")


def test_classification(spark):
    df = spark.createDataFrame([
        (1, "39-02-005 MARCHES ET CONTRATS. - FORMATION DES CONTRATS. - ADJUDICATION - DETAIL le contrat"),
        (2, "54 PROCEDURE 54-07 POUVOIRS. - DEVOIRS z54-07z encore z54z"), (3, "rien du tout")], "id int, s string")
    rows = [(r.id, r.leaf_code, r.code, r.label, r.depth)
            for r in summaries.explode_classification(df, "id", "s").collect()]
    assert (1, "39-02-005", "39-02", "FORMATION DES CONTRATS", 2) in rows
    assert (1, "39-02-005", "39-02-005", "ADJUDICATION", 3) in rows
    assert (2, "54-07", "54", "POUVOIRS", 1) in rows and (2, "54-07", "54-07", "DEVOIRS", 2) in rows
    assert any(r[:3] == (2, "54", "54") for r in rows) and not any(r[0] == 3 for r in rows)
