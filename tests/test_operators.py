import datetime
import random

from pyspark.sql import functions as F

from lexloom.operators import aggregates, asof, filters, joins, merge, windows
from lexloom.plans import citing

D = datetime.date
VERSION = ("legiarti string, legitext string, num string, titre_text string, etat string, date_debut string, "
           "date_fin string, texte string, nota string")


def versions_df(spark):
    cc, cp = "LEGITEXT000006070721", "LEGITEXT000006070719"
    rows = [
        ("LEGIARTI1", cc, "1128", "t", "MODIFIE", "1804-02-17", "2016-10-01", "ancien", ""),
        ("A2", cc, "1128", "t", "VIGUEUR", "2016-10-01", "2999-01-01", "nouveau", ""),
        ("B1", cp, "R610-1", "t", "VIGUEUR", "2000-01-01", "", "x", ""),
        ("C1", cc, "9", "t", "ABROGE", "1950-01-01", "1960-01-01", "x", ""),
        ("D1", cc, "10", "t", "MODIFIE", "1900-01-01", "1990-01-01", "long", ""),
        ("D2", cc, "10", "t", "MODIFIE", "1950-01-01", "1955-01-01", "nested", ""),
        ("E1", cc, "11", "t", "MODIFIE", "", "1980-01-01", "open start", ""),
    ]
    return spark.createDataFrame(rows, VERSION)


def test_law_batch(spark):
    refs = spark.createDataFrame([
        (1, "CC", "1128", D(1992, 5, 15)), (2, "CC", "1128", D(2016, 10, 1)), (3, "CC", "1128", None),
        (4, "CP", "R. 610-1", D(2020, 1, 1)), (5, "CP", "R. 610-1", D(1990, 1, 1)), (6, "CC", "9", D(2000, 1, 1)),
        (7, "CC", "10", D(1952, 1, 1)), (8, "CC", "10", D(1970, 1, 1)), (9, "CC", "11", D(1810, 1, 1)),
        (10, "ZZ", "1", None), (11, "CC", " ", None), (12, "CC", "999", None),
        (13, "LEGITEXT000006070721", "1128", D(1900, 1, 1))], "ref_id int, code string, num string, date date")
    out = {r.ref_id: r for r in asof.law_batch(refs, versions_df(spark), payload=["texte"]).collect()}
    assert len(out) == 13
    got = {i: (r.legiarti, r.tier) for i, r in out.items()}
    assert got == {1: ("LEGIARTI1", 1), 2: ("A2", 1), 3: ("A2", 1), 4: ("B1", 1), 5: ("B1", 2), 6: ("C1", 3), 7: ("D2", 1),
                   8: ("D1", 1), 9: ("E1", 1), 10: (None, None), 11: (None, None), 12: (None, None), 13: ("LEGIARTI1", 1)}
    assert out[1].texte == "ancien" and out[1].note is None and out[1].source_url.endswith("/LEGIARTI1/1992-05-15")
    assert out[5].note.startswith("Aucune version en vigueur à 1990-01-01")
    assert [out[i].error for i in (10, 11, 12)] == ["unknown code", "code and num are required", "no version of this article"]
    assert not out[12].found and out[13].found


def test_version_at_against_brute_force(spark):
    rng = random.Random(7)
    day = lambda: D(1990, 1, 1) + datetime.timedelta(days=rng.randrange(400))
    rows = []
    for i in range(160):
        a, b = sorted((day(), day()))
        rows.append((f"V{i:03d}", f"T{rng.randrange(3)}", str(rng.randrange(4)), rng.choice(["VIGUEUR", "MODIFIE"]),
                     rng.choice([a, a, a, None]), rng.choice([b, b, b, None])))
    versions = spark.createDataFrame(rows, "legiarti string, legitext string, num string, etat string, date_debut date, date_fin date")
    points = [(f"T{t}", str(n), day()) for t in range(4) for n in range(4) for _ in range(25)]
    got = {(r.legitext, r.num, r.at): (r.legiarti, r.tier) for r in asof.version_at(
        spark.createDataFrame(points, "legitext string, num string, at date"), versions).collect()}
    far = D(9999, 12, 31)
    recency = lambda v: (-(v[4] or D.min).toordinal() if v[4] else 1, (far - (v[5] or far)).days, v[0])
    for t, n, d in set(points):
        mine = [v for v in rows if v[1] == t and v[2] == n]
        tier1 = [v for v in mine if (v[4] or D.min) <= d <= (v[5] or far)]
        tier2 = [v for v in mine if v[3] == "VIGUEUR"]
        best, tier = next(((min(c, key=recency), i) for i, c in ((1, tier1), (2, tier2), (3, mine)) if c), (None, None))
        assert got.get((t, n, d)) == ((best[0], tier) if best else None), (t, n, d)


def test_law_versions_and_numbers(spark):
    refs = spark.createDataFrame([(1, "CC", "1128")], "ref_id int, code string, num string")
    got = asof.law_versions(refs, versions_df(spark)).orderBy("version_no").collect()
    assert [(r.legiarti, r.version_no) for r in got] == [("LEGIARTI1", 1), ("A2", 2)]
    v = spark.createDataFrame([
        ("a", "T1", "1", "Loi n° 68-1250 du", "", "1968-12-31", "", "", ""), ("b", "T1", "2", "Loi n°68-1250", "", "1969-01-01", "", "", ""),
        ("c", "T2", "1", "Décret n° 68-1250", "", "1970-01-01", "", "", ""), ("d", "T3", "1", "", "", "1979-01-01", "", "la loi n° 79-587 dit", ""),
        ("e", "T3", "2", "", "", "", "", "loi n° 79-587", "")], VERSION)
    asked = spark.createDataFrame([("68-1250",), ("79-587",), ("1-1",), ("bad",)], "numero string")
    got = {r.numero: (r.legitext, r.nb, r.articles_count, r.date_debut) for r in asof.resolve_law_number(asked, v).collect()}
    assert got == {"68-1250": ("T1", 2, 2, "1968-12-31"), "79-587": ("T3", 1, 2, "1979-01-01")}


def decisions_df(spark):
    return spark.createDataFrame([
        ("D1", "22-83263 24-80053", "Cour de cassation", D(2023, 1, 1), "t1", "x" * 300),
        ("D2", "22-83263", "Cour de cassation", D(2024, 1, 1), "t2", "court"),
        ("D3", "407974", "Conseil d'État", D(2017, 1, 1), "t3", None), ("D4", "407974", "CAA de PARIS", D(2018, 1, 1), "t4", "a\nb" * 200),
        ("D5", "21/05835", "Cour d'appel de Bordeaux", None, "t5", ""), ("D6", "2105835", "Cour d'appel de Lyon", D(2022, 1, 1), "t6", "y" * 300),
    ], "id string, numero string, juridiction string, date date, titre string, text string")


def test_lookups(spark):
    d = decisions_df(spark)
    values = spark.createDataFrame([("22-83263",), ("407974",), ("",)], "value string")
    got = [(r.value, r.id, r.rank) for r in filters.by_field(d, "numero", values).orderBy("value", "rank").collect()]
    assert got == [("22-83263", "D2", 1), ("22-83263", "D1", 2), ("407974", "D3", 1), ("407974", "D4", 2)]
    refs = spark.createDataFrame([(1, "407974", "Conseil d'Etat"), (2, "407974", "Cour administrative d'appel de Paris"),
                                  (3, "407974", None), (4, "", None)], "ref_id int, numero string, juridiction string")
    got = [(r.ref_id, r.id) for r in filters.by_docket(d, refs).orderBy("ref_id", "rank").collect()]
    assert got == [(1, "D3"), (2, "D4"), (3, "D3"), (3, "D4")]
    refs = spark.createDataFrame([(1, "21-05835"), (2, "407974"), (3, "nope")], "ref_id int, numero string")
    got = [(r.ref_id, r.id) for r in filters.by_rg(d, refs).orderBy("ref_id", "rank").collect()]
    assert got == [(1, "D6"), (1, "D5"), (2, "D4"), (2, "D3")]


def test_shared_roll_numbers_are_limited_before_references_meet_them(spark):
    rows = [(i, "12/34567" if i % 2 else "N 12", D(2000 + i % 7, 1, 1) if i % 5 else None) for i in range(40)] + [(99, None, None), (98, "", None)]
    d = spark.createDataFrame(rows, "id int, numero string, date date")
    refs = spark.createDataFrame([(1, "1234567"), (2, "12-34567"), (3, "N 12"), (4, ""), (5, None), (1, "1234567")], "ref_id int, numero string")
    found = filters.by_rg(d, refs, k=3)
    newest = lambda odd: [i for _, _, i in sorted(((r[2] is None, -(r[2] or D(1, 1, 1)).toordinal(), r[0]) for r in rows[:40] if r[0] % 2 == odd))]
    got = {n: [r.id for r in sorted(found.where(F.col("ref_id") == n).collect(), key=lambda r: r.rank)] for n in range(1, 6)}
    a, b = newest(1), newest(0)
    assert got == {1: [a[0], a[0], a[1]], 2: a[:3], 3: b[:3], 4: [], 5: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window [row_number") > plan.index("Join")  # numbers are cut below the join, not only pairs above it


def test_date_policies(spark):
    d = decisions_df(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(filters.date_range(d, "date", "2022-01-01", "2023-01-01")) == ["D1", "D5", "D6"]
    assert ids(filters.date_range(d, "date", "2022-01-01", "2023-01-01", blanks="drop")) == ["D1", "D6"]
    assert [r.id for r in filters.date_slice(d, "date", "id", "2017-01-01", None, ["appel", "caa"]).collect()] == ["D6", "D4"]


def test_results_and_headers(spark):
    raw = spark.createDataFrame([("a", "Conseil d'État", "Req. N° 466958, Lecture du 13 novembre 2023 ; suite"),
                                 ("b", "CE, 2020", "ECLI:FR:CECHR:2019:1.2019")], "id string, title string, extracts string")
    a, b = filters.to_result(raw, "ariane").orderBy("id").collect()
    assert (a.numero, a.date, a.title) == ("466958", D(2023, 11, 13), "Req. N° 466958, Lecture du 13 novembre 2023")
    assert b.date == D(2019, 1, 1) and b.juridiction == "Conseil d'État"
    dila = spark.createDataFrame([("x", None, "cc", "2020-01-01", "1")], "id string, titre string, juridiction string, date string, numero string")
    r = filters.to_result(dila, "dila").first()
    assert (r.title, r.juridiction, r.source_label) == ("Cour de cassation — n° 1", "Cour de cassation", "JUDICIAIRE")
    codes = spark.createDataFrame([("Tribunal administratif de Nîmes",), ("TA inconnu",)], "n string")
    assert [r.court_code for r in filters.court_code(codes, "n").collect()] == ["TA30", None]


def test_patches(spark):
    d = decisions_df(spark).select("id", "titre", "text")
    patch = spark.createDataFrame([("D2", "neuf", 1), ("D4", "neuf", 2), ("Z", "neuf", 3)], "id string, text string, other int")
    known, unknown = joins.split_known(patch, d)
    assert known.count() == 2 and unknown.first().id == "Z"
    out = {r.id: r.text for r in joins.patch_text(d, patch).collect()}
    assert out["D2"] == "neuf" and out["D4"].startswith("a\nb") and out["D1"] == "x" * 300
    cols = joins.patch_columns(d, spark.createDataFrame([("D1", None, "q")], "id string, titre string, zzz string"))
    assert cols.columns == d.columns and cols.where("id='D1'").first().titre is None
    listing = spark.createDataFrame([("D1",), ("D2",), ("N",)], "id string")
    assert sorted(r.id for r in joins.gaps(listing, d, "id").collect()) == ["D2", "N"]
    meta = spark.createDataFrame([("D1", "s"), (None, "n")], "decision_id string, summary string")
    assert joins.not_enriched(d, meta).count() == 5
    assert joins.with_meta(d, meta).where("summary = 's'").first().id == "D1"


def test_locations(spark):
    dim = spark.createDataFrame([("tj02691", "Tribunal judiciaire de Saint-Quentin")], "location string, name string")
    df = spark.createDataFrame([("tj02691", "tj"), ("ca_aix_provence", "ca"), ("tj75056", "tj"), (None, "cc"), ("9301", "zz")],
                               "location string, jurisdiction string")
    got = {r.location: r.juridiction for r in joins.location_name(df, dim).collect()}
    assert got == {"tj02691": "Tribunal judiciaire de Saint-Quentin", "ca_aix_provence": "Cour d'appel de Aix Provence",
                   "tj75056": "Tribunal judiciaire de 75056", None: "Cour de cassation", "9301": "zz de 9301"}
    old = spark.createDataFrame([("TJ de 02691", "TJ de 02691, 2020"), ("CA", "CA, 1")], "juridiction string, titre string")
    ren = spark.createDataFrame([("TJ de 02691", "TJ de Saint-Quentin")], "old_name string, new_name string")
    new = joins.rename_locations(old, ren)
    assert new.where("titre = 'TJ de Saint-Quentin, 2020'").count() == 1 and joins.rename_residuals(new).count() == 0
    assert joins.rename_residuals(old).first().n == 1


def test_probes_and_ids(spark):
    d = spark.createDataFrame([("DTA_2200433_20230301", "2200433", "TA"), ("T1", "C3830", "x"), ("T2", "00012", "Tribunal des conflits"),
                               ("T3", "00012", "autre")], "id string, numero string, juridiction string")
    refs = spark.createDataFrame([(1, "ta", "2200433", D(2023, 3, 1)), (2, "caa", "2200433", D(2023, 3, 1)), (3, "", "2200433", D(2023, 3, 1))],
                                 "ref_id int, juri_type string, value string, ref_date date")
    assert sorted(r.ref_id for r in joins.probe_ids(refs, d).collect()) == [1, 3]
    refs = spark.createDataFrame([(1, "c3830"), (2, "C12"), (3, "C9999")], "ref_id int, value string")
    assert sorted((r.ref_id, r.id) for r in joins.probe_conflicts(refs, d).collect()) == [(1, "T1"), (2, "T2")]
    changes = spark.createDataFrame([("h1", "21/05835"), ("h2", "21/05835"), ("h3", "x")], "id string, numero string")
    kept = spark.createDataFrame([("JURITEXT1", "21-05835")], "id string, numero string")
    assert sorted(r.id for r in joins.stable_id(changes, kept).collect()) == ["JURITEXT1", "h2", "h3"]
    langs = spark.createDataFrame([("1", "E1", "ENG", "e" * 200), ("2", "E1", "FRE", "f" * 200), ("3", "E1", "RUS", ""), ("4", "E2", "ENG", "")],
                                  "id string, ecli string, lang string, text string")
    best = joins.best_language(langs, ["ecli"]).collect()
    assert [(r.case_key, r.id) for r in best] == [("E1", "2")]
    filled = {r.id: (r.text_itemid, r.text_lang) for r in joins.fill_from_sibling(langs, ["ecli"]).collect()}
    assert filled == {"1": ("1", "ENG"), "2": ("2", "FRE"), "3": ("2", "FRE"), "4": ("4", "ENG")}


def test_merges(spark):
    target = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, v string")
    log = spark.createDataFrame([(1, "a", "modify", "2"), (2, "a", "modify", "3"), (3, "b", "delete", None), (4, "z", "delete", None),
                                 (5, "d", "create", "1"), (5, "d", "create", "1")], "seq int, id string, op string, v string")
    once = merge.apply_changes(target, log, "id", "seq")
    state = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert state(once) == [("a", "3"), ("c", "1"), ("d", "1")] == state(merge.apply_changes(once, log, "id", "seq"))
    actions = {r.id: r.action for r in merge.change_actions(target, log, "id", "seq").collect()}
    assert actions == {"a": "updated", "b": "deleted", "z": "ignored", "d": "inserted"}
    batch = spark.createDataFrame([(1, "a", "9", "n"), (2, "e", "8", "n"), (3, "e", "7", "n")], "seq int, id string, v string, extra string")
    assert state(merge.insert_ignore(target, batch, "id", "seq")) == [("a", "1"), ("b", "1"), ("c", "1"), ("e", "8")]
    up = merge.upsert(target, batch, "id", "seq")
    assert state(up) == [("a", "9"), ("b", "1"), ("c", "1"), ("e", "7")] and up.columns == ["id", "v", "extra"]


def test_aggregates(spark):
    docs = spark.createDataFrame([(1, "A.B@x.fr, a.b@x.fr."), (2, "c@justice.fr a.b@x.fr"), (3, "rien")], "id int, t string")
    got = {r.mail: (r.n, r.first_seen.id) for r in aggregates.mine_emails(docs, "t", "id").collect()}
    assert got == {"a.b@x.fr": (3, 1), "c@justice.fr": (1, 2)}
    assert aggregates.justice_domains(aggregates.mine_emails(docs, "t", "id")).first().justice_fr == 1
    leaves = spark.createDataFrame([("39", 1), ("39-02", 2), ("39-02-005", 3), ("40-01", 4)], "code string, freq int")
    got = {r.code: (r.freq_as_leaf, r.freq_cumulative) for r in aggregates.cumulative_frequency(leaves).collect()}
    assert got == {"39": (1, 6), "39-02": (2, 5), "39-02-005": (3, 3), "40": (0, 4), "40-01": (4, 4)}
    sums = spark.createDataFrame([(i, f"39-02 MARCHES PUBLICS. - {x} le contrat") for i, x in
                                  enumerate(["EXECUTION", "EXECUTION", "FORMATION"])], "id int, s string")
    tree = {r.code: r for r in aggregates.classification_tree(sums, "id", "s").collect()}
    assert tree["39-02"].label == "EXECUTION" and tree["39"].freq_cumulative == 3 and tree["39-02"].parent_code == "39"
    assert [v.n for v in tree["39-02"].variants] == [2, 1]
    gates = {r.rule: r.passed for r in aggregates.quality_gates(docs, {
        "volume": (F.count("*"), 3), "mails": (F.count_if(F.col("t").contains("@")), 3), "blank": (-F.count_if(F.col("t") == ""), 0)}).collect()}
    assert gates == {"volume": True, "mails": False, "blank": True}
    assert [r.n for r in aggregates.stats(decisions_df(spark)).collect()][:2] == [6, 2]


def test_directory_merge(spark):
    rows = [(1, "ta", "TA  Paris", [], "1", "s", "a"), (2, "ta", "ta paris", ["m@x"], None, None, None), (3, "ta", "TA Paris", ["n@x"], "1", None, None),
            (4, "ta", "TA Paris", ["o@x"], "1", None, None), (5, "ta", "Lyon", [], None, None, None), (6, "ta", "lyon", [], "1", "1", "1")]
    df = spark.createDataFrame(rows, "ord int, type string, nom string, mails array<string>, tel string, site string, adresse_postale string")
    assert sorted(r.ord for r in windows.merge_directory(df).collect()) == [3, 5]


def test_enumeration(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 7).cast("int"))).alias("d"))
    rows = windows.enumerate_pages(df, "id", "d", page_size=128).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1000)) and rows[-1].page == 7
    expected = sorted(((r.d is None, -(r.d.toordinal() if r.d else 0), r.id) for r in rows))
    assert [r.id for r in rows] == [e[2] for e in expected]


def test_paging(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10, D(2020, 1, 1 + i) if i else None) for i in range(5)], "query_id int, id int, score double, date date")
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    kept = windows.keep_best(hits, ["query_id"], F.desc("score"), k=3, rank_col="rank")
    m = windows.page_marker(windows.page_hits(kept, 2), totals).first()
    assert (m.total, m.returned, m.truncated, m.next_offset) == (5, 2, True, 2)
    ids = lambda mode, exact=None: [r.id for r in windows.order_hits(hits.withColumnRenamed("score", "relevance"), mode, exact).collect()]
    assert ids("date_desc") == [4, 3, 2, 1, 0] and ids("date_asc") == [1, 2, 3, 4, 0] and ids("relevance", F.col("id") == 3)[0] == 3
    assert [r.id for r in windows.page(hits.orderBy("id"), 2, 1).collect()] == [1, 2]
    assert sorted(r.date for r in windows.retain_latest(hits.where("id > 0"), "date", 2).collect()) == [D(2020, 1, 4), D(2020, 1, 5)]


def test_citation_graph(spark):
    docs = spark.createDataFrame([("d1", D(2000, 1, 1), "vu l'article 1128 du code civil"), ("d2", D(2020, 1, 1), "art. 1128 C. civ. puis article 1128 du code civil"),
                                  ("d3", D(2020, 1, 1), "article L. 1152-1 du code du travail")], "doc_id string, date date, text string")
    cites = citing.citation_table(docs, "doc_id", "text")
    got = {(r.doc_id, r.num): r.legiarti for r in citing.resolve_citations(cites, docs, versions_df(spark)).collect()}
    assert got == {("d1", "1128"): "LEGIARTI1", ("d2", "1128"): "A2", ("d3", "L1152-1"): None}
    refs = spark.createDataFrame([(1, "CC", "1128"), (2, "CT", "L. 1152-1")], "ref_id int, code string, num string")
    exact = sorted((r.ref_id, r.doc_id) for r in citing.decisions_citing(refs, cites, docs, limit=5).collect())
    assert exact == [(1, "d1"), (1, "d2"), (2, "d3")]
    text = sorted((r.ref_id, r.doc_id) for r in citing.decisions_citing_text(refs, docs, "doc_id", ["text"], "d").collect())
    assert text == exact
