import datetime
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.operators.filters import to_result
from lexloom.operators.windows import keep_best
from lexloom.plans import cascade, collections, directory, federation, index, search, thesaurus
from lexloom.runtime import shared_dir, stage, staging

D = datetime.date
K1, B = search.K1, search.B


def brute(docs, clauses, excluded=()):
    """Reference BM25 over token lists: clauses are lists of atoms, an atom is (words, is_prefix)."""
    def tf(tokens, atom):
        terms, prefix = atom
        ok = lambda i: all(tokens[i + j] == t or (prefix and j == len(terms) - 1 and tokens[i + j].startswith(t)) for j, t in enumerate(terms))
        return sum(ok(i) for i in range(len(tokens) - len(terms) + 1))
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    dfs = {str(a): sum(tf(t, a) > 0 for t in docs.values()) for c in clauses for a in c}
    for d, tokens in docs.items():
        if any(tf(tokens, a) for a in excluded) or not clauses or not all(any(tf(tokens, a) for a in c) for c in clauses):
            continue
        s = 0.0
        for c in clauses:
            for a in c:
                f = tf(tokens, a)
                s += math.log(1 + (n - dfs[str(a)] + .5) / (dfs[str(a)] + .5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(tokens) / avg))
        out[d] = round(s, 6)
    return out


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "alphabet", "omega", "alp"]
    docs = {i: [rng.choice(vocab) for _ in range(rng.randrange(1, 30))] for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id int, text string")
    cases = {1: ("alpha beta", [[(["alpha"], False)], [(["beta"], False)]], []),
             2: ("alpha OR omega -delta", [[(["alpha"], False), (["omega"], False)]], [(["delta"], False)]),
             3: ('"alpha beta" gamma', [[(["alpha", "beta"], False)], [(["gamma"], False)]], []),
             4: ("alph* delta", [[(["alph"], True)], [(["delta"], False)]], []), 5: ("-alpha", [], [(["alpha"], False)]),
             6: ("unknown alpha", [[(["unknown"], False)], [(["alpha"], False)]], []),
             7: ('"beta alpha gamma"', [[(["beta", "alpha", "gamma"], False)]], [])}
    queries = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "query_id int, query string")
    posts = index.postings(df, "doc_id", ["text"], "d")
    matched = search.match(search.parsed(queries), posts, index.corpus_stats(posts)).collect()
    for i, (_, clauses, excluded) in cases.items():
        got = {r.doc_id: r.score for r in matched if r.query_id == i}
        expected = brute(docs, clauses, excluded)
        assert got.keys() == expected.keys() and all(abs(got[d] - expected[d]) < 2e-6 for d in got), cases[i][0]
    plain = queries.where("query_id <> 4")
    scanned = {(r.query_id, r.doc_id, r.score) for r in search.match_docs(plain, df, "doc_id", ["text"]).collect()}
    assert scanned == {(r.query_id, r.doc_id, r.score) for r in matched if r.query_id != 4}


CLAUSE_ROWS = "query_id long, clause_id int, op string, terms array<string>, is_prefix boolean"


def test_searches_as_rows_equal_searches_as_text(spark):
    rng = random.Random(8)
    letters = ["alpha", "alpin", "bravo", "charlie", "delta", "écho", "foxtrot"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(letters, k=rng.randint(1, 9)))) for i in range(60)], "doc_id long, text string")
    texts = spark.createDataFrame([
        (1, "alpha bravo"), (2, '"alpha bravo" OR delta'), (3, "alp* NOT charlie"), (4, '(echo OR foxtrot) delta -"bravo charlie"'), (5, "NOT alpha")],
        "query_id long, query string")
    rows = spark.createDataFrame([
        (1, 1, "must", ["Alpha"], False), (1, 2, "must", ["BRAVO"], None), (2, 1, "must", ["alpha", "bravo"], False), (2, 1, "must", ["delta"], False),
        (3, 1, "must", ["alp"], True), (3, 2, "not", ["charlie"], False), (4, 7, "must", ["ECHO"], False), (4, 7, "must", ["foxtrot"], False),
        (4, 9, "must", ["delta"], False), (4, 11, "not", ["bravo charlie"], False), (5, 1, "not", ["alpha"], False)], CLAUSE_ROWS)
    found = [{(r.query_id, r.doc_id, r.score) for r in search.match_docs(q, docs, "doc_id", ["text"]).collect()} for q in (texts, rows)]
    assert found[0] == found[1] and {q for q, _, _ in found[0]} == {1, 2, 3, 4}


def test_odd_clause_rows(spark):
    docs = spark.createDataFrame([(1, "alpha bravo"), (2, "bravo"), (3, None), (4, "")], "doc_id long, text string")
    rows = spark.createDataFrame([
        (1, 1, "must", ["alpha", None], False), (2, 1, "must", ["bravo"], False), (2, 2, "not", [None], False), (3, 1, "must", [], False),
        (3, 2, "must", ["alpha"], False), (4, 1, "must", [None], True), (5, 1, "must", None, None)], CLAUSE_ROWS)
    found = lambda q: {(r.query_id, r.doc_id) for r in search.match_docs(q, docs, "doc_id", ["text"]).collect()}
    assert found(rows) == {(2, 1), (2, 2), (3, 1)} and found(rows.limit(0)) == set()
    scores = search.match_docs(spark.createDataFrame([(1, 1, "must", ["bravo"], False)] * 2, CLAUSE_ROWS), docs, "doc_id", ["text"])
    single = search.match_docs(spark.createDataFrame([(1, 1, "must", ["bravo"], False)], CLAUSE_ROWS), docs, "doc_id", ["text"])
    assert [r.score for r in scores.orderBy("doc_id").collect()] == pytest.approx([2 * r.score for r in single.orderBy("doc_id").collect()], abs=2e-6)


def test_scanned_phrases_and_beginnings_against_brute_force(spark):
    rng = random.Random(5)
    docs = {i: rng.choices(["al", "alp", "alpha", "be", "bet", "ga"], weights=[5, 4, 3, 3, 2, 1], k=rng.randint(1, 60)) for i in range(80)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id int, text string")
    asked = [(rng.choices(["al", "alp", "be", "alpha"], k=n), star) for n in (1, 2, 3, 4, 5, 6, 9) for star in (False, True) for _ in range(3)]
    planted = [(docs[i][3:3 + n], star) for i, n, star in ((1, 5, False), (2, 8, True), (3, 10, False), (4, 6, True)) if len(docs[i]) >= 3 + n]
    cases = dict(enumerate(asked + planted))
    rows = spark.createDataFrame([(i, 1, "must", *atom) for i, atom in cases.items()], CLAUSE_ROWS)
    posts = index.postings(df, "doc_id", ["text"], "documents")
    for found in (search.match_docs(rows, df, "doc_id", ["text"]), search.match(search.parsed(rows), posts, index.corpus_stats(posts))):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.doc_id] = r.score
        for i, atom in cases.items():
            assert got.get(i, {}) == pytest.approx(brute(docs, [[atom]]), abs=2e-6), atom
    assert any(len(words) > 4 and brute(docs, [[(words, star)]]) for words, star in cases.values())


def test_a_frequent_word_of_many_phrases_is_not_looked_up_alone(spark):
    docs = spark.range(40).select("id", F.concat(F.lit("common "), F.col("id").cast("string")).alias("text"))
    rows = spark.range(40).select(F.col("id").alias("query_id"), F.lit(1).alias("clause_id"), F.lit("must").alias("op"),
                                  F.array(F.lit("common"), F.col("id").cast("string")).alias("terms"), F.lit(False).alias("is_prefix"))
    pieces = search._pieces(search.parsed(rows), search.SPAN)
    posts, _ = search.scan_postings(pieces, docs, "id", ["text"], "documents")
    assert posts.where(F.col("term") != index.DOCUMENT_MARK).count() == 40  # by its single words, 1,600 pairs would meet
    assert {(r.query_id, r.doc_id) for r in search.match_docs(rows, docs, "id", ["text"]).collect()} == {(i, i) for i in range(40)}


def test_rows_that_share_an_id_are_one_scanned_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, "b a"), (2, "b")], "doc_id int, text string")
    pieces = search._pieces(search.parsed(spark.createDataFrame([(1, 1, "must", ["a"], False)], CLAUSE_ROWS)), search.SPAN)
    posts, corpus = search.scan_postings(pieces, docs, "doc_id", ["text"], "documents")
    assert {(r.doc_id, r.tf) for r in posts.where("term = 'a'").collect()} == {(1, 1), (None, 2)} and corpus.first().n_docs == 3


def test_staged_folders_are_removed_with_their_owner(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha bravo"), (2, "bravo")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "bravo")], "query_id long, query string")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "lexloom-stage"
    kept = stage(docs, "kept")
    before = set(folder.iterdir())
    with staging(spark):
        search.search_docs(queries, docs, "doc_id", ["text"]).write.parquet(str(tmp_path / "hits"))
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before and kept.count() == 2 and spark.read.parquet(str(tmp_path / "hits")).count() == 2
    with pytest.raises(ValueError), staging(spark):
        stage(docs, "lost")
        raise ValueError
    assert set(folder.iterdir()) == before


def test_hostile_queries(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id int, text string")
    hostile = ['"', "((", "*", "a AND", "NOT", "OR OR", "-", "\\", "a:b", "NEAR(a b)", "'; drop", "é\u0000"]
    queries = spark.createDataFrame(list(enumerate(hostile)), "query_id int, query string")
    assert search.search_docs(queries, df, "doc_id", ["text"]).count() == 0


def test_fields_and_phrases(spark):
    df = spark.createDataFrame([(1, "a b", "c d"), (2, "x", "b c")], "doc_id int, f string, g string")
    posts = index.postings(df, "doc_id", ["f", "g"], "d")
    queries = spark.createDataFrame([(1, '"b c"'), (2, '"c d"')], "query_id int, query string")
    rows = search.search(queries, posts, index.corpus_stats(posts)).collect()
    assert sorted((r.query_id, r.doc_id) for r in rows) == [(1, 2), (2, 1)]


def test_reindex_keeps_index_in_step(spark):
    docs = spark.createDataFrame([(1, "old words"), (2, "stay here"), (3, "gone soon")], "doc_id int, text string")
    posts = index.postings(docs, "doc_id", ["text"], "d")
    after = spark.createDataFrame([(1, "new text"), (2, "stay here")], "doc_id int, text string")
    changed = spark.createDataFrame([(1,), (3,)], "doc_id int")
    fresh = index.reindex(posts, after, changed, "doc_id", ["text"], "d")
    state = lambda p: sorted((r.term, r.doc_id, r.tf, r.positions) for r in p.collect())
    assert state(fresh) == state(index.postings(after, "doc_id", ["text"], "d"))
    again = index.reindex(fresh, after, changed, "doc_id", ["text"], "d")
    assert state(again) == state(fresh)


def test_written_index(spark):
    docs = spark.createDataFrame([(1, "un deux"), (2, "deux trois")], "doc_id int, text string")
    index.write_postings(index.postings(docs, "doc_id", ["text"], "d"), "lexloom_test_postings", 4)
    terms = spark.createDataFrame([("deux",)], "term string")
    assert index.read_postings(spark, "lexloom_test_postings", terms).count() == 2
    files = spark.table("lexloom_test_postings").inputFiles()
    index.write_postings(index.postings(docs.repartition(50), "doc_id", ["text"], "d"), "lexloom_test_postings", 4)
    assert len(files) <= 4 and len(spark.table("lexloom_test_postings").inputFiles()) <= 4  # little data: one file a bucket, however many input tasks
    spark.sql("drop table lexloom_test_postings")


def test_prefixes_without_an_index(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet gamma alpha"), (3, "beta gamma")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "alph*"), (2, "gam* alpha"), (3, "beta -alph*"), (4, "alph* alpha")], "query_id int, query string")
    found = {(r.query_id, r.doc_id, r.score) for r in search.match_docs(queries, docs, "doc_id", ["text"], "d").collect()}
    assert {f[:2] for f in found} == {(1, 1), (1, 2), (2, 2), (3, 3), (4, 1), (4, 2)}
    posts = index.postings(docs, "doc_id", ["text"], "d")
    stored = search.match(search.parsed(queries), posts, index.corpus_stats(posts))
    assert {(r.query_id, r.doc_id, r.score) for r in stored.collect()} == found


def test_every_version_is_searched(spark):
    rows = [("A1", "T", "bail", "2000-01-01"), ("A1", "T", "loyer", "2010-01-01"), ("A2", "T", "loyer loyer", "2010-01-01")]
    versions = spark.createDataFrame(rows, "legiarti string, legitext string, texte string, date_debut string").withColumn("date_debut", F.to_date("date_debut"))
    queries = spark.createDataFrame([(1, "bail"), (2, "loyer")], "query_id int, query string")
    hits = {(r.query_id, r.legiarti, r.texte) for r in collections.search_statutes(queries, versions).collect()}
    assert hits == {(1, "A1", "bail"), (2, "A2", "loyer loyer")}


def test_snippet(spark):
    tokens = [f"w{i}" for i in range(100)]
    tokens[60], tokens[70], tokens[5] = "Été", "midi", "midi"
    df = spark.createDataFrame([(" ".join(tokens),), ("midi court",)], "t string")
    long, short = [r[0] for r in df.select(search.snippet("t", F.array(F.lit("ete"), F.lit("midi")))).collect()]
    assert "<em>Été</em>" in long and "<em>midi</em>" in long and long.startswith("…") and long.endswith("…")
    assert len(re.sub("[…]", "", long).split()) == 28 and short == "<em>midi</em> court"


def decisions(spark):
    return spark.createDataFrame([
        ("J1", "Cass, pourvoi", "Cour de cassation", "rejet", "22-87.145", "", "le licenciement abusif", "2023-05-01", "E1", "ARRET"),
        ("J2", "CA", "Cour d'appel de Douai", "", "21/05835", "", "licenciement", "2025-01-15", "E2", "ARRET"),
        ("C1", "Décision 2008-562 DC", "Conseil constitutionnel", "", "2008-562", "", "rétention 2008-562", "2008-02-21", "", "DC"),
        ("C2", "Décision 2008-562 QPC", "Conseil constitutionnel", "", "2008-562", "", "licenciement 2008-562", "2009-02-21", "", "QPC")],
        "id string, titre string, juridiction string, solution string, numero string, formation string, text string, date string, ecli string, nature string")


def test_collection_searches(spark):
    d = decisions(spark)
    q = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    ids = lambda df, col="id": [r[col] for r in df.orderBy("query_id", "rank").collect()]
    assert sorted(ids(collections.search_judicial(q("licenciement"), d))) == ["C2", "J1", "J2"]
    assert ids(collections.search_judicial(q("licenciement"), d, family="appel")) == ["J2"]
    assert ids(collections.search_judicial(q("licenciement"), d, sort="date_asc", date_min="2010-01-01")) == ["J1", "J2"]
    assert ids(collections.search_constit(q("2008-562 DC", "2008-562"), d)) == ["C1", "C2", "C1"]
    numbers = spark.createDataFrame([(1, "2008-562")], "query_id int, number string")
    assert ids(collections.constit_by_number(numbers, d)) == ["C2"]
    long = "torture " + "mot " * 100
    echr = spark.createDataFrame([("1", "A", "CLINF", long, "1/02"), ("2", "B", "HFJUD", long + "4143/02", "9/99"), ("3", "C", "HFJUD", long + " 4143 02", "4143/02"),
                                  ("4", "D", "HFJUD", "torture", "4143/02")], "itemid string, docname string, doctype string, text string, appno string")
    assert ids(collections.search_echr(q("torture", "torture 4143/02"), echr), "itemid") in (["3", "2", "1", "3", "2"], ["2", "3", "1", "3", "2"])
    cjeu = spark.createDataFrame([("a", "T", "cite C-395/21", "C-1/20"), ("b", "T", "arrêt C-395/21 avec plus de mots", "C-395/21")],
                                 "celex string, title string, text string, affaire_num string")
    assert ids(collections.search_cjeu(q("C-395/21"), cjeu), "celex") == ["b", "a"]
    adm = d.withColumnRenamed("text", "texte")
    adm = adm.unionByName(spark.createDataFrame([("A1", "t", "CAA de PARIS", "", "22PA05407", "", "texte admin", "2022-01-01", "", "x")], adm.schema))
    assert ids(collections.search_admin(q("n° 22PA05407", "2116343 admin", "texte admin"), adm)) == ["A1", "A1"]
    laws = spark.createDataFrame([("L1", "T1", "1", "Code", "VIGUEUR", "2000-01-01", "bail bail"), ("L2", "T1", "2", "Code", "VIGUEUR", "2000-01-01", "bail et autre"),
                                  ("L3", "T2", "1", "Loi", "VIGUEUR", "2001-01-01", "un bail quelconque ici")],
                                 "legiarti string, legitext string, num string, titre_text string, etat string, date_debut string, texte string")
    assert ids(collections.search_statutes(q("bail"), laws), "legitext") == ["T1", "T2"]
    gaz = spark.createDataFrame([("G1", "arrêté bail", "ARRETE", "2020-01-01"), ("G2", "loi bail", "LOI", "2020-01-01")], "jorftext string, titre string, nature string, date_publi string")
    assert ids(collections.search_gazette(q("bail"), gaz, nature="loi"), "jorftext") == ["G2"]


def test_unified_search(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, text string")
    tables = {"cjue": (mk([("c1", "bail commun"), ("c2", "bail bail")]), "id", ["text"]), "legi": (mk([("l1", "bail")]), "id", ["text"]),
              "dila": (mk([("d1", "loyer"), ("d2", "rien")]), "id", ["text"])}
    queries = spark.createDataFrame([(1, "bail", "bail OR loyer"), (2, "rien", "rien inexistant"), (3, "nul", None)], "query_id int, query string, expanded string")
    rows = federation.search_all(queries, tables).collect()
    got = {(r.query_id, r.variant, r.source, r.id): r.score for r in rows}
    assert got == {(1, 0, "cjue", "c2"): 1.2, (1, 0, "cjue", "c1"): 1.199, (1, 0, "dila", "d1"): 1.15, (1, 0, "legi", "l1"): 0.8, (2, 1, "dila", "d2"): 1.15}


def test_federated_search(spark):
    d = decisions(spark)
    cjeu = spark.createDataFrame([("62021CJ0395", "ECLI:EU:C:2021:395", "2021-01-01", "licenciement", "C-395/21", "x")],
                                 "celex string, ecli string, date string, title string, affaire_num string, text string")
    tables = {"dila": (d, ["titre", "juridiction", "numero", "text"]), "cjue": (cjeu, ["title", "text", "affaire_num"])}
    queries = spark.createDataFrame([(1, "licenciement"), (2, "62021CJ0395"), (3, "22-87145"), (4, "licenciement 2008-562"), (5, "21/05835"), (6, "")], "query_id int, query string")
    rows = federation.search_federated(queries, tables).orderBy("query_id", "rank").collect()
    got = {q: [r.id for r in rows if r.query_id == q] for q in range(1, 7)}
    assert got[1] == ["J2", "J1", "62021CJ0395", "C2"]  # newest first without a relevance
    assert got[2] == ["62021CJ0395"] and got[3] == ["J1"] and got[5] == ["J2"] and got[6] == []
    assert got[4] == ["C2"]


def test_reference_cascade(spark):
    admin = spark.createDataFrame([
        ("DCAA_21TL04508_20240227", "CAA de TOULOUSE", "2024-02-27", "21TL04508", "t"), ("T3830", "Tribunal des conflits", "2012-04-02", "C3830", "t"),
        ("X1", "TA de LILLE", "2023-04-05", "2300001", "Welkamp c/ MDPH")],
        "id string, juridiction string, date string, numero string, titre string")
    dila = spark.createDataFrame([
        ("TJ1", "Tribunal judiciaire de Saint-Quentin", "2026-07-02", "26/00038", "t"), ("TJ2", "Tribunal judiciaire de Bobigny", "2026-07-09", "26/00038", "t"),
        ("CA1", "Cour d'appel de Douai", "2026-01-01", "26/00038", "t"), ("K1", "Cour de cassation", "2022-10-04", "22-87.145", "t")],
        "id string, juridiction string, date string, numero string, titre string")
    cjue = spark.createDataFrame([("62011CJ0312", "2013-01-01", "Commission / Italie")], "celex string, date string, title string")
    rows = to_result(admin, "admin").unionByName(to_result(dila, "dila")).unionByName(to_result(cjue, "cjue"))
    texts = ["CAA Toulouse, 2e ch., 27 fév. 2024, n° 21TL04508", "C3830", "CJUE, C-312/11", "tj saint-quentin 26-00038", "26/00038", "cass 22-87145",
             "9 juillet 2026 bobigny tj", "TA Lille, Welkamp, 2023-04-05", "tj paris, 1er mars 2001", "bonjour"]
    refs = spark.createDataFrame(list(enumerate(texts)), "ref_id int, query string")
    out = cascade.resolve_references(refs, rows).orderBy("ref_id", "rank").collect()
    got = {i: [r.id for r in out if r.ref_id == i] for i in range(len(texts))}
    assert got[0] == ["DCAA_21TL04508_20240227"] and got[1] == ["T3830"] and got[2] == ["62011CJ0312"]
    assert got[3] == ["TJ1", "TJ2"] and set(got[4]) == {"TJ1", "TJ2", "CA1"} and got[5] == ["K1"]
    assert got[6] == ["TJ2"] and got[7] == ["X1"] and got[9] == []
    assert got[8] == [None] and "introuvable" in [r.note for r in out if r.ref_id == 8][0]


def test_directory_search(spark):
    rng = random.Random(5)
    entries = [(i, "".join(rng.choice("abcé@.") for _ in range(8)), "".join(rng.choice("ABc é") for _ in range(6)), rng.choice([None, "abc", "bureau"])) for i in range(80)]
    df = spark.createDataFrame(entries, "entry_id int, mail string, organisme string, service string")
    queries = [(i, q) for i, q in enumerate(["ab", "é", "abc", "bure", "ab c", "zzz", "", " BC "])]
    got = directory.search_directory(spark.createDataFrame(queries, "query_id int, query string"), df, limit=10).collect()
    for i, q in queries:
        q = q.strip().lower()
        points = [(next((s for s, f in zip((3, 2, 1), e[1:]) if q and q in (f or "").lower()), 0), e[0]) for e in entries]
        expected = [(p, e) for p, e in sorted(points, key=lambda x: (-x[0], x[1])) if p > 0][:10]
        assert [(r.score, r.entry_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == expected, q


def test_thesaurus_expansion(spark):
    concepts = spark.createDataFrame([("pcja", "1", "Harcèlement moral", None, 1, "admin", 1), ("pcja", "1-1", "Mobbing", "1", 2, "admin", 1),
                                      ("eurovoc", "9", "Travail", None, 1, "all", 1), ("vie_publique", "v", "Harcèlement", None, 1, "x", 0)] +
                                     [("eurovoc", f"9-{i}", f"enfant {i:02d}", "9", 2, "all", 0) for i in range(12)],
                                     "source string, code string, label string, parent_code string, depth int, scope string, freq long")
    alt = spark.createDataFrame([("pcja", "1", "pression psychologique", "alt"), ("vie_publique", "v", "intimidation", "alt")], "source string, code string, label string, label_type string")
    concepts, labels, relations = thesaurus.build_thesaurus([
        (concepts, thesaurus.concept_labels(concepts), thesaurus.parent_relations(concepts)), (concepts, alt, thesaurus.parent_relations(concepts))])
    assert concepts.count() == 16 and relations.count() == 13
    queries = spark.createDataFrame([(1, "harcelement moral au bureau", "toutes"), (2, '"harcèlement moral" -harcèlement travail', "toutes"), (3, "harcèlement", "europeen"),
                                     (4, "inconnu", "zz"), (5, "", "toutes")], "query_id int, query string, scope string")
    out = {r.query_id: r for r in thesaurus.expand_queries(queries, concepts, labels, "scope").collect()}
    assert out[1].expanded == '(harcelement moral OR "pression psychologique" OR Mobbing) au bureau'.replace("(harcelement moral", '("harcelement moral"').replace('"pression psychologique" OR Mobbing', 'Mobbing OR "pression psychologique"')
    assert out[2].expanded.startswith('"harcèlement moral" -harcèlement (travail OR "enfant 00"') and len(out[2].trace[0].synonyms) == 8
    assert out[3].expanded == "harcèlement" and out[4].expanded == "inconnu" and out[5].expanded == ""
    flat = spark.createDataFrame([("harcèlement moral", ["mobbing"]), ("harcèlement", ["x y"])], "term string, synonyms array<string>")
    out = {r.query_id: r.expanded for r in thesaurus.expand_with_dict(queries.drop("scope"), flat).collect()}
    assert out[1] == '("harcelement moral" OR mobbing) au bureau' and out[3] == '(harcèlement OR "x y")'


@pytest.mark.parametrize("key", ["statute_version", "decision", "agreement", "echr_decision"])
def test_schemas_parse(spark, key):
    from lexloom.schemas import SCHEMAS
    assert spark.createDataFrame([], SCHEMAS[key]).count() == 0 and len(dims.CODE_TEXT_IDS) == 79


def test_shared_questions_are_ranked_before_references_meet_them(spark):
    rng = random.Random(11)
    day = lambda: rng.choice([None, D(2001, 3, 4), D(2001, 5, 6), D(2002, 3, 4), D(2003, 1, 1)])
    city = lambda: rng.choice(["", "Douai", "Riom"])
    parsed = spark.createDataFrame([(i, city(), day(), rng.choice(["", "Martin", "Martin Durand"])) for i in range(60)] + [(7, "Riom", D(2002, 3, 4), "")],
                                   "ref_id int, juri_ville string, ref_date date, ref_text string")
    rows = spark.createDataFrame([
        (rng.choice("ab"), rng.choice("xy"), f"D{rng.randrange(60)}", f"Cour de {city()}", rng.choice(["Martin", "Durand c. Martin", None]), day(), rng.choice([None, 100.0]))
        for _ in range(120)], "ask string, source string, id string, juridiction string, title string, date date, relevance double")
    asked = parsed.select("ref_id", F.when(F.col("ref_id") % 2 == 0, "a").otherwise("b").alias("ask"))
    for limit in (1, 3):
        few = cascade._candidates(asked, rows, parsed, limit)
        ranks = lambda hits: sorted((r.ref_id, r.rank, r.id, r.source, r.score) for r in cascade.rescore(hits, parsed, limit).collect())
        assert ranks(few) == ranks(asked.join(rows, "ask").drop("ask"))
        assert few.count() <= 3 * limit * (parsed.count() + 1) < asked.join(rows, "ask").count()


def test_equal_references_ask_once(spark):
    refs = spark.createDataFrame([(i, "cass 12-12.345") for i in range(30)] + [(None, "cass 12-12.345")], "ref_id int, query string")
    parsed = cascade.parse_references(refs, "query")
    rows = to_result(spark.createDataFrame([(f"J{i}", "12-12.345", "Cour de cassation", "2001-01-01") for i in range(30)],
                                           "id string, numero string, juridiction string, date string"), "dila")
    assert cascade._by_number(cascade.numbers_of(parsed), rows).count() == 30  # not 30 for each reference
    found = cascade.resolve_references(refs, rows, limit=1).collect()
    assert sorted((r.ref_id, r.id) for r in found if r.ref_id is not None) == [(i, "J0") for i in range(30)]
    assert [r.id for r in found if r.ref_id is None] == [None]


def test_hits_meet_documents_without_another_exchange(spark, monkeypatch):
    rng = random.Random(5)
    words = ["arrêt", "cour", "vente", "bail", "route"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6)), f"p{i % 7}") for i in range(200)], "doc_id long, text string, parent string")
    queries = spark.createDataFrame([(i, f'"{w}"') for i, w in enumerate(words)], "query_id int, query string")
    staged = {}
    monkeypatch.setattr(search, "HITS", 20)
    monkeypatch.setattr(search, "FILE_ROWS", 30)
    monkeypatch.setattr(search, "stage", lambda df, name, **options: staged.setdefault(name, stage(df, name, **options)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.attach(search.match_docs(queries, docs, "doc_id", ["text"]), docs, "doc_id", "parent")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        found = {(r.query_id, r.doc_id, r.parent) for r in hits.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(i, r.doc_id, r.parent) for r in docs.collect() for i, w in enumerate(words) if w in r.text.split()}
    assert "hashpartitioning(query_id" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 2
    # A split by bytes takes whole files, so their rows bound those of a task.
    sizes = staged["scan-postings"].groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 30 < sum(r["count"] for r in sizes)


def test_memory_of_a_search_does_not_grow_with_words_or_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b a" if i % 2 else "a c d", f"s{i}") for i in range(30)], "id long, text string, source string")
    queries = spark.createDataFrame([(i, '"a"') for i in range(20)], "query_id int, query string")
    monkeypatch.setattr(search, "HITS", 20)
    pieces = search._pieces(search.parsed(queries), search.SPAN)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        posts = index.query_postings(docs, "id", ["text"], pieces, {1: [0]}, "documents")
        assert "Exchange hashpartitioning(collection" not in plan(posts) and "doc_id" not in plan(posts).split("Aggregate(keys=[", 1)[-1].split("]")[0]
        assert {(r.doc_id, r.term, r.tf, r.doc_len) for r in posts.collect()} == {
            (i, *x) for i in range(30) for x in (("", 1, 3), ("a", 1 + i % 2, 3))}
        found = search.match_docs(queries, docs, "id", ["text"])
        # Hits are dealt before the twenty queries meet them.
        assert 0 < plan(found).index("BroadcastHashJoin [collection") < plan(found).index("Exchange hashpartitioning(doc_id")
        assert {(r.query_id, r.doc_id) for r in found.collect()} == {(q, i) for q in range(20) for i in range(30)}
        best = search.top_k(found, 2)
        # Few ranked hits go to the texts; the texts stay where they are.
        assert "Exchange hashpartitioning(id" not in plan(collections.with_texts(best.withColumnRenamed("doc_id", "id"), docs.select("id", "text"), "id"))
        assert "Exchange hashpartitioning(doc_id" not in plan(search.with_snippets(best, docs, search.parsed(queries), "id", "text"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_many_atoms_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "b a"), (2, "b"), (None, "a")], "id long, text string")
    queries = spark.createDataFrame([(1, '"a" "b"'), (2, '"b" -"a"'), (3, "a*")], "query_id int, query string")
    found = lambda: {(r.query_id, r.doc_id, r.score) for r in search.match_docs(queries, docs, "id", ["text"]).collect()}
    few = found()
    monkeypatch.setattr(search, "BATCH", 1)
    assert found() == few and {x[:2] for x in few} == {(1, 1), (2, 2), (3, 1), (3, None)}


def test_few_searches_exchange_no_words_or_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b a" if i % 2 else "a c d", f"s{i}") for i in range(30)], "id long, text string, source string")
    queries = spark.createDataFrame([(i, '"a" "b"') for i in range(20)], "query_id int, query string")
    monkeypatch.setattr(search, "HITS", 20)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pieces = search._pieces(search.parsed(queries), search.SPAN)
        posts = index.query_postings(docs, "id", ["text"], pieces, {1: [0]}, "documents")
        assert "SortMergeJoin" not in plan(posts)
        atoms = search.parsed(queries)
        found = search.match_atoms(atoms, docs, "id", ["text"])
        assert "SortMergeJoin [term" not in plan(found)
        assert {(r.query_id, r.doc_id) for r in found.collect()} == {(q, i) for q in range(20) for i in range(1, 30, 2)}
        best = search.top_k(found, 2)
        assert "SortMergeJoin" not in plan(collections.with_texts(best.withColumnRenamed("doc_id", "id"), docs.select("id", "text"), "id"))
        assert "SortMergeJoin" not in plan(search.with_snippets(best, docs, atoms, "id", "text"))
        stored = stage(index.postings(docs, "id", ["text"], "documents"), "postings")
        begun = search.parsed(spark.createDataFrame([(1, "b*")], "query_id int, query string"))
        assert {r.doc_id for r in search.match(begun, stored, index.corpus_stats(stored)).collect()} == set(range(1, 30, 2))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_of_statutes_are_dealt_by_their_number(spark, monkeypatch):
    versions = spark.createDataFrame([(f"A{i % 20}", f"T{i % 3}", "bail", D(2001, 1, 1 + i // 20)) for i in range(60)],
                                     "legiarti string, legitext string, texte string, date_debut date")
    queries = spark.createDataFrame([(i, '"bail"') for i in range(4)], "query_id int, query string")
    plans = []

    def planned(df, keys, *order, **options):
        best = keep_best(df, keys, *order, **options)
        plans.append(best._jdf.queryExecution().executedPlan().toString())
        return best

    monkeypatch.setattr(search, "HITS", 30)
    monkeypatch.setattr(collections, "keep_best", planned)
    found = collections.search_statutes(queries, versions, 5).collect()
    assert re.search(r"Exchange hashpartitioning\(query_id#\d+, legiarti#\d+, 9\), REPARTITION_BY_NUM", plans[0])
    assert not re.search(r"hashpartitioning\([^)]*legiarti#\d+, 4\)", plans[0])
    assert {(r.query_id, r.legitext, r.legiarti, r.date_debut) for r in found} == {
        (q, *x, D(2001, 1, 3)) for q in range(4) for x in (("T0", "A11"), ("T1", "A0"), ("T2", "A1"))}
