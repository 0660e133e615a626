"""Readers for the XML feeds. Each is a parallel scan of extracted files plus a projection.

Elements that hold markup are read as text, so their inner XML arrives unparsed and is cleaned
by column expressions. Malformed records are dropped by the permissive reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import strip_markup
from lexloom.runtime import blank_to_null

_META = "META_COMMUN struct<ID:string,NATURE:string>"
_TEXT_CHRONICLE = ("META_TEXTE_CHRONICLE struct<TITRE:string,TITREFULL:string,NUM_JORF:string,NOR:string,"
                   "DATE_PUBLI:string,DATE_TEXTE:string>")
_TEXT_VERSION = "META_TEXTE_VERSION struct<ETAT:string,DATE_DEBUT:string,DATE_FIN:string,MINISTERE:string,TITRE:string,TITREFULL:string>"


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str, stream: bool = False,
             files_per_trigger: int | None = None) -> DataFrame:
    """XML rows of one tag with an explicit schema, plus the file path they came from."""
    reader = (spark.readStream if stream else spark.read).format("xml").schema(schema)
    reader = reader.option("rowTag", row_tag).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
    reader = reader.option("attributePrefix", "_").option("valueTag", "_VALUE").option("ignoreSurroundingSpaces", "true")
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("_path", F.col("_metadata.file_path"))


def read_broken(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """``_path, record, parsed`` of the records of one tag that cannot be parsed whole: the text, and as JSON what was read of it."""
    rows = read_xml(spark, path, row_tag, f"{schema}, _corrupt_record string")
    fields = [c for c in rows.columns if c not in ("_path", "_corrupt_record")]
    return rows.where(F.col("_corrupt_record").isNotNull()).select("_path", F.col("_corrupt_record").alias("record"), F.to_json(F.struct(*fields)).alias("parsed"))


def _s(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.trim(col), F.lit(""))


def _first(*cols: str | Column) -> Column:
    """First non-blank value, else an empty text."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


STATUTE_ARTICLE = (
    f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<META_ARTICLE:struct<NUM:string,ETAT:string,DATE_DEBUT:string,"
    "DATE_FIN:string>>>, CONTEXTE struct<TEXTE:struct<_cid:string,TITRE_TXT:array<struct<_VALUE:string,_c_titre_court:string>>>>, "
    "BLOC_TEXTUEL struct<CONTENU:string>, NOTA struct<CONTENU:string>")


def statute_articles(raw: DataFrame, *keep: str) -> DataFrame:
    """Article records to version rows; ``keep`` columns pass through."""
    art = "META.META_SPEC.META_ARTICLE"
    title = F.get("CONTEXTE.TEXTE.TITRE_TXT", F.lit(0))
    return raw.where(F.col("META.META_COMMUN").isNotNull() & F.col(art).isNotNull()).select(
        *keep, _s("META.META_COMMUN.ID").alias("legiarti"), _s("CONTEXTE.TEXTE._cid").alias("legitext"),
        _s(f"{art}.NUM").alias("num"), _first(title["_c_titre_court"], title["_VALUE"]).alias("titre_text"),
        _s(f"{art}.ETAT").alias("etat"), _s(f"{art}.DATE_DEBUT").alias("date_debut"), _s(f"{art}.DATE_FIN").alias("date_fin"),
        strip_markup("BLOC_TEXTUEL.CONTENU").alias("texte"), strip_markup("NOTA.CONTENU").alias("nota"))


def read_statutes(spark: SparkSession, path: str) -> DataFrame:
    return statute_articles(read_xml(spark, path, "ARTICLE", STATUTE_ARTICLE))


STATUTE_TEXT = (f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<{_TEXT_CHRONICLE.replace(' ', ':', 1)},"
                f"{_TEXT_VERSION.replace(' ', ':', 1)}>>")


def read_statute_texts(spark: SparkSession, path: str, row_tag: str = "TEXTELR") -> DataFrame:
    """Statute-text records: chronicle and version blocks (either may be missing)."""
    raw = read_xml(spark, path, row_tag, STATUTE_TEXT)
    c, v = "META.META_SPEC.META_TEXTE_CHRONICLE", "META.META_SPEC.META_TEXTE_VERSION"
    return raw.where(F.col("META.META_COMMUN").isNotNull()).select(
        _s("META.META_COMMUN.ID").alias("legitext"), _first(f"{c}.TITRE", f"{v}.TITRE").alias("titre"),
        _first(f"{c}.TITREFULL", f"{v}.TITREFULL").alias("titre_long"), _s("META.META_COMMUN.NATURE").alias("nature"),
        _s(f"{v}.ETAT").alias("etat"), _s(f"{v}.DATE_DEBUT").alias("date_debut"), _s(f"{v}.DATE_FIN").alias("date_fin"),
        _s(f"{c}.DATE_PUBLI").alias("date_publi"), _s(f"{c}.NUM_JORF").alias("num_jorf"), _s(f"{c}.NOR").alias("nor"))


GAZETTE = (f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<{_TEXT_CHRONICLE.replace(' ', ':', 1)},"
           f"{_TEXT_VERSION.replace(' ', ':', 1)}>>, VISAS array<string>, CORPS array<string>, SIGNATAIRES array<string>, "
           "TM array<string>, NOTA struct<CONTENU:string>")


def read_gazette(spark: SparkSession, path: str, row_tag: str = "TEXTE_VERSION") -> DataFrame:
    """Gazette texts: only files under `/texte/version/`; the body is the first of each section."""
    raw = read_xml(spark, path, row_tag, GAZETTE).where(F.col("_path").contains("/texte/version/"))
    c, v = "META.META_SPEC.META_TEXTE_CHRONICLE", "META.META_SPEC.META_TEXTE_VERSION"
    body = F.concat_ws(" ", *[F.get(s, F.lit(0)) for s in ("VISAS", "CORPS", "SIGNATAIRES", "TM")])
    return raw.where(F.col("META.META_COMMUN").isNotNull()).select(
        _s("META.META_COMMUN.ID").alias("jorftext"), _first(f"{c}.TITRE", f"{v}.TITRE").alias("titre"),
        _first(f"{c}.TITREFULL", f"{v}.TITREFULL").alias("titre_long"), _s("META.META_COMMUN.NATURE").alias("nature"),
        _s(f"{c}.DATE_PUBLI").alias("date_publi"), _s(f"{c}.DATE_TEXTE").alias("date_signature"),
        _s(f"{c}.NUM_JORF").alias("num_jorf"), _s(f"{c}.NOR").alias("nor"), _s(f"{v}.MINISTERE").alias("ministere"),
        strip_markup(body).alias("texte"), strip_markup("NOTA.CONTENU").alias("nota"))


# Root tag of the decision files of each fund.
DECISION_TAGS = {"jade": "TEXTE_JURI_ADMIN", "capp": "TEXTE_JURI_JUDI", "cass": "TEXTE_JURI_JUDI", "inca": "TEXTE_JURI_JUDI",
                 "constit": "TEXTE_JURI_CONSTIT"}
_JURI = "META_JURI:struct<TITRE:string,DATE_DEC:string,JURIDICTION:string,NUMERO:string,SOLUTION:string,ECLI:string,FORMATION:string,PRESIDENT:string,RAPPORTEUR:string,AVOCAT_GENERAL:string,AVOCATS:struct<AVOCAT:array<string>>>"
_JURI_JUDI = "META_JURI_JUDI:struct<NUMEROS_AFFAIRES:struct<NUMERO_AFFAIRE:array<string>>,NUMERO_AFFAIRE:array<string>,FORMATION:string,ECLI:string,PRESIDENT:string,AVOCATS:string,RAPPORTEUR:string,PUBLI_BULL:struct<_publie:string,_VALUE:string>>"
_JURI_ADMIN = "META_JURI_ADMIN:struct<FORMATION:string,ECLI:string,PRESIDENT:string,AVOCATS:string,RAPPORTEUR:string,COMMISSAIRE_GVT:string,TYPE_REC:string,PUBLI_RECUEIL:string>"
_JURI_CONSTIT = "META_JURI_CONSTIT:struct<NATURE_QUALIFIEE:string,ECLI:string,LOI_DEF:struct<_num:string,_date:string,_VALUE:string>>"
DECISION = (
    f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<{_JURI},{_JURI_JUDI},{_JURI_ADMIN},{_JURI_CONSTIT}>>, "
    "TEXTE struct<BLOC_TEXTUEL:struct<CONTENU:string>,CONTENU:string,SOMMAIRE:struct<SCT:array<string>,ANA:array<string>,CONTENU:string>,"
    "CITATION_JP:array<struct<CONTENU:string>>,RAPPROCHEMENTS:array<struct<CONTENU:string>>,SAISINES:struct<SAISINE:array<string>>>, "
    "SOMMAIRE string, LIENS struct<LIEN:array<struct<_typelien:string,_sens:string,_naturetexte:string,_num:string,_VALUE:string>>>")


def decisions(raw: DataFrame, *keep: str) -> DataFrame:
    """Decision records to the 15-column row shared by the five case-law funds; ``keep`` passes through."""
    j = "META.META_SPEC.META_JURI"
    body = strip_markup(_first("TEXTE.BLOC_TEXTUEL.CONTENU", "TEXTE.CONTENU"))
    # Without a body element the whole text block, header aside, stands in for it.
    whole = strip_markup(F.to_xml("TEXTE"))
    summary = strip_markup(F.concat_ws(" ", F.col("TEXTE.SOMMAIRE.CONTENU"), F.array_join("TEXTE.SOMMAIRE.SCT", " "),
                                       F.array_join("TEXTE.SOMMAIRE.ANA", " "), F.col("SOMMAIRE")))
    return raw.where(F.col("META.META_COMMUN").isNotNull()).select(
        *keep, _s("META.META_COMMUN.ID").alias("id"), _s(f"{j}.ECLI").alias("ecli"), _s(f"{j}.JURIDICTION").alias("juridiction"),
        _s(f"{j}.FORMATION").alias("formation"), _s(f"{j}.DATE_DEC").alias("date"), _s(f"{j}.NUMERO").alias("numero"),
        _s(f"{j}.SOLUTION").alias("solution"), _s("META.META_COMMUN.NATURE").alias("nature"),
        _s(f"{j}.PRESIDENT").alias("president"), _s(f"{j}.RAPPORTEUR").alias("rapporteur"),
        _s(f"{j}.AVOCAT_GENERAL").alias("avocat_general"),
        F.coalesce(F.array_join(F.col(f"{j}.AVOCATS.AVOCAT"), " ; "), F.lit("")).alias("avocats"), _s(f"{j}.TITRE").alias("titre"),
        summary.alias("sommaire"), F.when(body != "", body).otherwise(whole).alias("texte"))


def read_decisions(spark: SparkSession, path: str, fund: str) -> DataFrame:
    return decisions(read_xml(spark, path, DECISION_TAGS[fund], DECISION))


def _texts(array: str | Column, field: str | None = None) -> Column:
    """Plain, non-blank texts of a repeated element."""
    col = F.col(array) if isinstance(array, str) else array
    got = F.transform(col, lambda e: F.trim(F.regexp_replace(F.coalesce(e[field] if field else e, F.lit("")), r"<[^>]+>", "")))
    return F.coalesce(F.filter(got, lambda t: t != ""), F.array().cast("array<string>"))


def read_decisions_enriched(spark: SparkSession, path: str, fund: str) -> DataFrame:
    """The 25-column decision row with its semantic sections."""
    raw = read_xml(spark, path, DECISION_TAGS[fund], DECISION)
    spec = "META.META_SPEC"
    j, judi, admin, cons = (f"{spec}.META_JURI", f"{spec}.META_JURI_JUDI", f"{spec}.META_JURI_ADMIN", f"{spec}.META_JURI_CONSTIT")
    sct, ana = _texts("TEXTE.SOMMAIRE.SCT"), _texts("TEXTE.SOMMAIRE.ANA")
    cross = F.concat(_texts("TEXTE.RAPPROCHEMENTS", "CONTENU"), _texts("TEXTE.CITATION_JP", "CONTENU"))
    some = lambda *parts: F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != "")
    links = F.transform("LIENS.LIEN", lambda x: F.array_join(some(
        F.array_join(some(x["_typelien"], x["_sens"], x["_naturetexte"], x["_num"]), "|"),
        F.trim(F.coalesce(x["_VALUE"], F.lit("")))), " :: "))
    law = F.filter(some(F.col(f"{cons}.LOI_DEF._num"), F.col(f"{cons}.LOI_DEF._date"), F.trim(f"{cons}.LOI_DEF._VALUE")),
                   lambda p: p != "2999-01-01")
    number = F.coalesce(F.get(f"{judi}.NUMEROS_AFFAIRES.NUMERO_AFFAIRE", F.lit(0)), F.get(f"{judi}.NUMERO_AFFAIRE", F.lit(0)))
    return raw.where(F.col("META.META_COMMUN").isNotNull() & F.col(j).isNotNull()).select(
        _s("META.META_COMMUN.ID").alias("id"), _s("META.META_COMMUN.NATURE").alias("nature"), _s(f"{j}.TITRE").alias("titre"),
        _s(f"{j}.DATE_DEC").alias("date"), _s(f"{j}.JURIDICTION").alias("juridiction"), _s(f"{j}.SOLUTION").alias("solution"),
        _s(number).alias("numero"), _first(f"{judi}.FORMATION", f"{admin}.FORMATION").alias("formation"),
        _first(f"{judi}.ECLI", f"{admin}.ECLI", f"{cons}.ECLI").alias("ecli"),
        _first(f"{judi}.PRESIDENT", f"{admin}.PRESIDENT").alias("president"),
        _first(f"{judi}.AVOCATS", f"{admin}.AVOCATS").alias("avocats"),
        strip_markup(_first("TEXTE.BLOC_TEXTUEL.CONTENU", "TEXTE.CONTENU")).alias("text"),
        F.array_join(F.concat(sct, ana), "\n\n").alias("sommaire"), F.array_join(sct, "\n").alias("abstrats"),
        F.array_join(ana, "\n\n").alias("resume"), F.array_join(cross, "\n").alias("renvois"),
        _first(f"{admin}.RAPPORTEUR", f"{judi}.RAPPORTEUR").alias("rapporteur"), _s(f"{admin}.COMMISSAIRE_GVT").alias("commissaire_gvt"),
        _s(f"{admin}.TYPE_REC").alias("type_rec"), _s(f"{admin}.PUBLI_RECUEIL").alias("publi_recueil"),
        _first(f"{judi}.PUBLI_BULL._publie", f"{judi}.PUBLI_BULL._VALUE").alias("publi_bull"),
        _s(f"{cons}.NATURE_QUALIFIEE").alias("nature_qualifiee"),
        F.array_join(_texts("TEXTE.SAISINES.SAISINE"), "\n\n").alias("saisines"), F.array_join(law, " | ").alias("loi_def"),
        F.coalesce(F.array_join(F.filter(links, lambda t: t != ""), "\n"), F.lit("")).alias("liens_textes"))


_KALI = "struct<IDCC:string,TITRE:string,ETAT:string,DATE_PUBLI:string,DATE_DEBUT:string,DATE_FIN:string>"
AGREEMENT = (f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<META_TEXTE_KALI:{_KALI},META_CONVENTION_COLLECTIVE:{_KALI}>>, "
             "BLOC_TEXTUEL struct<CONTENU:string>, CONTENU string")


def read_agreements(spark: SparkSession, path: str, row_tag: str = "TEXTEKALI") -> DataFrame:
    """Agreement texts; containers and articles lack the text block and are dropped."""
    raw = read_xml(spark, path, row_tag, AGREEMENT)
    k = F.coalesce("META.META_SPEC.META_TEXTE_KALI", "META.META_SPEC.META_CONVENTION_COLLECTIVE")
    return raw.withColumn("_k", k).where(F.col("META.META_COMMUN").isNotNull() & F.col("_k").isNotNull()).select(
        _s("META.META_COMMUN.ID").alias("id"), _s("_k.IDCC").alias("idcc"), _s("_k.TITRE").alias("titre"),
        _s("META.META_COMMUN.NATURE").alias("nature"), _s("_k.ETAT").alias("etat"), _s("_k.DATE_PUBLI").alias("date_publi"),
        _s("_k.DATE_DEBUT").alias("date_debut"), _s("_k.DATE_FIN").alias("date_fin"),
        strip_markup(_first("BLOC_TEXTUEL.CONTENU", "CONTENU")).alias("texte"))


_CNIL = "struct<NUMERO:string,TITRE:string,DATE_DEC:string,DATE_TEXTE:string,DATE_PUBLI:string,DATE:string,FORMATION:string>"
DELIBERATION = (f"META struct<{_META.replace(' ', ':', 1)},META_SPEC:struct<META_CNIL:{_CNIL},META_TEXTE_CHRONICLE:{_CNIL},META_JURI:{_CNIL}>>, "
                "BLOC_TEXTUEL struct<CONTENU:string>, CONTENU string, TEXTE struct<CONTENU:string>")


def read_deliberations(spark: SparkSession, path: str, row_tag: str = "TEXTE_CNIL") -> DataFrame:
    """Deliberations; the date is the first filled one of four tags."""
    raw = read_xml(spark, path, row_tag, DELIBERATION)
    blocks = [f"META.META_SPEC.{b}" for b in ("META_CNIL", "META_TEXTE_CHRONICLE", "META_JURI")]
    field = lambda *tags: _first(*[f"{b}.{t}" for t in tags for b in blocks])
    return raw.where(F.col("META.META_COMMUN").isNotNull()).select(
        _s("META.META_COMMUN.ID").alias("id"), field("NUMERO").alias("numero"), field("TITRE").alias("titre"),
        field("DATE_DEC", "DATE_TEXTE", "DATE_PUBLI", "DATE").alias("date"), field("FORMATION").alias("formation"),
        strip_markup(_first("BLOC_TEXTUEL.CONTENU", "CONTENU", "TEXTE.CONTENU")).alias("texte"))
