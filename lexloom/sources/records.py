"""Readers for JSON and delimited feeds, and projections of their records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.identifiers import celex_to_ecli, rg_key
from lexloom.functions.text import strip_markup_keep_paras
from lexloom.operators.joins import location_name
from lexloom.runtime import blank_to_null, map_lookup, stage


def _s(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.trim(col), F.lit(""))


def read_directory_csv(spark: SparkSession, path: str, schema: str, mails_col: str = "mails") -> DataFrame:
    """`;`-delimited contact file with header; the address list becomes an array."""
    df = spark.read.schema(schema).csv(path, sep=";", header=True, multiLine=True, escape='"', enforceSchema=False)
    if mails_col in df.columns:
        parts = F.transform(F.split(F.coalesce(mails_col, F.lit("")), ";"), lambda x: F.trim(x))
        df = df.withColumn(mails_col, F.filter(parts, lambda m: m != ""))
    return df


SERVICE = ("service array<struct<id:string,nom:string,pivot:array<struct<type_service_local:string>>,adresse_courriel:array<string>,"
           "telephone:array<struct<valeur:string>>,site_internet:array<struct<valeur:string>>>>")


def read_services_json(spark: SparkSession, path: str) -> DataFrame:
    """Local-service dump: services whose first known pivot belongs to the justice system."""
    services = spark.read.schema(SERVICE).json(path, multiLine=True).select(F.inline("service"))
    known = F.filter(F.transform("pivot", lambda p: p["type_service_local"]), lambda t: t.isin(dims.JUSTICE_PIVOTS))
    values = lambda c: F.filter(F.transform(c, lambda v: F.trim(F.coalesce(v["valeur"], F.lit("")))), lambda v: v != "")
    return services.withColumn("type", F.get(known, F.lit(0))).where(F.col("type").isNotNull()).select(
        "type", _s("nom").alias("nom"),
        F.coalesce(F.filter(F.transform("adresse_courriel", lambda x: F.trim(x)), lambda m: m != ""), F.array().cast("array<string>")).alias("mails"),
        F.coalesce(F.array_join(values("telephone"), ";"), F.lit("")).alias("tel"),
        F.coalesce(F.get(values("site_internet"), F.lit(0)), F.lit("")).alias("site"), _s("id").alias("id"))


# Key order when an object of the contact API is reduced to one text.
_GENERIC_KEYS = ["valeur", "value", "libelle", "nom", "adresse_courriel"]
_ADDRESS_KEYS = ["numero_voie", "code_postal", "nom_commune", "complement1"]


def flatten_value(col: str | Column, separator: str = " ; ") -> Column:
    """A field that is text, a JSON list or a JSON object (possibly as text) to one readable line."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.trim(col)
    structured = text.rlike(r"^[\[{]")
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    items = F.from_json(F.when(structured, listed), "array<string>")
    field = lambda item, key: blank_to_null(F.trim(F.get_json_object(item, f"$.{key}")))

    def one(item: Column) -> Column:
        is_address = F.coalesce(*[F.when(F.get_json_object(item, f"$.{k}").isNotNull(), True) for k in _ADDRESS_KEYS], F.lit(False))
        town = blank_to_null(F.concat_ws(" ", field(item, "code_postal"), field(item, "nom_commune")))
        address = F.concat_ws(", ", *[field(item, k) for k in ("complement1", "complement2", "numero_voie", "service_distribution")], town)
        generic = F.coalesce(*[field(item, k) for k in _GENERIC_KEYS], F.lit(""))
        return F.when(~item.startswith("{"), F.trim(item)).when(is_address, address).otherwise(generic)

    joined = F.array_join(F.filter(F.transform(items, one), lambda p: p != ""), separator)
    return F.when(structured, F.coalesce(joined, col)).otherwise(F.coalesce(col, F.lit("")))


def pivot_kind(col: str | Column) -> Column:
    """Kind of local service: `chapeau` for a free-standing entry, `autre` when it cannot be read."""
    col = F.col(col) if isinstance(col, str) else col
    kind = blank_to_null(F.get_json_object(col, "$[0].type_service_local"))
    return F.when(F.trim(F.coalesce(col, F.lit(""))).isin("", "[]", "null"), "chapeau").otherwise(F.coalesce(kind, F.lit("autre")))


def flatten_api_contacts(df: DataFrame) -> DataFrame:
    """Contact-API records (every field read as text) to flat rows; entries without address drop out."""
    addresses = F.from_json("adresse_courriel", "array<string>")
    single = F.when(blank_to_null("adresse_courriel").isNotNull(), F.array(F.trim("adresse_courriel")))
    mails = F.filter(F.when(F.trim("adresse_courriel").startswith("["), addresses).otherwise(single),
                     lambda m: F.coalesce(m, F.lit("")) != "")
    return df.withColumn("mails", mails).where(F.size("mails") > 0).select(
        _s("id").alias("id"), _s("nom").alias("nom"), _s("sigle").alias("sigle"), "mails",
        flatten_value("telephone").alias("telephone"), flatten_value("site_internet").alias("site_internet"),
        _s("type_organisme").alias("type_organisme"), flatten_value("hierarchie", " > ").alias("hierarchie"),
        flatten_value("adresse", " | ").alias("adresse"), pivot_kind("pivot").alias("pivot_kind"))


# Fields of a contact record.
API_CONTACT = ["id", "nom", "sigle", "adresse_courriel", "telephone", "site_internet", "type_organisme", "hierarchie", "adresse", "pivot"]


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as one VARIANT column ``v``: no schema, so a field may be text here and an object there."""
    return spark.read.format("json").option("singleVariantColumn", "v").load(path)


def read_api_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contact records whose fields are a text, a list, an object, or one of them written as text, to flat rows.

    Objects and lists of a VARIANT turn into JSON text, which is what their written form is already;
    fields that a record lacks are null.
    """
    fields = [F.try_variant_get("v", f"$.{name}", "string").alias(name) for name in API_CONTACT]
    return flatten_api_contacts(read_variants(spark, path).select(*fields))


HIT = ("_source struct<Identification:string,Numero_ECLI:string,Code_Juridiction:string,Nom_Juridiction:string,"
       "Formation_Jugement:string,Numero_Dossier:string,Type_Decision:string,Date_Lecture:string,Code_Publication:string,"
       "lastModified:string,paragraph:string>")


def read_admin_hits(spark: SparkSession, path: str) -> DataFrame:
    return admin_hits(spark.read.schema(HIT).json(path))


def admin_hits(df: DataFrame) -> DataFrame:
    """Search hits of the administrative open data to decision rows."""
    v = lambda name: F.when(F.col(f"_source.{name}") != "undefined", F.col(f"_source.{name}"))
    paragraphs = F.filter(F.split(v("paragraph"), r"\$\$\$"), lambda p: F.trim(p) != "")
    return df.select(
        F.regexp_replace(v("Identification"), r"\.xml$", "").alias("id"), v("Code_Juridiction").alias("juridiction_code"),
        v("Nom_Juridiction").alias("juridiction_name"),
        F.coalesce(blank_to_null(v("Date_Lecture")), F.substring(v("lastModified"), 1, 10)).alias("date"),
        v("Numero_Dossier").alias("numero_dossier"), v("Numero_ECLI").alias("ecli"), v("Formation_Jugement").alias("formation"),
        v("Type_Decision").alias("type_decision"), v("Code_Publication").alias("publication_code"),
        v("lastModified").alias("last_modified"),
        F.array_join(F.transform(paragraphs, lambda x: F.trim(x)), "\n\n").alias("texte"))


COURT_DECISION = ("id string, type string, jurisdiction string, location string, number string, numbers array<string>, decision_date string, "
                  "solution string, chamber string, formation string, ecli string, president string, text string, text_html string, "
                  "summary string, themes array<string>, resume string, rapprochements array<string>, rapporteur string, publication array<string>, nature string")


def read_court_api(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of the court API, for :func:`map_court_api`; a list field may be one text, or a list written as text."""
    def field(name: str, kind: str) -> Column:
        if not kind.startswith("array"):
            return F.try_variant_get("v", f"$.{name}", kind).alias(name)
        text = F.try_variant_get("v", f"$.{name}", "string")
        written = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
        listed = F.coalesce(F.try_variant_get("v", f"$.{name}", "array<string>"), written, F.when(text != "", F.array(text)))
        return listed.alias(name)

    kinds = [x.strip().split(" ", 1) for x in COURT_DECISION.split(",")]
    return read_variants(spark, path).select(*[field(name, kind) for name, kind in kinds])


def map_court_api(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Decisions of the court API to enriched decision rows.

    Text prefers the marked-up form; the court name comes from the location taxonomy or a readable fallback.
    """
    named = location_name(df, locations)
    numero = F.coalesce(blank_to_null("number"), F.get("numbers", F.lit(0)), F.lit(""))
    # Rich text may itself hold markup; it keeps its paragraphs.
    text = F.coalesce(blank_to_null(strip_markup_keep_paras("text_html")), F.col("text"), F.lit(""))
    day = F.coalesce("decision_date", F.lit(""))
    blank = F.lit("")
    return named.select(
        "id", _s("type").alias("nature"), F.concat(F.col("juridiction"), F.lit(", "), day, F.lit(", n° "), numero).alias("titre"),
        day.alias("date"), "juridiction", _s("solution").alias("solution"), numero.alias("numero"),
        F.coalesce(blank_to_null("chamber"), blank_to_null("formation"), blank).alias("formation"), _s("ecli").alias("ecli"),
        _s("president").alias("president"), blank.alias("avocats"), text.alias("text"), _s("summary").alias("sommaire"),
        F.coalesce(F.to_json("themes"), F.lit("[]")).alias("abstrats"), _s("resume").alias("resume"),
        F.coalesce(F.to_json("rapprochements"), F.lit("[]")).alias("renvois"), _s("rapporteur").alias("rapporteur"),
        blank.alias("commissaire_gvt"), _s("type").alias("type_rec"), blank.alias("publi_recueil"),
        F.when(F.size("publication") > 0, "oui").otherwise("").alias("publi_bull"), _s("nature").alias("nature_qualifiee"),
        blank.alias("saisines"), blank.alias("loi_def"), blank.alias("liens_textes"), rg_key(numero).alias("numero_rg_norm"))


COURT_META = "summary string, themes array<string>, visa array<string>, rapprochements array<string>, zones map<string,string>"


def read_court_export(spark: SparkSession, path: str) -> DataFrame:
    """Bulk export of the court API to base decision rows; rows without id drop out."""
    df = spark.read.schema("results array<struct<" + COURT_DECISION.replace(" ", ":").replace(",:", ",") + ">>").json(path)
    rows = df.select(F.inline("results")).where(blank_to_null("id").isNotNull())
    return rows.select(
        "id", _s("type").alias("nature"), F.coalesce(F.get("themes", F.lit(0)), F.lit("")).alias("titre"),
        _s("decision_date").alias("date"), map_lookup(dims.API_COURTS, F.col("jurisdiction"), _s("jurisdiction")).alias("juridiction"),
        _s("solution").alias("solution"), _s("number").alias("numero"), _s("chamber").alias("formation"), _s("ecli").alias("ecli"),
        _s("president").alias("president"), F.lit("").alias("avocats"), _s("text").alias("text"))


ECHR_LISTING = ("results array<struct<columns:struct<itemid:string,docname:string,ecli:string,kpdate:string,doctype:string,article:string,"
                "conclusion:string,importance:string,respondent:string,originatingbody:string>>>")


def read_echr_listing(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ECHR_LISTING).json(path, multiLine=True).select(F.inline("results")).select("columns.*")
    return rows.where(blank_to_null("itemid").isNotNull()).select(
        "itemid", "docname", "ecli", F.substring("kpdate", 1, 10).alias("date"), "doctype", "article", "conclusion", "importance",
        "respondent", F.col("originatingbody").alias("originating_body"))


CJEU_BINDINGS = "results struct<bindings:array<struct<celex:struct<value:string>,ecli:struct<value:string>,date:struct<value:string>,type:struct<value:string>,title:struct<value:string>>>>"


def read_cjeu_bindings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CJEU_BINDINGS).json(path, multiLine=True).select(F.inline("results.bindings"))
    celex = F.col("celex.value")
    return rows.where(blank_to_null(celex).isNotNull()).select(
        celex.alias("celex"), F.coalesce(blank_to_null("ecli.value"), celex_to_ecli(celex)).alias("ecli"),
        F.substring("date.value", 1, 10).alias("date"), F.substring_index("type.value", "/", -1).alias("type"), F.col("title.value").alias("title"))


def flatten_toc(df: DataFrame, toc_col: str = "toc") -> DataFrame:
    """Articles of a statute's table of contents (JSON text with nested ``sections`` and ``articles``).

    One level is unfolded per step until none is left; each level is written to the shared folder.
    """
    keep = [c for c in df.columns if c != toc_col]
    level = stage(df.select(*keep, F.col(toc_col).alias("_node"), F.array().cast("array<string>").alias("path")), "toc")
    found = []
    while not found or not level.isEmpty():
        articles = F.from_json(F.get_json_object("_node", "$.articles"), "array<struct<id:string,num:string,etat:string,title:string>>")
        found.append(level.select(*keep, "path", F.inline(articles)))
        sections = F.from_json(F.get_json_object("_node", "$.sections"), "array<string>")
        level = stage(level.select(*keep, "path", F.explode(sections).alias("_node")).withColumn(
            "path", F.array_append("path", F.coalesce(F.get_json_object("_node", "$.title"), F.lit("")))).select(*keep, "_node", "path"), "toc")
    return reduce(DataFrame.unionByName, found)


def read_patch_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated patch without quoting; escapes and the visible line mark are decoded."""
    df = spark.read.schema(schema).csv(path, sep="\t", quote="", escape="")
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            df = df.withColumn(f.name, decode_escapes(F.col(f.name)))
    return df


def decode_escapes(col: Column) -> Column:
    """`\\n`, `\\t`, `\\\\` and ` ⏎ ` in a patch field."""
    out = F.replace(col, F.lit("\\\\"), F.lit("\u0001"))
    for mark, ch in {"\\n": "\n", "\\t": "\t", " ⏎ ": "\n"}.items():
        out = F.replace(out, F.lit(mark), F.lit(ch))
    return F.replace(out, F.lit("\u0001"), F.lit("\\"))
