"""Identifiers: dockets, appeal and roll numbers, EU case numbers, URLs and families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.runtime import blank_to_null, map_lookup

# Identifier shapes.
ADMIN_DOCKET = r"^(?i)(?:2\d{6}|\d{2}[A-Z]{2}\d{4,6})$"
PLAIN_DOCKET = r"^\d{5,7}$"
CELEX = r"^6\d{4}[A-Z]{2}\d{4}$"
CELEX_PARTS = r"^6(\d{4})([A-Z]{2})(\d{4})"
CASE_NUMBER = r"^([CT])-(\d{1,4})/(\d{2})$"
APPLICATION_NUMBERS = [
    r"(?iu)Requ[êe]tes?\s+n\s*[o°ºs]+\s*(\d{1,6}/\d{2,4})",
    r"(?iu)appn?o\s*[:=]?\s*(\d{1,6}/\d{2,4})",
    r"(?iu)Application\s+n\s*[o°]\s*(\d{1,6}/\d{2,4})",
]
ROLL_NUMBERS = [
    r"(?iu)N[°o]\s*R\.?G\.?\s*:?\s*(\d{2,4})[/\-\s]+(\d{4,7})",
    r"(?iu)R[.\s]?G[.\s]?\s*n[°o]?\s*:?\s*(\d{2,4})[/\-\s]+(\d{4,7})",
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_docket(col: Column | str) -> Column:
    """Docket without the `n°` prefix and without spaces."""
    return F.replace(F.regexp_replace(F.trim(_c(col)), r"^[n°oN \t]+", ""), F.lit(" "), F.lit(""))


def admin_docket(col: Column | str) -> Column:
    """The cleaned docket when it has the shape of an administrative one, else NULL."""
    number = clean_docket(col)
    return F.when(number.rlike(ADMIN_DOCKET) | number.rlike(PLAIN_DOCKET), number)


def is_admin_docket(col: Column | str) -> Column:
    return admin_docket(col).isNotNull()


def appeal_variants(col: Column | str) -> Column:
    """Both spellings of an appeal number: `19-14001` and `19-14.001`."""
    plain = F.replace(_c(col), F.lit("."), F.lit(""))
    dotted = F.regexp_replace(plain, r"^(\d{2})-(\d{1,3})(\d{3})$", "$1-$2.$3")
    return F.array_distinct(F.array(plain, dotted))


def norm_rg(col: Column | str) -> Column:
    """Roll number as `yy/nnnnn`; accepts `/`, `-`, a space or nothing as separator."""
    text = F.trim(_c(col))
    split = F.regexp_replace(text, r"^(\d{2,4})[/\-\s](\d{4,7})$", "$1/$2")
    return F.regexp_replace(split, r"^(\d{2})(\d{4,6})$", "$1/$2")


def rg_digits(col: Column | str) -> Column:
    """Digits-only roll number: equal for every accepted spelling."""
    return F.regexp_replace(norm_rg(col), r"[^0-9]", "")


def rg_key(col: Column | str) -> Column:
    """The three searchable spellings `a/b a-b ab`, or an empty text."""
    a, b = F.regexp_extract(_c(col), r"^([^/]*)/(.*)$", 1), F.regexp_extract(_c(col), r"^([^/]*)/(.*)$", 2)
    return F.when(_c(col).contains("/"),
                  F.concat_ws(" ", F.concat_ws("/", a, b), F.concat_ws("-", a, b), F.concat(a, b))
                  ).otherwise(F.lit(""))


def extract_rg(col: Column | str) -> Column:
    """First roll number announced in a text, as `a/b`."""
    def hit(pattern: str) -> Column:
        year = F.regexp_extract(_c(col), pattern, 1)
        return F.when(year != "", F.concat_ws("/", year, F.regexp_extract(_c(col), pattern, 2)))
    return F.coalesce(*[hit(p) for p in ROLL_NUMBERS])


def extract_appno(col: Column | str) -> Column:
    """Application number announced first in the text of a decision; later ones refer to other cases."""
    found = F.array(*[F.struct(F.regexp_instr(_c(col), F.lit(p)).alias("at"), F.regexp_extract(_c(col), p, 1).alias("number"))
                      for p in APPLICATION_NUMBERS])
    # The leftmost announcement counts, in whatever wording.
    return F.get(F.array_sort(F.filter(found, lambda f: (f["at"] > 0) & (F.trim(f["number"]) != ""))), F.lit(0))["number"]


def appno_from_ecli(col: Column | str) -> Column:
    """Application number spelled in the tail of the court's ECLI (`…JUD000414302` -> `4143/02`)."""
    tail = r"(?i)(\d{7})(\d{2})$"
    number = F.regexp_replace(F.regexp_extract(_c(col), tail, 1), r"^0+(?=\d)", "")
    is_court = F.upper(_c(col)).startswith("ECLI:CE:ECHR:")
    return F.when(is_court & _c(col).rlike(tail), F.concat_ws("/", number, F.regexp_extract(_c(col), tail, 2)))


def appno_key(col: Column | str) -> Column:
    """`a/b a-b ab` spellings of an application number."""
    a, b = F.regexp_extract(_c(col), r"^([^/]*)/(.*)$", 1), F.regexp_extract(_c(col), r"^([^/]*)/(.*)$", 2)
    return F.when(_c(col).contains("/"), F.concat_ws(" ", _c(col), F.concat_ws("-", a, b), F.concat(a, b))
                  ).otherwise(F.lit(""))


def celex_to_case(col: Column | str) -> Column:
    """`62021CJ0395` -> `C-395/21`."""
    year, kind, number = [F.regexp_extract(_c(col), CELEX_PARTS, i) for i in (1, 2, 3)]
    letter = map_lookup(dims.CELEX_CASE_LETTERS, kind, F.substring(kind, 1, 1))
    serial = number.try_cast("int").cast("string")
    return F.when(_c(col).rlike(CELEX_PARTS),
                  F.concat(letter, F.lit("-"), serial, F.lit("/"), F.substring(year, 3, 2)))


def case_to_celex(col: Column | str) -> Column:
    """`C-395/21` -> `62021CJ0395`; two-digit years above 50 belong to the 1900s."""
    letter, number, yy = [F.regexp_extract(_c(col), CASE_NUMBER, i) for i in (1, 2, 3)]
    century = F.when(yy.try_cast("int") > 50, "19").otherwise("20")
    kind = F.when(letter == "C", "CJ").otherwise("TJ")
    return F.when(_c(col).rlike(CASE_NUMBER), F.concat(F.lit("6"), century, yy, kind, F.lpad(number, 4, "0")))


def celex_to_ecli(col: Column | str) -> Column:
    """`62021CJ0395` -> `ECLI:EU:C:2021:395`; NULL where no court letter is known."""
    year, kind, number = [F.regexp_extract(_c(col), CELEX_PARTS, i) for i in (1, 2, 3)]
    letter = map_lookup(dims.CELEX_ECLI_LETTERS, kind)
    serial = number.try_cast("int").cast("string")
    return F.when(_c(col).rlike(CELEX) & letter.isNotNull(),
                  F.concat(F.lit("ECLI:EU:"), letter, F.lit(":"), year, F.lit(":"), serial))


def case_key(col: Column | str) -> Column:
    """The four searchable spellings of `C-395/21`."""
    shape = r"^([A-Z])-(\d+)/(\d+)$"
    letter, number, year = [F.regexp_extract(_c(col), shape, i) for i in (1, 2, 3)]
    variants = F.concat_ws(" ", _c(col), F.concat_ws("-", letter, number, year),
                           F.concat(letter, number, year), letter, number, year)
    return F.when(_c(col).rlike(shape), variants).otherwise(F.coalesce(_c(col), F.lit("")))


def _url_quote(col: Column) -> Column:
    out = F.url_encode(col)
    for encoded, plain in {"+": "%20", "%2F": "/", "%7E": "~", "*": "%2A"}.items():
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


_STATE, _EUR_LEX, _HUDOC = "https://www.legifrance.gouv.fr", "https://eur-lex.europa.eu/legal-content/FR/TXT/?uri=", "https://hudoc.echr.coe.int/fre?i="
# Shapes of identifiers, the family of each, and the address it stands behind ({day}: a date may follow). The first shape that fits counts.
ID_FORMS = [
    (r"^CONSTEXT", "constitutional", f"{_STATE}/juri/id/"),
    (r"^JURITEXT", "judicial", f"{_STATE}/juri/id/"),
    (r"^JURI", "judicial", None),
    (r"^[0-9a-f]{24}$", "judicial", "https://www.courdecassation.fr/decision/"),
    (r"^(?:DCE|DTA|DCAA|DCA)_", "admin_open_data", "https://opendata.justice-administrative.fr/recherche/decision/"),
    (r"^(?:ORTA|ORCA|ORCE)_", "admin_open_data", None),
    (r"^CETATEXT", "admin_bulk", f"{_STATE}/ceta/id/"),
    (r"^/Ariane_Web/", "council_of_state", "https://www.conseil-etat.fr/arianeweb/#/view-document/"),
    (r"^\|\d+$", "council_of_state", None),
    (r"^\d{3}-\d+$", "human_rights", _HUDOC),
    (CELEX, "eu_court", f"{_EUR_LEX}CELEX:"),
    (r"(?i)^ECLI:EU:", "eu_court", f"{_EUR_LEX}ecli:"),
    (r"(?i)^ECLI:CE:ECHR", None, _HUDOC),
    (r"(?i)^ECLI:FR:", None, None),
    (r"(?i)^ECLI:", None, f"{_EUR_LEX}ecli:"),
    (r"^LEGIARTI", "statute_article", f"{_STATE}/codes/article_lc/{{day}}"),
    (r"^LEGITEXT", "statute_text", f"{_STATE}/codes/texte_lc/{{day}}"),
    (r"^JORFTEXT", "statute_text", f"{_STATE}/loda/id/{{day}}"),
]


def _of_form(ident: Column, values: list[str | None]) -> Column:
    """The value that belongs to the first shape the identifier fits."""
    form = F.coalesce(*[F.when(ident.rlike(pattern), i) for i, (pattern, _, _) in enumerate(ID_FORMS)])
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), form)


def source_url(identifier: Column | str, legitext: Column | None = None, at_date: Column | None = None) -> Column:
    """Public address of a document, by the form of its identifier; NULL where no form has one.

    Statutes take a day; an article whose text ``legitext`` is a gazette text stands with these.
    """
    ident = F.trim(_c(identifier))
    address = _of_form(ident, [url for _, _, url in ID_FORMS])
    if legitext is not None:
        in_gazette = ident.startswith("LEGIARTI") & F.coalesce(legitext, F.lit("")).startswith("JORFTEXT")
        address = F.when(in_gazette, F.replace(address, F.lit("/codes/"), F.lit("/loda/"))).otherwise(address)
    day = F.regexp_extract(F.coalesce(at_date.cast("string"), F.lit("")), r"^\d{4}-\d{2}-\d{2}$", 0) if at_date is not None else F.lit("")
    dated = F.when(address.endswith("{day}") & (day != ""), F.concat(F.lit("/"), day)).otherwise("")
    return F.concat(F.replace(address, F.lit("{day}"), F.lit("")), F.when(ident.startswith("/"), _url_quote(ident)).otherwise(ident), dated)


def id_family(identifier: Column | str) -> Column:
    """Family that an identifier belongs to, NULL when unknown."""
    return _of_form(F.trim(_c(identifier)), [family for _, family, _ in ID_FORMS])


def publication_label(collection: Column | str, bulletin: Column | str) -> Column:
    """Name of the official collection a decision appears in."""
    code = blank_to_null(_c(collection))
    return (
        F.when(code.isNotNull(), map_lookup(dims.PUBLICATION_LABELS, code, code))
        .when(_c(bulletin) == "oui", "Bulletin Cass.")
    )


def lang_flag(text_lang: Column | str) -> Column:
    """True when the available text is not French."""
    return F.coalesce(blank_to_null(F.lower(_c(text_lang))), F.lit("fr")) != "fr"
