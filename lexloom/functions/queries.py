"""Search queries as data: intent, routing and structured clauses over a query-log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.identifiers import ADMIN_DOCKET, CELEX, PLAIN_DOCKET
from lexloom.functions.text import words
from lexloom.runtime import map_lookup

# Intent shapes in order of precedence.
INTENT_PATTERNS = {
    "dce_id": r"(?i)^D(?:CE|TA|CAA)_[A-Z0-9_]+$",
    "itemid_hudoc": r"^00[0-9]-\d{4,6}$",
    "juritext": r"(?i)^(?:JURI|CONST|ARRETS)\w*$",
    "ecli": r"(?i)^ECLI:[A-Z]{2}:[A-Z]+:\d{4}:\S+$",
    "celex": CELEX,
    "pourvoi": r"^\d{2}-\d{2,3}\.?\d{2,4}$",
    "rg": r"^\d{2}/\d{5,6}$",
    "dossier_admin": ADMIN_DOCKET,
    "ariane_id": PLAIN_DOCKET,
    "phrase": r'^"\s*\S[^"]*"$',
}
# Shapes of a decision number inside a free query.
EXACT_NUMBER_PATTERNS = [r"\b(\d{4}-\d{1,4})\b", r"\b(\d{2}-\d{2,3}\.?\d{2,4})\b", r"\b(\d{2}/\d{5,6})\b"]

ATOMS = "array<struct<clause_id:int,op:string,terms:array<string>,is_phrase:boolean,is_prefix:boolean>>"


def classify_queries(df: DataFrame, col: str) -> DataFrame:
    """Add ``intent`` and the canonical ``intent_value`` of each query."""
    raw = F.trim(F.coalesce(F.col(col), F.lit("")))
    kind = F.when(raw == "", "empty")
    for name, pattern in INTENT_PATTERNS.items():
        kind = kind.when(raw.rlike(pattern), name)
    out = df.withColumn("intent", kind.otherwise("fts"))
    value = (
        F.when(F.col("intent").isin("juritext", "ecli", "celex"), F.upper(raw))
        .when(F.col("intent") == "pourvoi", F.replace(raw, F.lit("."), F.lit("")))
        .when(F.col("intent") == "phrase", F.trim(F.regexp_replace(raw, r'^"|"$', "")))
        .otherwise(raw)
    )
    return out.withColumn("intent_value", value)


def route(df: DataFrame, allowed: list[str], intent_col: str = "intent",
          capabilities: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``sources``: the allowed sources able to answer the intent, else every text-capable one."""
    caps = capabilities or dims.SOURCE_CAPABILITIES
    permitted = F.array(*[F.lit(s) for s in allowed]).cast("array<string>")
    kinds = sorted({k for kinds in caps.values() for k in kinds})
    able = F.create_map(*[x for k in kinds for x in (
        F.lit(k), F.array(*[F.lit(s) for s in allowed if k in caps.get(s, [])]).cast("array<string>"))])
    matching = F.array_intersect(permitted, F.coalesce(F.try_element_at(able, F.col(intent_col)),
                                                       F.array().cast("array<string>")))
    fallback = F.array(*[F.lit(s) for s in allowed if "fts" in caps.get(s, [])]).cast("array<string>")
    return df.withColumn("sources", F.when(F.size(matching) > 0, matching).otherwise(fallback))


def exact_number(col: Column | str) -> Column:
    """The distinctive decision number of a free query, without dots; NULL when there is none."""
    col = F.col(col) if isinstance(col, str) else col
    hits = [F.regexp_extract(col, p, 1) for p in EXACT_NUMBER_PATTERNS]
    return F.replace(F.coalesce(*[F.when(h != "", h) for h in hits]), F.lit("."), F.lit(""))


def _quoted(name: str) -> str:
    return f'"{name}"' if " " in name or "'" in name else name


def _outside_phrases(col: Column, change) -> Column:
    """Apply ``change`` to the parts of a query that are not between double quotes."""
    parts = F.regexp_extract_all(col, F.lit(r'"[^"]*"|[^"]+'), F.lit(0))
    return F.array_join(F.transform(
        parts, lambda p: F.when(p.startswith('"') & p.endswith('"') & (F.length(p) > 1), p).otherwise(change(p))), "")


def _each_match(part: Column, pattern: str, change) -> Column:
    """Replace every match of ``pattern`` by an expression of the matched text."""
    marked = F.split(F.regexp_replace(part, pattern, "\u0001$0\u0001"), "\u0001")
    return F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x)), "")


def expand_court_aliases(col: Column | str) -> Column:
    """Replace an unambiguous court acronym by an OR group of the names it has had."""
    col = F.col(col) if isinstance(col, str) else col
    groups = {
        alias: "(" + " OR ".join(_quoted(n) for n in dict.fromkeys([alias, *names])) + ")"
        for alias, names in dims.COURT_ALIASES.items()
    }
    pattern = rf"(?U)\b(?:{'|'.join(dims.COURT_ALIASES)})\b"
    return _outside_phrases(col, lambda p: _each_match(p, pattern, lambda x: map_lookup(groups, x, x)))


# Spellings of the operators.
OPERATORS = {"AND": "AND", "ET": "AND", "&": "AND", "OR": "OR", "OU": "OR", "|": "OR", "NOT": "NOT", "SAUF": "NOT", "-": "NOT"}
# What makes one word of several pieces.
CONNECTORS = r"(?:[-/:]\s*|\s+\.(?=\d)|\.)"
_TOKEN = rf'(?U)"[^"]*"\*?|(?<![^\s(])-(?=[\w"])|(?<![^\s(])-$|\w+(?:{CONNECTORS}+\w+)*\*?|[&|()]'


def query_tokens(col: Column | str, court_aliases: bool = True) -> Column:
    """A query as canonical tokens: AND, OR, NOT, brackets, words, and quoted phrases.

    A word made of pieces (`14-80854`, `C:2024:642`) is the phrase of its pieces.
    """
    col = F.col(col) if isinstance(col, str) else col
    text = F.trim(F.coalesce(col, F.lit("")))
    text = expand_court_aliases(text) if court_aliases else text

    def canonical(token: Column) -> Column:
        quoted, pieces = token.startswith('"'), F.regexp_extract_all(token, F.lit(r"(?U)\w+"), F.lit(0))
        operator = map_lookup(OPERATORS, F.upper(token))
        phrase = F.concat(F.lit('"'), F.array_join(pieces, " "), F.lit('"'), F.when(token.endswith("*"), "*").otherwise(""))
        # English operators count in capitals only; in lower case they are words.
        spelled = F.upper(token).isin(list(OPERATORS)) & ~(token.rlike("(?i)^(?:and|or|not)$") & (F.upper(token) != token))
        return F.when(quoted, token).when(spelled, operator).when(F.size(pieces) > 1, phrase).otherwise(token)

    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), canonical)


def normalize_query(col: Column | str, court_aliases: bool = True) -> Column:
    """The canonical tokens of a query as one text."""
    joined = F.array_join(query_tokens(col, court_aliases), " ")
    return F.regexp_replace(F.regexp_replace(joined, r"\( ", "("), r" \)", ")")


def query_atoms(normalized: Column) -> Column:
    """Canonical query text to an array of atoms.

    Atoms joined by OR share a ``clause_id``; all clauses must hold; ``op`` is `must` or `not`.
    Punctuation carries no meaning, so any text is a valid query.
    """
    tokens = F.regexp_extract_all(normalized, F.lit(r'"[^"]*"\*?|[\p{L}\p{N}_]+\*?'), F.lit(0))
    none = F.array().cast(ATOMS)
    start = F.struct(F.lit(0).alias("clause"), F.lit(False).alias("joined"), F.lit(False).alias("negated"),
                     F.lit(False).alias("last_negated"), none.alias("atoms"))

    def step(acc: Column, token: Column) -> Column:
        terms = words(token)
        negated = acc["negated"] | (acc["joined"] & acc["last_negated"])
        clause = F.when(acc["joined"] & (acc["clause"] > 0), acc["clause"]).otherwise(acc["clause"] + 1)
        atom = F.struct(clause.alias("clause_id"), F.when(negated, "not").otherwise("must").alias("op"),
                        terms.alias("terms"), (F.size(terms) > 1).alias("is_phrase"),
                        token.endswith("*").alias("is_prefix"))
        pushed = F.array_append(acc["atoms"], atom).cast(ATOMS)
        operator, empty = token.isin("AND", "OR", "NOT"), F.size(terms) == 0
        return F.struct(
            F.when(operator | empty, acc["clause"]).otherwise(clause).alias("clause"),
            F.when(operator, token == "OR").when(empty, acc["joined"]).otherwise(F.lit(False)).alias("joined"),
            F.when(operator, (token == "NOT")).when(empty, acc["negated"]).otherwise(F.lit(False)).alias("negated"),
            F.when(operator | empty, acc["last_negated"]).otherwise(negated).alias("last_negated"),
            F.when(operator | empty, acc["atoms"]).otherwise(pushed).alias("atoms"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["atoms"])


def queries_to_clauses(df: DataFrame, id_col: str, col: str, court_aliases: bool = True) -> DataFrame:
    """One row per atom: ``query_id, atom_id, clause_id, op, terms, is_phrase, is_prefix``."""
    atoms = query_atoms(normalize_query(col, court_aliases))
    return df.select(F.col(id_col).alias("query_id"), F.posexplode(atoms).alias("atom_id", "_a")).select(
        "query_id", "atom_id", "_a.*")


def clause_rows(df: DataFrame) -> DataFrame:
    """Searches given as rows ``query_id, clause_id, op, terms, is_prefix`` in the form of :func:`queries_to_clauses`.

    Rows that share a clause are alternatives and all clauses of op `must` have to hold; op `not`
    excludes. ``terms`` is an array of words: several are a phrase, and of a prefix row the last
    one is a beginning. Words are folded like those of an index. A row with a null word matches
    nothing; a row without words is left out; repeated rows count as often as they stand.
    """
    null = F.array(F.lit(None).cast("string"))
    folded = F.flatten(F.transform("terms", lambda t: F.when(t.isNull(), null).otherwise(words(t))))
    rows = df.select("query_id", F.col("clause_id").cast("int").alias("clause_id"), "op", folded.alias("terms"),
                     F.coalesce("is_prefix", F.lit(False)).alias("is_prefix")).where(F.size("terms") > 0)
    place = Window.partitionBy("query_id").orderBy("clause_id", "op", "terms", "is_prefix")
    return rows.select("query_id", (F.row_number().over(place) - 1).alias("atom_id"), "clause_id", "op", "terms",
                       (F.size("terms") > 1).alias("is_phrase"), "is_prefix")


def split_constitutional_ref(col: Column | str) -> Column:
    """`2008-562 DC` to ``struct<number, nature>``; NULL for any other text."""
    col = F.col(col) if isinstance(col, str) else col
    natures = "|".join(dims.CONSTITUTIONAL_NATURES)
    shape = rf'(?i)^\s*"?(\d{{4}})[\s-]+(\d{{1,4}})"?\s+({natures})"?\s*$'
    year, serial, nature = [F.regexp_extract(F.regexp_replace(F.trim(col), r'^"|"$', ""), shape, i) for i in (1, 2, 3)]
    return F.when(nature != "", F.struct(F.concat_ws("-", year, serial).alias("number"),
                                         F.upper(nature).alias("nature")))
