"""HTML pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import decode_entities, strip_markup


def html_to_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``title`` and plain ``text`` of a page; the title is not part of the text."""
    title = F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(html_col, r"(?is)<title[^>]*>.*?</title>", " ")
    return df.withColumn("title", strip_markup(title)).withColumn("text", strip_markup(body))


def joined_lines(col: Column) -> Column:
    """Markup to its text lines joined by ` | `."""
    out = F.regexp_replace(col, r"(?i)<br\s*/?>|</?p[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", ""))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " | ")


# Marks of the contact cards on a listing page.
CONTACT_CARD = r'(?s)<div class="views-row">(.*?)</article>'
CARD_NAME = r'(?s)<h2 class="title">\s*<span>(.*?)</span>'
CARD_OFFICER = r"(?s)field-name-pr-nom-prada.*?field-item[^>]*>(.*?)</div>"
CARD_ADDRESS = r"(?s)field-name-field-adresse-complete.*?<div><p>(.*?)</p>"
CARD_MAIL = r'mailto:([^"\']*)"'


def parse_contact_pages(df: DataFrame, html_col: str = "html", *keep: str, card: str = CONTACT_CARD, name: str = CARD_NAME,
                        officer: str = CARD_OFFICER, address: str = CARD_ADDRESS, mail: str = CARD_MAIL) -> DataFrame:
    """One row per contact card: ``card_no, organisme, prada, adresse, courriels``."""
    cards = F.regexp_extract_all(F.col(html_col), F.lit(card), F.lit(1))
    rows = df.select(*keep, F.posexplode_outer(cards).alias("card_no", "_card")).where(F.col("_card").isNotNull())
    part = lambda p: joined_lines(F.regexp_extract("_card", p, 1))
    mails = F.filter(F.regexp_extract_all(F.col("_card"), F.lit(mail), F.lit(1)), lambda m: m != "")
    return rows.select(*keep, "card_no", part(name).alias("organisme"), part(officer).alias("prada"),
                       part(address).alias("adresse"), F.array_distinct(mails).alias("courriels"))
