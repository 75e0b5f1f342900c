"""Cleaning, scrubbing and scalar text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Typographic signs and what they become, bullet signs.
PUNCTUATION = ("—–’‘“”�•", "--''\"\"- ")
BULLETS = "[•▪●◦⁃*]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# Scrub patterns in the order of their use, with the replacement of each match.
SCRUB = (
    ("email", r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"(?U)\b(?:\d[ -]?){13,16}\d\b"),
    ("url", r"(?i)https?://\S+"),
    ("phone", r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"),
)
# Month names by their first three letters.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def clean_punct(text: Column) -> Column:
    return F.translate(text, *PUNCTUATION)


def clean_bullets(text: Column) -> Column:
    return F.regexp_replace(text, BULLETS, " ")


def dehyphenate(text: Column) -> Column:
    """Joins a word cut at a line end if it goes on in lower case."""
    return F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*([a-z])", "$1$2")


def lines(text: Column) -> Column:
    """The lines of a text; null for null, and none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, LINE_BREAK, -1))


def collapse_ws(text: Column) -> Column:
    """Runs of spaces and tabs become one space, lines are stripped, empty ones dropped."""
    stripped = F.transform(lines(F.regexp_replace(text, r"[ \t]+", " ")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda x: x != ""), "\n")


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII; ASCII texts give the same."""
    return F.pandas_udf(_fold, "string")(text)


def clean_document(text: Column, fold: bool = True) -> Column:
    """Punctuation, hyphens, bullets, white space, then the fold."""
    out = collapse_ws(clean_bullets(dehyphenate(clean_punct(text))))
    return ascii_fold(out) if fold else out


def clean_block(text: Column, fold: bool = True) -> Column:
    """As :func:`clean_document` without joining hyphenated words, which only joined blocks may have."""
    out = collapse_ws(clean_bullets(clean_punct(text)))
    return ascii_fold(out) if fold else out


def scrub(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``scrubbed`` and a count per type: each pattern runs on what the one before left.

    Addresses, numbers and links get a stand-in made from a digest of the match, so equal
    values stay equal; a null text stays null with counts of 0. Each step is a column of its
    own, so no pattern runs twice on a text.
    """
    digest = lambda x, n: F.substring(F.sha1(x), 1, n)
    instead = {
        "email": lambda x: F.concat(F.lit("user_"), digest(x, 6), F.lit("@example.com")),
        "ssn": lambda x: F.lit("redacted_ssn"),
        "credit_card": lambda x: F.lit("redacted_cc"),
        "url": lambda x: F.concat(F.lit("https://example.com/page_"), digest(x, 6)),
        "phone": lambda x: F.concat(F.lit("+1-555-"), digest(x, 3), F.lit("-0000")),
    }
    df = df.withColumn("scrubbed", F.col(text))
    for kind, pattern in SCRUB:
        df = df.withColumn("_found", F.regexp_extract_all("scrubbed", F.lit(pattern), F.lit(0))).withColumn("_rest", F.split("scrubbed", pattern, -1))
        merged = F.array_join(F.zip_with("_rest", F.transform("_found", instead[kind]), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
        df = df.withColumns({"scrubbed": merged, kind: F.when(F.col("_found").isNull(), 0).otherwise(F.size("_found"))})
    return df.drop("_found", "_rest")


def content_hash(key: Column) -> Column:
    """Digest of the id (not of the content)."""
    return F.sha2(key, 256)


def month_date(text: Column) -> Column:
    """First of the month of ``Jul 2017``, first of January of ``2017`` or of an unknown month, else null."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    month = F.regexp_extract(text, r"^([A-Za-z]{3,9})\.?\s+(\d{4})", 1)
    year = F.regexp_extract(text, r"^([A-Za-z]{3,9})\.?\s+(\d{4})", 2)
    number = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.initcap(F.substring(month, 1, 3)))
    number = F.when(number > 0, number).otherwise(1)
    bare = F.regexp_extract(text, r"^(\d{4})", 1)
    return F.when(year != "", F.make_date(year.cast("int"), number.cast("int"), F.lit(1))).when(bare != "", F.make_date(bare.cast("int"), F.lit(1), F.lit(1)))


def block_kind(text: Column, style: Column) -> Column:
    """Kind of a block from its style, else from its text."""
    s = F.lower(F.coalesce(style, F.lit("")))
    styled = (
        F.when(s.contains("title"), "title").when(s.contains("heading 1") | (s == "heading1"), "heading").when(s.contains("heading"), "subheading").when(s.contains("list"), "bullet")
    )
    bare = F.when(F.startswith(F.lower(F.ltrim(F.coalesce(text, F.lit("")))), F.lit("project:")), "subheading").otherwise("normal")
    return F.coalesce(styled, bare)
