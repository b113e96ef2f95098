"""Text: column expressions where Spark has them, Arrow UDFs for Unicode normal forms, title case and case folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Words and marks that make a line critical.
CRITICAL = r"(?iU)(?:\d|₫|đ(?:\b|/)|%|\b(?:sđt|đt|tel|hotline|sku|mã|giá|km)\b)"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(StringType())
def case_pattern(source: pd.Series, candidate: pd.Series) -> pd.Series:
    """candidate in capitals if all letters of source are, in title case if source is in title case."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return b
        letters = [c for c in a if c.isalpha()]
        if letters and all(c.isupper() for c in letters):
            return b.upper()
        return b.title() if a.istitle() else b

    return pd.Series([one(a, b) for a, b in zip(source, candidate, strict=True)])


@F.pandas_udf(StringType())
def safe_name(s: pd.Series) -> pd.Series:
    """A portable file name of 80 characters at most; "layer" for one that has nothing left."""

    def one(t: str | None) -> str:
        t = re.sub(r'[<>:"/\\|?*\x00-\x1f]+', "_", unicodedata.normalize("NFKC", t or "").strip())
        return re.sub(r"\s+", " ", t).strip(" ._")[:80] or "layer"

    return s.map(one)


@F.pandas_udf(StringType())
def approved_text(s: pd.Series) -> pd.Series:
    """A reviewer's text with plain line ends, composed and trimmed; null if empty, over 2000 characters or with control characters."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).strip()
        return None if not t or len(t) > 2000 or any(unicodedata.category(c) == "Cc" and c not in "\n\t" for c in t) else t

    return s.map(one)


def squeezed(c: Column) -> Column:
    """White space runs become one space; ends trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_ocr(c: Column) -> Column:
    return nfc(squeezed(c))


def is_critical(c: Column) -> Column:
    return c.rlike(CRITICAL)


def edge_whitespace(c: Column) -> dict[str, Column]:
    """prefix, core and suffix of a text; white space on both sides of nothing goes to the prefix."""
    pattern = r"(?sU)^(\s*+)(.*?)(\s*)$"
    return {name: F.regexp_extract(c, pattern, i) for i, name in enumerate(("prefix", "core", "suffix"), 1)}


def scale_tag(scale: Column) -> Column:
    """A scale of up to five decimals without trailing zeros, its point written p."""
    wide = F.format_string("%.5f", F.round(scale, 5))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(wide, "0+$", ""), r"\.$", ""), r"\.", "p")


def first_reasons(reasons: Column) -> Column:
    """Trimmed reasons without empty ones, each once, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(reasons, lambda r: F.trim(r)), lambda r: r != ""))


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def safe_relative_path(c: Column) -> Column:
    """True for bundle-relative paths in canonical form: no root, drive, empty or dot parts, no NUL."""
    p = F.regexp_replace(c, r"\\", "/")
    parts = F.split(p, "/")
    return c.isNotNull() & (c != "") & ~F.contains(c, F.lit("\x00")) & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & F.forall(parts, lambda x: ~x.isin("", ".", ".."))


def portable(json: Column, staging: str) -> Column:
    """True if no string of a document names a staging place."""
    return ~(F.contains(json, F.lit(staging)) | F.contains(json, F.lit("job_v5_")) | F.contains(json, F.lit(".new-")))


def safe_attribute(name: Column, value: Column) -> Column:
    """True for attributes that only declare: no handlers, links, styles or scripts."""
    n, folded = F.trim(name), F.lower(F.trim(name))
    v = F.regexp_replace(F.lower(value), " ", "")
    bad_name = (n == "") | n.rlike("[\\s<>\"']") | folded.startswith("on") | folded.isin("href", "xlink:href", "style", "xmlns", "xmlns:xlink")
    bad_value = value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | F.contains(v, F.lit("javascript:")) | F.contains(v, F.lit("url(")) | F.contains(v, F.lit("data:text/html"))
    return ~bad_name & ~bad_value


def package_name(c: Column) -> Column:
    """A package name in canonical form: lower case, runs of - _ . become one hyphen."""
    return F.lower(F.regexp_replace(c, "[-_.]+", "-"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("form", StringType()), StructField("coverage", DoubleType())]))
def for_font(text: pd.Series, codepoints: pd.Series) -> pd.DataFrame:
    """The composed form of a text, or the decomposed one if a font covers more of it; and the share of visible characters that the font has."""
    rows = []
    for t, have in zip(text, codepoints, strict=True):
        best = ("", "NFC", -1.0)
        known = set(have if have is not None else ())
        for form in ("NFC", "NFD"):
            c = unicodedata.normalize(form, t or "")
            points = {ord(x) for x in c if not x.isspace() and unicodedata.category(x)[0] != "C"}
            share = len(points & known) / len(points) if points else 1.0
            if share > best[2]:
                best = (c, form, share)
        rows.append(best)
    return pd.DataFrame(rows, columns=["text", "form", "coverage"])


def path_operators(stream: Column) -> Column:
    """How many path construction operators a page description's text holds."""
    return F.regexp_count(stream, F.lit(r"(?<!\S)(?:m|l|c|v|y|h|re)(?!\S)"))
