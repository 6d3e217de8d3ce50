"""Text functions: search normalisation, tokens, cleaning, escaping and sizes."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Words for the full-text index: runs of letters, digits and private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_BREVE = "\u0306"
_STRAY_BREVE = re.compile(f"(?<![иуИУ]){_BREVE}")
#: All marks that take no space, but for the breve; those beyond the first plane by themselves, or the set would be searched in sequence.
_MARKS, _FAR_MARKS = (
    re.compile(f"[{''.join(c for c in map(chr, span) if c != _BREVE and unicodedata.category(c) == 'Mn')}]+")
    for span in (range(1 << 16), range(1 << 16, sys.maxunicode + 1))
)
_FAR = re.compile("[\U00010000-\U0010FFFF]")


def search_form(text: str | None) -> str | None:
    """Text without accents and with ё as е; the breve stays on и and у, whose letters it tells apart."""
    if not text or text.isascii():
        return text
    plain = _MARKS.sub("", unicodedata.normalize("NFD", text))
    if _FAR.search(plain):
        plain = _FAR_MARKS.sub("", plain)
    if _BREVE in plain:
        plain = _STRAY_BREVE.sub("", plain)
    return unicodedata.normalize("NFC", plain).replace("ё", "е").replace("Ё", "Е")


@F.pandas_udf(StringType())
def search_form_column(text: pd.Series) -> pd.Series:
    return text.map(search_form, na_action="ignore")


def search_form_of(name: str) -> Column:
    """search_form of a column; ASCII texts, which have as many bytes as characters, stay in the JVM."""
    other = F.when(F.octet_length(name) != F.length(name), F.col(name))
    return F.coalesce(search_form_column(other), F.col(name))


@F.pandas_udf(StringType())
def case_folded(text: pd.Series) -> pd.Series:
    """Full Unicode case folding, for which Spark has no function."""
    return text.str.casefold()


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def cleaned(column: Column) -> Column:
    """White space collapsed inside lines, blank lines dropped, ends trimmed."""
    flat = F.regexp_replace(column, r"[ \t\r\f\x0B\u00A0]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"\n\s*", "\n"), r"^\s+|\s+$", "")


def unescaped_script(column: Column) -> Column:
    """Script text with its escaped slashes and ampersands plain."""
    for escaped, plain in (("\\/", "/"), ("\\u002F", "/"), ("\\u002f", "/"), ("\\x2F", "/"), ("\\x2f", "/"), ("&amp;", "&")):
        column = F.replace(column, F.lit(escaped), F.lit(plain))
    return column


def escaped_html(column: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = F.replace(column, F.lit(plain), F.lit(escaped))
    return column


def with_marks(column: Column) -> Column:
    """Escaped HTML in which only <mark> tags are tags again."""
    return F.replace(F.replace(escaped_html(column), F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def repaired(name: str) -> Column:
    """UTF-8 that was read as Latin-1, where that is what it must have been."""
    c = F.col(name)
    latin = ~c.rlike(r"[^\u0000-\u00FF]")
    again = F.try_validate_utf8(F.encode(c, "ISO-8859-1"))
    return F.when(latin, F.coalesce(again.cast("string"), c)).otherwise(c)


def human_bytes(name: str, largest: str = "TB") -> Column:
    """A size with one decimal in the largest unit, up to `largest`, that leaves 1 or more; bytes without decimals."""
    size = F.col(name).cast("double")
    units = ("KB", "MB", "GB", "TB")
    top = units.index(largest) + 1
    out = F.concat(F.format_string("%.1f", F.bround(size / (1024.0**top), 1)), F.lit(f" {largest}"))
    for k, unit in reversed([*enumerate(units[: top - 1], 1)]):
        out = F.when(size < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(size / (1024.0**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(out)
