"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}_]+"
#: A wikilink's target: before an alias (also with an escaped bar) or a heading.
WIKILINK = r"\[\[([^\]|#\\]+)"


def words(text: Column) -> Column:
    """The words of a text, lower case; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def plain(text: Column) -> Column:
    """Words parted by single spaces, one also at either end, case kept."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def wikilinks(text: Column) -> Column:
    """Targets of all ``[[path/name]]``, ``[[path/name|alias]]`` and ``[[path/name#heading]]``."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WIKILINK), 1), lambda x: F.trim(x))


def fingerprint(*parts: Column) -> Column:
    """A stable identity of a finding; null parts differ from empty ones."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def strip_markup(html: Column) -> Column:
    """Text of a page by patterns: raw elements and comments first, then tags, references, white space."""
    out = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript", "template"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
