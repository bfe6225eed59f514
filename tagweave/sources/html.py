"""Names from web pages and name elements (re-aimed at stored pages; no
network fetch)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import py_strip

# --- fixed values: HTML entities decoded in heading text (&amp; last) --------
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _numeric_entities(t: Column) -> Column:
    """``&#233;`` and ``&#xe9;`` decoded; numbers outside Unicode stay.
    ``&#38;`` becomes ``&amp;``, which is decoded last."""
    number = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def one(m: Column) -> Column:
        digits = F.regexp_replace(m, r"&#[xX]?|;", "")
        code = F.when(m.rlike("[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        # UTF-16 code units, two above the basic plane
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        unit = lambda u: F.lpad(F.hex(u.cast("long")), 4, "0")
        chars = F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
        return (F.when(code == 38, F.lit("&amp;"))
                .when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(chars), "UTF-16BE"))
                .otherwise(m))

    parts = F.split(t, number, -1)
    found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(number), 0), one), F.array(F.lit("")))
    return F.when(t.rlike(number), F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(p, m)), "")).otherwise(t)


def html_text(c: Column) -> Column:
    """Text content of an HTML fragment: inner tags removed, common entities
    decoded, stripped."""
    t = F.regexp_replace(c, r"<[^>]*>", "")
    t = _numeric_entities(t)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return py_strip(t)


def _container(html: Column, container: str) -> Column:
    """Inside of the first matching element, with nested elements of its tag
    counted: the start and end tags are walked with a running depth."""
    name, _, cls = container.partition(".")
    has_class = rf"""(?=[^>]*\sclass\s*=\s*["']?(?:[^"'>]*\s)?{re.escape(cls)}(?=[\s"'>]))""" if cls else ""
    first = F.regexp_extract(html, rf"(?is)<({re.escape(name) if name else '[a-z][a-z0-9]*'})\b{has_class}[^>]*>(.*)$", 1)
    rest = F.regexp_extract(html, rf"(?is)<(?:{re.escape(name) if name else '[a-z][a-z0-9]*'})\b{has_class}[^>]*>(.*)$", 1)
    # the element's own tag is only known from the row, so all tags are cut out and compared
    pieces = F.split(rest, r"(?=</?[a-zA-Z])", -1)
    opens = lambda p: F.lower(F.regexp_extract(p, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    ends = lambda p: F.lower(F.regexp_extract(p, r"^</([a-zA-Z][a-zA-Z0-9]*)", 1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def walk(tag: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            depth = acc["depth"] + F.when(opens(p) == tag, 1).when(ends(p) == tag, -1).otherwise(0)
            return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
                depth.alias("depth"), F.when(depth == 0, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept")))
        return F.aggregate(pieces, start, step, lambda acc: acc["kept"])

    kept = F.transform(F.array(F.lower(first)), walk)[0]
    return F.when(first != "", F.array_join(F.slice(pieces, F.lit(1), kept), "")).otherwise(F.lit(""))


def extract_headings(pages_df: DataFrame, tag: str = "h1", key: str = "page_id", html_col: str = "html",
                     container: str | None = None) -> DataFrame:
    """Stripped text of every ``<tag>`` element, optionally only inside the
    first ``container`` element: a tag name, ``tag.class`` or ``.class``.  An
    element ends at its own end tag (elements of the same tag may be nested);
    without one it reaches the end of the page.  Output ``(key, ord, name)``;
    in-row regex extraction, no shuffle."""
    html = F.col(html_col)
    if container:
        html = _container(html, container)
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return (pages_df.select(key, F.posexplode(found).alias("ord", "raw"))
            .select(key, F.col("ord").cast("int").alias("ord"), html_text(F.col("raw")).alias("name")))


def extract_alias_names(df: DataFrame, name_col: str = "name", key: str = "src_id") -> DataFrame:
    """A name element without a sub-element gives one name; ``ABBR (Full
    name)`` gives an abbreviation row and a full-name row (outer parentheses
    stripped).  Output ``(key, ord, name, kind)``."""
    t = py_strip(F.col(name_col))
    m = r"^(.*?)\s*\((.*)\)$"
    has = t.rlike(m)
    abbr = F.when(has, py_strip(F.regexp_extract(t, m, 1)))
    full = F.when(has, py_strip(F.regexp_replace(py_strip(F.regexp_extract(t, m, 2)), r"^[()]+|[()]+$", "")))
    items = F.when(has, F.array(F.struct(abbr.alias("name"), F.lit("abbreviation").alias("kind")),
                                F.struct(full.alias("name"), F.lit("full").alias("kind")))) \
             .otherwise(F.array(F.struct(t.alias("name"), F.lit("name").alias("kind"))))
    return (df.select(key, F.posexplode(items).alias("ord", "x"))
            .select(key, F.col("ord").cast("int").alias("ord"), F.col("x.name").alias("name"),
                    F.col("x.kind").alias("kind")))
