"""Scalar functions as column expressions.

Java's regular expressions know Unicode classes under ``(?U)`` only, and Spark's ``trim``
takes spaces alone, so both are wrapped here once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE = "https://www.medicines.org.uk/emc/product/"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tidy(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def or_default(c: Column, default: str) -> Column:
    """Stripped value, or the default where it is null or blank."""
    s = strip(or_empty(c))
    return F.when(s == "", F.lit(default)).otherwise(s)


def safe_int(c: Column, fallback: int = 0) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(fallback))


def product_id_of(url: Column) -> Column:
    """Id in a product address, or null."""
    return F.regexp_extract(url, r"/emc/product/(\d+)(?:/|$)", 1).try_cast("long")


def is_sitemap(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).endswith(".xml")


def locations(xml: Column) -> Column:
    """Non-empty <loc> values of a sitemap, with or without a namespace prefix."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc(?:\s[^>]*)?>(.*?)</(?:\w+:)?loc\s*>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def only_references(markup: Column, names: tuple[str, ...]) -> Column:
    """Markup in which no references count but these, ended by a semicolon, and &amp with or without one.

    Every other & stands for itself, as in "&quot" where a text was cut off.  Scripts, styles and
    comments stay as they are.
    """
    pieces = F.regexp_extract_all(markup, F.lit(r"(?is)<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<!--.*?(?:-->|\z)|<|[^<]+"), F.lit(0))
    other = rf"&(?!(?:{'|'.join(names)});)(?:amp;?)?"
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"(?i)^<(script|style|!--)"), x).otherwise(F.regexp_replace(x, other, "&amp;"))), "")


def source_url(product_id: Column) -> Column:
    return F.concat(F.lit(SITE), product_id.cast("string"), F.lit("/smpc/print"))


def slug(c: Column) -> Column:
    """Lower-case words joined by underscores, at most 80 characters; ``unknown`` for none."""
    kept = F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(joined == "", F.lit("unknown")).otherwise(joined), 1, 80)


def title_case(c: Column) -> Column:
    """Every letter behind a non-letter in upper case, the others in lower case."""
    parts = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def occurrence_id(product_id: Column, term: Column) -> Column:
    key = F.concat(product_id, F.lit("|"), term)
    return F.concat(F.lit("occ_"), product_id, F.lit("_"), F.substring(F.sha1(key.cast("binary")), 1, 12))


def escape_literal(c: Column) -> Column:
    """A value inside a quoted graph literal."""
    e = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return strip(F.replace(e, F.lit("\n"), F.lit(" ")))


#: What joins the parts of a compound term.
COMPOUND = r"(?iU)\s*/\s*|\s+or\s+|\s+and\s+|\s+including\s+|\s+with\s+|\s+such\s+as\s+"


def search_terms(c: Column) -> Column:
    """Cleaned term, and the first part of a compound one."""
    bare = strip(F.regexp_replace(F.lower(strip(c)), r"(?U)\s*\([^)]*\)", ""))
    bare = strip(F.regexp_replace(bare, r"(?U)\s+[a-z]$", ""))
    parts = F.filter(F.transform(F.split(bare, COMPOUND), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array(bare, F.get(parts, F.lit(0)))).otherwise(F.array(bare))


#: Words that end a brand name.
FORM_WORDS = ("mg", "mcg", "ml", "tablets", "tablet", "capsules", "capsule", "solution")


def drug_query(c: Column) -> Column:
    """Brand name in front of the first strength or form; the whole label if nothing is left."""
    label = tidy(F.get(F.split(strip(or_empty(c)), r"\|"), F.lit(0)))
    tokens = F.split(label, " ")

    def ends(token: Column) -> Column:
        bare = F.regexp_replace(F.lower(token), r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")
        return bare.rlike(r"(?U)\d") | bare.isin(*FORM_WORDS)

    # place of the first token that ends the name; all tokens without one
    stop = F.array_position(F.transform(tokens, ends), True)
    name = strip(F.array_join(F.slice(tokens, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(tokens))), " "))
    return F.when(name == "", label).otherwise(name)


def eval_term(c: Column) -> Column:
    """Term for comparison: letters a-z, digits and Greek; ``&`` is ``and``."""
    s = F.replace(strip(F.lower(or_empty(c))), F.lit("&"), F.lit(" and "))
    return tidy(F.regexp_replace(s, "[^a-z0-9Ͱ-Ͽ ]+", " "))


def eval_frequency(c: Column) -> Column:
    return F.replace(F.regexp_replace(strip(F.lower(or_empty(c))), r"(?U)\s+", " "), F.lit("-"), F.lit(" "))


def run_term(c: Column) -> Column:
    """Term for comparing runs: white space and case only."""
    return F.regexp_replace(F.lower(strip(or_empty(c))), r"(?U)\s+", " ")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the score interval, clamped to [0, 1]; NaN without cases."""
    k, n = k.cast("double"), n.cast("double")
    m = F.nullif(n, F.lit(0.0))
    p, d = k / m, 1 + z * z / m
    centre, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    none = lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x)  # noqa: E731  greatest and least skip nulls
    return F.struct(none(F.greatest(F.lit(0.0), (centre - half) / d)).alias("low"), none(F.least(F.lit(1.0), (centre + half) / d)).alias("high"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(float("nan")))


def percent_text(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit("n/a")).otherwise(F.format_string("%.1f%%", 100 * x))


def interval_text(ci: Column) -> Column:
    low, high = ci["low"], ci["high"]
    return F.when(F.isnan(low), F.lit("n/a")).otherwise(F.format_string("[%.1f%%, %.1f%%]", 100 * low, 100 * high))


def atc_level(c: Column) -> Column:
    return F.substring(c, 1, 1)


#: Shapes of codes.
ATC_SHAPE = r"^(?:[A-Z]\d{2}[A-Z]{2}\d{2}|[A-Z]\d{2}[A-Z]{2}|[A-Z]\d{2}[A-Z]|[A-Z]\d{2}|[A-Z])$"
MEDDRA_SHAPE = r"^\d{7,8}$"
ICD_SHAPE = r"^[A-Z]\d{1,2}(\.\d+)?$"


def valid_atc(c: Column) -> Column:
    return c.rlike(ATC_SHAPE)


def valid_meddra(c: Column) -> Column:
    return c.rlike(MEDDRA_SHAPE)


def valid_icd(c: Column) -> Column:
    return c.rlike(ICD_SHAPE)


def valid_url(c: Column) -> Column:
    return c.startswith("https://")


def id_order(c: Column) -> list[Column]:
    """Sort keys that put digit strings in number order."""
    return [c.try_cast("bigint"), c]
