"""Documents to sections, cleaned text, names, prompts and parsed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phialo.functions import html as H
from phialo.functions import text as T
from phialo.functions.batches import map_documents

Parts = str | tuple[str, ...]
SECTION = "found boolean, method string, end_found boolean, content_html string, has_table boolean, has_list boolean"


def _with_text(df: DataFrame, html: str, out: str, work: Callable[[str], str]) -> DataFrame:
    """``df`` with a text made of each document in place of it; a null document stays null."""
    marked = df.select(*[df[c] for c in df.columns if c not in (html, out)], df[html].alias("_html"), df[html].isNull().alias("_null"))
    made = map_documents(marked, "_html", StructType().add(out, "string"), lambda: lambda x: (work(x),))
    return made.withColumn(out, F.when(~F.col("_null"), F.col(out))).drop("_null")


def page_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the stripped text nodes by line, without script and style, in place of the markup."""
    return _with_text(df, html, out, H.page_text)


def clean_text(df: DataFrame, html: str = "html", out: str = "text", max_chars: int | None = 8000) -> DataFrame:
    """Text with cell bars and row ends, blanks collapsed, cut at ``max_chars``, in place of the markup."""
    text = F.regexp_replace(F.col(out), r"[ \t]+", " ")
    text = T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return _with_text(df, html, out, H.marked_text).withColumn(out, text if max_chars is None else F.substring(text, 1, max_chars))


def extract_section(df: DataFrame, html: str = "html", start: Parts = H.SECTION_START, end: Parts = H.SECTION_END) -> DataFrame:
    """The markup between two markers; null documents are not found."""

    def make() -> Callable[[str], tuple]:
        first, last = H.Marker(start), H.Marker(end)
        return lambda x: H.section(x, first, last)

    return map_documents(df, html, StructType.fromDDL(SECTION), make)


def section_blocks(manifest: DataFrame, docs: DataFrame, **markers) -> tuple[DataFrame, DataFrame]:
    """(blocks, log) of a manifest's documents.

    A row is a Success where product and file are named, the document is there and the
    section has markup; every other one is Failed.
    """
    cut = extract_section(docs.select(F.col("product_id").alias("_doc"), "html"), **markers)
    rows = manifest.join(cut, manifest["product_id"].cast("string") == cut["_doc"].cast("string"), "left")
    named = (T.or_empty(F.col("product_id").cast("string")) != "") & (T.or_empty(F.col("file_name")) != "")
    good = named & F.coalesce("found", F.lit(False)) & (T.or_empty(F.col("content_html")) != "")
    rows = rows.withColumn("good", good)
    blocks = rows.where("good").select(F.col("product_id").cast("long").alias("product_id"), "has_table", "content_html")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) & F.col("good")
    log = rows.select("product_id", F.when(F.col("good"), "Success").otherwise("Failed").alias("status"), F.col("good").alias("found_4_8"), flag("has_table").alias("has_table"), flag("has_list").alias("has_list"))
    return blocks, log


def audit_sections(docs: DataFrame, **markers) -> DataFrame:
    """Method, whether the end was found, characters of the block."""
    cut = extract_section(docs.select("product_id", "html"), **markers)
    return cut.select("product_id", "method", F.col("end_found").alias("end_4_9_found"), F.length("content_html").alias("block_chars"))


def audit_summary(audit: DataFrame, small: int = 500) -> DataFrame:
    """A4, F8: (kind, value, n, percent) by method and by end; small blocks as their own row."""
    total = audit.agg(F.count(F.lit(1)).alias("total"))
    pairs = F.array(
        F.struct(F.lit("method").alias("kind"), F.col("method").alias("value")),
        F.struct(F.lit("end_found").alias("kind"), F.col("end_4_9_found").cast("string").alias("value")),
        F.struct(F.lit("small").alias("kind"), (F.col("block_chars") < small).cast("string").alias("value")),
    )
    counts = audit.select(F.explode(pairs).alias("z")).groupBy("z.kind", "z.value").agg(F.count(F.lit(1)).alias("n"))
    with_total = counts.crossJoin(F.broadcast(total))  # one row
    return with_total.select("kind", "value", "n", (100 * F.col("n") / F.col("total")).alias("percent")).orderBy("kind", F.desc("n"), "value")


def name_section(df: DataFrame, html: str = "html", out: str = "name_text") -> DataFrame:
    """``df`` with the text of the section with the product's name in place of the markup."""
    start, end = H.NAME_START, H.NAME_END

    def make() -> Callable[[str], tuple]:
        first, last = H.Marker(start), H.Marker(end)
        return lambda x: (H.name_section(x, first, last),)

    return map_documents(df, html, StructType().add(out, "string"), make)


def short_name(raw: Column) -> Column:
    """The first three lines that aren't blank, joined by bars, at most 300 characters."""
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), T.strip), lambda x: x != "")
    return F.substring(F.array_join(F.slice(lines, 1, 3), " | "), 1, 300)


def drug_names(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Name and status (Success, EmptyExtraction, Failed without a document) of each product."""
    texts = name_section(docs.select(F.col("product_id").cast("string").alias("_doc"), "html"))
    named = texts.select("_doc", short_name(F.col("name_text")).alias("_name"))
    rows = ids.select(F.col("product_id").cast("string").alias("product_id")).join(named, F.col("product_id") == F.col("_doc"), "left")
    status = F.when(F.col("_doc").isNull(), "Failed").when(F.col("_name") == "", "EmptyExtraction").otherwise("Success")
    return rows.select("product_id", T.or_empty(F.col("_name")).alias("brand_name"), status.alias("status"))


def build_prompts(df: DataFrame, template: str, column: str, slot: str = "{content}", out: str = "prompt") -> DataFrame:
    """A template with a column's text in its slot."""
    before, _, after = template.partition(slot)
    return df.withColumn(out, F.concat(F.lit(before), T.or_empty(F.col(column)), F.lit(after)))


ANSWER = "adrs array<struct<adr_term:string,frequency:string,soc:string>>, _bad string"


def unfenced(c: Column) -> Column:
    return T.strip(F.regexp_replace(T.or_empty(c), "```(?:json)?", ""))


def parse_adr_responses(df: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(rows, log) of model answers; an answer that is no JSON object fails with no rows."""
    parsed = df.withColumn("_text", unfenced(F.col(response)))
    parsed = parsed.withColumn("_a", F.from_json("_text", ANSWER, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    good = F.col("_a._bad").isNull() & F.col("_text").startswith("{") & F.col("_a").isNotNull()
    parsed = parsed.withColumn("_good", F.coalesce(good, F.lit(False)))
    rows = parsed.where("_good").select("product_id", F.posexplode("_a.adrs").alias("pos", "z"))
    field = lambda c: T.strip(T.or_empty(F.col(f"z.{c}")))
    rows = rows.select("product_id", "pos", field("adr_term").alias("adr_term"), F.lower(field("frequency")).alias("frequency"), field("soc").alias("soc"))
    n = F.when(F.col("_good"), F.coalesce(F.size("_a.adrs"), F.lit(0))).otherwise(0)
    log = parsed.select(
        "product_id", F.when(F.col("_good"), "Success").otherwise("Failed").alias("status"), F.greatest(n, F.lit(0)).alias("adr_count"),
        F.when(F.col("_good"), "").otherwise("answer is no JSON object").alias("error"),
    )
    return rows, log


def parse_substance(df: DataFrame, response: str = "response") -> DataFrame:
    """X11: active substance of an answer, lower case, blanks collapsed; empty ones fail."""
    value = F.lower(T.tidy(T.or_empty(F.try_variant_get(F.try_parse_json(unfenced(F.col(response))), "$.active_substance", "string"))))
    status = F.when(value == "", "Failed").otherwise("Success")
    return df.select("product_id", value.alias("active_substance"), status.alias("status"), F.when(value == "", "empty_result").otherwise("").alias("error"))


def pending(ids: DataFrame, done: DataFrame, key: str = "product_id") -> DataFrame:
    """Ids without a result."""
    return ids.join(done.select(key).distinct(), key, "left_anti")


def carried(ids: DataFrame, done: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows that an earlier run has, with status Skipped."""
    return done.join(ids.select(key).distinct(), key, "left_semi").withColumn("status", F.lit("Skipped"))
