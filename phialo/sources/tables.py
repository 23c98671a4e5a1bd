"""Readers and writers of the jobs' files."""

from __future__ import annotations

import csv
import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phialo import scratch
from phialo.functions import fixed
from phialo.functions import text as T

LOG_COLUMNS = ("timestamp", "product_id", "url", "status", "http_status", "error_type", "attempt_count", "duration_ms", "output_file")
LEGACY_COLUMNS = ("Product_ID", "Status", "Timestamp")
BOM = "﻿"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """IO1: ids of {"ids": [...]} or [...] with their order; what is no whole number is left out.

    The value is read by many tasks: it is cut at its commas, not at lines, and what lies
    between the bracket behind "ids" (or the first of all) and the next closing one counts.
    ``seq`` is the file, the place of its part and the place there.  A folder of parts that
    ``write_ids`` made is one value.
    """
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    pieces = spark.read.option("lineSep", ",").text(path).select(at.alias("seq"), F.col("value").alias("v"))
    opens = F.col("v").rlike(r'"ids"\s*:\s*\[|^\s*\[')
    bounds = pieces.agg(F.min(F.when(opens, F.col("seq"))).alias("first"), F.max(F.when(F.col("v").contains("]"), F.col("seq"))).alias("last"))
    inside = pieces.crossJoin(F.broadcast(bounds)).where("seq >= first AND seq <= last")  # one row
    item = F.regexp_replace(F.regexp_replace("v", r"^[^\[]*\[", ""), r"\][^\]]*$", "")
    number = F.regexp_extract(item, r'^\s*("?)\s*([+-]?[0-9]+)\s*\1\s*$', 2)
    return inside.select("seq", number.try_cast("long").alias("product_id")).where("product_id IS NOT NULL")


def write_ids(df: DataFrame, path: str, source: str = "", id: str = "product_id") -> None:
    """IO2: one object with source, count and the sorted distinct ids, as text.

    Ids are sorted in ranges and each task writes one, so no task holds the list; the parts
    in the order of their names are one JSON value, its first part with the head.
    """
    ids = scratch.table(df.select(F.col(id).cast("string").alias("id"), F.col(id).alias("_by")).where(F.col(id).isNotNull()).distinct(), "ids")
    known = ids.agg(F.count(F.lit(1)).alias("n"), F.min("_by").alias("least")).head()
    quoted = F.col("id") if dict(df.dtypes)[id] in ("tinyint", "smallint", "int", "bigint") else F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7)
    comma = F.when(F.col("_by") == F.lit(known["least"]), "").otherwise(",")
    kind = dict(df.dtypes)[id]
    ends = df.sparkSession.createDataFrame(
        [(0, f'{{"source": {json.dumps(source)}, "count": {known["n"]}, "ids": ['), (2, "]}")], "part int, line string"
    ).withColumn("_by", F.lit(None).cast(kind))
    lines = ids.select(F.lit(1).alias("part"), F.concat(comma, quoted).alias("line"), "_by").unionByName(ends)
    lines.orderBy("part", "_by").select("line").write.mode("overwrite").text(path)
    scratch.drop(ids)


def read_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, ordered: bool = False, multi_line: bool = True) -> DataFrame:
    """IO3: a CSV with header as strings, nulls as empty strings; fields beyond the schema go.

    ``multi_line`` is for fields that hold line ends; without it large files are read by many
    tasks.  ``ordered`` adds ``seq``, which rises with the lines of each file; its files are
    read whole.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multi_line or ordered)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.csv(path)
    df = df.withColumnsRenamed({c: c.lstrip(BOM) for c in df.columns}).na.fill("")
    return df.withColumn("seq", F.monotonically_increasing_id()) if ordered else df


def log_forms(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a log by their header; one pass over the lines, one row for each file.

    A file's first line is the first one that the task of the file's first part reads.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    forms: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():  # the driver has listed these files already
        header = next(csv.reader([row["header"].lstrip(BOM)]), [])
        forms.setdefault(tuple(header), []).append(unquote(row["file"]))
    return forms


def _current_form(raw: DataFrame, missing: str) -> DataFrame:
    """Rows of the legacy form as the current one has them."""
    status, empty = T.strip(F.col("Status")), F.lit("")
    named = F.when(status == "Success", "SUCCESS").when(status == "404", "HTTP_404").when(status == "Error", "HTTP_ERROR").otherwise(F.upper(status))
    return raw.select(
        F.col("Timestamp").alias("timestamp"),
        F.col("Product_ID").alias("product_id"),
        empty.alias("url"),
        named.alias("status"),
        F.when(named == "HTTP_404", "404").otherwise("").alias("http_status"),
        empty.alias("error_type"),
        F.lit(missing).alias("attempt_count"),
        F.lit(missing).alias("duration_ms"),
        empty.alias("output_file"),
    )


def read_fetch_log(spark: SparkSession, path: str, missing: str = "0") -> DataFrame:
    """IO4: the log's files, each in its current or its legacy form; any other header is an error.

    ``missing`` stands for the counters that the legacy form lacks.  Files without a line give
    no rows.
    """
    forms = log_forms(spark, path)
    if unknown := {h: files[:3] for h, files in forms.items() if h not in (LOG_COLUMNS, LEGACY_COLUMNS)}:
        raise ValueError(f"unknown log headers: {unknown}")
    parts = [read_table(spark, files, list(h), multi_line=False) for h, files in forms.items()]
    parts = [p if tuple(p.columns) == LOG_COLUMNS else _current_form(p, missing) for p in parts]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in LOG_COLUMNS))


def write_log(log: DataFrame, path: str) -> None:
    """a log of ``fetchlog.by_day`` by day; rows of a new run are appended."""
    log.repartition("day", F.pmod(F.xxhash64("product_id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "smpc_*.html").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"file_name": name, "product_id": F.regexp_extract(name, r"^smpc_(.+)\.html$", 1)})


def document_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """IO5: product, file, size, time and address of each stored document, by file name."""
    size, time, url = F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"), T.source_url(F.col("product_id"))
    return _stored(spark, folder).select("product_id", "file_name", size, time, url.alias("source_url")).orderBy("file_name")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """IO6: whole documents by product; bytes that are no UTF-8 become the replacement character."""
    return _stored(spark, folder).select("product_id", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def write_blocks(df: DataFrame, path: str) -> None:
    """IO7: section payloads as a JSON table."""
    df.select("product_id", "has_table", "content_html").write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """IO8: a table as Parquet, or as CSV with header and nulls as empty fields."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    else:
        writer.parquet(path)


def _value(name: str, column: str, end: str) -> Column:
    return F.concat(F.lit(f'    :{name} "'), T.escape_literal(F.col(column)), F.lit(f'" {end}'))


def _individual(id: str, kind: str, *lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(""), F.concat(F.lit(":"), F.col(id), F.lit(" rdf:type owl:NamedIndividual ,")), F.lit(f"    :{kind} ;"), *lines)


def turtle_blocks(drugs: DataFrame, adrs: DataFrame, smpcs: DataFrame, facts: DataFrame) -> DataFrame:
    """IO9: (part, number, key, block): the text of every individual with its sort keys."""
    has = F.col("active_ingredient") != ""
    atc = F.when(has, _value("atcCode", "atc_code", ";")).otherwise(_value("atcCode", "atc_code", "."))
    ingredient = F.when(has, _value("activeIngredient", "active_ingredient", "."))
    drug = _individual("slug", "Drug", _value("productId", "product_id", ";"), _value("drugLabel", "label", ";"), atc, ingredient)
    names = [_value("adrLabel", "adr_term", ";"), _value("meddraPreferredTerm", "meddra_preferred_term", ";")]
    adr = _individual("slug", "AdverseDrugReaction", *names, _value("meddraCode", "meddra_code", ";"), _value("icdCode", "icd_code", "."))
    smpc = _individual("slug", "SmPCDocument", _value("productId", "product_id", ";"), _value("sourceUrl", "source_url", "."))
    links = [F.concat(F.lit(f"    :{p} :"), F.col(c), F.lit(" ;")) for p, c in (("occurrenceOfAdr", "adr_id"), ("refersToSmPC", "smpc_id"))]
    values = [_value("productId", "product_id", ";"), _value("frequency", "frequency", ";"), _value("soc", "soc", ".")]
    of_drug = F.concat(F.lit(":"), F.col("drug_id"), F.lit(" :hasOccurrence :"), F.col("occ_id"), F.lit(" ."))
    occ = _individual("occ_id", "DrugAdrOccurrence", *links, *values, of_drug)
    number, none = F.col("product_id").try_cast("bigint"), F.lit(None).cast("bigint")
    by_product = F.col("product_id")
    rows = [(1, drugs, number, by_product, drug), (2, adrs, none, F.col("adr_term"), adr), (3, smpcs, number, by_product, smpc)]
    rows.append((4, facts, number, F.concat_ws("|", "product_id", "adr_term"), occ))
    parts = [df.select(F.lit(k).alias("part"), n.alias("number"), key.alias("key"), block.alias("block")) for k, df, n, key, block in rows]
    return reduce(DataFrame.unionByName, parts)


#: Prefixes of the written graph.
PREFIXES = {
    "": "http://example.org/pilot-smpc-kg#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def turtle_header() -> list[str]:
    """Prefixes and schema as Turtle lines."""
    lines = [f"@prefix {p}: <{iri}> ." for p, iri in PREFIXES.items()]

    def add(name: str, kind: str, label: str, *facts: str) -> None:
        lines.extend(["", f"{name} rdf:type owl:{kind} ;", *[f"    {x} ;" for x in facts], f'    rdfs:label "{label}"@en .'])

    add(f"<{fixed.NAMESPACE}>", "Ontology", fixed.GRAPH_LABEL)
    for name, label in fixed.CLASSES:
        add(f":{name}", "Class", label)
    for name, domain, range_, label in fixed.OBJECT_PROPERTIES:
        add(f":{name}", "ObjectProperty", label, f"rdfs:domain :{domain}", f"rdfs:range :{range_}")
    for name, domain, label in fixed.DATA_PROPERTIES:
        add(f":{name}", "DatatypeProperty", label, *([f"rdfs:domain :{domain}"] if domain else []), "rdfs:range xsd:string")
    return lines


def write_turtle(drugs: DataFrame, adrs: DataFrame, smpcs: DataFrame, facts: DataFrame, path: str) -> None:
    """IO9: the graph as text files whose names sort like their content."""
    head = drugs.sparkSession.createDataFrame([(0, None, "", "\n".join(turtle_header()))], "part int, number bigint, key string, block string")
    rows = head.unionByName(turtle_blocks(drugs, adrs, smpcs, facts)).orderBy("part", F.col("number").asc_nulls_last(), "key")
    rows.select("block").write.mode("overwrite").text(path)


def failed_ids(log: DataFrame, kind: str = "404") -> DataFrame:
    """IO10: sorted distinct ids of the 404 list or of the retry list."""
    wanted = ["HTTP_404"] if kind == "404" else ["HTTP_ERROR", "REQUEST_ERROR"]
    return log.where(F.col("status").isin(*wanted)).select("product_id").distinct().orderBy(*T.id_order(F.col("product_id")))


def product_ids(urls: DataFrame, url: str = "url") -> DataFrame:
    """Sorted distinct product ids of a table of addresses."""
    return urls.select(T.product_id_of(F.col(url)).alias("product_id")).where("product_id IS NOT NULL").distinct().orderBy("product_id")


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each location of stored sitemaps, with whether it is a sitemap itself."""
    each = sitemaps.select(F.explode(T.locations(F.col(xml))).alias("url"))
    return each.withColumn("is_sitemap", T.is_sitemap(F.col("url")))
