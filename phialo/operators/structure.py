"""Pages as tables: their tags as rows with ranges, and sections by joins on these.

A walk numbers a page's tags in document order and gives each its range: ``node`` to ``last``
of tags, ``a`` to ``b`` of the page's text in one line, ``x`` to ``y`` of its markup's bytes.
An ancestor's range holds its descendants', so markers, climbing and siblings are conditions
on ranges.  ``sections`` gives what the walk of ``phialo.functions.html`` gives.

Places of a marker are found once in a page's line.  Whether a tag holds one is a sweep over
places (the next marker behind a tag's start ends before the tag's end), not a search of its
text, so nested tags cost nothing extra.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phialo import scratch
from phialo.functions import html as H
from phialo.functions import text as T
from phialo.functions.batches import map_documents

NODE = "node int, last int, parent int, name string, spc boolean, a int, b int, x int, y int"
PAGE = f"markup binary, line string, nodes array<struct<{', '.join(c.replace(' ', ':') for c in NODE.split(', '))}>>"


def of_doc(value: Column) -> Column:
    """An aggregate over a doc's tags; they are one task's, as the page itself is."""
    return value.over(Window.partitionBy("doc"))


def _nodes(html: str) -> tuple[bytes, str, list[tuple]]:
    page = H.Page(html)
    out = [piece.encode("utf-8", "replace") for piece in page.out]
    upto = [0]
    for piece in out:
        upto.append(upto[-1] + len(piece))
    rows = [(t.node, t.last_node, t.parent.node, t.name, "spcWrapper" in t.classes, *page.span(t), upto[t.first_out], upto[t.last_out]) for t in page.tags]
    return b"".join(out), " ".join(page.lines), rows


def page_tables(docs: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Stored pages (doc, row, markup, line) and their tags (doc, NODE); ``row`` has the other columns of ``docs``."""
    own = docs.select(F.struct(*[c for c in docs.columns if c != html], F.lit(0).alias("_")).alias("row"), F.col(html).alias("html"))
    walked = map_documents(own, "html", StructType.fromDDL(PAGE), lambda: _nodes)
    held = scratch.table(walked.withColumn("doc", F.monotonically_increasing_id()), "pages")
    return held.drop("nodes"), held.select("doc", F.inline("nodes"))


def places(pages: DataFrame, pattern: str) -> DataFrame:
    """(doc, s, e) of all matches in the pages' lines: gaps and matches added up."""
    p = rf"(?iU){pattern}"
    found = pages.where(F.col("line").rlike(p)).select("doc", F.posexplode(F.arrays_zip(F.split("line", p).alias("gap"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("hit"))).alias("i", "z"))
    upto = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = found.withColumn("e", F.sum(F.length("z.gap") + F.coalesce(F.length("z.hit"), F.lit(0))).over(upto))
    return ends.where("z.hit IS NOT NULL").select("doc", (F.col("e") - F.length("z.hit")).cast("int").alias("s"), F.col("e").cast("int").alias("e"))


def behind(rows: DataFrame, at: str, marks: DataFrame, out: str) -> DataFrame:
    """``rows`` with the end of the next mark (doc, s, e) that begins at ``at`` or later, by a sweep."""
    events = rows.select("doc", F.struct(*rows.columns).alias("r"), F.col(at).alias("at"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("e"))
    events = events.unionByName(marks.select("doc", F.col("s").alias("at"), F.lit(0).alias("late"), "e"), allowMissingColumns=True)
    sweep = Window.partitionBy("doc").orderBy(F.desc("at"), "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("next", F.min("e").over(sweep)).where("r IS NOT NULL").select("r.*", F.col("next").alias(out))


def marker_places(pages: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """(doc, s, e): from each match of the first part to the nearest end of the others behind it, in order."""
    marks = places(pages, parts[-1])
    for part in reversed(parts[:-1]):
        marks = behind(places(pages, part), "e", marks, "z").where("z IS NOT NULL").select("doc", "s", F.col("z").alias("e"))
    return marks


def _at(node: Column, column: str) -> Column:
    """A column of the doc's tag with this number."""
    return of_doc(F.max(F.when(F.col("node") == node, F.col(column))))


def marked(pages: DataFrame, nodes: DataFrame, start: tuple[str, ...], end: tuple[str, ...]) -> DataFrame:
    """``nodes`` with their page's root, first marker and end marker (tag numbers), and whether each holds one."""
    rows = behind(nodes, "a", marker_places(pages, start), "start_end")
    rows = behind(rows, "a", marker_places(pages, end), "end_end")
    rank = F.when((F.col("name") == "div") & F.col("spc"), 0).when(F.col("name") == "body", 1).when(F.col("node") == 0, 2).otherwise(3)
    rows = rows.withColumn("root", of_doc(F.min(F.struct(rank.alias("rank"), "node", "last"))))
    long_ = F.col("name").isin(*H.SHORT_TAGS) & (F.col("b") - F.col("a") > H.SHORT)
    inside = (F.col("node") > F.col("root.node")) & (F.col("node") < F.col("root.last"))
    rows = rows.withColumn("may", inside & F.col("name").isin(*H.MARKER_TAGS) & (F.col("b") > F.col("a")) & ~long_)
    holds = lambda c: F.col("may") & (F.col(c) <= F.col("b"))
    rows = rows.withColumn("first", of_doc(F.min(F.when(holds("start_end"), F.col("node")))))
    return rows.withColumn("final", of_doc(F.min(F.when(holds("end_end") & (F.col("node") > F.col("first")), F.col("node")))))


def climbed(rows: DataFrame, of: str, out: str) -> DataFrame:
    """``rows`` with the outermost tag reached from tag ``of`` by climbing: the highest of its ancestors below the first that stops it."""
    above = (F.col("node") <= F.col(of)) & (F.col(of) < F.col("last"))
    stops = above & (F.col("node") < F.col(of)) & ((F.col("node") == F.col("root.node")) | ~F.col("name").isin(*H.CLIMBED))
    rows = rows.withColumn("_stop", F.coalesce(of_doc(F.max(F.when(stops, F.col("node")))), F.lit(-1)))
    return rows.withColumn(out, of_doc(F.min(F.when(above & (F.col("node") > F.col("_stop")), F.col("node"))))).drop("_stop")


def same_places(pages: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, what, place) of ``asked`` (doc, what, parent, tag): the first child of the parent that is the tag or has its markup."""
    t = nodes.select("doc", F.col("node").alias("tag"), F.col("name").alias("_name"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    alike = asked.join(t, ["doc", "tag"]).join(nodes.select("doc", "parent", "node", "name", "x", "y"), ["doc", "parent"]).where("node = tag OR (name = _name AND y - x = _y - _x)")
    piece = lambda x, y: F.expr(f"substring(markup, {x} + 1, {y} - {x})")
    known = alike.where("node = tag").select("doc", "what", "node")
    others = alike.where("node <> tag").join(pages.select("doc", "markup"), "doc").where(piece("x", "y") == piece("_x", "_y")).select("doc", "what", "node")
    return known.unionByName(others).groupBy("doc", "what").agg(F.min("node").alias("place"))


def sections(docs: DataFrame, html: str = "html", start: tuple[str, ...] = H.SECTION_START, end: tuple[str, ...] = H.SECTION_END) -> DataFrame:
    """X3 by joins: ``docs`` without the markup, with found, method, end_found, content_html, has_table, has_list."""
    pages, nodes = page_tables(docs, html)
    rows = marked(pages, nodes, start, end)
    rows = climbed(climbed(rows, "first", "box"), "final", "end_box")
    for side in ("first", "final"):
        rows = rows.withColumns({f"{side}_name": _at(F.col(side), "name"), f"{side}_in": _at(F.col(side), "parent")})
        rows = rows.withColumn(f"{side}_folded", F.coalesce((F.col(f"{side}_name") == "summary") & (_at(F.col(f"{side}_in"), "name") == "details"), F.lit(False)))
    rows = rows.withColumns({"fold_in": _at(F.col("first_in"), "parent"), "box_in": _at(F.col("box"), "parent"), "n": of_doc(F.max("last"))})
    one = rows.where("node = first").select("doc", "final", "box", "end_box", "first_in", "final_in", "first_folded", "final_folded", "fold_in", "box_in", "n")
    one = scratch.table(one, "sections")
    ask = lambda what, parent, tag, when: one.where(when).select("doc", F.lit(what).alias("what"), F.col(parent).alias("parent"), F.col(tag).alias("tag"))
    asked = [
        ask("fold_a", "fold_in", "first_in", "first_folded"), ask("fold_z", "fold_in", "final_in", "first_folded AND final_folded"),
        ask("box_a", "box_in", "box", "true"), ask("box_z", "box_in", "end_box", "end_box IS NOT NULL"),
    ]
    at = same_places(pages, nodes, reduce(DataFrame.unionByName, asked)).groupBy("doc").pivot("what", ["fold_a", "fold_z", "box_a", "box_z"]).agg(F.min("place"))
    picks = one.join(at, "doc")
    folded = F.col("fold_a").isNotNull() & (F.col("fold_z").isNull() | (F.col("fold_z") > F.col("fold_a")))
    alone = F.col("box_z") <= F.col("box_a")
    picks = picks.select(
        "doc", F.when(folded, "details_summary").otherwise("generic_fallback").alias("method"), F.col("final").isNotNull().alias("end_found"),
        F.when(folded, F.col("fold_in")).otherwise(F.col("box_in")).alias("parent"),
        F.when(folded, F.col("fold_a")).when(alone, F.col("box")).otherwise(F.col("box_a")).alias("from"),
        # up to the end's place, to the box's own end, or to the end of all siblings
        F.when(folded, F.col("fold_z")).when(alone, F.col("box") + 1).otherwise(F.col("box_z")).alias("until"),
    )
    picks = scratch.table(picks, "picks")
    chosen = nodes.join(picks, ["doc", "parent"]).where("node >= from AND (until IS NULL OR node < until)")
    parts = chosen.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("parts"), F.max("last").alias("to"))
    inner = nodes.join(picks.join(parts.select("doc", "to"), "doc"), "doc").where("node >= from AND node < to")
    kinds = inner.groupBy("doc").agg(F.max(nodes["name"] == "table").alias("has_table"), F.max(nodes["name"].isin("ul", "ol")).alias("has_list"))
    cut = F.expr("get(transform(array(markup), m -> transform(parts, p -> cast(substring(m, p.x + 1, p.y - p.x) AS string))), 0)")
    empty = nodes.groupBy("doc").agg(F.lit(True).alias("tags"))
    out = pages.join(empty, "doc", "left").join(picks.select("doc", "method", "end_found"), "doc", "left").join(parts, "doc", "left").join(kinds, "doc", "left")
    method = F.coalesce("method", F.when(F.col("tags"), "not_found").otherwise("no_root"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != html and c not in H.SECTION_COLUMNS]
    return out.select(
        *kept,
        F.col("method").isNotNull().alias("found"),
        method.alias("method"),
        F.coalesce("end_found", F.lit(False)).alias("end_found"),
        F.coalesce(T.strip(F.array_join(cut, "\n")), F.lit("")).alias("content_html"),
        F.coalesce("has_table", F.lit(False)).alias("has_table"),
        F.coalesce("has_list", F.lit(False)).alias("has_list"),
    )
