"""Sections, cleaned text, names and answers on inline documents."""

import time

import pyarrow as pa
import pytest

from phialo.functions import batches
from phialo.functions import html as H
from phialo.operators import sections

START, END = H.Marker(H.SECTION_START), H.Marker(H.SECTION_END)


def cut(html):
    return H.section(html, START, END)


def test_details_chain():
    page = "<div class='spcWrapper'><details><summary>4.7 x</summary></details><details><summary>4.8 Undesirable effects</summary><table><tr><td>a</table></details><details><summary>4.9 Overdose</summary>z</details></div>"
    found, method, end, markup, table, lists = cut(page)
    assert (found, method, end, table, lists) == (True, "details_summary", True, True, False)
    assert markup == "<details><summary>4.8 Undesirable effects</summary><table><tr><td>a</td></tr></table></details>"
    assert cut(page.replace("4.9", "5.1"))[3].count("<details>") == 2 and not cut(page.replace("4.9", "5.1"))[2]


def test_generic_fallback():
    page = "<body><h2>4 8 adverse reactions</h2><p>one<p>two <b>x</b><ul><li>k</li></ul><h2>4.9</h2><p>z</body>"
    # unclosed paragraphs nest, so the end marker's outermost container is the first one
    assert cut(page)[1:4] == ("generic_fallback", True, "<h2>4 8 adverse reactions</h2>")
    closed = page.replace("<p>one<p>two <b>x</b>", "<p>one</p><p>two <b>x</b></p>")
    assert cut(closed)[3] == "<h2>4 8 adverse reactions</h2>\n<p>one</p>\n<p>two <b>x</b></p>\n<ul><li>k</li></ul>" and cut(closed)[5]
    before = "<body><p>4.9 Overdose</p><div><span>4.8 undesirable effects</span></div></body>"
    assert cut(before)[3] == "<div><span>4.8 undesirable effects</span></div>"


def test_no_marker_and_no_root():
    assert cut("<body><p>nothing</body>")[1] == "not_found" and cut("")[1] == "no_root" and cut("plain text")[1] == "no_root"
    long = f"<body><div>4.8 undesirable effects {'x' * 220}</div></body>"
    assert cut(long)[1] == "not_found"
    assert cut("<body><script>4.8 undesirable effects</script><!-- 4.8 undesirable effects --></body>")[1] == "not_found"


def test_markup_is_normal():
    page = H.Page("""<body><p class=" a  b " id=x>1 &lt; 2 &amp; &eacute;<br>q<img src='a"b'></p></div></body>""")
    assert page.html(page.tags[1]) == """<p class="a b" id="x">1 &lt; 2 &amp; é<br/>q<img src='a"b'/></p>"""


def test_clean_text(spark):
    html = "<table><tr><th>A</th><td>b<br>c</td></tr><tr><td>d</td></tr></table><script>x</script><p>e &amp;   f</p>\n\n\n\n<p>g</p>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    whole = [r[0] for r in sections.clean_text(df, max_chars=None).collect()]
    assert whole == ["A | b \n c | \n d | \n e & f \n\n g", None, ""]
    short = sections.clean_text(df, max_chars=9).first()[0]
    assert whole[0].startswith(short) and len(short) == 9


def test_blocks_and_log(spark):
    good = "<body><p>4.8 undesirable effects</p><table></table></body>"
    docs = spark.createDataFrame([("1", good), ("2", "<p>no"), ("3", None)], "product_id string, html string")
    manifest = spark.createDataFrame([("1", "f"), ("2", "f"), ("3", "f"), ("4", "f"), ("1", "")], "product_id string, file_name string")
    blocks, log = sections.section_blocks(manifest, docs)
    assert [(r["product_id"], r["has_table"]) for r in blocks.collect()] == [(1, True)]
    assert sorted((r["product_id"], r["status"]) for r in log.collect()) == [("1", "Failed"), ("1", "Success"), ("2", "Failed"), ("3", "Failed"), ("4", "Failed")]
    audit = sections.audit_sections(docs)
    assert {r["product_id"]: r["method"] for r in audit.collect()} == {"1": "generic_fallback", "2": "not_found", "3": "no_root"}
    assert sections.audit_summary(audit).where("kind = 'small' AND value = 'true'").first()["n"] == 3


def test_names(spark):
    fold = "<details><summary>1. Name of the medicinal product</summary><p>skip</p><div>Abc\n\n 5 mg<br>x\ny\nz</div></details>"
    head = "<h2>1 NAME OF THE MEDICINAL PRODUCT</h2> tail <p>Def</p><h2>2. Qualitative and quantitative composition</h2><p>no"
    docs = spark.createDataFrame([("1", fold), ("2", head), ("3", "<p>x")], "product_id string, html string")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "product_id string")
    got = {r["product_id"]: (r["brand_name"], r["status"]) for r in sections.drug_names(ids, docs).collect()}
    assert got == {"1": ("Abc | 5 mg x | y", "Success"), "2": ("tail Def", "Success"), "3": ("", "EmptyExtraction"), "4": ("", "Failed")}


def test_answers(spark):
    data = [(1, '```json\n{"adrs": [{"adr_term": " A ", "frequency": "Rare", "soc": null}]}\n```'), (2, "no json"), (3, '{"adrs": []}'), (4, "{}"), (5, None), (6, "[1]")]
    rows, log = sections.parse_adr_responses(spark.createDataFrame(data, "product_id int, response string"))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "A", "rare", "")]
    assert {r["product_id"]: (r["status"], r["adr_count"]) for r in log.collect()} == {1: ("Success", 1), 2: ("Failed", 0), 3: ("Success", 0), 4: ("Success", 0), 5: ("Failed", 0), 6: ("Failed", 0)}
    out = sections.parse_substance(spark.createDataFrame([(1, '{"active_substance": " Ab  C "}'), (2, "x"), (3, None)], "product_id int, response string"))
    assert [(r["active_substance"], r["status"]) for r in out.orderBy("product_id").collect()] == [("ab c", "Success"), ("", "Failed"), ("", "Failed")]
    prompt = sections.build_prompts(spark.createDataFrame([("a{b}",)], "x string"), "<{content}>", "x").first()["prompt"]
    assert prompt == "<a{b}>"


def test_registered_clean_text_is_whole(spark, tmp_path):
    from phialo.plans.registry import QUERIES

    text = " ".join(f"w{i}" for i in range(4000))
    spark.createDataFrame([(1, f"<p>{text}</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in QUERIES["x6_clean_text"](spark, str(tmp_path)).select("page_id", "text").collect()] == [(1, text)]


def nested(tag, n, inside, end=False):
    return "<body>" + f"<{tag}> " * n + inside + (f"</{tag}>" * n if end else "") + "</i>" * n


@pytest.mark.parametrize(
    "page",
    [
        nested("p", 100_000, "4.8 undesirable effects"),
        nested("div", 5_000, "<p>4.8 undesirable effects</p><p>4.9</p>", end=True),
        nested("b", 50_000, "4.8 " * 20_000),
        nested("p", 50_000, "4.8 undesirable effects" + "<h2>4.9</h2>" * 20_000),
        nested("summary", 50_000, "1 name of the medicinal products"),
        "<body><h2>4.8 undesirable effects</h2>" + "<p>same</p>" * 50_000,
    ],
)
def test_deep_and_unclosed_markup_costs_time_in_proportion(page):
    start, end = H.Marker(H.NAME_START), H.Marker(H.NAME_END)
    began = time.perf_counter()
    cut(page), H.page_text(page), H.name_section(page, start, end)
    assert time.perf_counter() - began < 15


def test_sections_of_nested_markers_are_the_first_ones():
    page = "<body><b>4.8 a <strong>undesirable effects</strong></b><h2>x <b>y</b></h2><div><b>long <i>4.9</i> text</b></div><h3>4.9</h3></body>"
    assert cut(page)[:3] == (True, "generic_fallback", True) and cut(page)[3] == "<b>4.8 a <strong>undesirable effects</strong></b>\n<h2>x <b>y</b></h2>"
    # the first marker's own tag may hold the end's
    inner = f"<body><b>4.8 undesirable effects {'x ' * 200}<strong>{'y ' * 200} 4.9</strong></b><p>z</p></body>"
    assert cut(inner)[2] and cut(inner)[3].endswith("</b>\n<p>z</p>")


def test_parts_of_a_batch_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 50, 3, 3, 200, 1)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = [p.column("t").to_pylist() for p in batches.parts(batch, "t", 60)]
    assert sum(parts, []) == texts and [sum(len(x or "") for x in p) for p in parts] == [60, 6, 200, 1]


def test_large_pages_come_in_bounded_batches(spark):
    """200 pages of 2 MB: no task holds more of them at a time than fits the batch limit."""
    pages = spark.range(200, numPartitions=1).selectExpr("id AS product_id", "concat('<body><p>4.8 undesirable effects</p><p>', repeat('word ', 400000), id, '</p>') AS html")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    try:

        def peak(rows):
            import resource

            held = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss  # KB, of this Python worker
            for batch in rows:
                held = max(held, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
                assert batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], ["kb"])

        sections_of = sections.extract_section(pages)
        assert sections_of.where("found AND method = 'generic_fallback'").count() == 200
        assert pages.mapInArrow(peak, "kb long").head()[0] < 1_000_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


@pytest.mark.parametrize("name", ["x1_page_text", "x3_sections", "x6_clean_text", "x8_drug_names", "x4_section_blocks", "a4_audit_summary"])
def test_references_that_were_cut_off_are_text(spark, tmp_path, name):
    """A page's texts may end inside a reference; the queries read it as their SQL does."""
    import duckdb

    from phialo.plans import oracles, registry

    page = """concat('<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";a(1)&&b("&quot");</script></head><body><nav><ul><li><a href="/a&b">a</a></li></ul></nav><!-- ad &quot -->',
     '<div class="ad">x &amp y &q</div><article><h1>Name &quot;a&quot; = ', ref, '</h1><p>one ', ref, '</p><p><b>two ', ref, '<br></article><footer>&copy; e &middot; f', ref, '</footer></body></html>') AS html"""
    refs = "element_at(array('&quot', '&quo', '&amp', '&am', '&', '&copy', '&middot', '&amp;quot;', '&ampquot;', '&lt;', '&#39;', '&quot;'), cast(id / 6 AS int) + 1) AS ref"
    spark.range(72).selectExpr("id AS page_id", refs).selectExpr("page_id", "concat('http://x/', page_id) AS url", page).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    rows = sorted(map(str, map(tuple, got.select(columns).collect())))
    assert len(rows) == (72 if name != "a4_audit_summary" else len(want)) and rows == sorted(map(str, want))
