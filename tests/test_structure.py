"""Sections by joins of ranges against the walk."""

import random

from phialo.functions import html as H
from phialo.operators import sections, structure

TAGS = "p div b strong span h2 h1 summary details section article table ul li br td i".split()
WORDS = ["4.8", "4. 8", "Undesirable effects", "adverse\nreactions", "4.9", "4 9 overdose", "x", "\n ", " ", "word " * 60, "&amp;", "é", "🙂"]


def page(pick):
    out = [pick.choice(["<body>", "<div class='a spcWrapper'>", "", "<html><body>"])]
    for _ in range(pick.randint(1, 40)):
        k = pick.random()
        if k < 0.4:
            out.append(f"<{pick.choice(TAGS)}>")
        elif k < 0.6:
            out.append(f"</{pick.choice(TAGS)}>")
        elif k < 0.64:
            out.append("<details><summary>4.8 undesirable effects</summary>")
        elif k < 0.68:
            out.append("</details><details><summary>4.9</summary>")
        elif k < 0.72:
            out.append("<!-- c --><script>4.9</script>")
        else:
            out.append(pick.choice(WORDS))
    return "".join(out)


def both(spark, pages):
    docs = spark.createDataFrame([(i, h, "x") for i, h in enumerate(pages)], "product_id long, html string, method string").repartition(3)
    columns = ["product_id", *H.SECTION_COLUMNS]
    got = {r["product_id"]: tuple(r) for r in structure.sections(docs).select(columns).collect()}
    want = {r["product_id"]: tuple(r) for r in sections.extract_section(docs).select(columns).collect()}
    return got, want


def test_sections_equal_the_walk(spark):
    pick = random.Random(11)
    pages = [page(pick) for _ in range(1500)] + ["", None, "plain text", "<p>4.8 undesirable effects", "<b>" * 300 + "4.8 undesirable effects" + "<i>4.9"]
    got, want = both(spark, pages)
    assert got.keys() == want.keys() and [(i, pages[i], got[i], want[i]) for i in got if got[i] != want[i]] == []
    assert {r[2] for r in got.values()} == {"details_summary", "generic_fallback", "not_found", "no_root"}


def test_a_page_of_many_nested_markers(spark):
    many = "<body>" + "<b>4.8 " * 3000 + "undesirable effects" + "</b>" * 1500 + "<h2>4.9</h2>" * 500
    got, want = both(spark, [many])
    assert got == want


def test_no_pages(spark):
    assert structure.sections(spark.createDataFrame([], "product_id long, html string")).count() == 0
