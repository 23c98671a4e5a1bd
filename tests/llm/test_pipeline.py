"""run() against plain versions of its stages, and stages on awkward rows."""

import zlib

import public_tokenizers

import corpus_pipeline
from phialo.llm import pii
from tests.llm.test_near_duplicates import plain as plain_components
from tests.llm.test_texts import plain_counts

SF = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import duckdb

    from phialo.llm.oracle import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op9_quality_rules']}) WHERE kept").fetchall()}
    assert all(plain_counts(docs[i])[0] >= 50 for i in good) and len(good) > 0.5 * len(docs)
    left = [i for i, _, _, kept in plain_components([(i, docs[i]) for i in sorted(good)]) if kept]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in left:
        ids = [*library.encode(pii.redact(docs[i], pii.find(docs[i])[1]), add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_stages_on_awkward_rows(spark):
    long = " ".join(f"w{k} x{k * 7}" for k in range(80))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " a@b.co", None, None, None), (None, long, "en", None, 1), (4, None, None, None, None), (5, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert [(r["doc_id"], r["text"]) for r in out.collect()] == [(1, long)]


def test_repeated_ids_with_other_texts(spark):
    """Of rows that share an id each near-duplicate group keeps one; a rejected row doesn't come back."""
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    rows = [(7, a, "en", "s", 1), (7, a + " more", "en", "s", 2), (7, b, "en", "s", 3), (3, b + " end", "en", "s", 4), (None, b, "en", "s", 5), (9, "c " + a, "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"])] == [3, 7] and out[0]["text"].split()[0] in ("a0", "b0")


def test_packing_takes_everything(spark):
    long = " ".join(f"w{k} x{k * 7}" for k in range(80))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " a@b.co", None, None, None), (None, long, "en", None, 1), (4, None, None, None, None), (5, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6
