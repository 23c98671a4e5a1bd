"""Files in and out."""

import json
import shutil

import pytest

from phialo.operators import fetchlog
from phialo.sources import tables


def test_ids(spark, tmp_path):
    for name, text in (("a", '{"ids": [3, "4", "x", 1.5, null]}'), ("b", '[3, "4", "x"]')):
        (tmp_path / name).write_text(text)
        assert [r["product_id"] for r in tables.read_ids(spark, str(tmp_path / name)).orderBy("seq").collect()] == [3, 4]
    compact = '{"source": "a, 7, \\"b\\"", "count": 4, "ids":[12,\n "13" , -4,"5\\""], "note": 8}'
    (tmp_path / "c").write_text(compact)
    assert [r["product_id"] for r in tables.read_ids(spark, str(tmp_path / "c")).orderBy("seq").collect()] == [12, 13, -4]
    for name, text in (("d", '{"ids": []}'), ("e", "[]")):
        (tmp_path / name).write_text(text)
        assert tables.read_ids(spark, str(tmp_path / name)).count() == 0


def whole(folder):
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


@pytest.mark.parametrize("kind,given,want", [("long", [5, 2, 5, None, 10], [2, 5, 10]), ("string", ["b", 'a"', "b", None], ['a"', "b"]), ("long", [], [])])
def test_id_lists_are_one_value(spark, tmp_path, kind, given, want):
    tables.write_ids(spark.createDataFrame([(x,) for x in given], f"product_id {kind}"), str(tmp_path / "out"), 'he"re')
    assert whole(tmp_path / "out") == {"source": 'he"re', "count": len(want), "ids": want}


def test_many_ids_are_written_and_read_by_many_tasks(spark, tmp_path):
    n = 2_000_000
    ids = spark.range(n).selectExpr("id * 7919 % 20000003 AS product_id")
    tables.write_ids(ids, str(tmp_path / "out"))
    parts = [p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size > 1000]
    assert len(parts) > 1 and max(p.stat().st_size for p in parts) < 0.8 * sum(p.stat().st_size for p in parts)
    back = tables.read_ids(spark, str(tmp_path / "out"))
    assert back.select("product_id").exceptAll(ids).count() == 0 and back.count() == n
    assert back.orderBy("seq").select("product_id").limit(3).collect() == ids.orderBy("product_id").limit(3).collect()
    assert "collect_set" not in back._jdf.queryExecution().toString()


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿a,b\n"x, ""y""",1,extra\n,2\n')
    got = tables.read_table(spark, str(tmp_path / "t.csv"), ["a", "b"], ordered=True).orderBy("seq").collect()
    assert [(r["a"], r["b"]) for r in got] == [('x, "y"', "1"), ("", "2")]
    assert tables.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    tables.write_table(spark.createDataFrame([("q", None)], "a string, b string"), str(tmp_path / "o"), "csv")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "o")).collect()] == [("q", "")]


def test_fetch_log(spark, tmp_path):
    (tmp_path / "old.csv").write_text("Product_ID,Status,Timestamp\n1,Success,t\n2,404,t\n3,Error,t\n4,other,t\n")
    log = tables.read_fetch_log(spark, str(tmp_path / "old.csv"))
    assert [(r["status"], r["http_status"], r["attempt_count"]) for r in log.orderBy("product_id").collect()] == [("SUCCESS", "", "0"), ("HTTP_404", "404", "0"), ("HTTP_ERROR", "", "0"), ("OTHER", "", "0")]
    assert tables.read_fetch_log(spark, str(tmp_path / "old.csv"), "").first()["duration_ms"] == ""
    assert [r[0] for r in tables.failed_ids(log).collect()] == ["2"] and [r[0] for r in tables.failed_ids(log, "retry").collect()] == ["3"]
    assert fetchlog.log_summary(log).first()["errors"] == 2
    empty = fetchlog.log_summary(log.where("false")).first()
    assert (empty["total"], empty["success_rate"], empty["avg_duration_ms"]) == (0, 0.0, 0.0)
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_fetch_log(spark, str(tmp_path / "bad.csv"))


def test_a_folder_with_both_forms_of_the_log(spark, tmp_path):
    logs = tmp_path / "all logs"
    logs.mkdir()
    head = ",".join(tables.LOG_COLUMNS)
    (logs / "new.csv").write_text("\ufeff" + head + "\n" + 't1,1,"http://x/?a=1,2",SUCCESS,200,,1,5,f.html\n')
    (logs / "old.csv").write_text("Product_ID,Status,Timestamp\n2,404,t2\n3, Success ,t3\n")
    (logs / "newer.csv").write_text(head + "\n" + "".join(f"t{i},{i},,REQUEST_ERROR,,Timeout,x,,\n" for i in range(4, 2004)))
    (logs / "empty.csv").write_text("")
    got = {r["product_id"]: r for r in tables.read_fetch_log(spark, str(logs), "").collect()}
    assert len(got) == 2003 and (got["1"]["url"], got["1"]["timestamp"]) == ("http://x/?a=1,2", "t1")
    assert (got["2"]["status"], got["2"]["timestamp"], got["2"]["duration_ms"]) == ("HTTP_404", "t2", "") and got["3"]["status"] == "SUCCESS"
    (logs / "zz.csv").write_text("Product_ID,Status\n1,Success\n")
    with pytest.raises(ValueError, match="zz.csv"):
        tables.read_fetch_log(spark, str(logs))
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text("")
    assert tables.read_fetch_log(spark, str(empty)).count() == 0


def test_a_log_by_day_is_pruned(spark, tmp_path):
    rows = [(f"2024-01-{d:02} 0{h}:00:00", str(d), "SUCCESS") for d in range(1, 20) for h in range(3)] + [("x", "99", "SUCCESS"), (None, "98", "SUCCESS")]
    log = spark.createDataFrame(rows, "timestamp string, product_id string, status string")
    tables.write_log(fetchlog.by_day(log), str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    since = fetchlog.log_since(stored, "2024-01-10 01:00:00")
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert since.count() == fetchlog.log_since(log, "2024-01-10 01:00:00").count() == 29
    assert stored.where("day IS NULL").count() == 2


def test_resumed_results_lose_and_repeat_nothing(spark, tmp_path):
    from phialo.sources import resume

    asked = spark.createDataFrame([(str(i), f"brand{i % 40}") for i in range(200)], "product_id string, brand_name string")
    put = []

    def work(questions, fails_at=None):
        if fails_at is not None and len(put) == fails_at:
            raise OSError("the service went away")
        put.append([r[0] for r in questions.collect()])
        return questions.selectExpr("brand_name", "upper(brand_name) AS active_substance", "CASE WHEN brand_name = 'brand7' THEN 'Failed' ELSE 'Success' END AS status")

    path = str(tmp_path / "out")
    with pytest.raises(OSError):
        resume.resume(asked, path, lambda q: work(q, 3), parts=6)
    # rows of a part without its marker don't count
    spark.createDataFrame([("1", "brand1", "TORN", "Success", 1, 5)], "product_id string, brand_name string, active_substance string, status string, run int, part int").write.partitionBy("run", "part").mode("append").parquet(path + "/rows")
    first = {x for some in put for x in some}
    assert len(put) == 3 and resume.read_results(spark, path).count() == sum(int(f"brand{i % 40}" in first) for i in range(200))
    got = resume.resume(asked, path, work, parts=6).collect()
    assert sorted(r["product_id"] for r in got) == sorted(str(i) for i in range(200)) and all(r["active_substance"] != "TORN" for r in got)
    assert {r["product_id"] for r in got if r["status"] == "Skipped"} == {str(i) for i in range(200) if f"brand{i % 40}" in first - {"brand7"}}
    # each brand was put once in all, but for the one that failed
    every = [x for some in put for x in some if x != "brand7"]
    assert len(every) == len(set(every)) == 39
    put.clear()
    third = resume.resume(asked, path, work, parts=6)
    assert [x for some in put for x in some] == ["brand7"] and third.count() == 200 and third.where("status = 'Failed'").count() == 5


def test_documents(spark, tmp_path):
    (tmp_path / "smpc_7.html").write_bytes(b"<p>\xff ok")
    (tmp_path / "other.html").write_text("x")
    row = tables.document_manifest(spark, str(tmp_path)).collect()
    assert [(r["product_id"], r["file_name"], r["file_size_bytes"]) for r in row] == [("7", "smpc_7.html", 7)]
    assert tables.read_documents(spark, str(tmp_path)).first()["html"] == "<p>� ok"


def test_stream_matches_batch(spark, tmp_path):
    from phialo.streaming.fetchlog import status_windows

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = status_windows(stream, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = sorted(map(tuple, spark.table("windows").collect()))
    finally:
        query.stop()
    assert got == sorted(map(tuple, status_windows(batch.withColumn("ts", batch["ts"].cast("timestamp")), "ts", "event_type").collect()))
