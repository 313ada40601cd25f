import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quernel.plans.storage import discard, materialize, shared_dir
from quernel.sources import jsonl
from quernel.streaming.windows import follow_log, windowed


def line(user="颜色#红", role="user", meta=True):
    row = {"conversations": [{"role": "system", "content": "s"}, {"role": role, "content": user}, {"role": "assistant", "content": "a"}]}
    return json.dumps(row | ({"metadata": {"source": "train.json", "source_index": 1}} if meta else {}), ensure_ascii=False)


def test_scan_tells_every_reject(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([line(), "", "{broken", line(user=5), line(role="tool"), line(meta=False), line(user=" 　")]), encoding="utf-8")
    got = {r["line_number"]: r["reject_reason"] for r in jsonl.scan(spark, str(path), strict=False).collect()}
    assert got[1] is None and got[2] == got[3] == "malformed json" and got[4] == "content is no text"
    assert got[5] == "wrong roles" and got[6] == "no metadata" and got[7] == "blank content" and len(got) == 7
    with pytest.raises(Exception, match="x.jsonl:[2-7]: "):
        jsonl.scan(spark, str(path)).collect()


def test_strict_scan_with_attributes_round_trips(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("﻿" + line() + "\n\n" + line("颜色#蓝*颜色#红") + "\n", encoding="utf-8")
    rows = jsonl.scan(spark, str(path), skip_blank=True)
    got = jsonl.with_attributes(rows).orderBy("line_number").collect()
    assert [r["line_number"] for r in got] == [1, 3]
    assert [tuple(a) for a in got[1]["attributes"]] == [("颜色", "蓝"), ("颜色", "红")] and [a["value"] for a in got[1]["attribute_key"]] == ["红", "蓝"]
    assert jsonl.with_attributes(rows, 1).count() == 1
    out = str(tmp_path / "out")
    jsonl.write(rows.select("conversations", "metadata"), out)
    assert jsonl.scan(spark, out, strict=False).where("reject_reason is not null").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.write(rows.select("conversations"), out)


def test_last_wins_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "h", "c")], "line_number int, group_id string, v string")
    assert {r["group_id"]: r["v"] for r in jsonl.last_by_key(df, "group_id").collect()} == {"g": "b", "h": "c"}
    (tmp_path / "f").write_bytes(b"xyz")
    assert jsonl.file_digests(spark, str(tmp_path / "f")).first()["sha256"] == hashlib.sha256(b"xyz").hexdigest()


def test_load_run(spark, tmp_path):
    def write(samples=2, status="complete", rows=2):
        (tmp_path / "summary.json").write_text(json.dumps({"status": status, "samples": samples}))
        (tmp_path / "manifest.json").write_text(json.dumps({"protocol": "new", "original_manifest": {"protocol": "old"}}))
        (tmp_path / "samples.jsonl").write_text("\n".join(json.dumps({"line_number": i, "output_metrics": {"x": 1}}) for i in range(rows)))

    write()
    manifest, samples = jsonl.load_run(spark, str(tmp_path))
    assert manifest["protocol"] == "old" and samples.count() == 2
    for bad in ({"samples": 3}, {"status": "running"}):
        write(**bad)
        with pytest.raises(ValueError):
            jsonl.load_run(spark, str(tmp_path))


def test_written_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(5), "t")
    assert df._quernel_path.startswith(shared_dir(spark)) and df.count() == 5
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._quernel_path).count()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(0, "a", 1.0), (60, "a", 3.0), (7200, "b", 5.0)], "s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in" / "t"))
    schema = "event_type string, value double, ts timestamp"
    stream = windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "t")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"], r["mean_value"]) for r in spark.table("w").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("loss:1.0\nloss:0.5\n")
    seen = []
    q = follow_log(spark, str(tmp_path / "logs"), str(tmp_path / "c2"), seen.append)
    q.awaitTermination(60)
    assert seen[0]["n"] == 2 and seen[0]["min_loss"] == 0.5
