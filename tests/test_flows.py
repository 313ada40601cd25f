import pytest
from pyspark.sql import functions as F

from quernel.operators import flows, protocol, rewards
from quernel.sources import jsonl, reports

KIND = "line_number long, conversations array<struct<role:string,content:string>>, metadata struct<source:string,source_index:bigint,input_style:string>"


def row(n, prompt, answer, style="structured"):
    return (n, [("system", "s"), ("user", prompt), ("assistant", answer)], ("train.json", n, style))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def test_prepare(spark):
    train = frame(spark, row(1, "颜色#红", "a"), row(2, "颜色#红 ", "a"), row(3, "颜色#蓝", "b", None), row(4, "颜色#绿", "c"))
    val = frame(spark, row(1, "颜色#黑", "d"), row(2, "颜色#白", "e"), row(3, "颜色#白", "e"))
    test = frame(spark, row(1, "颜色#黑", "d"))
    clean, report = flows.prepare(train, val, test, smoke=2)
    assert [r["line_number"] for r in clean["train"].orderBy("line_number").collect()] == [1, 3, 4]
    assert report["removed"] == {"train_duplicates": 1, "val_duplicates": 1, "test_duplicates": 0, "val_in_test": 1}
    assert report["clean_counts"] == {"train": 3, "val": 1, "test": 1, "smoke": 2} and report["style_counts"]["train"] == {"structured": 2, "unknown": 1}
    with pytest.raises(ValueError, match="share"):
        flows.prepare(train, val, train)


def test_enhancement_and_mix(spark):
    good = [row(i, f"类型#裙*颜色#色{i}", f"裙子是色{i}，第{i}款") for i in range(1, 6)]
    rows = frame(spark, *good, row(6, "类型#裙*颜色#紫", "裙子"), row(7, "坏", "裙"), row(8, "类型#裤", "裤 穿着舒适 穿着舒适"), row(9, "类型#裤", "裤好看好看好看"))
    phrase, chosen, report = flows.enhancement(rows, target=4)
    assert report["rows"] == 9 and report["eligible"] == 5 and report["selected"] == 4 and [e["line_number"] for e in report["errors"]] == [7]
    assert phrase.count() == 7 and report["kinds"] == [["裙", 4]]
    out, told = flows.mixed(chosen, rows, 3)
    assert told["parts"] == {"enhancement": 4, "replay": 3} and out.count() == 7
    again, _ = flows.mixed(chosen.repartition(3), rows.repartition(2), 3)
    assert [r["row_key"] for r in again.collect()] == [r["row_key"] for r in out.collect()]
    with pytest.raises(ValueError, match="duplicates"):
        flows.mixed(chosen.unionByName(chosen), rows, 1)


def test_run_rescore_compare_round_trip(spark, tmp_path):
    rows = jsonl.with_attributes(frame(spark, row(1, "类型#裙*颜色#红", "红裙"), row(2, "类型#裤", "长裤", "natural")))
    outputs = spark.createDataFrame([(1, "裙裙", [5, 6, 2]), (2, "鞋", [5, 5])], "line_number long, output string, token_ids array<int>")
    samples, summary = flows.evaluate(rows, outputs, eos=2)
    out = summary["overall"]["output_metrics"]
    assert summary["samples"] == 2 and out["literal_coverage"] == {"mean": 0.25, "n": 2} and out["literal_coverage_micro"] == pytest.approx(1 / 3) and out["eos_normal"]["mean"] == 0.5
    assert summary["by_input_style"]["natural"]["reference_metrics"]["literal_coverage"]["mean"] == 1.0
    assert [r["m"]["token_length"] for r in samples.orderBy("line_number").select(F.col("output_metrics").alias("m")).collect()] == [2, 2]
    path = str(tmp_path / "run")
    flows.write_run(spark, path, samples, summary, {"protocol": "p", "original_manifest": {"seed": 1}})
    manifest, back = jsonl.load_run(spark, path)
    assert manifest == {"seed": 1} and reports.read_json(spark, f"{path}/summary.json")["samples"] == 2 and back.count() == 2
    with pytest.raises(FileExistsError):
        flows.write_run(spark, path, samples, summary, {})
    stale = samples.withColumn("output_metrics", F.col("output_metrics").withField("attribute_hits", F.lit(9).cast("long")))
    fresh = flows.rescored(stale)
    assert sorted(map(str, fresh.select("output_metrics").collect())) == sorted(map(str, samples.select("output_metrics").collect()))
    paired, report = flows.compare(samples, stale)
    assert report["compared_samples"] == 2 and report["left_only"] == 0 and report["left"]["overall"]["literal_coverage"]["mean"] == 0.25
    with pytest.raises(Exception, match="inputs differ"):
        flows.compare(samples, stale.withColumn("reference", F.lit("x")))
    text = reports.table({"output": out}, ("literal_coverage",))
    assert "literal_coverage | 25.00% (n=2)" in text and "key_literal_coverage | " in text


def test_candidates(spark):
    kind = "group_id string, attributes array<struct<key:string,value:string>>, candidates array<struct<candidate_id:string,text:string,content_token_ids:array<int>,eos_normal:boolean>>"
    df = spark.createDataFrame([("g", [("类型", "裙")], [("g-1", "裙", [1], True), ("g-2", "裤", None, None)])], kind)
    scored, rollup = flows.evaluate_candidates(df)
    assert {r["candidate_id"]: r["metrics"]["literal_coverage"] for r in scored.collect()} == {"g-1": 1.0, "g-2": 0.0}
    assert {(r["level"], r["mean"]) for r in rollup.where("metric = 'literal_coverage'").collect()} == {("overall", 0.5), ("group", 0.5)}
    for bad, why in (([("g-1", "x", None, None)], "fewer"), ([("g-1", "x", None, None)] * 2, "repeat")):
        with pytest.raises(Exception, match=why):
            flows.evaluate_candidates(spark.createDataFrame([("g", [("类型", "裙")], bad)], kind))


def test_manifest_protocol_and_masks(spark, tmp_path):
    m = reports.Manifest(spark, str(tmp_path / "m.json"), seed=1)
    m.advance("running")
    m.advance("complete", rows=3)
    assert reports.read_json(spark, m.path) == {"status": "complete", "seed": 1, "rows": 3}
    with pytest.raises(ValueError):
        m.advance("running")
    with pytest.raises(FileExistsError):
        reports.Manifest(spark, m.path)
    assert protocol.settings("length256")["max_new_tokens"] == 256 and protocol.settings()["max_new_tokens"] == 96
    protocol.check_arguments("val", 20, "greedy", "run")
    for bad in (("test", 20, "greedy"), ("val", 30, "greedy"), ("val", -1), ("val", 0, "none", "a/b"), ("val", 0, "none", "..")):
        with pytest.raises(ValueError):
            protocol.check_arguments(*bad)
    df = spark.createDataFrame([([5, 2, 2], [1.0, 2.0, 3.0], [1, 1, 0]), ([5, 5], [1.0, 2.0], [0, 0])], "ids array<int>, v array<double>, m array<int>").coalesce(1)
    got = df.select(rewards.upto_eos(F.col("ids"), 2), rewards.last_kept(F.col("v"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [([1, 1, 0], 2.0), ([1, 1], None)]
