"""Order of lines over files, splits, provenance, strict label joins, prompt selection, audits, numbering and thresholds."""

import json

import pytest
from pyspark.sql import functions as F

from quernel import queries
from quernel.operators import curate, rewards, runs
from quernel.sources import jsonl, reports
from tests.compare import same_rows
from tests.test_sources import line

NEW = "enhancement_eligible marks_in_values even_minus_copies_in_odd select_prompts_of_union jsonl_round_trip compare_runs_leniently run_integrity_whole config_diff_differing label_pairs answer_reward sequence_balance_loss ppo_loss_terms mean_response_length stratified_floor_fill stratified_round_last mix_replay diverse_round_robin resume_batches shard_by_rank".split()


@pytest.mark.parametrize("name", NEW)
def test_at_the_size_of_the_driver(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_rules_of_enhancement_each_decide(spark, sf_dir):
    got = {(r["phrase_once"], r["usable"]) for r in queries.queries()["enhancement_eligible"](spark, sf_dir).collect()}
    assert got == {(True, True), (True, False), (False, False)}
    assert queries.queries()["even_minus_copies_in_odd"](spark, sf_dir).count() < spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0").count()


def test_lines_are_numbered_in_the_order_of_paths(spark, tmp_path):
    """Not by the sizes of files, by which Spark packs them into tasks."""
    for name, n in (("a", 2), ("b", 40), ("c", 1), ("d", 9)):
        (tmp_path / f"{name}.jsonl").write_text("".join(line(f"颜色#{name}{i}") + "\n" for i in range(n)), encoding="utf-8")
    rows = jsonl.scan(spark, str(tmp_path)).orderBy("line_number").select("line_number", F.col("conversations")[1]["content"]).collect()
    want = [f"颜色#{name}{i}" for name, n in (("a", 2), ("b", 40), ("c", 1), ("d", 9)) for i in range(n)]
    assert [r[0] for r in rows] == list(range(1, 53)) and [r[1] for r in rows] == want


def test_lines_of_a_file_read_in_pieces(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(line(f"颜色#{i}") + "\n" for i in range(3000)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = jsonl.scan(spark, str(tmp_path)).orderBy("line_number").select("line_number", F.col("conversations")[1]["content"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in rows] == [(i + 1, f"颜色#{i}") for i in range(3000)]


def test_splits_by_name_and_provenance(spark, tmp_path):
    for name in ("train", "val", "test"):
        (tmp_path / f"{name}.jsonl").write_text(line() + "\n" + line() + "\n", encoding="utf-8")
    rows = jsonl.scan_splits(spark, str(tmp_path))
    assert {(r["split"], r["line_number"]) for r in rows.collect()} == {(s, n) for s in ("train", "val", "test") for n in (1, 2)}
    assert jsonl.from_source(rows).count() == 6 and jsonl.not_empty(rows) is rows
    with pytest.raises(Exception, match="the source is not other.json"):
        jsonl.from_source(rows, "other.json").select("metadata").collect()
    with pytest.raises(Exception):
        jsonl.scan_splits(spark, str(tmp_path), ("train", "missing")).collect()
    with pytest.raises(ValueError, match="no rows"):
        jsonl.not_empty(rows.limit(0), "x")


def test_labels_that_name_no_candidate_fail(spark):
    candidates = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("h", "c", 3.0)], "group_id string, candidate_id string, value double")
    labels = lambda *r: spark.createDataFrame(list(r), "group_id string, chosen_candidate_id string, rejected_candidate_ids array<string>")
    assert [tuple(r) for r in rewards.label_pairs(labels(("g", "a", ["b"])), candidates).collect()] == [("g", "a", "b", 1.0, 2.0)]
    for bad in (("g", "a", ["c"]), ("x", "a", ["b"]), ("h", "a", ["c"])):
        with pytest.raises(Exception, match="no candidate"):
            rewards.label_pairs(labels(bad), candidates).collect()


def test_prompts_of_keys_that_no_blocked_frame_has(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"]), (4, ["c"]), (5, ["d"])], "n int, k array<string>")
    blocked = [rows.where("n = 3").select("k"), rows.where("n = 4").select("k")]
    got = curate.select_prompts(rows, blocked, "k", "n", 2, 7).collect()
    assert sorted(r["n"] for r in got) == [1, 5] and len({r["group_id"] for r in got}) == 2
    with pytest.raises(ValueError, match="only 2 keys"):
        curate.select_prompts(rows, blocked, "k", "n", 3, 7)


def test_audit_report(spark):
    a = lambda *v: [("色", x) for x in v]
    rows = [(1, 0, "structured", a("红,白", "绿"), "p"), (2, 0, "natural", a("绿", "红,白"), "色为红、绿"), (3, 1, "structured", a("蓝/"), "p"), (4, 1, "natural", a("黑"), "p"), (5, 2, "natural", a("黑"), "p"), (6, 3, "structured", a("x"), "p"), (7, 3, "structured", a("x"), "p")]
    df = spark.createDataFrame(rows, "line_number int, i int, style string, attributes array<struct<key:string,value:string>>, prompt string")
    got = runs.audit_report(df, ["i"], "style", "attributes", "prompt", "line_number")
    assert got == {"rows": 7, "paired_groups": 2, "unpaired_groups": 1, "natural_multivalue_rows": 1, "structured_value_marks": {",": 1, "/": 1}, "mismatches": [[3, 4]], "ambiguous_groups": [[6, 7]]}


def test_numbers_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(6)
    assert [tuple(r) for r in curate.numbered(df, "k").orderBy("k").collect()] == [(i, i) for i in range(5000)]
    assert curate.numbered(df.limit(0), "k").count() == 0


def test_a_bound_that_is_too_low_is_noticed(spark, monkeypatch):
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in {"a": 700, "b": 90}.items() for i in range(n)], "k string, s string")
    want = sorted(curate.stratified_floor(df, "s", "k", 100, 3).collect())
    monkeypatch.setattr(curate, "_unit", lambda rank: F.lit(2.0))
    assert sorted(curate.stratified_floor(df, "s", "k", 100, 3).collect()) == want and len(want) == 100


def test_reports_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "r.json")
    reports.write_json(spark, path, {"a": 1})
    with pytest.raises(FileExistsError):
        reports.write_json(spark, path, {"a": 2})
    reports.write_json(spark, path, {"a": 3}, overwrite=True)
    assert json.load(open(path)) == {"a": 3} and not (tmp_path / "r.json.part").exists()


def test_no_score_is_looked_at_without_weight(spark):
    df = spark.range(1).select(rewards.blend_model_scores(F.lit(float("nan")), F.lit(None).cast("double"), 0).alias("r"), rewards.answer_of(F.lit("x <answer>\n 7 </answer> <answer>8</answer>")).alias("a"), rewards.answer_of(F.lit("none")).alias("n"))
    assert tuple(df.first()) == (0.0, "7", None)
