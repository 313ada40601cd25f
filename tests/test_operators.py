import math

import pytest
from pyspark.sql import functions as F

from quernel.functions import attributes as A
from quernel.functions.text import strip
from quernel.operators import curate, hooks, logs, metrics, rewards, runs


def test_roll_up_tells_macro_from_micro_and_null_from_zero(spark):
    df = spark.createDataFrame([("红", [("色", "红")], "x"), ("绿", [("色", "红"), ("鞋", "靴")], None)], "t string, a array<struct<key:string,value:string>>, style string")
    rows = {(r["level"], r["style"], r["metric"]): (r["mean"], r["n"]) for r in metrics.aggregate(df.select("style", A.score(F.col("t"), F.col("a")).alias("metrics")), by=["style"]).collect()}
    assert rows["overall", None, "literal_coverage"] == (0.5, 2)
    assert rows["overall", None, "literal_coverage_micro"][0] == pytest.approx(1 / 3)
    assert rows["overall", None, "key_literal_coverage"] == (None, 0) and rows["overall", None, "eos_normal"] == (None, 0)
    assert rows["group", None, "samples"] == (None, 1) and rows["group", "x", "literal_coverage"] == (1.0, 1)
    none = {r["metric"]: (r["mean"], r["n"]) for r in metrics.aggregate(df.limit(0).select(A.score(F.col("t"), F.col("a")).alias("metrics"))).collect()}
    assert none["samples"] == (None, 0) and none["literal_coverage_micro"] == (None, 0)
    assert metrics.format_metric(None, True) == "not applicable" and metrics.format_metric(0.5, True) == "50.00%"


def test_dedup_keeps_the_first_by_order_not_by_value(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b "), (2, " a　"), (4, "b")], "n int, t string")
    assert {r["n"] for r in curate.dedup_first(df, strip(F.col("t")), "n").collect()} == {1, 2}


def test_exclude_and_overlaps(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "b"), ("test", "c")], "s string, k string")
    left = curate.exclude(df.where("s = 'train'"), df.where("s = 'val'"), F.col("k"), F.col("k"))
    assert [r["k"] for r in left.collect()] == ["a"]
    got = {(r[0], r[1]): tuple(r)[2:] for r in curate.overlap_counts(df, "s", "k", ("train", "val", "test")).collect()}
    assert got["train", "val"] == (1, 1, 0) and got["val", "test"] == (0, 1, 1)


def strata(spark, sizes):
    return spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "k string, s string")


def counts(df):
    return {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}


def test_stratified_samples(spark):
    df = strata(spark, {"a": 5, "b": 3, "c": 2})
    assert counts(curate.stratified_floor(df, "s", "k", 10, 1)) == {"a": 5, "b": 3, "c": 2}
    got = curate.stratified_floor(df, "s", "k", 7, 1)
    assert got.count() == 7 and all(counts(got)[s] >= n for s, n in {"a": 3, "b": 2, "c": 1}.items())
    assert sorted(got.collect()) == sorted(curate.stratified_floor(df.repartition(3), "s", "k", 7, 1).collect())
    with pytest.raises(ValueError):
        curate.stratified_floor(df, "s", "k", 11, 1)
    # halves round to even: 2.5 -> 2, 1.5 -> 2, and the last takes the rest
    assert counts(curate.stratified_round(df, "s", "k", 5, 1)) == {"a": 2, "b": 2, "c": 1}
    assert curate.stratified_round(df, "s", "k", 10, 1).count() == 10
    with pytest.raises(Exception, match="too small"):
        # quotas 0.5, 0.5, ... round to nothing, so one row cannot be enough for the last
        curate.stratified_round(strata(spark, {f"s{i}": 1 for i in range(6)}), "s", "k", 3, 1).collect()


def test_round_robin_agrees_with_queues(spark):
    from collections import defaultdict
    import hashlib
    import random

    rng = random.Random(5)
    rows = [(f"k{i}", rng.choice("ABC"), rng.choice("xyz")) for i in range(40)]
    pools = defaultdict(lambda: defaultdict(list))
    for k, s, t in rows:
        pools[s][t].append(k)
    turns = {}
    for s, by in pools.items():
        lists = [sorted(v, key=lambda k: hashlib.sha256(f"2:{k}".encode()).hexdigest()) for _, v in sorted(by.items(), key=lambda x: (len(x[1]), x[0]))]
        turns[s] = [v[i] for i in range(max(map(len, lists))) for v in lists if i < len(v)]
    order = sorted(turns, key=lambda s: (len(turns[s]), s))
    want = [turns[s][i] for i in range(40) for s in order if i < len(turns[s])]
    df = spark.createDataFrame(rows, "k string, s string, t string")
    for target in (7, 40, 99):
        assert [r["k"] for r in curate.choose_diverse(df, "s", "t", "k", target, 2).collect()] == want[:target]


def test_validity(spark):
    kind = "m array<struct<role:string,content:string>>"
    good = [("system", "a"), ("user", "b"), ("assistant", "c")]
    rows = [good, good[:2], [good[1], good[0], good[2]], [good[0], ("user", "　"), good[2]], [good[0], ("user", None), good[2]], None, []]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], kind).coalesce(1).select(curate.reject_reason(F.col("m"))).collect()]
    assert got[0] is None and all(got[1:])


def test_skip_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    assert [r["n"] for r in curate.skip_batches(df, "n", 4, 1).orderBy("n").collect()] == list(range(4, 10))
    assert curate.skip_batches(df, "n", 4, 3).count() == 0


def test_pair_runs_refuses_different_inputs(spark):
    l = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "n int, q string, o int")
    r = spark.createDataFrame([(2, "b", 7), (3, "c", 8)], "n int, q string, o int")
    assert runs.pair_runs(l, r, "n", ["q"]).select("n", "left_o", "right_o").collect() == [(2, 6, 7)]
    other = r.withColumn("q", F.lit("z"))
    with pytest.raises(Exception, match="inputs differ at 2"):
        runs.pair_runs(l, other, "n", ["q"]).collect()
    assert runs.pair_runs(l, other, "n", ["q"], strict=False).first()["mismatch"]


def test_maps_and_integrity(spark):
    l = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", None)], "r int, key string, value string")
    r = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (1, "d", "w")], "r int, key string, value string")
    assert {x["key"]: x["status"] for x in runs.compare_maps(l, r, "r").collect()} == {"a": "same", "b": "different", "c": "unknown", "d": "unknown"}
    one = runs.integrity(l, "key", "value", 3).first()
    assert one["unique"] and not one["complete"] and one["as_declared"]


def test_advantage_without_variance(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "b", 0.0), (4, "b", 1.0)], "i int, g string, r double")
    got = {r["i"]: r["advantage"] for r in rewards.group_advantage(df, "g", "r").collect()}
    assert got[1] == got[2] == pytest.approx(0) and got[4] == pytest.approx(-got[3])


def test_format_reward(spark):
    full = "<think>\na\n</think>\n<answer>\nb\n</answer>"
    rows = [full, full.replace("</think>\n", "</think>\n\n"), full + "<think>", "x", full.replace("\na\n", "\n<think>\n")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").coalesce(1).select(rewards.format_reward(F.col("t"))).collect()]
    assert got == [1.5, 1.5, 0.75, 0.0, 1.25]


def test_losses_survive_large_arguments(spark):
    df = spark.createDataFrame([(800.0, 0.0), (-800.0, 0.0), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.coalesce(1).select(rewards.dpo_loss(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), 10.0)).collect()]
    assert got == [0.0, pytest.approx(8000.0), pytest.approx(math.log(2))]
    with pytest.raises(Exception, match="not finite"):
        df.select(rewards.blend_model_scores(F.lit(float("nan")), F.lit(None).cast("double"), 1.0)).collect()


def test_fit_pairwise_learns_the_sign(spark):
    df = spark.createDataFrame([(i, [1.0, -0.5] if i % 4 else [0.5, 0.5]) for i in range(40)], "n int, diff array<double>")
    fitted = rewards.fit_pairwise(df, "n")
    assert fitted["weights"][0] > 0 and fitted["train_pairs"] == 32 and fitted["val_accuracy"] == 1.0


def test_logs(spark):
    lines = spark.createDataFrame([(i, f"Epoch:[1/1]({i}/9) loss:{1.0 - i / 100:.3f} lr:1 val loss:0.5" if i == 3 else f"loss:{1.0 - i / 100:.3f}") for i in range(1, 50)] + [(50, "no number")], "line_number int, value string")
    s = logs.summarize(logs.losses(lines)).first()
    assert s["n"] == 50 and s["trend"] == "falling" and s["min_loss"] == 0.5
    assert logs.summarize(logs.losses(lines.limit(0))).first()["n"] == 0


def test_hooks(spark):
    rows = [("g", [("system", "s"), ("user", "u")], "g-1", "abc"), ("g", [("system", "s"), ("user", "u")], "g-2", "boom"), ("h", [("system", "s"), ("assistant", "leak")], "h-1", "abc")]
    df = spark.createDataFrame(rows, "group_id string, messages array<struct<role:string,content:string>>, candidate_id string, text string")

    def factory():
        def scorer(turns):
            if turns[-1]["content"] == "boom":
                raise RuntimeError("no score")
            return len(turns[-1]["content"])

        return scorer

    hooks.register("stub")(factory)
    got = {r["candidate_id"]: (r["score"], r["error"]) for r in hooks.score_candidates(df, hooks.REGISTRY["stub"]).collect()}
    assert got == {"g-1": (3.0, None), "g-2": (None, "no score"), "h-1": (None, "the messages are not system and user")}
    made = hooks.generate(spark.createDataFrame([("g", "p", 2)], "group_id string, prompt string, idx long"), lambda: lambda prompt, seed: f"{prompt}{seed}", 3, 10)
    assert sorted(tuple(r) for r in made.collect()) == [("g", "g-1", 16, "p16"), ("g", "g-2", 17, "p17"), ("g", "g-3", 18, "p18")]
