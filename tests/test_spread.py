"""Work on the rows of a narrow table: once a row, and in many tasks however few its files are."""

import pytest
from pyspark.sql import functions as F

from quernel import queries
from quernel.functions import attributes as A
from quernel.functions import text as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_prompt_is_parsed_once_however_often_its_fields_are_used(spark):
    df = spark.range(3).select("id", F.concat(F.lit("类型#a*颜色#"), F.col("id").cast("string")).alias("p"))
    rows = A.with_parsed(df, F.col("p")).select("*", "parsed.attributes", "parsed.error")
    used = rows.where(F.size("attributes") == 2).where("error is null").select("id", F.posexplode("attributes").alias("pos", "a"))
    assert plan(used).count(A.NATURAL_LEAD) == 1  # the pattern stands once in the plan: no filter computes the parse anew
    assert [(r["id"], r["pos"], tuple(r["a"])) for r in used.orderBy("id", "pos").collect()] == [(i, j, a) for i in range(3) for j, a in enumerate([("类型", "a"), ("颜色", str(i))])]


def test_parts_are_worked_on_in_many_tasks(spark, sf_dir):
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() < 3  # one small file
    assert queries._parsed(spark, sf_dir).rdd.getNumPartitions() >= 12
    assert queries.queries()["attribute_parse"](spark, sf_dir).rdd.getNumPartitions() >= 12


@pytest.mark.parametrize("text", ["", " \u3000\n", "a", "\x1fa b\x85", "\u2028é😀\u200a", "\u200b a"])
def test_trimmed_is_strip(spark, text):
    assert len(set(spark.range(1).select(F.lit(text).alias("t")).select(X.trimmed(F.col("t")), X.strip(F.col("t"))).first())) == 1


def test_small_files_share_a_task(spark, tmp_path):
    import hashlib

    from quernel.sources import formats, jsonl

    for i in range(100):
        (tmp_path / f"f{i:03d}").write_bytes(b"x" * i)
    df = jsonl.file_digests(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 8
    assert sorted((r["bytes"], r["sha256"]) for r in df.collect()) == [(i, hashlib.sha256(b"x" * i).hexdigest()) for i in range(100)]
    parts = formats.packed([("a", 1), ("b", formats.SPLIT), ("c", 5), ("d", 2)])
    assert [[f[0] for f in p.files] for p in parts] == [["a"], ["b"], ["c", "d"]] and formats.packed([]) == []


def test_anchors_of_texts_are_filtered_where_they_are_computed():
    import random

    import numpy as np

    from quernel.operators import search

    rng = random.Random(4)
    text = bytes(rng.choice(b"abcde ") for _ in range(5000)) + b"a" * 100
    classes = list(range(search.CLASSES))
    whole, wanted = search.anchors(text, classes), search.anchors(text[1000:1040], classes)
    for k in classes:
        assert set(wanted[k]) <= set(whole[k])
    got = search.anchors(text, classes, {k: search.Filter.of(wanted[k].view(np.int64)) for k in classes})
    for k in classes:
        assert set(wanted[k]) <= set(got[k]) <= set(whole[k])
    assert len(got[4]) < len(whole[4]) / 4
    assert all(len(v) == 0 for v in search.anchors(b"", classes, {k: search.Filter.of(wanted[k]) for k in classes}).values())


def test_anchors_of_many_texts_travel_together():
    import pyarrow as pa

    from quernel.operators import search

    texts = ["", "a", "ab" * 40] + [f"text number {i} of a batch" for i in range(2000)] + ["".join(chr(97 + i * i % 23) + str(i) for i in range(60_000))]
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([-i for i in ids]), pa.array(texts)], names=["one", "two", "text"])
    got = list(search._anchor_rows(False, [1, 4])(iter([batch])))
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = [(i, -i, k, h) for i, t in enumerate(texts) for k, v in search.anchors(t.encode(), [1, 4]).items() for h in v.view("int64").tolist()]
    assert rows == want and len(got) <= 2 + len(rows) // search.HELD * 2


def test_enhancement_filter_parses_once_in_many_tasks(spark, sf_dir):
    df = queries.queries()["enhancement_filter"](spark, sf_dir)
    assert plan(df).count(A.NATURAL_LEAD) == 1 and "RepartitionByExpression" in plan(df)


def test_metrics_rollup_parses_once_in_many_tasks(spark, sf_dir):
    df = queries.queries()["metrics_rollup"](spark, sf_dir)
    assert plan(df).count(A.NATURAL_LEAD) == 1 and "RepartitionByExpression" in plan(df)


def test_candidate_files_are_written_and_read_in_many_tasks(spark, sf_dir):
    from quernel import queries_sources

    assert queries_sources._candidate_file(spark, sf_dir).rdd.getNumPartitions() >= 12


def test_rows_of_a_run_are_parsed_once_in_many_tasks(spark, sf_dir):
    from quernel import queries_sources

    rows = queries_sources._conversations(spark, sf_dir)
    assert plan(rows.where("attributes is not null")).count(A.NATURAL_LEAD) == 1 and rows.rdd.getNumPartitions() >= 12


def test_punctuation_in_values_parses_once_in_many_tasks(spark, sf_dir):
    df = queries.queries()["punctuation_in_values"](spark, sf_dir)
    assert plan(df).count(A.NATURAL_LEAD) == 1 and "RepartitionByExpression" in plan(df)


def test_marks_in_values_parses_once_in_many_tasks(spark, sf_dir):
    df = queries.queries()["marks_in_values"](spark, sf_dir)
    assert plan(df).count(A.NATURAL_LEAD) == 1 and "RepartitionByExpression" in plan(df)


def test_enhancement_filter_leaves_no_work_to_the_tasks_that_read(spark, sf_dir):
    below = plan(queries.queries()["enhancement_filter"](spark, sf_dir)).split("RepartitionByExpression")[1]
    assert "好看" not in below and "Filter" not in below


def test_rollup_computes_the_metrics_that_are_wanted(spark):
    from quernel.operators import metrics

    record = F.when(F.col("id") % 5 > 0, F.struct((F.col("id") % 3).alias("attribute_hits"), F.lit(3).alias("attribute_count"), (F.col("id") % 3 / 3).alias("literal_coverage"), (F.col("id") % 2 == 0).alias("loop")))
    df = spark.range(40).select((F.col("id") % 4).alias("g"), record.alias("metrics"))
    whole = [tuple(r) for r in metrics.aggregate(df, by=["g"]).collect()]
    for only in (["literal_coverage"], ["samples", "loop"], ["literal_coverage_micro", "attribute_hits"]):
        part = metrics.aggregate(df, by=["g"], only=only)
        assert sorted(map(tuple, part.collect()), key=str) == sorted((r for r in whole if r[2] in only), key=str)
    assert "loop" not in plan(metrics.aggregate(df, by=["g"], only=["literal_coverage"])).split("Aggregate")[0]


def test_candidate_rollup_has_one_row_a_group(spark, sf_dir):
    df = queries.queries()["candidate_rollup"](spark, sf_dir)
    assert "avg" in plan(df) and plan(df).count("avg(") == 1


def test_sound_candidates_are_told_by_columns():
    import pyarrow as pa

    from quernel.sources import formats

    kind = pa.list_(pa.struct([("candidate_id", pa.string()), ("seed", pa.int64())]))
    group = lambda *ids: [{"candidate_id": i, "seed": 1} for i in ids]
    one = lambda rows: formats.sound(pa.array(rows, kind))
    good = [group("a", "b"), group("a", "b", None), group("b", "a")]
    assert one([]) and one(good) and formats.sound(pa.array([group("x"), *good], kind)[1:])
    for bad in ([], group("a"), None, group("a", "a"), group("a", "b", "a"), group(None, None)):
        assert not one([*good, bad]), bad
    assert not formats.sound(pa.array([[{"seed": 1}, {"seed": 2}]], pa.list_(pa.struct([("seed", pa.int64())]))))


def test_metrics_rollup_computes_what_it_shows(spark, sf_dir):
    told = plan(queries.queries()["metrics_rollup"](spark, sf_dir))
    assert told.count("avg(") == 5 and "mean_char_length" not in told


def test_run_directory_parses_as_it_writes_and_not_to_count(spark, sf_dir, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    counted, count = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda df: counted.append(plan(df)) or count(df))
    rows = queries.queries()["run_directory"](spark, sf_dir)
    assert counted and not any(A.NATURAL_LEAD in p for p in counted)
    assert count(rows) == count(spark.read.parquet(f"{sf_dir}/part.parquet"))


def test_punctuation_in_values_keeps_only_marked_values_apart(spark, sf_dir):
    told = plan(queries.queries()["punctuation_in_values"](spark, sf_dir))
    assert told.count("Aggregate") == 2 and "Generate explode" not in told.split("Aggregate")[1]
    assert "mark#" in told.split("Aggregate")[2].split("]")[0]
