"""Sources, sinks, streams, searches and samples against plain versions."""

import hashlib
import json
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quernel.operators import curate, flows, metrics, rewards, runs, search
from quernel.sources import commits, formats, jsonl
from quernel.streaming import state

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# --- digests, leading lines, lines by parts -------------------------------------------------------------------------


def test_digests_of_files_of_many_pieces(spark, tmp_path):
    rng = random.Random(1)
    whole = {"a.bin": b"", "b.bin": rng.randbytes(3 << 20), "c/d.bin": b"x" * ((1 << 20) + 1), "c/é.bin": b"\n"}
    for name, data in whole.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"z")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = {r["path"].split(str(tmp_path) + "/")[1]: (r["bytes"], r["sha256"]) for r in jsonl.file_digests(spark, path).collect()}
        assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in whole.items()}
    assert jsonl.file_digests(spark, str(tmp_path / "b.bin")).count() == 1
    with pytest.raises(Exception, match="absent"):
        jsonl.file_digests(spark, str(tmp_path / "absent")).collect()


def test_a_digest_holds_one_piece_at_a_time(tmp_path):
    """A file of 3 GB, which is one long hole on the disk."""
    path = tmp_path / "large"
    with open(path, "wb") as file:
        file.truncate(3 << 30)
    code = f"import resource; from quernel.sources import formats; system, at = formats.opened({str(path)!r}); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; print(formats.digest(system, at)); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    told = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=300).stdout.split()
    zero = hashlib.sha256()
    for _ in range(3 << 10):
        zero.update(bytes(1 << 20))
    assert told[0] == zero.hexdigest() and int(told[1]) < 64 << 10  # kilobytes


def test_leading_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"1\n2\r\n\n4")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes("é\n6\n".encode())
    every = ["1", "2\r", "", "4", "é", "6"]
    for n in range(1, 9):
        got = [tuple(r) for r in jsonl.first_lines(spark, str(tmp_path), n).orderBy("line_number").collect()]
        assert got == list(enumerate(every[:n], 1))
    monkeypatch.setattr(formats, "PIECE", 2)
    for n in range(1, 9):
        parts = formats.LeadingReader(str(tmp_path), n).partitions()
        assert sum(len(b.to_pydict()["value"]) for p in parts for b in formats.LeadingReader(str(tmp_path), n).read(p)) == min(n, 6)


def test_leading_lines_read_no_more_than_they_need(tmp_path, monkeypatch):
    """A file of 8 GB, nearly all of it a hole: what is read is counted."""
    path = tmp_path / "large"
    with open(path, "wb") as file:
        file.write(b"a line\n" * 1000)
        file.truncate(8 << 30)
    read = []
    opened = formats.opened

    class Counted:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def open_input_stream(self, at):
            stream, outer = self.system.open_input_stream(at), read

            class One:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    stream.close()

                def read(self, n):
                    data = stream.read(n)
                    outer.append(len(data))
                    return data

            return One()

    monkeypatch.setattr(formats, "opened", lambda p: (Counted(opened(p)[0]), opened(p)[1]))
    reader = formats.LeadingReader(str(path), 500)
    parts = reader.partitions()
    monkeypatch.setattr(formats, "opened", opened)
    assert sum(read) == formats.PIECE and [(p.stop, p.number) for p in parts] == [(3500, 1)]
    assert sum(len(b) for b in reader.read(parts[0])) == 500


def test_parts_of_a_file_have_each_line_once(tmp_path, monkeypatch):
    rng = random.Random(2)
    path = tmp_path / "x"
    system = formats.opened(str(path))[0]
    for end in (b"\n", b""):
        lines = [b"x" * rng.choice([0, 1, 3, 20, 200]) for _ in range(60)]
        data = b"\n".join(lines) + end
        path.write_bytes(data)
        for split in (1, 7, 64, 1000, 10**6):
            monkeypatch.setattr(formats, "BLOCK", rng.choice([3, 50, 5000]))
            monkeypatch.setattr(formats, "PIECE", rng.choice([2, 50]))
            got = b"".join(b for at in range(0, len(data), split) for b in formats.line_blocks(system, formats.Part(str(path), at, min(len(data), at + split))))
            assert got == data


# --- run directories and candidate files ----------------------------------------------------------------------------


def write_run(folder, lines, **summary):
    folder.mkdir()
    (folder / "summary.json").write_text(json.dumps({"status": "complete", "samples": len(lines)} | summary))
    (folder / "manifest.json").write_text("{}")
    (folder / "samples.jsonl").write_text("".join(json.dumps(s) + "\n" for s in lines))
    return str(folder)


def test_run_directories(spark, tmp_path):
    samples = [{"line_number": i, "output": f"o{i}", "messages": [{"role": "user", "content": "é\n"}], "attributes": [{"key": "k", "value": "v"}], "more": {"x": 1}} for i in range(500)]
    good = write_run(tmp_path / "good", samples)
    rows = jsonl.checked_run(spark, good).orderBy("line_number").collect()
    assert [r["output"] for r in rows] == [f"o{i}" for i in range(500)] and rows[0]["messages"][0]["content"] == "é\n" and rows[0]["reference"] is None
    formats.register(spark)
    narrow = spark.read.format("evaluation_run").schema("line_number long").option("splitBytes", 1000).load(good)
    assert narrow.columns == ["line_number"] and narrow.rdd.getNumPartitions() > 10 and sorted(r[0] for r in narrow.collect()) == list(range(500))
    with pytest.raises(Exception, match="incomplete run"):
        jsonl.checked_run(spark, write_run(tmp_path / "running", samples, status="running"))
    with pytest.raises(ValueError, match="count mismatch"):
        jsonl.checked_run(spark, write_run(tmp_path / "short", samples[1:], samples=500))
    with pytest.raises(ValueError, match="repeated lines"):
        jsonl.checked_run(spark, write_run(tmp_path / "twice", samples + samples[:1]))
    with pytest.raises(Exception, match="without output"):
        jsonl.checked_run(spark, write_run(tmp_path / "gap", samples + [{"line_number": 500}])).collect()
    with pytest.raises(Exception, match="no rows"):
        jsonl.checked_run(spark, write_run(tmp_path / "empty", []))
    with pytest.raises(Exception, match="samples.jsonl: JSON parse error"):
        bad = write_run(tmp_path / "bad", samples)
        with open(f"{bad}/samples.jsonl", "a") as file:
            file.write("{broken\n")
        jsonl.checked_run(spark, bad).collect()


def test_candidate_files(spark, tmp_path):
    formats.register(spark)
    group = lambda name, ids: {"group_id": name, "attributes": [{"key": "a", "value": "b"}], "candidates": [{"candidate_id": i, "text": "ab", "seed": 1, "eos_normal": None} for i in ids]}
    read = lambda groups, name: (tmp_path / name).write_text("\n".join(json.dumps(g) for g in groups)) and spark.read.format("candidate_groups").load(str(tmp_path / name))
    rows = read([group("g", "xy"), group("h", "xyz")], "good").orderBy("group_id").collect()
    assert [len(r["candidates"]) for r in rows] == [2, 3] and rows[0]["candidates"][0]["seed"] == 1
    with pytest.raises(Exception, match="group g: fewer than two"):
        read([group("g", "x")], "one").collect()
    with pytest.raises(Exception, match="group h: candidate ids repeat"):
        read([group("g", "xy"), group("h", "xx")], "same").collect()


def test_output_is_not_the_source(spark, tmp_path):
    df = spark.range(1)
    for out in (f"{tmp_path}/x", f"{tmp_path}//x/", f"file:{tmp_path}/y/../x"):
        with pytest.raises(ValueError, match="over the source"):
            jsonl.write(df, out, sources=(f"file://{tmp_path}/x",))
    jsonl.write(df, f"{tmp_path}/z", sources=(f"{tmp_path}/x",))


# --- groups that are appended ---------------------------------------------------------------------------------------


def test_groups_are_appended_once(spark, tmp_path):
    source = spark.range(1000).select((F.col("id") % 37).alias("g"), "id").unionByName(spark.sql("select cast(null as bigint) g, 5000L id"))
    log = commits.GroupLog(spark, str(tmp_path / "out"), "g")
    assert log.read() is None and log.committed() is None

    def dies(rows):
        dies.calls += 1
        if dies.calls == 3:
            raise RuntimeError("killed")
        return rows

    dies.calls = 0
    with pytest.raises(RuntimeError):
        log.run(source, dies, 6)
    part = log.read().count()
    assert 0 < part < 1001 and len(log.entries()) == 2
    # a batch that was written but not committed is not there
    source.write.parquet(f"{tmp_path}/out/rows/lost")
    assert log.read().count() == part
    again = commits.GroupLog(spark, str(tmp_path / "out"), "g")
    assert again.run(source, lambda rows: rows, 4) == 1001 - part
    assert sorted((r["g"] is None, r["g"] or 0, r["id"]) for r in again.read().collect()) == sorted((r["g"] is None, r["g"] or 0, r["id"]) for r in source.collect())
    before = len(again.entries())
    assert again.run(source, lambda rows: rows, 4) == 0 and len(again.entries()) == before
    assert again.pending(source).count() == 0 and again.committed().count() == 38


def test_two_runs_at_once_write_a_group_once(spark, tmp_path, monkeypatch):
    a, b = (commits.GroupLog(spark, str(tmp_path / "out"), "g") for _ in range(2))
    rows = spark.range(20).select((F.col("id") % 5).alias("g"), "id")
    commit = a._commit

    def late(number, entry):
        monkeypatch.setattr(a, "_commit", commit)
        b.append(rows.where("g < 2"))  # another run comes first
        return commit(number, entry)

    monkeypatch.setattr(a, "_commit", late)
    assert a.append(rows) == 12
    assert sorted(r["id"] for r in a.read().collect()) == list(range(20))


# --- logs with state ------------------------------------------------------------------------------------------------


def test_a_log_in_steps_is_the_log_in_one(spark, tmp_path):
    rng = random.Random(3)
    folder, values = tmp_path / "logs", {"a": [], "b": []}
    folder.mkdir()
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for turn in range(3):
            for log in "ab":
                own = [round(rng.uniform(0, 2), 6) for _ in range(rng.choice([3, 15, 40]))]
                values[log] += own
                (folder / f"{log}-{turn}.log").write_text("x\n" + "".join(f"step loss:{v} lr:1\n" for v in own), encoding="utf-8")
            spark.conf.set("spark.sql.shuffle.partitions", str(3 + turn))  # as many workers as there are now
            log = F.regexp_extract("_metadata.file_name", "^(.)-", 1)
            snapshots = state.log_snapshots(spark, str(folder), log)
            state.keep_snapshots(snapshots, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    got = {r["log"]: r for r in state.at_step(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and {r["step"] for r in got.values()} == {3}
    for log, own in values.items():
        r = got[log]
        assert r["n"] == len(own) and (r["min_loss"], r["max_loss"]) == (min(own), max(own))
        for name, some in (("head_mean", own[:20]), ("tail_mean", own[-20:]), ("mean_loss", own)):
            assert r[name] == pytest.approx(sum(some) / len(some), abs=1e-12)
    first = state.at_step(spark, str(tmp_path / "out"), 1).collect()
    assert {r["step"] for r in first} == {1} and all(r["n"] < got[r["log"]]["n"] for r in first)


def test_parts_of_a_log_add_up():
    rng = random.Random(4)
    values = [rng.random() for _ in range(100)]
    for most in (1, 7, 200):
        own, at = state.Part(most), 0
        while at < 100:
            n = rng.randint(1, 12)
            piece = state.Part(most)
            piece.add(values[at : at + n])
            own.append(*piece.kept())
            at += n
        assert own.head == values[:most] and own.tail == values[-most:] and own.n == 100 and own.low == min(values) and own.total == pytest.approx(sum(values))


# --- search ---------------------------------------------------------------------------------------------------------


def test_search_against_contains(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé日") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(120)] + [None, "", "a", texts_long(rng)]
    texts += texts[:5]
    patterns = [t[i : i + n] for t in texts[:100] for i, n in [(rng.randint(0, len(t)), rng.choice([1, 2, 3, 5, 9, 17, 40, 300]))]] + [word() for _ in range(40)] + [None, "", "absent " * 9, texts[-1][70_000:70_400]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(patterns)), "id int, text string").repartition(2)
    want = sorted((i, j) for i, t in enumerate(texts) for j, x in enumerate(patterns) if t and x and x in t)
    assert sorted(tuple(r) for r in search.contained_pairs(d, p, "doc", "id").collect()) == want
    left = search.exclude_containing(d.withColumn("_one", F.lit(1)), p)
    assert sorted(r["doc"] for r in left.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want}) and left.columns == ["doc", "text", "_one"]
    assert search.contained_pairs(d, p.limit(0), "doc", "id").count() == 0 and search.exclude_containing(d.limit(0), p).count() == 0


def texts_long(rng):
    return " ".join("".join(rng.choice("xyz") for _ in range(6)) for _ in range(20_000))


# --- samples --------------------------------------------------------------------------------------------------------


def plain_floor(rows, target, seed):
    rank = lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()
    strata = {}
    for k, s in rows:
        strata.setdefault(s, []).append(k)
    kept, rest = [], []
    for own in strata.values():
        own.sort(key=lambda k: (rank(k), k))
        quota = math.floor(target * len(own) / len(rows))
        kept, rest = kept + own[:quota], rest + own[quota:]
    return sorted(kept + sorted(rest, key=lambda k: (rank(k), k))[: target - len(kept)])


def test_null_is_a_stratum_and_names_don_t_clash(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "a", "a", "b", "rare"] if i % 9 else ["b"])) for i in range(1000)]
    df = spark.createDataFrame([(k, s, 1, 2, 3, 4, 5, 6) for k, s in rows], "k int, s string, n int, quota int, _in int, _key int, _n int, stratum int")
    for target in (0, 1, 200, 999, 1000):
        got = curate.stratified_floor(df, "s", "k", target, 7)
        assert sorted(r["k"] for r in got.collect()) == plain_floor(rows, target, 7) and got.columns == df.columns
    got = curate.stratified_round(df, "s", "k", 200, 7)
    assert got.count() == 200 and got.columns == df.columns and got.where("s is null").count() > 20
    with pytest.raises(ValueError, match="exceeds"):
        curate.stratified_floor(df, "s", "k", 1001, 7)
    assert curate.stratified_round(df, "s", "k", 5000, 7).count() == 1000 and curate.stratified_floor(df.limit(0), "s", "k", 0, 7).count() == 0
    first = curate.dedup_first(df, F.col("s"), "k")
    assert first.columns == df.columns and first.count() == 4
    assert curate.exclude(df, df.where("s = 'a'"), F.col("s"), F.col("s")).columns == df.columns
    with pytest.raises(ValueError, match="keys repeat"):
        curate.stratified_floor(df.withColumn("k", F.lit(0)), "s", "k", 777, 7)


def test_first_of_groups_before_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(curate, "HELD", 50)
    rng = random.Random(7)
    rows = [(rng.choice([None, "x", "y", "z"]), rng.choice([None, *range(30)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(3)
    got = curate.first_n(df, ["g"], ["o", "i"], 10)
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) <= 3 * 4 * 10 + 3 * 100
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in (None, "x", "y", "z"):
        assert sorted((r for r in kept if r[0] == g), key=key)[:10] == sorted((r for r in rows if r[0] == g), key=key)[:10]
    many = curate.first_n(df.withColumn("h", F.col("i")), ["h"], ["o"], 1)  # more groups than are held
    assert many.count() == 2000


def test_a_round_robin_shuffles_and_sorts_no_more_than_its_target(spark):
    n = 40_000
    df = spark.range(n).select("id", F.lit("one").alias("s"), (F.col("id") % 3).alias("t")).repartition(4)
    got = curate.choose_diverse(df, "s", "t", "id", 100, 1)
    rows = sorted(r["position"] for r in got.collect())
    assert rows == list(range(1, 101)) and {r["count"] for r in got.groupBy("t").count().collect()} == {33, 34}
    left = curate.first_n(curate._rows(df, structure=F.col("s"), template=F.col("t"), key=F.col("id"), rank=curate.hash_rank(F.col("id"), 1)), ["structure", "template"], ["rank", "key"], 100)
    assert left.count() <= 4 * 3 * 100


# --- canonical rows, key changes, sums ------------------------------------------------------------------------------


def test_canonical_json(spark):
    docs = ['{"b":{"y":[{"q":1,"p":null}],"x":"é\\n"},"a":1.5}', '{ "a": 1.5, "b": {"x": "\\u00e9\\n", "y": [{"p": null, "q": 1}]} }', '{"a":[2,1]}', '{"a":[1,2]}', "{", None, "[]", '{"":{}}']
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").coalesce(1).select(flows.canonical_json(F.col("d"))).collect()]
    assert got[0] == got[1] == '{"a":1.5,"b":{"x":"é\\n","y":[{"p":null,"q":1}]}}' and got[2] != got[3] and got[4] is None and got[5] is None and got[6:] == ["[]", '{"":{}}']
    rows = spark.sql("select named_struct('y', 1, 'x', named_struct('b', cast(null as int), 'a', array(2))) a, 's' b").select(flows.canonical("b", "a").alias("one"))
    other = spark.sql("select 's' b, named_struct('x', named_struct('a', array(2), 'b', cast(null as int)), 'y', 1) a").select(flows.canonical("a", "b").alias("one"))
    assert rows.first() == other.first() and rows.first()[0] == '{"a":{"x":{"a":[2],"b":null},"y":1},"b":"s"}'


def test_key_changes(spark):
    df = spark.sql("select map('a', 1, 'b', 2) l, map('b', 5, 'c', 6) r union all select null, map('c', 1) union all select map('a', 1), null").coalesce(1)
    got = df.select(runs.key_changes(F.col("l"), F.col("r")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], ["b"], ["a"], ["c"]), (["c"], [], [], ["c"]), (["a"], [], ["a"], [])]
    none = spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    assert tuple(runs.side_counts(none, none.where("k is null or k = 1"), "k").first()) == (1, 0, 2)


def test_sums_have_the_same_bits_for_any_partitions(spark):
    from fractions import Fraction

    rng = random.Random(8)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-20, 20) for _ in range(3000)] + [5e-324, -5e-324, 1e308, -1e308, 2.0**-1074, 0.0, -0.0, 1.7976931348623157e308]
    rows = [(i % 3, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, x double")
    seen = set()
    for parts in (1, 4, 32):
        got = metrics.exact_sums(df.repartition(parts), "x", ["g"]).orderBy("g").collect()
        seen.add(tuple(r["total"].hex() for r in got))
    want = tuple(float(sum((Fraction(v) for g, v in rows if g == k), Fraction())).hex() for k in range(3))
    assert seen == {want}
    odd = spark.createDataFrame([(1, None), (1, None), (2, float("inf")), (2, 1.0), (3, float("inf")), (3, float("-inf")), (4, float("nan")), (None, 2.0), (5, 1.7e308), (5, 1.7e308)], "g int, x double")
    told = {r["g"]: (r["total"], r["n"]) for r in metrics.exact_sums(odd, "x", ["g"]).collect()}
    assert told[1] == (None, 0) and told[2] == (math.inf, 2) and math.isnan(told[3][0]) and math.isnan(told[4][0]) and told[None] == (2.0, 1) and told[5] == (math.inf, 2)


def test_a_validation_loss_has_the_same_bits_for_any_partitions(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i % 3, i // 7, rng.random()) for i in range(2000)], "rank int, batch int, loss double")
    seen = {tuple(metrics.validation_loss(df.repartition(n), "loss", "batch", "rank")[1].first()) for n in (1, 4, 32)}
    assert len(seen) == 1


def test_expert_counts_and_steps(spark):
    df = spark.createDataFrame([([0, 2],), ([2, 3],), ([],)], "c array<int>")
    assert [tuple(r) for r in rewards.expert_counts(df, "c", 5).orderBy("expert").collect()] == [(0, 1, 1), (1, 0, 1), (2, 2, 3), (3, 1, 4), (4, 0, 4)]
    assert [r[0] for r in spark.range(4).select(curate.resumed_step(F.col("id"), 8, 3)).collect()] == [0, 2, 5, 8]
    with pytest.raises(ValueError):
        curate.resumed_step(F.lit(1), 0, 3)
