"""Queries of sources, sinks, searches and flows, each with its SQL; registered with those of ``quernel.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import attributes as A
from quernel.operators import curate, flows, hooks, logs, metrics, rewards, runs, search
from quernel.plans.storage import new_path
from quernel.queries import _HASH, _PROMPT_SQL, _parsed, _r, _t, query
from quernel.sources import formats, jsonl, reports
from quernel.sources.commits import GroupLog
from quernel.streaming import state


def _message(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _conversations(spark, sf_dir, prompt=None) -> DataFrame:
    """part as conversations of a prompt and an answer, with metadata."""
    p = _parsed(spark, sf_dir)
    messages = F.array(_message("system", F.lit("s")), _message("user", F.col("prompt") if prompt is None else prompt), _message("assistant", F.col("answer")))
    meta = F.struct(F.lit("train.json").alias("source"), F.col("p_partkey").alias("source_index"), F.when(F.col("p_size") % 2 == 0, "structured").otherwise("natural").alias("input_style"))
    return p.select("p_partkey", "p_size", "answer", "attributes", messages.alias("conversations"), meta.alias("metadata"))


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt so that files by name, and lines in them, ascend by ``key``."""
    return df.repartitionByRange(4, key).sortWithinPartitions(key)


# --- files ----------------------------------------------------------------------------------------------------------


@query("""SELECT source || '-' || doc_id // 1000 AS file, CAST(sum(octet_length(encode(doc_id || ' ' || text || chr(10)))) AS BIGINT) AS bytes,
 sha256(string_agg(doc_id || ' ' || text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY ALL""")
def file_digests(spark, sf_dir):
    """Documents written as files of a source and a thousand ids each; every file is read again for its digest."""
    path = new_path(spark, "digested")
    file = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    lines = _t(spark, sf_dir, "documents").select(file.alias("file"), "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    return jsonl.file_digests(spark, path).select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "bytes", "sha256")


_FIRST_SQL = f"""WITH {_PROMPT_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS line_number FROM a)
SELECT line_number, p_partkey AS source_index, answer AS reference, list_transform(list_sort(list_transform(attrs, lambda x: x.k || '=' || x.v)), lambda x: x) AS attribute_key FROM n"""


def _eval_rows(rows: DataFrame) -> DataFrame:
    key = F.array_sort(F.transform("attribute_key", lambda a: F.concat_ws("=", a["key"], a["value"])))
    return rows.select("line_number", F.col("metadata.source_index").alias("source_index"), F.element_at("conversations", -1)["content"].alias("reference"), key.alias("attribute_key"))


@query(f"{_FIRST_SQL} ORDER BY line_number LIMIT 100")
def eval_scan_first(spark, sf_dir):
    """The first 100 lines of files of evaluation rows, strictly read, with their attributes; the limit is the feature."""
    path = new_path(spark, "eval-rows")
    jsonl.write(_in_order(_conversations(spark, sf_dir), "p_partkey").select("conversations", "metadata"), path)
    return _eval_rows(jsonl.with_attributes(jsonl.scan(spark, path, limit=100)))


@query(_FIRST_SQL)
def eval_scan_all(spark, sf_dir):
    """All lines of files of evaluation rows, strictly read, by number, with attributes and their sorted key."""
    path = new_path(spark, "eval-rows")
    jsonl.write(_in_order(_conversations(spark, sf_dir), "p_partkey").select("conversations", "metadata"), path)
    return _eval_rows(jsonl.with_attributes(jsonl.scan(spark, path)))


@query(f"""WITH {_PROMPT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey DESC) AS i FROM a)
SELECT CAST(p_partkey % 100 AS BIGINT) AS key, p_partkey AS source_index, answer FROM n WHERE i = 1""")
def scan_last_wins(spark, sf_dir):
    """Lines with a byte-order mark and blank lines between them; of lines of one key the last stays."""
    path = new_path(spark, "marked-lines")
    lines = _in_order(_conversations(spark, sf_dir), "p_partkey").select(F.to_json(F.struct("conversations", "metadata")).alias("j"))
    lines.select(F.concat(F.lit("﻿"), "j", F.lit("\n\n  ")).alias("value")).write.text(path)
    rows = jsonl.scan(spark, path, skip_blank=True).withColumn("key", F.col("metadata.source_index") % 100)
    last = jsonl.last_by_key(rows, "key")
    return last.select("key", F.col("metadata.source_index").alias("source_index"), F.element_at("conversations", -1)["content"].alias("answer"))


@query(f"""WITH {_PROMPT_SQL}, s AS (SELECT *, ['train', 'val', 'test'][p_size % 3 + 1] AS split FROM a)
SELECT split, p_partkey AS source_index, row_number() OVER (PARTITION BY split ORDER BY p_partkey) AS line_number, answer FROM s""")
def scan_splits(spark, sf_dir):
    """Three files by the names of their splits; lines count within each."""
    folder, rows = new_path(spark, "splits"), _conversations(spark, sf_dir)
    for i, name in enumerate(("train", "val", "test")):
        jsonl.write(_in_order(rows.where(F.col("p_size") % 3 == i), "p_partkey").select("conversations", "metadata"), f"{folder}/{name}.jsonl")
    read = jsonl.scan_splits(spark, folder)
    return read.select("split", F.col("metadata.source_index").alias("source_index"), "line_number", F.element_at("conversations", -1)["content"].alias("answer"))


@query(f"""WITH {_PROMPT_SQL} SELECT p_partkey AS line_number, CASE WHEN p_size % 2 = 0 THEN 'structured' ELSE 'natural' END AS input_style, 2::BIGINT AS messages,
 array_to_string(list_transform(attrs, lambda x: x.k || '=' || x.v), '|') AS attributes, answer AS reference, '另一条 ' || p_type AS output FROM a""")
def run_directory(spark, sf_dir):
    """A run that is written, and read again by its format once its numbers are checked."""
    path, rows = new_path(spark, "run"), _conversations(spark, sf_dir)
    output = F.concat(F.lit("另一条 "), F.filter("attributes", lambda a: a["key"] == "类型")[0]["value"])
    samples = rows.select(F.col("p_partkey").alias("line_number"), "metadata.input_style", F.slice("conversations", 1, 2).alias("messages"), "attributes", F.col("answer").alias("reference"), output.alias("output"))
    flows.write_run(spark, path, samples, {"status": "complete", "samples": _t(spark, sf_dir, "part").count()}, {"protocol": {}})  # a sample a part: parsed as they are written, and not to be counted before
    read = jsonl.checked_run(spark, path)
    shown = F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["key"], a["value"])), "|")
    return read.select("line_number", "input_style", F.size("messages").cast("long").alias("messages"), shown.alias("attributes"), "reference", "output")


def _candidate_file(spark, sf_dir) -> DataFrame:
    """Two candidates a prompt, written and read again by their format."""
    path, rows = new_path(spark, "candidates"), _parsed(spark, sf_dir)
    candidate = lambda i, text: F.struct(F.concat_ws("-", F.lit("g"), "p_partkey", F.lit(str(i))).alias("candidate_id"), (F.col("p_partkey") * 2 + i).alias("seed"), text.alias("text"), F.array(F.lit(5), F.col("p_size")).alias("content_token_ids"), (F.col("p_size") % 2 == 0).alias("eos_normal"))
    groups = rows.select(F.concat_ws("-", F.lit("g"), "p_partkey").alias("group_id"), F.col("p_partkey").alias("line_number"), "attributes", F.array(candidate(1, F.col("answer")), candidate(2, F.concat(F.lit("另一条 "), "p_type"))).alias("candidates"))
    jsonl.write(groups, path)
    formats.register(spark)
    return spark.read.format("candidate_groups").load(path)


_CANDIDATE_SQL = f"""{_PROMPT_SQL}, c AS (
  SELECT 'g-' || p_partkey AS group_id, 'g-' || p_partkey || '-1' AS candidate_id, len(list_filter(attrs, lambda x: contains(answer, x.v))) / 4 AS coverage, p_size % 2 = 0 AS eos FROM a
  UNION ALL SELECT 'g-' || p_partkey, 'g-' || p_partkey || '-2', len(list_filter(attrs, lambda x: contains('另一条 ' || p_type, x.v))) / 4, p_size % 2 = 0 FROM a)"""


@query(f"WITH {_CANDIDATE_SQL} SELECT candidate_id, round(coverage, 6) AS coverage, eos AS eos_normal, 2::BIGINT AS tokens FROM c")
def candidate_file(spark, sf_dir):
    """Metrics of every candidate of a file of groups, each of which has two candidates or more, with ids of their own."""
    scored, _ = flows.evaluate_candidates(_candidate_file(spark, sf_dir))
    m = F.col("metrics")
    return scored.select("candidate_id", _r(m["literal_coverage"]).alias("coverage"), m["eos_normal"].alias("eos_normal"), m["token_length"].cast("long").alias("tokens"))


@query(f"""WITH {_CANDIDATE_SQL} SELECT CASE WHEN grouping(group_id) = 1 THEN 'overall' ELSE 'group' END AS level, group_id, round(avg(coverage), 6) AS coverage, count(*) AS n FROM c GROUP BY GROUPING SETS ((), (group_id))""")
def candidate_rollup(spark, sf_dir):
    """Overall and by group, from one aggregation."""
    _, rollup = flows.evaluate_candidates(_candidate_file(spark, sf_dir), only=["literal_coverage"])
    return rollup.select("level", "group_id", _r("mean").alias("coverage"), "n")


@query("""SELECT 'lang-' || lang AS file, doc_id, substr(md5(text), 1, 8) AS made FROM documents""")
def append_groups(spark, sf_dir):
    """Documents by group of fifty ids, appended by a run that stops half-way and by another that goes on: each once."""
    log = GroupLog(spark, new_path(spark, "appended"), "grp")
    source = _t(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 50)).cast("string").alias("grp"), "doc_id", "lang", "text")
    make = lambda rows: rows.select("grp", F.concat_ws("-", F.lit("lang"), "lang").alias("file"), "doc_id", F.substring(F.md5("text"), 1, 8).alias("made"))
    log.append(make(source.where(F.pmod(F.xxhash64("grp"), F.lit(2)) == 0)))  # as far as the first run got
    log.run(source, make, 3)
    return log.read().select("file", "doc_id", "made")


# --- streams --------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT user_id % 8 AS log, value, event_id % 2 AS half, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id % 2, event_id) AS a,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id % 2 DESC, event_id DESC) AS b FROM events),
s AS (SELECT log, count(*) AS n, avg(CASE WHEN a <= 20 THEN value END) AS h, avg(CASE WHEN b <= 20 THEN value END) AS t, min(value) AS mi, max(value) AS ma, avg(value) AS me FROM o GROUP BY log)
SELECT CAST(log AS VARCHAR) AS log, n, round(h, 6) AS head_mean, round(t, 6) AS tail_mean, mi AS min_loss, ma AS max_loss, round(me, 6) AS mean_loss, round(t - h, 6) AS delta,
  CASE WHEN t - h < -0.005 THEN 'falling' WHEN t - h > 0.005 THEN 'rising' ELSE 'flat' END AS trend, t < 0.693147 AS below_baseline FROM s""")
def log_snapshots(spark, sf_dir):
    """Eight logs that grow between two runs of a stream: the second goes on from the state of the first, in another number of tasks."""
    folder, out, checkpoint = new_path(spark, "logs"), new_path(spark, "snapshots"), new_path(spark, "log-state")
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("log"), "event_id", F.format_string("step:%d loss:%s lr:0.1", "event_id", F.col("value").cast("string")).alias("value"))
    for half in (0, 1):
        lines = e.where(F.col("event_id") % 2 == half).repartition("log").sortWithinPartitions("log", "event_id").select("log", "value")
        lines.write.mode("append").partitionBy("log").text(folder)
        snapshots = state.log_snapshots(spark, f"{folder}/*", F.regexp_extract("_metadata.file_path", "log=([0-9]+)", 1))
        state.keep_snapshots(snapshots, out, checkpoint).awaitTermination()
    last = state.at_step(spark, out).drop("step")
    return last.withColumns({c: _r(c) for c in ("head_mean", "tail_mean", "mean_loss", "delta")})


# --- searches -------------------------------------------------------------------------------------------------------


_PIECES = "(SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, substr(text, 1, CAST(5 + item_id % 60 AS BIGINT)) FROM benchmark)"


def _passages(spark, sf_dir) -> DataFrame:
    """Items as they are, and their beginnings of 5 to 64 characters."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.unionByName(b.select((F.col("item_id") + 1000000).alias("item_id"), F.substring("text", 1, F.lit(5) + (F.col("item_id") % 60).cast("int")).alias("text")))


@query(f"SELECT doc_id, item_id FROM documents d JOIN {_PIECES} b ON contains(d.text, b.text) WHERE b.text <> ''")
def passages_in_documents(spark, sf_dir):
    """Every document with every passage that it contains, without a nested loop."""
    return search.contained_pairs(_t(spark, sf_dir, "documents").select("doc_id", "text"), _passages(spark, sf_dir), "doc_id", "item_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(d.text, b.text))")
def train_minus_benchmark_contains(spark, sf_dir):
    """Documents that contain no benchmark item."""
    return search.exclude_containing(_t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "benchmark")).select("doc_id")


# --- curation -------------------------------------------------------------------------------------------------------

_NULLED = "SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN {0} END AS {0}, n_chars AS n, doc_id AS quota, source AS _in FROM documents"


def _nulled(spark, sf_dir, column: str) -> DataFrame:
    """documents with a stratum that is null for a quarter, and columns with names of bookkeeping."""
    own = F.when(F.col("doc_id") % 4 != 1, F.col(column)).alias(column)
    return _t(spark, sf_dir, "documents").select("doc_id", own, F.col("n_chars").alias("n"), F.col("doc_id").alias("quota"), F.col("source").alias("_in"))


@query(f"""WITH d AS ({_NULLED.format('lang')}), q AS (SELECT lang, CAST(floor(CAST(200 AS DOUBLE) * count(*) / (SELECT count(*) FROM d)) AS BIGINT) AS own FROM d GROUP BY lang),
o AS (SELECT d.*, own, {_HASH.format(seed=31)} AS h, row_number() OVER (PARTITION BY d.lang ORDER BY {_HASH.format(seed=31)}, doc_id) AS i FROM d JOIN q ON d.lang IS NOT DISTINCT FROM q.lang),
l AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS j FROM o WHERE i > own)
SELECT doc_id, lang, n, quota, _in FROM o WHERE i <= own UNION ALL SELECT doc_id, lang, n, quota, _in FROM l WHERE j <= 200 - (SELECT sum(own) FROM q)""")
def stratified_floor_with_null(spark, sf_dir):
    return curate.stratified_floor(_nulled(spark, sf_dir, "lang"), "lang", "doc_id", 200, 31)


@query(f"""WITH d AS ({_NULLED.format('lang')}), q AS (SELECT lang, count(*) AS k, CAST(round_even(CAST(150 AS DOUBLE) * count(*) / (SELECT count(*) FROM d), 0) AS BIGINT) AS own FROM d GROUP BY lang),
b AS (SELECT *, least(150, coalesce(sum(own) OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before, lead(1) OVER (ORDER BY lang NULLS FIRST) IS NULL AS last FROM q),
k AS (SELECT lang, CASE WHEN last THEN 150 - before ELSE least(own, 150 - before) END AS take FROM b),
o AS (SELECT d.*, take, row_number() OVER (PARTITION BY d.lang ORDER BY {_HASH.format(seed=37)}, doc_id) AS i FROM d JOIN k ON d.lang IS NOT DISTINCT FROM k.lang)
SELECT doc_id, lang, n, quota, _in FROM o WHERE i <= take""")
def stratified_round_with_null(spark, sf_dir):
    return curate.stratified_round(_nulled(spark, sf_dir, "lang"), "lang", "doc_id", 150, 37)


@query(f"""WITH d AS (SELECT doc_id, lang, n_chars % 97 AS template FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY lang, template ORDER BY {_HASH.format(seed=8)}, doc_id) AS k, count(*) OVER (PARTITION BY lang, template) AS s FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, s, template) AS position, count(*) OVER (PARTITION BY lang) AS m FROM a)
SELECT doc_id, lang, template, CAST(position AS BIGINT) AS position FROM b ORDER BY position, m, lang LIMIT 600""")
def diverse_of_many_templates(spark, sf_dir):
    """A round robin over templates that are many, more rows than any template has."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 97).alias("template"))
    return curate.choose_diverse(d, "lang", "template", "doc_id", 600, 8)


@query("""SELECT doc_id, '{"a":"' || lang || '","b":[{"x":' || n_chars || ',"y":null},{"x":' || doc_id || ',"y":true}],"c":{"k":"é","n":{"p":1,"q":2}}}' AS one, true AS same,
 '{"a":"' || lang || '","d":[' || doc_id || ',' || n_chars || '],"z":null}' AS row_text FROM documents""")
def canonical_rows(spark, sf_dir):
    """Documents of the same fields in two orders, at every level, have one canonical text."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    first = F.format_string('{"c": {"n": {"q": 2, "p": 1}, "k": "é"}, "a": "%s", "b": [{"y": null, "x": %d}, {"y": true, "x": %d}]}', "lang", "n_chars", "doc_id")
    second = F.format_string('{"b":[{"x":%d,"y":null},{"x":%d,"y":true}],"a":"%s","c":{"k":"\\u00e9","n":{"p":1,"q":2}}}', "n_chars", "doc_id", "lang")
    rows = d.select("doc_id", flows.canonical_json(first).alias("one"), flows.canonical_json(second).alias("two"), F.lit(None).cast("int").alias("z"), F.array("doc_id", "n_chars").alias("d"), F.col("lang").alias("a"))
    return rows.select("doc_id", "one", (F.col("one") == F.col("two")).alias("same"), flows.canonical("z", "d", "a").alias("row_text"))


@query("""WITH l AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 1 END AS x, doc_id % 3 = 0 AS y FROM documents) SELECT doc_id,
 array_to_string(list_sort(list_distinct(list_concat(CASE WHEN x = 1 THEN ['even', lang] ELSE [lang] END, CASE WHEN y THEN ['three', lang] ELSE ['even'] END))), ',') AS either,
 array_to_string(list_sort(CASE WHEN x = 1 AND NOT y THEN ['even'] WHEN y THEN [lang] ELSE [] END), ',') AS both_sides,
 array_to_string(list_sort(CASE WHEN x = 1 AND y THEN ['even'] WHEN NOT y THEN [lang] ELSE [] END), ',') AS left_only,
 array_to_string(list_sort(CASE WHEN y THEN ['three'] WHEN x IS NULL THEN ['even'] ELSE [] END), ',') AS right_only FROM l""")
def map_key_changes(spark, sf_dir):
    """Keys of two maps of every document: union, intersection and both differences."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    even = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("even"), F.lit(1), "lang", F.lit(2))).otherwise(F.create_map("lang", F.lit(2)))
    three = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("three"), F.lit(1), "lang", F.lit(5))).otherwise(F.create_map(F.lit("even"), F.lit(1)))
    c = d.select("doc_id", runs.key_changes(even, three).alias("c"))
    return c.select("doc_id", *[F.array_join(f"c.{n}", ",").alias(m) for n, m in (("either", "either"), ("both", "both_sides"), ("left_only", "left_only"), ("right_only", "right_only"))])


# --- rewards and losses ---------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT event_id % 4 AS rank, user_id, avg(value) AS mean FROM events GROUP BY ALL), r AS (SELECT rank, sum(mean) AS total, count(*) AS n FROM m GROUP BY rank)
SELECT CAST(rank AS BIGINT) AS rank, round(total, 6) AS total, n, round((SELECT sum(total) / sum(n) FROM r), 6) AS loss FROM r""")
def validation_loss_over_ranks(spark, sf_dir):
    """Means of batches added up by four ranks, and the loss that their reduction gives."""
    rows = _t(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("rank"), "user_id", "value")
    own, whole = metrics.validation_loss(rows, "value", "user_id", "rank")
    return own.join(F.broadcast(whole.select("loss"))).select("rank", _r("total").alias("total"), "n", _r("loss").alias("loss"))


@query("""WITH g AS (SELECT vec_id, unnest(range(0, 64)) AS e, unnest(embedding)::DOUBLE AS x FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, e) AS r FROM g),
c AS (SELECT e, count(*) FILTER (r <= 2) AS n FROM k GROUP BY e) SELECT CAST(e AS BIGINT) AS expert, n AS tokens, CAST(sum(n) OVER (ORDER BY e) AS BIGINT) AS upto FROM c""")
def expert_counts(spark, sf_dir):
    """Slots and offsets of all 64 experts."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    chosen = F.transform(rewards.top_experts(logits, 2), lambda t: t["expert"])
    return rewards.expert_counts(_t(spark, sf_dir, "embeddings").select(chosen.alias("chosen")), "chosen", 64)


@query("SELECT vec_id, CASE WHEN vec_id % 65 > 0 THEN CAST(embedding[vec_id % 65] AS DOUBLE) END AS kept FROM embeddings")
def last_kept_value(spark, sf_dir):
    """The value at the last of as many places as the id says."""
    mask = F.transform("embedding", lambda x, i: (i < F.col("vec_id") % 65).cast("int"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", rewards.last_kept(F.col("embedding"), mask).cast("double").alias("kept"))


@query("""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
SELECT 'g' || item_id AS group_id, 'g' || item_id || '-' || (j + 1) AS candidate_id, CAST(7 + idx * 3 + j AS BIGINT) AS seed, length(text) || ':' || (7 + idx * 3 + j) AS text FROM b, range(0, 3) t(j)""")
def generated_candidates(spark, sf_dir):
    """Three candidates a prompt from a stub in place of a model: the prompt's length and the seed."""
    b = curate.numbered(_t(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "idx")
    prompts = b.select(F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("group_id"), F.col("text").alias("prompt"), "idx")
    return hooks.generate(prompts, lambda: lambda prompt, seed: f"{len(prompt)}:{seed}", 3, 7)


@query(f"""WITH {_PROMPT_SQL} SELECT row_number() OVER (ORDER BY p_partkey) AS line_number, 2::BIGINT AS n_messages, answer AS reference, round(len(list_filter(attrs, lambda x: contains(answer, x.v))) / 4, 6) AS coverage FROM a""")
def evaluated_references(spark, sf_dir):
    """Samples of a run without a model: messages without the reference, and the reference's metrics."""
    path = new_path(spark, "eval-rows")
    jsonl.write(_in_order(_conversations(spark, sf_dir), "p_partkey").select("conversations", "metadata"), path)
    samples, _ = flows.evaluate(jsonl.with_attributes(jsonl.scan(spark, path)))
    return samples.select("line_number", F.size("messages").cast("long").alias("n_messages"), "reference", _r("reference_metrics.literal_coverage").alias("coverage"))


# --- logs, masks, reports -------------------------------------------------------------------------------------------


@query("""SELECT user_id % 16 AS log, count(*) AS n, round(avg(value), 6) AS mean_loss, max(length('step ' || event_id || chr(65533) || ' loss:' || value)) > 0 AS told FROM events GROUP BY 1""")
def log_with_bad_bytes(spark, sf_dir):
    """Logs in which every line has a byte that is no UTF-8: it is replaced, and the losses are read."""
    folder = new_path(spark, "bad-logs")
    bad = F.unhex(F.lit("FF")).cast("string")
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("log"), F.concat(F.lit("step "), F.col("event_id").cast("string"), bad, F.lit(" loss:"), F.col("value").cast("string")).alias("value"))
    e.write.partitionBy("log").text(folder)
    lines = logs.decoded(spark.read.text(folder)).withColumn("line_number", F.struct("log", F.contains("value", F.lit("�")).alias("told")))
    found = logs.losses(lines).select("line_number.log", "line_number.told", "loss")
    return found.groupBy(F.col("log").cast("long").alias("log")).agg(F.count("*").alias("n"), _r(F.avg("loss")).alias("mean_loss"), F.bool_and("told").alias("told"))


@query("""WITH i AS (SELECT o_orderkey, list_transform(range(0, 8), lambda j: (o_orderkey * 7 + j * 3) % 11) AS ids FROM orders)
SELECT o_orderkey, array_to_string(list_transform(range(1, 9), lambda p: CASE WHEN p <= CASE WHEN list_position(ids, 2) > 0 THEN list_position(ids, 2) ELSE 8 END THEN 1 ELSE 0 END), '') AS mask FROM i""")
def eos_mask(spark, sf_dir):
    """The places up to and with the first end token."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("o_orderkey") * 7 + j * 3) % 11)
    t = _t(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    return t.select("o_orderkey", F.array_join(F.transform(rewards.upto_eos(F.col("ids"), 2), lambda x: x.cast("string")), "").alias("mask"))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS place, count(*) AS samples, round(avg(n_chars), 6) AS mean_chars, count(*) AS counted FROM documents GROUP BY GROUPING SETS ((), (lang))""")
def report_round_trip(spark, sf_dir):
    """A roll-up as a nested report that is written as one JSON document, and read again by a run's name."""
    rows = _t(spark, sf_dir, "documents").select("lang", F.struct("n_chars").alias("metrics"))
    path = new_path(spark, "report") + f"-{reports.run_name()}.json"
    reports.write_json(spark, path, {"status": "complete"} | reports.nested(metrics.aggregate(rows, by=["lang"]), "lang"))
    read = reports.read_json(spark, path)
    told = {"overall": read["overall"]} | read["by_lang"]
    return spark.createDataFrame([(k, v["samples"], round(v["n_chars"]["mean"], 6), v["n_chars"]["n"]) for k, v in told.items()], "place string, samples long, mean_chars double, counted long")
