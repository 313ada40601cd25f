"""Queries over the driver's tables, one or more for each operator, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions import attributes as A
from quernel.functions import text as X
from quernel.operators import curate, flows, hooks, logs, metrics, rewards, runs
from quernel.plans.storage import new_path
from quernel.sources import jsonl
from quernel.streaming.windows import windowed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: White space as the SQL engine's regular expressions spell it, in SQL quotes.
_WS = "'" + X.WS + "'"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


# --- text metrics ---------------------------------------------------------------------------------------------------

_CHAR_SQL = f"""
r AS (SELECT row_number() OVER () AS id, * FROM src),
c AS (SELECT id, string_split(regexp_replace(text, {_WS}, '', 'g'), '') AS ch FROM r),
k AS (SELECT id, list_filter(ch, lambda x: x <> '') AS ch FROM c),
g AS (SELECT id, CASE WHEN len(ch) < 4 THEN 0.0 ELSE (len(ch) - 3 - len(list_distinct(list_transform(range(1, len(ch) - 2), lambda i: array_to_string(ch[i:i + 3], ''))))) / CAST(len(ch) - 3 AS DOUBLE) END AS rep FROM k),
e AS (SELECT id, p, i, ch[i] = ch[i + p] AS same FROM (SELECT id, ch, p, unnest(range(1, len(ch) - p + 1)) AS i FROM k, range(2, 33) t(p) WHERE len(ch) >= 3 * p)),
n AS (SELECT id, p, i, same, i - row_number() OVER (PARTITION BY id, p, same ORDER BY i) AS isle FROM e),
l AS (SELECT DISTINCT id FROM (SELECT id, p, count(*) AS run FROM n WHERE same GROUP BY id, p, isle) WHERE run >= 2 * p),
m AS (SELECT r.*, g.rep, l.id IS NOT NULL AS has_loop FROM r JOIN g USING (id) LEFT JOIN l USING (id))
"""


@query(f"""WITH src AS (SELECT * FROM conversations), {_CHAR_SQL}
SELECT CASE WHEN grouping(role) = 1 THEN 'overall' ELSE 'group' END AS level, role, count(*) AS n, round(avg(rep), 6) AS mean_rep, round(avg(CAST(has_loop AS INT)), 6) AS loop_rate
FROM m GROUP BY GROUPING SETS ((), (role))""")
def repetition_loop_by_role(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("role", X.char_repetition(F.col("text")).alias("rep"), X.has_loop(F.col("text")).alias("l"))
    g = c.groupingSets([[], [F.col("role")]], "role").agg(F.grouping("role").alias("g"), F.count("*").alias("n"), F.avg("rep").alias("rep"), F.avg(F.col("l").cast("int")).alias("loops"))
    return g.select(F.when(F.col("g") == 1, "overall").otherwise("group").alias("level"), "role", "n", _r("rep").alias("mean_rep"), _r("loops").alias("loop_rate"))


def _prompts(spark, sf_dir, style: str) -> DataFrame:
    """part as attribute prompts and an answer that names the type and sometimes the colour."""
    p = curate.spread(_t(spark, sf_dir, "part"), "p_partkey").withColumn("b", F.replace("p_brand", F.lit("#"), F.lit("-")))
    structured = F.concat(F.lit("商品属性：类型#"), "p_type", F.lit(" *颜色# "), "p_name", F.lit("*品牌#"), "b", F.lit("*类型#"), "p_type", F.lit("*风格#"), F.split("p_name", " ")[0])
    natural = F.concat(F.lit("请根据以下商品信息生成一段中文电商广告文案：类型为"), "p_type", F.lit("，颜色为"), "p_name", F.lit("，品牌:"), "b", F.lit("；风格为"), F.split("p_name", " ")[0], F.lit("。"))
    answer = F.concat(F.lit("这款"), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("是"), "p_name")).otherwise(F.lit("")), F.lit(" 好看好看好看 "), F.col("p_size").cast("string"), F.lit(".5 码"), F.col("b"))
    return p.select("p_partkey", "p_size", "p_type", "p_name", "b", (structured if style == "structured" else natural).alias("prompt"), answer.alias("answer"))


_PROMPT_SQL = """
q AS (SELECT *, replace(p_brand, '#', '-') AS b FROM part),
a AS (SELECT p_partkey, p_size, p_type, p_name, b,
  [{'k': '类型', 'v': p_type}, {'k': '颜色', 'v': p_name}, {'k': '品牌', 'v': b}, {'k': '风格', 'v': split_part(p_name, ' ', 1)}] AS attrs,
  concat('这款', p_type, CASE WHEN p_size % 2 = 0 THEN '是' || p_name ELSE '' END, ' 好看好看好看 ', p_size, '.5 码', b) AS answer FROM q)
"""


def _parsed(spark, sf_dir, style="structured") -> DataFrame:
    return A.with_parsed(_prompts(spark, sf_dir, style), F.col("prompt")).select("*", "parsed.attributes", "parsed.error")


@query(f"""WITH {_PROMPT_SQL}, u AS (SELECT p_partkey, attrs, unnest(range(1, 5)) AS i FROM a)
SELECT s.style, p_partkey, CAST(i - 1 AS BIGINT) AS pos, attrs[i].k AS key, attrs[i].v AS value FROM u, (VALUES ('structured'), ('natural')) s(style)""")
def attribute_parse(spark, sf_dir):
    both = [_parsed(spark, sf_dir, s).select(F.lit(s).alias("style"), "p_partkey", F.posexplode("attributes").alias("pos", "a")) for s in ("structured", "natural")]
    return both[0].unionByName(both[1]).select("style", "p_partkey", F.col("pos").cast("bigint").alias("pos"), F.col("a.key").alias("key"), F.col("a.value").alias("value"))


_SCORE_SQL = f"""{_PROMPT_SQL},
src AS (SELECT p_partkey, p_size, attrs, answer AS text, CAST(len(list_filter(attrs, lambda x: contains(answer, x.v))) AS BIGINT) AS hits,
  CAST(len(list_filter(attrs, lambda x: x.k IN ('类型', '颜色') AND contains(answer, x.v))) AS BIGINT) AS key_hits FROM a), {_CHAR_SQL}"""


@query(f"""WITH {_SCORE_SQL}
SELECT p_partkey, hits AS attribute_hits, 4::BIGINT AS attribute_count, key_hits AS key_attribute_hits, 2::BIGINT AS key_attribute_count, round(hits / 4, 6) AS coverage, round(key_hits / 2, 6) AS key_coverage, hits = 4 AS all_covered,
  round(rep, 6) AS rep, has_loop, CAST(length(text) AS BIGINT) AS chars, array_to_string(list_transform(list_filter(attrs, lambda x: NOT contains(text, x.v)), lambda x: x.v), '|') AS missing FROM m""")
def attribute_coverage(spark, sf_dir):
    m = _parsed(spark, sf_dir).withColumn("m", A.score(F.col("answer"), F.col("attributes"))).select("p_partkey", "m.*")
    return m.select("p_partkey", "attribute_hits", "attribute_count", "key_attribute_hits", "key_attribute_count", _r("literal_coverage").alias("coverage"), _r("key_literal_coverage").alias("key_coverage"), F.col("all_attributes_covered").alias("all_covered"), _r("repeated_char_4gram_ratio").alias("rep"), F.col("loop").alias("has_loop"), F.col("char_length").alias("chars"), F.array_join(F.transform("missing_attributes", lambda a: a["value"]), "|").alias("missing"))


@query(f"""WITH {_SCORE_SQL}, s AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS style, * FROM m),
w AS (SELECT style, grouping(style) AS g, count(*) AS n, avg(hits / 4) AS c, avg(key_hits / 2) AS kc, avg(rep) AS rep, avg(CAST(has_loop AS INT)) AS lp, sum(hits) / sum(4) AS mi, sum(key_hits) / sum(2) AS kmi FROM s GROUP BY GROUPING SETS ((), (style)))
SELECT CASE WHEN g = 1 THEN 'overall' ELSE 'group' END AS level, style, x.metric, round(x.mean, 6) AS mean, x.n FROM (
 SELECT g, style, unnest([{{'metric': 'samples', 'mean': NULL::DOUBLE, 'n': n}}, {{'metric': 'literal_coverage', 'mean': c, 'n': n}}, {{'metric': 'key_literal_coverage', 'mean': kc, 'n': n}}, {{'metric': 'repeated_char_4gram_ratio', 'mean': rep, 'n': n}}, {{'metric': 'loop', 'mean': lp, 'n': n}}, {{'metric': 'eos_normal', 'mean': NULL, 'n': 0}}, {{'metric': 'literal_coverage_micro', 'mean': mi, 'n': n}}, {{'metric': 'key_literal_coverage_micro', 'mean': kmi, 'n': n}}]) AS x FROM w)""")
def metrics_rollup(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select(F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("style"), A.score(F.col("answer"), F.col("attributes")).alias("metrics"))
    wanted = ["samples", "literal_coverage", "key_literal_coverage", "repeated_char_4gram_ratio", "loop", "eos_normal", "literal_coverage_micro", "key_literal_coverage_micro"]
    return metrics.aggregate(rows, by=["style"], only=wanted).withColumn("mean", _r("mean"))


@query(f"""WITH {_PROMPT_SQL} SELECT p_partkey, CAST(len(list_filter(attrs, lambda x: contains('另一条 ' || p_type, x.v))) AS BIGINT) AS attribute_hits, round(len(list_filter(attrs, lambda x: contains('另一条 ' || p_type, x.v))) / 4, 6) AS coverage, true AS has_loop FROM a""")
def rescore(spark, sf_dir):
    """Old records keep all but their coverage."""
    rows = _parsed(spark, sf_dir).withColumn("old", A.score(F.col("answer"), F.col("attributes")))
    new = rows.withColumn("m", A.rescore(F.col("old"), F.concat(F.lit("另一条 "), "p_type"), F.col("attributes")))
    return new.select("p_partkey", F.col("m.attribute_hits"), _r("m.literal_coverage").alias("coverage"), F.col("m.loop").alias("has_loop"))


@query(f"""WITH {_PROMPT_SQL}, t AS (SELECT p_type, regexp_replace(regexp_replace(list_reduce(list_prepend(answer, list_transform(list_sort(list_transform(attrs, lambda x, i: {{'l': -length(x.v), 'i': i, 'k': x.k, 'v': x.v}})), lambda x: x.v || chr(1) || x.k)), lambda t, x: replace(t, split_part(x, chr(1), 1), '{{' || split_part(x, chr(1), 2) || '}}')), '[0-9]+([.][0-9]+)?', '{{数值}}', 'g'), {_WS}, '', 'g') AS template FROM a)
SELECT p_type, count(*) AS n, count(DISTINCT template) AS templates, min(template) AS first_template FROM t GROUP BY p_type""")
def template_diversity(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("p_type", X.template(F.col("answer"), F.col("attributes")).alias("template"))
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct("template").alias("templates"), F.min("template").alias("first_template"))


@query(f"""WITH {_PROMPT_SQL} SELECT p_type AS kind, array_to_string(list_sort(list_distinct(list_transform(attrs, lambda x: x.k))), ',') AS names, count(*) AS n, min(p_partkey) AS first_key FROM a GROUP BY ALL""")
def structure_frequency(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("p_partkey", A.structure(F.col("attributes")).alias("s"))
    # most common first, ties by first seen
    g = rows.groupBy(F.col("s.kind").alias("kind"), F.array_join("s.names", ",").alias("names")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
    return g.orderBy(F.desc("n"), "first_key")


@query(f"""WITH {_SCORE_SQL} SELECT p_partkey FROM m WHERE hits = 4 AND key_hits = 2 AND rep <= 0.10 AND length(text) - length(replace(text, '好看', '')) < 8 ORDER BY p_partkey""")
def enhancement_filter(spark, sf_dir):
    m = A.score(F.col("answer"), F.col("attributes"))
    own = A.coverage(F.col("attributes"), F.col("answer"), ("类型", "颜色"))
    fit = m["all_attributes_covered"] & (own["key_attribute_hits"] == own["key_attribute_count"]) & (m["repeated_char_4gram_ratio"] <= 0.10) & (X.occurrences(F.col("answer"), "好看") < 4)
    # exploded: as a plain filter, its parts that need the answer alone would move below the deal of rows, into the few tasks that read
    return _parsed(spark, sf_dir).select("p_partkey", F.explode(F.array(fit)).alias("fit")).where("fit").select("p_partkey")


@query("""SELECT p_partkey - CAST(p_partkey % 7 = 0 AS INT) AS source_index, CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN min(p_partkey % 5) = 0 THEN 'unpaired' ELSE 'paired' END AS outcome, count(*) AS n_structured,
 CAST(sum(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_natural FROM part GROUP BY 1""")
def style_parity_audit_all(spark, sf_dir):
    """All parts; every seventh key is folded onto its neighbour, so that twins, repeats and lone rows occur everywhere."""
    s = _parsed(spark, sf_dir, "structured").select("p_partkey", F.lit("structured").alias("style"), "attributes")
    n = _parsed(spark, sf_dir, "natural").where("p_partkey % 5 <> 0").select("p_partkey", F.lit("natural").alias("style"), "attributes")
    both = s.unionByName(n).withColumn("source_index", F.col("p_partkey") - (F.col("p_partkey") % 7 == 0).cast("int"))
    return runs.audit_pairs(both, ["source_index"], "style", "attributes")


@query(f"""WITH {_PROMPT_SQL}, u AS (SELECT DISTINCT p_partkey, x.v AS v, c FROM (SELECT p_partkey, unnest(attrs) AS x FROM a), (VALUES ('-'), (' '), ('/'), (',')) t(c) WHERE contains(x.v, c)) SELECT c AS mark, count(*) AS n FROM u GROUP BY c""")
def punctuation_in_values(spark, sf_dir):
    marks = F.array(*[F.lit(c) for c in "- /,"])
    values = _parsed(spark, sf_dir).select("p_partkey", F.explode("attributes").alias("a")).select("p_partkey", F.col("a.value").alias("v"))
    # only values with a mark are kept apart, not all of them
    found = values.select("p_partkey", "v", F.explode(F.filter(marks, lambda c: F.col("v").contains(c))).alias("mark")).distinct()
    return found.groupBy("mark").agg(F.count("*").alias("n"))


_SHORT = "CASE WHEN p_size % 3 = 0 THEN replace(answer, ' 好看好看好看 ', ' 穿着舒适 ') WHEN p_size % 3 = 1 THEN replace(answer, ' 好看好看好看 ', ' 穿着舒适，穿着舒适 ') ELSE answer END"


@query(f"""WITH {_SCORE_SQL.replace("answer AS text", _SHORT + " AS text")}, o AS (SELECT *, (length(text) - length(replace(text, '穿着舒适', ''))) // 4 AS phrases FROM m)
SELECT p_partkey, phrases < 2 AS phrase_once, phrases < 2 AND hits = 4 AND key_hits = 2 AND NOT has_loop AND rep <= 0.10 AS usable FROM o""")
def enhancement_eligible(spark, sf_dir):
    """The rules of ``flows.enhancement`` over answers with a loop, with the phrase once and with it twice."""
    loop = " 好看好看好看 "
    text = F.when(F.col("p_size") % 3 == 0, F.replace("answer", F.lit(loop), F.lit(" 穿着舒适 "))).when(F.col("p_size") % 3 == 1, F.replace("answer", F.lit(loop), F.lit(" 穿着舒适，穿着舒适 "))).otherwise(F.col("answer"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = _prompts(spark, sf_dir, "structured").select("p_partkey", F.array(message("system", F.lit("s")), message("user", F.col("prompt")), message("assistant", text)).alias("conversations"))
    once, usable = flows.eligible()
    return flows.analyse(rows).select("p_partkey", once.alias("phrase_once"), usable.alias("usable"))


@query(f"""WITH {_PROMPT_SQL}, u AS (SELECT x.v AS v, c FROM (SELECT unnest(attrs) AS x FROM a), (VALUES ('、'), ('，'), (','), ('；'), (';'), ('/')) t(c) WHERE contains(x.v || CASE WHEN length(x.v) % 3 = 0 THEN '/' WHEN length(x.v) % 3 = 1 THEN ',;' ELSE '' END, c)) SELECT c AS mark, count(*) AS n FROM u GROUP BY c""")
def marks_in_values(spark, sf_dir):
    """Every occurrence of a value counts; marks are put behind values, which have none."""
    v = _parsed(spark, sf_dir).select(F.explode("attributes").alias("a")).select(F.col("a.value").alias("v"))
    marked = F.concat("v", F.when(F.length("v") % 3 == 0, "/").when(F.length("v") % 3 == 1, ",;").otherwise(""))
    return runs.value_marks(v.select(marked.alias("v")), "v")


# --- curation -------------------------------------------------------------------------------------------------------

_STRIP = f"regexp_replace(regexp_replace(text, '^' || {_WS} || '+', ''), {_WS} || '+$', '')"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_STRIP} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return curate.dedup_first(_t(spark, sf_dir, "documents"), X.strip(F.col("text")), "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_STRIP} NOT IN (SELECT {_STRIP} FROM benchmark)")
def train_minus_benchmark_exact(spark, sf_dir):
    key = X.strip(F.col("text"))
    return curate.exclude(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), key, key).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND {_STRIP} NOT IN (SELECT {_STRIP} FROM documents WHERE doc_id % 2 = 1)")
def even_minus_copies_in_odd(spark, sf_dir):
    """An anti-join that removes rows: copies stand under odd and even ids."""
    key, d = X.strip(F.col("text")), _t(spark, sf_dir, "documents")
    return curate.exclude(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), key, key).select("doc_id")


@query(f"""WITH k AS (SELECT doc_id, sha256(text) AS k FROM documents), f AS (SELECT k, min(doc_id) AS doc_id FROM k WHERE doc_id % 3 = 0 AND k NOT IN (SELECT k FROM k WHERE doc_id % 3 <> 0) GROUP BY k),
j AS (SELECT doc_id, '{{"k":"' || k || '"}}' AS j FROM f) SELECT doc_id, substr(sha256(j), 1, 16) AS group_id FROM j ORDER BY sha256('42:' || j) LIMIT 25""")
def select_prompts_of_union(spark, sf_dir):
    """First row of each key that is in neither of two blocked frames, a sample of keys without replacement."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    blocked = [d.where("doc_id % 3 = 1"), d.where("doc_id % 3 = 2")]
    return curate.select_prompts(d.where("doc_id % 3 = 0"), blocked, "k", "doc_id", 25, 42).select("doc_id", "group_id")


@query(f"""WITH d AS (SELECT DISTINCT ['train', 'val', 'test'][doc_id % 3 + 1] AS s, {_STRIP} AS k FROM documents), p AS (SELECT k, max(CAST(s = 'train' AS INT)) AS a, max(CAST(s = 'val' AS INT)) AS b, max(CAST(s = 'test' AS INT)) AS c FROM d GROUP BY k)
SELECT 'train' AS left_split, 'val' AS right_split, CAST(sum(a * b) AS BIGINT) AS both, CAST(sum(a * (1 - b)) AS BIGINT) AS left_only, CAST(sum((1 - a) * b) AS BIGINT) AS right_only FROM p
UNION ALL SELECT 'train', 'test', CAST(sum(a * c) AS BIGINT), CAST(sum(a * (1 - c)) AS BIGINT), CAST(sum((1 - a) * c) AS BIGINT) FROM p
UNION ALL SELECT 'val', 'test', CAST(sum(b * c) AS BIGINT), CAST(sum(b * (1 - c)) AS BIGINT), CAST(sum((1 - b) * c) AS BIGINT) FROM p""")
def split_overlap_counts(spark, sf_dir):
    names = ("train", "val", "test")
    d = _t(spark, sf_dir, "documents").select(F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 3).cast("int")).alias("split"), F.sha2(X.strip(F.col("text")), 256).alias("key"))
    return curate.overlap_counts(d, "split", "key", names)


_HASH = "sha256(concat({seed}, ':', doc_id))"


@query(f"""WITH q AS (SELECT lang, CAST(floor(CAST(200 AS DOUBLE) * count(*) / (SELECT count(*) FROM documents)) AS BIGINT) AS quota FROM documents GROUP BY lang),
r AS (SELECT doc_id, lang, {_HASH.format(seed=17)} AS h FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS i FROM r), o AS (SELECT n.*, quota FROM n JOIN q USING (lang)),
l AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) AS j FROM o WHERE i > quota)
SELECT doc_id, lang FROM o WHERE i <= quota UNION ALL SELECT doc_id, lang FROM l WHERE j <= 200 - (SELECT sum(quota) FROM q)""")
def stratified_floor_fill(spark, sf_dir):
    return curate.stratified_floor(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 200, 17)


@query(f"""WITH q AS (SELECT source, count(*) AS n, CAST(round_even(CAST(150 AS DOUBLE) * count(*) / (SELECT count(*) FROM documents), 0) AS BIGINT) AS quota FROM documents GROUP BY source),
b AS (SELECT *, least(150, coalesce(sum(quota) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before, lead(source) OVER (ORDER BY source) IS NULL AS last FROM q),
k AS (SELECT source, CASE WHEN last THEN 150 - before ELSE least(quota, 150 - before) END AS take FROM b),
n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format(seed=23)}, doc_id) AS i FROM documents)
SELECT doc_id, source FROM n JOIN k USING (source) WHERE i <= take""")
def stratified_round_last(spark, sf_dir):
    return curate.stratified_round(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150, 23)


@query(f"""WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {_HASH.format(seed=5)}, doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS s FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, s, lang) AS position, count(*) OVER (PARTITION BY source) AS m FROM a)
SELECT doc_id, source, lang, CAST(position AS BIGINT) AS position FROM b ORDER BY position, m, source LIMIT 150""")
def diverse_round_robin(spark, sf_dir):
    return curate.choose_diverse(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 150, 5)


@query(f"""WITH e AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 7 = 0), c AS (SELECT doc_id, lang FROM documents WHERE text NOT IN (SELECT text FROM e)),
q AS (SELECT lang, CAST(floor(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM c)) AS BIGINT) AS quota FROM c GROUP BY lang),
o AS (SELECT c.*, quota, {_HASH.format(seed=3)} AS h, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed=3)}, doc_id) AS i FROM c JOIN q USING (lang)),
l AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS j FROM o WHERE i > quota),
u AS (SELECT doc_id, 'enhancement' AS part FROM e UNION ALL SELECT doc_id, 'replay' FROM o WHERE i <= quota UNION ALL SELECT doc_id, 'replay' FROM l WHERE j <= 100 - (SELECT sum(quota) FROM q))
SELECT doc_id, part, {_HASH.format(seed=4)} AS ord FROM u""")
def mix_replay(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return curate.mix_replay(d.where("doc_id % 7 = 0"), d, F.col("text"), "lang", "doc_id", 100, 3).select("doc_id", "part", "ord")


def _nested(spark, sf_dir) -> DataFrame:
    """conversations as one row each, messages in the order of turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("""WITH n AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(r) <> 3 THEN 'wrong number of messages' WHEN r <> ['system', 'user', 'assistant'] THEN 'wrong roles' WHEN len(list_filter(t, lambda x: x IS NULL OR trim(x) = '')) > 0 THEN 'blank content' END AS reason FROM n""")
def conversation_validity(spark, sf_dir):
    return _nested(spark, sf_dir).select("conv_id", curate.reject_reason(F.col("messages")).alias("reason"))


@query("""WITH n AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(r) AS BIGINT) AS turns, sha256(array_to_string(list_transform(t, lambda x: trim(x)), chr(0))) AS key, CASE WHEN len(list_filter(r, lambda x: x = 'user')) = 1 THEN t[list_position(r, 'user')] END AS only_user FROM n""")
def conversation_identity(spark, sf_dir):
    return _nested(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("turns"), X.conversation_key(F.col("messages")).alias("key"), curate.only_text(F.col("messages"), "user").alias("only_user"))


@query("""WITH n AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t, list(trim(text) ORDER BY turn) AS c FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, t, c, list_transform(regexp_extract_all(t, '(?s)<\\|im_start\\|>(?:system|user|assistant)\\s+(.*?)<\\|im_end\\|>', 1), lambda x: trim(x)) AS read FROM n)
SELECT conv_id, md5(t) AS rendered, CAST(len(read) AS BIGINT) AS parsed, read = c AS same FROM p""")
def chat_markup_roundtrip(spark, sf_dir):
    rows = _nested(spark, sf_dir).withColumn("text", X.render_chat(F.col("messages")))
    stripped = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), X.strip(m["content"]).alias("content")))
    return rows.withColumn("p", X.parse_chat(F.col("text"))).select("conv_id", F.md5("text").alias("rendered"), F.size("p").cast("long").alias("parsed"), (F.col("p") == stripped).alias("same"))


_TURN_SQL = """m AS (SELECT conv_id, turn, CASE WHEN turn > 1 AND turn % 4 <> 0 AND conv_id % 3 = 0 THEN 'tool' ELSE role END AS role, text FROM conversations WHERE NOT (conv_id % 2 = 0 AND role = 'system')),
n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, i, CASE WHEN i = 1 AND role = 'system' THEN text END AS head, CASE WHEN i = 1 AND role = 'system' THEN '' WHEN role <> 'tool' THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
  ELSE CASE WHEN before IS NOT DISTINCT FROM 'tool' THEN '' ELSE '<|im_start|>user' END || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || CASE WHEN after IS NOT DISTINCT FROM 'tool' THEN '' ELSE '<|im_end|>' || chr(10) END END AS s FROM n)"""


@query(f"""WITH {_TURN_SQL} SELECT conv_id, max(head) IS NULL AS by_default, md5('<|im_start|>system' || chr(10) || coalesce(max(head), 'You are a helpful assistant') || '<|im_end|>' || chr(10) || string_agg(s, '' ORDER BY i)
 || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS prompt FROM t GROUP BY conv_id""")
def chat_template(spark, sf_dir):
    """Prompts with and without a system message of their own, some turns of tools, an empty thought at the end."""
    c = _t(spark, sf_dir, "conversations").where("NOT (conv_id % 2 = 0 AND role = 'system')")
    role = F.when((F.col("turn") > 1) & (F.col("turn") % 4 != 0) & (F.col("conv_id") % 3 == 0), "tool").otherwise(F.col("role"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content")))).alias("t"))
    m = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    by_default = F.get("t", F.lit(0))["role"] != "system"
    return turns.select("conv_id", by_default.alias("by_default"), F.md5(X.chat_prompt(m, generate=True, thinking=False)).alias("prompt"))


@query("""WITH p AS (SELECT regexp_extract_all(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', '' ORDER BY turn), '(?s)<\\|im_start\\|>(?:system|user|assistant)\\s+(.*?)<\\|im_end\\|>', 1) AS c, conv_id FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(c) AS BIGINT) AS messages, md5(array_to_string(list_transform(c, lambda x: trim(x)), '|')) AS contents FROM p""")
def chat_markup_parse(spark, sf_dir):
    """Contents read back from the markup alone."""
    p = _nested(spark, sf_dir).select("conv_id", X.parse_chat(X.render_chat(F.col("messages"))).alias("p"))
    return p.select("conv_id", F.size("p").cast("long").alias("messages"), F.md5(F.array_join(F.transform("p", lambda m: m["content"]), "|")).alias("contents"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def style_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang")


@query(f"""WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 <> 0) GROUP BY text)
SELECT doc_id, substr({_HASH.format(seed=42)}, 1, 16) AS group_id FROM f ORDER BY {_HASH.format(seed=42)} LIMIT 20""")
def select_prompts(spark, sf_dir):
    """Rows whose key is in no other split, first of each key, a sample without replacement."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    pool = curate.dedup_first(curate.exclude(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), F.col("text"), F.col("text")), F.col("text"), "doc_id")
    rank = curate.hash_rank(F.col("doc_id"), 42)
    return pool.orderBy(rank).limit(20).select("doc_id", F.substring(rank, 1, 16).alias("group_id"))


@query("""SELECT item_id, substr(sha256(text), 1, 16) || '-' || j AS candidate_id, CAST(100 + (item_id * 4 + j - 1) AS BIGINT) AS seed FROM benchmark, range(1, 5) t(j)""")
def candidate_ids(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 16).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    return b.select("item_id", F.concat_ws("-", "g", F.col("j") + 1).alias("candidate_id"), (100 + F.col("item_id") * 4 + F.col("j")).alias("seed"))


@query("""WITH n AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(r) AS BIGINT) AS messages, md5(array_to_string(list_transform(t, lambda x: coalesce(x, '')), '|')) AS contents,
 CASE WHEN len(r) <> 3 THEN 'wrong number of messages' WHEN r <> ['system', 'user', 'assistant'] THEN 'wrong roles' WHEN len(list_filter(t, lambda x: x IS NULL OR trim(x) = '')) > 0 THEN 'blank content' END AS reason FROM n""")
def jsonl_round_trip(spark, sf_dir):
    """Conversations written as JSON lines and scanned again, every line with its number and why it is not valid."""
    path = new_path(spark, "conversations-jsonl")
    meta = F.struct(F.lit("train.json").alias("source"), F.col("conv_id").alias("source_index"), F.lit("natural").alias("input_style"))
    jsonl.write(_nested(spark, sf_dir).select(F.col("messages").alias("conversations"), meta.alias("metadata")), path)
    rows = jsonl.from_source(jsonl.not_empty(jsonl.scan(spark, path, strict=False)))
    contents = F.md5(F.array_join(F.transform("conversations", lambda m: F.coalesce(m["content"], F.lit(""))), "|"))
    return rows.where("line_number > 0").select(F.col("metadata.source_index").alias("conv_id"), F.size("conversations").cast("long").alias("messages"), contents.alias("contents"), F.col("reject_reason").alias("reason"))


# --- runs -----------------------------------------------------------------------------------------------------------

@query("""SELECT l.doc_id, l.lang IS DISTINCT FROM r.lang AS mismatch, l.n_chars AS left_output, r.n_chars * 2 AS right_output FROM documents l JOIN documents r USING (doc_id) WHERE doc_id % 2 = 0 AND doc_id % 3 = 0 ORDER BY doc_id LIMIT 100""")
def compare_runs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    left, right = d.where("doc_id % 2 = 0").select("doc_id", "lang", F.col("n_chars").alias("output")), d.where("doc_id % 3 = 0").select("doc_id", "lang", (F.col("n_chars") * 2).alias("output"))
    return runs.pair_runs(left, right, "doc_id", ["lang"], 100).select("doc_id", "mismatch", "left_output", "right_output")


@query("""SELECT l.doc_id, l.doc_id % 12 = 0 OR l.lang <> r.lang AS mismatch, l.n_chars AS left_output, r.n_chars AS right_output FROM documents l JOIN documents r USING (doc_id) WHERE doc_id % 2 = 0 AND doc_id % 3 = 0""")
def compare_runs_leniently(spark, sf_dir):
    """Inputs that differ are told, not refused; every twelfth line's does."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("output"))
    right = d.where("doc_id % 3 = 0").withColumn("lang", F.when(F.col("doc_id") % 12 == 0, "other").otherwise(F.col("lang")))
    return runs.pair_runs(d.where("doc_id % 2 = 0"), right, "doc_id", ["lang"], strict=False).select("doc_id", "mismatch", "left_output", "right_output")


@query("""SELECT count(*) AS rows, count(DISTINCT doc_id) AS distinct_keys, count(CASE WHEN n_chars > 500 THEN 1 END) AS with_output, count(*) = count(DISTINCT doc_id) AS "unique",
 count(CASE WHEN n_chars > 500 THEN 1 END) IN (0, count(*)) AS complete, count(*) = 1000 AS as_declared FROM documents""")
def run_integrity_whole(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("o", F.when(F.col("n_chars") > 500, F.col("text")))
    return runs.integrity(d, "doc_id", "o", 1000)


@query("""WITH l AS (SELECT user_id, arg_max(value, event_id) AS v, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT user_id, arg_max(value, event_id) AS v, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = 1 GROUP BY 1),
a AS (SELECT user_id, 'value' AS key, CAST(round(v * 100) AS BIGINT)::VARCHAR AS value FROM l UNION ALL SELECT user_id, 'type', t FROM l), b AS (SELECT user_id, 'value' AS key, CAST(round(v * 100) AS BIGINT)::VARCHAR AS value FROM r UNION ALL SELECT user_id, 'type', t FROM r)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'unknown' WHEN a.value = b.value THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id AND a.key = b.key""")
def config_diff_tristate(spark, sf_dir):
    def side(rest: int) -> DataFrame:
        last = _t(spark, sf_dir, "events").where(F.col("event_id") % 2 == rest).groupBy("user_id").agg(F.max_by(F.struct("value", "event_type"), "event_id").alias("e"))
        config = F.create_map(F.lit("value"), F.round(F.col("e.value") * 100).cast("bigint").cast("string"), F.lit("type"), F.col("e.event_type"))
        return last.select("user_id", F.explode(config).alias("key", "value"))

    return runs.compare_maps(side(0), side(1), "user_id")


_SIDE_SQL = """SELECT user_id, 'type' AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_id % 2 = {} GROUP BY 1"""


@query(f"""WITH a AS ({_SIDE_SQL.format(0)}), b AS ({_SIDE_SQL.format(1)})
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.value AS left_value, b.value AS right_value FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.value IS DISTINCT FROM b.value""")
def config_diff_differing(spark, sf_dir):
    """Only keys whose values differ, a missing side included."""
    side = lambda rest: _t(spark, sf_dir, "events").where(F.col("event_id") % 2 == rest).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("value")).withColumn("key", F.lit("type"))
    return runs.compare_maps(side(0), side(1), "user_id", differing=True).select("user_id", "left_value", "right_value")


@query("""SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS distinct_keys, count(CASE WHEN n_chars > 500 THEN 1 END) AS with_output FROM documents GROUP BY source""")
def run_integrity(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("o", F.when(F.col("n_chars") > 500, F.col("text")))
    return d.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("distinct_keys"), F.count("o").alias("with_output"))


@query("""WITH l AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM r)) AS left_only, (SELECT count(*) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS right_only, (SELECT count(*) FROM l WHERE doc_id IN (SELECT doc_id FROM r)) AS both""")
def sides_only(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id")
    return runs.side_counts(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), "doc_id")


# --- preferences, rewards, losses -----------------------------------------------------------------------------------

_PAIRS = """q AS (SELECT source, doc_id, quality, n_chars, text FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, min(doc_id) AS chosen FROM q WHERE quality = 1 GROUP BY source),
p AS (SELECT c.source, chosen, doc_id AS rejected FROM c JOIN q USING (source) WHERE quality = 0)"""


def _pairs(spark, sf_dir) -> DataFrame:
    """One chosen document a source, and each rejected one of it."""
    q = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("source", "doc_id", "quality")
    chosen = q.where("quality = 1").groupBy("source").agg(F.min("doc_id").alias("chosen"))
    return q.where("quality = 0").join(chosen, "source").select("source", "chosen", F.col("doc_id").alias("rejected"))


@query(f"WITH {_PAIRS} SELECT p.source, chosen, rejected, a.n_chars - b.n_chars AS diff FROM p JOIN documents a ON a.doc_id = chosen JOIN documents b ON b.doc_id = rejected")
def preference_pairs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    p = _pairs(spark, sf_dir).join(d.select(F.col("doc_id").alias("chosen"), F.col("n_chars").alias("a")), "chosen").join(d.select(F.col("doc_id").alias("rejected"), F.col("n_chars").alias("b")), "rejected")
    return p.select("source", "chosen", "rejected", (F.col("a") - F.col("b")).alias("diff"))


@query(f"WITH {_PAIRS} SELECT p.source AS group_id, chosen AS chosen_id, rejected AS rejected_id, a.n_chars AS chosen, b.n_chars AS rejected FROM p JOIN documents a ON a.doc_id = chosen JOIN documents b ON b.doc_id = rejected")
def label_pairs(spark, sf_dir):
    """Labels joined with the candidates that they name; one that is missing would fail."""
    labels = _pairs(spark, sf_dir).groupBy(F.col("source").alias("group_id"), F.col("chosen").alias("chosen_candidate_id")).agg(F.collect_list("rejected").alias("rejected_candidate_ids"))
    candidates = _t(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("candidate_id"), F.col("n_chars").alias("value"))
    return rewards.label_pairs(labels, candidates)


_FEATURE_SQL = f"""f AS (SELECT doc_id, text, length(text) AS n, list_filter(string_split(regexp_replace(text, {_WS}, '', 'g'), ''), lambda x: x <> '') AS ch, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z]+|\\d+') AS w FROM documents)"""
_FEATURE_COLUMNS = """(CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'ion') AS INT)) / 2 AS attr_coverage, CASE WHEN n BETWEEN 80 AND 260 THEN 1.0 ELSE greatest(0.0, 1 - abs(n - 170) / 170) END AS length_quality,
 1 - len(list_distinct(ch)) / greatest(len(ch), 1) AS char_repeat, 1 - len(list_distinct(w)) / greatest(len(w), 1) AS token_repeat, CAST(contains(text, 'sos') AS INT) AS malformed"""


@query(f"""WITH {_FEATURE_SQL}, g AS (SELECT doc_id, {_FEATURE_COLUMNS} FROM f) SELECT doc_id, round(attr_coverage, 6) AS attr_coverage, round(length_quality, 6) AS length_quality, round(char_repeat, 6) AS char_repeat, round(token_repeat, 6) AS token_repeat, CAST(1 - malformed AS DOUBLE) AS eos_complete, CAST(malformed AS DOUBLE) AS malformed FROM g""")
def pair_features(spark, sf_dir):
    v = _t(spark, sf_dir, "documents").select("doc_id", rewards.features(F.col("text"), F.array(F.lit("the"), F.lit("ion"))).alias("v"))
    return v.select("doc_id", *[_r(F.col("v")[i]).alias(n) for i, n in enumerate(rewards.FEATURES) if n != "bias"])


_NAMES = ("attr_coverage", "length_quality", "char_repeat", "token_repeat", "eos_complete", "malformed")
_SUM = " + ".join(f"w{i} * x{i}" for i in range(6))

#: The same maximum, climbed by small steps.
_FIT_SQL = f"""WITH RECURSIVE {_FEATURE_SQL}, {_PAIRS},
v AS (SELECT doc_id, CAST(contains(text, 'the') AS INT) AS v0, {_FEATURE_COLUMNS.split(" AS attr_coverage, ")[1].replace("AS length_quality", "AS v1").replace("AS char_repeat", "AS v2").replace("AS token_repeat", "AS v3").replace("AS malformed", "AS v5")}, 1 - CAST(contains(text, 'sos') AS INT) AS v4 FROM f),
n AS (SELECT {", ".join(f"CAST(a.v{i} - b.v{i} AS DOUBLE) AS x{i}" for i in range(6))}, row_number() OVER (ORDER BY rejected) - 1 AS i, count(*) OVER () AS n FROM p JOIN v a ON a.doc_id = chosen JOIN v b ON b.doc_id = rejected),
t AS MATERIALIZED (SELECT *, i < greatest(1, CAST(floor(0.8 * n) AS BIGINT)) AS seen FROM n),
w AS (SELECT 0 AS step, {", ".join(f"0.0::DOUBLE AS w{i}" for i in range(6))} UNION ALL
 SELECT step + 1, {", ".join(f"least(10.0, greatest(-10.0, any_value(w{i}) + avg((1 - 1 / (1 + exp(-({_SUM})))) * x{i}) - 0.1 * any_value(w{i})))" for i in range(6))} FROM w, t WHERE seen AND step < 400 GROUP BY step),
z AS (SELECT * FROM w WHERE step = 400), r AS (SELECT any_value(n) AS pairs, count(*) FILTER (seen AND {_SUM} > 0) / count(*) FILTER (seen) AS train_accuracy, count(*) FILTER (NOT seen AND {_SUM} > 0) / greatest(1, count(*) FILTER (NOT seen)) AS val_accuracy FROM t, z)
SELECT feature, round(weight, 6) + 0.0 AS weight, pairs, round(train_accuracy, 6) AS train_accuracy, round(val_accuracy, 6) AS val_accuracy FROM r, (SELECT 'bias' AS feature, 0.0::DOUBLE AS weight UNION ALL
 {" UNION ALL ".join(f"SELECT '{name}', w{i} FROM z" for i, name in enumerate(_NAMES))})"""


@query(_FIT_SQL)
def fit_pairwise_reward(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", rewards.features(F.col("text"), F.array(F.lit("the"))).alias("v"))
    p = _pairs(spark, sf_dir).join(d.select(F.col("doc_id").alias("chosen"), F.col("v").alias("a")), "chosen").join(d.select(F.col("doc_id").alias("rejected"), F.col("v").alias("b")), "rejected")
    fitted = rewards.fit_pairwise(p.withColumn("diff", F.zip_with("a", "b", lambda x, y: x - y)), "rejected")
    rows = [(n, round(w, 6) + 0.0, fitted["pairs"], round(fitted["train_accuracy"], 6), round(fitted["val_accuracy"], 6)) for n, w in zip(rewards.FEATURES, fitted["weights"])]
    return spark.createDataFrame(rows, "feature string, weight double, pairs long, train_accuracy double, val_accuracy double")


@query(f"""WITH {_SCORE_SQL} SELECT p_partkey, round(hits / 4 - 0.5 * rep - 0.5 * CAST(has_loop AS INT) - 0.2 * CASE WHEN length(text) < 20 OR length(text) > 520 THEN 1 ELSE 0 END, 6) AS reward FROM m""")
def rule_reward(spark, sf_dir):
    return _parsed(spark, sf_dir).select("p_partkey", _r(rewards.rule_reward(F.col("answer"), F.col("attributes"))).alias("reward"))


_TAGGED = """t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || 'a' || chr(10) || '</answer>' WHEN 1 THEN '<think>' || text || '</think>' WHEN 2 THEN '<answer>' || text || '<answer>' ELSE text END AS s FROM conversations)"""


def _tagged(spark, sf_dir) -> DataFrame:
    t, n = F.col("text"), F.lit("\n")
    full = F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n<answer>\na\n</answer>"))
    s = F.when(F.col("turn") % 4 == 0, full).when(F.col("turn") % 4 == 1, F.concat(F.lit("<think>"), t, F.lit("</think>"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("<answer>"), t, F.lit("<answer>"))).otherwise(t)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))


@query(f"""WITH {_TAGGED} SELECT conv_id, turn, CAST(CASE WHEN regexp_matches(s, '(?s)\\A<think>\\n.*?\\n</think>\\n\\n?<answer>\\n.*?\\n</answer>\\n?\\z') THEN 0.5 ELSE 0 END
 + list_sum(list_transform(['<think>', '</think>', '<answer>', '</answer>'], lambda t: CASE WHEN (length(s) - length(replace(s, t, ''))) / length(t) = 1 THEN 0.25 ELSE 0 END)) AS DOUBLE) AS reward FROM t""")
def reasoning_format_reward(spark, sf_dir):
    return _tagged(spark, sf_dir).select("conv_id", "turn", rewards.format_reward(F.col("s")).alias("reward"))


@query("""SELECT event_id, round(0.5 * CASE WHEN event_type = 'click' THEN 0.4 * least(3, greatest(-3, value - 10)) + 0.6 * least(3, greatest(-3, value / 10)) ELSE least(3, greatest(-3, value - 10)) END, 6) AS reward FROM events""")
def model_reward_blend(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    answer = F.when(F.col("event_type") == "click", F.col("value") / 10)
    return e.select("event_id", _r(rewards.blend_model_scores(F.col("value") - 10, answer, 0.5)).alias("reward"))


@query(f"""WITH {_TAGGED}, x AS (SELECT conv_id, turn, s, CASE WHEN regexp_matches(s, '(?s)<answer>.*?</answer>') THEN trim(regexp_extract(s, '(?s)<answer>(.*?)</answer>', 1), ' ' || chr(10)) END AS a FROM t)
SELECT conv_id, turn, a AS answer, round(0.5 * CASE WHEN a IS NULL THEN least(3, greatest(-3, length(s) / 100 - 2)) ELSE 0.4 * least(3, greatest(-3, length(s) / 100 - 2)) + 0.6 * least(3, length(a) / 2) END, 6) AS reward FROM x""")
def answer_reward(spark, sf_dir):
    """The answer block is scored by itself; lengths stand in for a model's scores."""
    t = _tagged(spark, sf_dir).withColumn("answer", rewards.answer_of(F.col("s")))
    reward = rewards.blend_model_scores(F.length("s") / 100 - 2, F.length("answer") / 2, 0.5)
    return t.select("conv_id", "turn", "answer", _r(reward).alias("reward"))


@query("""WITH a AS (SELECT event_id, least(10.0, greatest(-10.0, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-4))) AS a FROM events WINDOW w AS (PARTITION BY user_id)), m AS (SELECT avg(a) AS mu, stddev_pop(a) AS sd FROM a)
SELECT event_id, round((a - mu) / (sd + 1e-8), 6) + 0.0 AS advantage FROM a, m""")
def group_relative_advantage(spark, sf_dir):
    return rewards.group_advantage(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", _r("advantage").alias("advantage"))


@query("""WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS a, row_number() OVER (ORDER BY event_id DESC) AS b FROM events), s AS (SELECT count(*) AS n, avg(CASE WHEN a <= 20 THEN value END) AS h, avg(CASE WHEN b <= 20 THEN value END) AS t, min(value) AS mi, max(value) AS ma, avg(value) AS me FROM o)
SELECT n, round(h, 6) AS head_mean, round(t, 6) AS tail_mean, mi AS min_loss, ma AS max_loss, round(me, 6) AS mean_loss, round(t - h, 6) AS delta, CASE WHEN t - h < -0.005 THEN 'falling' WHEN t - h > 0.005 THEN 'rising' ELSE 'flat' END AS trend, t < 0.693147 AS below_baseline FROM s""")
def loss_log_summary(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select(F.col("event_id").alias("line_number"), F.format_string("Epoch:[1/1](%d/9) loss:%s lr:0.1", "event_id", F.col("value").cast("string")).alias("value"))
    s = logs.summarize(logs.losses(lines))
    return s.withColumns({c: _r(c) for c in ("head_mean", "tail_mean", "mean_loss", "delta")})


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(i // 64 AS BIGINT) AS batch_no FROM n WHERE i // 64 >= 5""")
def resume_batches(spark, sf_dir):
    return curate.skip_batches(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, 5)


_GATE = """g AS (SELECT vec_id, unnest(range(0, 64)) AS e, embedding[unnest(range(1, 65))]::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, e, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, e) AS r FROM s)"""


def _gate(spark, sf_dir) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"), rewards.top_experts(logits, 2).alias("top"))


@query(f"""WITH {_GATE} SELECT vec_id, CAST(r AS BIGINT) AS rank, CAST(e AS BIGINT) AS expert, round(p, 6) AS prob, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM k WHERE r <= 2""")
def topk_gate(spark, sf_dir):
    t = _gate(spark, sf_dir).select("vec_id", F.posexplode("top").alias("r", "t"))
    return t.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("t.expert").alias("expert"), _r("t.prob").alias("prob"), _r("t.weight").alias("weight"))


@query(f"""WITH {_GATE}, c AS (SELECT e, count(*) AS n FROM k WHERE r <= 2 GROUP BY e), m AS (SELECT e, avg(p) AS p FROM k GROUP BY e)
SELECT CAST(e AS BIGINT) AS expert, coalesce(n, 0) AS tokens, CAST(sum(coalesce(n, 0)) OVER (ORDER BY e) AS BIGINT) AS upto, round(p, 6) AS mean_prob, round(coalesce(n, 0) * 64 / sum(n) OVER () * p, 6) AS load FROM m LEFT JOIN c USING (e)""")
def moe_load_balance(spark, sf_dir):
    g = _gate(spark, sf_dir)
    counts = rewards.expert_counts(g.select(F.transform("top", lambda t: t["expert"]).alias("chosen")), "chosen", 64)
    probs = g.select(F.posexplode(rewards.softmax(F.col("logits"))).alias("expert", "p")).groupBy(F.col("expert").cast("long").alias("expert")).agg(F.avg("p").alias("p"))
    every = Window.partitionBy(F.lit(0))  # one row an expert
    return counts.join(probs, "expert").select("expert", "tokens", "upto", _r("p").alias("mean_prob"), _r(F.col("tokens") * 64 / F.sum("tokens").over(every) * F.col("p")).alias("load"))


@query("""WITH g AS (SELECT vec_id, label, unnest(range(0, 64)) AS e, embedding[unnest(range(1, 65))]::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, label, e, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, e) AS r FROM s), c AS (SELECT label, e, sum(CASE WHEN r <= 2 THEN 1 ELSE 0 END) * 64 / (count(*) * 2) AS load, avg(p) AS p FROM k GROUP BY label, e)
SELECT label, round(0.1 * sum(load * p), 6) AS loss FROM c GROUP BY label""")
def sequence_balance_loss(spark, sf_dir):
    """Labels stand in for sequences and all components for experts."""
    rows = _t(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    return rewards.balance_loss(rows, "label", "logits", 64, 2, 0.1).select("label", _r("loss").alias("loss"))


@query("SELECT event_id, round(0.001 * (0.1 + 0.45 * (1 + cos(pi() * event_id / 1000))), 9) AS lr FROM events")
def lr_schedule(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", _r(rewards.cosine_rate(F.col("event_id"), 1000, 0.001), 9).alias("lr"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events")
def running_best(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", metrics.best_so_far("value", "event_id", "user_id").alias("best"))


_LOGP = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS q, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM embeddings),
a AS (SELECT vec_id, list_inner_product(p, m) / greatest(list_sum(m), 1e-8) AS lp, list_inner_product(q, m) / greatest(list_sum(m), 1e-8) AS lq, list_inner_product(list_transform(list_zip(p, q), lambda z: exp(z[2] - z[1]) - (z[2] - z[1]) - 1), m) / greatest(list_sum(m), 1e-8) AS kl FROM v)"""


def _logp(spark, sf_dir) -> DataFrame:
    """A vector is a policy's log-probabilities, backwards the reference's, and tells by its signs which tokens count."""
    p = F.transform("embedding", lambda x: x.cast("double"))
    v = _t(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), F.reverse(p).alias("q"), F.transform(p, lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("m"))
    return v.select("vec_id", rewards.masked_mean(F.col("p"), F.col("m")).alias("lp"), rewards.masked_mean(F.col("q"), F.col("m")).alias("lq"), rewards.masked_mean(rewards.k3_kl(F.col("p"), F.col("q")), F.col("m")).alias("kl"))


@query(f"""WITH {_LOGP} SELECT c.vec_id, round(ln(1 + exp(-(0.1 * ((c.lp - r.lp) - (c.lq - r.lq))))), 6) AS loss FROM a c JOIN a r ON r.vec_id = c.vec_id + 1 WHERE c.vec_id % 2 = 0""")
def dpo_loss(spark, sf_dir):
    a = _logp(spark, sf_dir)
    c, r = a.where("vec_id % 2 = 0"), a.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("lp").alias("rp"), F.col("lq").alias("rq"))
    return c.join(r, "vec_id").select("vec_id", _r(rewards.dpo_loss(F.col("lp"), F.col("rp"), F.col("lq"), F.col("rq"))).alias("loss"))


@query(f"""WITH {_LOGP} SELECT round(avg(kl), 6) AS mean_kl, count(*) AS n FROM a""")
def grpo_kl(spark, sf_dir):
    return _logp(spark, sf_dir).agg(_r(F.avg("kl")).alias("mean_kl"), F.count("*").alias("n"))


@query(f"""WITH {_LOGP} SELECT round(avg(-least(exp(lp - lq) * lp, least(1.2, greatest(0.8, exp(lp - lq))) * lp)), 6) AS policy_loss, round(avg((lp - lq) * (lp - lq)), 6) AS value_loss FROM a""")
def ppo_losses(spark, sf_dir):
    a = _logp(spark, sf_dir)
    return a.agg(_r(F.avg(rewards.ppo_surrogate(F.exp(F.col("lp") - F.col("lq")), F.col("lp")))).alias("policy_loss"), _r(F.avg((F.col("lp") - F.col("lq")) ** 2)).alias("value_loss"))


@query("""WITH e AS (SELECT -value / 100 AS a, -(value + 1) / 100 AS o, -(value + 2 * (event_id % 3)) / 100 AS r, event_id % 7 - 3 AS adv, value / 100 AS v, (event_id % 5) / 5 AS w FROM events),
s AS (SELECT avg(-least(exp(a - o) * adv, least(1.005, greatest(0.995, exp(a - o))) * adv)) AS p, avg((v - w) * (v - w)) AS q, avg(a - o) AS k, avg(a - r) AS f FROM e)
SELECT round(p, 6) AS policy_loss, round(q, 6) AS value_loss, round(k, 6) AS kl, round(f, 6) AS kl_reference, round(p + 0.5 * q + 0.02 * f, 6) AS loss FROM s""")
def ppo_loss_terms(spark, sf_dir):
    v = F.col("value")
    rows = _t(spark, sf_dir, "events").select((-v / 100).alias("a"), (-(v + 1) / 100).alias("o"), (-(v + 2 * (F.col("event_id") % 3)) / 100).alias("r"), (F.col("event_id") % 7 - 3).alias("adv"), (v / 100).alias("v"), (F.col("event_id") % 5 / 5).alias("w"))
    loss = rewards.ppo_loss(rows, "a", "o", "r", "adv", "v", "w", clip=0.005)
    return loss.select(*[_r(c).alias(c) for c in loss.columns])


@query("""WITH b AS (SELECT user_id, sum(value) AS total, avg(value) AS mean, count(*) AS n FROM events GROUP BY user_id) SELECT round(avg(mean), 6) AS loss, count(*) AS batches FROM b""")
def validation_loss(spark, sf_dir):
    """The mean of batch means, each batch counting once."""
    rows = _t(spark, sf_dir, "events").select(F.lit(0).alias("rank"), "user_id", "value")
    return metrics.validation_loss(rows, "value", "user_id", "rank")[1].select(_r("loss").alias("loss"), "batches")


_IDS = """i AS (SELECT o_orderkey, list_transform(range(0, 8), lambda j: (o_orderkey * 7 + j * 3) % 11) AS ids FROM orders)"""


@query(f"""WITH {_IDS} SELECT o_orderkey, ids[8] = 2 AS ends_normal, CASE WHEN ids[8] = 2 THEN 7 ELSE 8 END::BIGINT AS content_a, CASE WHEN ids[8] = 2 THEN 'eos' ELSE 'length' END AS finish_reason, CASE WHEN list_position(ids, 2) > 0 THEN list_position(ids, 2) - 1 ELSE 8 END::BIGINT AS content_b,
 CASE WHEN list_position(ids, 2) > 0 THEN list_position(ids, 2) ELSE 8 END::BIGINT AS length_to_eos, list_min(ids) >= 0 AND list_max(ids) < 11 AS in_range, ids[8] AS last_id FROM i""")
def eos_rules(spark, sf_dir):
    """Two rules: the last id is the end token; the end token is anywhere."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("o_orderkey") * 7 + j * 3) % 11)
    t = _t(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    i, ends = F.col("ids"), rewards.ends_normally(F.col("ids"), 2)
    return t.select(
        "o_orderkey",
        ends.alias("ends_normal"),
        F.size(rewards.without_last_eos(i, 2)).cast("long").alias("content_a"),
        rewards.finish_reason(ends).alias("finish_reason"),
        F.size(rewards.before_first_eos(i, 2)).cast("long").alias("content_b"),
        rewards.first_eos(i, 2).alias("length_to_eos"),
        rewards.ids_in_range(i, 11).alias("in_range"),
        F.element_at("ids", -1).alias("last_id"),
    )


@query(f"""WITH {_IDS} SELECT round(avg(CASE WHEN list_position(ids, 2) > 0 THEN list_position(ids, 2) ELSE 8 END), 6) AS mean_length, count(*) AS n, bool_and(list_min(ids) >= 0 AND list_max(ids) < 11) AS in_range FROM i""")
def mean_response_length(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("o_orderkey") * 7 + j * 3) % 11)
    t = _t(spark, sf_dir, "orders").select(ids.alias("ids"))
    sound = t.agg(F.bool_and(rewards.ids_in_range(F.col("ids"), 11)).alias("in_range"))
    return rewards.mean_length(t, "ids", 2).join(F.broadcast(sound)).select(_r("mean_length").alias("mean_length"), "n", "in_range")


@query(f"""WITH {_IDS}, w AS (SELECT o_orderkey, list_transform(range(1, 6), lambda p: ids[p] * 1331 + ids[p + 1] * 121 + ids[p + 2] * 11 + ids[p + 3]) AS g FROM i) SELECT o_orderkey, round((5 - len(list_distinct(g))) / 5, 6) AS rep FROM w""")
def token_repetition(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("o_orderkey") * 7 + j * 3) % 11)
    return _t(spark, sf_dir, "orders").select("o_orderkey", _r(X.repetition(ids)).alias("rep"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS BIGINT) AS rank FROM orders")
def shard_by_rank(spark, sf_dir):
    return curate.shard(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 4)


@query("SELECT event_id, CAST(event_id * 8 // 3 AS BIGINT) AS step FROM events")
def resume_step(spark, sf_dir):
    """Steps after the number of workers went from 8 to 3."""
    return _t(spark, sf_dir, "events").select("event_id", curate.resumed_step(F.col("event_id"), 8, 3).alias("step"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(seed=9)}, doc_id) - 1 AS rank FROM documents")
def seeded_shuffle_all(spark, sf_dir):
    """Every document with its place in the shuffle."""
    return curate.shuffle_rank(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9).orderBy("rank")


@query("""WITH n AS (SELECT conv_id, list(role ORDER BY turn) AS r, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id FROM n WHERE r <> ['system', 'user', 'assistant'] ORDER BY conv_id LIMIT 20""")
def first_errors(spark, sf_dir):
    bad = _nested(spark, sf_dir).where(curate.reject_reason(F.col("messages")).isNotNull())
    return bad.select("conv_id").orderBy("conv_id").limit(20)


@query("""SELECT item_id AS group_id, 'c-' || item_id AS candidate_id, CASE WHEN item_id % 10 <> 0 AND item_id % 10 <> 5 THEN CAST(length(text) AS DOUBLE) END AS score,
 CASE WHEN item_id % 10 = 0 THEN 'the messages are not system and user' WHEN item_id % 10 = 5 THEN 'the score is not finite' END AS error FROM benchmark""")
def score_candidates(spark, sf_dir):
    """A stub in place of a reward model: the length of the candidate, infinite for ids ending in 5."""
    b = _t(spark, sf_dir, "benchmark")
    second = F.when(F.col("item_id") % 10 == 0, "assistant").otherwise("user")
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(second.alias("role"), F.col("item_id").cast("string").alias("content")))
    groups = b.select(F.col("item_id").alias("group_id"), messages.alias("messages"), F.concat(F.lit("c-"), F.col("item_id").cast("string")).alias("candidate_id"), "text")

    def factory():
        return lambda turns: float("inf") if turns[1]["content"].endswith("5") else len(turns[2]["content"])

    return hooks.score_candidates(groups, factory)


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{"error": "KeyError: ''conversation''"}' WHEN 1 THEN '{"error": "JSONDecodeError: Expecting value: line 1 column 1 (char 0)"}' WHEN 2 THEN '{"error": "ValueError: the score is not finite"}'
 ELSE '{"score": ' || length(text) || '.0}' END AS response FROM benchmark""")
def reward_service(spark, sf_dir):
    """Requests as lines of JSON, three of four out of form or without a finite score; the length stands in for a score."""
    turn = F.struct(F.lit("user").alias("role"), F.when(F.col("item_id") % 4 != 2, F.col("text")).alias("content"))
    asked = F.to_json(F.struct(F.array(turn).alias("conversation")), {"ignoreNullFields": "false"})
    line = F.when(F.col("item_id") % 4 == 0, "{}").when(F.col("item_id") % 4 == 1, "no json").otherwise(asked)

    def factory():
        return lambda turns: float("nan") if turns[-1]["content"] is None else len(turns[-1]["content"])

    return hooks.answer_lines(_t(spark, sf_dir, "benchmark").select("item_id", line.alias("value")), factory).select("item_id", "response")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """An extension: the windowed aggregation that streams use, over the whole table."""
    return windowed(_t(spark, sf_dir, "events")).withColumn("mean_value", _r("mean_value"))


from quernel import queries_sources  # noqa: E402, F401  (adds its own)
