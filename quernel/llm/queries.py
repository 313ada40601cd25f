"""The operators as queries over the whole tables, by contract columns, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import contamination, embeddings, langid, licenses, merkle, mixing, negatives, repeats, secrets, simhash, tokens, toxicity, warc
from quernel.llm.common import remainder, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; a null id stays null."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.count_tokens(docs, tokens.vocabulary(), keep_text=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows without an id are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.coalesce(remainder("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    scored = toxicity.score_documents(docs, model, keep_text=False)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    marked = contamination.contamination(docs, items, keep_text=False)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", contamination.digest().alias("items_sha256"), "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, keep_text=False)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "copies", F.round("margin_gap", 9).alias("margin_gap"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document; rows without an id are not held out."""
    model = langid.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    held = F.coalesce(remainder("doc_id", langid.FOLDS) == langid.HELD_OUT, F.lit(False))
    predicted = langid.predict(table(spark, sf_dir, "documents", "doc_id", "text"), model, keep_text=False)
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.find_secrets(docs, secrets.train(docs), keep_text=False).drop("secret_spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base patterns alone find, which SQL can tell too."""
    return secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), None, keep_text=False).drop("secret_spans", "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)
    spans = F.array_join(F.transform("license_spans", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"), spans.alias("license_spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are moved on by one first."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, and the root that a row leads to after some rows were tampered with."""
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    more = [F.col(f).cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    made = merkle.manifest(docs, also={"tampered": F.when(remainder("doc_id", 7) == 0, merkle.leaf(*more))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_token_counts, op2_toxicity, op3_embedding_dedup, op4_warc, op5_decontamination, op6_mixing, op7_language_id, op8_simhash_dedup, op9_secret_scan, op10_license_scan]
    ops += [op11_hard_negatives, op12_merkle_manifest, op13_substring_dedup, secret_base_spans, pipeline]
    return {f.__name__: f for f in ops}


_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         row_number() OVER () AS row
  FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.row <> b.row
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT a AS vec_id, b AS other FROM link
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a
), lowest AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links,
       least(v.vec_id, coalesce(l.other, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(l.other, v.vec_id)) AS kept
FROM v LEFT JOIN degree d ON v.vec_id = d.vec_id LEFT JOIN lowest l ON v.vec_id = l.vec_id
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS p0 FROM i WHERE len(w) > 0
), win AS (SELECT DISTINCT item, n, array_to_string(w[p0:p0 + n - 1], ' ') AS key FROM iw),
dw AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM d JOIN (SELECT DISTINCT n FROM win) s ON len(w) >= n
), hit AS (
  SELECT dw.doc_id, dw.p0, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND array_to_string(dw.w[dw.p0:dw.p0 + dw.n - 1], ' ') = win.key
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10
"""

_BYTES = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
#: CRC-32 of a list of bytes, bit by bit.
_CRC = f"""xor(4294967295, list_reduce({_BYTES}, lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT)))"""
_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("CAST(doc_id AS VARCHAR)", "source", "lang", "{0}", "text")) + ")"

_MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format("CAST(n_chars AS VARCHAR)")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format("CAST(n_chars + 1 AS VARCHAR)")} END AS changed
  FROM documents
), o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM d
), t AS (
  SELECT g, 0 AS level, pos, leaf AS h, n FROM o
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, level, pos // 2, n
), sub AS MATERIALIZED (SELECT g, h AS subroot FROM t WHERE n = 1), u AS (
  SELECT 0 AS level, g AS pos, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n
), sides AS MATERIALIZED (
  SELECT o.doc_id, o.leaf, o.g, o.pos AS place, t.level, t.h, (o.pos >> t.level) % 2 = 1 AS on_left
  FROM o JOIN t ON t.g = o.g AND t.n > 1 AND t.pos = xor(o.pos >> t.level, 1)
  UNION ALL
  SELECT o.doc_id, o.leaf, o.g, o.pos, 1000 + u.level, u.h, (o.g >> u.level) % 2 = 1
  FROM o JOIN u ON u.n > 1 AND u.pos = xor(o.g >> u.level, 1)
), levels AS (SELECT DISTINCT g, level FROM t WHERE n > 1 UNION SELECT sub.g, 1000 + u.level FROM sub, u WHERE u.n > 1),
steps AS MATERIALIZED (
  SELECT o.g, o.pos AS place, l.level, row_number() OVER (PARTITION BY o.g, o.pos ORDER BY l.level) AS i, s.h, s.on_left
  FROM o JOIN levels l ON l.g = o.g LEFT JOIN sides s ON s.g = o.g AND s.place = o.pos AND s.level = l.level
), f AS (
  SELECT g, pos AS place, 0 AS i, coalesce(changed, leaf) AS h FROM o
  UNION ALL
  SELECT f.g, f.place, f.i + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.on_left THEN s.h || f.h ELSE f.h || s.h END)
  FROM f JOIN steps s ON s.g = f.g AND s.place = f.place AND s.i = f.i + 1
), ends AS (SELECT g, place, max_by(h, i) AS folded_root FROM f GROUP BY g, place),
proofs AS (SELECT g, place, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY g, place),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT o.doc_id, o.leaf, sub.subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM o JOIN sub USING (g) CROSS JOIN root JOIN ends e ON e.g = o.g AND e.place = o.pos LEFT JOIN proofs p ON p.g = o.g AND p.place = o.pos
"""

_REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS MATERIALIZED (
  SELECT row, doc_id, p, array_to_string(w[p:p + 12], ' ') AS key
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)
), least AS (SELECT key, min(doc_id) AS first FROM w GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT row, list(DISTINCT p) AS spots FROM (SELECT row, unnest(range(p, p + 13)) AS p FROM w JOIN least USING (key) WHERE doc_id > first) GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {'x': x, 'i': i}), lambda s: NOT coalesce(list_contains(spots, s.i), false)), lambda s: s.x), ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.row = d.row
"""


_SECRET_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k(kind, place, pattern, least) AS (
  VALUES ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
         ('access', 1, '(AKIA[A-Z0-9]+)', 16), ('hex', 2, '([0-9a-f]+)', 32)),
m AS (SELECT doc_id, t, kind, place, least, regexp_extract_all(t, pattern, 0) AS whole, regexp_extract_all(t, pattern, 1) AS part, string_split_regex(t, pattern) AS gaps FROM d, k),
u AS (SELECT doc_id, kind, place, least, whole[i] AS w, part[i] AS p,
        list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS a
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m)),
s AS (SELECT doc_id, kind, place, CAST(a AS BIGINT) AS a, CAST(a + length(w) AS BIGINT) AS b FROM u WHERE length(p) >= least),
g AS (SELECT doc_id, count_if(place = 0) AS x, count_if(place = 1) AS y, count_if(place = 2) AS z, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS l FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(x, 0) AS BIGINT) AS n_assign, CAST(coalesce(y, 0) AS BIGINT) AS n_access, CAST(coalesce(z, 0) AS BIGINT) AS n_hex, sha256(coalesce(l, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": _EMBEDDING_SQL, "op4_warc": _WARC_SQL, "op5_decontamination": _DECONTAMINATION_SQL,
        "secret_base_spans": _SECRET_BASE_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_merkle_manifest": _MERKLE_SQL, "op13_substring_dedup": _REPEATS_SQL,
    }
