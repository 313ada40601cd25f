"""Whole flows from scans to written results and their reports, composed of the other operators.

Frames stay distributed; only counts, roll-ups and single examples come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import attributes as A
from quernel.functions import text as X
from quernel.operators import curate, metrics, rewards, runs
from quernel.plans.storage import materialize
from quernel.sources import jsonl, reports

PHRASE = "穿着舒适"  # Fixed value: the phrase that a good answer does not repeat.


def style(metadata: str = "metadata"):
    return F.coalesce(F.col(metadata)["input_style"], F.lit("unknown"))


def canonical(*columns: str):
    """Row text in which names are sorted at every level, nulls kept: equal rows have equal texts, whatever order their fields have.

    A column of text is a value; ``canonical_json`` reads it as a document.
    """
    return canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def canonical_json(text):
    """A JSON document, of whatever shape, in its canonical text, as VARIANT stores it: names sorted at every level, no blanks. Null if it is malformed."""
    return F.to_json(F.try_parse_json(text), {"ignoreNullFields": "false"})


def prepare(train: DataFrame, val: DataFrame, test: DataFrame, smoke: int = 5000, seed: int = 42) -> tuple[dict[str, DataFrame], dict]:
    """Clean splits and their report: exact duplicates go, first kept; validation rows found in test go; a stratified sample of train.

    Splits that still share a conversation fail.
    """
    source = {"train": train, "val": val, "test": test}
    key = X.conversation_key(F.col("conversations"))
    keyed = {n: materialize(d.withColumn("key", key).withColumn("input_style", style()), n) for n, d in source.items()}
    clean = {n: curate.dedup_first(d, F.col("key"), "line_number") for n, d in keyed.items()}
    unique_val = clean["val"].count()
    clean["val"] = curate.exclude(clean["val"], clean["test"], F.col("key"), F.col("key"))
    clean = {n: materialize(d, n) for n, d in clean.items()}
    every = None
    for n, d in clean.items():
        part = d.select(F.lit(n).alias("split"), "key")
        every = part if every is None else every.unionByName(part)
    overlaps = {f"{r['left_split']}_{r['right_split']}": r["both"] or 0 for r in curate.overlap_counts(every, "split", "key", ("train", "val", "test")).collect()}
    if any(overlaps.values()):
        raise ValueError(f"splits share conversations: {overlaps}")
    clean["smoke"] = curate.stratified_round(clean["train"], "input_style", "key", smoke, seed)
    counts = {n: d.count() for n, d in keyed.items()}
    kept = {n: d.count() for n, d in clean.items()}
    styles = {n: {r["input_style"]: r["count"] for r in d.groupBy("input_style").count().orderBy("input_style").collect()} for n, d in clean.items()}
    removed = {"train_duplicates": counts["train"] - kept["train"], "val_duplicates": counts["val"] - unique_val, "test_duplicates": counts["test"] - kept["test"], "val_in_test": unique_val - kept["val"]}
    return clean, {"seed": seed, "source_counts": counts, "clean_counts": kept, "removed": removed, "style_counts": styles, "overlaps": overlaps}


def analyse(rows: DataFrame) -> DataFrame:
    """Rows with attributes, parse error, coverage, key coverage (true without key attributes), phrase count, repetition, loop, structure and template."""
    user, answer = curate.only_text(F.col("conversations"), "user"), curate.only_text(F.col("conversations"), "assistant")
    out = A.with_parsed(rows, user, "_p").withColumn("answer", answer).select("*", "_p.attributes", "_p.error").drop("_p")
    own = A.coverage(F.col("attributes"), F.col("answer"), ("类型", "颜色"))
    error = F.coalesce(F.col("error"), F.when(F.col("answer").isNull(), "not one answer"))
    return out.withColumns({
        "error": error,
        "coverage": own["literal_coverage"],
        "all_covered": F.coalesce(own["all_attributes_covered"], F.lit(False)),
        "key_covered": own["key_attribute_hits"] == own["key_attribute_count"],
        "phrase_count": X.occurrences(F.col("answer"), PHRASE),
        "char4": X.char_repetition(F.col("answer")),
        "loop": X.has_loop(F.col("answer")),
        "structure": F.to_json(A.structure(F.col("attributes"))),
        "template": X.template(F.col("answer"), F.col("attributes")),
    })


def eligible(most_repetition: float = 0.10):
    """Whether an analysed row's phrase stands once at most, and whether such a row may enhance a corpus besides."""
    phrase = F.col("phrase_count") < 2
    return phrase, phrase & F.col("all_covered") & F.col("key_covered") & ~F.col("loop") & (F.col("char4") <= most_repetition)


def enhancement(rows: DataFrame, target: int = 5000, most_repetition: float = 0.10, seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """(all rows without a repeated phrase, a diverse choice of the covered ones, report); unparsable rows are told, not used."""
    seen = materialize(analyse(rows.withColumn("key", X.conversation_key(F.col("conversations")))), "analysed")
    good = seen.where("error is null")
    once, usable = eligible(most_repetition)
    phrase, fit = good.where(once), good.where(usable)
    chosen = materialize(curate.choose_diverse(fit, "structure", "template", "key", target, seed), "chosen")
    bad = seen.where("error is not null").orderBy("line_number").limit(20).select("line_number", "error").collect()
    kinds = chosen.groupBy(F.get_json_object("structure", "$.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("position").alias("p")).orderBy(F.desc("n"), "p", "kind").collect()
    one = chosen.agg(F.count("*").alias("selected"), F.countDistinct("structure").alias("structures"), F.countDistinct("template").alias("templates"), F.avg("coverage").alias("coverage"), F.max("char4").alias("most_repetition")).first().asDict()
    report = one | {"rows": seen.count(), "without_phrase": phrase.count(), "eligible": fit.count(), "errors": [r.asDict() for r in bad], "kinds": [[r["kind"], r["n"]] for r in kinds]}
    return phrase.select(*rows.columns), chosen.select(*rows.columns, "position"), report


def mixed(enhanced: DataFrame, clean: DataFrame, replay: int, seed: int = 42) -> tuple[DataFrame, dict]:
    """Enhancement rows plus a stratified replay of clean rows that are none of them, shuffled by hash (column ord)."""
    row = canonical("conversations", "metadata")
    with_key = lambda d: d.select("conversations", "metadata").withColumns({"row_key": F.sha2(row, 256), "input_style": style()})
    e, c = with_key(enhanced), with_key(clean)
    if e.count() != e.select("row_key").distinct().count():
        raise ValueError("the enhancement rows hold duplicates")
    out = materialize(curate.mix_replay(e, c, F.col("row_key"), "input_style", "row_key", replay, seed), "mixed")
    parts = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
    styles = {r["input_style"]: r["count"] for r in out.groupBy("input_style").count().orderBy("input_style").collect()}
    return out.orderBy("ord"), {"seed": seed, "parts": parts, "style_counts": styles}


def evaluate(rows: DataFrame, outputs: DataFrame | None = None, eos: int | None = None) -> tuple[DataFrame, dict]:
    """(samples, summary) of rows of ``jsonl.with_attributes``: metrics of references, and of outputs (line_number, output, token_ids) if given.

    A model's state is normal if its last id is ``eos``; content ids go without it.
    """
    messages = F.col("conversations")
    samples = rows.select("line_number", "metadata", F.slice(messages, 1, 2).alias("messages"), "attributes", F.element_at(messages, -1)["content"].alias("reference"))
    samples = samples.withColumns({"reference_metrics": A.score(F.col("reference"), F.col("attributes")), "input_style": style()})
    names = ["reference_metrics"]
    if outputs is not None:
        ids = F.col("token_ids")
        normal = F.lit(None).cast("boolean") if eos is None else rewards.ends_normally(ids, eos)
        content = ids if eos is None else rewards.without_last_eos(ids, eos)
        samples = samples.join(outputs, "line_number").withColumn("output_metrics", A.score(F.col("output"), F.col("attributes"), content, normal))
        names.append("output_metrics")
    samples = materialize(samples, "samples")
    summary = {"status": "complete", "samples": samples.count(), "overall": {}, "by_input_style": {}}
    for n in names:
        r = reports.nested(metrics.aggregate(samples, n, ["input_style"]), "input_style")
        summary["overall"][n] = r["overall"]
        for s, v in r.get("by_input_style", {}).items():
            summary["by_input_style"].setdefault(s, {})[n] = v
    return samples, summary


def write_run(spark: SparkSession, path: str, samples: DataFrame, summary: dict, manifest: dict) -> None:
    """samples.jsonl, manifest.json and, last, summary.json; an existing run is refused."""
    reports.write_json(spark, f"{path}/manifest.json", manifest)
    jsonl.write(samples, f"{path}/samples.jsonl")
    reports.write_json(spark, f"{path}/summary.json", summary)


def rescored(samples: DataFrame) -> DataFrame:
    """Samples whose coverage is derived anew from their prompts; all rows have an output, or none."""
    state = runs.integrity(samples, "line_number", "output").first() if "output" in samples.columns else None
    if state and not (state["unique"] and state["complete"]):
        raise ValueError("lines repeat, or only some rows have an output")
    out = A.with_parsed(samples, F.element_at("messages", 2)["content"], "_p").withColumn("attributes", F.col("_p.attributes")).drop("_p")
    out = out.withColumn("reference_metrics", A.rescore(F.col("reference_metrics"), F.col("reference"), F.col("attributes")))
    return out.withColumn("output_metrics", A.rescore(F.col("output_metrics"), F.col("output"), F.col("attributes"))) if state else out


def compare(left: DataFrame, right: DataFrame, limit: int = 200) -> tuple[DataFrame, dict]:
    """(paired rows, report) of two runs' samples; different inputs are refused, lines of one side are counted."""
    prepared = [d.select("line_number", "input_style", F.to_json("messages").alias("messages"), "reference", F.to_json(F.array_sort("attributes")).alias("attributes"), "output", "output_metrics") for d in (left, right)]
    paired = materialize(runs.pair_runs(*prepared, "line_number", ["messages", "reference", "attributes"], limit), "paired")
    if paired.isEmpty():
        raise ValueError("no shared samples")
    sides = {}
    for s in ("left", "right"):
        rows = paired.select(F.col(f"{s}_input_style").alias("input_style"), F.col(f"{s}_output_metrics").alias("metrics"))
        sides[s] = reports.nested(metrics.aggregate(rows, by=["input_style"]), "input_style")
    only = [a.join(b, "line_number", "left_anti").count() for a, b in (prepared, prepared[::-1])]
    return paired, {"compared_samples": paired.count(), "left_only": only[0], "right_only": only[1]} | sides


def evaluate_candidates(groups: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics by candidate, roll-up overall and by group) of groups (group_id, attributes, candidates array<struct<candidate_id, text, content_token_ids, eos_normal>>).

    Groups of fewer than two candidates, or with repeated candidate ids, fail. ``only`` names the metrics of the roll-up, all by default.
    """
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    problem = F.when(F.size("candidates") < 2, "fewer than two candidates").when(F.size(ids) != F.size(F.array_distinct(ids)), "candidate ids repeat")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("group "), F.col("group_id"), F.lit(": "), problem))).otherwise(F.col("candidates"))
    rows = groups.select("group_id", "attributes", F.explode(checked).alias("c"))
    scored = rows.select("group_id", F.col("c.candidate_id").alias("candidate_id"), A.score(F.col("c.text"), F.col("attributes"), F.col("c.content_token_ids"), F.col("c.eos_normal")).alias("metrics"))
    scored = materialize(scored, "candidates")
    return scored, metrics.aggregate(scored, by=["group_id"], only=only)
