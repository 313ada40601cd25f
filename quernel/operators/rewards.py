"""Preference features, rewards, advantages and losses as column arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.attributes import coverage
from quernel.functions.text import char_repetition, chars, has_loop, let, occurrences, squeeze, strip
from quernel.operators import curate
from quernel.plans.storage import discard, materialize

# Names of the features of a candidate, and the words that mark a malformed one.
FEATURES = ("bias", "attr_coverage", "length_quality", "char_repeat", "token_repeat", "eos_complete", "malformed")
MALFORMED = "�|嘿嘿|sos|mrang|不锈钢|遗传|危机|透视效果|防晒外套|冬天的冬天"


def _repeat(items: Column) -> Column:
    return let(items, lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))


def features(text: Column, wanted: Column) -> Column:
    """Seven features of a candidate; ``wanted`` are the strings (names and values) that it should contain."""
    t = F.coalesce(text, F.lit(""))
    w = F.coalesce(wanted, F.array().cast("array<string>"))
    n = F.length(t)
    bad = t.rlike(MALFORMED).cast("double")
    # Fixed value: what counts as a word.
    words = F.regexp_extract_all(t, F.lit(r"(?U)([一-鿿]|[A-Za-z]+|\d+)"), F.lit(1))
    return F.array(
        F.lit(1.0),
        F.size(F.filter(w, lambda x: t.contains(x))) / F.greatest(F.size(w), F.lit(1)),
        F.when(n.between(80, 260), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - 170) / 170)),
        _repeat(chars(squeeze(t))),
        _repeat(words),
        1 - bad,
        bad,
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), x))))


def fit_pairwise(pairs: DataFrame, order: str, diff: str = "diff", l2: float = 0.1, clip: float = 10.0, most_steps: int = 100) -> dict:
    """Pairwise logistic weights; the first four fifths by ``order`` train, the rest is held out.

    The weights are the one maximum of the mean of log sigmoid(weights * diff) less l2 / 2 * |weights|^2 with no weight
    beyond ``clip``: where an ascent by small steps, clipped at each, ends. It is reached by Newton's method over the
    weights that are free, at every size: a step is one aggregation of slopes and curvatures where the pairs are, and
    only sums reach the driver. ``order`` is to be unique. Without pairs the weights are empty.
    """
    numbered = materialize(curate.numbered(pairs.select(order, diff), order, "_n"), "numbered-pairs")
    n, width = numbered.agg(F.count("*"), F.coalesce(F.max(F.size(diff)), F.lit(0))).first()
    cut = max(1, int(0.8 * n))
    x = [F.get(diff, F.lit(i)) for i in range(width)]
    score = lambda w: sum((F.lit(float(a)) * b for a, b in zip(w, x)), F.lit(0.0))
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, slopes and curvatures."""
        rows = numbered.where(F.col("_n") < cut).select(*[v.alias(f"x{i}") for i, v in enumerate(x)], score(w).alias("s"))
        rows = rows.withColumn("p", sigmoid(F.col("s")))
        spread = F.col("p") * (1 - F.col("p"))
        slopes = [F.sum((1 - F.col("p")) * F.col(f"x{i}")) for i in range(width)]
        curves = [F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]
        sums = np.array(rows.agg(F.sum(F.log("p")), *slopes, *curves).first(), float) / cut
        curved = np.zeros((width, width))
        for (i, j), v in zip(upper, sums[1 + width :]):
            curved[i, j] = curved[j, i] = v
        return sums[0] - l2 / 2 * float(w @ w), sums[1 : 1 + width] - l2 * w, curved + l2 * np.eye(width)

    w = np.zeros(width)
    if n:
        value, slope, curved = at(w)
    for _ in range(most_steps if n else 0):
        free = ~(((w >= clip) & (slope > 0)) | ((w <= -clip) & (slope < 0)))
        if not free.any() or np.abs(slope[free]).max() < 1e-12:
            break
        step = np.zeros(width)
        step[free] = np.linalg.solve(curved[np.ix_(free, free)], slope[free])
        following = np.clip(w + step, -clip, clip)
        there = at(following)
        while there[0] < value - 1e-12 and np.abs(step).max() > 1e-12:  # too far
            step = step / 2
            following = np.clip(w + step, -clip, clip)
            there = at(following)
        w, (value, slope, curved) = following, there
    seen = F.col("_n") < cut
    right = numbered.agg(F.count_if(seen & (score(w) > 0)), F.count_if(~seen & (score(w) > 0))).first()
    discard(numbered)
    return {"weights": w.tolist(), "pairs": n, "train_pairs": min(cut, n), "val_pairs": max(0, n - cut), "train_accuracy": right[0] / cut, "val_accuracy": right[1] / max(1, n - cut)}


def rule_reward(text: Column, attributes: Column, coverage_weight: float = 1.0, repeat: float = 0.5, loop: float = 0.5, length: float = 0.2) -> Column:
    """Coverage less penalties for repetition, loops and lengths out of 20 to 520; null attributes count as uncovered."""
    n = F.length(text)
    out_of_range = ((n < 20) | (n > 520)).cast("double")
    covered = F.coalesce(coverage(attributes, text)["literal_coverage"], F.lit(0.0))
    return coverage_weight * covered - repeat * char_repetition(text) - loop * has_loop(text).cast("double") - length * out_of_range


def format_reward(text: Column) -> Column:
    """0.5 for the think/answer layout, 0.25 for each of its four tags that occurs exactly once."""
    laid_out = text.rlike(r"(?s)\A<think>\n.*?\n</think>\n\n?<answer>\n.*?\n</answer>\n?\z")
    once = [F.when(occurrences(text, t) == 1, 0.25).otherwise(0.0) for t in ("<think>", "</think>", "<answer>", "</answer>")]
    return F.when(laid_out, 0.5).otherwise(0.0) + once[0] + once[1] + once[2] + once[3]


def answer_of(text: Column) -> Column:
    """What stands in the first <answer> block, stripped; null without one."""
    return F.when(text.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)))


def blend_model_scores(full: Column, answer: Column, weight: float, clip: float = 3.0) -> Column:
    """Clipped model score, blended 0.4 to 0.6 with that of the answer where there is one; non-finite scores fail.

    At weight 0 the reward is 0 and no score is looked at.
    """
    if weight == 0:
        return F.lit(0.0)
    sound = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a model score is not finite"))).otherwise(F.least(F.lit(clip), F.greatest(F.lit(-clip), c)))
    return F.lit(weight) * F.when(answer.isNull(), sound(full)).otherwise(0.4 * sound(full) + 0.6 * sound(answer))


def label_pairs(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """(group_id, chosen_id, rejected_id, chosen, rejected): one row a rejected candidate of a label.

    ``labels`` are (group_id, chosen_candidate_id, rejected_candidate_ids), ``candidates`` (group_id, candidate_id, value).
    A label that names a candidate which its group does not have fails.
    """
    each = labels.select("group_id", F.col("chosen_candidate_id").alias("chosen_id"), F.explode("rejected_candidate_ids").alias("rejected_id"))
    out = each
    for side in ("chosen", "rejected"):
        own = candidates.select("group_id", F.col("candidate_id").alias(f"{side}_id"), F.struct("value").alias(f"_{side}"))
        missing = F.raise_error(F.concat_ws(" ", F.lit("no candidate"), F.col(f"{side}_id"), F.lit("in group"), F.col("group_id").cast("string")))
        found = F.when(F.col(f"_{side}").isNull(), missing.cast(candidates.schema["value"].dataType)).otherwise(F.col(f"_{side}.value"))
        out = out.join(own, ["group_id", f"{side}_id"], "left").withColumn(side, found).drop(f"_{side}")
    return out.select("group_id", "chosen_id", "rejected_id", "chosen", "rejected")


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """``advantage``: reward standardised in its group, clamped to 10, then whitened over all rows.

    The moments over all rows are one aggregated row met by broadcast; no window spans the table.
    """
    w = Window.partitionBy(group)
    inner = (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + 1e-4)
    out = df.withColumn("_a", F.least(F.lit(10.0), F.greatest(F.lit(-10.0), inner)))
    moments = out.agg(F.avg("_a").alias("_m"), F.stddev_pop("_a").alias("_s"))
    return out.join(F.broadcast(moments)).withColumn("advantage", (F.col("_a") - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_a", "_m", "_s")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def masked_mean(values: Column, mask: Column, floor: float = 1e-8) -> Column:
    return _sum(F.zip_with(values, mask, lambda v, m: v * m)) / F.greatest(_sum(mask), F.lit(floor))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """Of mean log-probabilities: -log sigmoid(beta * difference of the log-ratios)."""
    x = beta * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return F.greatest(F.lit(0.0), -x) + F.log1p(F.exp(-F.abs(x)))


def k3_kl(policy: Column, reference: Column) -> Column:
    """Per token exp(d) - d - 1 with d = reference - policy."""
    return F.zip_with(policy, reference, lambda p, r: F.exp(r - p) - (r - p) - 1)


def ppo_surrogate(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    return -F.least(ratio * advantage, F.least(F.lit(1 + clip), F.greatest(F.lit(1 - clip), ratio)) * advantage)


def softmax(logits: Column) -> Column:
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def top_experts(logits: Column, k: int) -> Column:
    """array<struct<prob, expert, weight>> of the k likeliest experts, weights scaled to sum to 1; ties by expert."""
    indexed = F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("neg"), i.alias("expert")))

    def scaled(best: Column, total: Column) -> Column:
        return F.transform(best, lambda b: F.struct((-b["neg"]).alias("prob"), b["expert"].cast("long").alias("expert"), (-b["neg"] / total).alias("weight")))

    return let(F.slice(F.array_sort(indexed), 1, k), lambda best: let(_sum(F.transform(best, lambda b: -b["neg"])) + 1e-20, lambda total: scaled(best, total)))


def cosine_rate(step: Column, total: int, rate: float) -> Column:
    return rate * (0.1 + 0.45 * (1 + F.cos(np.pi * step / total)))


def first_eos(ids: Column, eos: int) -> Column:
    """1-based place of the first end token, else the full length."""
    at = F.array_position(ids, eos)
    return F.when(at > 0, at).otherwise(F.size(ids)).cast("long")


def ends_normally(ids: Column, eos: int) -> Column:
    """Whether the last id is the end token; false without ids."""
    return F.coalesce(F.get(ids, F.size(ids) - 1) == eos, F.lit(False))


def without_last_eos(ids: Column, eos: int) -> Column:
    """Content ids by the rule of the last id: all but an end token at the end."""
    return F.when(ends_normally(ids, eos), F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)


def before_first_eos(ids: Column, eos: int) -> Column:
    """Content ids by the rule of the first end token anywhere: those before it, or all without one."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(ids)


def finish_reason(normal: Column) -> Column:
    return F.when(normal, "eos").otherwise("length")


def upto_eos(ids: Column, eos: int) -> Column:
    """1 for every place up to and with the first end token, 0 after it."""
    return let(first_eos(ids, eos), lambda n: F.transform(ids, lambda x, i: (i < n).cast("int")))


def last_kept(values: Column, mask: Column) -> Column:
    """The value at the last place that ``mask`` (ones, then zeros) keeps; null without one."""
    return F.get(values, F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")) - 1)


def balance_loss(df: DataFrame, sequence: str, logits: str, experts: int, k: int, alpha: float = 1.0) -> DataFrame:
    """(sequence, load, loss) of tokens: for each sequence the sum over experts of load times mean probability, times ``alpha``.

    ``load`` has the share of a sequence's routed slots that each expert got, times the number of experts.
    """
    rows = df.select(sequence, softmax(F.col(logits)).alias("p"), F.transform(top_experts(F.col(logits), k), lambda t: t["expert"]).alias("e"))
    slots = [F.sum(F.when(F.array_contains("e", F.lit(i).cast("long")), 1.0).otherwise(0.0)) / (F.count("*") * k) * experts for i in range(experts)]
    means = [F.avg(F.col("p")[i]) for i in range(experts)]
    sums = rows.groupBy(sequence).agg(F.array(*slots).alias("load"), F.array(*means).alias("_p"))
    return sums.select(sequence, "load", (alpha * _sum(F.zip_with("load", "_p", lambda a, b: a * b))).alias("loss"))


def expert_counts(df: DataFrame, chosen: str, experts: int) -> DataFrame:
    """(expert, tokens, upto) of every one of ``experts``: how many slots went to it, and to it and those before it.

    ``chosen`` is the array of a row's experts. Slots are counted before the shuffle; an expert without any has 0.
    """
    counts = df.select(F.explode(chosen).alias("expert")).groupBy(F.col("expert").cast("long").alias("expert")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(experts).select(F.col("id").alias("expert"))
    upto = Window.orderBy("expert").rowsBetween(Window.unboundedPreceding, 0)  # one row an expert
    tokens = F.coalesce("n", F.lit(0))
    return every.join(F.broadcast(counts), "expert", "left").select("expert", tokens.alias("tokens"), F.sum(tokens).over(upto).alias("upto"))


def ppo_loss(df: DataFrame, actor: str, old: str, reference: str, advantage: str, value: str, reward: str, clip: float = 0.2, value_weight: float = 0.5, kl_weight: float = 0.02) -> DataFrame:
    """One row: policy_loss, value_loss, kl (to the policy that sampled), kl_reference, loss, over rows of summed log-probabilities."""
    a, o, r = F.col(actor), F.col(old), F.col(reference)
    parts = df.agg(
        F.avg(ppo_surrogate(F.exp(a - o), F.col(advantage), clip)).alias("policy_loss"),
        F.avg((F.col(value) - F.col(reward)) ** 2).alias("value_loss"),
        F.avg(a - o).alias("kl"),
        F.avg(a - r).alias("kl_reference"),
    )
    return parts.withColumn("loss", F.col("policy_loss") + value_weight * F.col("value_loss") + kl_weight * F.col("kl_reference"))


def mean_length(df: DataFrame, ids: str, eos: int) -> DataFrame:
    """One row: mean_length of id sequences up to and with their first end token, n."""
    return df.agg(F.avg(first_eos(F.col(ids), eos)).alias("mean_length"), F.count(ids).alias("n"))


def ids_in_range(ids: Column, size: int) -> Column:
    """Whether a sequence of ids is not empty and all lie in a vocabulary of ``size``."""
    return (F.size(ids) > 0) & F.forall(ids, lambda i: (i >= 0) & (i < size))
