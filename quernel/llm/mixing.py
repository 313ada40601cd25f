"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are raked to the target share of each source,
each language and each topic in turn until all three margins agree. A document's probability is its cell's weight per
token, scaled; documents are sampled by a hash of their id against it, so a sample is the same on every cluster.

The sample has a stated share of all tokens, whatever the rarest cell. No cell can give more than all its tokens: that
is its cap, raking holds every weight under it, and what a cell or a value cannot give is raked over the others.

Everything is a DataFrame operation. Raking works on the cells alone, not on documents, and needs sums by margin only:
windows in one partition up to SMALL cells, aggregations and joins beyond. Totals are single numbers.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import broadcast_if_small
from quernel.plans.storage import discard, materialize

ALPHA = 0.7  # exponent that tempers the observed shares to default targets
KEEP = 0.5  # share of all tokens that a sample has without a budget
TOLERANCE = 1e-6
ROUNDS, STEPS = 24, 4  # at most, and iterations of a round; rounds are written tables
STALLED = 0.9999  # share of the gap before, over which a round has not helped: the targets contradict each other
SMALL = 100_000  # cells up to which sums by margin are windows in one partition
MARGINS = ("source", "lang", "topic")
SEED = 11


def topic(text: str = "text") -> Column:
    """A coarse topic told from whole texts; never null."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(~t.rlike(r"\S"), "empty")
        .when(t.contains(" | "), "table")
        .when(t.contains("###") | t.contains("$$$") | t.contains("%%%"), "markup")
        .when(F.lower(t).contains("licen"), "legal")
        .when(F.length(t) < 1000, "short")
        .when(F.length(t) < 8000, "article")
        .otherwise("long")
    )


def tokens(text: str = "text") -> Column:
    """Words of a text: maximal runs without blanks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def cells(docs: DataFrame) -> DataFrame:
    """source, lang, topic (null: ``unknown``), tokens and documents of each cell with tokens."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("documents")).where("tokens > 0")


def tempered(cell_tokens: DataFrame, margin: str, alpha: float = ALPHA) -> DataFrame:
    """Target shares (value, share) of a margin: observed shares to the power ``alpha``, scaled to sum to 1."""
    by = cell_tokens.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens"), alpha).alias("power"))
    total = by.agg(F.sum("power")).first()[0]
    return by.select("value", (F.col("power") / F.lit(total)).alias("share"))


def _with_sums(cells: DataFrame, margin: str, sums: dict[str, Column], small: bool, written: list[DataFrame]) -> DataFrame:
    """``cells`` with sums over the cells of the same value of ``margin``; tables that it writes are added to ``written``."""
    if small:
        return cells.withColumns({k: F.sum(c).over(Window.partitionBy(margin)) for k, c in sums.items()})
    # both sides read the cells: written first, or plans would double with every margin
    cells = materialize(cells, "cells")
    written.append(cells)
    return cells.join(cells.groupBy(margin).agg(*[F.sum(c).alias(k) for k, c in sums.items()]), margin)


def _spread(rows: DataFrame) -> float:
    """The factor by which ``wanted``, held under ``most``, sums to 1 (or to all of ``most`` where that is less).

    It follows from the rows over their caps at the factor before, and only grows.
    """
    factor = 1 / (rows.agg(F.sum("wanted")).first()[0] or 1)
    while True:
        over = F.col("wanted") * factor >= F.col("most")
        held, free = rows.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("wanted"))), F.lit(0.0))).first()
        following = (1 - held) / free if free > 0 else factor
        if following <= factor * (1 + 1e-12):
            return factor
        factor = following


def _goals(cells: DataFrame, margin: str, shares: DataFrame, capped: bool) -> DataFrame:
    """(margin, to_margin): what the weights of each value are to sum to; 1 in all, and none over its caps.

    Values without a target keep their share; a target of values without cells is spread over the others, as is what
    is over the caps.
    """
    goal = f"to_{margin}"
    by = cells.groupBy(margin).agg(F.sum("raw").alias("own"), F.sum("cap").alias("most"))
    by = by.join(shares.select(F.col("value").alias(margin), "share"), margin, "left")
    by = materialize(by.select(margin, "most", F.coalesce("share", "own").alias("wanted")), "goals")
    wanted = F.col("wanted") * (_spread(by) if capped else 1 / (by.agg(F.sum("wanted")).first()[0] or 1))
    return by.select(margin, (F.least("most", wanted) if capped else wanted).alias(goal))


def rake(cell_tokens: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, steps: int = STEPS, keep: float | None = None, strict: bool = False) -> DataFrame:
    """``cell_tokens`` with ``weight``, whose margins agree with ``targets`` (value, share) by name of the margin, and ``margin_gap``.

    Stops when no margin is off by over ``tolerance``, when a round brings the margins no nearer (targets may contradict
    each other where cells are missing or small), or after ``rounds`` times ``steps`` iterations: ``margin_gap`` is how far the worst margin is off, in every row; a
    gap over the tolerance is warned of, or with ``strict`` an error. Values without a target keep the share they have
    among all; a target of values without cells is spread over the others. With ``keep``, a share of all tokens up to 1,
    no weight is over what its cell's tokens are of that many; targets over what a value's cells can give are spread
    over the others, and weights sum to 1 even where margins do not agree. Without cells there are no weights.
    """
    count, total = cell_tokens.agg(F.count("*"), F.sum("tokens")).first()
    if not count:
        return cell_tokens.withColumns({"weight": F.lit(0.0), "margin_gap": F.lit(0.0)})
    small = count <= SMALL
    together = (lambda d: d.coalesce(1)) if small else (lambda d: d)
    capped = keep is not None
    own = F.col("tokens") / F.lit(float(total))
    out = cell_tokens.withColumns({"raw": own, "cap": own / F.lit(float(keep)) if capped else F.lit(float("inf"))})
    for name in targets:
        out = out.join(broadcast_if_small(_goals(out, name, targets[name], capped)), name)
    out = materialize(out, "cells")
    weight = F.least("raw", "cap")
    gap, best, idle = float("inf"), float("inf"), 0
    for _ in range(rounds):
        step, written = together(out), [out]
        for _ in range(steps):
            for name in targets:
                at_cap = F.col("raw") >= F.col("cap")
                step = _with_sums(step, name, {"_held": F.when(at_cap, F.col("cap")).otherwise(0.0), "_free": F.when(at_cap, 0.0).otherwise(F.col("raw"))}, small, written)
                goal = F.col(f"to_{name}")
                # what is left for cells under their caps; all shrink where the capped ones alone are too much
                factor = F.when(F.col("_held") >= goal, goal / (F.col("_held") + F.col("_free"))).when(F.col("_free") > 0, (goal - F.col("_held")) / F.col("_free")).otherwise(1.0)
                step = step.withColumn("raw", F.when(F.col("_held") >= goal, weight * factor).otherwise(F.col("raw") * F.coalesce(factor, F.lit(1.0)))).drop("_held", "_free")
        out = materialize(step, "cells")
        for old in written:
            discard(old)
        gaps = []
        for name in targets:
            apart = together(out).groupBy(name).agg(F.abs(F.sum(weight) - F.first(f"to_{name}")).alias("off"))
            gaps.append(apart.agg(F.max("off")).first()[0] or 0.0)
        gap = max(gaps, default=0.0)
        idle = idle + 1 if gap > STALLED * best else 0
        best = min(best, gap)
        if gap <= tolerance or idle == 2:
            break
    if gap > tolerance:
        if strict:
            raise ValueError(f"a margin is off its target by {gap}")
        warnings.warn(f"a margin is off its target by {gap}", stacklevel=2)
    factor = _spread(out.select(weight.alias("wanted"), F.col("cap").alias("most"))) if capped else 1.0
    return out.select(*cell_tokens.columns, F.least("cap", weight * factor).alias("weight"), F.lit(float(gap)).alias("margin_gap"))


def probabilities(raked: DataFrame, budget: float | None = None, keep: float = KEEP) -> DataFrame:
    """``raked`` with ``rate``, the expected number of copies of a document of each cell.

    rate is budget * weight / tokens: expected tokens of every margin stand as its targets. Without ``budget`` it is
    the share ``keep`` of all tokens, and rates are probabilities, as weights raked with ``keep`` are under their caps.
    """
    ratio = F.col("weight") / F.col("tokens")
    if budget is not None:
        return raked.withColumn("rate", ratio * F.lit(float(budget)))
    total = raked.agg(F.sum("tokens")).first()[0] or 0.0
    return raked.withColumn("rate", F.least(F.lit(1.0), ratio * F.lit(float(total) * keep)))


#: Columns that a mixture has besides those of its documents.
_MADE = ("topic", "tokens", "weight", "probability", "copies", "margin_gap")


def _mixed(docs: DataFrame, row: Column, targets: dict[str, DataFrame] | None, budget: float | None, alpha: float, seed: int, text: str, keep: float, topic_of: Column | None, strict: bool, write: bool) -> DataFrame:
    """``row`` of every document as ``_row``, and the columns of _MADE. With ``write`` the rows are written, and texts are read once."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    key = F.xxhash64(text, F.lit(seed))
    if "doc_id" in docs.columns:
        key = F.when(F.col("doc_id").isNull(), key).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    unit = F.pmod(key, F.lit(1 << 52)) / float(1 << 52)
    told = F.coalesce(topic_of, F.lit("unknown")) if topic_of is not None else topic(text)
    marked = docs.select(row.alias("_row"), unknown("source").alias("source"), unknown("lang").alias("lang"), told.alias("topic"), tokens(text).alias("tokens"), unit.alias("unit"))
    marked = materialize(marked, "marked") if write else marked
    summed = materialize(cells(marked.select(*MARGINS, "tokens")), "cells")
    raked = rake(summed, targets or {m: tempered(summed, m, alpha) for m in MARGINS}, keep=keep if budget is None else None, strict=strict)
    rated = materialize(probabilities(raked, budget, keep).select(*MARGINS, "weight", "margin_gap", "rate"), "rates")
    joined = marked.join(broadcast_if_small(rated), list(MARGINS), "left")
    rate = F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    copies = F.floor(rate) + (F.col("unit") < rate - F.floor(rate)).cast("long")
    return joined.select("_row", "topic", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), rate.alias("probability"), copies.cast("long").alias("copies"), F.coalesce("margin_gap", F.lit(0.0)).alias("margin_gap"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None, alpha: float = ALPHA, seed: int = SEED, text: str = "text", keep: float = KEEP, topic_of: Column | None = None, strict: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with topic, tokens, weight (of the cell), probability, copies and margin_gap; existing columns of those names are replaced.

    copies is the whole part of the expected number, plus one if a hash of doc_id (of the text where the id is null) and
    ``seed`` lies under the rest. Without ``budget`` it is 0 or 1, and the expected tokens are the share ``keep`` of all.
    ``topic_of`` is the topic of a row, without it ``topic`` tells a coarse one. Null sources, languages and topics are
    ``unknown``. Texts without words have no tokens, no weight and probability 0. Repeated rows share their fate. Empty
    tables give empty results. Other columns stay, whatever their names; without ``keep_text`` the text goes, and the
    rest is written once.
    """
    kept = [c for c in docs.columns if c.lower() not in _MADE and (keep_text or c != text)]
    row = F.struct(*[docs[f"`{c}`"] for c in kept])
    return _mixed(docs, row, targets, budget, alpha, seed, text, keep, topic_of, strict, not keep_text).select("_row.*", *_MADE)


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None, alpha: float = ALPHA, seed: int = SEED, text: str = "text", keep: float = KEEP, topic_of: Column | None = None, strict: bool = False) -> DataFrame:
    """The sampled documents with all their own columns and values, repeated by copies."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    mixed = _mixed(docs, row, targets, budget, alpha, seed, text, keep, topic_of, strict, False).where("copies > 0")
    if budget is None:  # no row is taken twice
        return mixed.select("_row.*")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
