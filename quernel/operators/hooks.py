"""Hooks for models: scorers and generators supplied by the caller run in Arrow batches, one instance a task."""

from __future__ import annotations

import contextlib
import json
import math
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, Callable[[], Callable]] = {}


def register(name: str):
    """Register a factory of scorers or generators under a name."""

    def add(factory):
        REGISTRY[name] = factory
        return factory

    return add


def score_candidates(groups: DataFrame, factory: Callable[[], Callable[[list], float]]) -> DataFrame:
    """(group_id, candidate_id, score, error) of exploded candidates (group_id, messages, candidate_id, text).

    ``factory()`` is called once a task and returns the scorer, closed at the end if it can be. A scorer sees the
    prompt's messages and the candidate, never a reference: messages that are not system and user are refused.
    A failing or non-finite score is an error of its row alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        try:
            for frame in frames:
                out = []
                for messages, text in zip(frame["messages"], frame["text"]):
                    turns = [{"role": m["role"], "content": m["content"]} for m in messages]
                    try:
                        if [t["role"] for t in turns] != ["system", "user"]:
                            raise ValueError("the messages are not system and user")
                        value = float(scorer([*turns, {"role": "assistant", "content": text}]))
                        if not math.isfinite(value):
                            raise ValueError("the score is not finite")
                        out.append((value, None))
                    except Exception as error:  # isolated by row, told in its column
                        out.append((None, str(error)))
                yield pd.DataFrame({"group_id": frame["group_id"], "candidate_id": frame["candidate_id"], "score": [s for s, _ in out], "error": [e for _, e in out]})
        finally:
            if hasattr(scorer, "close"):
                scorer.close()

    schema = T.StructType([groups.schema["group_id"], groups.schema["candidate_id"], T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
    return groups.select("group_id", "messages", "candidate_id", "text").mapInPandas(run, schema)


def answer_lines(lines: DataFrame, factory: Callable[[], Callable[[list], float]], line: str = "value") -> DataFrame:
    """``lines`` with ``response``: a line protocol, one JSON request {"conversation": [...]} to one JSON answer a line.

    An answer is {"score": x}, or {"error": "Type: message"} of its line alone: requests out of form, a scorer that
    fails, a score that is not finite. Works on streams. What a factory prints goes to the standard error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with contextlib.redirect_stdout(sys.stderr):
            scorer = factory()
        try:
            for frame in frames:
                yield frame.assign(response=[answer(scorer, x) for x in frame[line]])
        finally:
            if hasattr(scorer, "close"):
                scorer.close()

    def answer(scorer, request: str | None) -> str:
        try:
            score = float(scorer(json.loads(request)["conversation"]))
            if not math.isfinite(score):
                raise ValueError("the score is not finite")
            return json.dumps({"score": score})
        except Exception as error:  # isolated by line, told in the answer
            return json.dumps({"error": f"{type(error).__name__}: {error}"}, ensure_ascii=False)

    return lines.mapInPandas(run, T.StructType([*lines.schema, T.StructField("response", T.StringType())]))


def generate(prompts: DataFrame, factory: Callable[[], Callable[[str, int], str]], count: int, seed: int) -> DataFrame:
    """``count`` candidates a prompt (group_id, prompt): candidate_id, seed and text; seeds follow from the group's place ``idx``."""
    rows = prompts.select("group_id", "prompt", "idx", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j"))
    rows = rows.select("group_id", "prompt", F.concat_ws("-", "group_id", F.col("j") + 1).alias("candidate_id"), (F.lit(seed) + F.col("idx") * count + F.col("j")).cast("long").alias("seed"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            yield frame[["group_id", "candidate_id", "seed"]].assign(text=[model(p, int(s)) for p, s in zip(frame["prompt"], frame["seed"])])

    return rows.mapInPandas(run, T.StructType([rows.schema["group_id"], rows.schema["candidate_id"], rows.schema["seed"], T.StructField("text", T.StringType())]))
