"""Attribute prompts: parsing, coverage and the metrics of a scored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import WS, char_repetition, has_loop, let, repetition, trimmed

# Attribute names that count as key attributes.
KEY_ATTRIBUTES = ("类型", "颜色", "材质", "面料", "版型", "长度", "衣长", "裙长", "裤长", "袖长")
# Optional lead-ins of the two prompt styles.
STRUCTURED_LABEL = "商品属性"
NATURAL_LEAD = "请根据以下商品信息生成一段中文电商广告文案"
#: Coverage fields, the ones that rescoring derives anew.
COVERAGE = ("attribute_hits", "attribute_count", "key_attribute_hits", "key_attribute_count", "literal_coverage", "key_literal_coverage", "all_attributes_covered", "missing_attributes")

PAIRS = "array<struct<key:string,value:string>>"
_CLAUSE = rf"(?d)\A{WS}*([^为:：]+?){WS}*(?:为|:|：){WS}*(.+?){WS}*\z"


def _judged(pairs: Column) -> Column:
    """The result for pairs that are in form: an error where a name or a value is empty."""
    empty = F.exists(pairs, lambda a: (a["key"] == "") | (a["value"] == ""))
    return _result(F.when(~empty, F.array_distinct(pairs)), F.when(empty, "empty attributes"))


def _result(attributes: Column, error: Column) -> Column:
    return F.struct(attributes.cast(PAIRS).alias("attributes"), error.cast("string").alias("error"))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _structured(text: Column) -> Column:
    body = F.regexp_replace(text, rf"\A{STRUCTURED_LABEL}{WS}*[:：]{WS}*", "")
    parts = F.transform(F.split(body, r"\*", -1), lambda p: F.split(p, "#", -1))
    pairs = lambda own: F.transform(own, lambda p: _pair(trimmed(F.get(p, F.lit(0))), trimmed(F.get(p, F.lit(1)))))
    wrong = _result(F.lit(None), F.lit("invalid structured attribute"))
    return let(parts, lambda own: F.when(F.exists(own, lambda p: F.size(p) != 2), wrong).otherwise(let(pairs(own), _judged)))


def _natural(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(text, rf"\A{NATURAL_LEAD}{WS}*[:：]{WS}*", ""), r"[。.!！]+\z", "")
    # (name, values) of every clause; a name has a character at least, so that an empty one tells a clause out of form
    clauses = F.transform(F.split(body, "[，,；;]", -1), lambda c: _pair(F.regexp_extract(c, _CLAUSE, 1), F.regexp_extract(c, _CLAUSE, 2)))
    pairs = lambda own: F.flatten(F.transform(own, lambda c: F.transform(F.split(c["value"], "、", -1), lambda v: _pair(c["key"], trimmed(v)))))
    wrong = _result(F.lit(None), F.lit("unsupported natural attribute"))
    return let(clauses, lambda own: F.when(F.exists(own, lambda c: c["key"] == ""), wrong).otherwise(let(pairs(own), _judged)))


def parse(prompt: Column) -> Column:
    """struct(attributes array<struct<key,value>>, error string): ordered, pairs distinct, names may repeat.

    A prompt with ``#`` is a list of key#value joined by ``*``; another one is a list of clauses, values split at ``、``.
    Any part out of form makes the whole prompt an error with null attributes; a null prompt is an error too. Each step
    is computed once a row; ``with_parsed`` sees to it that the whole is, however often its fields are used.
    """
    either = let(trimmed(prompt), lambda t: F.when(t.contains("#"), _structured(t)).otherwise(_natural(t)))
    return F.when(prompt.isNull(), _result(F.lit(None), F.lit("no prompt"))).otherwise(either)


def with_parsed(df: DataFrame, prompt: Column, name: str = "parsed") -> DataFrame:
    """``df`` with the column ``name``: ``parse`` of the prompt, once a row.

    As an array of one that is exploded: a plain column would be computed anew in every filter and for every field
    that the optimiser moves below it.
    """
    return df.select("*", F.explode(F.array(parse(prompt))).alias(name))


def hits(attributes: Column, text: Column) -> Column:
    return F.filter(attributes, lambda a: text.contains(a["value"]))


def key_only(attributes: Column, names: tuple[str, ...] = KEY_ATTRIBUTES) -> Column:
    return F.filter(attributes, lambda a: a["key"].isin(*names))


def coverage(attributes: Column, text: Column, names: tuple[str, ...] = KEY_ATTRIBUTES) -> dict[str, Column]:
    """The coverage fields; ratios are null where nothing is to be covered."""
    count = lambda a: F.size(a).cast("long")
    keys = key_only(attributes, names)
    n, k, h, kh = count(attributes), count(keys), count(hits(attributes, text)), count(hits(keys, text))
    return {
        "attribute_hits": h,
        "attribute_count": n,
        "key_attribute_hits": kh,
        "key_attribute_count": k,
        "literal_coverage": F.try_divide(h, n),
        "key_literal_coverage": F.try_divide(kh, k),
        "all_attributes_covered": F.when(n > 0, h == n),
        "missing_attributes": F.filter(attributes, lambda a: ~text.contains(a["value"])),
    }


def score(text: Column, attributes: Column, token_ids: Column | None = None, eos: Column | None = None) -> Column:
    """The metrics record of a scored text; null token ids or end state give null token metrics or state."""
    ids = F.lit(None).cast("array<int>") if token_ids is None else token_ids
    c = coverage(attributes, text)
    fields = {k: v for k, v in c.items() if k != "missing_attributes"} | {
        "repeated_char_4gram_ratio": char_repetition(text),
        "repeated_token_4gram_ratio": repetition(ids),
        "loop": has_loop(text),
        "eos_normal": F.lit(None).cast("boolean") if eos is None else eos,
        "char_length": F.length(text).cast("long"),
        "token_length": F.when(ids.isNotNull(), F.size(ids).cast("long")),
        "missing_attributes": c["missing_attributes"],
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def rescore(metrics: Column, text: Column, attributes: Column) -> Column:
    """A metrics record whose coverage fields are derived anew; all others stay as they are."""
    out = metrics
    for name, value in coverage(attributes, text).items():
        out = out.withField(name, value)
    return out


def structure(attributes: Column) -> Column:
    """struct(kind, names): first value of 类型 and the sorted distinct names."""
    kind = F.get(F.filter(attributes, lambda a: a["key"] == "类型"), F.lit(0))["value"]
    return F.struct(F.coalesce(kind, F.lit("<无类型>")).alias("kind"), F.array_sort(F.array_distinct(F.transform(attributes, lambda a: a["key"]))).alias("names"))
