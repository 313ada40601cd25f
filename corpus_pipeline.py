"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of ``documents``, in their order, and any
further columns that the input has, whatever their names; what it decides takes effect. The last stage returns the
sampled documents. No stage sees the whole table in one task, and each decides by rows: empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import contamination, langid, mixing, secrets, simhash
from quernel.plans.storage import discard, materialize

LEAST_LANGUAGE_SCORE = 0.5  # no language has this probability: the text is not of one language


def _scored(docs: DataFrame, run) -> DataFrame:
    """``run`` over (_row, text): all columns travel as one, so that none clashes with what an operator adds."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return run(docs.select(row.alias("_row"), "text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language that the kernel tells; texts that are of no one language go.

    Learnt from the documents at hand. Null, empty and letterless texts go, and those of which no language has the
    probability LEAST_LANGUAGE_SCORE. Where no document has a language to learn from, all texts with a letter stay, and
    ``lang`` stays null. Equal texts share their fate; repeated rows stay repeated; ties go to the language first by name.
    """
    model = langid.train(docs)
    if not model.languages:  # nothing to learn from
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = _scored(docs, lambda d: langid.predict(d, model, keep_text=False, least_score=LEAST_LANGUAGE_SCORE))
    own = [F.col("lang_pred").alias("lang") if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns]
    return kept.select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Null and wordless texts are near-duplicates of each other (their fingerprint is zero). Of equal rows one stays; rows
    that repeat an id with unlike texts are each in the group of their own text; rows without an id all stay.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and wordless texts are clean, as is everything without benchmark items. Equal texts share their fate.
    """
    return contamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go, whether a pattern or the random field finds it; the field is fitted on the documents at hand.

    Null and empty texts have none. Equal texts share their fate.
    """
    model = secrets.train(docs)
    return _scored(docs, lambda d: secrets.find_secrets(d, model, keep_text=False, drop_marked=True)).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the share ``mixing.KEEP`` of the tokens, whose sources, languages and topics have tempered shares.

    Languages are those of the first stage. Null sources and languages are a value of their own. Texts without words are
    never taken. Rows that repeat an id share their fate, and no row is taken twice.
    """
    return mixing.sample(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", drop_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # fingerprints, fitted models and raking have no SQL here; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        following = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # read no more; ``documents`` itself is not a written step
        docs = following
    return docs
