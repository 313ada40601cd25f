"""Conversation files: strict and permissive JSONL scans, line numbers, run directories, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.attributes import with_parsed
from quernel.operators.curate import reject_reason
from quernel.sources import formats

MESSAGE = "struct<role:string,content:string>"
ROW = f"conversations array<{MESSAGE}>, metadata struct<source:string,source_index:bigint,input_style:string>"


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value) of text files, from 1, in the order of their paths; counted within the pieces that files are read in, joined by offsets."""
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_id"))
    pieces = lines.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))  # one row a piece of a file
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("_file", "_block", "_first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    numbered = lines.join(F.broadcast(starts), ["_file", "_block"])
    return numbered.select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_number"), "value")


def first_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(line_number, value) of the first ``limit`` lines; the bytes that are read don't grow with the files.

    Where only Spark's readers open the path, all lines are numbered and the first taken.
    """
    try:
        formats.opened(path)
    except (OSError, ValueError):  # no file system of Arrow's
        return _text_lines(spark, path).orderBy("line_number").limit(limit)
    formats.register(spark)
    return spark.read.format("leading_lines").option("limit", limit).load(path)


def scan(spark: SparkSession, path: str, strict: bool = True, skip_blank: bool = False, limit: int = 0) -> DataFrame:
    """line_number, conversations, metadata, reject_reason of every line, or of the first ``limit`` lines if any.

    A blank line is malformed unless ``skip_blank`` (which also drops a byte-order mark). Contents must be JSON strings
    that are not blank, roles system, user, assistant in order, metadata an object. ``strict`` fails on the first
    reject with its line; else rejects stay with their reason.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    lines = first_lines(spark, path, limit) if limit else _text_lines(spark, path)
    if skip_blank:
        lines = lines.withColumn("value", F.regexp_replace("value", r"\A\x{feff}", "")).where(F.trim("value") != "")
    # a line is parsed by its schema, and once more into a VARIANT, which tells whether it is JSON and its contents are texts
    read = lines.select("line_number", F.try_parse_json("value").alias("v"), F.from_json("value", ROW, {"mode": "PERMISSIVE"}).alias("r"))
    kinds = F.transform(F.expr("try_variant_get(v, '$.conversations', 'array<variant>')"), lambda m: F.call_function("schema_of_variant", F.call_function("try_variant_get", m, F.lit("$.content"), F.lit("variant"))))
    rows = read.select("line_number", "r", F.col("v").isNull().alias("broken"), F.exists(kinds, lambda k: k != "STRING").alias("other"))
    reason = F.when(F.col("broken"), "malformed json").when(F.coalesce("other", F.lit(False)), "content is no text").otherwise(reject_reason(F.col("r.conversations"), F.col("r.metadata")))
    out = rows.select("line_number", "r.conversations", "r.metadata", reason.alias("reject_reason"))
    if not strict:
        return out
    failed = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line_number").cast("string"), F.lit(": "), F.col("reject_reason")))
    return out.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), failed).otherwise(F.col("reject_reason")))


def with_attributes(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Rows with the parsed attributes of the user message (and their sorted key), the first ``limit`` lines if any."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    out = with_parsed(rows, F.get("conversations", F.lit(1))["content"], "_p").select("*", "_p.*").drop("_p")
    out = out.withColumn("attribute_key", F.array_sort("attributes"))
    return out.orderBy("line_number").limit(limit) if limit else out


def write(df: DataFrame, path: str, sources: tuple[str, ...] = ()) -> None:
    """Compact UTF-8 JSON lines, nulls written; refuses to overwrite, and to write where one of ``sources`` is."""
    whole = lambda p: df.sparkSession._jvm.org.apache.hadoop.fs.Path(p).toUri().normalize().getPath().rstrip("/")
    for source in sources:
        if whole(path) == whole(source) or whole(source).startswith(whole(path) + "/"):
            raise ValueError(f"the output {path} would be written over the source {source}")
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def last_by_key(rows: DataFrame, key: str, order: str = "line_number") -> DataFrame:
    """Of rows of one key the last by ``order``."""
    names = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r"))
    return last.select(key, "_r.*")


def scan_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "val", "test"), suffix: str = ".jsonl", strict: bool = True) -> DataFrame:
    """Rows of ``folder``/<name><suffix> with ``split``, the name of the file; line numbers count within each. A missing file is an error."""
    out = None
    for name in names:
        rows = scan(spark, f"{folder}/{name}{suffix}", strict).select(F.lit(name).alias("split"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def not_empty(rows: DataFrame, what: str = "the table") -> DataFrame:
    """``rows``; an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"{what} has no rows")
    return rows


def from_source(rows: DataFrame, source: str = "train.json") -> DataFrame:
    """``rows``, failing on the first whose metadata names another source, or none."""
    wrong = ~F.coalesce(F.col("metadata.source") == source, F.lit(False))
    failed = F.raise_error(F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(f": the source is not {source}")))
    return rows.withColumn("metadata", F.when(wrong, failed.cast(rows.schema["metadata"].dataType)).otherwise(F.col("metadata")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``path``, computed where the files are read: no byte of one reaches the driver.

    Files are read in pieces, whatever their size; a task has one large file, or many small ones. Where only Spark's readers open the path, files are
    held whole by the task that reads them, which bounds them to 2 GB.
    """
    try:
        formats.opened(path)
    except (OSError, ValueError):  # no file system of Arrow's
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    formats.register(spark)
    return spark.read.format("file_digests").load(path)


def checked_run(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a complete run directory; a number of rows other than declared, and lines that repeat, are refused.

    One aggregation over line numbers alone tells.
    """
    formats.register(spark)
    declared = formats.whole_json(f"{path.rstrip('/')}/summary.json")["samples"]
    source = spark.read.format("evaluation_run")
    seen = source.schema("line_number long").load(path).agg(F.count("*").alias("rows"), F.countDistinct("line_number").alias("keys")).first()
    if not seen["rows"] or seen["rows"] != declared:
        raise ValueError(f"{path}: sample count mismatch")
    if seen["keys"] != seen["rows"]:
        raise ValueError(f"{path}: repeated lines")
    return spark.read.format("evaluation_run").load(path)


def load_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(original manifest, samples) of a run directory; incomplete runs, wrong counts and repeated lines are refused."""
    whole = lambda name: spark.read.option("multiLine", True).json(f"{path}/{name}").first().asDict(recursive=True)
    summary, manifest = whole("summary.json"), whole("manifest.json")
    if summary.get("status") != "complete":
        raise ValueError(f"{path}: incomplete run")
    samples = spark.read.json(f"{path}/samples.jsonl")
    seen = samples.agg(F.count("*").alias("rows"), F.countDistinct("line_number").alias("keys"), (F.count("output_metrics") if "output_metrics" in samples.columns else F.lit(0)).alias("done")).first()
    if not seen["rows"] or seen["rows"] != summary["samples"]:
        raise ValueError(f"{path}: sample count mismatch")
    if seen["keys"] != seen["rows"] or seen["done"] != seen["rows"]:
        raise ValueError(f"{path}: repeated lines or missing generation")
    while manifest.get("original_manifest"):
        manifest = manifest["original_manifest"]
    return manifest, samples
