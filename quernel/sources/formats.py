"""Data sources for Spark's reader: digests of files, their first lines, run directories and candidate files.

``register(spark)`` makes ``spark.read.format("file_digests")``, ``("leading_lines")``, ``("evaluation_run")`` and
``("candidate_groups")`` known. Executors read the files themselves, in pieces; planning lists them and reads what is small. Paths are those
that Arrow's file systems open (local, HDFS, object stores); ``jsonl.file_digests`` has a way for all others.
"""

from __future__ import annotations

import hashlib
import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

PIECE = 1 << 20  # bytes of a file that are held at once
SPLIT = 32 << 20  # bytes of lines, or of small files, that one task reads
OPENING = 1 << 20  # bytes that a task could read while it opens a file
BLOCK = 4 << 20  # bytes of lines that are parsed at once
MESSAGES = "array<struct<role:string,content:string>>"
ATTRIBUTES = "array<struct<key:string,value:string>>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all visible files under a folder, by name."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda f: any(part[:1] in "._" for part in f.path[len(at) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not (f is not info and hidden(f)))


def whole_json(path: str) -> dict:
    """One JSON document, which is small."""
    system, at = opened(path)
    with system.open_input_stream(at) as stream:
        return json.loads(stream.read().decode("utf-8-sig"))


def digest(system: fs.FileSystem, at: str) -> str:
    """SHA-256 of a file, read in pieces of PIECE bytes."""
    own = hashlib.sha256()
    with system.open_input_stream(at) as stream:
        while piece := stream.read(PIECE):
            own.update(piece)
    return own.hexdigest()


@dataclass
class Part(InputPartition):
    """A file, or the lines that begin from ``start`` on and before ``stop``."""

    path: str
    start: int
    stop: int


@dataclass
class Files(InputPartition):
    """Some files, (path, bytes) each."""

    files: list[tuple[str, int]]


def packed(found: list[tuple[str, int]], most: int = SPLIT) -> list[Files]:
    """Files in their order, together as long as they have ``most`` bytes, OPENING for each besides its own; larger ones alone."""
    out, filled = [], most
    for path, size in found:
        cost = size + OPENING
        if filled + cost > most:
            out.append(Files([]))
            filled = 0
        out[-1].files.append((path, size))
        filled += cost
    return out


class DigestSource(DataSource):
    """(path, bytes, sha256) of a file, or of every file under a folder; a partition reads a large file, or small ones one after the other."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DigestReader(self.options["path"])


class DigestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return packed(files(self.path))

    def read(self, part: Files) -> Iterator[tuple]:
        if part is None:
            return
        system = opened(self.path)[0]
        for path, size in part.files:
            yield path, size, digest(system, path)


class LeadingSource(DataSource):
    """(line_number, value): the first ``limit`` lines of a file, or of the files under a folder one after the other.

    Planning reads pieces from the front until it has met so many line ends, and a task reads what lies before that
    place: neither depends on the size of the rest.
    """

    @classmethod
    def name(cls) -> str:
        return "leading_lines"

    def schema(self) -> str:
        return "line_number long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LeadingReader(self.options["path"], int(self.options["limit"]))


@dataclass
class Leading(InputPartition):
    """The lines of a file up to byte ``stop``, the first being number ``number``."""

    path: str
    stop: int
    number: int


class LeadingReader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self) -> list[Leading]:
        system, out, left = opened(self.path)[0], [], self.limit
        for path, size in files(self.path):
            if left <= 0:
                break
            at, lines = 0, 0
            with system.open_input_stream(path) as stream:
                ended = True
                while lines < left and (piece := stream.read(PIECE)):
                    ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
                    if lines + len(ends) >= left:
                        at += int(ends[left - lines - 1]) + 1
                        lines, ended = left, True
                        break
                    lines, at, ended = lines + len(ends), at + len(piece), piece.endswith(b"\n")
            lines += 0 if ended else 1  # a last line without an end
            if lines:
                out.append(Leading(path, at, self.limit - left + 1))
            left -= lines
        return out or [Leading("", 0, 0)]

    def read(self, part: Leading) -> Iterator[pa.RecordBatch]:
        if part is None or not part.path:
            return
        number = part.number
        for block in line_blocks(opened(self.path)[0], Part(part.path, 0, part.stop)):
            lines = block.decode("utf-8", "replace").split("\n")
            lines = lines[:-1] if block.endswith(b"\n") else lines
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(lines))), pa.array(lines, pa.string())], names=["line_number", "value"])
            number += len(lines)


# --- JSON lines -----------------------------------------------------------------------------------------------------


def next_line(file: pa.NativeFile, at: int) -> int:
    """Where the first line begins that begins at byte ``at`` or later."""
    if at == 0:
        return 0
    at -= 1
    file.seek(at)
    while piece := file.read(PIECE):
        found = piece.find(b"\n") + 1
        if found:
            return at + found
        at += len(piece)
    return at


def line_blocks(system: fs.FileSystem, part: Part) -> Iterator[bytes]:
    """The lines that begin in a part of a file, whole, in blocks of about BLOCK bytes."""
    with system.open_input_file(part.path) as file:
        at, end = next_line(file, part.start), next_line(file, part.stop)
        file.seek(at)
        rest = b""
        while at < end:
            rest += file.read(min(BLOCK, end - at))
            at = file.tell()
            cut = rest.rfind(b"\n") + 1
            if cut:
                yield rest[:cut]
                rest = rest[cut:]
        if rest:
            yield rest


class LinesReader(DataSourceReader):
    """Rows of JSON-lines files; only fields of the schema are built. ``check`` refuses a batch of rows."""

    def __init__(self, path: str, schema: T.StructType, split: int):
        self.path, self.fields, self.split = path, to_arrow_schema(schema), split

    def partitions(self) -> list[Part]:
        found = files(self.path)
        if not any(size for _, size in found):
            raise ValueError(f"{self.path} has no rows")
        return [Part(p, at, min(size, at + self.split)) for p, size in found for at in range(0, size, self.split)]

    def check(self, rows: pa.Table, path: str) -> None:
        pass

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None or not part.path:
            return
        options = pa.json.ParseOptions(explicit_schema=self.fields, unexpected_field_behavior="ignore")
        for block in line_blocks(opened(self.path)[0], part):
            if not block.strip():
                continue
            try:
                rows = pa.json.read_json(io.BytesIO(block), read_options=pa.json.ReadOptions(use_threads=False, block_size=max(1 << 16, 2 * len(block))), parse_options=options)
            except pa.ArrowInvalid as error:
                raise ValueError(f"{part.path}: {error}") from error
            self.check(rows, part.path)
            yield from rows.select(self.fields.names).cast(self.fields).to_batches()


def _split(options: dict) -> int:
    return int(options.get("splitBytes", SPLIT))


class RunSource(DataSource):
    """Samples of a run directory (summary.json, manifest.json, samples.jsonl).

    A run whose summary doesn't say ``complete``, or without a manifest or samples, is refused when it is planned; a line
    without a number, or without an output where another line of its block has one, when it is read. The number of rows
    and whether lines repeat concern all rows: ``jsonl.checked_run`` sees to them. A given schema reads its fields alone.
    """

    @classmethod
    def name(cls) -> str:
        return "evaluation_run"

    def schema(self) -> str:
        return f"line_number long, input_style string, messages {MESSAGES}, attributes {ATTRIBUTES}, reference string, output string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options["path"].rstrip("/")
        summary = whole_json(f"{path}/summary.json")
        whole_json(f"{path}/manifest.json")
        if summary.get("status") != "complete":
            raise ValueError(f"{path}: incomplete run")
        return RunReader(f"{path}/samples.jsonl", schema, _split(self.options))


class RunReader(LinesReader):
    def check(self, rows: pa.Table, path: str) -> None:
        for name, none_at_all in (("line_number", False), ("output", True)):
            missing = rows.column(name).null_count if name in rows.column_names else 0
            if missing and not (none_at_all and missing == rows.num_rows):
                raise ValueError(f"{path}: lines without {name}")


class CandidateSource(DataSource):
    """Groups of candidates, a group a line. Empty files, groups of fewer than two candidates and repeated ids are refused."""

    @classmethod
    def name(cls) -> str:
        return "candidate_groups"

    def schema(self) -> str:
        return f"group_id string, line_number long, messages {MESSAGES}, attributes {ATTRIBUTES}, candidates array<struct<candidate_id:string,seed:long,text:string,content_token_ids:array<int>,eos_normal:boolean>>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CandidateReader(self.options["path"], schema, _split(self.options))


def sound(candidates: pa.ListArray) -> bool:
    """Whether every group has two candidates or more, with ids of their own; no object is made of a row."""
    if not pc.all(pc.greater_equal(pc.fill_null(pc.list_value_length(candidates), 0), 2), min_count=0).as_py():
        return False
    flat = pc.list_flatten(candidates)
    ids = pc.struct_field(flat, "candidate_id") if flat.type.get_field_index("candidate_id") >= 0 else pa.nulls(len(flat))
    return pa.table({"group": pc.list_parent_indices(candidates), "id": ids}).group_by(["group", "id"]).aggregate([]).num_rows == len(flat)


class CandidateReader(LinesReader):
    def check(self, rows: pa.Table, path: str) -> None:
        if "candidates" not in rows.column_names or all(sound(c) for c in rows.column("candidates").chunks):
            return
        names = rows.column("group_id").to_pylist() if "group_id" in rows.column_names else range(rows.num_rows)
        for name, candidates in zip(names, rows.column("candidates").to_pylist()):
            ids = [c.get("candidate_id") for c in candidates or []]
            problem = "fewer than two candidates" if len(ids) < 2 else "candidate ids repeat" if len(set(ids)) < len(ids) else None
            if problem:
                raise ValueError(f"{path}: group {name}: {problem}")


def register(spark: SparkSession) -> None:
    for source in (DigestSource, LeadingSource, RunSource, CandidateSource):
        spark.dataSource.register(source)
