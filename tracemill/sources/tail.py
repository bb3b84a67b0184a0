"""A streaming source that follows growing transcript files (ST1), as a Python data source.

The offset of a query maps each file to the end of its last complete line and a probe of the bytes before it. Planning lists files and reads some small
ranges of those that changed; lines are read by tasks, in splits of bounded size. For each file a batch tells how it moved on:

* ``initial``: not seen before, read from its start;
* ``append``: the probe of the consumed bytes is unchanged, only what follows is read;
* ``replacement``: it shrank or its consumed bytes changed, so all its lines are given again.

An unfinished last line waits until it is finished. Everything follows from the two offsets of a batch, so a restarted query reads the same.

Options: ``path`` (a folder or file, any URI that Arrow's file systems open), ``suffix`` (names that count, default .jsonl), ``probe``: ``windows`` looks at
the last 256 bytes before each power of two and before the end, which a rewrite could leave alone; ``prefix`` hashes all consumed bytes of
changed files on the driver; ``splitBytes`` (default 64 MiB); ``ordinals`` (default true): tasks count the line ends before their split, which reads the file
up to there again.

Edge cases: an empty folder or file gives no rows; a file that goes away keeps its place in the offset while the query runs, so that it is not read twice
when it returns; one that is away when a query restarts counts as new when it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK, WINDOW = 1 << 20, 256
SCHEMA = "file string, relation string, ordinal long, byte_offset long, line string"


def _read(files: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[bytes]:
    """The bytes ``start`` .. ``stop`` of a file in blocks."""
    with files.open_input_file(path) as f:
        f.seek(start)
        while start < stop and (block := f.read(min(BLOCK, stop - start))):
            start += len(block)
            yield block


def last_line_end(files: fs.FileSystem, path: str, size: int) -> int:
    """Where the last complete line of the first ``size`` bytes ends."""
    stop = size
    with files.open_input_file(path) as f:
        while stop > 0:
            start = max(0, stop - BLOCK)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def probe(files: fs.FileSystem, path: str, end: int, kind: str) -> str:
    """A hash that changes if the first ``end`` bytes do: of all of them, or of their windows."""
    digest = hashlib.sha256(str(end).encode())
    if kind == "prefix":
        for block in _read(files, path, 0, end):
            digest.update(block)
        return digest.hexdigest()
    with files.open_input_file(path) as f:
        for stop in sorted({1 << k for k in range(8, end.bit_length())} | {end}):
            f.seek(max(0, stop - WINDOW))
            digest.update(f.read(min(WINDOW, stop)))
    return digest.hexdigest()


@dataclass
class Split(InputPartition):
    """Lines of a file that start at ``start`` or later and before ``stop``; the batch reads the file from ``first`` to ``end``."""

    file: str
    relation: str
    first: int
    start: int
    stop: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.kind = options["path"], options.get("suffix", ".jsonl"), options.get("probe", "windows")
        self.split, self.ordinals = int(options.get("splitbytes", 64 << 20)), options.get("ordinals", "true").lower() == "true"
        if self.kind not in ("windows", "prefix"):
            raise ValueError("probe: windows or prefix")
        self.known: dict[str, dict] = {}  # what this query has read, also of files that are away now
        self.seen: dict[str, tuple] = {}  # file -> size, time and place, to leave unchanged files alone

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        now = dict(self.known)
        for f in found:
            if f.type != fs.FileType.File or not f.path.endswith(self.suffix):
                continue
            mark = (f.size, f.mtime_ns)
            if self.seen.get(f.path, (None,))[0] != mark:
                end = last_line_end(files, f.path, f.size)
                self.seen[f.path] = mark, {"end": end, "probe": probe(files, f.path, end, self.kind)}
            now[f.path] = self.seen[f.path][1]
        return now

    def partitions(self, start: dict, end: dict) -> list[Split]:
        files, _ = fs.FileSystem.from_uri(self.path)
        out = []
        for path, to in sorted(end.items()):
            was, first, relation = start.get(path), 0, "initial"
            if was is not None and was != to:
                first, relation = 0, "replacement"
                if was["end"] <= to["end"] and probe(files, path, was["end"], self.kind) == was["probe"]:
                    first, relation = was["end"], "append" if was["end"] else "initial"
            if was != to:
                out += [Split(path, relation, first, at, min(at + self.split, to["end"]), to["end"]) for at in range(first, to["end"], self.split)]
        self.known = {**start, **end}
        return out

    def commit(self, end: dict) -> None:
        self.known = {**self.known, **end}

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        before = sum(b.count(b"\n") for b in _read(files, part.file, 0, part.start)) if self.ordinals else None
        # a line that starts before the split belongs to the one before, unless it starts right there
        at, rest, skip = part.start, b"", False
        if part.start > part.first:
            skip = next(_read(files, part.file, part.start - 1, part.start)) != b"\n"
        for block in _read(files, part.file, part.start, part.end):
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            if skip and lines:
                at, skip = at + len(lines.pop(0)) + 1, False
                before = None if before is None else before + 1
            offsets, ordinals, kept = [], [], []
            for line in lines:
                if at >= part.stop:
                    break
                before = None if before is None else before + 1
                offsets.append(at)
                ordinals.append(before)
                kept.append(line.decode(errors="replace"))
                at += len(line) + 1
            if kept:
                n = len(kept)
                columns = [pa.array([part.file] * n), pa.array([part.relation] * n), pa.array(ordinals, pa.int64()), pa.array(offsets, pa.int64()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "relation", "ordinal", "byte_offset", "line"])
            if not skip and at >= part.stop:
                return


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
