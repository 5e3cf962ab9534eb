"""Append-only JSONL files as a Spark data source with byte offsets, for batches and streams.

    spark.dataSource.register(JsonlSource)
    spark.read.format("jsonl_offsets").load(dir)
    spark.readStream.format("jsonl_offsets").load(dir)

One row per complete line: (path, src_offset, end_offset, text, oversized). A line is cut at byte 0x0A,
loses one carriage return before it, and is left out if blank; a last line without its end is not a
line yet. Of lines above max_line bytes only the first 2,048 come, marked. Large files are read in
ranges of split_bytes; a line belongs to the range in which it begins. The stream's offset is the byte
read so far of each file; a file that shrank is read again from its start.

The files must be on a path every executor can open. Unreadable folders are an error, never silence.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, src_offset bigint, end_offset bigint, text string, oversized boolean"
MAX_LINE, HEAD, SPLIT = 16 << 20, 2048, 64 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, begin: int):
        self.path, self.start, self.end, self.begin = path, start, end, begin


def walk(root: str) -> list[str]:
    if os.path.isfile(root):
        return [root]
    out = []

    def fail(e: OSError):
        raise e

    for folder, _, names in os.walk(root, onerror=fail):
        out += [os.path.join(folder, n) for n in names if n.endswith(".jsonl")]
    return sorted(out)


def read_lines(path: str, start: int, end: int, begin: int, max_line: int = MAX_LINE) -> Iterator[tuple]:
    """Lines that begin in [start, end); begin is where the file's first line begins."""
    with open(path, "rb") as f:
        at = start
        if start > begin:  # the range may begin inside a line
            f.seek(start - 1)
            if f.read(1) != b"\n":
                while (piece := f.readline(1 << 20)) and not piece.endswith(b"\n"):
                    pass
            at = f.tell()
        else:
            f.seek(at)
        while at < end:
            head, size, done = b"", 0, False
            while piece := f.readline(1 << 20):
                size += len(piece)
                if size <= max_line + 2:
                    head += piece
                else:  # no more than the head of an oversized line is held
                    head = (head if len(head) >= HEAD else head + piece)[:HEAD]
                if piece.endswith(b"\n"):
                    done = True
                    break
            if not done:
                return
            body = head.rstrip(b"\n")
            body = body[:-1] if body.endswith(b"\r") else body
            if size - 1 > max_line:
                yield path, at, at + size, body[:HEAD].decode("utf-8", "replace"), True
            elif body.strip():
                yield path, at, at + size, body.decode("utf-8", "replace"), False
            at += size


def complete_end(path: str, size: int, start: int = 0) -> int:
    """Where the last complete line within size bytes ends."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            n = min(1 << 16, at - start)
            f.seek(at - n)
            k = f.read(n).rfind(b"\n")
            if k >= 0:
                return at - n + k + 1
            at -= n
    return start


class JsonlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_offsets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


class _Common:
    def __init__(self, options):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("jsonl_offsets needs a path")
        self.max_line, self.split = int(options.get("max_line", MAX_LINE)), int(options.get("split_bytes", SPLIT))

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, s, min(s + self.split, end), start) for s in range(start, end, self.split)]

    def read(self, partition: Range):
        yield from read_lines(partition.path, partition.start, partition.end, partition.begin, self.max_line)


class _Batch(_Common, DataSourceReader):
    def partitions(self):
        return [r for p in walk(self.root) for r in self.ranges(p, 0, os.path.getsize(p))] or [Range(os.devnull, 0, 0, 0)]


class _Stream(_Common, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: complete_end(p, os.path.getsize(p)) for p in walk(self.root)}

    def partitions(self, start: dict, end: dict):
        out = []
        for p, e in end.items():
            s = start.get(p, 0)
            out += self.ranges(p, 0 if e < s else s, e)
        return out or [Range(os.devnull, 0, 0, 0)]

    def commit(self, end: dict) -> None:
        pass


def sniff(head: str) -> str:
    """Record type named in the first bytes of an oversized line, or ''."""
    import re

    m = re.search(r'"type"\s*:\s*"([^"]{1,64})"', head)
    return m[1] if m else ""


def registry(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
