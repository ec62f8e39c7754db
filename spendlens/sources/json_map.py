"""One JSON object ``{"key": "value", ...}`` as a partitioned source (Spark's Python data source).

The file is read in byte ranges, one task each.  Whether a range begins inside a string follows from the number of quotes
before it that end or begin strings, so one pass counts those per range; a file of one range needs none.  A task reads the
entries whose key begins in its range, past the range's end where an entry goes on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
_ESCAPE_OR_QUOTE = re.compile(rb'\\.|"', re.DOTALL)
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_SPACE = re.compile(rb"[ \t\r\n]*")
_SCALAR = re.compile(rb'[^\s,{}\[\]":]+')


class Window:
    """A file's bytes from ``start`` on, read as far as they are asked for."""

    def __init__(self, path: str, start: int):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file, self.start, self.held = system.open_input_file(name), start, bytearray()
        self.size = self.file.size()
        self.file.seek(start)

    def more(self) -> bool:
        got = self.file.read(BLOCK)
        self.held += got
        return bool(got)

    def escaped(self) -> bool:
        """Whether the first byte follows an odd number of backslashes, however many there are."""
        at, run = self.start, 0
        while at:
            lo = max(0, at - BLOCK)
            self.file.seek(lo)
            before = self.file.read(at - lo)
            own = len(before) - len(before.rstrip(b"\\"))
            run += own
            if own < len(before):
                break
            at = lo
        self.file.seek(self.start)
        return run % 2 == 1

    def match(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The pattern at a place, with more read while it fails or reaches the end of what is held."""
        while True:
            found = pattern.match(self.held, at)
            if found and found.end() < len(self.held) or not self.more():
                return found


def count_quotes(path: str, start: int, end: int) -> int:
    """Quotes in [start, end) that begin or end strings."""
    window, n, at = Window(path, start), 0, start
    skip = window.escaped()
    while at < end:
        block = window.file.read(min(BLOCK, end - at))
        if not block:
            break
        at += len(block)
        body = block[1:] if skip else block
        run = len(body) - len(body.rstrip(b"\\"))
        n += sum(m.group() == b'"' for m in _ESCAPE_OR_QUOTE.finditer(body))
        # body follows no open escape, so an odd run at its end escapes the next block's first byte
        skip = run % 2 == 1
    return n


def entries(path: str, start: int, end: int, inside: bool) -> Iterator[tuple[str, str | None, int]]:
    """(key, value, place) of the entries whose key begins in [start, end); ``inside``: the range begins inside a string."""
    window = Window(path, start)
    wrong = f"not a flat JSON object: {path}, near byte "
    escaped = window.escaped()
    window.more()
    at = 0
    if inside:  # the string that was cut belongs to the range before
        at = int(escaped)
        while True:
            quote = next((m for m in _ESCAPE_OR_QUOTE.finditer(window.held, at) if m.group() == b'"'), None)
            if quote or not window.more():
                break
        if quote is None:
            raise ValueError(f"{wrong}{start}: a string is not closed")
        at = quote.end()
    if start == 0:
        at = window.match(_SPACE, 0).end()
        if window.held[at:at + 1] != b"{":
            raise ValueError(f"{wrong}0: no object begins there")
        at += 1
    first = True
    while True:
        at = window.match(_SPACE, at).end()
        if first and start:  # what is left of the cut entry: ':', a scalar or ','
            while window.held[at:at + 1] not in (b'"', b"}", b""):
                scalar = window.match(_SCALAR, at)
                at = window.match(_SPACE, scalar.end() if scalar else at + 1).end()
                if start + at >= end:
                    return
        mark = window.held[at:at + 1]
        if mark == b"}":
            rest = window.match(_SPACE, at + 1)
            if start + rest.end() < window.size:
                raise ValueError(f"{wrong}{start + at}: something follows the object")
            return
        if start + at >= end:
            return
        name = window.match(_STRING, at) if mark == b'"' else None
        if name is None:
            raise ValueError(f"{wrong}{start + at}: a key is missing or not closed")
        place, key = start + at, name.group()
        at = window.match(_SPACE, name.end()).end()
        if first and start and window.held[at:at + 1] != b":":
            first = False  # it was the value of the cut entry
        else:
            first = False
            if window.held[at:at + 1] != b":":
                raise ValueError(f"{wrong}{start + at}: a key without a value")
            at = window.match(_SPACE, at + 1).end()
            value = window.match(_STRING, at) or window.match(_SCALAR, at)
            if value is None:
                raise ValueError(f"{wrong}{start + at}: neither a string nor a number, boolean or null")
            read = json.loads(value.group())
            yield json.loads(key), value.group().decode() if not isinstance(read, str) and read is not None else read, place
            at = window.match(_SPACE, value.end()).end()
        mark = window.held[at:at + 1]
        if mark == b",":
            at = window.match(_SPACE, at + 1).end()
            if window.held[at:at + 1] == b"}":
                raise ValueError(f"{wrong}{start + at}: a key is missing or not closed")
        elif mark != b"}":
            raise ValueError(f"{wrong}{start + at}: ',' or '}}' is missing")
        del window.held[:at]
        window.start, start, at = window.start + at, start + at, 0


class Range(InputPartition):
    def __init__(self, start: int, end: int, inside: bool):
        self.start, self.end, self.inside = start, end, inside


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ranges = json.loads(options["ranges"])

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from entries(self.path, partition.start, partition.end, partition.inside)


class JsonMapSource(DataSource):
    """Format ``json_map``: options ``path`` and ``ranges`` (JSON: [first byte, end, whether it begins inside a string])."""

    @classmethod
    def name(cls) -> str:
        return "json_map"

    def schema(self) -> str:
        return "key string, value string, place long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def _edges(size: int, range_bytes: int) -> list[tuple[int, int]]:
    return [(lo, min(size, lo + range_bytes)) for lo in range(0, max(size, 1), range_bytes)]


def read_entries(spark: SparkSession, path: str, size: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, value, place) of every entry of a file of ``size`` bytes: strings unescaped, other scalars as written, null NULL."""
    edges = _edges(size, range_bytes)
    counts = {0: 0}
    if len(edges) > 1:
        def count(batches):
            for batch in batches:
                for lo in batch["id"]:
                    yield batch[batch["id"] == lo].assign(quotes=count_quotes(path, int(lo), min(size, int(lo) + range_bytes)))

        # one number per range comes back
        counted = spark.range(0, size, range_bytes, len(edges)).mapInPandas(count, "id long, quotes long")
        counts = {r["id"]: r["quotes"] for r in counted.collect()}
    inside, ranges = False, []
    for lo, hi in edges:
        ranges.append((lo, hi, inside))
        inside ^= counts[lo] % 2 == 1
    spark.dataSource.register(JsonMapSource)
    return spark.read.format("json_map").option("path", path).option("ranges", json.dumps(ranges)).load()
