"""Game archives as a data source: spark.read.format("game_archive").load(path).

An archive is PGN text, plain or compressed with zstd or gzip. It is read in byte ranges, one task each, also where it is
compressed: zstd frames and the blocks of a blocked gzip file can be read by themselves, and a task finds the first of them in
its range from its header alone (a zstd candidate is followed block by block to its end, so a chance match is not taken).
Nothing is read while tasks are planned, only sizes are asked for. A file of one frame, or a plain gzip file, can only be read
from its start; it takes one task, which holds one record and one buffer at a time.

A record begins at a line that starts with the event tag. It belongs to the range that holds the line end before it, so a task
passes over what comes before the first such line and reads on, beyond its range, to the end of its last record.

Options: path (a file, a folder, a pattern, or several with commas between), bytes (size of a range, 64m), speed, players (with
commas between), whole (true: an archive whose last part ends early is an error; false, the default: its last record is kept as
far as it goes, as from plain text; a damaged part is an error either way), pushdown (true: filters of the query on speed and on
header columns, =, IN and IS NOT NULL, are taken over; needs spark.sql.python.filterPushdown.enabled). Records that fail a filter
are not handed to the JVM. Bytes that are no UTF-8 are replaced.

Columns: file, the header columns as written (null where the tag is missing), speed, block.
"""

from __future__ import annotations

import fnmatch
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from fidelis.functions.scalars import SPEED_CLASSES
from fidelis.sources.readers import GAME_HEADERS

COLUMNS = ("file", *GAME_HEADERS, "speed", "block")
READ = 1 << 20
_START = b"\n[Event "
_TAG = re.compile(rb'^\[(\w+) "([^"\n]*)"\]', re.M)
#: Fixed values of the formats: first bytes of a zstd frame, of a skippable one (its lowest byte varies), of a gzip member.
ZSTD, SKIPPABLE, GZIP = b"\x28\xb5\x2f\xfd", b"\x2a\x4d\x18", b"\x1f\x8b\x08"


def speed_of(time_control: str | None) -> str:
    """The class of a time control; the same rule as the column function."""
    base, plus, inc = (time_control or "-").partition("+")
    try:
        estimate = float(base) + 40 * (float(inc) if plus else 0.0)
    except ValueError:
        return "correspondence"
    return next((name for edge, name in SPEED_CLASSES if estimate < edge), "classical")


# --- files ---


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, sorted, of a path, a folder, a pattern, or several of them."""
    from pyarrow import fs

    found = {}
    for one in filter(None, (p.strip() for p in path.split(","))):
        one = one if "://" in one else os.path.abspath(one)
        top = re.sub(r"[^/]*[*?\[].*$", "", one).rstrip("/") or "/"
        system, inner = _system(top)
        prefix = top[: len(top) - len(inner)] if "://" in top else ""
        info = system.get_file_info(inner)
        for f in [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True)):
            name = prefix + f.path
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (top == one.rstrip("/") or fnmatch.fnmatch(name, one)):
                found[name] = f.size
    if not found:
        raise FileNotFoundError(path)
    return sorted(found.items())


# --- compressed units ---


class Plain:
    """Bytes as they are; any place is a start."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def sync(self, a: int, b: int) -> int | None:
        return a if a < min(b, self.size) else None

    def until(self, b: int) -> int:
        """Where the units of a task end whose range ends at b."""
        return b

    def stream(self, start: int, b: int) -> Iterator[tuple[int, bytes]]:
        """(place of the unit, bytes of its text): no piece goes across b."""
        at = start
        while at < self.size:
            n = min(READ, b - at) if at < b else READ
            data = self._at(at, n)
            if not data:
                return
            yield at, data
            at += len(data)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


class Units(Plain):
    """Compressed units one after another. A kind says where one starts (sync) and how to undo one (decoder)."""

    whole = False

    def decoder(self):
        raise NotImplementedError

    def skip(self, head: bytes) -> int:
        """Length of something at this place that holds no text; 0 if there is none."""
        return 0

    def stream(self, start: int, b: int) -> Iterator[tuple[int, bytes]]:
        at, rest, read = start, b"", start
        while True:
            while len(rest) < 18 and (more := self._at(read, READ)):
                rest, read = rest + more, read + len(more)
            if not rest:
                return
            if over := self.skip(rest):
                at += over
                rest, read = (rest[over:], read) if over <= len(rest) else (b"", at)
                continue
            unit, used = self.decoder(), 0
            while not unit.eof:
                if not rest:
                    rest = self._at(read, READ)
                    read += len(rest)
                    if not rest:
                        if self.whole:
                            raise EOFError(f"the last part, from byte {at}, ends early")
                        if text := self.flush(unit):
                            yield at, text
                        return
                used += len(rest)
                text = unit.decompress(rest)
                rest = b""
                if text:
                    yield at, text
            rest = unit.unused_data
            at += used - len(rest)

    def flush(self, unit) -> bytes:
        return b""


class Zstd(Units):
    def decoder(self):
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()

    def skip(self, head: bytes) -> int:
        return 8 + int.from_bytes(head[4:8], "little") if head[1:4] == SKIPPABLE and head[0] & 0xF0 == 0x50 else 0

    def sync(self, a: int, b: int) -> int | None:
        if a == 0:
            return 0
        at = a
        while at < b:
            data = self._at(at, min(READ, b - at) + 3)
            i = data.find(ZSTD)
            while i >= 0:
                if at + i < b and self._ends(at + i):
                    return at + i
                i = data.find(ZSTD, i + 1)
            if len(data) < 4:
                return None
            at += min(READ, b - at)
        return None

    def _ends(self, at: int) -> bool:
        """Whether a frame that starts here leads, block by block, to another frame or to the end of the file."""
        head = self._at(at + 4, 1)
        if not head:
            return False
        d = head[0]
        single, checksum, content = d >> 5 & 1, d >> 2 & 1, d >> 6
        if d & 8:
            return False
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[d & 3] + ((1 if single else 0), 2, 4, 8)[content]
        while True:
            h = self._at(at, 3)
            if len(h) < 3:
                return True  # cut off at its end
            block = int.from_bytes(h, "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3 or size > 1 << 17:
                return False
            at += 3 + (1 if kind == 1 else size)
            if last:
                after = self._at(at + 4 * checksum, 4)
                return not after or after == ZSTD or (after[1:4] == SKIPPABLE and after[0] & 0xF0 == 0x50) or len(after) < 4


class Gzip(Units):
    """A gzip file of one or more members; blocked (BGZF) members say how long they are."""

    def __init__(self, file, size: int):
        super().__init__(file, size)
        self.blocked = self._length(0) is not None

    def decoder(self):
        return zlib.decompressobj(31)

    def flush(self, unit) -> bytes:
        return unit.flush()

    def _length(self, at: int) -> int | None:
        h = self._at(at, 18)
        if len(h) < 18 or h[:3] != GZIP or h[3] != 4 or h[12:14] != b"BC" or h[10:12] != b"\x06\x00":
            return None
        return int.from_bytes(h[16:18], "little") + 1

    def until(self, b: int) -> int:
        return b if self.blocked else self.size

    def sync(self, a: int, b: int) -> int | None:
        if a == 0:
            return 0
        if not self.blocked:
            return None
        data = self._at(a, (1 << 17) + 18)
        i = data.find(GZIP + b"\x04")
        while i >= 0 and a + i < b:
            at = a + i
            for _ in range(3):  # one chance match may be followed by no others
                n = self._length(at) if at < self.size else 0
                if n is None:
                    break
                at += n
            else:
                return a + i
            i = data.find(GZIP + b"\x04", i + 1)
        return None


def opened(path: str, size: int):
    system, inner = _system(path)
    file = system.open_input_file(inner)
    head = file.read(4)
    return (Zstd if head == ZSTD or head[1:4] == SKIPPABLE else Gzip if head[:3] == GZIP else Plain)(file, size)


# --- records ---


def records(units: Plain, a: int, b: int) -> Iterator[bytes]:
    """Records that belong to bytes a to b of the file."""
    start = units.sync(a, b)
    if start is None:
        return
    b = units.until(b)
    inside = a == 0  # whether held[head:] begins with a record of ours
    held, head, looked, others = b"", 0, 0, None  # others: where the text of the next range begins in held
    for at, text in units.stream(start, b):
        if others is None and at >= b:
            others = len(held)
        held += text
        while (found := held.find(_START, looked)) >= 0:
            if inside:
                yield held[head:found]
            if others is not None and found >= others:
                return
            inside, head, looked = True, found + 1, found + 1
        looked = max(looked, len(held) - len(_START) + 1)
        cut = head if inside else looked
        held, head, looked, others = held[cut:], 0, looked - cut, None if others is None else others - cut
        if not inside and others is not None and others <= 0:
            return
    if inside and held:
        yield held


def tags(record: bytes) -> dict[str, str]:
    head = re.split(rb"\r?\n[ \t]*\r?\n", record, maxsplit=1)[0]
    return {k.decode(): v.decode("utf-8", "replace") for k, v in reversed(_TAG.findall(head))}


class Range(InputPartition):
    def __init__(self, path: str, size: int, a: int, b: int):
        self.path, self.size, self.a, self.b = path, size, a, b


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.bytes = _bytes(options.get("bytes", "64m"))
        self.whole = options.get("whole", "false").lower() == "true"
        self.players = frozenset(p for p in options.get("players", "").split(",") if p)
        self.wanted: list[tuple[str, frozenset | None]] = [("speed", frozenset([options["speed"]]))] if options.get("speed") else []

    def partitions(self) -> list[InputPartition]:
        return [Range(path, size, a, min(size, a + self.bytes)) for path, size in files(self.path) for a in range(0, size, self.bytes)] or [Range("", 0, 0, 0)]

    def row(self, part: Range, record: bytes) -> tuple | None:
        """The row of a record, or None if a filter or the list of players leaves it out."""
        t = tags(record)
        speed = speed_of(t.get("TimeControl"))
        has = {**{h: t.get(h) for h in GAME_HEADERS}, "speed": speed}
        if self.players and not {t.get("White"), t.get("Black")} & self.players:
            return None
        if any((has[n] not in v) if v is not None else has[n] is None for n, v in self.wanted):
            return None
        return (part.path, *has.values(), record.decode("utf-8", "replace").strip("﻿"))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        units = opened(part.path, part.size)
        units.whole = self.whole
        rows, size = [], 0
        for record in records(units, part.a, part.b):
            if record.strip() and (row := self.row(part, record)):
                rows.append(row)
                size += len(record)
            if size > 4 * READ:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


class FilteringReader(ArchiveReader):
    """Takes filters over; Spark lets no reader do so unless its setting allows it."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in (*GAME_HEADERS, "speed") and isinstance(f, EqualTo | In | IsNotNull):
                self.wanted.append((name, frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None))
                if isinstance(f, IsNotNull):
                    yield f
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*rows)], names=list(COLUMNS))


def _bytes(text: str) -> int:
    n, unit = re.fullmatch(r"(\d+)([kmg]?)b?", text.strip().lower()).groups()
    return max(1, int(n) << {"": 0, "k": 10, "m": 20, "g": 30}[unit])


class GameArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "game_archive"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in COLUMNS)

    def reader(self, schema) -> ArchiveReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown", "false").lower() == "true" else ArchiveReader)(options)


def archive_games(spark: SparkSession, path: str, speed: str | None = None, players: list[str] | None = None, size: str = "64m") -> DataFrame:
    """block, one row per game, of archives plain or compressed, filtered by speed and players where they are read."""
    spark.dataSource.register(GameArchive)
    reader = spark.read.format("game_archive").option("bytes", size).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in (("speed", speed), ("players", ",".join(players) if players else None)):
        reader = reader.option(name, value) if value else reader
    return reader.load(path)
