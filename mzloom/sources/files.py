"""``spark.read.format("spectra")``: mzXML and mzML files, read in parts that are planned from the files' own indexes.

A file ends with the place of its index, and the index holds the offset of every spectrum; a partition is a range of whole spectra
of about ``part_bytes``. A missing or wrong index (an offset that no spectrum starts at) is replaced by one pass over
the file. Filters on ms_level, scan_number, retention_time and polarity are pushed into the source: the heads of spectra
decide, and arrays of dropped ones are never decoded; with ``points=false`` none are (num_points is then the stated length).

Options: ``format`` (mzxml or mzml, else by the file's suffix), ``part_bytes``, ``points``, ``min_mz``, ``max_mz``. Paths may be files, folders or
comma-separated lists in any store that pyarrow opens on every executor; ``spectra.read_mzxml`` and ``read_mzml`` read stores that only Spark opens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from mzloom.sources import spectra

PART_BYTES = 16 << 20
_BLOCK = 4 << 20
_MARKS = {"mzxml": (b"<scan", spectra.parse_mzxml, "indexOffset"), "mzml": (b"<spectrum", spectra.parse_mzml, "indexListOffset")}
_AFTER = b" \t\r\n>/"
_TESTS: dict[type, Callable] = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}
#: What a head tells.
_PUSHED = {"ms_level", "scan_number", "retention_time", "polarity"}


def _store(path: str):
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def opened(path: str):
    system, inner = _store(path)
    return system.open_input_file(inner)


def packed(path: str) -> bool:
    """Whether a file is compressed, and so read from its beginning."""
    return path.endswith((".gz", ".bz2"))


def unpacked(path: str):
    system, inner = _store(path)
    return system.open_input_stream(inner)


def listed(path: str) -> list[str]:
    """The files of a path; those of a folder by name, hidden ones left out."""
    out = []
    for p in path.split(","):
        system, inner = _store(p)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            lead = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            found = system.get_file_info(fs.FileSelector(inner, recursive=True))
            out += sorted(lead + f.path for f in found if f.type == fs.FileType.File and not any(x[:1] in "._" for x in f.path[len(inner) :].strip("/").split("/")))
        else:
            out.append(p)
    return out


def kind_of(path: str, option: str | None) -> str:
    kind = (option or path.rsplit(".", 1)[-1]).lower()
    if kind not in _MARKS:
        raise ValueError(f"unknown spectrum format: {kind}")
    return kind


def _starts_at(f, offset: int, mark: bytes) -> bool:
    f.seek(offset)
    got = f.read(len(mark) + 1)
    return got[: len(mark)] == mark and got[len(mark) :] in [bytes([c]) for c in _AFTER]


def indexed_offsets(f, size: int, kind: str) -> list[int] | None:
    """Offsets of spectra by the file's own index; None without one that holds."""
    mark, _, tag = _MARKS[kind]
    f.seek(max(0, size - 4096))
    m = re.search(rf"<{tag}>\s*(\d+)\s*</{tag}>".encode(), f.read())
    if not m or not 0 < int(m[1]) < size:
        return None
    f.seek(int(m[1]))
    text = f.read(size - int(m[1]))
    # The index of chromatograms, if there is one, follows that of spectra.
    head = re.match(rb"\s*(?:<indexList[^>]*>\s*)?<index\s+name\s*=\s*[\"'](?:scan|spectrum)[\"']\s*>", text)
    if not head:
        return None
    offsets = [int(x) for x in re.findall(rb"<offset[^>]*>\s*(\d+)\s*</offset>", text[head.end() : text.find(b"</index>")])]
    if not offsets or any(a >= b for a, b in zip(offsets, offsets[1:])) or offsets[-1] >= size:
        return None
    # A part begins at an offset, so each of them must hold; a wrong one elsewhere shows at the next part.
    return offsets if all(_starts_at(f, o, mark) for o in (offsets[0], offsets[len(offsets) // 2], offsets[-1])) else None


def scanned_offsets(f, kind: str) -> list[int]:
    """Offsets of spectra by one pass over the file."""
    mark, out, at, rest = _MARKS[kind][0], [], 0, b""
    f.seek(0)
    found = re.compile(re.escape(mark) + b"(?=[" + _AFTER.replace(b"\r\n", rb"\r\n") + b"])")
    while block := f.read(_BLOCK):
        text = rest + block
        out += [at + m.start() for m in found.finditer(text)]
        keep = len(mark)  # a mark needs the character behind it
        at, rest = at + len(text) - keep, text[-keep:]
    return sorted(set(out))


@dataclass
class Part(InputPartition):
    path: str = ""
    start: int = 0
    end: int = 0

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def plan(path: str, kind: str, part_bytes: int) -> list[Part]:
    """Ranges of whole spectra of about ``part_bytes``."""
    with opened(path) as f:
        size = f.size()
        offsets = indexed_offsets(f, size, kind)
        if offsets is not None:
            cuts = _cuts(offsets, part_bytes)
            if all(_starts_at(f, c, _MARKS[kind][0]) for c in cuts):
                return [Part(path, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        cuts = _cuts(scanned_offsets(f, kind), part_bytes)
    return [Part(path, a, b) for a, b in zip(cuts, [*cuts[1:], size])]


def _cuts(offsets: list[int], part_bytes: int) -> list[int]:
    cuts: list[int] = []
    for o in offsets:
        if not cuts or o - cuts[-1] >= part_bytes:
            cuts.append(o)
    return cuts


@dataclass
class SpectrumReader(DataSourceReader):
    options: dict
    tests: list = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and len(column) == 1 and column[0] in _PUSHED and f.value is not None:
                self.tests.append((type(f).__name__, column[0], f.value))
            else:
                yield f

    def _kind(self, path: str) -> str:
        return kind_of(path, self.options.get("format"))

    def partitions(self) -> list[Part]:
        if not self.options.get("path"):
            raise ValueError("spectra: no path")
        size = int(self.options.get("part_bytes", PART_BYTES))
        return [p for path in listed(self.options["path"]) for p in plan(path, self._kind(path), size)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        kind, tests = self._kind(part.path), {t.__name__: f for t, f in _TESTS.items()}
        mark, parse, _ = _MARKS[kind]
        bounds = spectra.check_range(float(self.options.get("min_mz", -1)), float(self.options.get("max_mz", -1)), "mz")
        wanted = lambda s: all(tests[t](s[c], v) for t, c, v in self.tests)
        points = str(self.options.get("points", "true")).lower() != "false"
        with opened(part.path) as f:
            f.seek(part.start)
            pieces = _pieces(f, part.end - part.start, mark)
            texts = ((part.path, p.decode("utf-8", "replace")) for p in pieces)
            yield from spectra.batches_of(spectra._whole(texts, mark.decode()), parse, wanted, bounds, points)


def _pieces(f, length: int, mark: bytes) -> Iterator[bytes]:
    """What lies behind each mark, block by block; only one spectrum and one block are held."""
    held = b""
    while length > 0 and (block := f.read(min(_BLOCK, length))):
        length -= len(block)
        *whole, held = (held + block).split(mark)
        yield from whole
    yield held


class SpectrumSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return spectra.SCHEMA

    def reader(self, schema) -> SpectrumReader:
        return SpectrumReader(dict(self.options))


#: The elements of an identification file that make its four tables; none lies within another.
IDENTIFIED = ("DBSequence", "PeptideEvidence", "Peptide", "SpectrumIdentificationResult")
_BEGIN = re.compile(rb"<(" + "|".join(IDENTIFIED).encode() + rb")(?=[\s>/])")
_HEAD = re.compile(rb"<[\w:.-]+(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*(/?)>")
_CLOSE = {t.encode(): re.compile(rb"</" + t.encode() + rb"\s*>") for t in IDENTIFIED}
_LONGEST = 64  # a mark with the character behind it is shorter


def elements(f, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """(tag, text) of the elements that begin in the range of bytes, each to its end; one element and one block are held."""
    if start:
        f.seek(start)
    base, text, at = start, b"", 0
    while True:
        m = _BEGIN.search(text, at)
        if m and base + m.start() >= end:
            return
        if m:
            head = _HEAD.match(text, m.start())
            close = head if head and head[1] else _CLOSE[m[1]].search(text, head.end()) if head else None
            if close:
                yield m[1].decode(), text[m.start() : close.end()]
                at = close.end()
                continue
        keep = m.start() if m else max(at, len(text) - _LONGEST)
        if not m and base + keep >= end:
            return
        block = f.read(_BLOCK)
        if not block:
            return
        base, text, at = base + keep, text[keep:] + block, 0


@dataclass
class ElementReader(DataSourceReader):
    options: dict

    def partitions(self) -> list[Part]:
        if not self.options.get("path"):
            raise ValueError("identifications: no path")
        step, out = int(self.options.get("part_bytes", PART_BYTES)), []
        for path in listed(self.options["path"]):
            if packed(path):
                out.append(Part(path, 0, 1 << 62))
                continue
            with opened(path) as f:
                out += [Part(path, a, min(a + step, f.size())) for a in range(0, f.size(), step)]
        return out

    def read(self, part: Part) -> Iterator[tuple[str, str, str]]:
        if part.path:
            with (unpacked if packed(part.path) else opened)(part.path) as f:
                for tag, text in elements(f, part.start, part.end):
                    yield part.path, tag, text.decode("utf-8", "replace")


class ElementSource(DataSource):
    """``identifications``: (path, tag, value), the elements of mzIdentML files in one pass, in parts of ``part_bytes``; a compressed file (gz, bz2) is one part."""

    @classmethod
    def name(cls) -> str:
        return "identifications"

    def schema(self) -> str:
        return "path string, tag string, value string"

    def reader(self, schema) -> ElementReader:
        return ElementReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes ``spectra`` and ``identifications`` known to a session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpectrumSource)
    spark.dataSource.register(ElementSource)
    return spark
