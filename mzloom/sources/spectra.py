"""Spectrum readers. A file is split at its spectrum elements by Spark's text source, so that large files
are read by many tasks and from any store Spark can open; each piece is decoded on its own.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCHEMA = (
    "path string, scan_number long, ms_level int, retention_time double, polarity string, centroid boolean, num_points long, max_intensity double, total_intensity double, "
    "precursor struct<scan_number:long,charge:int,mz:double,intensity:double,activation:string,window:double>, points array<struct<mz:double,intensity:double>>"
)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TAG = {n: re.compile(rf"<{n}(\s[^>]*?)?/?>", re.S) for n in ("precursorMz", "peaks", "cvParam", "precursor", "scanList", "binaryDataArray")}
_DURATION = re.compile(r"P.*?T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?")
POLARITY = {"+": "positive", "pos": "positive", "positive": "positive", "-": "negative", "neg": "negative", "negative": "negative", "": "both", "both": "both", "+-": "both", "-+": "both"}


def polarity_of(name: str) -> str:
    if name.lower() not in POLARITY:
        raise ValueError(f"unknown polarity: {name}")
    return POLARITY[name.lower()]


def check_range(low: float, high: float, what: str) -> tuple[float, float]:
    """Negative bounds mean none."""
    low, high = (0.0 if low < 0 else low), (float("inf") if high < 0 else high)
    if low >= high:
        raise ValueError(f"min_{what} must be below max_{what}")
    return low, high


def attributes(text: str) -> dict[str, str]:
    return {k: a or b for k, a, b in _ATTR.findall(text)}


def seconds(duration: str) -> float:
    m = _DURATION.fullmatch(duration.strip())
    if not m:
        return float(duration) if re.fullmatch(r"[\d.]+", duration.strip()) else 0.0
    h, mi, s = (float(x) if x else 0.0 for x in m.groups())
    return h * 3600 + mi * 60 + s


def decode(text: str, bits: int, big_endian: bool, compressed: bool, kind: str = "f") -> np.ndarray:
    """Numbers of a base64 text: floats (``f``), signed (``i``) or unsigned (``u``) integers of 32 or 64 bits."""
    raw = base64.b64decode("".join(text.split()))
    raw = zlib.decompress(raw) if compressed and raw else raw
    values = np.frombuffer(raw, f"{'>' if big_endian else '<'}{kind}{bits // 8}")
    return values.astype(float) if kind == "f" else values


def _nothing() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0), np.zeros(0)


def parse_mzxml(piece: str) -> dict | None:
    """One scan from the text behind a ``<scan`` mark, up to the next one."""
    head = piece.split(">", 1)[0]
    a = attributes(head)
    if "num" not in a:
        return None
    out = {
        "scan_number": int(a["num"]), "ms_level": int(a.get("msLevel", 1)), "retention_time": seconds(a.get("retentionTime", "PT0S")),
        "polarity": {"+": "positive", "-": "negative"}.get(a.get("polarity", ""), "both"), "centroid": a.get("centroided") == "1", "precursor": None, "stated": int(a.get("peaksCount", 0) or 0), "arrays": _nothing,
    }
    if m := _TAG["precursorMz"].search(piece):
        p, value = attributes(m.group(1) or ""), piece[m.end() :].split("<", 1)[0].strip()
        kind = p.get("activationMethod", "")
        out["precursor"] = {
            "scan_number": int(p["precursorScanNum"]) if p.get("precursorScanNum") else None, "charge": int(p.get("precursorCharge", 0) or 0), "mz": float(value or 0),
            "intensity": float(p.get("precursorIntensity", 0) or 0), "activation": kind if kind in ("CID", "HCD") else "unknown", "window": float(p.get("windowWideness", 0) or 0),
        }
    if m := _TAG["peaks"].search(piece):
        p, body = attributes(m.group(1) or ""), piece[m.end() :].split("<", 1)[0]

        def arrays():
            values = decode(body, int(p.get("precision", 32)), p.get("byteOrder", "network") == "network", p.get("compressionType", "none") == "zlib")
            return values[0::2], values[1::2]

        out["arrays"] = arrays
    return out


def parse_mzml(piece: str) -> dict | None:
    """One spectrum from the text behind a ``<spectrum`` mark, up to the next one."""
    head = attributes(piece.split(">", 1)[0])
    if "index" not in head:
        return None
    body = piece.split("</spectrum>", 1)[0]
    arrays = body.find("<binaryDataArrayList")
    about, data = (body, "") if arrays < 0 else (body[:arrays], body[arrays:])

    def params(text):
        return [attributes(m.group(1) or "") for m in _TAG["cvParam"].finditer(text)]

    cut = about.find("<precursorList")
    own, before = (about, "") if cut < 0 else (about[:cut] + about[cut:].split("</precursorList>", 1)[-1], about[cut:].split("</precursorList>", 1)[0])
    cv = {p.get("accession"): p for p in params(own)}
    rt = cv.get("MS:1000016", {})
    out = {
        "scan_number": int(head["index"]) + 1, "ms_level": int(cv.get("MS:1000511", {}).get("value") or 1), "retention_time": float(rt.get("value") or 0) * (60 if rt.get("unitAccession") == "UO:0000031" else 1),
        "polarity": "positive" if "MS:1000130" in cv else "negative" if "MS:1000129" in cv else "both", "centroid": "MS:1000127" in cv, "precursor": None, "stated": int(head.get("defaultArrayLength", 0) or 0),
    }
    if before:
        ref = attributes((_TAG["precursor"].search(before) or re.match("", "")).group(0)).get("spectrumRef", "")
        p = {x.get("accession"): x.get("value", "") for x in params(before)}
        num = re.search(r"scan=(\d+)", ref)
        number = lambda k: float(p.get(k) or 0)
        out["precursor"] = {
            "scan_number": int(num.group(1)) if num else None, "charge": int(number("MS:1000041")), "mz": number("MS:1000827") or number("MS:1000744"), "intensity": number("MS:1000042"),
            "activation": "HCD" if "MS:1000422" in p else "CID" if "MS:1000133" in p else "unknown", "window": number("MS:1000828") + number("MS:1000829"),
        }

    def arrays():
        mz, intensity = _nothing()
        for block in re.split(r"<binaryDataArray(?=[\s>])", data)[1:]:
            p = {x.get("accession") for x in params(block)}
            m = re.search(r"<binary\s*>(.*?)</binary\s*>", block, re.S)
            if "MS:1000514" in p or "MS:1000515" in p:
                whole = p & {"MS:1000519", "MS:1000522"}  # integers of 32 and 64 bits
                wide = p & {"MS:1000522", "MS:1000523"}
                values = decode(m.group(1) if m else "", 64 if wide else 32, False, "MS:1000574" in p, "i" if whole else "f").astype(float)
                mz, intensity = (values, intensity) if "MS:1000514" in p else (mz, values)
        return mz, intensity

    out["arrays"] = arrays
    return out


def _read(spark: SparkSession, path, mark: str, parse, min_mz, max_mz, min_rt, max_rt, polarity, ms_level) -> DataFrame:
    pieces = spark.read.text(path, lineSep=mark).select(F.col("_metadata.file_path").alias("path"), "value")
    return decode_pieces(pieces, parse, min_mz, max_mz, min_rt, max_rt, polarity, ms_level, mark)


def _whole(rows, mark: str | None):
    """(path, piece) rows; a piece that goes on with a longer tag name (``<scanOrigin``) belongs to the one before it."""
    held = None
    for path, piece in rows:
        longer = mark is not None and piece[:1] not in ("", " ", "\t", "\n", "\r", ">", "/")
        if held is not None and longer and held[0] == path:
            held = (path, held[1] + mark + piece)
            continue
        if held is not None:
            yield held
        held = (path, piece)
    if held is not None:
        yield held


def decode_pieces(pieces: DataFrame, parse, min_mz=-1.0, max_mz=-1.0, min_rt=-1.0, max_rt=-1.0, polarity="", ms_level=0, mark: str | None = None) -> DataFrame:
    """Scans from (path, value), where value is one piece of a spectrum file (as it lies in the file, if it was split at ``mark``)."""
    bounds, (lo_rt, hi_rt), sign = check_range(min_mz, max_mz, "mz"), check_range(min_rt, max_rt, "rt"), polarity_of(polarity)

    def wanted(s: dict) -> bool:
        return not ((ms_level and s["ms_level"] != ms_level) or not lo_rt <= s["retention_time"] <= hi_rt or (sign != "both" and s["polarity"] not in (sign, "both")))

    def run(batches):
        slices = (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64))
        pieces = ((p, t) for b in slices for p, t in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True))
        yield from batches_of(_whole(pieces, mark), parse, wanted, bounds)

    return pieces.mapInArrow(run, SCHEMA)


#: Characters of the pieces that are decoded at a time.
CHARS = 4 << 20


def _parts(pieces):
    """Lists of up to 256 (path, piece), and of no more than the first beyond CHARS characters."""
    part, held = [], 0
    for x in pieces:
        part.append(x)
        held += len(x[1])
        if len(part) == 256 or held >= CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def batches_of(pieces, parse, wanted, bounds: tuple[float, float], points: bool = True):
    """Arrow batches of the scans of (path, piece) that are ``wanted`` by their heads; only their arrays are decoded, or none.

    Points of zero intensity or outside the bounds are dropped, and scans without any point left.
    """
    names = ["path", "scan_number", "ms_level", "retention_time", "polarity", "centroid", "num_points", "max_intensity", "total_intensity", "precursor", "points"]
    types = [
        pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(),
        pa.struct([("scan_number", pa.int64()), ("charge", pa.int32()), ("mz", pa.float64()), ("intensity", pa.float64()), ("activation", pa.string()), ("window", pa.float64())]),
    ]
    point = [pa.field("mz", pa.float64()), pa.field("intensity", pa.float64())]
    for part in _parts(pieces):
        rows, kept = [], []
        for path, text in part:
            s = parse(text)
            if s is None or not wanted(s):
                continue
            head = (path, s["scan_number"], s["ms_level"], s["retention_time"], s["polarity"], s["centroid"])
            if not points:
                rows.append((*head, s["stated"], None, None, s["precursor"]))
                continue
            mz, v = s["arrays"]()
            ok = (mz >= bounds[0]) & (mz <= bounds[1]) & (v != 0)
            if ok.any():
                mz, v = mz[ok], v[ok]
                kept.append((mz, v))
                rows.append((*head, len(mz), float(v.max()), float(v.sum()), s["precursor"]))
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        if points:
            offsets = np.cumsum([0, *[len(mz) for mz, _ in kept]]).astype(np.int32)
            flat = [np.concatenate([x[k] for x in kept]) if kept else np.zeros(0) for k in (0, 1)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=point))
        else:
            lists = pa.nulls(len(rows), pa.list_(pa.struct(point)))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], lists], names=names)


def read_mzxml(spark: SparkSession, path, min_mz=-1.0, max_mz=-1.0, min_rt=-1.0, max_rt=-1.0, polarity="", ms_level=1) -> DataFrame:
    """Scans of mzXML files; ms_level 0 reads all levels."""
    return _read(spark, path, "<scan", parse_mzxml, min_mz, max_mz, min_rt, max_rt, polarity, ms_level)


def read_mzml(spark: SparkSession, path, min_mz=-1.0, max_mz=-1.0, min_rt=-1.0, max_rt=-1.0, polarity="+", ms_level=1) -> DataFrame:
    """Scans of mzML files; the scan number is the spectrum's index plus one."""
    return _read(spark, path, "<spectrum", parse_mzml, min_mz, max_mz, min_rt, max_rt, polarity, ms_level)


def with_parents(scans: DataFrame) -> DataFrame:
    """Precursors without a scan number get the last scan of a lower level before them (needs all levels)."""
    w = W.partitionBy("path").orderBy("scan_number").rowsBetween(W.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("ms_level") == 1, F.col("scan_number")), ignorenulls=True).over(w)
    named = F.when(F.col("precursor").isNotNull(), F.col("precursor").withField("scan_number", F.coalesce(F.col("precursor.scan_number"), parent)))
    return scans.withColumn("precursor", named)


def numbered(scans: DataFrame, files: dict[str, int]) -> DataFrame:
    """Adds file_id by file name; ``files`` has one entry per run, and their names must differ."""
    names = {k.rsplit("/", 1)[-1]: v for k, v in files.items()}
    if len(names) < len(files):
        raise ValueError("runs need distinct file names")
    runs = scans.sparkSession.createDataFrame(sorted(names.items()), "_name string, file_id int")
    return scans.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(runs), "_name").drop("_name")


def to_points(scans: DataFrame) -> DataFrame:
    """(file_id, scan_number, rt, mz, intensity), one row per point."""
    return scans.select("file_id", "scan_number", F.col("retention_time").alias("rt"), F.inline("points"))


def events(scans: DataFrame) -> DataFrame:
    """Fragmentation events (file_id, event_id, mz, rt, charge) of MS2 scans."""
    s = scans.where("ms_level = 2 and precursor is not null")
    return s.select("file_id", F.col("scan_number").alias("event_id"), F.col("precursor.mz").alias("mz"), F.col("retention_time").alias("rt"), F.col("precursor.charge").alias("charge"))
