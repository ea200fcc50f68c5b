"""Spectrum text in the two XML formats, one scan per row: the inverse of the piece parsers."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _packed(values, kind: str, compress: bool) -> str:
    raw = np.asarray(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if compress else raw).decode()


def mzxml_scan(number: int, rt: float, mz, intensity, bits: int = 64, compress: bool = True) -> str:
    pairs = np.column_stack([mz, intensity]).ravel()
    body = _packed(pairs, f">f{bits // 8}", compress)
    kind = "zlib" if compress else "none"
    return f'num="{number}" msLevel="1" polarity="+" retentionTime="PT{rt!r}S"><peaks precision="{bits}" byteOrder="network" contentType="m/z-int" compressionType="{kind}">{body}</peaks></scan>'


def mzml_spectrum(number: int, rt: float, mz, intensity) -> str:
    def cv(accession, value=""):
        return f'<cvParam cvRef="MS" accession="{accession}" value="{value}"/>'

    arrays = "".join(
        f'<binaryDataArray encodedLength="0">{cv("MS:1000523")}{cv("MS:1000574")}{cv(a)}<binary>{_packed(v, "<f8", True)}</binary></binaryDataArray>' for a, v in (("MS:1000514", mz), ("MS:1000515", intensity))
    )
    return f'index="{number - 1}" id="scan={number}">{cv("MS:1000511", 1)}{cv("MS:1000130")}<scanList><scan>{cv("MS:1000016", repr(rt))}</scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


#: Points of the scans that are encoded at a time.
POINTS = 1 << 18


def written(batches, write, mark: str = ""):
    """(path, number, text) batches of scans (path, number, rt, mz[], intensity[]); the arrays stay arrays, and a few scans are held at a time."""
    for b in batches:
        mz, v = b.column("mz"), b.column("intensity")
        size = mz.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), POINTS, "right")))
            head = zip(b.column("number")[at:end].to_pylist(), b.column("rt")[at:end].to_pylist(), range(at, end), strict=True)
            text = [mark + write(n, rt, *(np.asarray(x[k].values) for x in (mz, v))) for n, rt, k in head]
            yield pa.RecordBatch.from_arrays([b.column("path")[at:end], b.column("number")[at:end], pa.array(text, pa.string())], names=["path", "number", "value"])
            at = end


def pieces(scans: DataFrame, write) -> DataFrame:
    """(path, value) from scans (path, number, rt, mz[], intensity[])."""

    def run(batches):
        for b in written(batches, write):
            yield b.select(["path", "value"])

    return scans.select("path", "number", "rt", "mz", "intensity").mapInArrow(run, "path string, value string")


def write_files(scans: DataFrame, out: str, kind: str) -> None:
    """A spectrum file per path of ``scans`` (path, number, rt, mz[], intensity[]) in the folder ``out``/path=..., by number."""
    write, mark, lead, end = (mzxml_scan, "<scan ", '<?xml version="1.0"?>\n<mzXML><msRun>', "</msRun></mzXML>") if kind == "mzxml" else (mzml_spectrum, "<spectrum ", '<?xml version="1.0"?>\n<mzML><run><spectrumList>', "</spectrumList></run></mzML>")

    body = scans.select("path", "number", "rt", "mz", "intensity").mapInArrow(lambda batches: written(batches, write, mark), "path string, number long, value string")
    ends = scans.select("path").distinct().select("path", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("number"), F.lit(lead).alias("value")), F.struct(F.lit((1 << 63) - 1).alias("number"), F.lit(end).alias("value")))).alias("x")).select("path", "x.*")
    body.unionByName(ends).repartition("path").sortWithinPartitions("path", "number").select("path", "value").write.partitionBy("path").text(out)
