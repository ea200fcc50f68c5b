import base64
import zlib

import numpy as np
import pytest

from mzloom.sources import files, identifications, spectra
from tests.files import mzid, mzml, mzxml

SCANS = [
    (1, 1, 10.5, "+", [400.0, 500.25, 600.0], [5.0, 0.0, 7.5], None),
    (2, 2, 11.0, "+", [100.0], [3.0], (1, 2, 500.25)),
    (3, 1, 12.0, "-", [450.0], [2.0], None),
    (4, 1, 100.0, "+", [], [], None),
]


@pytest.mark.parametrize(("bits", "compress"), [(64, False), (32, False), (64, True)])
def test_mzxml(spark, tmp_path, bits, compress):
    mzxml(tmp_path / "a.mzXML", SCANS, bits, compress)
    rows = spectra.read_mzxml(spark, str(tmp_path / "a.mzXML")).orderBy("scan_number").collect()
    assert [r.scan_number for r in rows] == [1, 3]  # level 1, empty scans dropped
    assert [(p.mz, p.intensity) for p in rows[0].points] == [(400.0, 5.0), (600.0, 7.5)]  # zero intensities dropped
    assert rows[0].max_intensity == 7.5 and rows[0].total_intensity == 12.5 and rows[0].retention_time == 10.5
    two = spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), ms_level=2).collect()[0]
    assert two.precursor.mz == 500.25 and two.precursor.charge == 2 and two.precursor.scan_number == 1
    assert spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), polarity="-").count() == 1
    assert spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), min_rt=11, max_rt=13).count() == 1
    with pytest.raises(ValueError):
        spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), min_mz=5, max_mz=5)
    with pytest.raises(ValueError):
        spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), polarity="up")


@pytest.mark.parametrize("minutes", [True, False])
def test_mzml(spark, tmp_path, minutes):
    mzml(tmp_path / "a.mzML", SCANS, minutes)
    rows = spectra.read_mzml(spark, str(tmp_path / "a.mzML"), polarity="").orderBy("scan_number").collect()
    assert [r.scan_number for r in rows] == [1, 3]
    assert np.isclose(rows[0].retention_time, 10.5) and [p.mz for p in rows[0].points] == [400.0, 600.0]
    two = spectra.read_mzml(spark, str(tmp_path / "a.mzML"), ms_level=2).collect()[0]
    assert (two.precursor.scan_number, two.precursor.charge, two.precursor.mz, two.precursor.window, two.precursor.activation) == (1, 2, 500.25, 2.0, "HCD")


def test_points_and_events(spark, tmp_path):
    mzxml(tmp_path / "a.mzXML", SCANS)
    s = spectra.numbered(spectra.read_mzxml(spark, str(tmp_path / "a.mzXML"), ms_level=0), {"x/a.mzXML": 4})
    assert spectra.to_points(s).count() == 4
    assert spectra.events(s).collect()[0][:4] == (4, 2, 500.25, 11.0)
    assert spectra.with_parents(s).where("scan_number = 2").collect()[0].precursor.scan_number == 1


def test_mzidentml(spark, tmp_path):
    mzid(tmp_path / "a.mzid", [(1, "PEPTIDE", "P1", 2, 400.2, 30, 1, True, False), (1, "OTHER", "P2", 2, 400.2, 30, 2, True, False), (2, "DECOY", "P3", 2, 410.0, 31, 1, True, True), (3, "LOW", "P4", 3, 420.0, 32, 1, False, False)])
    d = identifications.read_mzidentml(spark, str(tmp_path / "a.mzid"))
    assert [(r.match_id, r.rt) for r in d.spectrum_matches.collect()] == [("m0", 30.0)]
    assert d.db_sequences.where("accession = 'P1'").collect()[0].description == "about P1"
    m = d.peptides.where("peptide_id = 'p0'").collect()[0].modifications
    assert len(m) == 1 and m[0].location == 2 and m[0].id == ["UNIMOD:35|Oxidation"] and m[0].average_mass_delta == 0.0 and m[0].residues == ""
    loose = identifications.read_mzidentml(spark, str(tmp_path / "a.mzid"), ignore_decoy=False, require_threshold=False, max_rank_only=False)
    assert loose.spectrum_matches.count() == 4


def test_substitutions_and_several_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.mzid").write_text(
            f'<MzIdentML><DBSequence id="d" accession="P{k}"/><Peptide id="p"><PeptideSequence>PEP{k}</PeptideSequence>'
            f'<SubstitutionModification originalResidue="A" replacementResidue="G" location="{k + 1}" monoisotopicMassDelta="-14.01"/></Peptide><PeptideEvidence id="e" peptide_ref="p" dBSequence_ref="d"/>'
            f'<SpectrumIdentificationResult id="r" spectrumID="s"><SpectrumIdentificationItem id="m" peptide_ref="p" passThreshold="true" rank="1" chargeState="2" experimentalMassToCharge="400"/></SpectrumIdentificationResult></MzIdentML>\n'
        )
    d = identifications.read_mzidentml(spark, [str(tmp_path / f"{k}.mzid") for k in range(2)])
    got = {(r.sequence, r.modifications[0].id[0], r.modifications[0].location) for r in d.spectrum_matches.join(d.peptides, ["path", "peptide_id"]).collect()}
    assert got == {("PEP0", "SUBSTITUTION|A->G", 1), ("PEP1", "SUBSTITUTION|A->G", 2)}


def test_white_space_and_longer_tag_names(spark, tmp_path):
    mzxml(tmp_path / "a.mzXML", SCANS)
    text = (tmp_path / "a.mzXML").read_text()
    (tmp_path / "b.mzXML").write_text(text.replace("<scan ", "<scan\n\t").replace("<peaks", '<scanOrigin parentFileID="x" num="9"/><peaks'))
    plain, odd = (spectra.read_mzxml(spark, str(tmp_path / f"{n}.mzXML"), ms_level=0).drop("path").orderBy("scan_number").collect() for n in "ab")
    assert plain == odd and len(plain) == 3
    mzml(tmp_path / "a.mzML", SCANS)
    text = (tmp_path / "a.mzML").read_text()
    (tmp_path / "b.mzML").write_text(text.replace("<spectrum ", "<spectrum\r\n ").replace("<binaryDataArray ", "<binaryDataArray\n").replace("<binary>", "<binary >"))
    plain, odd = (spectra.read_mzml(spark, str(tmp_path / f"{n}.mzML"), polarity="", ms_level=0).drop("path").orderBy("scan_number").collect() for n in "ab")
    assert plain == odd and len(plain) == 3


def _indexed(path, kind, broken=""):
    """Adds the format's index to a plain file; ``broken`` spoils it."""
    raw = path.read_bytes()
    mark, close = (b"<scan ", b"</mzXML>") if kind == "mzxml" else (b"<spectrum ", b"</mzML>")
    at, offsets = raw.find(mark), []
    while at >= 0:
        offsets.append(at + (7 if broken == "shifted" else 0))
        at = raw.find(mark, at + 1)
    place = len(raw) - len(close) - 1 + (10**6 if broken == "place" else 0)
    name = b"scan" if kind == "mzxml" else b"spectrum"
    rows = b"".join(b'<offset id="%d">%d</offset>' % (k, o) for k, o in enumerate(offsets))
    index = b'<index name="%s">%s</index>' % (name, rows)
    tag = b"indexOffset" if kind == "mzxml" else b"indexListOffset"
    index = index if kind == "mzxml" else b'<indexList count="1">' + index + b"</indexList>"
    path.write_bytes(raw.replace(close + b"\n", index + b"<%s>%d</%s>" % (tag, place, tag) + close + b"\n"))


MANY = [(k + 1, 1 + k % 2, 10.0 + k, "+-"[k % 3 == 0], np.arange(400.0, 400 + 5 + k % 7), np.arange(1.0, 6 + k % 7), (k, 2, 500.25) if k % 2 else None) for k in range(40)]


@pytest.mark.parametrize("kind", ["mzxml", "mzml"])
@pytest.mark.parametrize("index", ["none", "whole", "shifted", "place"])
def test_spectrum_source(spark, tmp_path, kind, index):
    files.register(spark)
    write, read = (mzxml, spectra.read_mzxml) if kind == "mzxml" else (mzml, spectra.read_mzml)
    for n in "ab":
        write(tmp_path / f"{n}.{kind}", MANY)
        if index != "none":
            _indexed(tmp_path / f"{n}.{kind}", kind, index)
    with files.opened(str(tmp_path / f"a.{kind}")) as f:
        found = files.indexed_offsets(f, f.size(), kind)
        assert (found is not None) == (index == "whole") and (found is None or len(found) == 40)
        assert len(files.scanned_offsets(f, kind)) == 40
    want = read(spark, str(tmp_path / f"a.{kind}"), polarity="", ms_level=0).drop("path").orderBy("scan_number").collect()
    whole = spark.read.format("spectra").option("part_bytes", 1500).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() > 10 and whole.where("path like '%b." + kind + "'").count() == 40
    assert whole.where("path like '%a." + kind + "'").drop("path").orderBy("scan_number").collect() == want and len(want) == 40
    some = whole.where("ms_level = 1 and retention_time between 15 and 30 and polarity in ('positive', 'both') and num_points > 6 and path like '%/a." + kind + "'")
    assert [r.scan_number for r in some.orderBy("scan_number").collect()] == [r.scan_number for r in want if r.ms_level == 1 and 15 <= r.retention_time <= 30 and r.polarity == "positive" and r.num_points > 6]
    heads = spark.read.format("spectra").option("points", "false").option("format", kind).load(str(tmp_path / f"a.{kind}"))
    assert heads.where("points is null").count() == 40


def test_dropped_spectra_are_not_decoded(monkeypatch, tmp_path):
    mzxml(tmp_path / "a.mzxml", MANY)
    reader = files.SpectrumReader({"path": str(tmp_path / "a.mzxml")})
    other = files.EqualTo(("centroid",), True)
    assert list(reader.pushFilters([files.EqualTo(("ms_level",), 2), files.LessThan(("retention_time",), 20.0), other])) == [other]
    decoded = []
    real = spectra.decode
    monkeypatch.setattr(spectra, "decode", lambda *a: (decoded.append(1), real(*a))[1])
    got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("scan_number").to_pylist()]
    assert got == [2, 4, 6, 8, 10] and len(decoded) == 5
    with pytest.raises(ValueError):
        files.kind_of("x.txt", None)


def test_two_known_scans(spark, tmp_path):
    """64-bit network order, nested scans, attributes over several lines, and a scan without points."""
    (tmp_path / "k.mzxml").write_text(
        '<?xml version="1.0"?>\n<mzXML><msRun scanCount="2">\n<scan num="1"\n scanType="Full" centroided="1" msLevel="1" peaksCount="2"\n polarity="-" retentionTime="PT1H2M3.5S">\n'
        '<peaks compressionType="none" compressedLen="0" precision="64" byteOrder="network" contentType="m/z-int">' + "QHkAAAAAAABAFAAAAAAAAEB/RAAAAAAAQB4AAAAAAAA=" + '</peaks>\n'
        '<scan num="2" msLevel="2" peaksCount="0" polarity="-" retentionTime="PT3725S"><precursorMz precursorScanNum="1" precursorIntensity="1.5" precursorCharge="3" activationMethod="HCD" windowWideness="2.0">557.64</precursorMz>\n'
        '<peaks precision="64" byteOrder="network" contentType="m/z-int">QFkAAAAAAABACAAAAAAAAA==</peaks></scan>\n</scan>\n</msRun></mzXML>\n'
    )
    files.register(spark)
    one, two = spark.read.format("spectra").load(str(tmp_path / "k.mzxml")).orderBy("scan_number").collect()
    assert (one.retention_time, one.polarity, one.centroid, one.points) == (3723.5, "negative", True, [(400.0, 5.0), (500.25, 7.5)])
    assert two.precursor.asDict() == {"scan_number": 1, "charge": 3, "mz": 557.64, "intensity": 1.5, "activation": "HCD", "window": 2.0} and two.points == [(100.0, 3.0)]


@pytest.mark.parametrize(("kind", "bits"), [("f", 32), ("f", 64), ("u", 32), ("u", 64), ("i", 32), ("i", 64)])
@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_numbers_of_every_kind(kind, bits, big, packed):
    values = np.array([0, 1, 2**bits // 2 - 1 if kind != "f" else 1.5, 77, 2**bits - 1 if kind == "u" else -3], f"{'>' if big else '<'}{kind}{bits // 8}")
    raw = zlib.compress(values.tobytes()) if packed else values.tobytes()
    text = base64.b64encode(raw).decode()
    got = spectra.decode(text[:5] + "\n " + text[5:], bits, big, packed, kind)
    assert got.tolist() == values.tolist() and len(spectra.decode("", bits, big, packed, kind)) == 0


def test_integer_intensities(spark, tmp_path):
    mzml(tmp_path / "a.mzML", SCANS[:1])
    text = (tmp_path / "a.mzML").read_text()
    ints = base64.b64encode(np.array([5, 0, 9], "<i4").tobytes()).decode()
    head, mid, tail = text.partition('<cvParam cvRef="MS" accession="MS:1000515"')
    cut = head.rindex('<cvParam cvRef="MS" accession="MS:1000523"')
    tail = mid + tail[: tail.index("<binary>") + 8] + ints + tail[tail.index("</binary>") :]
    (tmp_path / "b.mzML").write_text(head[:cut] + '<cvParam cvRef="MS" accession="MS:1000519" name="x" value=""/>' + tail)
    row = spectra.read_mzml(spark, str(tmp_path / "b.mzML")).first()
    assert [(p.mz, p.intensity) for p in row.points] == [(400.0, 5.0), (600.0, 9.0)]


def test_elements_are_cut_once(tmp_path):
    """Elements of every form, in ranges of any size: each is found once, by the range that it begins in."""
    text = '<?xml version="1.0"?><MzIdentML><!-- x --><DBSequence id="a" name="x &gt; y > z"/><DBSequence\n id=\'b\'><cvParam value="/>"/></DBSequence ><Peptide id="p"><PeptideSequence>PEP</PeptideSequence></Peptide>'
    text += '<PeptideEvidence id="e" peptide_ref="p"/><SpectrumIdentificationResult id="r"><SpectrumIdentificationItem id="i"><PeptideEvidenceRef peptideEvidence_ref="e"/></SpectrumIdentificationItem></SpectrumIdentificationResult></MzIdentML>'
    (tmp_path / "a.mzid").write_text(text)
    for step in (1, 7, 50, 10_000):
        with files.opened(str(tmp_path / "a.mzid")) as f:
            found = [x for a in range(0, len(text), step) for x in files.elements(f, a, a + step)]
        assert [t for t, _ in found] == ["DBSequence", "DBSequence", "Peptide", "PeptideEvidence", "SpectrumIdentificationResult"]
        assert all(text.count(v.decode()) == 1 for _, v in found) and found[1][1].endswith(b"</DBSequence >") and found[4][1].endswith(b"</SpectrumIdentificationResult>")


def test_one_pass_gives_the_same_tables(spark, tmp_path, monkeypatch):
    rows = [(k, f"PEP{k}", f"P{k % 3}", 2, 400.0 + k, 30 + k, 1 + k % 2, k % 4 > 0, k % 5 == 0) for k in range(40)]
    for n in "ab":
        mzid(tmp_path / f"{n}.mzid", rows)
    monkeypatch.setattr(files, "PART_BYTES", 700)
    for strict in (True, False):
        one, four = (identifications.read_mzidentml(spark, [str(tmp_path / f"{n}.mzid") for n in "ab"], strict, strict, strict, one_pass=p) for p in (True, False))
        for name in ("db_sequences", "peptides", "peptide_evidence", "spectrum_matches"):
            a, b = ([r[1:] for r in getattr(x, name).collect()] for x in (one, four))
            assert sorted(map(str, a)) == sorted(map(str, b)) and a, name


def test_scans_are_written_and_decoded_a_few_at_a_time(monkeypatch):
    """Batches of large scans are cut by their points and characters; nothing is lost at the cuts."""
    import pyarrow as pa

    from mzloom.sources import encode, spectra

    monkeypatch.setattr(encode, "POINTS", 1000)
    monkeypatch.setattr(spectra, "CHARS", 1000)
    size = [0, 400, 700, 1500, 3, 0, 5]
    mz = [[100.0 + k for k in range(n)] for n in size]
    b = pa.RecordBatch.from_pydict({"path": ["a"] * 7, "number": list(range(1, 8)), "rt": [float(k) for k in range(7)], "mz": pa.array(mz, pa.list_(pa.float64())), "intensity": pa.array([[1.0] * n for n in size], pa.list_(pa.float64()))})
    out = list(encode.written([b], encode.mzxml_scan))
    assert [x.num_rows for x in out] == [2, 1, 1, 3]
    rows = [r for x in out for r in x.to_pylist()]
    assert [r["number"] for r in rows] == list(range(1, 8))
    parts = list(spectra.batches_of([(r["path"], r["value"]) for r in rows], spectra.parse_mzxml, lambda s: True, (0.0, float("inf"))))
    assert len(parts) > 2 and [n for p in parts for n in p.column("num_points").to_pylist()] == [n for n in size if n]


def test_identification_files_have_a_bounded_size(spark, monkeypatch):
    import glob

    from mzloom.plans import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 30)
    q = spark.range(200).selectExpr("CAST(id % 2 AS INT) AS file_id", "id AS psm_index", "500D AS mz", "10D AS rt", "500D AS theoretical_mz", "2 AS psm_charge_state", "'PEP' AS sequence")
    out = queries._identification_files(q)
    texts = [open(f).read() for f in glob.glob(f"{out}/file_id=*/part=*/*.txt")]
    assert len(texts) == 8 and all(t.count("<MzIdentML>") == t.count("</MzIdentML>") == 1 and t.count("<DBSequence") < 60 for t in texts)
    got = {r.match_id for r in queries.identification_files(q).collect()} if not hasattr(queries.identification_files, "__wrapped__") else None
    assert got == {f"m{k}" for k in range(200) if k % 5 and k % 7}


def test_identification_files_are_small(spark, tmp_path):
    """What a query leaves on disk beside its result: compressed files, and elements without their text."""
    import gzip

    from mzloom.plans import queries
    from mzloom.storage import shared_dir

    mzid(tmp_path / "a.mzid", [(k, "PEPTIDE", f"P{k}", 2, 400.2, 30, 1, True, k % 3 == 0) for k in range(50)])
    with gzip.open(tmp_path / "b.mzid.gz", "wt") as f:
        f.write((tmp_path / "a.mzid").read_text())
    tables = []
    for one_pass in (False, True):
        for name in ("a.mzid", "b.mzid.gz"):
            d = identifications.read_mzidentml(spark, str(tmp_path / name), one_pass=one_pass)
            tables.append([sorted(map(str, t.drop("path").collect())) for t in (d.db_sequences, d.peptides, d.peptide_evidence, d.spectrum_matches)])
    assert all(t == tables[0] for t in tables) and len(tables[0][3]) == 33

    import os

    def size(found):
        return sum(os.path.getsize(os.path.join(r, f)) for p in found for r, _, fs in os.walk(p) for f in fs)

    root = shared_dir(spark).removeprefix("file:")
    q = spark.range(20_000).selectExpr("CAST(id % 2 AS INT) AS file_id", "id AS psm_index", "500 + id / 7D AS mz", "10D AS rt", "500 + id / 7D AS theoretical_mz", "2 AS psm_charge_state", "'PEP' AS sequence")
    before = set(os.listdir(root))
    assert queries.identification_files_in_one_pass(q).count() == spark.range(20_000).where("id % 5 <> 0 and id % 7 <> 0 and 500 + id / 7D between 350 and 900").count()
    assert size([os.path.join(root, x) for x in set(os.listdir(root)) - before]) < 300 * 20_000
