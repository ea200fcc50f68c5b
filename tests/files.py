"""Writers of small spectrum and identification files."""

import base64
import zlib

import numpy as np


def _b64(values, kind, compress=False):
    raw = np.asarray(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if compress else raw).decode()


def mzxml(path, scans, bits=64, compress=False):
    """scans: (num, level, rt, polarity, mz[], intensity[], precursor or None)."""
    out = ['<?xml version="1.0"?>\n<mzXML><msRun>\n']
    for num, level, rt, pol, mz, v, pre in scans:
        pairs = np.column_stack([mz, v]).ravel()
        out.append(f'<scan num="{num}" msLevel="{level}" polarity="{pol}"\n retentionTime="PT{rt}S" peaksCount="{len(mz)}">\n')
        if pre:
            out.append(f'<precursorMz precursorScanNum="{pre[0]}" precursorCharge="{pre[1]}" precursorIntensity="9" windowWideness="2">{pre[2]}</precursorMz>\n')
        kind = "zlib" if compress else "none"
        out.append(f'<peaks precision="{bits}" byteOrder="network" contentType="m/z-int" compressionType="{kind}">{_b64(pairs, f">f{bits // 8}", compress)}</peaks>\n</scan>\n')
    out.append("</msRun></mzXML>\n")
    path.write_text("".join(out))


def mzml(path, scans, minutes=True):
    out = ['<?xml version="1.0"?>\n<mzML><run><spectrumList count="1">\n']
    cv = lambda a, v="", u="": f'<cvParam cvRef="MS" accession="{a}" name="x" value="{v}"' + (f' unitAccession="{u}"' if u else "") + "/>"
    for num, level, rt, pol, mz, v, pre in scans:
        out.append(f'<spectrum index="{num - 1}" id="scan={num}" defaultArrayLength="{len(mz)}">{cv("MS:1000511", level)}{cv("MS:1000130" if pol == "+" else "MS:1000129")}')
        time = cv("MS:1000016", rt / 60, "UO:0000031") if minutes else cv("MS:1000016", rt, "UO:0000010")
        out.append(f"<scanList><scan>{time}</scan></scanList>")
        if pre:
            out.append(f'<precursorList><precursor spectrumRef="scan={pre[0]}">{cv("MS:1000827", pre[2])}{cv("MS:1000828", 1)}{cv("MS:1000829", 1)}{cv("MS:1000041", pre[1])}{cv("MS:1000422")}</precursor></precursorList>')
        out.append("<binaryDataArrayList>")
        for acc, values in (("MS:1000514", mz), ("MS:1000515", v)):
            out.append(f'<binaryDataArray encodedLength="1">{cv("MS:1000523")}{cv("MS:1000574")}{cv(acc)}<binary>{_b64(values, "<f8", True)}</binary></binaryDataArray>')
        out.append("</binaryDataArrayList></spectrum>\n")
    out.append("</spectrumList></run></mzML>\n")
    path.write_text("".join(out))


def mzid(path, matches):
    """matches: (id, peptide, accession, charge, mz, rt, rank, passed, decoy)."""
    out = ['<?xml version="1.0"?>\n<MzIdentML>\n']
    for k, (_, pep, acc, *_rest, decoy) in enumerate(matches):
        out.append(f'<DBSequence id="db{k}" accession="{acc}" searchDatabase_ref="s"><cvParam accession="MS:1001088" name="d" value="about {acc}"/></DBSequence>\n')
        out.append(f'<Peptide id="p{k}"><PeptideSequence>{pep}</PeptideSequence><Modification location="2" monoisotopicMassDelta="15.9949"><cvParam accession="UNIMOD:35" name="Oxidation"/></Modification></Peptide>\n')
        out.append(f'<PeptideEvidence id="e{k}" peptide_ref="p{k}" dBSequence_ref="db{k}" isDecoy="{str(decoy).lower()}"/>\n')
    for k, (i, _, _, charge, mz, rt, rank, passed, _) in enumerate(matches):
        out.append(f'<SpectrumIdentificationResult id="r{i}" spectrumID="scan={i}"><SpectrumIdentificationItem id="m{k}" peptide_ref="p{k}" passThreshold="{str(passed).lower()}" rank="{rank}" chargeState="{charge}" experimentalMassToCharge="{mz}" calculatedMassToCharge="{mz}"/><cvParam accession="MS:1000016" name="t" value="{rt}"/></SpectrumIdentificationResult>\n')
    out.append("</MzIdentML>\n")
    path.write_text("".join(out))
