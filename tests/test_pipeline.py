import dataclasses
import math

import numpy as np
import pytest

from mzloom.params import Parameters, Run, Warping, default_parameters
from mzloom.plans.pipeline import RunFile, dda_pipeline, stems_of
from mzloom.sources.sinks import Stages, fingerprint, parameters_json
from tests.files import mzid, mzxml


def _run(path, shift, sigma_mz, sigma_rt):
    """Three isotope envelopes of charge 2 over 60 scans, and one fragmentation event."""
    scans, num = [], 0
    for rt in np.arange(0, 180, 3.0):
        mz, v = [], []
        for center, at, h in ((500.0, 60.0, 1e5), (504.0, 90.0, 5e4), (508.0, 120.0, 2e4)):
            for k, share in enumerate((1.0, 0.55, 0.2)):
                for a in np.arange(-3, 3.01, 0.5):
                    height = h * share * math.exp(-0.5 * (a * a + ((rt - at - shift) / sigma_rt) ** 2))
                    if height > 1:
                        mz.append(center + k * 1.0033 / 2 + a * sigma_mz)
                        v.append(height)
        order = np.argsort(mz)
        num += 1
        scans.append((num, 1, float(rt), "+", np.array(mz)[order], np.array(v)[order], None))
        if rt == 60:
            num += 1
            scans.append((num, 2, 61.0 + shift, "+", [100.0], [1.0], (num - 1, 2, 500.0)))
    mzxml(path, scans)


def test_pipeline(spark, tmp_path):
    run = Run("orbitrap", resolution_ms1=20_000, reference_mz=200, fwhm_rt=20.0)
    sigma_mz = 200 / 20_000 * (500 / 200) ** 1.5 / (2 * math.sqrt(2 * math.log(2)))
    files = []
    for k, shift in enumerate((0.0, 3.0)):
        _run(tmp_path / f"run{k}.mzXML", shift, sigma_mz, 20 / 2.3548)
        mzid(tmp_path / f"run{k}.mzid", [(1, "PEPTIDE", "P1", 2, 500.0, 61.0 + shift, 1, True, False)])
        files.append(RunFile(str(tmp_path / f"run{k}.mzXML"), "mzxml", str(tmp_path / f"run{k}.mzid"), "all"))
    params = Parameters(run=run, warping=Warping(slack=3, window=20, num_points=100, peaks_per_window=20))
    t = dda_pipeline(spark, params, files, str(tmp_path / "out"))
    assert t["peaks"].where("file_id = 0").count() >= 9
    best = t["peaks"].where("file_id = 0 and peak_id = 0").first()
    assert abs(best.fitted_mz - 500.0) < 0.01 and abs(best.fitted_rt - 60) < 2
    assert t["features"].where("charge_state = 2").count() >= 4
    after = t["similarity_after"].where("file_a = 0 and file_b = 1").first().geometric_ratio
    assert after >= t["similarity_before"].where("file_a = 0 and file_b = 1").first().geometric_ratio - 1e-9
    assert t["peak_clusters_height"].columns == ["cluster_id", "run0", "run1"] and {r.file_id for r in t["peak_table"].select("file_id").distinct().collect()} == {"run0", "run1"}
    assert t["peak_events"].count() == 2
    assert [r.sequence for r in t["peptides_data"].collect()] == ["PEPTIDE"]
    assert t["protein_groups_metadata"].first().proteins == "P1"
    again = dda_pipeline(spark, params, files, str(tmp_path / "out"))  # reuses the stage tables
    assert again["peaks"].count() == t["peaks"].count()
    assert '"fwhm_rt": 20.0' in parameters_json(params) and (tmp_path / "out/parameters.json").read_text() == parameters_json(params)
    row = t["peak_annotations"].first()
    assert row.psm_sequence == "PEPTIDE" and row.protein_name == "P1" and row.psm_modifications_info.endswith("id: UNIMOD:35|Oxidation")
    assert t["peak_clusters_metadata"].where("psm_sequence = 'PEPTIDE'").count() >= 1 and t["feature_clusters_metadata"].where("consensus_sequence = 'PEPTIDE'").count() == 1
    assert t["ident_events"].count() == 2 and t["qc_tic"].count() == t["ms1"].select("file_id", "rt").distinct().count()
    for name in ("quant/peak_table", "quant/peak_annotations", "quant/peptides_metadata", "summary/linking", "qc/qc_scatter"):
        assert spark.read.csv(str(tmp_path / "out" / name), header=True).count() > 0, name
    # Linked through fragmentation events, by volume: the peak annotations stay the same here.
    other = Parameters(run=run, warping=params.warping, identification_by="theoretical_mz", quant_isotopes="volume", consensus=False)
    u = dda_pipeline(spark, other, files, str(tmp_path / "out2"), save_grid=True)
    assert {(r.file_id, r.peak_id) for r in u["peak_annotations"].collect()} == {(r.file_id, r.peak_id) for r in t["peak_annotations"].collect()}
    assert "peak_clusters_volume" in u and u["grid"].count() > 100 and [r.sequence for r in u["peptides_data"].collect()] == ["PEPTIDE"]
    one = {r.file_id: r for r in t["linking"].collect()}
    assert one["run0"].n == 1 and one["run0"].linked == 1 and one["run0"].percent == 100.0
    assert t["identification_linking"].where("file_id = 'run1'").first().n == 1 and t["identification_event_linking"].count() == 2
    text = (tmp_path / "out/summary.log").read_text()
    assert "Raw data, MS2\n    run0\n        n_scans: 1" in text and "Linkage, events to peaks" in text and "Overall average" in text
    log = (tmp_path / "out/info.log").read_text().splitlines()
    assert sum(", kept" in x for x in log) == len(log) // 2  # the second call kept all stages
    # Links that use other parameters are made anew with what reads them; the stages before them stay.
    third = dda_pipeline(spark, dataclasses.replace(params, link_n_sig_mz=2.5), files, str(tmp_path / "out"))
    log = (tmp_path / "out/info.log").read_text().splitlines()[len(log):]
    made = {x.split()[2].rstrip(":") for x in log if ", kept" not in x}
    assert made == {"peak_events", "ident_events", "ident_peaks", "peak_annotations", "feature_clusters_annotations"} and third["peak_events"].count() == 2


def test_stages_depend_on_values_inputs_and_parents(spark, tmp_path):
    out, made = str(tmp_path / "out"), []

    def call(a=1, b=1, fail=False):
        stages = Stages(spark, out)

        def make(name, n):
            made.append(name)
            if fail and name == "second":
                raise RuntimeError
            return spark.range(n).selectExpr("id", "cast(id % 2 as int) file_id")

        one = stages.table("first", lambda: make("first", a), a)
        two = stages.table("second", lambda: make("second", a + b), b, ("first",))
        return one.count(), two.count(), stages.made

    assert call() == (1, 2, ["first", "second"]) and call() == (1, 2, [])
    assert call(b=3) == (1, 4, ["second"]) and call(a=5, b=3) == (5, 8, ["first", "second"])
    with pytest.raises(RuntimeError):
        call(a=7, b=3, fail=True)  # stops between the stages
    assert call(a=7, b=3) == (7, 10, ["second"]) and call(a=5, b=3) == (5, 8, ["first", "second"])
    made.clear()
    assert call(a=5, b=3)[:2] == (5, 8) and made == []
    path = tmp_path / "in.txt"
    path.write_text("x")
    before = fingerprint(spark, str(path))
    path.write_text("xy")
    assert fingerprint(spark, str(path)) != before


def test_stems_name_runs():
    assert stems_of([RunFile("a/x.mzML"), RunFile("b/x.mzML"), RunFile("y.v2.mzXML")]) == ["x~0", "x~1", "y.v2"]


def test_defaults():
    """Every default, as documented for a run of an Orbitrap."""
    p = default_parameters()
    assert dataclasses.asdict(p) == {
        "run": {"instrument": "orbitrap", "resolution_ms1": 70000, "resolution_msn": 30000, "reference_mz": 200, "fwhm_rt": 9.0},
        "resampling": {"num_samples_mz": 5, "num_samples_rt": 5, "smoothing_coef_mz": 0.4, "smoothing_coef_rt": 0.4},
        "warping": {"slack": 30, "window": 100, "num_points": 2000, "expand": 0.2, "peaks_per_window": 100},
        "polarity": "both", "min_mz": 0, "max_mz": 100000, "min_rt": 0, "max_rt": 100000, "max_peaks": 1000000, "charge_states": (5, 4, 3, 2, 1),
        "link_n_sig_mz": 3, "link_n_sig_rt": 3, "match_fraction": 0.7, "match_n_sig_mz": 1.5, "match_n_sig_rt": 1.5, "match_intensity": 0.5, "match_compat": False, "similarity_peaks": 2000,
        "max_rank_only": True, "require_threshold": True, "ignore_decoy": True, "identification_by": "msms_event", "quant_isotopes": "height", "quant_features": "max_height",
        "charge_state_filter": True, "consensus": True, "consensus_min": 2, "save_annotations": True, "protein_min_peptides": 1, "protein_remove_subsets": True, "protein_ignore_ambiguous": True,
        "protein_quant": "razor", "scatter_peaks": 200000,
    }
