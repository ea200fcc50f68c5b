import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mzloom.functions import exprs
from mzloom.operators import components, features, grid, link, match, peaks, points, proteins, quant, similarity, summary, warp
from mzloom.params import Resampling, Run, Warping, default_parameters, instrument

RNG = np.random.default_rng(7)


def test_rolling_cosine_known_case():
    score, lo, hi = features.rolling_cosine([1, 100, 50, 25, 1], [100, 50, 25])
    assert (lo, hi) == (1, 3) and abs(score - 1) < 1e-12
    assert features.rolling_cosine([1, 0, 2], [1, 2]) == (0.0, 0, 0)
    assert features.rolling_cosine([1], [1, 2]) == (0.0, 0, 0)


def test_averagine_table():
    t = features.averagine_table()
    assert len(t) == 391 and t[0][0] == 100.226 and t[-1][0] == 3999.848
    assert np.allclose(t[0][1][:2], [100, 4.79], atol=0.2)
    assert features.nearest_pattern(105.2235, t) == t[1][1] and features.nearest_pattern(5000, t) is None


def test_instruments():
    assert instrument("Quadrupole") == "quad" and default_parameters().run.fwhm_rt == 9
    with pytest.raises(ValueError):
        instrument("sundial")
    with pytest.raises(ValueError):
        default_parameters("tof")


def _gauss_points(spark, centers, s_mz, s_rt, file_id=0, step=(0.2, 0.25)):
    rows = set()
    for mz, rt, h in centers:
        for a in np.arange(-3, 3.01, step[0]):
            for b in np.arange(-3, 3.01, step[1]):
                rows.add((file_id, float(round(rt + b * s_rt, 6)), float(round(mz + a * s_mz, 6)), float(h * math.exp(-0.5 * (a * a + b * b)))))
    return spark.createDataFrame(sorted(rows), "file_id int, rt double, mz double, intensity double")


def test_fit_recovers_gaussians(spark):
    run = Run("quad", resolution_ms1=200 / (0.05 * exprs.SIGMA), reference_mz=200, fwhm_rt=5 * exprs.SIGMA)
    truth = [(500.0, 100.0, 1000.0), (510.0, 200.0, 50.0)]
    pts = _gauss_points(spark, truth, 0.05, 5.0)
    maxima = spark.createDataFrame([(0, 500.01, 101.0, 900.0), (0, 510.0, 199.0, 45.0), (0, 800.0, 1.0, 1.0)], "file_id int, mz double, rt double, value double")
    got = peaks.find_peaks(pts, maxima, run).orderBy("peak_id").collect()
    assert len(got) == 2
    for g, (mz, rt, h) in zip(got, truth, strict=True):
        assert np.allclose([g.fitted_mz, g.fitted_rt, g.fitted_height, g.fitted_sigma_mz, g.fitted_sigma_rt], [mz, rt, h, 0.05, 5.0], rtol=1e-4)
    cen = peaks.find_peaks(pts, maxima, run, centroid=True).orderBy("peak_id").collect()[0]
    assert np.isclose(cen.fitted_sigma_mz, 0.05) and np.isclose(cen.fitted_mz, 500.01)


def test_solve_agrees_with_least_squares():
    u, v = RNG.normal(size=40), RNG.normal(size=40)
    y = 3 + 0.2 * u - 0.5 * u**2 + 0.1 * v - 0.4 * v**2 + RNG.normal(size=40) * 0.01
    w2 = RNG.random(40)
    sums = np.array([[(w2 * u**p * v**q).sum() for p, q in peaks.MOMENTS]])
    rhs = np.array([[(w2 * y * u**p * v**q).sum() for p, q in peaks.TERMS]])
    a = np.stack([u**p * v**q for p, q in peaks.TERMS], 1)
    want = np.linalg.lstsq(a * np.sqrt(w2)[:, None], y * np.sqrt(w2), rcond=None)[0]
    assert np.allclose(peaks.solve(sums, rhs)[0], want, atol=1e-8)


def test_failure_text(spark):
    df = spark.createDataFrame([(0,), (1 | 1 << 38,)], "code long").select(peaks.failure_text("code").alias("t")).collect()
    assert df[0].t == "Fit Failure Errors:\nNo errors detected.\n" and df[1].t == "Fit Failure Errors:\n- Weight sum is zero\n- Fitted sigma_rt is too large\n"


def _dense(points, b, run, how):
    """The dense grid by plain loops."""
    k = how.num_samples_mz
    n = int((b["max_mz"] - b["min_mz"]) * k / (run.reference_mz / run.resolution_ms1)) + 1
    m = math.ceil((b["max_rt"] - b["min_rt"]) / (run.fwhm_rt / k)) + 1
    x = b["min_mz"] + np.arange(n) * (b["max_mz"] - b["min_mz"]) / (n - 1)
    y = b["min_rt"] + np.arange(m) * (b["max_rt"] - b["min_rt"]) / (m - 1)
    s_mz = run.reference_mz / run.resolution_ms1 / exprs.SIGMA * how.smoothing_coef_mz / math.sqrt(2)
    s_rt = run.fwhm_rt / exprs.SIGMA * how.smoothing_coef_rt / math.sqrt(2)
    g = np.zeros((n, m))
    for rt, mz, v in points:
        ci, cj = int(k * (mz - b["min_mz"]) / (run.reference_mz / run.resolution_ms1)), math.ceil((rt - b["min_rt"]) / (run.fwhm_rt / k))
        i, j = np.arange(max(0, ci - 5), min(n - 1, ci + 5) + 1), np.arange(max(0, cj - 5), min(m - 1, cj + 5) + 1)
        w = np.exp(-0.5 * (((x[i] - mz) / s_mz)[:, None] ** 2 + ((y[j] - rt) / s_rt)[None, :] ** 2))
        g[np.ix_(i, j)] += w / (w.sum() or 1) * v
    for axis, at, s in ((1, y, s_rt), (0, x, s_mz)):
        out = np.zeros_like(g)
        for c in range(len(at)):
            o = np.arange(max(0, c - 5), min(len(at) - 1, c + 5) + 1)
            w = np.exp(-0.5 * ((at[o] - at[c]) / s) ** 2)
            part = (np.take(g, o, axis) * (w if axis else w[:, None])).sum(axis) / w.sum()
            out[(slice(None), c) if axis else c] = part
        g = out
    return g


def test_resample_and_maxima_against_dense_grid(spark):
    run, how = Run("quad", resolution_ms1=200, reference_mz=200, fwhm_rt=10), Resampling()
    pts = [(float(RNG.uniform(0, 60)), float(RNG.uniform(400, 406)), float(RNG.uniform(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(0, *p) for p in pts], "file_id int, rt double, mz double, intensity double")
    b = grid.bounds_of(df)
    g = _dense(pts, b.collect()[0].asDict(), run, how)
    cells = grid.resample(df, b, run, how)
    got = np.zeros_like(g)
    for r in cells.collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, g, atol=1e-9)
    want = {(i, j) for i in range(1, g.shape[0] - 1) for j in range(1, g.shape[1] - 1) if g[i, j] > max(g[i - 1, j], g[i + 1, j], g[i, j - 1], g[i, j + 1])}
    dims = grid.shape(b, run, how).select("file_id", "n", "m")
    assert {(r.i, r.j) for r in grid.local_maxima(cells, dims).collect()} == want
    assert np.isclose(grid.splat(df, b, run, how).agg(F.sum("value")).first()[0], sum(p[2] for p in pts))
    assert grid.subset(cells, 0, 2, 0, 2).count() <= 4


def _peaks(spark, rows):
    df = spark.createDataFrame(rows, "file_id int, peak_id long, fitted_mz double, fitted_rt double, fitted_height double, fitted_sigma_mz double, fitted_sigma_rt double")
    return df.withColumn("rt_delta", F.lit(0.0)).withColumn("fitted_volume", F.col("fitted_height") * 2.0)


def _random_peaks(n, files=3, span=40.0):
    out = []
    for f in range(files):
        h = np.sort(RNG.uniform(1, 100, n))[::-1]
        out += [(f, k, float(RNG.uniform(400, 400 + span)), float(RNG.uniform(0, 300)), float(h[k]), 0.3, 4.0) for k in range(n)]
    return out




def test_connected_components(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 300, (200, 2))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_clusters_against_sequential(spark):
    rows = _random_peaks(120)
    items = match.peak_items(_peaks(spark, rows), spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "file_id int, group_id int"))
    got = {(r.cluster_id, r.file_id, r.uid) for r in match.clusters(items, {0: 2, 1: 1}, 0.7).collect()}
    x = items.toPandas()
    near = {u: [v.uid for v in x.itertuples() if abs(v.mz - m) <= 0.45 and abs(v.rt - r) <= 6] for u, m, r in zip(x.uid, x.mz, x.rt, strict=True)}
    seq = match.greedy_clusters(x, near, {0: 2, 1: 1}, 0.7, 0.5)
    seeds = list(dict.fromkeys(s for s, _ in seq))
    file_of = dict(zip(x.uid, x.file_id, strict=True))
    assert got == {(seeds.index(s), file_of[u], u) for s, u in seq}


def test_detect_features(spark):
    z, base = 2, 500.0
    pattern = features.nearest_pattern(base * z - z * features.PROTON, features.averagine_table())
    rows = [(0, k, base + k * features.ISOTOPE_STEP / z, 100.0 + 0.1 * k, pattern[k] * 10, 0.01, 5.0) for k in range(4)]
    rows += [(0, 10, 700.0, 100.0, 5.0, 0.01, 5.0), (1, 0, base, 10.0, 50.0, 0.01, 5.0)]
    got = features.detect(_peaks(spark, rows), [5, 4, 3, 2, 1]).collect()
    assert len(got) == 1 and got[0].charge_state == 2 and got[0].peak_ids == [0, 1, 2, 3] and np.isclose(got[0].monoisotopic_mz, base)
    assert got[0].score > 0.5 and got[0].feature_id == 0


def test_razor_and_groups(spark):
    e = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "3"), ("B", "3"), ("B", "4"), ("C", "4"), ("D", "9")], "protein string, psm string")
    assert {(r.protein, r.psm) for r in proteins.razor(e).collect()} == {("A", "1"), ("A", "2"), ("A", "3"), ("B", "4"), ("D", "9")}
    n = e.withColumnRenamed("psm", "peptide")
    assert {r.protein for r in proteins.without_subsets(n).select("protein").distinct().collect()} == {"A", "B", "D"}
    kinds = {(r.protein, r.peptide): r.kind for r in proteins.peptide_classes(n).collect()}
    assert kinds["A", "1"] == "unique" and kinds["A", "3"] == "razor" and kinds["B", "3"] == "shared" and kinds["C", "4"] == "shared"
    with pytest.raises(ValueError):
        proteins.chosen_peptides(proteins.peptide_classes(n), n.select("protein", F.col("protein").alias("leader")), "best")


def test_razor_against_repeated_stable_sorts(spark):
    pairs = sorted({(f"P{a:02d}", int(b)) for a, b in RNG.integers(0, 40, (300, 2))})
    left: dict = {}
    for p, m in pairs:
        left.setdefault(p, set()).add(m)
    queue, want = sorted(sorted(left), key=lambda p: -len(left[p])), set()
    while queue:
        p, *queue = queue
        taken = set(left[p])
        want |= {(p, m) for m in taken}
        for q in queue:
            left[q] -= taken
        queue = sorted((q for q in queue if left[q]), key=lambda q: -len(left[q]))
    assert {(r.protein, r.psm) for r in proteins.razor(spark.createDataFrame(pairs, "protein string, psm long")).collect()} == want


def test_subsets_against_all_pairs(spark):
    pairs = sorted({(int(a), int(b)) for a, b in RNG.integers(0, 25, (90, 2))} | {(99, 3), (98, 3), (98, 4), (97, 3), (97, 4)})
    of: dict = {}
    for p, m in pairs:
        of.setdefault(p, set()).add(m)
    want = {p for p in of if not any(of[p] < of[q] for q in of)}
    assert {r.protein for r in proteins.without_subsets(spark.createDataFrame(pairs, "protein long, peptide long")).collect()} == want


def test_group_order_and_metadata(spark):
    # B has a unique peptide; A and C share one, so they are a component, which comes after B and gets the shared cluster.
    notes = [(0, "b1", "B"), (1, "ac", "A"), (1, "ac", "C"), (0, "ac", "A"), (0, "ac", "C"), (2, "b2", "B")]
    a = spark.createDataFrame([(c, p, q, f"about {q}") for c, p, q in notes], "cluster_id long, peptide string, protein string, description string")
    data = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "cluster_id long, height double")
    sums, about = proteins.quantify(data, a, ["height"], add_ambiguous=True)
    assert {(r.group_id, r.leader, r.height) for r in sums.collect()} == {(0, "B", 4.0), (1, "A", 3.0)}
    assert {(r.group_id, r.sequences, r.proteins, r.descriptions) for r in about.collect()} == {(0, "b1.|.b2", "B", "about B"), (1, "ac", "A.|.C", "about A.|.about C")}
    sums, about = proteins.quantify(data, a, ["height"])  # the tied peptide counts for nobody
    assert [(r.leader, r.height) for r in sums.collect()] == [("B", 5.0)] and [r.proteins for r in about.collect()] == ["B"]


def test_fill_gaps(spark):
    mz = [400.0, 400.003, 400.008, 400.02]
    got = sorted((r.mz, r.intensity) for r in summary.fill_gaps(spark.createDataFrame([(0, 1.0, m, 5.0) for m in mz], "file_id int, rt double, mz double, intensity double")).collect())
    assert np.allclose([m for m, v in got if v == 0], [400.0055, 400.0115, 400.0165])


def _nearest_brute(events, rows, n=3.0, idents=False):
    out = {}
    run = Run("orbitrap", resolution_ms1=2000, fwhm_rt=20)
    for f, key, mz, rt in events:
        s = 0.1 * (mz / 200) ** 1.5 / exprs.SIGMA
        near = [r for r in rows if r[0] == f and abs(r[2] - mz) <= n * s]
        if idents:
            near = [(math.hypot((mz - r[2]) / r[2], (rt - r[3]) / r[3]), r[2], r[1], abs(mz - r[2]) <= n * s and abs(rt - r[3]) <= n * run.fwhm_rt / exprs.SIGMA) for r in near if r[3]]
        else:
            near = [(math.hypot((mz - r[2]) / r[5], (rt - r[3]) / r[6]), r[2], r[1], abs(mz - r[2]) <= n * r[5] and abs(rt - r[3]) <= n * r[6]) for r in near]
        if near and min(near)[3]:
            out[f, key] = min(near)[2]
    return out


def test_links_against_unbounded_search(spark):
    run = Run("orbitrap", resolution_ms1=2000, fwhm_rt=20)
    rows = _random_peaks(150)
    events = [(int(RNG.integers(0, 3)), k, float(RNG.uniform(400, 440)), float(RNG.choice([0.0, RNG.uniform(0, 30), RNG.uniform(0, 300)]))) for k in range(300)]
    e = spark.createDataFrame(events, "file_id int, event_id long, mz double, rt double")
    got = {(r.file_id, r.event_id): r.peak_id for r in link.link_peaks(_peaks(spark, rows), e, run).collect()}
    assert got == _nearest_brute(events, rows) and len(got) > 10
    scans = [(r[0], r[1], r[2], r[3] if r[1] % 9 else 0.0) for r in rows]
    s = spark.createDataFrame(scans, "file_id int, event_id long, mz double, rt double")
    got = {(r.file_id, r.psm_index): r.event_id for r in link.link_idents(e.withColumnRenamed("event_id", "psm_index"), s, run).collect()}
    assert got == _nearest_brute(events, scans, idents=True) and len(got) > 10


def test_warp_moves_peaks_back(spark):
    ref = [(0, k, 400.0 + 2 * k, 20.0 + 15 * k, 100.0 - k, 0.3, 3.0) for k in range(20)]
    moved = [(1, k, m, r + 6.0, h, a, b) for _, k, m, r, h, a, b in ref]
    p = _peaks(spark, ref + moved)
    maps = warp.time_map(p, 0, Warping(slack=5, window=20, num_points=200, expand=0.2, peaks_per_window=50))
    out = warp.warp_peaks(p.where("file_id = 1"), maps).toPandas()
    before = similarity.similarity(p).where("file_a = 0 and file_b = 1").first().geometric_ratio
    after = similarity.similarity(p.where("file_id = 0").unionByName(warp.warp_peaks(p.where("file_id = 1"), maps))).where("file_a = 0 and file_b = 1").first().geometric_ratio
    assert after > before and out.rt_delta.median() < -2
    assert maps.where("file_id = 0").where("abs(rt_start - sample_rt_start) > 1e-9").count() == 0


def test_best_path_prefers_strictly_better():
    e = pd.DataFrame([(0, 0, 9, 1.0), (0, 0, 10, 1.0), (0, 0, 11, 2.0), (1, 9, 20, 5.0), (1, 10, 20, 0.0), (1, 11, 20, 1.0)], columns=["level", "src_start", "src_end", "similarity"])
    assert warp.best_path(e, 2) == [0, 9, 20]


def test_match_within_sigma_is_greedy(spark):
    a = spark.createDataFrame([(0, 0, 500.0, 10.0, 1.0, 5.0, 8.0), (0, 1, 500.4, 10.0, 1.0, 5.0, 4.0)], "file_id int, peak_id long, mz double, rt double, s_mz double, s_rt double, height double")
    b = spark.createDataFrame([(0, 5, 500.3, 10.0, 1.0, 5.0, 4.0)], a.schema)
    got = match.match_within_sigma(a, b).collect()
    assert [(r.peak_a, r.peak_b, r.log2_ratio) for r in got] == [(0, 5, 1.0)]


def test_quant_choices(spark):
    m = spark.createDataFrame([(0, 0, 1.0)], "cluster_id long, file int, height double")
    with pytest.raises(ValueError):
        quant.wide_matrix(m, "colour", [0], ("height",))
    a = spark.createDataFrame([(0, None), (0, "b"), (0, "a"), (1, None)], "cluster_id int, sequence string")
    assert {r.cluster_id: r.sequence for r in quant.aggregate_annotations(a).collect()} == {0: "a.|.b", 1: ""}
    mods = spark.sql("select array(named_struct('id', array('U:35|Ox', 'X'), 'monoisotopic_mass_delta', 15.99491D, 'average_mass_delta', 16D, 'residues', 'M', 'location', 3), named_struct('id', array('a'), 'monoisotopic_mass_delta', 1D, 'average_mass_delta', null, 'residues', null, 'location', -1)) as modifications")
    one, two = mods.select(quant.modification_text().alias("t")).first().t.split(" / ")
    assert one == "monoisotopic_mass_delta: 15.99491, average_mass_delta: 16.0, residues: M, location: 3, id: U:35|Ox; X"
    assert two == "monoisotopic_mass_delta: 1.0, average_mass_delta: 0.0, residues: , location: -1, id: a"


def test_duration(spark):
    got = spark.createDataFrame([("PT1H2M3.5S",), ("PT90S",), ("PT2M",)], "t string").select(exprs.duration_seconds("t").alias("s")).collect()
    assert [r.s for r in got] == [3723.5, 90.0, 120.0]


def test_files_need_groups(spark):
    p, groups = _peaks(spark, _random_peaks(3)), spark.createDataFrame([(0, 0), (1, 0)], "file_id int, group_id int")
    assert match.require_groups(p.where("file_id < 2"), groups).count() == 6
    with pytest.raises(ValueError, match="without a group"):
        match.require_groups(p, groups)


def test_isotopes_wider_than_their_step(spark):
    # Sigmas wider than the step make peaks their own neighbours; the walk ends all the same.
    rows = [(0, k, 500.0 + k * 0.3, 100.0, 50.0 - k, 1.0, 5.0) for k in range(8)]
    got = features.detect(_peaks(spark, rows), [5, 3, 1]).collect()
    assert all(len(r.peak_ids) == len(set(r.peak_ids)) for r in got)


def test_csv_round_trip(spark, tmp_path):
    from mzloom.sources import sinks

    df = spark.createDataFrame([(1, 2.5, "a,b", [1, 2]), (2, None, None, [])], "cluster_id int, height double, sequence string, peak_ids array<int>")
    sinks.write_csv(df, str(tmp_path / "t"))
    got = sorted(tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "t"), "cluster_id int, height double, sequence string, peak_ids string").collect())
    assert got == [(1, 2.5, "a,b", "1 2"), (2, None, None, None)]
    assert dict(sinks.read_csv(spark, str(tmp_path / "t")).dtypes)["height"] == "double"


def test_dense_rank(spark):
    df = spark.range(1000).withColumn("v", F.hash("id"))
    got = match.dense_rank(df, "v", "id").collect()
    want = {r.id: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)))}
    assert {r.id: r["rank"] for r in got} == want


def test_empty_tables(spark):
    p = _peaks(spark, [])
    assert similarity.similarity(p).count() == 0 and features.detect(p, [1, 2]).count() == 0
    assert summary.isotope_counts(features.detect(p, [1])).count() == 0


def test_peaks_are_numbered_in_parts_of_a_run(spark):
    from mzloom.adapters import view

    k = view(spark, "/root/testdata/sf0.001", "peaks")
    assert "windowspecdefinition(file_id" in (plan := k._jdf.queryExecution().optimizedPlan().toString())
    assert not re.search(r"row_number\(\) windowspecdefinition\(file_id#\d+, fitted_height#\d+ DESC", plan), "a run is one window"
    ids = k.groupBy("file_id").agg(F.count("*").alias("n"), F.countDistinct("peak_id").alias("d"), F.max("peak_id").alias("m")).collect()
    assert ids and all(r.n == r.d == r.m + 1 for r in ids)


@pytest.mark.parametrize("method", ["sum", "max"])
def test_chromatograms_pair_scans_with_regions(spark, monkeypatch, method):
    r = np.random.default_rng(8)
    rows = [(0, float(r.integers(0, 5)), float(r.integers(400, 420)), float(r.integers(-3, 9))) for _ in range(400)] + [(0, 9.0, 405.0, None), (0, 3.0, 500.0, 7.0)]
    rois = [(0, k, float(m := r.uniform(400, 420)), m + 3.0, float(t := r.uniform(0, 8)), t + 2.0) for k in range(30)]
    seen, joined = [], points.binned
    monkeypatch.setattr(points, "binned", lambda p, *a, **k: seen.append(p.count()) or joined(p, *a, **k))
    p = spark.createDataFrame(rows, "file_id int, rt double, mz double, intensity double")
    k = spark.createDataFrame(rois, "file_id int, peak_id long, roi_min_mz double, roi_max_mz double, roi_min_rt double, roi_max_rt double")
    got = {(x.peak_id, x.rt): x.intensity for x in points.peak_xic(p, k, 2.0, method).collect()}
    want = {}
    for _, peak, m0, m1, t0, t1 in rois:
        for t in {x[1] for x in rows if t0 <= x[1] <= t1}:
            each = [x[3] if m0 <= x[2] <= m1 else 0.0 for x in rows if x[1] == t]
            each = [x for x in each if x is not None]
            want[peak, t] = (sum(each) if each else None) if method == "sum" else max([0.0, *each])
    assert got == want and seen == [6]


def test_closest_peaks_pairs_grow_with_targets(spark, monkeypatch):
    r = np.random.default_rng(5)
    ks = [(0, k, float(r.uniform(400, 410)), float(r.uniform(0, 200)), 0.5, 0.1, float(r.uniform(2, 9))) for k in range(2000)]
    ks += [(*x[:1], x[1] + 5000, *x[2:]) for x in ks[:50]]  # equal peaks: the first one wins
    ts = [(0, k, float(r.uniform(399, 411)), float(r.uniform(-20, 220)), 0.5, 10.0) for k in range(150)] + [(0, 900, 430.0, 50.0, 0.5, 10.0), (1, 901, 405.0, 50.0, 0.5, 10.0)]
    pairs, joined = [], summary.touching
    monkeypatch.setattr(summary, "touching", lambda *a: pairs.append((j := joined(*a)).count()) or j)
    t = spark.createDataFrame(ts, "file_id int, target_id long, t_mz double, t_rt double, t_sigma_mz double, t_sigma_rt double")
    k = spark.createDataFrame(ks, "file_id int, peak_id long, fitted_mz double, fitted_rt double, rt_delta double, fitted_sigma_mz double, fitted_sigma_rt double")
    got = {x.target_id: (x.peak_id, round(x.distance, 9)) for x in summary.closest_peak(t, k).collect()}
    want = {}
    for f, i, mz, rt, sm, sr in ts:
        each = [(math.hypot((rt - x[3] - x[4]) / (sr + x[6]), (mz - x[2]) / (sm + x[5])), x[1], abs(mz - x[2]) <= 3 * sm and abs(rt - x[3] - x[4]) <= 3 * sr) for x in ks if x[0] == f]
        if each and min(each)[2]:
            want[i] = (min(each)[1], round(min(each)[0], 9))
    assert got == want and len(got) > 140 and pairs[0] < 50 * len(ts)


def test_top_peaks_are_cut_in_parts_of_a_run(spark):
    k = spark.range(5000).select((F.col("id") % 2).cast("int").alias("file_id"), F.col("id").alias("peak_id"), (F.col("id") * 7919 % 900).cast("double").alias("fitted_height"))
    top = similarity.top_peaks(k, 1200)
    want = {f: sorted(((-(i * 7919 % 900), i) for i in range(5000) if i % 2 == f))[:1200] for f in (0, 1)}
    rows = top.collect()
    assert len(rows) == 2400 and {f: sorted((-int(r.fitted_height), r.peak_id) for r in rows if r.file_id == f) for f in (0, 1)} == want
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"^[ +:-]*Window \[row_number", plan, re.M)) == 2


def test_razor_state_is_a_few_numbers_an_edge():
    import tracemalloc

    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 1000 * 20000, 300_000))
    protein, psm = (at // 20000).astype(np.int32), (at % 20000).astype(np.int32)
    tracemalloc.start()
    kept = proteins._owned(protein, psm, np.arange(1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(psm[kept]) == sorted(set(psm)) and peak < 100 * len(at)


def test_razor_searches_components_of_proteins(spark, monkeypatch):
    """The component search gets pairs of proteins, not edges to psms as text; edges without a psm stay with a protein that has others."""
    asked = []
    real = proteins.connected_components

    def components(edges):
        asked.append((edges.count(), [kind for _, kind in edges.dtypes]))
        return real(edges)

    monkeypatch.setattr(proteins, "connected_components", components)
    rows = [(20 * b + p, 1000 * b + (p * 7 + k * k) % 60) for b in range(3) for p in range(20) for k in range(12)] + [(500, 9000), (501, 9001), (501, None), (502, None)]
    e = spark.createDataFrame(rows, "protein long, psm long").distinct()
    got = sorted(((r.protein, r.psm) for r in proteins.razor(e).collect()), key=str)
    held = {}
    for p, m in sorted({r for r in rows if r[0] != 502}, key=str):
        held.setdefault(p, set()).add(m)
    want, order = [], sorted(held)
    while order:
        order.sort(key=lambda p: -len(held[p]))
        p = order.pop(0)
        want += [(p, m) for m in held[p]]
        for q in order:
            held[q] -= held[p]
        order = [q for q in order if held[q]]
    assert got == sorted(want, key=str) and asked[0][0] < 0.75 * len(set(rows)) and asked[0][1] == ["bigint", "bigint"]
