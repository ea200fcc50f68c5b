"""The whole acquisition pipeline: spectra and identifications in, quantitative tables out.

Every stage is a lazy frame over all runs, keyed by file_id, and is written as a Parquet table that a later call
reuses if what it was made from is unchanged, unless ``force`` is set. Result tables name runs by the stems of their files.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzloom.functions.exprs import sigma_mz, sigma_rt
from mzloom.operators import features, grid, link, match, peaks, points, proteins, quant, similarity, summary, warp
from mzloom.params import Parameters
from mzloom.sources import identifications, sinks, spectra


@dataclass(frozen=True)
class RunFile:
    path: str
    format: str = "mzml"
    identifications: str | None = None
    group: str = "all"
    reference: bool = False

    @property
    def stem(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _scans(spark: SparkSession, params: Parameters, files: list[RunFile], level: int) -> DataFrame:
    out = None
    for kind, read in (("mzxml", spectra.read_mzxml), ("mzml", spectra.read_mzml)):
        paths = [f.path for f in files if f.format == kind]
        if paths:
            s = read(spark, paths, params.min_mz, params.max_mz, params.min_rt, params.max_rt, params.polarity, level)
            out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no input files of a known format")
    return spectra.numbered(out, {f.path: k for k, f in enumerate(files)})


def stems_of(files: list[RunFile]) -> list[str]:
    """Names of the runs; files of one name in several folders are told apart by their place in the list."""
    stems = [f.stem for f in files]
    return [s if stems.count(s) == 1 else f"{s}~{k}" for k, s in enumerate(stems)]


def _identifications(spark: SparkSession, files: list[RunFile], params: Parameters) -> tuple[DataFrame, DataFrame] | None:
    """(psms, protein annotations) of all runs, read at once; annotations have psm_index, peptide_id, accession, description, decoy."""
    given = {f.identifications: k for k, f in enumerate(files) if f.identifications}
    if not given:
        return None
    d = identifications.read_mzidentml(spark, sorted(given), params.ignore_decoy, params.require_threshold, params.max_rank_only)
    matches = d.spectrum_matches.join(d.peptides, ["path", "peptide_id"]).withColumn("psm_index", F.xxhash64("match_id", "peptide_id"))
    psms = spectra.numbered(matches, given)
    evidence = d.peptide_evidence.select("path", "peptide_id", "db_sequence_id", "decoy").join(d.db_sequences, ["path", "db_sequence_id"])
    # Inner: identifications without protein evidence have no annotation.
    notes = psms.select("path", "file_id", "psm_index", "peptide_id").join(evidence, ["path", "peptide_id"])
    return psms.drop("path"), notes.drop("path")


def _cluster_tables(named: DataFrame, params: Parameters) -> tuple[DataFrame, DataFrame]:
    """(annotations with their consensus, the same joined per cluster) of (cluster_id, file_id, ..., psm_sequence, protein_name, protein_description)."""
    if params.consensus:
        best = quant.sequence_consensus(named, "psm_sequence", params.consensus_min).select("cluster_id", F.col("psm_sequence").alias("consensus_sequence"), F.col("count").alias("consensus_count"))
        named = named.join(best, "cluster_id", "left")
        told = named.where("psm_sequence = consensus_sequence").select("cluster_id", F.col("protein_name").alias("consensus_protein_name"), F.col("protein_description").alias("consensus_protein_description")).distinct()
        named = named.join(told, "cluster_id", "left")
    return named, quant.aggregate_annotations(named, columns=ANNOTATED)


#: Columns that are joined per cluster.
ANNOTATED = [
    "psm_sequence", "psm_charge_state", "psm_modifications_num", "protein_name", "protein_description", "consensus_sequence", "consensus_count", "consensus_protein_name",
    "consensus_protein_description",
]


def qc_tables(params: Parameters, ms1: DataFrame, peaks_: DataFrame, maps: DataFrame, similarity_before: DataFrame, similarity_after: DataFrame) -> dict[str, DataFrame]:
    """Values behind the quality plots: width densities, drift, chromatograms before and after alignment, similarities."""
    tic, bpc = points.xic(ms1), points.xic(ms1, method="max")
    aligned = lambda x: warp.warp_times(x, maps)
    widths = peaks_.select("file_id", (F.col("fitted_sigma_mz") / sigma_mz("fitted_mz", params.run)).alias("mz"), (F.col("fitted_sigma_rt") / sigma_rt(params.run)).alias("rt"))
    return {
        "qc_tic": aligned(tic), "qc_base_peak": aligned(bpc), "qc_scatter": summary.scatter(peaks_, params.scatter_peaks),
        "qc_sigma_mz_density": summary.histogram(widths, "mz", 0.05), "qc_sigma_rt_density": summary.histogram(widths, "rt", 0.05),
        "qc_similarity_before": similarity_before, "qc_similarity_after": similarity_after,
    }


def dda_pipeline(spark: SparkSession, params: Parameters, files: list[RunFile], out: str, force: bool = False, save_grid: bool = False) -> dict[str, DataFrame]:
    """Run all stages; returns every table by name.

    Stage tables lie in ``out``, result tables are written as CSV to out/quant, out/qc and out/summary, parameters, a
    log of all calls' stages and the summary as text. Beyond ``quant.PIVOT`` runs matrices are frames of blocks (block, values); their CSV is the same. ``save_grid`` keeps the smoothed grid as well. Stages whose
    parameters, input files or earlier stages have changed are made anew.
    """
    if params.identification_by not in ("theoretical_mz", "msms_event"):
        raise ValueError(f"unknown identification_by: {params.identification_by}")
    if params.quant_isotopes not in ("height", "volume"):
        raise ValueError(f"unknown quant_isotopes: {params.quant_isotopes}")
    if params.quant_features not in quant.MEASURES:
        raise ValueError(f"unknown quant_features: {params.quant_features}")
    run = params.run
    t: dict[str, DataFrame] = {}
    log: list[str] = []
    sinks.write_text(spark, sinks.parameters_json(params), f"{out}/parameters.json")
    stages = sinks.Stages(spark, out, force)

    def stage(name, make, *parents, uses=None, by_file=True):
        began = time.time()
        t[name] = stages.table(name, make, uses, parents, by_file)
        log.append(f"{time.strftime('%Y-%m-%d %H:%M:%S')} {name}: {time.time() - began:.1f} s" + ", kept" * (name not in stages.made))
        return t[name]

    inputs = [[f.format, *sinks.fingerprint(spark, f.path)] for f in files]
    cut = [params.polarity, params.min_mz, params.max_mz, params.min_rt, params.max_rt]
    mesh = [run, params.resampling]
    ms1 = stage("ms1", lambda: spectra.to_points(_scans(spark, params, files, 1)), uses=[inputs, cut])
    # All levels are read, for an event may leave it to its place which scan it was chosen from.
    ms2 = stage("ms2", lambda: spectra.events(spectra.with_parents(_scans(spark, params, files, 0).drop("points"))), uses=[inputs, cut])
    bounds = stage("bounds", lambda: grid.bounds_of(ms1), "ms1", by_file=False)
    if save_grid:
        stage("grid", lambda: grid.resample(ms1, bounds, run, params.resampling), "ms1", "bounds", uses=mesh)

    def detected():
        maxima = grid.maxima_of(ms1, bounds, run, params.resampling)
        return peaks.find_peaks(ms1, grid.locate(maxima, bounds, run, params.resampling), run, params.max_peaks, bin_mz=0.5).drop("fit")

    found = stage("peaks", detected, "ms1", "bounds", uses=[mesh, params.max_peaks])
    before = stage("similarity_before", lambda: similarity.similarity(found, params.similarity_peaks, 1.0), "peaks", uses=params.similarity_peaks, by_file=False)
    flagged = [k for k, f in enumerate(files) if f.reference]
    # One row, the chosen run: the aligned runs need it as a plan parameter.
    reference = flagged[0] if len(flagged) == 1 else similarity.reference_run(before, flagged or None).first().file_id
    maps = stage("time_maps", lambda: warp.time_map(found, reference, params.warping), "peaks", uses=[reference, params.warping])
    own = found.where(F.col("file_id") == reference)
    aligned = stage("aligned_peaks", lambda: warp.warp_peaks(found.where(F.col("file_id") != reference), maps).unionByName(own), "peaks", "time_maps", uses=reference)
    after = stage("similarity_after", lambda: similarity.similarity(aligned, params.similarity_peaks, 1.0), "aligned_peaks", uses=params.similarity_peaks, by_file=False)
    time_bin = 4 * sigma_rt(run)
    feats = stage("features", lambda: features.detect(aligned, list(params.charge_states), time_bin), "aligned_peaks", uses=[params.charge_states, time_bin])
    near = [run, params.link_n_sig_mz, params.link_n_sig_rt]
    peak_events = stage("peak_events", lambda: link.link_peaks(aligned, ms2, *near), "aligned_peaks", "ms2", uses=near)
    named_groups = [(k, f.group) for k, f in enumerate(files)]
    groups = match.group_numbers(spark.createDataFrame(named_groups, "file_id int, group string"))
    sizes: dict[int, int] = {}
    for r in groups.collect():  # one row per run
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
    least, sig_mz, sig_rt = (1.5, params.match_n_sig_rt, 1.5) if params.match_compat else (params.match_intensity, params.match_n_sig_mz, params.match_n_sig_rt)
    args = (sizes, params.match_fraction, least, sig_mz, sig_rt)
    clustered = lambda items: match.clusters(match.require_groups(items, groups), *args, width=0.5, width_rt=time_bin)
    pc = stage("peak_clusters", lambda: clustered(match.peak_items(aligned, groups)), "aligned_peaks", uses=[named_groups, args, time_bin], by_file=False)
    fc = stage("feature_clusters", lambda: clustered(match.feature_items(feats, groups)), "features", uses=[named_groups, args, time_bin], by_file=False)

    part = F.lit(1 << 40)
    stems = stems_of(files)
    runs = F.broadcast(spark.createDataFrame(list(enumerate(stems)), "file_id int, stem string"))  # one row per run
    in_words = lambda df, c="file_id": df.join(runs.withColumnRenamed("file_id", c), c).withColumn(c, F.col("stem")).drop("stem").select(*df.columns)
    wide = len(files) > quant.PIVOT
    places = runs.select(F.col("file_id").alias("file"), F.col("file_id").alias("place"))
    matrix = lambda m, *how: quant.block_matrix(m, how[0], places, *how[1:]) if wide else quant.wide_matrix(in_words(m, "file"), how[0], stems, *how[1:])
    t["peak_table"] = quant.peak_table(aligned)
    t["feature_table"] = feats.drop("peak_ids")
    t["feature_peaks"] = quant.feature_peaks(feats)
    t["peak_clusters_peaks"] = pc.select("cluster_id", "file_id", (F.col("uid") % part).alias("peak_id"))
    t["feature_clusters_features"] = fc.select("cluster_id", "file_id", (F.col("uid") % part).alias("feature_id"))
    members = t["peak_clusters_peaks"].join(t["peak_table"], ["file_id", "peak_id"]).withColumnRenamed("file_id", "file")
    t["peak_clusters_metadata"] = quant.cluster_metadata(members)
    t[f"peak_clusters_{params.quant_isotopes}"] = matrix(members, params.quant_isotopes)
    fmembers = t["feature_clusters_features"].join(feats, ["file_id", "feature_id"]).withColumnRenamed("file_id", "file")
    fmembers = fmembers.withColumn("rt", F.col("average_rt") + F.col("average_rt_delta"))
    t["feature_clusters_metadata"] = fmembers.groupBy("cluster_id").agg(F.avg("monoisotopic_mz").alias("mz"), F.avg("rt").alias("rt"), F.avg("total_height").alias("avg_height"), F.min("charge_state").alias("charge_state"))
    t["feature_clusters_measure"] = matrix(fmembers, params.quant_features, quant.MEASURES)
    for name in ("metadata", "measure"):
        t[f"feature_clusters_{name}"] = stage(f"feature_clusters_{name}", lambda name=name: t[f"feature_clusters_{name}"], "feature_clusters", "features", uses=[stems, params.quant_features], by_file=False)

    got = _identifications(spark, files, params)
    links = None
    if got:
        read = [[sinks.fingerprint(spark, f.identifications) if f.identifications else None for f in files], params.ignore_decoy, params.require_threshold, params.max_rank_only]
        psms = stage("psms", lambda: got[0].withColumnRenamed("experimental_mz", "mz"), uses=read)
        notes = stage("protein_notes", lambda: got[1], uses=read)
        ident_events = stage("ident_events", lambda: link.link_idents(psms, ms2, *near), "psms", "ms2", uses=near)
        ident_peaks = stage("ident_peaks", lambda: link.link_psm(aligned, psms, *near), "psms", "aligned_peaks", uses=near)
        links = ident_events if params.identification_by == "msms_event" else ident_peaks
        about = psms.select(
            "file_id", "psm_index", "peptide_id", F.col("charge_state").alias("psm_charge_state"), F.col("rank").alias("psm_rank"), F.col("theoretical_mz").alias("psm_theoretical_mz"),
            F.col("sequence").alias("psm_sequence"), F.size("modifications").alias("psm_modifications_num"), quant.modification_text().alias("psm_modifications_info"),
        )
        told_peaks = quant.annotate_peaks(aligned.select("file_id", "peak_id"), peak_events, about, links, params.identification_by)
        proof = notes.select("file_id", "psm_index", "peptide_id", F.col("accession").alias("protein_name"), F.col("description").alias("protein_description"), F.col("decoy").alias("psm_decoy"))
        links_from = "ident_events" if params.identification_by == "msms_event" else "ident_peaks"
        made_from = ("aligned_peaks", "peak_events", "psms", "protein_notes", links_from)
        t["peak_annotations"] = stage("peak_annotations", lambda: told_peaks.join(proof.drop("psm_index").distinct(), ["file_id", "peptide_id"]), *made_from, uses=params.identification_by)
        t["feature_annotations"] = quant.feature_peaks(feats).join(t["peak_annotations"], ["file_id", "peak_id"], "left")
        pn, joined = _cluster_tables(t["peak_clusters_peaks"].join(t["peak_annotations"], ["file_id", "peak_id"], "left"), params)
        t["peak_clusters_annotations"] = pn
        t["peak_clusters_metadata"] = t["peak_clusters_metadata"].join(joined, "cluster_id", "left")
        fn, _ = _cluster_tables(t["feature_clusters_features"].join(t["feature_annotations"], ["file_id", "feature_id"], "left"), params)
        fn = t["feature_clusters_annotations"] = stage("feature_clusters_annotations", lambda: fn, "feature_clusters", "features", "peak_annotations", uses=[params.consensus, params.consensus_min], by_file=False)
        sequence, name, text = ("consensus_sequence", "consensus_protein_name", "consensus_protein_description") if params.consensus else ("psm_sequence", "protein_name", "protein_description")
        evidence = fn.select("cluster_id", F.col(sequence).alias("peptide"), F.col(name).alias("protein"), F.col(text).alias("description"))
        values = None if wide else stems
        t["protein_groups"], t["protein_groups_metadata"] = proteins.quantify(
            t["feature_clusters_measure"], evidence, values, params.protein_min_peptides, params.protein_remove_subsets, params.protein_ignore_ambiguous, params.protein_quant
        )
        shown = fn.where("psm_charge_state = charge_state") if params.charge_state_filter else fn
        joined = quant.aggregate_annotations(shown, columns=ANNOTATED)
        t["feature_clusters_metadata"] = t["feature_clusters_metadata"].join(joined, "cluster_id", "left")
        t["peptides_data"] = quant.peptide_table(t["feature_clusters_measure"], joined.select("cluster_id", sequence), values, sequence).withColumnRenamed(sequence, "sequence")
        t["peptides_metadata"] = quant.peptide_metadata(shown.select(*[c for c in ANNOTATED if c in shown.columns and "count" not in c]), t["peptides_data"].select(F.col("sequence").alias(sequence)).distinct(), sequence)

    t["raw_summary"] = summary.raw_summary(ms1)
    t["event_summary"] = summary.event_summary(ms2)
    t["isotope_counts"] = summary.isotope_counts(feats)
    t["isotope_summary"] = summary.isotope_summary(feats)
    for value, told in summary.describe_all(aligned, [f"fitted_{v}" for v in ("height", "volume", "sigma_mz", "sigma_rt")]).items():
        t[f"peak_{value.removeprefix('fitted_')}_summary"] = told
    for value, told in summary.describe_all(feats, ["max_height", "monoisotopic_height", "total_height"]).items():
        t[f"feature_{value}_summary"] = told
    t["peak_summary"] = t["peak_height_summary"]
    t["peak_summary_over_files"] = summary.over_files(t["peak_summary"])
    t["linking"] = summary.linking_efficiency(peak_events, ms2)
    if got:
        t["identification_linking"] = summary.linking_efficiency(ident_peaks, psms)
        t["identification_event_linking"] = summary.linking_efficiency(ident_events, psms)
    qc = qc_tables(params, ms1, aligned, maps, before, after)
    t |= qc
    for name in RESULTS:
        if name in t and (params.save_annotations or not name.endswith("_annotations")):
            folder = "qc" if name in qc else "summary" if name in SUMMARIES else "quant"
            for c in ("file_id", "file_a", "file_b"):
                t[name] = in_words(t[name], c) if c in t[name].columns else t[name]
            if t[name].columns[-2:] == ["block", "values"]:
                keys = t[name].columns[:-2]
                sinks.write_wide_csv(quant.wide_lines(t[name], len(files), *keys), keys, stems, f"{out}/{folder}/{name}")
            else:
                sinks.write_csv(t[name], f"{out}/{folder}/{name}")
    sinks.write_text(spark, summary_text(t, stems), f"{out}/summary.log")
    sinks.write_text(spark, (sinks.read_text(spark, f"{out}/info.log") or "") + "\n".join(log) + "\n", f"{out}/info.log")
    return t


def summary_text(t: dict[str, DataFrame], stems: list[str]) -> str:
    """The summary tables as text: a heading a subject, a block a run. Every table has one row per run."""
    subjects = {
        "Raw data, MS1": "raw_summary", "Raw data, MS2": "event_summary", "Peaks, height": "peak_height_summary", "Peaks, volume": "peak_volume_summary", "Peaks, sigma m/z": "peak_sigma_mz_summary",
        "Peaks, sigma time": "peak_sigma_rt_summary", "Features, isotopes": "isotope_summary", "Features, max height": "feature_max_height_summary", "Features, monoisotopic height": "feature_monoisotopic_height_summary",
        "Features, total height": "feature_total_height_summary", "Linkage, events to peaks": "linking", "Linkage, identifications to events": "identification_event_linking", "Linkage, identifications to peaks": "identification_linking",
    }
    lines = []
    for subject, name in subjects.items():
        if name in t:
            lines.append(subject)
            rows = {r.file_id: r.asDict() for r in t[name].collect()}
            for stem in stems:
                lines.append(f"    {stem}")
                lines += [f"        {k}: {v}" for k, v in rows.get(stem, {}).items() if k != "file_id"]
            known = [r for r in rows.values() if r]
            if len(known) > 1 and "Linkage" not in subject and "Raw" not in subject:
                lines.append("    Overall average")
                lines += [f"        {k}: {sum(r[k] for r in known) / len(known)}" for k in known[0] if k != "file_id" and all(r[k] is not None for r in known)]
    return "\n".join(lines) + "\n"


SUMMARIES = ["raw_summary", "event_summary", "feature_max_height_summary", "feature_monoisotopic_height_summary", "feature_total_height_summary", "identification_event_linking", "isotope_counts", "isotope_summary", "peak_height_summary", "peak_volume_summary", "peak_sigma_mz_summary", "peak_sigma_rt_summary", "peak_summary_over_files", "linking", "identification_linking"]
#: Tables written as CSV.
RESULTS = [
    "peak_table", "peak_annotations", "feature_table", "feature_annotations", "peak_clusters_height", "peak_clusters_volume", "peak_clusters_metadata", "peak_clusters_peaks", "peak_clusters_annotations",
    "feature_clusters_measure", "feature_clusters_metadata", "feature_clusters_features", "feature_clusters_annotations", "protein_groups", "protein_groups_metadata", "peptides_data", "peptides_metadata",
    *SUMMARIES, "qc_tic", "qc_base_peak", "qc_scatter", "qc_sigma_mz_density", "qc_sigma_rt_density", "qc_similarity_before", "qc_similarity_after",
]
