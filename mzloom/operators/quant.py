"""Relational steps of quantification: tables, annotations, consensus, wide matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PEAK_COLUMNS = [
    "peak_id", "fitted_mz", "fitted_rt", "rt_delta", "fitted_height", "fitted_sigma_mz", "fitted_sigma_rt", "fitted_volume", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt",
    "raw_roi_mean_mz", "raw_roi_mean_rt", "raw_roi_sigma_mz", "raw_roi_sigma_rt", "raw_roi_skewness_mz", "raw_roi_skewness_rt", "raw_roi_kurtosis_mz", "raw_roi_kurtosis_rt",
    "raw_roi_total_intensity", "raw_roi_num_points", "raw_roi_num_scans",
]
#: Table names of the peak columns that are renamed.
PEAK_NAMES = {"fitted_mz": "mz", "fitted_rt": "rt", "fitted_height": "height", "fitted_volume": "volume", "fitted_sigma_mz": "sigma_mz", "fitted_sigma_rt": "sigma_rt"}


def peak_table(peaks: DataFrame) -> DataFrame:
    cols = [c for c in PEAK_COLUMNS if c in peaks.columns]
    return peaks.select("file_id", *[F.col(c).alias(PEAK_NAMES.get(c, c)) for c in cols], (F.col("fitted_rt") + F.col("rt_delta")).alias("aligned_rt"))


def joined_unique(c: str) -> Column:
    """Sorted distinct non-null values joined by ``.|.``, without leading or trailing marks."""
    text = F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ".|.")
    return F.regexp_replace(text, r"^[.|]+|[.|]+$", "")


def aggregate_annotations(annotations: DataFrame, key: str = "cluster_id", columns: list[str] | None = None) -> DataFrame:
    cols = [c for c in (columns or annotations.columns) if c in annotations.columns and c != key]
    return annotations.groupBy(key).agg(*[joined_unique(c).alias(c) for c in cols])


def annotate_peaks(peaks: DataFrame, peak_events: DataFrame, psms: DataFrame, links: DataFrame, by: str = "theoretical_mz") -> DataFrame:
    """Left join of events and identifications to peaks, through peaks or through events.

    ``links`` has file_id, psm_index and peak_id (theoretical_mz) or event_id (msms_event).
    """
    if by not in ("theoretical_mz", "msms_event"):
        raise ValueError(f"unknown ident_linkage: {by}")
    key = "peak_id" if by == "theoretical_mz" else "event_id"
    out = peaks.join(peak_events.select("file_id", "peak_id", "event_id"), ["file_id", "peak_id"], "left")
    told = links.select("file_id", "psm_index", key).join(psms, ["file_id", "psm_index"])
    return out.join(told, ["file_id", key], "left")


def modification_text(mods: str = "modifications") -> Column:
    """Modifications as text: mass deltas, residues, location and all ids, joined by `` / ``."""

    def one(m):
        shown = [("monoisotopic_mass_delta", m["monoisotopic_mass_delta"], "0.0"), ("average_mass_delta", m["average_mass_delta"], "0.0"), ("residues", m["residues"], ""), ("location", m["location"], "-1")]
        parts = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(none))) for name, value, none in shown]
        return F.concat_ws(", ", *parts, F.concat(F.lit("id: "), F.array_join(m["id"], "; ")))

    return F.array_join(F.transform(F.col(mods), one), " / ")


def with_proteins(annotations: DataFrame, evidence: DataFrame, sequences: DataFrame) -> DataFrame:
    """Inner joins to protein evidence: rows multiply per protein, and rows without a peptide go."""
    e = evidence.join(sequences, "db_sequence_id")
    return annotations.join(e, "peptide_id")


def feature_peaks(features: DataFrame) -> DataFrame:
    """One row per peak of every feature."""
    return features.select("file_id", "feature_id", "charge_state", F.explode("peak_ids").alias("peak_id"))


def annotate_features(features: DataFrame, peak_annotations: DataFrame, match_charge: bool = True) -> DataFrame:
    out = feature_peaks(features).join(peak_annotations, ["file_id", "peak_id"], "left")
    return out.where("psm_charge_state is null or psm_charge_state = charge_state") if match_charge else out


MEASURES = ("total_height", "total_volume", "max_height", "max_volume", "monoisotopic_height", "monoisotopic_volume")


def wide_matrix(members: DataFrame, value: str, files: list, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """cluster_id and a column per file (0 where the file has no member)."""
    if allowed and value not in allowed:
        raise ValueError(f"unknown quantity: {value}")
    m = members.groupBy("cluster_id").pivot("file", files).agg(F.first(value))
    return m.select("cluster_id", *[F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(str(f)) for f in files])


#: Files of one block of a wide matrix, and files beyond which matrices are kept in blocks: a column a file would break plans and generated code.
BLOCK, PIVOT = 256, 500


def block_matrix(members: DataFrame, value: str, places: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The wide matrix in blocks of files: (cluster_id, block, values), for any number of files; blocks without a member are absent.

    ``places`` numbers the files (file, place) from 0. Values of a block are an array, 0 where a file has no member; of several members
    of a file the least counts.
    """
    if allowed and value not in allowed:
        raise ValueError(f"unknown quantity: {value}")
    m = members.select("cluster_id", "file", F.col(value).cast("double").alias("_v")).join(F.broadcast(places), "file")  # one row per file
    one = m.groupBy("cluster_id", "place").agg(F.min("_v").alias("_v"))
    g = one.groupBy("cluster_id", F.floor(F.col("place") / BLOCK).cast("int").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") % BLOCK).cast("int"), "_v"))).alias("_m"))
    at = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    return g.select("cluster_id", "block", F.transform(at, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("values"))


def sum_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Sums of blocks per ``keys`` and block, place by place; partial sums are made in every task."""
    each = blocks.select(*keys, "block", F.posexplode("values").alias("place", "v")).where("v <> 0")
    total = each.groupBy(*keys, "block", "place").agg(F.sum("v").alias("v"))
    g = total.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("_m"))
    return g.select(*keys, "block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("values"))


def wide_lines(blocks: DataFrame, n_files: int, *keys: str) -> DataFrame:
    """(keys, line): the blocks of a row side by side as text, ``n_files`` values joined by commas, absent blocks as zeros."""
    last = -(-n_files // BLOCK) - 1
    held = F.map_from_entries(F.collect_list(F.struct("block", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("t"))))
    empty = F.lit(",".join(["0.0"] * BLOCK))
    size = n_files - last * BLOCK
    cut = lambda k, t: F.when(k == last, F.array_join(F.slice(F.split(t, ","), 1, size), ",")).otherwise(t)
    g = blocks.groupBy(*keys).agg(held.alias("_m"))
    return g.select(*keys, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: cut(k, F.coalesce(F.try_element_at("_m", k), empty))), ",").alias("line"))


def cluster_metadata(members: DataFrame) -> DataFrame:
    """Means and number of members of every cluster of peaks (cluster_id, mz, rt, height, volume)."""
    return members.groupBy("cluster_id").agg(F.avg("mz").alias("mz"), F.avg("rt").alias("rt"), F.avg("height").alias("avg_height"), F.avg("volume").alias("avg_volume"), F.count("*").alias("n_files"))


def sequence_consensus(annotations: DataFrame, column: str = "sequence", least: int = 1) -> DataFrame:
    """Per cluster the sequences named in most files (ties stay), in at least ``least``: cluster_id, column, count."""
    n = annotations.where(F.col(column).isNotNull()).select("cluster_id", "file_id", column).distinct().groupBy("cluster_id", column).agg(F.count("*").alias("count"))
    top = F.max("count").over(W.partitionBy("cluster_id"))
    return n.withColumn("_top", top).where((F.col("count") == F.col("_top")) & (F.col("count") >= least)).drop("_top")


def consensus_proteins(consensus: DataFrame, annotations: DataFrame, column: str = "sequence") -> DataFrame:
    """Consensus sequences with the distinct proteins named for them."""
    return consensus.join(annotations.select("cluster_id", column, "protein").distinct(), ["cluster_id", column], "left")


def peptide_table(matrix: DataFrame, annotations: DataFrame, values: list[str] | None, column: str = "sequence") -> DataFrame:
    """Sums per peptide of clusters with exactly one sequence; without ``values``, ``matrix`` is in blocks."""
    s = annotations.select("cluster_id", column).where(F.col(column).isNotNull() & (F.col(column) != "") & ~F.contains(F.col(column), F.lit(".|.")))
    if values is None:
        return sum_blocks(matrix.join(s, "cluster_id"), column)
    return matrix.join(s, "cluster_id").groupBy(column).agg(*[F.sum(F.col(f"`{v}`")).alias(v) for v in values])


def peptide_metadata(annotations: DataFrame, peptides: DataFrame, column: str = "sequence") -> DataFrame:
    kept = annotations.join(peptides.select(column), column, "left_semi")
    return aggregate_annotations(kept, column)
