"""mzIdentML reader: four relational tables.

With ``one_pass`` the files are cut into elements once (``files.ElementSource``, for stores that pyarrow opens), those are written to the shared folder, and the
tables come from there; else Spark's XML source reads the files once for each table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.sources import files
from mzloom.sources.spectra import check_range
from mzloom.storage import materialise

_CV = "array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>"
_MOD = "array<struct<_location:int,_residues:string,_monoisotopicMassDelta:double,_avgMassDelta:double,cvParam:" + _CV + ">>"
_SUB = "array<struct<_location:int,_residues:string,_monoisotopicMassDelta:double,_avgMassDelta:double,_originalResidue:string,_replacementResidue:string>>"
_ITEM = (
    "array<struct<_id:string,_peptide_ref:string,_passThreshold:boolean,_rank:int,_chargeState:int,_experimentalMassToCharge:double,_calculatedMassToCharge:double,"
    "PeptideEvidenceRef:array<struct<_peptideEvidence_ref:string>>,cvParam:" + _CV + ">>"
)

#: What the tables need of each element.
SCHEMAS = {
    "DBSequence": f"_id string, _accession string, _searchDatabase_ref string, cvParam {_CV}",
    "Peptide": f"_id string, PeptideSequence string, Modification {_MOD}, SubstitutionModification {_SUB}",
    "PeptideEvidence": "_id string, _peptide_ref string, _dBSequence_ref string, _isDecoy boolean",
    "SpectrumIdentificationResult": f"_id string, _spectrumID string, SpectrumIdentificationItem {_ITEM}, cvParam {_CV}",
}


@dataclass
class Identifications:
    """db_sequences, peptides, peptide_evidence, spectrum_matches; each with the path of its file, since ids are local to it."""

    db_sequences: DataFrame
    peptides: DataFrame
    peptide_evidence: DataFrame
    spectrum_matches: DataFrame


def _by_tag(spark: SparkSession, path, tag: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(SCHEMAS[tag])
    return rows.load(path).select(F.col("_metadata.file_path").alias("path"), "*")


def _parsed(pieces: DataFrame) -> DataFrame:
    """Pieces with a column for each tag in place of their text: what the tables need of it, parsed once."""
    told = [F.when(F.col("tag") == tag, F.from_xml("value", schema, {"attributePrefix": "_"})).alias(tag) for tag, schema in SCHEMAS.items()]
    return pieces.select("path", "tag", *told)


def _value(params, *accessions: str):
    return F.get(F.filter(params, lambda p: p["_accession"].isin(*accessions)), F.lit(0))


def read_mzidentml(spark: SparkSession, path: str | list[str], ignore_decoy=True, require_threshold=True, max_rank_only=True, min_mz=-1.0, max_mz=-1.0, min_rt=-1.0, max_rt=-1.0, one_pass: bool = False) -> Identifications:
    if one_pass:
        pieces = materialise(_parsed(files.register(spark).read.format("identifications").load(path if isinstance(path, str) else ",".join(path))))
        _rows = lambda spark, path, tag: pieces.where(F.col("tag") == tag).select("path", f"{tag}.*")
    else:
        _rows = _by_tag
    (lo_mz, hi_mz), (lo_rt, hi_rt) = check_range(min_mz, max_mz, "mz"), check_range(min_rt, max_rt, "rt")
    seq = _rows(spark, path, "DBSequence")
    seq = seq.select("path", F.col("_id").alias("db_sequence_id"), F.col("_accession").alias("accession"), F.col("_searchDatabase_ref").alias("db_reference"), _value("cvParam", "MS:1001088")["_value"].alias("description"))
    pep = _rows(spark, path, "Peptide")

    def described(m, ids):
        return F.struct(
            F.coalesce(m["_monoisotopicMassDelta"], F.lit(0.0)).alias("monoisotopic_mass_delta"), F.coalesce(m["_avgMassDelta"], F.lit(0.0)).alias("average_mass_delta"),
            F.coalesce(m["_residues"], F.lit("")).alias("residues"), F.coalesce(m["_location"], F.lit(-1)).alias("location"), ids.alias("id"),
        )

    text = lambda c: F.coalesce(c, F.lit(""))
    named = lambda m: F.coalesce(F.transform(m["cvParam"], lambda p: F.concat(text(p["_accession"]), F.lit("|"), text(p["_name"]))), F.array().cast("array<string>"))
    swapped = lambda m: F.array(F.concat(F.lit("SUBSTITUTION|"), text(m["_originalResidue"]), F.lit("->"), text(m["_replacementResidue"])))
    mods = F.transform(F.coalesce("Modification", F.array().cast(_MOD)), lambda m: described(m, named(m)))
    mods = F.concat(mods, F.transform(F.coalesce("SubstitutionModification", F.array().cast(_SUB)), lambda m: described(m, swapped(m))))
    pep = pep.select("path", F.col("_id").alias("peptide_id"), F.col("PeptideSequence").alias("sequence"), mods.alias("modifications"))
    ev = _rows(spark, path, "PeptideEvidence")
    ev = ev.where(F.col("_peptide_ref").isNotNull()).select("path", F.col("_id").alias("evidence_id"), F.col("_peptide_ref").alias("peptide_id"), F.col("_dBSequence_ref").alias("db_sequence_id"), F.coalesce("_isDecoy", F.lit(False)).alias("decoy"))
    res = _rows(spark, path, "SpectrumIdentificationResult")
    time = _value("cvParam", "MS:1000894", "MS:1000016")
    rt = time["_value"].cast("double") * F.when(time["_unitAccession"] == "UO:0000031", 60).otherwise(1)
    items = res.select("path", F.col("_id").alias("result_id"), F.col("_spectrumID").alias("spectrum_id"), rt.alias("rt"), F.posexplode("SpectrumIdentificationItem").alias("place", "i"))
    items = items.select(
        "path", "result_id", "spectrum_id", "rt", "place", F.col("i._id").alias("match_id"), F.col("i._peptide_ref").alias("peptide_id"), F.coalesce("i._passThreshold", F.lit(False)).alias("pass_threshold"), F.col("i._rank").alias("rank"),
        F.col("i._chargeState").alias("charge_state"), F.col("i._experimentalMassToCharge").alias("experimental_mz"), F.col("i._calculatedMassToCharge").alias("theoretical_mz"),
    )
    if require_threshold:
        items = items.where("pass_threshold")
    items = items.where(F.col("experimental_mz").between(lo_mz, hi_mz) & F.coalesce("rt", F.lit(0.0)).between(lo_rt, hi_rt))
    if ignore_decoy:
        items = items.join(ev.where("decoy").select("path", "peptide_id").distinct(), ["path", "peptide_id"], "left_anti")
        ev = ev.where("not decoy")
    if max_rank_only:
        best = F.min(F.struct("rank", "place")).over(W.partitionBy("path", "result_id"))
        items = items.withColumn("b", best).where("path is not null and result_id is not null and rank = b.rank and place = b.place").drop("b")
    return Identifications(seq, pep, ev, items)
