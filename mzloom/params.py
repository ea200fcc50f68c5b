"""Parameters of a data-dependent acquisition run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

INSTRUMENTS = ("orbitrap", "fticr", "tof", "quad")
#: Accepted spellings.
SYNONYMS = {"quadrupole": "quad", "ft-icr": "fticr"}


def instrument(name: str) -> str:
    found = SYNONYMS.get(name.lower(), name.lower())
    if found not in INSTRUMENTS:
        raise ValueError(f"unknown instrument type: {name}")
    return found


@dataclass(frozen=True)
class Run:
    """What a run's acquisition fixes: instrument, resolution and chromatographic width."""

    instrument: str = "orbitrap"
    resolution_ms1: float = 70_000.0
    resolution_msn: float = 30_000.0
    reference_mz: float = 200.0
    fwhm_rt: float = 9.0


@dataclass(frozen=True)
class Resampling:
    """Grid sampling; defaults of the pipeline."""

    num_samples_mz: int = 5
    num_samples_rt: int = 5
    smoothing_coef_mz: float = 0.4
    smoothing_coef_rt: float = 0.4


@dataclass(frozen=True)
class Warping:
    slack: int = 30
    window: int = 100
    num_points: int = 2000
    expand: float = 0.2
    peaks_per_window: int = 100


@dataclass(frozen=True)
class Parameters:
    run: Run = field(default_factory=Run)
    resampling: Resampling = field(default_factory=Resampling)
    warping: Warping = field(default_factory=Warping)
    polarity: str = "both"
    min_mz: float = 0.0
    max_mz: float = 100_000.0
    min_rt: float = 0.0
    max_rt: float = 100_000.0
    max_peaks: int = 1_000_000
    charge_states: tuple[int, ...] = (5, 4, 3, 2, 1)
    link_n_sig_mz: float = 3.0
    link_n_sig_rt: float = 3.0
    match_fraction: float = 0.7
    match_n_sig_mz: float = 1.5
    match_n_sig_rt: float = 1.5
    match_intensity: float = 0.5
    #: Clusters as a known older pipeline made them: intensity threshold 1.5 and 1.5 sigma in time, whatever is set.
    match_compat: bool = False
    similarity_peaks: int = 2000
    #: Which identifications are read: the best rank of a spectrum, above the threshold, no decoys.
    max_rank_only: bool = True
    require_threshold: bool = True
    ignore_decoy: bool = True
    identification_by: str = "msms_event"
    quant_isotopes: str = "height"
    quant_features: str = "max_height"
    charge_state_filter: bool = True
    consensus: bool = True
    consensus_min: int = 2
    #: Whether annotation tables are kept as results besides the tables per cluster.
    save_annotations: bool = True
    protein_min_peptides: int = 1
    protein_remove_subsets: bool = True
    protein_ignore_ambiguous: bool = True
    protein_quant: str = "razor"
    #: Highest peaks of a run in the plot of widths over m/z.
    scatter_peaks: int = 200_000


def default_parameters(name: str = "orbitrap", avg_fwhm_rt: float = 9.0) -> Parameters:
    """Defaults are known for Orbitrap runs only."""
    if instrument(name) != "orbitrap":
        raise ValueError(f"no default parameters for {name}")
    return Parameters(run=Run(fwhm_rt=avg_fwhm_rt))
