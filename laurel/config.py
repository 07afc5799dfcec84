"""Run parameters. One frozen object is handed to every operator."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# Publication types that count as core papers, and the first
# citing year of the full-career edition (it decides the export name).
CORE_TYPES = ("ar", "cp", "re")
CAREER_CITE_YEAR = 1996

# Lists of hot keys hold at most rows / hot_key_rows keys; a run over real data wants
# a million, tests a few dozen.
LEAST_HOT_ROWS = 16


@dataclass(frozen=True)
class MetricConfig:
    """Years, cut-offs and switches of one run.

    ``collections`` names the collection codes whose papers count and may
    cite (preprint-only papers carry neither). ``database_name`` and
    ``scheme_name`` only appear in the data dictionary's wording.
    """

    collections: tuple[str, ...]
    min_year: int = 1960
    min_cite_year: int = 1996
    max_year: int = 2020
    overall_min_year: int | None = None
    include_preprints: bool = False
    year_column: str = "year"
    stamp: str = "00000000"
    # cut-offs
    min_core_papers: int = 5
    min_ranked_papers: int = 2
    rank_cutoff: int = 100_000
    subfield_fraction: float = 0.02
    # deliberate extensions, off by default
    max_cite_year: int | None = None
    strict_reference: bool = False
    # wording
    database_name: str = "the database"
    scheme_name: str = "subject"
    # a key holding more rows than this is split over several tasks
    hot_key_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if not self.collections:
            raise ValueError("collections must name at least one collection code")
        for name in ("min_year", "min_cite_year", "max_year"):
            if not isinstance(getattr(self, name), int):
                raise TypeError(f"{name} must be an integer year")
        if self.min_year > self.max_year:
            raise ValueError("min_year is after max_year")
        if self.overall_min_year is not None and self.overall_min_year > self.min_cite_year:
            raise ValueError("overall_min_year must not be after min_cite_year")
        if self.hot_key_rows < LEAST_HOT_ROWS:
            raise ValueError(f"hot_key_rows must be at least {LEAST_HOT_ROWS}")

    @property
    def label_suffixes(self) -> tuple[str, str, str]:
        """Two-digit years used in column labels: papers from, cites from, until."""
        return tuple(f"{y % 100:02d}" for y in (self.min_year, self.min_cite_year, self.max_year))

    @property
    def edition(self) -> str:
        if self.min_cite_year == CAREER_CITE_YEAR:
            return "career"
        if self.min_cite_year == self.max_year:
            return "singleyr"
        return str(self.min_cite_year)

    def artifact_name(self, kind: str) -> str:
        """Export name, e.g. ``Table_1_Authors_career_2020_wopp_extracted_202108``."""
        since = "" if self.overall_min_year is None else f"_pubs_since_{self.overall_min_year}"
        preprints = "wpp" if self.include_preprints else "wopp"
        return f"{kind}_{self.edition}_{self.max_year}{since}_{preprints}_extracted_{self.stamp[:6]}"

    def fingerprint(self, *extra: str) -> str:
        """Digest of every parameter, so a changed one can never reuse a stage."""
        text = json.dumps([asdict(self), *extra], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def career(collections: tuple[str, ...], **overrides) -> MetricConfig:
    """Citations from 1996 on, papers 1960-2020."""
    return MetricConfig(collections=collections, **{"min_cite_year": CAREER_CITE_YEAR, **overrides})


def single_year(collections: tuple[str, ...], **overrides) -> MetricConfig:
    """Citations of 2020 alone, papers 1960-2020."""
    return MetricConfig(collections=collections, **{"min_cite_year": 2020, **overrides})
