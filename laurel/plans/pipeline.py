"""The run from publications to ranked tables, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.bloom import held, id_filter
from laurel.functions.spread import any_of, hot_keys
from laurel.operators import (
    authorship,
    checks,
    citations,
    institutions,
    names,
    profile,
    ranking,
    score,
    subjects,
    thresholds,
)
from laurel.plans import reports
from laurel.sources.reports import write_report
from laurel.sources.stages import PLAIN, Layout, StageStore, file_identity


# What later steps read by: citation counts and citing papers by cited paper, everything
# about an author by author; few pairs are checked for a shared author.
LAYOUTS = {
    "edge_candidates": Layout(split_by="maybe_self"),
    "edges": Layout(bucket_by="cited_eid"),
    "author_papers": Layout(bucket_by="auid"),
    "hot_authors": Layout(bucket_by="auid"),
    "core_papers": Layout(bucket_by="auid"),
    "subject_counts": Layout(bucket_by="auid"),
    "author_profile": Layout(bucket_by="auid"),
}


@dataclass(frozen=True)
class Inputs:
    """``partitions`` is how many tasks the author slots call for; 0 leaves it to the session."""

    publications: DataFrame
    institutions: DataFrame
    classification: DataFrame
    labels: DataFrame
    discontinued: DataFrame
    partitions: int = 0


class Pipeline:
    """Lazily built stages of one run; each is written once and read from there on.

    Stages that several later steps read are tables in the store. That keeps every
    job short enough to restart after a lost executor, and gives the next job the
    real size of what it joins.
    """

    def __init__(
        self, spark: SparkSession, inputs: Inputs, cfg: MetricConfig, root: str, version: str
    ) -> None:
        """``version`` names the snapshot of the inputs; it must not be empty.

        The key of a stage also covers the files of every input, the labels and the
        discontinued list, so that changed inputs never reuse a stage.
        """
        if not version:
            raise ValueError("version must name the snapshot of the inputs")
        self.spark = spark
        self.inputs = inputs
        self.cfg = cfg
        listed = inputs.discontinued.select(F.col("srcid")).distinct().agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("srcid"))
        )
        named = inputs.labels.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("domain", "field", "subfield"))
        )
        files = [
            file_identity(df)
            for df in (inputs.publications, inputs.institutions, inputs.classification)
        ]
        self.store = StageStore(
            spark, root, f"{version}|{listed.first()}|{named.first()}|{files}", inputs.partitions
        )

    def save(self, name: str, df: DataFrame) -> DataFrame:
        return self.store.get_or_build(name, self.cfg, lambda: df, LAYOUTS.get(name, PLAIN))

    def _hot(self, name: str, counts: DataFrame, on: str, n: str) -> DataFrame:
        """Keys that hold more rows than one task should; often none."""
        return self.save(name, hot_keys(counts, [on], n, self.cfg.hot_key_rows))

    @cached_property
    def hot_cited(self) -> DataFrame:
        counts = citations.heavy_references(self.inputs.publications, self.cfg)
        return self._hot("hot_cited", counts, "cited_eid", "n_references")

    @cached_property
    def known_papers(self) -> DataFrame:
        return self.save("known_papers", citations.known_papers(self.inputs.publications))

    @cached_property
    def edges(self) -> DataFrame:
        return self.save(
            "edges",
            citations.citation_edges(
                self.inputs.publications,
                self.inputs.discontinued,
                self.cfg,
                any_of(self.hot_cited),
                self.known_papers,
                self.save,
            ),
        )

    @cached_property
    def citation_counts(self) -> DataFrame:
        return citations.citation_counts(self.edges)

    @cached_property
    def author_papers(self) -> DataFrame:
        return self.save(
            "author_papers",
            authorship.author_papers(
                self.inputs.publications,
                self.citation_counts,
                self.inputs.classification,
                self.inputs.discontinued,
                self.cfg,
            ),
        )

    @cached_property
    def author_sizes(self) -> DataFrame:
        return self.save("author_sizes", authorship.author_sizes(self.author_papers))

    @cached_property
    def core_papers(self) -> DataFrame:
        """Rows of authors that are profiled: what metrics, citing papers and subjects start from."""
        return self.save(
            "core_papers",
            authorship.rows_of_core_authors(self.author_papers, self.author_sizes, self.cfg),
        )

    @cached_property
    def hot_authors(self) -> DataFrame:
        enough = self.author_sizes.filter(F.col("n_core") >= self.cfg.min_core_papers)
        return self._hot("hot_authors", enough, "auid", "n_rows")

    @cached_property
    def paper_metrics(self) -> DataFrame:
        return profile.paper_metrics(self.core_papers, self.cfg, any_of(self.hot_authors))

    @cached_property
    def distinct_citing(self) -> DataFrame:
        return profile.distinct_citing(
            self.core_papers, self.edges, self.cfg, self.save, self.store.buckets
        )

    @cached_property
    def subject_counts(self) -> DataFrame:
        return self.save("subject_counts", subjects.subject_counts(self.core_papers, self.cfg))

    @cached_property
    def subject_volumes(self) -> DataFrame:
        return self.save("subject_volumes", subjects.subject_volumes(self.subject_counts))

    @cached_property
    def author_subjects(self) -> DataFrame:
        return subjects.rank_subjects(self.subject_counts, self.subject_volumes)

    @cached_property
    def author_profile(self) -> DataFrame:
        return self.save(
            "author_profile",
            profile.author_profile(
                self.paper_metrics, self.distinct_citing, self.author_subjects
            ),
        )

    @cached_property
    def log_maxima(self) -> DataFrame:
        return self.save("log_maxima", score.log_maxima(self.author_profile))

    @cached_property
    def scored(self) -> DataFrame:
        return score.composite_score(self.author_profile, self.log_maxima)

    @cached_property
    def author_names(self) -> DataFrame:
        return names.author_names(self.inputs.publications, self.cfg)

    def _institutions(self, prefix: str = "", wanted: DataFrame | None = None) -> DataFrame:
        links = institutions.author_affiliations(self.inputs.publications, self.cfg)
        last = None
        if wanted is not None:  # two passes over these links, one over the publications
            links = self.save(f"{prefix}links", links.filter(held(wanted, F.col("auid"))))
            years = self.save(f"{prefix}last_years", institutions.last_affiliated_years(links))
            last = self.save(f"{prefix}last_links", id_filter(years, "_key"))
        chosen = self.save(
            f"{prefix}dominant_affiliation", institutions.dominant_affiliation(links, None, last)
        )
        sizes = chosen.groupBy("affil_id").agg(F.count(F.lit(1)).alias("n"))
        hot = self._hot(f"{prefix}hot_institutions", sizes, "affil_id", "n")
        return institutions.author_institution(chosen, self.inputs.institutions, hot)

    @cached_property
    def author_institution(self) -> DataFrame:
        return self._institutions()

    @cached_property
    def profiled_authors(self) -> DataFrame:
        """A filter over the authors that have a profile: only their names and institutions are ranked."""
        return self.save("profiled_authors", id_filter(self.author_profile, "auid"))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.save(
            "ranked",
            ranking.rank_authors(
                self.scored,
                names.author_names(self.inputs.publications, self.cfg, self.profiled_authors),
                self._institutions("profiled_", self.profiled_authors),
                self.cfg,
                self.save,
            ),
        )

    @cached_property
    def thresholds(self) -> DataFrame:
        return self.save(
            "thresholds", thresholds.subject_thresholds(self.ranked, self.cfg, save=self.save)
        )

    @cached_property
    def table1(self) -> DataFrame:
        return reports.table1(self.ranked, self.cfg)

    @cached_property
    def table2_subfield(self) -> DataFrame:
        return reports.table2_subfield(self.thresholds, self.inputs.labels, self.cfg)

    @cached_property
    def table2_field(self) -> DataFrame:
        return reports.table2_field(self.thresholds, self.inputs.labels, self.cfg)

    @cached_property
    def table3(self) -> DataFrame:
        return reports.table3(self.log_maxima, self.cfg)

    @cached_property
    def dataset_stats(self) -> DataFrame:
        return reports.dataset_stats(self.ranked, self.thresholds, self.cfg)

    @cached_property
    def run_summary(self) -> DataFrame:
        return checks.run_summary(self.ranked)

    def check_inputs(self) -> None:
        """One subject per paper and one institution per author, or the counts inflate."""
        checks.assert_unique(self.inputs.classification, "eid")
        checks.assert_unique(self.author_institution, "auid")

    def write_reports(self, folder: str) -> dict[str, str]:
        """Write all tables as CSV below ``folder``; returns their paths."""
        folder = folder.rstrip("/")
        written = {}
        for kind, df, single in (
            ("Table_1_Authors", self.table1, False),
            ("Table_1_Key", reports.table1_dictionary(self.spark, self.cfg), True),
            ("Table_2_subfield_thresholds", self.table2_subfield, True),
            ("Table_2_field_thresholds", self.table2_field, True),
            ("Table_3_maxlog", self.table3, True),
        ):
            path = f"{folder}/{self.cfg.artifact_name(kind)}"
            write_report(df, path, single_file=single)
            written[kind] = path
        return written
