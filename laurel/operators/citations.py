"""Citation edges, self-citations and counts per cited paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.bloom import held, id_filter
from laurel.functions.columns import author_id, in_collections, is_person
from laurel.functions.spread import spread_join
from laurel.operators.ranking import Save, unsaved

# Cells of the sketch that finds very cited papers: what one task sends at most.
SKETCH_CELLS = 1 << 16
# Two signatures with hashes of their own; an author in common shows in both.
SIGNATURES = ("first", "second")


def flag_discontinued(papers: DataFrame, discontinued: DataFrame, source_id: Column) -> DataFrame:
    """Add ``is_discontinued`` (0/1): does the paper's source appear in the list?

    A paper without a source id counts as 0. The join carries no hint: Spark
    broadcasts the list when its size allows and shuffles it otherwise.
    """
    listed = discontinued.select(F.col("srcid").alias("_srcid")).distinct().withColumn(
        "_listed", F.lit(1)
    )
    return (
        papers.withColumn("_srcid", source_id)
        .join(listed, "_srcid", "left")
        .withColumn("is_discontinued", F.coalesce("_listed", F.lit(0)))
        .drop("_srcid", "_listed")
    )


def _people(raw_ids: Column, cfg: MetricConfig) -> Column:
    """Ids used to compare author lists.

    Unknown and placeholder ids do not identify anybody, so they are left out;
    ``strict_reference`` keeps them, and then two unknown authors match.
    """
    ids = F.transform(raw_ids, author_id)
    return ids if cfg.strict_reference else F.filter(ids, is_person)


def citing_papers(publications: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Papers whose references count: from the first citing year on, preprints never."""
    citing = publications.filter(F.col(cfg.year_column) >= cfg.min_cite_year)
    if cfg.max_cite_year is not None:
        citing = citing.filter(F.col(cfg.year_column) <= cfg.max_cite_year)
    return citing.filter(in_collections("dbcollections", cfg.collections))


def _references(publications: DataFrame, cfg: MetricConfig) -> DataFrame:
    """One row per distinct reference of a citing paper; reads three columns."""
    return (
        citing_papers(publications, cfg)
        .select(F.explode(F.array_distinct("references")).alias("cited_eid"))
        .filter(F.col("cited_eid").isNotNull())
    )


def reference_counts(publications: DataFrame, cfg: MetricConfig) -> DataFrame:
    """How often each paper id is cited, known to the database or not."""
    return _references(publications, cfg).groupBy("cited_eid").agg(
        F.count(F.lit(1)).alias("n_references")
    )


def heavy_references(
    publications: DataFrame, cfg: MetricConfig, limit: int | None = None, cells: int = SKETCH_CELLS
) -> DataFrame:
    """The papers with more than ``limit`` references (``hot_key_rows``), with exact counts.

    A sketch first: ids are hashed to ``cells`` and the cells counted, combined on the map
    side, so that a task sends at most that many rows. A cell counts at least as much as any
    of its ids, so the cells beyond the limit hold all the papers wanted; they are at most
    references / limit, which bounds their broadcast. Only ids in them are counted one by one.
    """
    limit = cfg.hot_key_rows if limit is None else limit
    rows = _references(publications, cfg).withColumn(
        "_cell", F.pmod(F.xxhash64("cited_eid"), F.lit(cells)).cast("int")
    )
    heavy = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return (
        rows.join(F.broadcast(heavy.select("_cell")), "_cell", "left_semi")
        .groupBy("cited_eid")
        .agg(F.count(F.lit(1)).alias("n_references"))
        .filter(F.col("n_references") > limit)
    )


def known_papers(publications: DataFrame) -> DataFrame:
    """A Bloom filter over all paper ids: one row with ``bits`` and ``words``."""
    return id_filter(publications, "eid")


def _signature(people: Column, name: str) -> Column:
    """64 bits of an author list: lists that share an author share a bit."""
    bits = F.aggregate(
        people,
        F.lit(0).cast("long"),
        lambda mask, auid: mask.bitwiseOR(F.call_function(
            "shiftleft",
            F.lit(1).cast("long"),
            F.pmod(F.xxhash64(F.lit(name), auid), F.lit(64)).cast("int"),
        )),
    )
    return F.coalesce(bits, F.lit(0).cast("long"))


def _signatures(people: Column, side: str) -> list[Column]:
    return [_signature(people, name).alias(f"_{side}_{name}") for name in SIGNATURES]


def edge_candidates(
    publications: DataFrame,
    discontinued: DataFrame,
    cfg: MetricConfig,
    hot_cited: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per (citing, cited) pair of known papers, and whether they may share an author.

    What travels has a fixed width: ids and two signatures of 64 bits of each author list, never
    the lists. ``maybe_self`` is 1 for every pair that shares an author, and for others with a
    chance of about (a * b / 64) ** 2 for lists of a and b authors. ``known`` (from
    ``known_papers``) keeps references to unknown papers, but for its error, out of the shuffle.
    """
    people = _people(F.col("Au.auid"), cfg)
    citing = flag_discontinued(
        citing_papers(publications, cfg).select(
            F.col("eid").alias("citing_eid"),
            F.array_distinct("references").alias("_references"),
            F.col("source.srcid").alias("_source"),
            *_signatures(people, "citing"),
        ),
        discontinued,
        F.col("_source"),
    )
    references = citing.select(
        "citing_eid",
        F.explode("_references").alias("cited_eid"),
        "is_discontinued",
        *[f"_citing_{name}" for name in SIGNATURES],
    ).filter(F.col("cited_eid").isNotNull())
    if known is not None:
        references = references.filter(held(known, F.col("cited_eid")))
    cited = publications.select(F.col("eid").alias("cited_eid"), *_signatures(people, "cited"))
    meet = F.lit(True)
    for name in SIGNATURES:
        meet = meet & (F.col(f"_citing_{name}").bitwiseAND(F.col(f"_cited_{name}")) != 0)
    return spread_join(
        references, cited, ["cited_eid"], hot_cited, "citing_eid", written=True
    ).select(
        "citing_eid", "cited_eid", "is_discontinued", meet.cast("int").alias("maybe_self")
    )


def citation_edges(
    publications: DataFrame,
    discontinued: DataFrame,
    cfg: MetricConfig,
    hot_cited: DataFrame | None = None,
    known: DataFrame | None = None,
    save: Save = unsaved,
) -> DataFrame:
    """One row per (citing, cited) pair of papers that are both in the database.

    Repeated references count once. The cited side is not filtered: any known
    paper can be cited. ``is_self`` is 1 when both papers share an author; only the pairs
    whose signatures meet fetch the two author lists, which then decide. ``eid`` names one
    paper. ``hot_cited`` (from ``heavy_references`` or ``hot_keys`` on ``cited_eid``) spreads
    very cited papers, ``known`` (from ``known_papers``) drops unknown references early. With
    written stages (``save``) a filter over the ids of those pairs keeps other lists in place.
    """
    pairs = save("edge_candidates", edge_candidates(publications, discontinued, cfg, hot_cited, known))
    meeting = pairs.filter("maybe_self = 1")
    both = meeting.select(F.explode(F.array("citing_eid", "cited_eid")).alias("eid"))
    lists = publications.select("eid", "Au.auid")
    if save is not unsaved:
        lists = lists.filter(held(save("meeting_papers", id_filter(both, "eid")), F.col("eid")))
    cited = lists.select(F.col("eid").alias("cited_eid"), F.col("auid").alias("_cited"))
    citing = lists.select(F.col("eid").alias("citing_eid"), F.col("auid").alias("_citing"))
    checked = spread_join(
        meeting, cited, ["cited_eid"], hot_cited, "citing_eid", written=True
    ).join(citing, "citing_eid", "left")
    ids, other_ids = _people(F.col("_citing"), cfg), _people(F.col("_cited"), cfg)
    if cfg.strict_reference:
        # array_intersect, unlike arrays_overlap, lets NULL match NULL
        shared = F.size(F.array_intersect(ids, other_ids)) > 0
    else:
        shared = F.arrays_overlap(ids, other_ids)

    def edges(rows: DataFrame, is_self: Column) -> DataFrame:
        return rows.select("citing_eid", "cited_eid", is_self.alias("is_self"), "is_discontinued")

    return edges(pairs.filter("maybe_self = 0"), F.lit(0)).unionAll(
        edges(checked, F.coalesce(shared.cast("int"), F.lit(0)))
    )


def citation_counts(edges: DataFrame) -> DataFrame:
    """Citations per cited paper: all, self, non-self, from discontinued sources."""
    return edges.groupBy(F.col("cited_eid").alias("eid")).agg(
        F.count(F.lit(1)).alias("ws_cites"),
        F.sum("is_self").alias("self_cites"),
        F.sum(1 - F.col("is_self")).alias("ns_cites"),
        F.sum("is_discontinued").alias("discontinued_cites"),
    )
