"""Batch jobs: episode deduplication, retention, and the fingerprint of the belief tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_cohorts(episodes: DataFrame, owners: DataFrame, resolving: DataFrame | None = None) -> DataFrame:
    """Exact episodes that are live, have an owner and resolve no prediction, with their cohort: same title and event time, same set of owners."""
    live = episodes.where("type = 'episode' and (consolidation_state is null or consolidation_state <> 'tombstoned')")
    if resolving is not None:
        live = live.join(resolving.select("episode_id"), "episode_id", "left_anti")
    owner_sets = owners.groupBy("episode_id").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    return live.join(owner_sets, "episode_id")


def duplicate_episode_candidates(episodes: DataFrame, owners: DataFrame, resolving: DataFrame | None = None) -> DataFrame:
    """Members of cohorts of two or more. The cohort's size comes from an aggregate, so that no window holds a large cohort."""
    rows = dedup_cohorts(episodes, owners, resolving)
    sizes = rows.groupBy("title", "event_time", "owners").agg(F.count("*").alias("n")).where("n > 1")
    same = rows["title"].eqNullSafe(sizes["title"]) & rows["event_time"].eqNullSafe(sizes["event_time"]) & (rows["owners"] == sizes["owners"])
    return rows.join(sizes, same, "left_semi")


def dedup_episodes(episodes: DataFrame, owners: DataFrame, resolving: DataFrame | None = None) -> DataFrame:
    """(episode_id, keeper) for each loser: the keeper is the earliest by ingest time, then id."""
    rows = dedup_cohorts(episodes, owners, resolving)
    keepers = rows.groupBy("title", "event_time", "owners").agg(F.min(F.struct("ingest_time", "episode_id")).alias("first")).select("title", "event_time", "owners", F.col("first.episode_id").alias("keeper"))
    same = rows["title"].eqNullSafe(keepers["title"]) & rows["event_time"].eqNullSafe(keepers["event_time"]) & (rows["owners"] == keepers["owners"])
    return rows.join(keepers, same).where("episode_id <> keeper").select("episode_id", "keeper")


def tombstone(episodes: DataFrame, losers: DataFrame) -> DataFrame:
    hit = losers.select("episode_id").distinct().withColumn("lost", F.lit(True))
    return episodes.join(hit, "episode_id", "left").withColumn("consolidation_state", F.when(F.col("lost"), "tombstoned").otherwise(F.col("consolidation_state"))).drop("lost")


def tick(episodes: DataFrame, owners: DataFrame, resolving: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """One pass of the consolidation job: (episodes after it, counts); a second pass changes nothing."""
    losers = dedup_episodes(episodes, owners, resolving)
    return tombstone(episodes, losers), {"tombstoned": losers.count()}


def _superseded_flag(informs: DataFrame, superseded: DataFrame) -> DataFrame:
    gone = superseded.select(F.col("belief_id").alias("synthesized")).distinct().withColumn("gone", F.lit(True))
    return informs.join(gone, "synthesized", "left").groupBy("retrieval").agg(F.max(F.coalesce("gone", F.lit(False))).alias("some"), F.min(F.coalesce("gone", F.lit(False))).alias("every"))


def retention_any(informs: DataFrame, superseded: DataFrame) -> DataFrame:
    """Retrieval events of which some belief is superseded."""
    return _superseded_flag(informs, superseded).where("some").select("retrieval")


def retention_all(informs: DataFrame, superseded: DataFrame) -> DataFrame:
    """Retrieval events all of whose beliefs are superseded: the ones that are safe to prune."""
    return _superseded_flag(informs, superseded).where("every").select("retrieval")


def fingerprint(frames: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(label, measure, n) for each frame, zero for an empty one."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), F.lit(measure).alias("measure"), "n") for (label, measure), df in frames.items()]
    return reduce(DataFrame.unionAll, parts)


def fingerprint_by_label(rows: DataFrame, labels: list[str], measure: str) -> DataFrame:
    """Counts by the column ``label``, zero for labels without rows."""
    known = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return known.join(counts, "label", "left").select("label", F.lit(measure).alias("measure"), F.coalesce("n", F.lit(0)).alias("n"))


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), ["label", "measure"], "full_outer")
    return both.select("label", "measure", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")).where("n_before <> n_after")


#: Jobs that have a name and a place in a run, but no rule yet.
PLANNED = (
    "discover_typed_join_links",
    "synthesize_links_llm",
    "contradiction_sweep",
    "decay_archive_tombstone",
    "summarize_archived_provenance",
    "ttl_prune_record_tier",
    "rollup_high_volume_episodes",
    "collapse_superseded_provenance",
    "precompute_blast_radius",
    "invalidate_blast_radius",
)


def planned(name: str) -> None:
    """Asking for a planned job is an error of its own kind, so that callers can tell it from a name that doesn't exist."""
    if name not in PLANNED:
        raise ValueError(f"no job {name}")
    raise NotImplementedError(f"{name} isn't implemented yet")


def keeper_rank() -> object:
    """The order of keepers, for callers that want all ranks of small cohorts."""
    return F.row_number().over(Window.partitionBy("title", "event_time", "owners").orderBy("ingest_time", "episode_id"))
