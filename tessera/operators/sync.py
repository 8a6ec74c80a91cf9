"""Diff-sync of a bundle's documents with what is stored: collisions, plan, garbage, release, retirement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collisions(manifest: DataFrame, stored: DataFrame, bundle: str) -> DataFrame:
    """Manifest ids that are stored but not contained by this bundle (by another, or by none). stored: concept_id, file_hash, bundle_name; a row for each container."""
    others = stored.select("concept_id").distinct()
    mine = stored.where(F.col("bundle_name") == bundle).select("concept_id")
    return manifest.select("concept_id").join(others, "concept_id", "left_semi").join(mine, "concept_id", "left_anti").distinct()


def plan_sync(manifest: DataFrame, stored: DataFrame, bundle: str) -> DataFrame:
    """(concept_id, action): insert, update (the hash differs or is missing), skip or delete."""
    mine = stored.where(F.col("bundle_name") == bundle).select("concept_id", F.col("file_hash").alias("old"), F.lit(True).alias("held"))
    new = manifest.select("concept_id", F.col("file_hash").alias("new"), F.lit(True).alias("listed"))
    both = new.join(mine, "concept_id", "full_outer")
    action = F.when(F.col("held").isNull(), "insert").when(F.col("listed").isNull(), "delete").when(F.col("new").eqNullSafe(F.col("old")) & F.col("new").isNotNull(), "skip").otherwise("update")
    return both.select("concept_id", action.alias("action"))


def split_gc(deletes: DataFrame, containment: DataFrame, bundle: str) -> DataFrame:
    """(concept_id, fate): delete what only this bundle contains, release what others contain too."""
    others = containment.where(F.col("bundle_name") != bundle).select("concept_id").distinct().withColumn("shared", F.lit(True))
    return deletes.select("concept_id").join(others, "concept_id", "left").select("concept_id", F.when(F.col("shared"), "release").otherwise("delete").alias("fate"))


def retire_or_delete(deletes: DataFrame, belief_players: DataFrame) -> DataFrame:
    """(concept_id, fate): a concept that plays in a belief relation is retired, others are deleted."""
    players = belief_players.select("concept_id").distinct().withColumn("plays", F.lit(True))
    return deletes.select("concept_id").join(players, "concept_id", "left").select("concept_id", F.when(F.col("plays"), "retire").otherwise("delete").alias("fate"))


def within(pairs: DataFrame, manifest: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs both of whose ends are in the manifest."""
    ids = manifest.select("concept_id").distinct()
    return pairs.join(ids.withColumnRenamed("concept_id", a), a, "left_semi").join(ids.withColumnRenamed("concept_id", b), b, "left_semi").select(pairs.columns)


def missing_from(pairs: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that aren't held yet, each once."""
    return pairs.dropDuplicates(keys).join(held.select(keys), keys, "left_anti")
