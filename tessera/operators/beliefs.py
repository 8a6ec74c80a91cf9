"""Belief reads: windows, supersession, the gate, scores.

Validity windows are half open: from <= t, and no end or t < end; a missing start is in no window. Every function takes
DataFrames and gives one, without running anything.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import isa

HALF_LIFE_HOURS = 168
Time = dt.datetime | str


def moment(t: Time) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def in_window(start: Column, end: Column, t: Time | Column) -> Column:
    t = t if isinstance(t, Column) else moment(t)
    return F.coalesce((start <= t) & (end.isNull() | (end > t)), F.lit(False))


def believed_at(beliefs: DataFrame, t: Time) -> DataFrame:
    """Beliefs that are asserted now and valid at t; no owner matters. What was superseded later is absent (state is current)."""
    return beliefs.where((F.col("belief_state") == "asserted") & in_window(F.col("valid_from"), F.col("valid_to"), t))


def superseded(beliefs: DataFrame, supersession: DataFrame) -> DataFrame:
    """Beliefs that a supersession targets or whose state is superseded or retracted (contested ones aren't)."""
    hit = supersession.select(F.col("superseded").alias("belief_id")).distinct().withColumn("hit", F.lit(True))
    return beliefs.join(hit, "belief_id", "left").where(F.col("hit").isNotNull() | F.col("belief_state").isin("superseded", "retracted")).drop("hit")


def gate(beliefs: DataFrame, ownership: DataFrame, supersession: DataFrame, agent: str, now: Time) -> DataFrame:
    """Beliefs that agent may see now: asserted, valid, no supersession, and owned by the agent (by any row) or visible to team or shared. An agent that no row names sees nothing."""
    known = ownership.where(F.col("owner") == agent).limit(1).select(F.lit(1).alias("known"))
    seen = ownership.where(F.col("visibility").isin("team", "shared") | (F.col("owner") == agent)).select(F.col("owned").alias("belief_id"))
    live = believed_at(beliefs, now).join(supersession.select(F.col("superseded").alias("belief_id")), "belief_id", "left_anti")
    return live.join(seen, "belief_id", "left_semi").join(F.broadcast(known), F.lit(True), "left_semi")  # known has a row at most


def contradicts(claims: DataFrame) -> DataFrame:
    """Ordered pairs (b1, b2) of different claims of one contradiction."""
    a, b = claims.select("rel_id", F.col("claim").alias("b1")), claims.select("rel_id", F.col("claim").alias("b2"))
    return a.join(b, "rel_id").where("b1 <> b2").select("b1", "b2").distinct()


def score(now: Time) -> Column:
    """Base activation plus salience, for what was last used by now; null if any of the three is missing or use lies ahead."""
    return F.when(F.col("last_access") <= moment(now), F.col("base_activation") + F.col("salience"))


def retrieval_score(beliefs: DataFrame, now: Time) -> DataFrame:
    return beliefs.withColumn("score", score(now)).where("score is not null")


def decay(last_access: Column, now: Time) -> Column:
    """Halved every week of whole seconds since last use; 1 without a last use, or for one ahead."""
    age = F.timestamp_diff("SECOND", last_access, moment(now))
    return F.when(age > 0, F.pow(F.lit(0.5), age / F.lit(3600.0) / HALF_LIFE_HOURS)).otherwise(1.0)


def select_for_context(beliefs: DataFrame, ownership: DataFrame, supersession: DataFrame, agent: str, now: Time) -> DataFrame:
    """Gated and scored beliefs with rank = score * decay."""
    scored = retrieval_score(gate(beliefs, ownership, supersession, agent, now), now)
    return scored.withColumn("rank", F.col("score") * decay(F.col("last_access"), now))


def retrieval_provenance_of(informs: DataFrame, beliefs: DataFrame | None = None, episodes: DataFrame | None = None) -> DataFrame:
    """(synthesized, retrieval): the retrieval events that informed a belief; with episodes (episode_id, type), players of other types don't count."""
    pairs = informs.select("synthesized", "retrieval").distinct()
    if episodes is not None:
        pairs = pairs.join(isa(episodes, "retrieval-event").select(F.col("episode_id").alias("retrieval")), "retrieval", "left_semi").select("synthesized", "retrieval")
    return pairs if beliefs is None else pairs.join(beliefs.select(F.col("belief_id").alias("synthesized")), "synthesized", "left_semi")
