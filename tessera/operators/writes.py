"""Belief-tier writes as operators on whole batches: rows of requests give the rows of each table that they add or replace.

Ids come from the run, the time and the request's key, so that a repeated attempt makes the same ids. ``*_problems`` give
(key, problem) for requests that must not be written; a batch with problems is refused whole by the writer.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.disposition import METHOD_RANK, STRENGTH, lookup, method_rank

# The tier that a method gives a belief; all other methods give tool-derived.
ENTRENCHMENT = {"human-assertion": "user-stated", "llm-synthesis": "llm"}


@dataclass
class Context:
    """Who writes, in which run, when, and where observations come from."""

    run_id: str
    actor: str
    now: dt.datetime
    origin: str = "observation"


def at(ctx: Context) -> Column:
    return F.lit(ctx.now).cast("timestamp_ntz")


def mint(kind: str, ctx: Context, act: str, key: Column) -> Column:
    """The id of what ``act`` makes of the request with this key."""
    content = F.concat_ws("\x1f", F.lit(ctx.run_id), F.lit(ctx.now.isoformat()), F.lit(act), key.cast("string"))
    return F.concat(F.lit(f"mem/{kind}/"), F.substring(F.sha2(content.cast("binary"), 256), 1, 26))


def entrenchment_of(method: Column) -> Column:
    out = F.lit("tool-derived")
    for name, tier in ENTRENCHMENT.items():
        out = F.when(method == name, tier).otherwise(out)
    return out


def observed(ctx: Context, events: DataFrame) -> dict[str, DataFrame]:
    """events: key, text, event_time, ingest_time (null: now). Ownership of episodes has no visibility."""
    rows = events.withColumn("id", mint("ep", ctx, "observe", F.col("key")))
    own = F.col("id")
    return {
        "episode": rows.select(own.alias("episode_id"), F.lit("episode").alias("type"), F.col("text").alias("title"), F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.coalesce(F.col("ingest_time").cast("timestamp_ntz"), at(ctx)).alias("ingest_time"), F.lit(None).cast("string").alias("consolidation_state")),
        "source_link": rows.select(own.alias("sourced"), F.lit(ctx.run_id).alias("run_id"), F.lit(ctx.origin).alias("origin_kind")),
        "ownership": rows.select(own.alias("owned"), F.lit(ctx.actor).alias("owner"), F.lit(None).cast("string").alias("visibility")),
    }


def confidence_problem(confidence: Column, method: Column) -> Column:
    """What is wrong with a confidence: null if nothing."""
    outside = F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    return F.when(outside, "confidence lies outside 0 to 1").when((method_rank(method) == 0) & (confidence >= 1), "a probabilistic method can't be certain")


def assert_problems(drafts: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """drafts: key, title, confidence, visibility, valid_to, method; evidence: key, source; known: id of every memory item."""
    method = F.when(method_rank(F.col("method")) < 0, F.concat(F.lit("unknown method "), F.coalesce("method", F.lit("null"))))
    own = drafts.select(F.col("key").cast("string").alias("key"), F.coalesce(confidence_problem(F.col("confidence"), F.col("method")), method).alias("problem")).where("problem is not null")
    return own.unionByName(unknown(evidence, "source", known))


def unknown(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(key, problem) for ids in a column of rows (key, ...) that nobody has."""
    lost = rows.select(F.col("key").cast("string").alias("key"), F.col(column).alias("id")).join(known.select("id").distinct(), "id", "left_anti")
    return lost.select("key", F.concat(F.lit("unknown ids: "), F.coalesce("id", F.lit("null"))).alias("problem"))


def beliefs_of(ctx: Context, rows: DataFrame) -> dict[str, DataFrame]:
    """rows: id, title, confidence, entrenchment, visibility, valid_to, retrieval_provenance."""
    return {
        "belief": rows.select(
            F.col("id").alias("belief_id"),
            "title",
            F.lit("asserted").alias("belief_state"),
            "confidence",
            "entrenchment",
            at(ctx).alias("valid_from"),
            F.col("valid_to").cast("timestamp_ntz").alias("valid_to"),
            F.coalesce("confidence", F.lit(0.5)).alias("salience"),
            F.lit(1.0).alias("base_activation"),
            at(ctx).alias("last_access"),
            "retrieval_provenance",
        ),
        "source_link": rows.select(F.col("id").alias("sourced"), F.lit(ctx.run_id).alias("run_id"), F.lit("assertion").alias("origin_kind")),
        "ownership": rows.select(F.col("id").alias("owned"), F.lit(ctx.actor).alias("owner"), "visibility"),
    }


def correlations(ctx: Context, evidence: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(key, retrieval, concept_id): what this run's retrievals surfaced of each draft's evidence."""
    shown = surfaced.where(F.col("run_id") == ctx.run_id).select("retrieval", "concept_id").distinct()
    return evidence.select("key", F.col("source").alias("concept_id")).distinct().join(shown, "concept_id").select("key", "retrieval", "concept_id")


def asserted(ctx: Context, drafts: DataFrame, evidence: DataFrame, surfaced: DataFrame) -> dict[str, DataFrame]:
    """Beliefs with one derivation each from their evidence; retrievals of this run that surfaced some of it informed them."""
    hits = correlations(ctx, evidence, surfaced)
    informed = hits.select("key").distinct().withColumn("hit", F.lit(True))
    rows = drafts.withColumn("id", mint("bel", ctx, "assert", F.col("key"))).join(informed, "key", "left")
    rows = rows.withColumn("entrenchment", entrenchment_of(F.col("method"))).withColumn("retrieval_provenance", F.when(F.col("hit"), "semantic").otherwise("none"))
    sources = evidence.select("key", "source").distinct().join(drafts.select("key", "method"), "key").withColumn("derived", mint("bel", ctx, "assert", F.col("key")))
    return beliefs_of(ctx, rows) | {
        "derivation": sources.select(F.concat("derived", F.lit("/d")).alias("rel_id"), "derived", "source", F.col("method").alias("derivation_method")),
        "informs_synthesis": hits.select("retrieval", mint("bel", ctx, "assert", F.col("key")).alias("synthesized")).distinct(),
    }


def used(ctx: Context, evidence: DataFrame, surfaced: DataFrame) -> DataFrame:
    """The rows of surfaced that this run's evidence has used, marked."""
    sources = evidence.select(F.col("source").alias("concept_id")).distinct()
    return surfaced.where(F.col("run_id") == ctx.run_id).join(sources, "concept_id", "left_semi").withColumn("was_used", F.lit(True))


def with_tiers(drafts: DataFrame, beliefs: DataFrame) -> DataFrame:
    """drafts (old, entrenchment, ...) with the old belief's tier, and the new one's: the draft's, else the old one's, else inferred."""
    old = beliefs.select(F.col("belief_id").alias("old"), F.col("entrenchment").alias("old_tier"), F.lit(True).alias("held"))
    return drafts.join(old, "old", "left").withColumn("new_tier", F.coalesce("entrenchment", "old_tier", F.lit("inferred")))


def supersede_problems(drafts: DataFrame, beliefs: DataFrame) -> DataFrame:
    """drafts: old, title, confidence, entrenchment, visibility, valid_to, reason. A belief is superseded by one of a tier that
    reaches its own; an absent or unknown tier stops nothing. Two drafts for one old belief are a problem."""
    strength = lambda c: lookup(F.col(c), STRENGTH, -1)
    problem = F.coalesce(
        confidence_problem(F.col("confidence"), F.lit(None).cast("string")),
        F.when(F.col("held").isNull(), F.concat(F.lit("unknown ids: "), F.coalesce("old", F.lit("null")))),
        F.when(strength("new_tier") < 0, F.concat(F.lit("unknown entrenchment "), "new_tier")),
        F.when(strength("new_tier") < strength("old_tier"), F.concat("new_tier", F.lit(" can't supersede "), "old_tier")),
    )
    own = with_tiers(drafts, beliefs).select(F.col("old").alias("key"), problem.alias("problem")).where("problem is not null")
    twice = drafts.groupBy("old").agg(F.count("*").alias("n")).where("n > 1").select(F.col("old").alias("key"), F.lit("superseded twice").alias("problem"))
    return own.unionByName(twice)


def superseding(ctx: Context, drafts: DataFrame, beliefs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows to add, the old beliefs in their new state). The old belief's window stays as it is."""
    rows = with_tiers(drafts, beliefs).withColumn("id", mint("bel", ctx, "supersede", F.col("old"))).withColumn("entrenchment", F.col("new_tier"))
    rows = rows.withColumn("retrieval_provenance", F.lit(None).cast("string"))
    link = rows.select(F.col("old").alias("superseded"), F.col("id").alias("superseding"), "reason", at(ctx).alias("created_at"))
    flipped = beliefs.join(drafts.select(F.col("old").alias("belief_id")).distinct(), "belief_id", "left_semi").withColumn("belief_state", F.lit("superseded"))
    return beliefs_of(ctx, rows) | {"supersession": link}, flipped


def contest_problems(claims: DataFrame, beliefs: DataFrame) -> DataFrame:
    """claims: key, claim, condition."""
    few = claims.groupBy(F.col("key").cast("string").alias("key")).agg(F.countDistinct("claim").alias("n")).where("n < 2").select("key", F.lit("a contradiction needs two different claims").alias("problem"))
    return few.unionByName(unknown(claims, "claim", beliefs.select(F.col("belief_id").alias("id"))))


def contested(ctx: Context, claims: DataFrame) -> dict[str, DataFrame]:
    """An anomaly for each key, with its claims; their state doesn't change."""
    rows = claims.withColumn("id", mint("anom", ctx, "contest", F.col("key")))
    return {
        "anomaly": rows.groupBy(F.col("id").alias("anomaly_id")).agg(F.min("condition").alias("condition")),
        "contradiction_claim": rows.select(F.col("id").alias("rel_id"), "claim").distinct(),
    }


def resolved(ctx: Context, outcomes: DataFrame, predictions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """outcomes: belief_id, outcome. (an episode for each, the predictions of these beliefs with their open ones closed); the
    episode is written even if there is no prediction."""
    rows = outcomes.withColumn("id", mint("ep", ctx, "resolve", F.col("belief_id")))
    add = {
        "episode": rows.select(F.col("id").alias("episode_id"), F.lit("episode").alias("type"), F.concat(F.lit("prediction resolved: "), "outcome").alias("title"), at(ctx).alias("event_time"), at(ctx).alias("ingest_time"), F.lit(None).cast("string").alias("consolidation_state")),
        "ownership": rows.select(F.col("id").alias("owned"), F.lit(ctx.actor).alias("owner"), F.lit(None).cast("string").alias("visibility")),
    }
    held = predictions.withColumnRenamed("outcome", "old").join(rows.select("belief_id", "outcome", "id"), "belief_id")
    is_open = F.col("old").isNull()
    return add, held.select("belief_id", "p", F.when(is_open, F.col("outcome")).otherwise(F.col("old")).alias("outcome"), F.when(is_open, F.col("id")).otherwise(F.col("episode_id")).alias("episode_id"))


def retrieved(ctx: Context, own: str, candidates: DataFrame) -> dict[str, DataFrame]:
    """The event of a recall, its method and how many candidates passed the gate, and a surfaced row for each (belief_id, similarity)."""
    n = candidates.agg(F.count("*").alias("candidate_count"))
    return {
        "episode": n.select(F.lit(own).alias("episode_id"), F.lit("retrieval-event").alias("type"), F.lit("retrieval").alias("title"), at(ctx).alias("event_time"), at(ctx).alias("ingest_time"), F.lit("semantic").alias("method"), "candidate_count"),
        "surfaced": candidates.select(F.lit(ctx.run_id).alias("run_id"), F.lit(own).alias("retrieval"), F.col("belief_id").alias("concept_id"), "similarity", F.lit(False).alias("was_used")),
    }


def claims_of(ctx: Context, claims: DataFrame) -> DataFrame:
    """Drafts for detection claims (key, logic, technique, method, confidence)."""
    number = F.regexp_replace(F.col("confidence").cast("string"), r"\.0$", "")
    text = F.concat(F.lit("detection '"), "logic", F.lit("' detects technique '"), "technique", F.lit("' (confidence "), number, F.lit(")"))
    return claims.select("key", text.alias("title"), "confidence", F.lit("private").alias("visibility"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), "method")


def verdicts_of(ctx: Context, verdicts: DataFrame) -> DataFrame:
    """Drafts for verdicts on alerts (key, logic, verdict): human assertions without a confidence."""
    text = F.concat(F.lit("disposition of detection '"), "logic", F.lit("': "), "verdict")
    return verdicts.select("key", text.alias("title"), F.lit(None).cast("double").alias("confidence"), F.lit("private").alias("visibility"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("human-assertion").alias("method"))


METHODS = [*METHOD_RANK]
