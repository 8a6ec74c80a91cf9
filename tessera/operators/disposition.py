"""Ranking of conflicting claims by evidence: method, confidence, entrenchment, start of validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
METHOD_RANK = {"type-join": 2, "cardinality": 2, "functional-dependency": 2, "type-db-function": 1, "external-tool": 1, "human-assertion": 1, "llm-synthesis": 0}
STRENGTH = {"axiom": 4, "user-stated": 3, "tool-derived": 2, "inferred": 1, "llm": 0}
REASONS = {"method": "method rank", "confidence": "confidence", "entrenchment": "entrenchment", "valid_from": "recency"}


def lookup(value: Column, table: dict[str, int], absent: int) -> Column:
    out = F.lit(absent)
    for key, number in table.items():
        out = F.when(value == key, number).otherwise(out)
    return out


def method_rank(method: Column) -> Column:
    return lookup(method, METHOD_RANK, -1)


def effective_method(derivation: DataFrame) -> DataFrame:
    """(belief_id, method): the weakest method of each belief's derivations; ties go by name."""
    ranked = derivation.select(F.col("derived").alias("belief_id"), "derivation_method", method_rank(F.col("derivation_method")).alias("r"))
    return ranked.groupBy("belief_id").agg(F.min(F.struct("r", "derivation_method")).alias("m")).select("belief_id", F.col("m.derivation_method").alias("method"))


def keys(method: Column, confidence: Column, entrenchment: Column, valid_from: Column) -> dict[str, Column]:
    """The four keys, greatest first; absent and NaN confidence is 1.0 if the method is provable, else 0.5."""
    rank = method_rank(method)
    assumed = F.when(rank == 2, 1.0).otherwise(0.5)
    return {
        "method": rank,
        "confidence": F.when(confidence.isNull() | F.isnan(confidence), assumed).otherwise(confidence),
        "entrenchment": lookup(entrenchment, STRENGTH, 0),
        "valid_from": F.coalesce(valid_from, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")),
    }


def rank(competitors: DataFrame, group: str = "group_id") -> DataFrame:
    """The head of each group with ``contested`` (the next one equals it in all keys), ``reason`` (the first key that sets
    it apart, or sole competitor) and ``n``. Rows: group, belief_id, method, confidence, entrenchment, valid_from.

    Only the two best of a group are needed, so they are found by an aggregate of struct maxima, not by a window.
    """
    named = keys(F.col("method"), F.col("confidence"), F.col("entrenchment"), F.col("valid_from"))
    rows = competitors.select(group, F.struct(*(c.alias(k) for k, c in named.items())).alias("key"), "belief_id")
    heads = rows.groupBy(group).agg(F.max("key").alias("key"), F.count("*").alias("n"))
    first = rows.join(heads, [group, "key"]).groupBy(group, "key", "n").agg(F.min("belief_id").alias("belief_id"), F.count("*").alias("equal"))
    second = rows.join(heads.select(group, F.col("key").alias("top")), group).where(F.col("key") < F.col("top")).groupBy(group).agg(F.max("key").alias("next"))
    out = first.join(second, group, "left")
    reason = F.lit("tie")
    for k, text in reversed(REASONS.items()):
        reason = F.when(F.col(f"key.{k}") != F.col(f"next.{k}"), text).otherwise(reason)
    contested = F.col("equal") > 1
    return out.select(group, "belief_id", "n", contested.alias("contested"), F.when(F.col("n") == 1, "sole competitor").when(contested, "tie").otherwise(reason).alias("reason"))


def ordered(competitors: DataFrame, group: str = "group_id") -> DataFrame:
    """Every competitor with its place, for groups that fit a task."""
    named = keys(F.col("method"), F.col("confidence"), F.col("entrenchment"), F.col("valid_from"))
    order = Window.partitionBy(group).orderBy(*(c.desc() for c in named.values()), F.col("belief_id"))
    return competitors.withColumn("place", F.row_number().over(order))
