"""Populations: windowed membership rows (spec_hash, member, valid_from, valid_to, computed_at) and their passes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.beliefs import Time, in_window, moment

SKEW = dt.timedelta(minutes=5)
SPARK_SQL = "spark-sql"


def members(rows: DataFrame) -> DataFrame:
    """Current members: rows without an end, whatever their start."""
    return rows.where("valid_to is null").select("spec_hash", "member").distinct()


def members_at(rows: DataFrame, t: Time) -> DataFrame:
    return rows.where(in_window(F.col("valid_from"), F.col("valid_to"), t)).select("spec_hash", "member").distinct()


def define(populations: DataFrame, spec_hash: str, dialect: str, text: str) -> tuple[DataFrame, bool]:
    """(populations with this one, whether it is new). The same spec again changes nothing; another spec under the hash is an error."""
    if not (spec_hash.strip() and dialect.strip() and text.strip()):
        raise ValueError("a population needs a spec hash, a dialect and a text")
    held = populations.where(F.col("spec_hash") == spec_hash).select("spec_dialect", "spec_text").limit(2).collect()
    if held:
        if (held[0][0], held[0][1]) != (dialect, text):
            raise ValueError(f"population {spec_hash} has another spec")
        return populations, False
    row = populations.sparkSession.createDataFrame([(spec_hash, dialect, text)], "spec_hash string, spec_dialect string, spec_text string")
    return populations.unionByName(row, allowMissingColumns=True), True


def plan(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """(spec_hash, member, action) for requested (spec_hash, member) of the populations requested: open, close or refresh."""
    wanted = requested.select("spec_hash", "member").distinct().withColumn("wanted", F.lit(True))
    current = members(rows).join(wanted.select("spec_hash").distinct(), "spec_hash", "left_semi").withColumn("held", F.lit(True))
    both = wanted.join(current, ["spec_hash", "member"], "full_outer")
    action = F.when(F.col("held").isNull(), "open").when(F.col("wanted").isNull(), "close").otherwise("refresh")
    return both.select("spec_hash", "member", action.alias("action"))


def steps(rows: DataFrame, requested: DataFrame, at: Time) -> tuple[DataFrame, DataFrame]:
    """What a pass at ``at`` does: (new rows of members that come, or come back; all rows of the members that stay or go, after it).
    Closing sets end and computed_at of the open row, refreshing only its computed_at."""
    planned = plan(rows, requested)
    held = rows.join(planned.where("action <> 'open'"), ["spec_hash", "member"])
    touched = F.col("valid_to").isNull()
    changed = held.select(
        "spec_hash",
        "member",
        "valid_from",
        F.when(touched & (F.col("action") == "close"), moment(at)).otherwise(F.col("valid_to")).alias("valid_to"),
        F.when(touched, moment(at)).otherwise(F.col("computed_at")).alias("computed_at"),
    )
    opened = planned.where("action = 'open'").select("spec_hash", "member", moment(at).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), moment(at).alias("computed_at"))
    return opened, changed


def materialize(rows: DataFrame, requested: DataFrame, at: Time) -> DataFrame:
    """The membership rows after a pass at ``at``."""
    opened, changed = steps(rows, requested, at)
    kept = rows.join(plan(rows, requested).where("action <> 'open'"), ["spec_hash", "member"], "left_anti")
    return kept.unionByName(changed).unionByName(opened)


def latest(rows: DataFrame) -> DataFrame:
    """(latest): the last time that any row tells of."""
    return rows.agg(F.max(F.greatest("valid_from", "valid_to", "computed_at")).alias("latest"))


def check_pass(rows: DataFrame, requested: DataFrame, at: dt.datetime, now: dt.datetime, populations: DataFrame | None = None, concepts: DataFrame | None = None) -> None:
    """The guards of a pass: known population, no blank member, not older than what is recorded, at most five minutes ahead of now, new members stored."""
    if at > now + SKEW:
        raise ValueError("the pass lies in the future")
    asked = requested.select("spec_hash").distinct()
    if populations is not None and (lost := asked.join(populations, "spec_hash", "left_anti").limit(5).collect()):
        raise ValueError(f"unknown populations: {[r[0] for r in lost]}")
    if requested.where("member is null or trim(member) = ''").take(1):
        raise ValueError("a member id is blank")
    last = latest(rows.join(asked, "spec_hash", "left_semi")).first()[0]
    if last is not None and at < last:
        raise ValueError("the pass is older than one recorded")
    if concepts is not None:
        opened = plan(rows, requested).where("action = 'open'").select(F.col("member").alias("concept_id"))
        if lost := opened.join(concepts, "concept_id", "left_anti").limit(5).collect():
            raise ValueError(f"members that aren't stored: {[r[0] for r in lost]}")


def report(rows: DataFrame, requested: DataFrame) -> dict[str, int]:
    """How many rows a pass opens, closes and refreshes."""
    counts = {r["action"]: r["count"] for r in plan(rows, requested).groupBy("action").count().collect()}
    return {a: counts.get(a, 0) for a in ("open", "close", "refresh")}


def close_one(rows: DataFrame, spec_hash: str, member: str, at: Time) -> tuple[DataFrame, bool]:
    """End the open row of one member; False if there is none."""
    mine = (F.col("spec_hash") == spec_hash) & (F.col("member") == member) & F.col("valid_to").isNull()
    found = bool(rows.where(mine).take(1))
    return rows.withColumns({"computed_at": F.when(mine, moment(at)).otherwise(F.col("computed_at")), "valid_to": F.when(mine, moment(at)).otherwise(F.col("valid_to"))}), found


def strict(concepts: DataFrame, dialect: str, text: str) -> DataFrame:
    """What the stored predicate selects now; foreign dialects can't be run."""
    if dialect != SPARK_SQL:
        raise ValueError(f"dialect {dialect} can't be evaluated")
    return concepts.where(F.expr(text))
