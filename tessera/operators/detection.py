"""Detection coverage: techniques without a detection, detections without sight, precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.beliefs import Time, moment


def asserted_detections(detections: DataFrame, beliefs: DataFrame) -> DataFrame:
    live = beliefs.where("belief_state = 'asserted'").select(F.col("belief_id").alias("detection_claim"))
    return detections.join(live, "detection_claim", "left_semi")


def undetected_techniques(techniques: DataFrame, detections: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Techniques without an asserted detection claim; revoked ones count too."""
    known = asserted_detections(detections, beliefs).select(F.col("detected_technique").alias("technique"))
    return techniques.select("technique").distinct().join(known, "technique", "left_anti")


def blinded_detections(detections: DataFrame, beliefs: DataFrame, requires: DataFrame, coverage: DataFrame) -> DataFrame:
    """Detecting logic with an asserted claim on a technique that needs a component no sensor covers; one such component suffices."""
    blind = requires.join(coverage.select(F.col("covered_component").alias("required")), "required", "left_anti").select(F.col("technique").alias("detected_technique"))
    return asserted_detections(detections, beliefs).join(blind, "detected_technique", "left_semi").select("detecting_logic").distinct()


def precision(dispositions: DataFrame, beliefs: DataFrame, now: Time, window_seconds: int) -> DataFrame:
    """(detecting logic, true_positives, false_positives, precision) over verdicts of the trailing window, whatever the
    beliefs' state; benign ones don't count, later ones do; null precision without a verdict."""
    if window_seconds <= 0:
        raise ValueError("the window must be longer than nothing")
    start = moment(now) - F.make_dt_interval(secs=F.lit(window_seconds))
    recent = beliefs.where(F.col("valid_from") >= start).select(F.col("belief_id").alias("disposition_belief"))
    counted = dispositions.join(recent, "disposition_belief", "left_semi").groupBy(F.col("dispositioned_logic").alias("detecting_logic"))
    out = counted.agg(F.count_if(F.col("detection_verdict") == "true-positive").alias("true_positives"), F.count_if(F.col("detection_verdict") == "false-positive").alias("false_positives"))
    return out.withColumn("precision", F.try_divide("true_positives", F.col("true_positives") + F.col("false_positives")))
