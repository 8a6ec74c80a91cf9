"""What an extension brings (types, relations that beliefs write, functions), and the one for detection engineering."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import detection
from tessera.operators import writes as W
from tessera.operators.writes import Context
from tessera.plans.writes import Draft, EdgeDeclaration, EdgeRegistry, Writer
from tessera.schema import ENUMS
from tessera.store import Snapshot, Store


class Extension(Protocol):
    name: str
    types: dict[str, str | None]
    edges: list[EdgeDeclaration]
    functions: dict[str, Callable]

    def on_init(self, store: Store) -> None: ...


def registry(extensions: Iterable[Extension]) -> EdgeRegistry:
    """The declarations of all extensions, checked together; names are unique."""
    extensions = [*extensions]
    if len({e.name for e in extensions}) < len(extensions):
        raise ValueError("two extensions of one name")
    return EdgeRegistry([d for e in extensions for d in e.edges], {e.name: e.types for e in extensions})


def writer(store: Store, extensions: Iterable[Extension]) -> Writer:
    extensions = [*extensions]
    out = Writer(store, registry(extensions))
    for e in extensions:
        e.on_init(store)
    return out


class Detection:
    """Claims that a piece of logic detects a technique, verdicts on its alerts, and what follows from both."""

    name = "cyber"
    types: dict[str, str | None] = {}
    edges = [
        EdgeDeclaration("technique-detection", "detection-claim", ["detection-claim", "detecting-logic", "detected-technique"], players={"detecting-logic": "concept", "detected-technique": "attack-pattern"}, keys={"detected-technique": "attack_id"}, extension="cyber"),
        EdgeDeclaration("alert-disposition", "disposition-belief", ["disposition-belief", "dispositioned-logic"], {"detection-verdict": str}, ["detection-verdict"], {"dispositioned-logic": "concept"}, extension="cyber"),
    ]

    def __init__(self):
        self.functions = {"claim": claim, "disposition": disposition, "coverage_gaps": coverage_gaps, "blinded": blinded, "precision": precision}

    def on_init(self, store: Store) -> None:
        pass


def claim(writer: Writer, ctx: Context, logic_id: str, technique_id: str, method: str, confidence: float, evidence: list[str] = ()) -> str:
    """A belief that the logic (a concept) detects the technique (an attack id), with its edge."""
    number = f"{confidence:g}" if float(confidence).is_integer() else repr(float(confidence))
    draft = Draft(f"detection '{logic_id}' detects technique '{technique_id}' (confidence {number})", float(confidence))
    return writer.assert_belief(ctx, draft, [*evidence], method, [("technique-detection", {"detecting-logic": logic_id, "detected-technique": technique_id}, {})])


def disposition(writer: Writer, ctx: Context, logic_id: str, verdict: str, evidence: list[str] = ()) -> str:
    """An analyst's verdict on an alert of the logic, as a belief with its edge."""
    if verdict not in ENUMS["detection_verdict"]:
        raise ValueError(f"unknown verdict {verdict}")
    draft = Draft(f"disposition of detection '{logic_id}': {verdict}")
    return writer.assert_belief(ctx, draft, [*evidence], "human-assertion", [("alert-disposition", {"dispositioned-logic": logic_id}, {"detection-verdict": verdict})])


def claim_all(writer: Writer, ctx: Context, claims: DataFrame, evidence: DataFrame) -> None:
    """Many claims in one commit: key, logic, technique, method, confidence; evidence: key, source. All logic and techniques must be stored."""
    _, have = writer.store.snapshot()
    concepts = have["concept"]
    logic = W.unknown(claims, "logic", concepts.select(F.col("concept_id").alias("id")))
    techniques = W.unknown(claims, "technique", concepts.where("type = 'attack-pattern'").select(F.col("attack_id").alias("id")))
    writer.refuse(logic.union(techniques))
    players = F.create_map(F.lit("detecting-logic"), "logic", F.lit("detected-technique"), "technique")
    edges = claims.select("key", F.lit("technique-detection").alias("relation"), players.alias("players"), F.expr("cast(map() as map<string,string>)").alias("attributes"))
    writer.assert_all(ctx, W.claims_of(ctx, claims), evidence, edges)


def disposition_all(writer: Writer, ctx: Context, verdicts: DataFrame, evidence: DataFrame) -> None:
    """Many verdicts in one commit: key, logic, verdict; evidence: key, source."""
    _, have = writer.store.snapshot()
    logic = W.unknown(verdicts, "logic", have["concept"].select(F.col("concept_id").alias("id")))
    odd = verdicts.where(~F.col("verdict").isin(*ENUMS["detection_verdict"])).select(F.col("key").cast("string").alias("key"), F.concat(F.lit("unknown verdict "), "verdict").alias("problem"))
    writer.refuse(logic.union(odd))
    edges = verdicts.select("key", F.lit("alert-disposition").alias("relation"), F.create_map(F.lit("dispositioned-logic"), "logic").alias("players"), F.create_map(F.lit("detection-verdict"), "verdict").alias("attributes"))
    writer.assert_all(ctx, W.verdicts_of(ctx, verdicts), evidence, edges)


def detections(have: Snapshot) -> DataFrame:
    """(detecting_logic, detected_technique, detection_claim)"""
    edges = have["belief_edge"].where("relation = 'technique-detection'")
    return edges.select(F.col("players")["detecting-logic"].alias("detecting_logic"), F.col("players")["detected-technique"].alias("detected_technique"), F.col("belief_id").alias("detection_claim"))


def dispositions(have: Snapshot) -> DataFrame:
    """(dispositioned_logic, disposition_belief, detection_verdict)"""
    edges = have["belief_edge"].where("relation = 'alert-disposition'")
    return edges.select(F.col("players")["dispositioned-logic"].alias("dispositioned_logic"), F.col("belief_id").alias("disposition_belief"), F.col("attributes")["detection-verdict"].alias("detection_verdict"))


def requirements(have: Snapshot) -> DataFrame:
    """(technique, required): the attack id of each technique and the components it needs."""
    names = have["concept"].select(F.col("concept_id").alias("target"), F.col("attack_id").alias("technique"))
    return have["typed_edge"].where("relation = 'requires-evidence'").join(names, "target").select("technique", F.col("source").alias("required"))


def coverage(have: Snapshot) -> DataFrame:
    return have["typed_edge"].where("relation = 'sensor-coverage'").select(F.col("source").alias("covering_sensor"), F.col("target").alias("covered_component"))


def coverage_gaps(writer: Writer, ctx: Context) -> DataFrame:
    _, have = writer.store.snapshot()
    techniques = have["concept"].where("type = 'attack-pattern'").select(F.col("attack_id").alias("technique"))
    return detection.undetected_techniques(techniques, detections(have), have["belief"])


def blinded(writer: Writer, ctx: Context) -> DataFrame:
    _, have = writer.store.snapshot()
    return detection.blinded_detections(detections(have), have["belief"], requirements(have), coverage(have))


def precision(writer: Writer, ctx: Context, logic_id: str, window: int) -> DataFrame:
    _, have = writer.store.snapshot()
    return detection.precision(dispositions(have).where(F.col("dispositioned_logic") == logic_id), have["belief"], ctx.now, window)
