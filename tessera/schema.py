"""Types, relations and enumerations of the graph, and validation of rows against them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each type's parent.
PARENTS = {
    "concept": None,
    "memory-item": "concept",
    "episode": "memory-item",
    "execution-episode": "episode",
    "retrieval-event": "execution-episode",
    "sighting": "execution-episode",
    "belief": "memory-item",
    "resolution": "belief",
    "divergence-exception": "belief",
    "anomaly": "memory-item",
    "playbook": "memory-item",
    "working-set": "memory-item",
    "intention": "memory-item",
    "learned-constraint": "memory-item",
    "cyber-object": "concept",
} | {
    t: "cyber-object"
    for t in ("attack-pattern", "intrusion-set", "threat-actor", "campaign", "malware", "tool", "indicator", "observable", "course-of-action", "data-source", "data-component", "host-asset", "sensor")
}
# Enumerations.
ENUMS = {
    "belief_state": ["asserted", "superseded", "contested", "retracted"],
    "entrenchment": ["axiom", "user-stated", "tool-derived", "inferred", "llm"],
    "visibility": ["private", "shared", "team"],
    "derivation_method": ["type-join", "cardinality", "functional-dependency", "type-db-function", "external-tool", "human-assertion", "llm-synthesis"],
    "detection_verdict": ["true-positive", "false-positive", "benign-true"],
}
# The roles of each relation and the type that plays there.
RELATIONS = {
    "derivation": {"derived": "memory-item", "source": "memory-item"},
    "supersession": {"superseded": "memory-item", "superseding": "memory-item"},
    "contradiction": {"claim": "memory-item"},
    "rests-on": {"resting": "memory-item", "assumption": "memory-item"},
    "ownership": {"owned": "memory-item", "owner": "agent"},
    "source-link": {"sourced": "memory-item", "run": "doc-run"},
    "prediction-resolution": {"predicted": "belief", "resolving": "episode"},
    "consolidation-step": {"step": "memory-item", "run": "doc-run"},
    "population-member": {"population": "population", "member": "concept"},
    "scoped": {"scoped-belief": "belief", "population": "population"},
    "resolves": {"resolution": "resolution", "record": "concept"},
    "surfaced": {"retrieval": "retrieval-event", "candidate": "concept"},
    "informs-synthesis": {"retrieval": "retrieval-event", "synthesized": "belief"},
    "containment": {"bundle": "bundle", "contained": "concept"},
    "hierarchy": {"parent": "concept", "child": "concept"},
    "concept-link": {"source": "concept", "target": "concept"},
    "citation": {"citing": "concept", "cited": "external-resource"},
    "technique-detection": {"detecting-logic": "concept", "detected-technique": "attack-pattern", "detection-claim": "belief"},
    "alert-disposition": {"dispositioned-logic": "concept", "disposition-belief": "belief"},
    "requires-evidence": {"technique": "attack-pattern", "required": "data-component"},
    "sensor-coverage": {"covering-sensor": "sensor", "covered-component": "data-component"},
}
LABEL = re.compile(r"^[A-Za-z][A-Za-z0-9_-]*$")


def label(text: str) -> str:
    """text, if it may stand as an identifier."""
    if not LABEL.match(text):
        raise ValueError(f"not a label: {text!r}")
    return text


def is_label(c: Column) -> Column:
    return c.rlike(LABEL.pattern)


def enum_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, name, value) for every value outside its enumeration."""
    values = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(c).isin(*ENUMS[c]).alias("fits")) for c in ENUMS if c in df.columns))
    return df.select(key, F.explode(values).alias("v")).where("v.value is not null and not v.fits").select(key, "v.name", "v.value")


def closure(root: str) -> list[str]:
    """The type and all its subtypes."""

    def below(t: str) -> list[str]:
        return [t, *(x for child, parent in PARENTS.items() if parent == t for x in below(child))]

    if root not in PARENTS:
        raise ValueError(f"unknown type {root}")
    return below(root)


def isa(df: DataFrame, root: str, exact: bool = False, column: str = "type") -> DataFrame:
    """Rows whose type is root, or unless exact, one of its subtypes."""
    return df.where(F.col(column) == root) if exact else df.where(F.col(column).isin(*closure(root)))


def belief_surface() -> dict[str, list[str]]:
    """The belief tier: memory items, and the relations with a role that only they play."""
    own = set(closure("memory-item"))
    return {"types": sorted(own), "relations": sorted(r for r, roles in RELATIONS.items() if any(p in own for p in roles.values()))}


def types_frame(spark) -> DataFrame:
    return spark.createDataFrame([(t, p) for t, p in PARENTS.items()], "type string, parent string")


def roles_frame(spark) -> DataFrame:
    return spark.createDataFrame([(r, role, p) for r, roles in RELATIONS.items() for role, p in roles.items()], "relation string, role string, player string")


def check_enums(df: DataFrame) -> None:
    """An error naming the first value outside its enumeration."""
    for column in [c for c in ENUMS if c in df.columns]:
        if bad := df.where(F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[column])).select(column).limit(1).collect():
            raise ValueError(f"{column} can't be {bad[0][0]!r}")


def check_key(df: DataFrame, key: str) -> None:
    if df.where(F.col(key).isNull()).take(1):
        raise ValueError(f"{key} is missing")
    if bad := df.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key} {bad[0][0]!r} isn't unique")
