"""Writes of the belief tier to a store: each call checks its guards and commits all its rows or none.

Every write takes a batch (``*_all``, DataFrames of requests) and is one commit that adds its own rows and replaces those
that change; the single forms are batches of one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import jobs, populations
from tessera.operators import writes as W
from tessera.operators.writes import Context
from tessera.schema import check_enums, closure, label
from tessera.session import scratch, stored
from tessera.store import Snapshot, Store

__all__ = ["Context", "Draft", "EdgeDeclaration", "EdgeRegistry", "Writer", "guest_arguments"]

# Fixed values.
ORIGIN = {"observe": "observation", "assert": "assertion", "consolidation": "consolidation"}
RESERVED = ("run_id", "actor", "source", "occurred_at")
DRAFTS = "key string, title string, confidence double, visibility string, valid_to timestamp_ntz, method string"
KEYS = {"belief": "belief_id", "episode": "episode_id", "agent": "agent_id", "doc_run": "run_id", "anomaly": "anomaly_id"}


@dataclass
class Draft:
    title: str
    confidence: float | None = None
    visibility: str | None = "private"
    entrenchment: str | None = None
    valid_to: dt.datetime | None = None


@dataclass
class EdgeDeclaration:
    """A relation that a belief may write: its roles (one of them the belief's) with the type that plays there and the key
    that names it, and its attributes, some of them required."""

    relation: str
    belief_role: str
    roles: list[str]
    attributes: dict[str, type] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    players: dict[str, str] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    extension: str = ""

    def __post_init__(self):
        for x in (self.relation, self.belief_role, *self.roles, *self.attributes, *self.players.values()):
            label(x)
        if len({*self.roles}) < len(self.roles):
            raise ValueError(f"{self.relation} has a role twice")


class EdgeRegistry(dict):
    """Declarations by relation. A relation belongs to one extension; extensions may add types, but not give a type that is
    there another parent; players must be known types that aren't memory items."""

    def __init__(self, declarations: Iterable[EdgeDeclaration] = (), types: dict[str, dict[str, str | None]] | None = None):
        from tessera.schema import PARENTS

        parents, owner = dict(PARENTS), {}
        for extension, own in (types or {}).items():
            for name, parent in own.items():
                label(name)
                if name in parents and parents[name] != parent:
                    raise ValueError(f"{extension} gives {name} another parent")
                if owner.setdefault(name, extension) != extension:
                    raise ValueError(f"{extension} and {owner[name]} both define {name}")
                parents[name] = parent
        for name in parents:  # every chain ends in a root
            seen, at = set(), name
            while at is not None:
                if at in seen or at not in parents:
                    raise ValueError(f"{name} has no root")
                seen.add(at)
                at = parents[at]
        memory = {*closure("memory-item")} | {t for t in parents if self._below(t, "memory-item", parents)}
        for d in declarations:
            if d.relation in self:
                raise ValueError(f"two declarations of one relation: {d.relation}")
            for role, player in d.players.items():
                if role not in d.roles or role == d.belief_role:
                    raise ValueError(f"{d.relation} has no role {role} to play")
                if player not in parents:
                    raise ValueError(f"{player} isn't a type")
                if player in memory:
                    raise ValueError(f"{player} is a memory item and can't play {role}")
            self[d.relation] = d
        aliases = [(d.relation, r) for d in self.values() for r in d.roles if r in self]
        if aliases:
            raise ValueError(f"a role of {aliases[0][0]} has the name of the relation {aliases[0][1]}")

    @staticmethod
    def _below(name: str, root: str, parents: dict[str, str | None]) -> bool:
        while name is not None and name != root:
            name = parents[name]
        return name == root


def guest_arguments(arguments: dict) -> dict:
    """What a caller may say; identity and time come from the context."""
    return {k: v for k, v in arguments.items() if k not in RESERVED}


class Writer:
    def __init__(self, store: Store, edges: Iterable[EdgeDeclaration] = ()):
        self.store, self.spark = store, store.spark
        self.edges = edges if isinstance(edges, EdgeRegistry) else EdgeRegistry(edges)

    # The parts that all writes share.

    @staticmethod
    def memory_items(have: Snapshot, beliefs_only: bool = False) -> DataFrame:
        known = have["belief"].select(F.col("belief_id").alias("id"))
        return known if beliefs_only else known.union(have["episode"].select("episode_id")).union(have["anomaly"].select("anomaly_id"))

    @staticmethod
    def refuse(problems: DataFrame) -> None:
        if found := problems.orderBy("problem", "key").limit(20).collect():
            raise ValueError("; ".join(dict.fromkeys(r["problem"] for r in found)))

    def _publish(self, ctx: Context, base: int, have: Snapshot, adds: dict[str, DataFrame], patches: dict[str, tuple[DataFrame, list[str]]] | None = None) -> None:
        """The rows, and the run and the agent if they aren't there yet. Ids must be new."""
        adds = dict(adds)
        for table, key, row in (("doc_run", "run_id", (ctx.run_id, ctx.actor, ctx.now)), ("agent", "agent_id", (ctx.actor,))):
            if not have[table].where(F.col(key) == row[0]).take(1):
                adds[table] = self.spark.createDataFrame([row], have[table].schema)
        with scratch(self.spark):
            kept = {t: stored(df, "adds") for t, df in adds.items()}
            for table, df in kept.items():
                check_enums(df)
                if key := KEYS.get(table):
                    again = df.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").select(key)
                    if bad := again.union(df.join(have[table].select(key), key, "left_semi").select(key)).limit(1).collect():
                        raise ValueError(f"{key} {bad[0][0]!r} isn't unique")
            self.store.commit({}, base, adds=kept, patches=patches)

    # Batches.

    def observe_all(self, ctx: Context, events: DataFrame) -> None:
        """events: key, text, event_time, ingest_time."""
        base, have = self.store.snapshot()
        self._publish(ctx, base, have, W.observed(ctx, events))

    def assert_all(self, ctx: Context, drafts: DataFrame, evidence: DataFrame, edges: DataFrame | None = None) -> None:
        """drafts: key, title, confidence, visibility, valid_to, method; evidence: key, source; edges: key, relation, players, attributes."""
        base, have = self.store.snapshot()
        self.refuse(W.assert_problems(drafts, evidence, self.memory_items(have)))
        adds = W.asserted(ctx, drafts, evidence, have["surfaced"])
        if edges is not None:
            adds["belief_edge"] = edges.select("relation", W.mint("bel", ctx, "assert", F.col("key")).alias("belief_id"), "players", "attributes")
        marked = W.used(ctx, evidence, have["surfaced"])
        self._publish(ctx, base, have, adds, {"surfaced": (marked, ["run_id", "retrieval", "concept_id"])} if marked.take(1) else None)

    def supersede_all(self, ctx: Context, drafts: DataFrame) -> None:
        """drafts: old, title, confidence, entrenchment, visibility, valid_to, reason."""
        base, have = self.store.snapshot()
        self.refuse(W.supersede_problems(drafts, have["belief"]))
        adds, flipped = W.superseding(ctx, drafts, have["belief"])
        self._publish(ctx, base, have, adds, {"belief": (flipped, ["belief_id"])})

    def contest_all(self, ctx: Context, claims: DataFrame) -> None:
        """claims: key, claim, condition."""
        base, have = self.store.snapshot()
        self.refuse(W.contest_problems(claims, have["belief"]))
        self._publish(ctx, base, have, W.contested(ctx, claims))

    def rest_all(self, ctx: Context, pairs: DataFrame) -> None:
        """pairs: resting, assumption."""
        base, have = self.store.snapshot()
        ends = pairs.select(F.col("resting").alias("key"), F.explode(F.array("resting", "assumption")).alias("id"))
        self.refuse(W.unknown(ends, "id", self.memory_items(have)))
        self._publish(ctx, base, have, {"rests_on": pairs.select("resting", "assumption").distinct()})

    def predict_all(self, ctx: Context, predictions: DataFrame) -> None:
        """predictions: belief_id, p (any number)."""
        base, have = self.store.snapshot()
        self.refuse(W.unknown(predictions.withColumn("key", F.col("belief_id")), "belief_id", self.memory_items(have, True)))
        self._publish(ctx, base, have, {"prediction": predictions.select("belief_id", "p")})

    def resolve_all(self, ctx: Context, outcomes: DataFrame) -> None:
        """outcomes: belief_id, outcome."""
        base, have = self.store.snapshot()
        self.refuse(W.unknown(outcomes.withColumn("key", F.col("belief_id")), "belief_id", self.memory_items(have, True)))
        adds, closed = W.resolved(ctx, outcomes, have["prediction"])
        self._publish(ctx, base, have, adds, {"prediction": (closed, ["belief_id"])} if closed.take(1) else None)

    # One at a time.

    def _one(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def _id(self, kind: str, ctx: Context, act: str, key: str) -> str:
        return self._one("key string", key).select(W.mint(kind, ctx, act, F.col("key"))).first()[0]

    def observe(self, ctx: Context, text: str, event_time: dt.datetime, ingest_time: dt.datetime | None = None) -> str:
        key = repr((text, event_time))
        self.observe_all(ctx, self._one("key string, text string, event_time timestamp_ntz, ingest_time timestamp_ntz", key, text, event_time, ingest_time))
        return self._id("ep", ctx, "observe", key)

    def assert_belief(self, ctx: Context, draft: Draft, evidence: list[str], method: str, edges: Iterable[tuple[str, dict, dict]] = ()) -> str:
        """A belief, one derivation from its evidence, and declared edges (relation, players, attributes)."""
        key = repr((draft.title, draft.confidence, *evidence))
        sources = self.spark.createDataFrame([(key, e) for e in dict.fromkeys(evidence)], "key string, source string")
        checked = [(key, *self._edge(*e)) for e in edges]
        rows = self.spark.createDataFrame(checked, "key string, relation string, players map<string,string>, attributes map<string,string>") if checked else None
        self.assert_all(ctx, self._one(DRAFTS, key, draft.title, draft.confidence, draft.visibility, draft.valid_to, method), sources, rows)
        return self._id("bel", ctx, "assert", key)

    def _edge(self, relation: str, players: dict, attributes: dict) -> tuple[str, dict, dict]:
        if relation not in self.edges:
            raise ValueError(f"relation {relation} isn't declared")
        d = self.edges[relation]
        if sorted(players) != sorted(r for r in d.roles if r != d.belief_role):
            raise ValueError(f"{relation} needs each of the roles {d.roles} once")
        if lost := [a for a in d.required if attributes.get(a) is None]:
            raise ValueError(f"{relation} needs {lost}")
        for name, value in attributes.items():
            if name not in d.attributes or not isinstance(value, d.attributes[name]):
                raise ValueError(f"{relation} has no attribute {name} of {type(value).__name__}")
        concepts = self.store.read("concept")
        for role, player in players.items():
            held = concepts.where(F.col(d.keys.get(role, "concept_id")) == player)
            if role in d.players:
                held = held.where(F.col("type").isin(*closure(d.players[role])))
            if not held.take(1):
                raise ValueError(f"unknown players: {player!r} as {role}")
        return relation, players, {k: str(v) for k, v in attributes.items()}

    def supersede(self, ctx: Context, old: str, draft: Draft, reason: str) -> str:
        """A belief in place of an old one, whose tier it must reach."""
        self.supersede_all(ctx, self._one("old string, title string, confidence double, entrenchment string, visibility string, valid_to timestamp_ntz, reason string", old, draft.title, draft.confidence, draft.entrenchment, draft.visibility, draft.valid_to, reason))
        return self._id("bel", ctx, "supersede", old)

    def contest(self, ctx: Context, claims: list[str], condition: str) -> str:
        key = repr(sorted({*claims}))
        if not claims:
            raise ValueError("a contradiction needs two different claims")
        self.contest_all(ctx, self.spark.createDataFrame([(key, c, condition) for c in claims], "key string, claim string, condition string"))
        return self._id("anom", ctx, "contest", key)

    def rests_on(self, ctx: Context, resting: str, assumptions: list[str]) -> None:
        if not assumptions:
            raise ValueError("no assumption is given")
        self.rest_all(ctx, self.spark.createDataFrame([(resting, a) for a in assumptions], "resting string, assumption string"))

    def record_prediction(self, ctx: Context, belief: str, p: float) -> None:
        self.predict_all(ctx, self._one("belief_id string, p double", belief, p))

    def resolve_prediction(self, ctx: Context, belief: str, outcome: str) -> str:
        """An episode of the outcome, linked to the belief's open predictions; it is written even if there are none."""
        self.resolve_all(ctx, self._one("belief_id string, outcome string", belief, outcome))
        return self._id("ep", ctx, "resolve", belief)

    def record_retrieval(self, ctx: Context, candidates: DataFrame) -> str:
        """The event of a recall with all gated candidates (belief_id, similarity), before the best are cut off."""
        base, have = self.store.snapshot()
        own = self._id("ep", ctx, "retrieval", str(base))
        adds = W.retrieved(ctx, own, candidates) | {"ownership": self._one("owned string, owner string, visibility string", own, ctx.actor, None)}
        self._publish(ctx, base, have, adds)
        return own

    # Populations.

    def define_population(self, spec_hash: str, dialect: str, text: str) -> bool:
        """Whether the population is new; another spec under its hash is an error."""
        base, have = self.store.snapshot()
        defined, new = populations.define(have["population"], spec_hash, dialect, text)
        if new:
            self.store.commit({}, base, adds={"population": defined.where(F.col("spec_hash") == spec_hash)})
        return new

    def materialize_population(self, requested: DataFrame, at: dt.datetime, now: dt.datetime) -> dict[str, int]:
        """One pass over the populations in requested (spec_hash, member): guards, plan and rows in one commit; how many rows it opened, closed and refreshed."""
        base, have = self.store.snapshot()
        populations.check_pass(have["population_member"], requested, at, now, have["population"], have["concept"].select("concept_id"))
        opened, changed = populations.steps(have["population_member"], requested, at)
        counts = populations.report(have["population_member"], requested)
        if any(counts.values()):
            self.store.commit({}, base, adds={"population_member": opened}, patches={"population_member": (changed, ["spec_hash", "member"])})
        return counts

    def close_membership(self, spec_hash: str, member: str, at: dt.datetime, now: dt.datetime) -> bool:
        """End the open row of one member; False if there is none."""
        base, have = self.store.snapshot()
        own = have["population_member"].where((F.col("spec_hash") == spec_hash) & (F.col("member") == member))
        populations.check_pass(have["population_member"], self._one("spec_hash string, member string", spec_hash, member), at, now, have["population"])
        closed, found = populations.close_one(own, spec_hash, member, at)
        if found:
            self.store.commit({}, base, patches={"population_member": (closed, ["spec_hash", "member"])})
        return found

    # Consolidation.

    def tick(self, now: dt.datetime, actor: str = "consolidation-daemon") -> dict:
        """One pass of episode deduplication: losers become tombstones, with a step each, in one run; without losers nothing is written."""
        ctx = Context(f"{actor}/{now.isoformat()}", actor, now, ORIGIN["consolidation"])
        base, have = self.store.snapshot()
        owners = have["ownership"].select(F.col("owned").alias("episode_id"), "owner")
        resolving = have["prediction"].where("episode_id is not null").select("episode_id")
        with scratch(self.spark):
            losers = stored(jobs.dedup_episodes(have["episode"], owners, resolving), "losers")
            n = losers.count()
            if n:
                gone = have["episode"].join(losers, "episode_id", "left_semi").withColumn("consolidation_state", F.lit("tombstoned"))
                steps = losers.select(F.lit(ctx.run_id).alias("run_id"), "episode_id", F.lit("tombstone").alias("action"))
                self._publish(ctx, base, have, {"consolidation_step": steps}, {"episode": (gone, ["episode_id"])})
        return {"run_id": ctx.run_id if n else None, "episodes_deduped": n}
