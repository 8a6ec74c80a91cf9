"""Syncing a bundle's concepts into the store in one commit, and reads of the record tier."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import jobs, sync
from tessera.schema import closure
from tessera.session import scratch, stored
from tessera.sources import bundle as source
from tessera.sources import stix
from tessera.store import Store

#: Tables of the belief tier; a sync may not change how many rows they have.
BELIEF_TIER = ["belief", "episode", "anomaly", "ownership", "source_link", "derivation", "supersession", "contradiction_claim", "rests_on", "prediction", "surfaced", "informs_synthesis", "population_member", "belief_edge"]


class Collision(ValueError):
    """The bundle has ids that others hold."""


class BeliefTierChanged(RuntimeError):
    """A sync may not change what the belief tier has."""


def belief_players(have: dict[str, DataFrame]) -> DataFrame:
    """(concept_id): concepts that play in a relation of the belief tier."""
    from_edges = have["belief_edge"].select(F.explode(F.map_values("players")).alias("concept_id"))
    return have["population_member"].select(F.col("member").alias("concept_id")).union(have["surfaced"].select("concept_id")).union(from_edges).distinct()


def _contents(concepts: DataFrame) -> DataFrame:
    meta = F.when(F.size("extra_metadata") > 0, F.to_json("extra_metadata")) if "extra_metadata" in concepts.columns else F.col("metadata_json") if "metadata_json" in concepts.columns else F.lit(None).cast("string")
    hint = F.coalesce(F.col("type_hint"), F.lit("concept")) if "type_hint" in concepts.columns else F.lit("concept")
    extra = {"type": hint, "metadata_json": meta, "retired_at": F.lit(None).cast("timestamp_ntz")}
    return concepts.withColumns(extra)


def sync_bundle(store: Store, concepts: DataFrame, name: str, path: str | None, now: dt.datetime, description: str | None = None, links: DataFrame | None = None, typed: DataFrame | None = None) -> dict[str, int]:
    """Bring what the store holds of the bundle in line with its concepts, and say how many were touched.

    Ids that another bundle (or none) holds refuse the whole sync. Unchanged hashes are skipped. What the bundle dropped is
    released if others contain it, retired if the belief tier refers to it (once; it keeps its id and its place), else
    deleted. Updated concepts lose their outgoing links and citations and get the new ones; links and hierarchy need both
    ends in the bundle. Typed edges (source, target, relation) are added once; those of a deleted or retired concept go.
    Everything is one commit, which isn't published if it would change the belief tier. Concepts without bodies have no
    links, citations or hierarchy of their own.
    """
    concepts = concepts.dropDuplicates(["concept_id"])
    base, have = store.snapshot()
    before = jobs.fingerprint({(t, "rows"): have[t] for t in BELIEF_TIER})
    held = have["concept"].join(have["containment"], "concept_id", "left").select("concept_id", "file_hash", "bundle_name")
    if clash := sync.collisions(concepts, held, name).orderBy("concept_id").limit(20).collect():
        raise Collision(f"bundle {name}: ids held elsewhere: {[r[0] for r in clash]}")
    if "type_hint" in concepts.columns and (bad := concepts.where(F.col("type_hint").isNotNull() & ~F.col("type_hint").isin(*closure("concept"))).limit(1).collect()):
        raise ValueError(f"{bad[0]['type_hint']} isn't a concept type")
    plan = sync.plan_sync(concepts, held, name).cache()
    pick = lambda *actions: plan.where(F.col("action").isin(*actions)).select("concept_id")
    fates = sync.split_gc(pick("delete"), have["containment"], name)
    ends = sync.retire_or_delete(fates.where("fate = 'delete'"), belief_players(have))
    retired_before = have["concept"].where("retired_at is not null").select("concept_id")
    retire = ends.where("fate = 'retire'").select("concept_id").join(retired_before, "concept_id", "left_anti").cache()
    delete = ends.where("fate = 'delete'").select("concept_id").cache()
    release = fates.where("fate = 'release'").select("concept_id").cache()
    written = pick("insert", "update")

    kept = have["concept"].join(pick("update"), "concept_id", "left_anti").join(delete, "concept_id", "left_anti")
    flag = retire.withColumn("goes", F.lit(True))
    kept = kept.join(flag, "concept_id", "left")
    gone = F.coalesce("goes", F.lit(False))
    emptied = {c: F.when(~gone, F.col(c)) for c in kept.columns if c not in ("concept_id", "type", "retired_at", "goes")}
    kept = kept.withColumns(emptied | {"retired_at": F.when(gone, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("retired_at"))}).drop("goes")
    fresh = _contents(concepts.join(written, "concept_id", "left_semi"))
    fresh = fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns))
    inside = have["containment"].join(delete, "concept_id", "left_anti")
    inside = inside.join(release.withColumn("bundle_name", F.lit(name)), ["bundle_name", "concept_id"], "left_anti")
    placed = written.select(F.lit(name).alias("bundle_name"), "concept_id")
    dropped = delete.union(retire)

    def without(table: str, *columns: str) -> DataFrame:
        df = have[table]
        for c in columns:
            df = df.join(dropped.withColumnRenamed("concept_id", c), c, "left_anti")
        return df.select(have[table].columns)

    cleared = pick("update").withColumnRenamed("concept_id", "source_id")
    texts = "body" in concepts.columns
    none = lambda schema: store.spark.createDataFrame([], schema)
    found = links if links is not None else source.links(concepts) if texts else none("source_id string, target_id string, link_text string")
    found = sync.within(found, concepts, "source_id", "target_id").cache()
    cited = (source.citations(concepts) if texts else none("source_id string, target_url string, link_text string")).cache()
    edges = source.hierarchy(concepts, within_bundle=True) if texts else none("parent_id string, child_id string")
    old_links = without("concept_link", "source_id", "target_id").join(cleared, "source_id", "left_anti").select(have["concept_link"].columns)
    old_citations = without("citation", "source_id").join(cleared, "source_id", "left_anti").select(have["citation"].columns)
    old_edges = without("hierarchy", "parent_id", "child_id")
    bundles = have["bundle"]
    if not bundles.where(F.col("bundle_name") == name).take(1):  # path and description are set once
        bundles = bundles.unionByName(store.spark.createDataFrame([(name, path, name, description)], "bundle_name string, bundle_path string, title string, description string"))
    old_typed = without("typed_edge", "source", "target")
    new_typed = sync.missing_from(typed, old_typed, ["source", "target", "relation"]) if typed is not None else none("source string, target string, relation string")
    new_typed = new_typed.cache()

    def guard(after) -> None:
        if changed := jobs.fingerprint_changes(before, jobs.fingerprint({(t, "rows"): after[t] for t in BELIEF_TIER})).collect():
            raise BeliefTierChanged(f"the sync would change the belief tier: {[r.asDict() for r in changed]}")

    store.commit(
        {
            "typed_edge": old_typed.unionByName(new_typed),
            "bundle": bundles,
            "concept": kept.unionByName(fresh),
            "containment": inside.unionByName(sync.missing_from(placed, inside, ["bundle_name", "concept_id"])),
            "hierarchy": old_edges.unionByName(sync.missing_from(edges, old_edges, ["parent_id", "child_id"])),
            "concept_link": old_links.unionByName(sync.missing_from(found, old_links, ["source_id", "target_id"])),
            "citation": old_citations.unionByName(sync.missing_from(cited, old_citations, ["source_id", "target_url"])),
        },
        base,
        check=guard,
    )
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    out = {
        "inserted": counts.get("insert", 0),
        "updated": counts.get("update", 0),
        "skipped": counts.get("skip", 0),
        "deleted": delete.count(),
        "released": release.count(),
        "retired": retire.count(),
        "links_attempted": found.count(),
        "citations_attempted": cited.count(),
        "typed_added": new_typed.count(),
    }
    for df in (plan, retire, delete, release, found, cited, new_typed):
        df.unpersist()
    return out


def sync_stix(store: Store, objects: DataFrame, name: str, path: str | None, now: dt.datetime) -> dict[str, int]:
    """Bring the store in line with a STIX bundle's objects: concepts, plain links, and typed edges where their shape admits them."""
    with scratch(store.spark):
        objects = stored(objects, "stix")
        concepts = stored(stix.concepts(objects), "stix-concepts")
        edges = stored(stix.relations(objects, concepts), "stix-edges")
        links = edges.where("relation is null").groupBy(F.col("source").alias("source_id"), F.col("target").alias("target_id")).agg(F.min("rel_type").alias("link_text"))
        typed = edges.where("relation is not null").select("source", "target", "relation")
        return sync_bundle(store, concepts.withColumn("program", F.lit(None).cast("string")).drop("source_ref"), name, path, now, links=links, typed=typed)


def status(store: Store) -> DataFrame:
    """(bundle_name, bundle_path, n): bundles and how many concepts they contain."""
    return bundle_counts(store.read("bundle"), store.read("containment")).select("bundle_name", "bundle_path", "n")


def bundle_counts(bundles: DataFrame, containment: DataFrame) -> DataFrame:
    n = containment.groupBy("bundle_name").agg(F.count("*").alias("n"))
    return bundles.join(n, "bundle_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def playbook(store: Store, concept_id: str) -> dict:
    """The engine, program and scopes of a concept; retired ones and ones without a program are refused."""
    row = store.read("concept").where(F.col("concept_id") == concept_id).first()
    if row is None:
        raise ValueError(f"no concept {concept_id}")
    if row["retired_at"] is not None:
        raise ValueError(f"{concept_id} is retired")
    if not row["program"]:
        raise ValueError(f"{concept_id} has no program")
    return {"engine": row["engine"], "program": row["program"], "scopes": row["scopes"] or []}


def query(store: Store, text: str, **arguments) -> DataFrame:
    """SQL over the store's tables, by their names as {table}; values come by name as :value."""
    import re

    tables = {t: store.read(t) for t in {*re.findall(r"\{(\w+)\}", text)}}
    return store.spark.sql(text, args=arguments or None, **tables)
