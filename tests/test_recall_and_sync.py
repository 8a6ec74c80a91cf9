"""Recall dispatch, sessions, extensions, population passes, the tick, STIX sync and the command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import retrieval
from tessera.plans import bundle_sync, extension
from tessera.plans.recall import ScopeError, Session, StubEmbedder, recall
from tessera.plans.writes import Context, Draft, EdgeDeclaration, EdgeRegistry, Writer
from tessera.sources import stix
from tessera.store import Store

NOW = dt.datetime(2026, 3, 1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ctx(run="r", actor="ann", now=NOW):
    return Context(run, actor, now)


def test_recall_takes_its_route(spark, store):
    writer, embedder = Writer(store), StubEmbedder(32)
    ids = {t: writer.assert_belief(ctx(), Draft(t, 0.5, "team"), [], "external-tool") for t in ("red fox", "blue whale", "red deer")}
    later = ctx("r2", "bob", NOW + dt.timedelta(hours=1))
    plain = recall(writer, later, "x").collect()
    assert [r["text"] for r in plain] == [] or all(r["text"] == "" for r in plain)
    assert {r["belief_id"] for r in recall(writer, later, "x", as_of=NOW).collect()} == {*ids.values()}
    vectors = embedder.embed(store.read("belief").select("belief_id", F.col("title").alias("text"))).select("belief_id", "embedding")
    writer.observe(later, "bob exists", NOW)  # the gate needs a known agent
    assert store.read("episode").where("type = 'retrieval-event'").count() == 0
    found = recall(writer, later, "red", embedder=embedder, index=vectors, max_chunks=2).collect()
    events = store.read("episode").where("type = 'retrieval-event'").collect()
    assert len(events) == 1 and events[0]["method"] == "semantic" and events[0]["candidate_count"] == store.read("surfaced").count()
    assert len(found) <= 2 and all(r["belief_id"] in ids.values() for r in found)


def test_sessions_deny_by_default(store):
    writer = Writer(store)
    closed, open_ = Session(writer, ctx()), Session(writer, ctx(), ["mem:remember", "mem:derive", "mem:contest", "mem:supersede", "mem:recall"])
    for call in (lambda s: s.remember("x"), lambda s: s.recall("x"), lambda s: s.derive("x", [], "llm-synthesis"), lambda s: s.contest(["a", "b"], "c"), lambda s: s.supersede("a", "b", "c"), lambda s: s.call("cyber", "claim")):
        with pytest.raises(ScopeError):
            call(closed)
    e = open_.remember("seen")
    a, b = (open_.derive(t, [e], "external-tool", 0.4) for t in "ab")
    open_.contest([a, b], "odd")
    open_.supersede(a, "a2", "better")
    assert open_.recall("anything") == [] or store.read("belief").count() == 3
    calls = []
    s = Session(writer, ctx(), ["x:f"], extensions={"x": {"f": lambda w, c, **k: calls.append(k)}})
    s.call("x", "f", run_id="forged", note=1)
    assert calls == [{"note": 1}]
    with pytest.raises(ScopeError):
        s.call("x", "g")


def test_registry():
    edge = lambda **k: EdgeDeclaration("sees", "claim", ["claim", "thing"], **k)
    assert "sees" in EdgeRegistry([edge(players={"thing": "gadget"})], {"e": {"gadget": "concept"}})
    for declarations, types, message in (
        ([edge(), edge()], {}, "two declarations"),
        ([edge(players={"thing": "belief"})], {}, "memory item"),
        ([edge(players={"thing": "nothing"})], {}, "isn't a type"),
        ([edge(players={"other": "concept"})], {}, "no role"),
        ([], {"e": {"belief": "concept"}}, "another parent"),
        ([], {"e": {"a": "b", "b": "a"}}, "no root"),
        ([], {"e": {"a": "concept"}, "f": {"a": "concept"}}, "both define"),
        ([edge(players={"thing": "gadget"})], {"e": {"gadget": "belief"}}, "memory item"),
        ([edge(), EdgeDeclaration("thing", "claim", ["claim", "x"])], {}, "name of the relation"),
    ):
        with pytest.raises(ValueError, match=message):
            EdgeRegistry(declarations, types)
    with pytest.raises(ValueError, match="role twice"):
        EdgeDeclaration("r", "a", ["a", "b", "b"])
    with pytest.raises(ValueError):
        EdgeDeclaration("r x", "a", ["a"])


BUNDLE = {
    "type": "bundle",
    "objects": [
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Shell", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Scan", "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]},
        {"type": "malware", "id": "malware--1", "name": "M"},
        {"type": "x-mitre-data-component", "id": "x-mitre-data-component--1", "name": "C"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "malware--1", "target_ref": "attack-pattern--1"},
        {"type": "relationship", "relationship_type": "detects", "source_ref": "x-mitre-data-component--1", "target_ref": "attack-pattern--1"},
        {"type": "relationship", "relationship_type": "related-to", "source_ref": "malware--1", "target_ref": "attack-pattern--2"},
    ],
}


def test_stix_sync_and_detection(spark, store, tmp_path):
    (tmp_path / "enterprise.json").write_text(json.dumps(BUNDLE))
    objects = lambda: stix.objects(spark, str(tmp_path / "enterprise.json"))
    first = bundle_sync.sync_stix(store, objects(), "enterprise", None, NOW)
    assert (first["inserted"], first["typed_added"], first["links_attempted"]) == (4, 2, 1)
    assert sorted((r["relation"], r["source"]) for r in store.read("typed_edge").collect()) == [("requires-evidence", "stix/x-mitre-data-component/1"), ("uses", "stix/malware/1")]
    again = bundle_sync.sync_stix(store, objects(), "enterprise", None, NOW)
    assert (again["inserted"], again["updated"], again["skipped"], again["typed_added"]) == (0, 0, 4, 0)
    assert {r["attack_id"] for r in store.read("concept").where("type = 'attack-pattern'").collect()} == {"T1", "T2"}
    writer = extension.writer(store, [extension.Detection()])
    with pytest.raises(ValueError, match="unknown players"):
        extension.claim(writer, ctx(), "ghost", "T1", "external-tool", 0.9)
    with pytest.raises(ValueError, match="unknown players"):
        extension.claim(writer, ctx(), "stix/malware/1", "T9", "external-tool", 0.9)
    with pytest.raises(ValueError, match="verdict"):
        extension.disposition(writer, ctx(), "stix/malware/1", "maybe")
    belief = extension.claim(writer, ctx(), "stix/malware/1", "T1", "external-tool", 1.0)
    assert store.read("belief").where(F.col("belief_id") == belief).first()["title"] == "detection 'stix/malware/1' detects technique 'T1' (confidence 1)"
    assert [r[0] for r in extension.coverage_gaps(writer, ctx()).collect()] == ["T2"]
    assert [r[0] for r in extension.blinded(writer, ctx()).collect()] == ["stix/malware/1"]
    for k, verdict in enumerate(("true-positive", "false-positive", "benign-true", "true-positive")):
        extension.disposition(writer, ctx(f"v{k}"), "stix/malware/1", verdict)
    row = extension.precision(writer, ctx(), "stix/malware/1", 60).first()
    assert (row["true_positives"], row["false_positives"]) == (2, 1)
    claims = spark.createDataFrame([("k1", "stix/malware/1", "T2", "external-tool", 0.5), ("k2", "stix/malware/1", "T1", "external-tool", 0.25)], "key string, logic string, technique string, method string, confidence double")
    evidence = spark.createDataFrame([("k1", belief)], "key string, source string")
    extension.claim_all(writer, ctx("batch"), claims, evidence)
    assert extension.coverage_gaps(writer, ctx()).count() == 0
    verdicts = spark.createDataFrame([("a", "stix/malware/1", "true-positive"), ("b", "stix/malware/1", "true-positive")], "key string, logic string, verdict string")
    extension.disposition_all(writer, ctx("batch2"), verdicts, evidence.limit(0))
    assert extension.precision(writer, ctx(), "stix/malware/1", 60).first()["true_positives"] == 4
    with pytest.raises(ValueError, match="unknown ids: T9"):
        extension.claim_all(writer, ctx("batch3"), claims.withColumn("technique", F.lit("T9")), evidence)


def test_sync_may_not_change_the_belief_tier(spark, store, monkeypatch, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(BUNDLE))
    objects = stix.objects(spark, str(tmp_path / "s.json"))
    real = store.commit
    row = spark.createDataFrame([("b", "t")], "belief_id string, title string")
    monkeypatch.setattr(store, "commit", lambda changes, base, **k: real({**changes, "belief": row}, base, **k))
    with pytest.raises(bundle_sync.BeliefTierChanged):
        bundle_sync.sync_stix(store, objects, "s", None, NOW)
    assert store.version() == 0 and not [*(tmp_path / "store" / "data").rglob("*.parquet")]


def test_population_passes(spark, store):
    writer = Writer(store)
    concepts = spark.createDataFrame([(f"c{k}", "concept") for k in range(4)], "concept_id string, type string")
    store.commit({}, 0, adds={"concept": concepts})
    assert writer.define_population("p", "spark-sql", "true") and not writer.define_population("p", "spark-sql", "true")
    with pytest.raises(ValueError, match="another spec"):
        writer.define_population("p", "spark-sql", "false")
    ask = lambda *ids: spark.createDataFrame([("p", i) for i in ids], "spec_hash string, member string")
    assert writer.materialize_population(ask("c0", "c1"), NOW, NOW) == {"open": 2, "close": 0, "refresh": 0}
    later = NOW + dt.timedelta(days=1)
    assert writer.materialize_population(ask("c1", "c2"), later, later) == {"open": 1, "close": 1, "refresh": 1}
    assert writer.close_membership("p", "c1", later, later) and not writer.close_membership("p", "c1", later, later)
    assert writer.materialize_population(ask("c0"), later, later) == {"open": 1, "close": 1, "refresh": 0}
    rows = sorted((r["member"], r["valid_from"], r["valid_to"]) for r in store.read("population_member").collect() if r["valid_to"]) + [(r["member"],) for r in store.read("population_member").where("valid_to is null").collect()]
    assert rows == [("c0", NOW, later), ("c1", NOW, later), ("c2", later, later), ("c0",)]
    for requested, at, message in ((ask("c9"), later, "aren't stored"), (ask(" "), later, "blank"), (ask("c1"), NOW, "older"), (ask("c1"), later + dt.timedelta(days=9), "future")):
        with pytest.raises(ValueError, match=message):
            writer.materialize_population(requested, at, later)


def test_tick(store):
    writer = Writer(store)
    for actor, text, hour in (("ann", "same", 1), ("ann", "same", 2), ("bob", "same", 3), ("ann", "other", 4)):
        writer.observe(ctx(f"{actor}{hour}", actor), text, NOW, NOW + dt.timedelta(hours=hour))
    report = writer.tick(NOW + dt.timedelta(days=1))
    assert report["episodes_deduped"] == 1 and store.read("consolidation_step").first()["run_id"] == report["run_id"]
    gone = store.read("episode").where("consolidation_state = 'tombstoned'").collect()
    assert len(gone) == 1 and gone[0]["ingest_time"] == NOW + dt.timedelta(hours=2)
    version = store.version()
    assert writer.tick(NOW + dt.timedelta(days=2)) == {"run_id": None, "episodes_deduped": 0} and store.version() == version


def test_planned_jobs_say_so():
    from tessera.operators import jobs

    assert len(jobs.PLANNED) == 10
    for name in jobs.PLANNED:
        with pytest.raises(NotImplementedError, match=name):
            jobs.planned(name)
    with pytest.raises(ValueError, match="no job"):
        jobs.planned("else")


def test_batches_commit_once(spark, store, monkeypatch):
    from tessera import store as module

    writer = Writer(store)
    events = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("seen "), "id").alias("text"), F.lit(NOW).cast("timestamp_ntz").alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("ingest_time"))
    writer.observe_all(ctx(), events)
    assert store.version() == 1 and store.read("episode").count() == 5000
    with pytest.raises(ValueError, match="isn't unique"):
        writer.observe_all(ctx(), events.limit(10))
    assert store.version() == 1
    monkeypatch.setattr(module, "MOST_PARTS", 2)  # the third part has the table written anew
    for k in range(3):
        writer.observe(ctx(f"r{k}"), "one more", NOW)
    assert store.read("episode").count() == 5003 and max(map(len, store._pointer(store.version()).values())) <= 3


def test_index_snapshots(spark, tmp_path):
    index = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>")
    path = str(tmp_path / "index")
    assert retrieval.open_index(spark, path, "m", 2) is None
    retrieval.persist_index(index, path, "m", 2)
    retrieval.persist_index(index.withColumn("id", F.lit("b")), path, "m", 2)
    assert [r["id"] for r in retrieval.open_index(spark, path, "m", 2).collect()] == ["b"]
    assert retrieval.open_index(spark, path, "other", 2) is None and retrieval.open_index(spark, path, "m", 3) is None


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("---\ntype: note\n---\nhello")
    (tmp_path / "s.json").write_text(json.dumps(BUNDLE))
    at = str(tmp_path / "store")
    assert main([at, "sync", str(root)], spark) == main([at, "sync-stix", str(tmp_path / "s.json")], spark) == 0
    assert main([at, "status"], spark) == main([at, "query", "select count(*) as n from {concept}"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["inserted"] == 1 and lines[1]["inserted"] == 4 and {"n": 5} in lines and {x.get("bundle_name") for x in lines} >= {"notes", "s"}
