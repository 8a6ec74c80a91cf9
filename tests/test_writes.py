import datetime as dt

import pytest

from tessera import schema
from tessera.operators import beliefs as B
from tessera.operators import graph
from tessera.plans.writes import Context, Draft, EdgeDeclaration, Writer, guest_arguments
from tessera.store import Conflict, Store

NOW = dt.datetime(2026, 1, 1)


@pytest.fixture
def writer(spark, tmp_path):
    edge = EdgeDeclaration("technique-detection", "claim", ["claim", "logic"], {"note": str, "weight": float}, ["note"])
    return Writer(Store(spark, str(tmp_path / "store")), [edge])


def ctx(run="r1", actor="agent-1", now=NOW):
    return Context(run, actor, now)


def test_observe_assert_supersede(writer):
    store = writer.store
    e = writer.observe(ctx(), "seen", NOW)
    with pytest.raises(ValueError, match="unknown ids: ghost"):
        writer.assert_belief(ctx(), Draft("no"), ["ghost"], "external-tool")
    assert store.read("belief").count() == 0
    b = writer.assert_belief(ctx(), Draft("claim", 0.7), [e], "human-assertion")
    row = store.read("belief").first()
    assert (row["entrenchment"], row["salience"], row["retrieval_provenance"]) == ("user-stated", 0.7, "none")
    seeds = store.spark.createDataFrame([(b,)], "seed string")
    assert [r["node"] for r in graph.derivation_chain(store.read("derivation"), seeds).collect()] == [e]
    with pytest.raises(ValueError, match="can't supersede"):
        writer.supersede(ctx(), b, Draft("weaker", entrenchment="llm"), "why")
    assert store.read("belief").count() == 1
    new = writer.supersede(ctx(), b, Draft("better", 1.0), "why")
    gated = B.gate(store.read("belief"), store.read("ownership"), store.read("supersession"), "agent-1", dt.datetime(2026, 1, 2))
    assert [r["belief_id"] for r in gated.collect()] == [new]
    assert store.read("belief").where(f"belief_id = '{b}'").first()["valid_to"] is None


def test_guards(writer):
    for confidence in (1.5, -0.1, float("nan")):
        with pytest.raises(ValueError):
            writer.assert_belief(ctx(), Draft("x", confidence), [], "external-tool")
    with pytest.raises(ValueError):
        writer.assert_belief(ctx(), Draft("x", 1.0), [], "llm-synthesis")
    a = writer.assert_belief(ctx(), Draft("a"), [], "llm-synthesis")
    b = writer.assert_belief(ctx(), Draft("b"), [], "llm-synthesis")
    for claims in ([a], [a, a]):
        with pytest.raises(ValueError):
            writer.contest(ctx(), claims, "odd")
    writer.contest(ctx(), [a, b], "odd")
    assert writer.store.read("contradiction_claim").count() == 2
    assert {r[0] for r in writer.store.read("belief").select("belief_state").collect()} == {"asserted"}
    with pytest.raises(ValueError):
        writer.rests_on(ctx(), a, [])
    writer.rests_on(ctx(), a, [b])
    writer.record_prediction(ctx(), a, 7.0)
    writer.resolve_prediction(ctx(), a, "yes")
    writer.resolve_prediction(ctx(), b, "no")
    assert writer.store.read("prediction").first()["outcome"] == "yes"
    assert writer.store.read("episode").count() == 2
    assert guest_arguments({"run_id": 1, "text": 2}) == {"text": 2}


def test_belief_edges_and_recall(writer):
    store = writer.store
    store.commit({"concept": store.spark.createDataFrame([("c1", "concept", None, None, None, None)], "concept_id string, type string, title string, body string, file_hash string, retired_at timestamp_ntz")}, 0)
    a = writer.assert_belief(ctx(), Draft("a"), [], "llm-synthesis")
    shown = store.spark.createDataFrame([(a, 0.9)], "belief_id string, similarity double")
    event = writer.record_retrieval(ctx(), shown)
    for players, attributes in (({}, {"note": "n"}), ({"logic": "c1"}, {}), ({"logic": "c1"}, {"note": 3}), ({"logic": "ghost"}, {"note": "n"})):
        with pytest.raises(ValueError):
            writer.assert_belief(ctx(), Draft("b"), [a], "external-tool", [("technique-detection", players, attributes)])
    assert store.read("belief").count() == 1
    b = writer.assert_belief(ctx(), Draft("b"), [a], "external-tool", [("technique-detection", {"logic": "c1"}, {"note": "n"})])
    assert store.read("belief_edge").first()["belief_id"] == b
    assert [tuple(r) for r in store.read("informs_synthesis").collect()] == [(event, b)]
    assert store.read("surfaced").first()["was_used"] and store.read("belief").where(f"belief_id = '{b}'").first()["retrieval_provenance"] == "semantic"


def test_commits_are_atomic(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    agents = spark.createDataFrame([("a",)], "agent_id string")
    assert store.commit({"agent": agents}, 0) == 1
    with pytest.raises(Conflict):
        store.commit({"agent": agents}, 0)
    with pytest.raises(ValueError, match="were expected"):
        store.commit({"agent": agents}, 1, expected={"agent": 2})
    assert store.version() == 1 and store.read("belief").count() == 0


def test_schema(spark):
    assert schema.closure("episode") == ["episode", "execution-episode", "retrieval-event", "sighting"]
    df = spark.createDataFrame([("belief",), ("resolution",)], "type string")
    assert schema.isa(df, "belief").count() == 2 and schema.isa(df, "belief", exact=True).count() == 1
    assert "derivation" in schema.belief_surface()["relations"] and "containment" not in schema.belief_surface()["relations"]
    with pytest.raises(ValueError):
        schema.label("a b")
    with pytest.raises(ValueError):
        schema.check_enums(spark.createDataFrame([("maybe",)], "belief_state string"))
    with pytest.raises(ValueError):
        schema.check_key(spark.createDataFrame([("a",), ("a",)], "k string"), "k")


def test_streaming(spark, sf, tmp_path):
    import os
    import shutil

    from tessera.streaming import episodes

    os.mkdir(tmp_path / "in")
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    events = episodes.read_events(spark, str(tmp_path / "in"))
    query = episodes.ingest(episodes.episodes(events, "40 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("title", "event_time", "owner").distinct().count() > 0
