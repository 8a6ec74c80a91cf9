"""Small graphs with exact expectations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import beliefs as B
from tessera.operators import closure, disposition, graph, jobs, populations, retrieval, sync
from tessera.operators.closure import components, reach
from tessera.session import stored

BELIEF = "belief_id string, title string, belief_state string, confidence double, entrenchment string, valid_from timestamp_ntz, valid_to timestamp_ntz, salience double, base_activation double, last_access timestamp_ntz"


def at(text):
    return dt.datetime.fromisoformat(text)


def belief(b, vf="2026-01-01", vt=None, state="asserted", salience=0.5, last="2026-01-01"):
    return (b, b, state, None, None, vf and at(vf), vt and at(vt), salience, 1.0, last and at(last))


def beliefs(spark, *rows):
    return spark.createDataFrame(list(rows), BELIEF)


def ids(df, column="belief_id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_windows_are_half_open(spark):
    df = beliefs(spark, belief("a", "2026-01-01", "2026-02-01"), belief("b", "2026-03-01"), belief("c", None))
    assert ids(B.believed_at(df, "2026-01-01")) == ["a"]
    assert ids(B.believed_at(df, "2026-02-01")) == []
    assert ids(B.believed_at(df, "2026-03-01")) == ["b"]


def test_gate(spark):
    df = beliefs(spark, belief("team"), belief("shared"), belief("private"), belief("old"), belief("ended", vt="2026-01-02"), belief("state", state="contested"))
    own = spark.createDataFrame([("team", "o", "team"), ("shared", "o", "shared"), ("private", "o", "private"), ("old", "o", "team"), ("ended", "o", "team"), ("state", "o", "team"), ("x", "other", None)], "owned string, owner string, visibility string")
    sup = spark.createDataFrame([("old", "new")], "superseded string, superseding string")
    see = lambda who, now="2026-01-03": ids(B.gate(df, own, sup, who, now))
    assert see("o") == ["private", "shared", "team"]
    assert see("other") == ["shared", "team"]
    assert see("nobody") == []
    assert "ended" in see("o", "2026-01-01") and see("o", "2025-01-01") == []
    assert ids(B.superseded(df, sup)) == ["old"]


def test_scores_and_decay(spark):
    df = beliefs(spark, belief("a"), belief("week", last="2025-12-25"), belief("ahead", last="2026-02-01"), belief("never", last=None))
    now = "2026-01-01"
    got = {r["belief_id"]: (r["score"], r["d"]) for r in B.retrieval_score(df, now).withColumn("d", B.decay(F.col("last_access"), now)).collect()}
    assert got == {"a": (1.5, 1.0), "week": (1.5, 0.5)}
    assert [r[0] for r in df.select(B.decay(F.col("last_access"), now)).collect()] == [1.0, 0.5, 1.0, 1.0]


def test_reach_on_cycles_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("d",), (None,)], "seed string")
    assert sorted(tuple(r) for r in reach(edges, seeds).collect()) == [("a", x) for x in "abcd"]


def test_blast_radius_follows_windows(spark):
    rests = spark.createDataFrame([("D", "B")], "resting string, assumption string")
    derivation = spark.createDataFrame([], "derived string, source string")
    members = spark.createDataFrame([("p", "C1", at("2026-01-01"), at("2026-04-01")), ("p", "C2", None, None)], "spec_hash string, member string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    scoped = spark.createDataFrame([("B", "p")], "scoped_belief string, spec_hash string")
    seeds = spark.createDataFrame([("C1",), ("C2",)], "seed string")
    hit = lambda t: sorted(tuple(r) for r in graph.blast_radius(graph.impact_edges(rests, derivation, members, scoped, t), seeds).collect())
    assert hit("2026-02-01") == [("C1", "B"), ("C1", "D")]
    assert hit("2026-05-01") == []
    assert hit(None) == [("C2", "B"), ("C2", "D")]


def test_canonical_entity(spark):
    rows = [("r1", "c1", "c2", "asserted", at("2026-01-01"), None), ("r2", "c2", "c3", "superseded", at("2026-06-01"), None), ("r3", "c3", "c4", "asserted", at("2026-01-01"), None), ("r4", "c4", "c5", "asserted", at("2026-01-01"), None)]
    resolves = spark.createDataFrame(rows, "resolution string, record_a string, record_b string, belief_state string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    methods = [("r1", "llm-synthesis"), ("r1", "type-join"), ("r2", "cardinality"), ("r3", "llm-synthesis")]  # one provable derivation suffices; r4 has none
    derivation = spark.createDataFrame(methods, "derived string, derivation_method string")
    seed = spark.createDataFrame([("c1",), ("c9",)], "seed string")
    of = lambda t=None: ids(graph.canonical_entity(resolves, derivation, seed, t), "node")
    assert of() == ["c1", "c2"]
    assert of("2026-03-01") == ["c1", "c2"]
    assert of("2026-08-01") == ["c1", "c2", "c3"]


@pytest.mark.parametrize("local", [10**6, 0])
def test_reach_by_both_routes(spark, monkeypatch, local):
    monkeypatch.setattr(closure, "MOST_LOCAL_EDGES", local)
    rnd = random.Random(4)
    edges = {(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(80)}
    seeds = [0, 1, 2, 3, 99, None, 3]
    want = set()
    for s in {0, 1, 2, 3}:
        todo, seen = [s], set()
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(s, x) for x in seen}
    frame = spark.createDataFrame([*edges, *list(edges)[:5], (None, 1), (1, None)], "src long, dst long")
    got = [tuple(r) for r in reach(frame, spark.createDataFrame([(s,) for s in seeds], "seed long")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert reach(frame.limit(0), spark.createDataFrame([(1,)], "seed long")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    got = components(links).collect()
    assert len(got) == 41 and {r["root"] for r in got} == {"n000"}


def test_population_passes(spark):
    schema = "spec_hash string, member string, valid_from timestamp_ntz, valid_to timestamp_ntz, computed_at timestamp_ntz"
    rows, seen = spark.createDataFrame([], schema), []
    for month, want in enumerate(["ab", "ab", "bc", "abc"], 1):
        asked = spark.createDataFrame([("p", x) for x in want], "spec_hash string, member string")
        r = populations.report(rows, asked)
        seen.append((r["open"], r["close"], r["refresh"]))
        rows = stored(populations.materialize(rows, asked, f"2026-0{month}-01"), "rows")
    assert seen == [(2, 0, 0), (0, 0, 2), (1, 1, 1), (1, 0, 2)]
    assert rows.where("member = 'a'").count() == 2
    assert ids(populations.members_at(rows, "2026-01-15"), "member") == ["a", "b"]
    assert ids(populations.members_at(rows, "2026-03-15"), "member") == ["b", "c"]
    assert ids(populations.members(rows), "member") == ["a", "b", "c"]
    now = at("2026-05-01")
    asked = spark.createDataFrame([("p", "a")], "spec_hash string, member string")
    for bad in (at("2026-03-01"), at("2026-05-02")):
        with pytest.raises(ValueError):
            populations.check_pass(rows, asked, bad, now)
    populations.check_pass(rows, asked, now, now)
    closed, found = populations.close_one(rows, "p", "c", "2026-05-01")
    assert found and ids(populations.members(closed), "member") == ["a", "b"]


def test_define_population(spark):
    held = spark.createDataFrame([], "spec_hash string, spec_dialect string, spec_text string")
    held, new = populations.define(held, "h", populations.SPARK_SQL, "k > 1")
    assert new and not populations.define(held, "h", populations.SPARK_SQL, "k > 1")[1]
    with pytest.raises(ValueError):
        populations.define(held, "h", populations.SPARK_SQL, "k > 2")
    assert populations.strict(spark.range(4).toDF("k"), populations.SPARK_SQL, "k > 1").count() == 2
    with pytest.raises(ValueError):
        populations.strict(spark.range(4), "other", "x")


def test_dedup(spark):
    rows = [("c", "episode", "t", at("2026-01-01"), at("2026-01-02"), None), ("a", "episode", "t", at("2026-01-01"), at("2026-01-02"), None), ("b", "episode", "t", at("2026-01-01"), at("2026-01-03"), None), ("x", "retrieval-event", "t", at("2026-01-01"), at("2026-01-02"), None), ("y", "episode", "t", at("2026-01-05"), at("2026-01-02"), None), ("z", "episode", "t", at("2026-01-01"), at("2026-01-02"), None)]
    episodes = spark.createDataFrame(rows, "episode_id string, type string, title string, event_time timestamp_ntz, ingest_time timestamp_ntz, consolidation_state string")
    owners = spark.createDataFrame([(x, "o") for x in "abcxyz"] + [("z", "p")], "episode_id string, owner string")
    assert ids(jobs.duplicate_episode_candidates(episodes, owners), "episode_id") == ["a", "b", "c"]
    after, counts = jobs.tick(episodes, owners)
    assert counts == {"tombstoned": 2} and ids(after.where("consolidation_state = 'tombstoned'"), "episode_id") == ["b", "c"]
    assert jobs.tick(after, owners)[1] == {"tombstoned": 0}


def test_disposition(spark):
    schema = "group_id string, belief_id string, method string, confidence double, entrenchment string, valid_from timestamp_ntz"
    rows = [
        ("method", "a", "llm-synthesis", 0.99, "axiom", None),
        ("method", "b", "external-tool", 0.1, None, None),
        ("nan", "a", "type-join", float("nan"), None, None),
        ("nan", "b", "type-join", 0.9, None, None),
        ("tie", "a", None, None, None, None),
        ("tie", "b", None, 0.5, None, None),
        ("sole", "a", None, None, None, None),
        ("new", "a", None, None, None, at("2026-01-01")),
        ("new", "b", None, None, None, None),
    ]
    got = {r["group_id"]: (r["belief_id"], r["contested"], r["reason"]) for r in disposition.rank(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"method": ("b", False, "method rank"), "nan": ("a", False, "confidence"), "tie": ("a", True, "tie"), "sole": ("a", False, "sole competitor"), "new": ("a", False, "recency")}
    assert disposition.ordered(spark.createDataFrame(rows, schema)).where("place = 1").count() == 5


def test_recall_ranks_by_activation(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("gone", [1.0, 0.0])], "belief_id string, embedding array<float>")
    selected = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "belief_id string, rank double")
    assert [r["belief_id"] for r in retrieval.recall_indexed(vectors, selected, [1.0, 0.0], 2).collect()] == ["b", "a"]
    assert [r["belief_id"] for r in retrieval.recall_indexed(vectors, selected, [1.0, 0.0], 1).collect()] == ["b"]
    assert retrieval.recall_candidates(vectors, selected, [1.0, 0.0], 1, gate_after=True).count() == 2
    assert retrieval.stub_vector("")[0] == 1.0


def test_index_changes(spark):
    index = spark.createDataFrame([("a", [1.0], "o", "private"), ("b", [1.0], "p", "private"), ("c", [1.0], "p", None)], "id string, embedding array<float>, owner string, visibility string")
    assert ids(retrieval.prefilter(index, "o"), "id") == ["a", "c"]
    assert ids(retrieval.remove(index, index.where("id = 'a'")), "id") == ["b", "c"]
    assert retrieval.upsert(index, index.where("id = 'a'"), 1).count() == 3
    with pytest.raises(ValueError):
        retrieval.upsert(index, index, 2)


def test_index_files_and_repairs(spark, tmp_path):
    index = spark.createDataFrame([("b", [1.0]), ("a", [2.0])], "id string, embedding array<float>")
    retrieval.persist_index(index, str(tmp_path), "m", 1)
    assert sorted(tuple(r) for r in retrieval.open_index(spark, str(tmp_path), "m", 1).collect()) == [("a", [2.0]), ("b", [1.0])]
    assert retrieval.open_index(spark, str(tmp_path), "other", 1) is None
    dirty = spark.createDataFrame([("a",), ("b",)], "id string")
    fresh = spark.createDataFrame([("a", [9.0])], "id string, embedding array<float>")
    assert [tuple(r) for r in retrieval.drain_dirty(index, dirty, fresh).collect()] == [("a", [9.0])]


def test_sync_plan(spark):
    manifest = spark.createDataFrame([("new", "1"), ("same", "2"), ("changed", "3"), ("nohash", "4"), ("foreign", "5")], "concept_id string, file_hash string")
    stored = spark.createDataFrame([("same", "2", "a"), ("changed", "0", "a"), ("nohash", None, "a"), ("gone", "9", "a"), ("both", "9", "a"), ("both", "9", "b"), ("foreign", "5", "b")], "concept_id string, file_hash string, bundle_name string")
    assert ids(sync.collisions(manifest, stored, "a"), "concept_id") == ["foreign"]
    plan = {r["concept_id"]: r["action"] for r in sync.plan_sync(manifest.where("concept_id <> 'foreign'"), stored, "a").collect()}
    assert plan == {"new": "insert", "same": "skip", "changed": "update", "nohash": "update", "gone": "delete", "both": "delete"}
    deletes = spark.createDataFrame([("gone",), ("both",)], "concept_id string")
    assert {r[0]: r[1] for r in sync.split_gc(deletes, stored, "a").collect()} == {"gone": "delete", "both": "release"}
    assert {r[0]: r[1] for r in sync.retire_or_delete(deletes, deletes.where("concept_id = 'gone'")).collect()} == {"gone": "retire", "both": "delete"}
