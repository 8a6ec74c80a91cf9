"""Registered queries over writes, schema, text functions, indexes and sync steps; each with its SQL for another engine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import markdown
from tessera.functions.ioc import normalize_ioc
from tessera.operators import beliefs as B
from tessera.operators import jobs, populations, retrieval, sync
from tessera.operators import writes as W
from tessera.operators.disposition import METHOD_RANK, STRENGTH, method_rank
from tessera.plans.queries import AT, PLAN, TIER, register, requested, ts
from tessera.session import shared_dir
from tessera.sources import stix
from tessera.sources.star import ctes, view
from tessera.streaming import episodes as streaming

CTX = W.Context("run-9", "agent-7", dt.datetime(1998, 6, 1))
STAMP = ts("1998-06-01 00:00:00")


def minted(kind: str, act: str, key: str) -> str:
    return f"'mem/{kind}/' || substr(sha256(concat_ws(chr(31), 'run-9', '1998-06-01T00:00:00', '{act}', {key})), 1, 26)"


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Writes.


def seen(spark, d):
    return read(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("text"), F.col("ts").alias("event_time"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("ingest_time"))


@register(f"SELECT {minted('ep', 'observe', 'event_id::VARCHAR')} AS episode_id, event_type AS title, ts AS event_time, CASE WHEN event_id % 2 = 0 THEN ts ELSE {STAMP} END AS ingest_time FROM events")
def observe(spark, d):
    return W.observed(CTX, seen(spark, d))["episode"].select("episode_id", "title", "event_time", "ingest_time")


#: Every order a draft, with three unlike confidences; its evidence are the beliefs of order numbers around half its own.
DRAFT_SQL = f"""drafts AS (SELECT o_orderkey::VARCHAR AS key, concat('claim ', o_orderkey) AS title, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE (o_orderkey % 100)::DOUBLE / 100 END AS confidence,
['{"', '".join(W.METHODS)}'][(o_orderkey % 7)::INT + 1] AS method FROM orders),
evidence AS (SELECT o_orderkey::VARCHAR AS key, concat('mem/bel/', o_orderkey // 2) AS source FROM orders UNION ALL SELECT o_orderkey::VARCHAR, concat('mem/bel/', o_orderkey // 2) FROM orders WHERE o_orderkey % 3 = 0),
ranks AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {r})" for m, r in METHOD_RANK.items())}) AS r(method, method_rank)),
shown AS (SELECT 'run-9' AS run_id, concat('mem/ep/re', o_orderkey % 40) AS retrieval, concat('mem/bel/', o_orderkey) AS concept_id FROM orders WHERE o_orderkey % 5 = 0)""".replace('"', "'")


def drafts(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    confidence = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 7 == 1, 1.5).when(k % 7 == 2, 1.0).otherwise((k % 100).cast("double") / 100)
    rows = o.select(k.cast("string").alias("key"), F.concat(F.lit("claim "), k).alias("title"), confidence.alias("confidence"), F.lit("private").alias("visibility"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.get(F.array(*map(F.lit, W.METHODS)), (k % 7).cast("int")).alias("method"))
    half = o.select(k.cast("string").alias("key"), F.concat(F.lit("mem/bel/"), F.floor(k / 2)).alias("source"))
    evidence = half.union(half.where(F.col("key").cast("long") % 3 == 0))
    shown = o.where(k % 5 == 0).select(F.lit("run-9").alias("run_id"), F.concat(F.lit("mem/ep/re"), k % 40).alias("retrieval"), F.concat(F.lit("mem/bel/"), k).alias("concept_id"), F.lit(0.5).alias("similarity"), F.lit(False).alias("was_used"))
    return rows, evidence, shown


@register(
    f"""WITH {DRAFT_SQL} SELECT {minted('bel', 'assert', 'key')} AS belief_id, title, 'asserted' AS belief_state, confidence, CASE method WHEN 'human-assertion' THEN 'user-stated' WHEN 'llm-synthesis' THEN 'llm' ELSE 'tool-derived' END AS entrenchment,
{STAMP} AS valid_from, coalesce(confidence, 0.5) AS salience, CASE WHEN key IN (SELECT key FROM evidence WHERE source IN (SELECT concept_id FROM shown)) THEN 'semantic' ELSE 'none' END AS retrieval_provenance FROM drafts"""
)
def assert_belief(spark, d):
    return W.asserted(CTX, *drafts(spark, d))["belief"].select("belief_id", "title", "belief_state", "confidence", "entrenchment", "valid_from", "salience", "retrieval_provenance")


@register(f"WITH {DRAFT_SQL} SELECT DISTINCT {minted('bel', 'assert', 'key')} AS derived, source, method AS derivation_method FROM drafts JOIN evidence USING (key)")
def assert_derivation(spark, d):
    return W.asserted(CTX, *drafts(spark, d))["derivation"].select("derived", "source", "derivation_method")


@register(f"WITH {DRAFT_SQL} SELECT DISTINCT retrieval, {minted('bel', 'assert', 'key')} AS synthesized FROM evidence JOIN shown ON concept_id = source")
def correlation_on_assert(spark, d):
    return W.asserted(CTX, *drafts(spark, d))["informs_synthesis"]


@register(f"WITH {DRAFT_SQL} SELECT retrieval, concept_id, true AS was_used FROM shown WHERE concept_id IN (SELECT source FROM evidence)")
def mark_used(spark, d):
    _, evidence, shown = drafts(spark, d)
    return W.used(CTX, evidence, shown).select("retrieval", "concept_id", "was_used")


@register(
    f"""WITH {DRAFT_SQL} SELECT key, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence lies outside 0 to 1' ELSE 'a probabilistic method can''t be certain' END AS problem
FROM drafts JOIN ranks USING (method) WHERE confidence < 0 OR confidence > 1 OR (method_rank = 0 AND confidence >= 1)
UNION ALL SELECT key, concat('unknown ids: ', source) FROM evidence WHERE source NOT IN (SELECT concat('mem/bel/', o_orderkey) FROM orders)"""
)
def assert_problems(spark, d):
    rows, evidence, _ = drafts(spark, d)
    return W.assert_problems(rows, evidence, view(spark, d, "belief").select(F.col("belief_id").alias("id")))


@register("SELECT m AS method, CASE m WHEN 'human-assertion' THEN 'user-stated' WHEN 'llm-synthesis' THEN 'llm' ELSE 'tool-derived' END AS entrenchment, CASE WHEN m IN ('type-join', 'cardinality', 'functional-dependency') THEN 2 WHEN m = 'llm-synthesis' THEN 0 ELSE 1 END AS rank, count(*) AS n FROM (SELECT ['" + "', '".join(W.METHODS) + "'][(l_orderkey % 7)::INT + 1] AS m FROM lineitem) GROUP BY 1")
def method_tiers(spark, d):
    m = read(spark, d, "lineitem").select(F.get(F.array(*map(F.lit, W.METHODS)), (F.col("l_orderkey") % 7).cast("int")).alias("method"))
    return m.groupBy("method").agg(F.count("*").alias("n")).select("method", W.entrenchment_of(F.col("method")).alias("entrenchment"), method_rank(F.col("method")).alias("rank"), "n")


#: Every fifth belief gets a draft, of its own tier, of one below the top or of none.
SUPERSEDE_SQL = """requests AS (SELECT belief_id AS old, concat('new ', belief_id) AS title, CASE k % 3 WHEN 0 THEN 'user-stated' WHEN 1 THEN NULL ELSE 'inferred' END AS entrenchment FROM belief WHERE k % 5 = 0),
tiers AS (SELECT r.old, r.title, coalesce(r.entrenchment, b.entrenchment, 'inferred') AS new_tier, b.entrenchment AS old_tier FROM requests r JOIN belief b ON b.belief_id = r.old)"""
STRENGTH_SQL = "CASE {} " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in STRENGTH.items()) + " END"


def replacements(spark, d):
    b = view(spark, d, "belief").where("k % 5 = 0")
    tier = F.when(F.col("k") % 3 == 0, "user-stated").when(F.col("k") % 3 == 2, "inferred")
    none = F.lit(None).cast("string")
    return b.select(F.col("belief_id").alias("old"), F.concat(F.lit("new "), "belief_id").alias("title"), F.lit(1.0).alias("confidence"), tier.alias("entrenchment"), none.alias("visibility"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("why").alias("reason"))


@register(f"WITH {ctes('belief')}, {SUPERSEDE_SQL} SELECT old AS key, concat(new_tier, ' can''t supersede ', old_tier) AS problem FROM tiers WHERE {STRENGTH_SQL.format('new_tier')} < {STRENGTH_SQL.format('old_tier')}")
def supersede_problems(spark, d):
    return W.supersede_problems(replacements(spark, d), view(spark, d, "belief"))


@register(f"WITH {ctes('belief')}, {SUPERSEDE_SQL} SELECT {minted('bel', 'supersede', 'old')} AS belief_id, title, new_tier AS entrenchment, old AS superseded FROM tiers")
def supersede(spark, d):
    adds, _ = W.superseding(CTX, replacements(spark, d), view(spark, d, "belief"))
    return adds["belief"].join(adds["supersession"].withColumnRenamed("superseding", "belief_id"), "belief_id").select("belief_id", "title", "entrenchment", "superseded")


@register(f"WITH {ctes('belief')} SELECT belief_id, 'superseded' AS belief_state, valid_to FROM belief WHERE k % 5 = 0")
def supersede_flips(spark, d):
    return W.superseding(CTX, replacements(spark, d), view(spark, d, "belief"))[1].select("belief_id", "belief_state", "valid_to")


#: Groups of up to three orders; some claims are said twice, some beliefs don't exist.
CLAIMS_SQL = "claims AS (SELECT concat('g', o_orderkey // 3) AS key, concat('mem/bel/', CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 50 = 7 THEN -o_orderkey ELSE o_orderkey END) AS claim FROM orders WHERE o_orderkey % 9 < 4)"


def contesting(spark, d):
    k = F.col("o_orderkey")
    claim = F.when(k % 4 == 0, k - 1).when(k % 50 == 7, -k).otherwise(k)
    return read(spark, d, "orders").where(k % 9 < 4).select(F.concat(F.lit("g"), F.floor(k / 3)).alias("key"), F.concat(F.lit("mem/bel/"), claim).alias("claim"), F.lit("odd").alias("condition"))


@register(f"WITH {CLAIMS_SQL} SELECT DISTINCT {minted('anom', 'contest', 'key')} AS rel_id, claim FROM claims")
def contest(spark, d):
    return W.contested(CTX, contesting(spark, d))["contradiction_claim"]


@register(
    f"""WITH {ctes('belief')}, {CLAIMS_SQL} SELECT key, 'a contradiction needs two different claims' AS problem FROM claims GROUP BY key HAVING count(DISTINCT claim) < 2
UNION ALL SELECT key, concat('unknown ids: ', claim) FROM claims WHERE claim NOT IN (SELECT belief_id FROM belief)"""
)
def contest_problems(spark, d):
    return W.contest_problems(contesting(spark, d), view(spark, d, "belief"))


@register(f"WITH {ctes('rests_on', 'belief')}, ends AS (SELECT resting, resting AS id FROM rests_on UNION ALL SELECT resting, assumption FROM rests_on) SELECT resting AS key, concat('unknown ids: ', id) AS problem FROM ends WHERE id NOT IN (SELECT belief_id FROM belief)")
def rests_on_problems(spark, d):
    pairs = view(spark, d, "rests_on")
    ends = pairs.select(F.col("resting").alias("key"), F.explode(F.array("resting", "assumption")).alias("id"))
    return W.unknown(ends, "id", view(spark, d, "belief").select(F.col("belief_id").alias("id")))


PREDICTED_SQL = "prediction AS (SELECT concat('mem/bel/', o_orderkey) AS belief_id, (o_orderkey % 13)::DOUBLE AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'no' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN 'mem/ep/0' END AS episode_id FROM orders WHERE o_orderkey % 4 <> 1), outcomes AS (SELECT concat('mem/bel/', o_orderkey) AS belief_id, 'yes' AS outcome FROM orders WHERE o_orderkey % 2 = 0)"


def predictions(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    name = F.concat(F.lit("mem/bel/"), k).alias("belief_id")
    held = o.where(k % 4 != 1).select(name, (k % 13).cast("double").alias("p"), F.when(k % 3 == 0, "no").alias("outcome"), F.when(k % 3 == 0, "mem/ep/0").alias("episode_id"))
    return o.where(k % 2 == 0).select(name, F.lit("yes").alias("outcome")), held


@register(
    f"""WITH {PREDICTED_SQL} SELECT belief_id, p, CASE WHEN p.outcome IS NULL THEN o.outcome ELSE p.outcome END AS outcome, CASE WHEN p.outcome IS NULL THEN {minted('ep', 'resolve', 'belief_id')} ELSE episode_id END AS episode_id
FROM prediction p JOIN outcomes o USING (belief_id)"""
)
def resolve_prediction(spark, d):
    return W.resolved(CTX, *predictions(spark, d))[1]


@register(f"WITH {PREDICTED_SQL} SELECT {minted('ep', 'resolve', 'belief_id')} AS episode_id, 'prediction resolved: yes' AS title, {STAMP} AS event_time FROM outcomes")
def resolution_episodes(spark, d):
    return W.resolved(CTX, *predictions(spark, d))[0]["episode"].select("episode_id", "title", "event_time")


@register(f"WITH {ctes('vector')} SELECT 'mem/ep/x' AS episode_id, 'retrieval-event' AS type, 'semantic' AS method, count(*) AS candidate_count FROM vector")
def retrieval_event(spark, d):
    candidates = view(spark, d, "vector").select("belief_id", F.lit(0.5).alias("similarity"))
    return W.retrieved(CTX, "mem/ep/x", candidates)["episode"].select("episode_id", "type", "method", "candidate_count")


@register(f"WITH {ctes('technique_detection')}, c AS (SELECT DISTINCT detecting_logic AS logic, detected_technique AS technique, length(detecting_logic) % 4 / 4.0::DOUBLE AS confidence FROM technique_detection) SELECT concat(logic, ' ', technique) AS key, concat('detection ''', logic, ''' detects technique ''', technique, ''' (confidence ', CASE WHEN confidence = 0 THEN '0' ELSE confidence::VARCHAR END, ')') AS title, confidence FROM c")
def detection_claims(spark, d):
    t = view(spark, d, "technique_detection").select(F.col("detecting_logic").alias("logic"), F.col("detected_technique").alias("technique")).distinct()
    rows = t.select(F.concat_ws(" ", "logic", "technique").alias("key"), "logic", "technique", F.lit("external-tool").alias("method"), (F.length("logic") % 4 / F.lit(4.0)).alias("confidence"))
    return W.claims_of(CTX, rows).select("key", "title", "confidence")


@register(f"WITH {ctes('alert_disposition')} SELECT DISTINCT disposition_belief AS key, concat('disposition of detection ''', dispositioned_logic, ''': ', detection_verdict) AS title, 'human-assertion' AS method FROM alert_disposition")
def detection_verdicts(spark, d):
    rows = view(spark, d, "alert_disposition").select(F.col("disposition_belief").alias("key"), F.col("dispositioned_logic").alias("logic"), F.col("detection_verdict").alias("verdict")).distinct()
    return W.verdicts_of(CTX, rows).select("key", "title", "method")


@register(f"WITH {ctes('belief')}, {SUPERSEDE_SQL} SELECT belief_state, count(*) AS n, count(valid_from) AS dated FROM (SELECT belief_id, CASE WHEN k % 5 = 0 THEN 'superseded' ELSE belief_state END AS belief_state, valid_from FROM belief UNION ALL SELECT title, 'asserted', {STAMP} FROM tiers) GROUP BY 1")
def store_write_and_read(spark, d):
    """Beliefs written to a store, some superseded in a second commit, and read back."""
    import uuid

    from tessera.store import Store

    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    beliefs = view(spark, d, "belief")
    base = store.commit({}, 0, adds={"belief": beliefs})
    held = store.read("belief")
    adds, flipped = W.superseding(CTX, replacements(spark, d), held)
    store.commit({}, base, adds={"belief": adds["belief"]}, patches={"belief": (flipped, ["belief_id"])})
    return store.read("belief").groupBy("belief_state").agg(F.count("*").alias("n"), F.count("valid_from").alias("dated"))


LIVE = "live AS (SELECT * FROM episode WHERE consolidation_state IS NULL OR consolidation_state <> 'tombstoned')"
#: Some episodes have a second owner; cohorts share all owners.
OWNERS_SQL = "owners AS (SELECT episode_id, owner FROM episode UNION SELECT episode_id, 'user-0' FROM episode WHERE length(episode_id) % 2 = 0), sets AS (SELECT episode_id, list_sort(list(DISTINCT owner)) AS own FROM owners WHERE owner IS NOT NULL GROUP BY episode_id)"


def owned(spark, d):
    e = view(spark, d, "episode")
    return e, e.select("episode_id", "owner").where("owner is not null").union(e.where("length(episode_id) % 2 = 0").select("episode_id", F.lit("user-0")))


@register(f"WITH {ctes('episode')}, {LIVE}, {OWNERS_SQL} SELECT episode_id, keeper FROM (SELECT episode_id, first_value(episode_id) OVER (PARTITION BY title, event_time, own ORDER BY ingest_time, episode_id) AS keeper FROM live JOIN sets USING (episode_id)) WHERE episode_id <> keeper")
def dedup_by_owner_sets(spark, d):
    return jobs.dedup_episodes(*owned(spark, d))


@register(f"WITH {ctes('episode')}, {LIVE}, {OWNERS_SQL}, lost AS (SELECT episode_id FROM (SELECT episode_id, row_number() OVER (PARTITION BY title, event_time, own ORDER BY ingest_time, episode_id) AS place FROM live JOIN sets USING (episode_id)) WHERE place > 1) SELECT coalesce(CASE WHEN episode_id IN (SELECT episode_id FROM lost) THEN 'tombstoned' ELSE consolidation_state END, 'live') AS state, count(*) AS n FROM episode GROUP BY 1")
def consolidation_tick(spark, d):
    after, _ = jobs.tick(*owned(spark, d))
    return after.groupBy(F.coalesce("consolidation_state", F.lit("live")).alias("state")).agg(F.count("*").alias("n"))


@register("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_by_day(spark, d):
    """The tumbling windows of the stream, over all events at once."""
    found = streaming.activity(read(spark, d, "events"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


# Populations.


@register(f"WITH {ctes('population_member')} SELECT member, valid_from, CASE WHEN valid_to IS NULL THEN {ts(AT)} ELSE valid_to END AS valid_to, CASE WHEN valid_to IS NULL THEN {ts(AT)} ELSE computed_at END AS computed_at FROM population_member WHERE spec_hash = 'pop/3' AND member = 'cust/2' UNION ALL SELECT member, valid_from, valid_to, computed_at FROM population_member WHERE NOT (spec_hash = 'pop/3' AND member = 'cust/2')")
def population_close_one(spark, d):
    rows, _ = populations.close_one(view(spark, d, "population_member"), "pop/3", "cust/2", AT)
    return rows.select("member", "valid_from", "valid_to", "computed_at")


@register(f"WITH {ctes('population_member')}, {PLAN} SELECT action, count(*) AS n FROM plan GROUP BY action")
def population_report(spark, d):
    counts = populations.report(view(spark, d, "population_member"), requested(spark, d))
    return spark.createDataFrame([(a, n) for a, n in counts.items() if n], "action string, n long")


@register(f"WITH {ctes('population_member')} SELECT max(greatest(valid_from, valid_to, computed_at)) AS latest FROM population_member")
def population_staleness(spark, d):
    return populations.latest(view(spark, d, "population_member"))


@register("SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND c_mktsegment = 'BUILDING'")
def population_strict(spark, d):
    return populations.strict(read(spark, d, "customer"), populations.SPARK_SQL, "c_acctbal > 100 and c_mktsegment = 'BUILDING'").select("c_custkey")


# Schema.

TYPES = sorted(schema.PARENTS)
TYPED_SQL = f"typed AS (SELECT o_orderkey AS id, [{', '.join(repr(t) for t in TYPES)}][(o_orderkey % {len(TYPES)})::INT + 1] AS type FROM orders)"


def typed(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % len(TYPES)).cast("int")).alias("type"))


PARENTS_SQL = "parents AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {repr(p) if p else 'NULL'})" for t, p in sorted(schema.PARENTS.items())) + ") AS p(type, parent)), below AS (SELECT 'memory-item' AS type UNION SELECT p.type FROM parents p JOIN below b ON p.parent = b.type)"


@register(f"WITH RECURSIVE {TYPED_SQL}, {PARENTS_SQL} SELECT id, type FROM typed WHERE type IN (SELECT type FROM below)")
def isa(spark, d):
    return schema.isa(typed(spark, d), "memory-item")


@register(f"WITH {TYPED_SQL} SELECT id, type FROM typed WHERE type = 'episode'")
def isa_exact(spark, d):
    return schema.isa(typed(spark, d), "episode", exact=True)


@register(f"WITH {TYPED_SQL}, names AS (SELECT id, concat(CASE WHEN id % 3 = 0 THEN '1' ELSE '' END, type, CASE WHEN id % 5 = 0 THEN ' x' ELSE '' END) AS name FROM typed) SELECT id, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_-]*') AS safe FROM names")
def label_safety(spark, d):
    name = F.concat(F.when(F.col("id") % 3 == 0, "1").otherwise(""), "type", F.when(F.col("id") % 5 == 0, " x").otherwise(""))
    return typed(spark, d).select("id", schema.is_label(name).alias("safe"))


@register(f"WITH {ctes('belief')}, odd AS (SELECT belief_id, CASE WHEN k % 6 = 0 THEN concat(belief_state, '?') ELSE belief_state END AS belief_state, entrenchment FROM belief) SELECT belief_id, 'belief_state' AS name, belief_state AS value FROM odd WHERE belief_state NOT IN ('asserted', 'superseded', 'contested', 'retracted')")
def enum_violations(spark, d):
    b = view(spark, d, "belief").withColumn("belief_state", F.when(F.col("k") % 6 == 0, F.concat("belief_state", F.lit("?"))).otherwise(F.col("belief_state")))
    return schema.enum_violations(b.select("belief_id", "belief_state", "entrenchment"), "belief_id")


SURFACE = schema.belief_surface()


@register(f"WITH RECURSIVE {PARENTS_SQL}, roles AS (SELECT * FROM (VALUES {', '.join(f'({r!r}, {p!r})' for r, roles in sorted(schema.RELATIONS.items()) for p in roles.values())}) AS r(relation, player)) SELECT 'type' AS kind, type AS name FROM below UNION ALL SELECT DISTINCT 'relation', relation FROM roles WHERE player IN (SELECT type FROM below)")
def belief_surface(spark, d):
    own = schema.belief_surface()
    return spark.createDataFrame([("type", t) for t in own["types"]] + [("relation", r) for r in own["relations"]], "kind string, name string")


@register(f"WITH {ctes('informs_synthesis')} SELECT DISTINCT synthesized, retrieval FROM informs_synthesis WHERE length(retrieval) % 2 = 0")
def retrieval_provenance_typed(spark, d):
    """Players of another type than retrieval events are left out."""
    informs = view(spark, d, "informs_synthesis")
    players = informs.select(F.col("retrieval").alias("episode_id"), F.when(F.length("retrieval") % 2 == 0, "retrieval-event").otherwise("sighting").alias("type")).distinct()
    return B.retrieval_provenance_of(informs, episodes=players)


# Text.

BODY_SQL = "bodies AS (SELECT doc_id, lang, regexp_replace(substr(text, 1, 40), '[^a-zA-Z ]', '', 'g') AS t FROM documents)"


def bodies(spark, d):
    """Each document as markdown with a fence in JavaScript, one in another language and, sometimes, a second program."""
    t = F.regexp_replace(F.substring("text", 1, 40), "[^a-zA-Z ]", "")
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n```quickjs x\n  two\n```\n"))).otherwise("\n")
    body = F.concat(F.lit("intro\n```js\nrun("), t, F.lit(")\n```\nmid\n```python\nno\n```"), second)
    return read(spark, d, "documents").select("doc_id", body.alias("body"))


@register(f"WITH {BODY_SQL} SELECT doc_id, 0 AS place, 'js' AS lang, concat('run(', t, ')') AS code FROM bodies UNION ALL SELECT doc_id, 1, 'python', 'no' FROM bodies UNION ALL SELECT doc_id, 2, 'quickjs', 'two' FROM bodies WHERE doc_id % 2 = 0")
def extract_fences(spark, d):
    return bodies(spark, d).select("doc_id", F.posexplode(markdown.fences(F.col("body"))).alias("place", "f")).select("doc_id", "place", "f.lang", "f.code")


@register(f"WITH {BODY_SQL} SELECT doc_id, concat('run(', t, ')', CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'two' ELSE '' END) AS program FROM bodies")
def extract_program(spark, d):
    return bodies(spark, d).select("doc_id", markdown.program(F.col("body"), F.lit("js")).alias("program"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS at FROM orders")
def parse_rfc3339(spark, d):
    from tessera.sources.bundle import moment

    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on "), F.col("o_orderdate").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    shifted = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    return o.select("o_orderkey", moment(F.coalesce(text, shifted)).alias("at"))


@register(
    """SELECT c_custkey, 'domain' AS kind, concat('host', c_custkey, '.example.org') AS value FROM customer
UNION ALL SELECT c_custkey, 'ipv4', concat('10.0.', c_custkey % 256, '.', c_nationkey) FROM customer
UNION ALL SELECT c_custkey, 'ipv6', CASE WHEN c_custkey % 65536 = 0 THEN '2001:db8::' ELSE concat('2001:db8::', lower(printf('%x', c_custkey % 65536))) END FROM customer
UNION ALL SELECT c_custkey, 'email-addr', concat('User', c_custkey, '@mail.example.org') FROM customer
UNION ALL SELECT c_custkey, 'file-md5', concat('abcdef', c_custkey) FROM customer UNION ALL SELECT c_custkey, 'mutex', concat('Global\\M', c_custkey) FROM customer"""
)
def normalize_iocs(spark, d):
    """Indicators of each kind, written with other case and defanged, in canonical form."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    forms = {
        "domain": F.concat(F.lit("HOST"), k, F.lit("[.]Example(dot)ORG.")),
        "ipv4": F.concat(F.lit("10[.]0{.}"), (F.col("c_custkey") % 256).cast("string"), F.lit("(.)"), F.col("c_nationkey").cast("string")),
        "ipv6": F.concat(F.lit("2001:0DB8:0:0:0:0:0000:"), F.lpad(F.hex(F.col("c_custkey") % 65536), 4, "0")),
        "email-addr": F.concat(F.lit("User"), k, F.lit("[@]MAIL[.]example[.]org")),
        "file-md5": F.concat(F.lit("ABCdef"), k),
        "mutex": F.concat(F.lit("  Global\\M"), k, F.lit(" ")),
    }
    rows = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), v.alias("raw")) for n, v in forms.items()))).alias("x"))
    return rows.select("c_custkey", "x.kind", normalize_ioc(F.col("x.kind"), F.col("x.raw")).alias("value"))


@register("SELECT n_nationkey, sha256(concat('{\"a\":{\"c\":\"', n_name, '\",\"d\":[1,2]},\"b\":', n_nationkey, '}')) AS hash FROM nation UNION ALL SELECT n_nationkey, sha256(concat('{\"a\":{\"c\":\"', n_name, '\",\"d\":[1,2]},\"b\":', n_nationkey, '}')) FROM nation")
def canonical_json(spark, d):
    """Two spellings of the same objects have the same hashes."""
    n = read(spark, d, "nation")
    one = F.concat(F.lit('{"b": '), "n_nationkey", F.lit(', "a": {"d": [1, 2], "c": "'), "n_name", F.lit('"}}'))
    two = F.concat(F.lit('{"a":{"c":"'), "n_name", F.lit('","d":[1,2]},"b":'), "n_nationkey", F.lit("}"))
    rows = n.select("n_nationkey", one.alias("o")).union(n.select("n_nationkey", two))
    return rows.select("n_nationkey", F.sha2(stix.canonical(F.col("o")).cast("binary"), 256).alias("hash"))


# STIX.


def stix_objects(spark, d):
    """Suppliers as malware, parts as attack patterns; line items are uses (typed) or references (plain links)."""
    s, p, line = read(spark, d, "supplier"), read(spark, d, "part"), read(spark, d, "lineitem").where("l_linenumber = 1")
    one = lambda t, key, name: F.to_json(F.struct(F.lit(t).alias("type"), F.concat(F.lit(f"{t}--"), key).alias("id"), F.col(name).alias("name"))).alias("object")
    kind = F.when(F.col("l_orderkey") % 2 == 0, "uses").otherwise("related-to")
    edge = F.to_json(F.struct(F.lit("relationship").alias("type"), kind.alias("relationship_type"), F.concat(F.lit("malware--"), "l_suppkey").alias("source_ref"), F.concat(F.lit("attack-pattern--"), "l_partkey").alias("target_ref")))
    return s.select(one("malware", "s_suppkey", "s_name")).union(p.select(one("attack-pattern", "p_partkey", "p_name"))).union(line.select(edge))


EDGES_SQL = "edges AS (SELECT concat('stix/malware/', l_suppkey) AS source, concat('stix/attack-pattern/', l_partkey) AS target, CASE WHEN l_orderkey % 2 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) THEN 'uses' END AS relation FROM lineitem WHERE l_linenumber = 1)"


@register(f"WITH {EDGES_SQL} SELECT source, target, coalesce(relation, 'link') AS relation, count(*) AS n FROM edges GROUP BY ALL")
def stix_relations(spark, d):
    objects = stix_objects(spark, d)
    found = stix.relations(objects, stix.concepts(objects))
    return found.groupBy("source", "target", F.coalesce("relation", F.lit("link")).alias("relation")).agg(F.count("*").alias("n"))


@register(f"WITH {EDGES_SQL} SELECT DISTINCT source, target, relation FROM edges WHERE relation IS NOT NULL AND target NOT LIKE '%1'")
def stix_typed_edges(spark, d):
    objects = stix_objects(spark, d)
    found = stix.relations(objects, stix.concepts(objects))
    held = found.where("relation is not null and target like '%1'").select("source", "target", "relation")
    return stix.post_sync(found, held)


# Sync.


@register(f"WITH {ctes('stored', 'manifest')}, gone AS (SELECT concept_id FROM stored WHERE concept_id NOT IN (SELECT concept_id FROM manifest)), players AS (SELECT concept_id FROM stored WHERE file_hash < '8') SELECT DISTINCT concept_id, CASE WHEN concept_id IN (SELECT concept_id FROM players) THEN 'retire' ELSE 'delete' END AS fate FROM gone")
def retire_or_delete(spark, d):
    held = view(spark, d, "stored")
    gone = held.join(view(spark, d, "manifest"), "concept_id", "left_anti").select("concept_id").distinct()
    return sync.retire_or_delete(gone, held.where("file_hash < '8'"))


PAIRS_SQL = "pairs AS (SELECT concat('doc/', doc_id) AS a, concat('doc/', doc_id + 3) AS b FROM documents)"


def neighbours(spark, d):
    return read(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("a"), F.concat(F.lit("doc/"), F.col("doc_id") + 3).alias("b"))


@register(f"WITH {ctes('manifest')}, {PAIRS_SQL} SELECT a, b FROM pairs WHERE a IN (SELECT concept_id FROM manifest) AND b IN (SELECT concept_id FROM manifest)")
def links_within_bundle(spark, d):
    return sync.within(neighbours(spark, d), view(spark, d, "manifest"), "a", "b")


@register(f"WITH {PAIRS_SQL} SELECT a, b FROM pairs WHERE a NOT LIKE '%2'")
def links_missing(spark, d):
    pairs = neighbours(spark, d)
    return sync.missing_from(pairs.union(pairs), pairs.where("a like '%2'"), ["a", "b"])


@register(f"WITH {ctes('stored')} SELECT bundle_name, count(*) AS n FROM stored GROUP BY 1 UNION ALL SELECT 'empty', 0")
def bundle_status(spark, d):
    from tessera.plans.bundle_sync import bundle_counts

    held = view(spark, d, "stored").select("bundle_name", "concept_id")
    names = held.select("bundle_name").distinct().union(spark.createDataFrame([("empty",)], "bundle_name string"))
    return bundle_counts(names, held).select("bundle_name", "n")


@register("WITH " + ctes(*TIER[:3]) + ", counted AS (SELECT title AS label, count(*) AS n FROM belief GROUP BY 1) SELECT label, 'rows' AS measure, n FROM counted UNION ALL SELECT 'no such', 'rows', 0")
def fingerprint_by_label(spark, d):
    rows = view(spark, d, "belief").select(F.col("title").alias("label"))
    return jobs.fingerprint_by_label(rows, [*(r[0] for r in rows.distinct().collect()), "no such"], "rows")


# Index.


@register("SELECT concat('v', vec_id) AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT concat('w', vec_id), 'new' FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 7 <> 0")
def index_upsert_and_remove(spark, d):
    e = read(spark, d, "embeddings")
    old = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding"), F.lit("old").alias("model"))
    some = e.where("vec_id % 3 = 0")
    new = some.select(F.concat(F.lit("v"), "vec_id").alias("id"), "embedding", F.lit("new").alias("model")).union(some.select(F.concat(F.lit("w"), "vec_id"), "embedding", F.lit("new")))
    dim = len(e.first()["embedding"])
    gone = e.where("vec_id % 7 = 0").select(F.explode(F.array(F.concat(F.lit("v"), "vec_id"), F.concat(F.lit("w"), "vec_id"))).alias("id"))
    return retrieval.remove(retrieval.upsert(old, new, dim), gone).select("id", "model")


@register("SELECT concat('v', vec_id) AS id, CASE WHEN vec_id % 4 = 0 THEN 'again' ELSE 'old' END AS model FROM embeddings WHERE vec_id % 4 <> 0 OR vec_id % 8 = 0")
def index_drain_dirty(spark, d):
    e = read(spark, d, "embeddings")
    name = F.concat(F.lit("v"), "vec_id").alias("id")
    embeddable = e.where("vec_id % 8 = 0 or vec_id % 4 <> 0").select(name, F.lit("again").alias("model"))
    return retrieval.drain_dirty(e.select(name, F.lit("old").alias("model")), e.where("vec_id % 4 = 0").select(name), embeddable)


@register("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 1")
def index_prefilter(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("agent-"), F.col("vec_id") % 5).alias("owner"), F.when(F.col("vec_id") % 3 == 0, "private").otherwise(F.when(F.col("vec_id") % 3 == 1, "team")).alias("visibility"))
    return retrieval.prefilter(e, "agent-1").select("vec_id")


@register(
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), scored AS (SELECT query, vec_id, round(list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e, e)), 6) AS similarity FROM embeddings, q),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM scored) SELECT query, vec_id, similarity, place FROM placed WHERE place <= 5"""
)
def similar_topk_batch(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return retrieval.similar_topk_batch(e, queries, 5, "vec_id", "query")
