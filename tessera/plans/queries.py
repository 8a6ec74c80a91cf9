"""The registered queries over the star-schema projections, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown
from tessera.functions.ioc import normalize_ioc
from tessera.operators import beliefs as B
from tessera.operators import detection, disposition, graph, jobs, populations, retrieval, sync
from tessera.sources import bundle
from tessera.sources.star import ctes, view

AGENT, NOW, T = "agent-7", "1998-06-01 00:00:00", "1998-06-01 00:00:00"
BLAST, MEMBER, AT = "mem/bel/100", "cust/1", "1998-01-01 00:00:00"
ID_T = "1997-01-01 00:00:00"
WEEKS = 86_400 * 365 * 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def ts(t: str) -> str:
    return f"TIMESTAMP '{t}'"


def one(spark: SparkSession, value: str) -> DataFrame:
    return spark.createDataFrame([(value,)], "seed string")


BELIEVED = f"belief_state = 'asserted' AND valid_from <= {ts(T)} AND (valid_to IS NULL OR valid_to > {ts(T)})"
GATED = f"""gated AS (SELECT b.* FROM belief b WHERE b.{BELIEVED.replace('AND valid_from', 'AND b.valid_from')}
  AND NOT EXISTS (SELECT 1 FROM supersession s WHERE s.superseded = b.belief_id)
  AND EXISTS (SELECT 1 FROM ownership o WHERE o.owned = b.belief_id AND (o.visibility IN ('team', 'shared') OR o.owner = '{AGENT}'))
  AND EXISTS (SELECT 1 FROM ownership o WHERE o.owner = '{AGENT}'))"""
DECAY = f"CASE WHEN date_diff('second', last_access, {ts(NOW)}) > 0 THEN pow(0.5, date_diff('second', last_access, {ts(NOW)}) / 3600.0 / 168) ELSE 1.0 END"
SELECTED = f"selected AS (SELECT *, base_activation + salience AS score, (base_activation + salience) * ({DECAY}) AS rank FROM gated WHERE last_access <= {ts(NOW)} AND base_activation + salience IS NOT NULL)"
GATE_CTES = f"WITH {ctes('belief', 'ownership', 'supersession')}, {GATED}"


def selected(spark: SparkSession, d: str) -> DataFrame:
    return B.select_for_context(view(spark, d, "belief"), view(spark, d, "ownership"), view(spark, d, "supersession"), AGENT, NOW)


@register(f"WITH {ctes('belief')} SELECT belief_id FROM belief WHERE {BELIEVED}")
def believed_at(spark, d):
    return B.believed_at(view(spark, d, "belief"), T).select("belief_id")


SUPERSEDED = "gone AS (SELECT belief_id FROM belief WHERE belief_state IN ('superseded', 'retracted') OR belief_id IN (SELECT superseded FROM supersession))"


@register(f"WITH {ctes('belief', 'supersession')}, {SUPERSEDED} SELECT belief_id FROM gone")
def is_superseded(spark, d):
    return B.superseded(view(spark, d, "belief"), view(spark, d, "supersession")).select("belief_id")


@register(f"{GATE_CTES} SELECT belief_id FROM gated")
def gate(spark, d):
    return B.gate(view(spark, d, "belief"), view(spark, d, "ownership"), view(spark, d, "supersession"), AGENT, NOW).select("belief_id")


@register(f"WITH {ctes('contradiction_claim')} SELECT DISTINCT a.claim AS b1, b.claim AS b2 FROM contradiction_claim a JOIN contradiction_claim b USING (rel_id) WHERE a.claim <> b.claim")
def contradicts(spark, d):
    return B.contradicts(view(spark, d, "contradiction_claim"))


@register(f"WITH {ctes('belief')} SELECT belief_id, round(base_activation + salience, 6) AS score, round(({DECAY}), 6) AS decay FROM belief WHERE last_access <= {ts(NOW)} AND base_activation + salience IS NOT NULL")
def retrieval_score(spark, d):
    scored = B.retrieval_score(view(spark, d, "belief"), NOW)
    return scored.select("belief_id", F.round("score", 6).alias("score"), F.round(B.decay(F.col("last_access"), NOW), 6).alias("decay"))


@register(f"{GATE_CTES}, {SELECTED} SELECT belief_id, round(score, 6) AS score, round(rank, 6) AS rank FROM selected")
def select_for_context(spark, d):
    return selected(spark, d).select("belief_id", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"))


def reach_sql(edges: str, seeds: str) -> str:
    return f"reached AS (SELECT s.seed, e.dst AS node FROM ({seeds}) s JOIN ({edges}) e ON e.src = s.seed UNION SELECT r.seed, e.dst FROM reached r JOIN ({edges}) e ON e.src = r.node) SELECT seed, node FROM reached"


DERIVED = "SELECT DISTINCT derived AS src, source AS dst FROM derivation"


@register(f"WITH RECURSIVE {ctes('derivation')}, {reach_sql(DERIVED, "SELECT max(derived) AS seed FROM derivation")}")
def derivation_chain(spark, d):
    derivation = view(spark, d, "derivation")
    return graph.derivation_chain(derivation, derivation.agg(F.max("derived").alias("seed")))


@register(f"WITH RECURSIVE {ctes('derivation')}, {reach_sql(DERIVED, "SELECT DISTINCT derived AS seed FROM derivation")}")
def derivation_chain_all_pairs(spark, d):
    derivation = view(spark, d, "derivation")
    return graph.derivation_chain(derivation, derivation.select(F.col("derived").alias("seed")).distinct())


def impact(spark, d, t=None):
    return graph.impact_edges(view(spark, d, "rests_on"), view(spark, d, "derivation"), view(spark, d, "population_member"), view(spark, d, "scoped"), t)


def impact_sql(window: str) -> str:
    return f"""SELECT assumption AS src, resting AS dst FROM rests_on UNION SELECT source, derived FROM derivation
UNION SELECT m.member, s.scoped_belief FROM population_member m JOIN scoped s USING (spec_hash) WHERE {window}"""


IMPACT_VIEWS = ctes("rests_on", "derivation", "population_member", "scoped")


@register(f"WITH RECURSIVE {IMPACT_VIEWS}, {reach_sql(impact_sql('m.valid_to IS NULL'), f"SELECT '{BLAST}' AS seed")}")
def blast_radius(spark, d):
    return graph.blast_radius(impact(spark, d), one(spark, BLAST))


@register(f"WITH RECURSIVE {IMPACT_VIEWS}, {reach_sql(impact_sql(f'm.valid_from <= {ts(AT)} AND (m.valid_to IS NULL OR m.valid_to > {ts(AT)})'), f"SELECT '{MEMBER}' AS seed")}")
def blast_radius_at(spark, d):
    return graph.blast_radius(impact(spark, d, AT), one(spark, MEMBER))


def identity_sql(live: str) -> str:
    return f"""links AS (SELECT record_a AS a, record_b AS b FROM resolves WHERE {live} AND resolution IN (SELECT derived FROM resolution_derivation WHERE derivation_method IN ('type-join', 'cardinality', 'functional-dependency'))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), pairs AS (SELECT a AS seed, a AS node FROM both_ways UNION SELECT p.seed, w.b FROM pairs p JOIN both_ways w ON w.a = p.node)"""


ID_NOW, ID_AT = identity_sql("belief_state = 'asserted'"), identity_sql(f"valid_from <= {ts(ID_T)} AND (valid_to IS NULL OR valid_to > {ts(ID_T)})")


def all_records(spark, d):
    r = view(spark, d, "resolves")
    return r.select(F.col("record_a").alias("seed")).union(r.select("record_b")).distinct()


@register(f"WITH RECURSIVE {ctes('resolves', 'resolution_derivation')}, {ID_NOW} SELECT seed, node FROM pairs")
def canonical_entity(spark, d):
    return graph.canonical_entity(view(spark, d, "resolves"), view(spark, d, "resolution_derivation"), all_records(spark, d))


@register(f"WITH RECURSIVE {ctes('resolves', 'resolution_derivation')}, {ID_AT} SELECT seed, node FROM pairs")
def canonical_entity_at(spark, d):
    return graph.canonical_entity(view(spark, d, "resolves"), view(spark, d, "resolution_derivation"), all_records(spark, d), ID_T)


@register(f"WITH RECURSIVE {ctes('resolves', 'resolution_derivation')}, {ID_NOW} SELECT seed AS record, min(node) AS entity FROM pairs GROUP BY seed")
def canonical_components(spark, d):
    return graph.canonical_components(view(spark, d, "resolves"), view(spark, d, "resolution_derivation"))


@register(f"WITH {ctes('population_member')} SELECT DISTINCT spec_hash, member FROM population_member WHERE valid_to IS NULL")
def population_members(spark, d):
    return populations.members(view(spark, d, "population_member"))


@register(f"WITH {ctes('population_member')} SELECT DISTINCT spec_hash, member FROM population_member WHERE valid_from <= {ts(AT)} AND (valid_to IS NULL OR valid_to > {ts(AT)})")
def population_members_at(spark, d):
    return populations.members_at(view(spark, d, "population_member"), AT)


PASS_AT = "2001-09-01 00:00:00"
#: The pass asks for every customer in debt of no more than nothing: some stay, some come, some go.
REQUESTED = "SELECT DISTINCT concat('pop/', c_nationkey) AS spec_hash, concat('cust/', c_custkey) AS member FROM customer WHERE c_acctbal >= 0"
PLAN = f"""requested AS ({REQUESTED}), held AS (SELECT DISTINCT spec_hash, member FROM population_member WHERE valid_to IS NULL AND spec_hash IN (SELECT spec_hash FROM requested)),
steps AS (SELECT spec_hash, member, 'open' AS action FROM requested EXCEPT SELECT spec_hash, member, 'open' FROM held),
closing AS (SELECT spec_hash, member, 'close' AS action FROM held EXCEPT SELECT spec_hash, member, 'close' FROM requested),
refreshing AS (SELECT spec_hash, member, 'refresh' AS action FROM held INTERSECT SELECT spec_hash, member, 'refresh' FROM requested),
plan AS (SELECT * FROM steps UNION ALL SELECT * FROM closing UNION ALL SELECT * FROM refreshing)"""


def requested(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal >= 0")
    return c.select(F.concat(F.lit("pop/"), "c_nationkey").alias("spec_hash"), F.concat(F.lit("cust/"), "c_custkey").alias("member"))


@register(f"WITH {ctes('population_member')}, {PLAN} SELECT * FROM plan")
def population_plan(spark, d):
    return populations.plan(view(spark, d, "population_member"), requested(spark, d))


@register(
    f"""WITH {ctes('population_member')}, {PLAN} SELECT m.spec_hash, m.member, m.valid_from,
CASE WHEN m.valid_to IS NULL AND p.action = 'close' THEN {ts(PASS_AT)} ELSE m.valid_to END AS valid_to,
CASE WHEN m.valid_to IS NULL AND p.action IN ('close', 'refresh') THEN {ts(PASS_AT)} ELSE m.computed_at END AS computed_at
FROM population_member m LEFT JOIN (SELECT * FROM plan WHERE action <> 'open') p ON p.spec_hash = m.spec_hash AND p.member = m.member
UNION ALL SELECT spec_hash, member, {ts(PASS_AT)}, NULL, {ts(PASS_AT)} FROM plan WHERE action = 'open'"""
)
def population_materialize(spark, d):
    return populations.materialize(view(spark, d, "population_member"), requested(spark, d), PASS_AT)


LIVE = "live AS (SELECT * FROM episode WHERE consolidation_state IS NULL OR consolidation_state <> 'tombstoned')"


def episodes(spark, d):
    e = view(spark, d, "episode")
    return e, e.select("episode_id", "owner").where("owner is not null")


@register(f"WITH {ctes('episode')}, {LIVE} SELECT episode_id FROM live JOIN (SELECT title, event_time, owner FROM live GROUP BY ALL HAVING count(*) > 1) USING (title, event_time, owner)")
def duplicate_episode_candidates(spark, d):
    return jobs.duplicate_episode_candidates(*episodes(spark, d)).select("episode_id")


@register(f"WITH {ctes('episode')}, {LIVE} SELECT episode_id, keeper FROM (SELECT episode_id, first_value(episode_id) OVER (PARTITION BY title, event_time, owner ORDER BY ingest_time, episode_id) AS keeper FROM live) WHERE episode_id <> keeper")
def dedup_episodes(spark, d):
    return jobs.dedup_episodes(*episodes(spark, d))


RETENTION = f"WITH {ctes('belief', 'supersession', 'informs_synthesis')}, {SUPERSEDED}, flags AS (SELECT retrieval, synthesized IN (SELECT belief_id FROM gone) AS f FROM informs_synthesis)"


def informed(spark, d):
    return view(spark, d, "informs_synthesis"), B.superseded(view(spark, d, "belief"), view(spark, d, "supersession"))


@register(f"{RETENTION} SELECT retrieval FROM flags GROUP BY retrieval HAVING bool_or(f)")
def retention_any(spark, d):
    return jobs.retention_any(*informed(spark, d))


@register(f"{RETENTION} SELECT retrieval FROM flags GROUP BY retrieval HAVING bool_and(f)")
def retention_all(spark, d):
    return jobs.retention_all(*informed(spark, d))


TIER = ["belief", "episode", "ownership", "supersession", "derivation", "rests_on", "contradiction_claim", "population_member", "scoped", "resolves", "informs_synthesis"]


@register(f"WITH {ctes(*TIER)} " + " UNION ALL ".join(f"SELECT '{t}' AS label, 'rows' AS measure, count(*) AS n FROM {t}" for t in TIER))
def tier_fingerprint(spark, d):
    return jobs.fingerprint({(t, "rows"): view(spark, d, t) for t in TIER})


METHOD_CASE = "CASE derivation_method " + " ".join(f"WHEN '{m}' THEN {r}" for m, r in disposition.METHOD_RANK.items()) + " ELSE -1 END"
EFFECTIVE = f"effective AS (SELECT derived AS belief_id, arg_min(derivation_method, struct_pack(r := {METHOD_CASE}, m := derivation_method)) AS method FROM derivation GROUP BY derived)"


@register(f"WITH {ctes('derivation')}, {EFFECTIVE} SELECT belief_id, method FROM effective")
def effective_method(spark, d):
    return disposition.effective_method(view(spark, d, "derivation"))


COMPETE = f"""competitors AS (SELECT c.rel_id AS group_id, b.belief_id, {METHOD_CASE.replace('derivation_method', 'e.method')} AS k1,
  CASE WHEN b.confidence IS NULL OR isnan(b.confidence) THEN CASE WHEN {METHOD_CASE.replace('derivation_method', 'e.method')} = 2 THEN 1.0 ELSE 0.5 END ELSE b.confidence END AS k2,
  CASE b.entrenchment {' '.join(f"WHEN '{t}' THEN {s}" for t, s in disposition.STRENGTH.items())} ELSE 0 END AS k3, coalesce(b.valid_from, TIMESTAMP '0001-01-01') AS k4
  FROM contradiction_claim c JOIN belief b ON b.belief_id = c.claim LEFT JOIN effective e ON e.belief_id = b.belief_id),
ranked AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY group_id) AS n, lead(k1) OVER w AS n1, lead(k2) OVER w AS n2, lead(k3) OVER w AS n3, lead(k4) OVER w AS n4
  FROM competitors WINDOW w AS (PARTITION BY group_id ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, belief_id))"""


@register(
    f"""WITH {ctes('belief', 'derivation', 'contradiction_claim')}, {EFFECTIVE}, {COMPETE}
SELECT group_id, belief_id, n, n > 1 AND k1 = n1 AND k2 = n2 AND k3 = n3 AND k4 = n4 AS contested,
CASE WHEN n = 1 THEN 'sole competitor' WHEN k1 <> n1 THEN 'method rank' WHEN k2 <> n2 THEN 'confidence' WHEN k3 <> n3 THEN 'entrenchment' WHEN k4 <> n4 THEN 'recency' ELSE 'tie' END AS reason FROM ranked WHERE place = 1"""
)
def disposition_rank(spark, d):
    methods = disposition.effective_method(view(spark, d, "derivation"))
    rows = view(spark, d, "contradiction_claim").select(F.col("rel_id").alias("group_id"), F.col("claim").alias("belief_id"))
    rows = rows.join(view(spark, d, "belief"), "belief_id").join(methods, "belief_id", "left")
    return disposition.rank(rows)


def query_vector(spark, d) -> list[float]:
    """The query: the first vector of the table."""
    return spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").select("embedding").first()[0]


COSINE = "round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 6)"
QUERY_VECTOR = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


@register(f"WITH {ctes('vector')} SELECT belief_id, {COSINE} AS similarity FROM vector, {QUERY_VECTOR} ORDER BY 2 DESC, 1 LIMIT 10")
def similar_topk(spark, d):
    return retrieval.similar_topk(view(spark, d, "vector"), query_vector(spark, d), 10)


@register(f"WITH {ctes('belief')} SELECT belief_id, title AS text, 0.0::DOUBLE AS score FROM belief WHERE {BELIEVED} ORDER BY belief_id LIMIT 8")
def recall_as_of(spark, d):
    return retrieval.recall_as_of(view(spark, d, "belief"), T)


@register(f"{GATE_CTES}, {SELECTED} SELECT belief_id, '' AS text, 0.0::DOUBLE AS score, round(rank, 6) AS rank FROM selected ORDER BY selected.rank DESC, belief_id LIMIT 8")
def recall_fallback(spark, d):
    return retrieval.recall_fallback(selected(spark, d)).withColumn("rank", F.round("rank", 6))


CANDIDATES = f"candidates AS (SELECT belief_id, rank, {COSINE} AS similarity FROM selected JOIN vector USING (belief_id), {QUERY_VECTOR} ORDER BY similarity DESC, belief_id LIMIT 32)"


@register(f"WITH {ctes('belief', 'ownership', 'supersession', 'vector')}, {GATED}, {SELECTED}, {CANDIDATES} SELECT belief_id, similarity, round(rank, 6) AS rank FROM candidates ORDER BY candidates.rank DESC, belief_id LIMIT 8")
def recall_indexed(spark, d):
    found = retrieval.recall_indexed(view(spark, d, "vector"), selected(spark, d), query_vector(spark, d))
    return found.withColumn("rank", F.round("rank", 6))


@register(f"WITH {ctes('informs_synthesis')} SELECT DISTINCT synthesized, retrieval FROM informs_synthesis")
def retrieval_provenance_of(spark, d):
    return B.retrieval_provenance_of(view(spark, d, "informs_synthesis"))


#: Runs are customers' orders: what a run surfaced are the beliefs a derivation has as source, its evidence the sources of the run's beliefs.
CORRELATED = f"""surfaced AS (SELECT o_custkey AS run_id, concat('re/', o_custkey) AS retrieval, concat('mem/bel/', o_orderkey) AS concept_id FROM orders),
evidence AS (SELECT o_custkey AS run_id, d.derived AS belief_id, d.source AS concept_id FROM derivation d JOIN orders ON d.derived = concat('mem/bel/', o_orderkey))"""


@register(f"WITH {ctes('derivation')}, {CORRELATED} SELECT DISTINCT retrieval, belief_id FROM surfaced JOIN evidence USING (run_id, concept_id)")
def correlate_evidence(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("mem/bel/"), "o_orderkey").alias("belief_id"))
    surfaced = o.select("run_id", F.concat(F.lit("re/"), "run_id").alias("retrieval"), F.col("belief_id").alias("concept_id"))
    evidence = o.join(view(spark, d, "derivation"), o["belief_id"] == F.col("derived")).select("run_id", "belief_id", F.col("source").alias("concept_id"))
    return retrieval.correlate_evidence(surfaced, evidence)


EMBEDDABLE = """SELECT b.belief_id AS id, b.title AS text, 'belief' AS kind, o.owner, o.visibility FROM belief b JOIN ownership o ON o.owned = b.belief_id
WHERE b.belief_state = 'asserted' AND b.valid_from IS NOT NULL AND o.visibility IS NOT NULL
UNION ALL SELECT episode_id, title, 'episode', owner, NULL FROM episode WHERE consolidation_state IS NULL OR consolidation_state <> 'tombstoned'"""


@register(f"WITH {ctes('belief', 'ownership', 'episode')} {EMBEDDABLE}")
def enumerate_embeddables(spark, d):
    return retrieval.embeddables(view(spark, d, "belief"), view(spark, d, "ownership"), *episodes(spark, d)).drop("at")


DETECTED = "detected AS (SELECT t.* FROM technique_detection t JOIN belief b ON b.belief_id = t.detection_claim WHERE b.belief_state = 'asserted')"


@register(f"WITH {ctes('belief', 'technique_detection', 'requires_evidence')}, {DETECTED} SELECT DISTINCT technique FROM requires_evidence WHERE technique NOT IN (SELECT detected_technique FROM detected)")
def undetected_techniques(spark, d):
    return detection.undetected_techniques(view(spark, d, "requires_evidence"), view(spark, d, "technique_detection"), view(spark, d, "belief"))


@register(
    f"""WITH {ctes('belief', 'technique_detection', 'requires_evidence', 'sensor_coverage')}, {DETECTED} SELECT DISTINCT detecting_logic FROM detected
WHERE detected_technique IN (SELECT technique FROM requires_evidence WHERE required NOT IN (SELECT covered_component FROM sensor_coverage))"""
)
def blinded_detections(spark, d):
    return detection.blinded_detections(view(spark, d, "technique_detection"), view(spark, d, "belief"), view(spark, d, "requires_evidence"), view(spark, d, "sensor_coverage"))


@register(
    f"""WITH {ctes('belief', 'alert_disposition')}, counted AS (SELECT dispositioned_logic AS detecting_logic, count(*) FILTER (detection_verdict = 'true-positive') AS true_positives,
count(*) FILTER (detection_verdict = 'false-positive') AS false_positives FROM alert_disposition WHERE disposition_belief IN (SELECT belief_id FROM belief WHERE valid_from >= {ts(NOW)} - INTERVAL {WEEKS} SECOND) GROUP BY 1)
SELECT *, CASE WHEN true_positives + false_positives > 0 THEN round(true_positives::DOUBLE / (true_positives + false_positives), 6) END AS precision FROM counted"""
)
def detection_precision(spark, d):
    found = detection.precision(view(spark, d, "alert_disposition"), view(spark, d, "belief"), NOW, WEEKS)
    return found.withColumn("precision", F.round("precision", 6))


HELD = "mine AS (SELECT * FROM stored WHERE bundle_name = 'alpha'), clash AS (SELECT DISTINCT concept_id FROM manifest WHERE concept_id IN (SELECT concept_id FROM stored) AND concept_id NOT IN (SELECT concept_id FROM mine))"


@register(f"WITH {ctes('manifest', 'stored')}, {HELD} SELECT concept_id FROM clash")
def sync_collisions(spark, d):
    return sync.collisions(view(spark, d, "manifest"), view(spark, d, "stored"), "alpha")


@register(
    f"""WITH {ctes('manifest', 'stored')}, {HELD}, listed AS (SELECT * FROM manifest WHERE concept_id NOT IN (SELECT concept_id FROM clash))
SELECT coalesce(l.concept_id, m.concept_id) AS concept_id, CASE WHEN m.concept_id IS NULL THEN 'insert' WHEN l.concept_id IS NULL THEN 'delete' WHEN l.file_hash = m.file_hash THEN 'skip' ELSE 'update' END AS action
FROM listed l FULL JOIN mine m ON m.concept_id = l.concept_id"""
)
def sync_plan(spark, d):
    manifest, stored = view(spark, d, "manifest"), view(spark, d, "stored")
    return sync.plan_sync(manifest.join(sync.collisions(manifest, stored, "alpha"), "concept_id", "left_anti"), stored, "alpha")


#: Every third document (by content) is contained by a second bundle.
@register(
    f"""WITH {ctes('manifest', 'stored')}, {HELD}, containment AS (SELECT concept_id, bundle_name FROM stored UNION ALL SELECT concept_id, 'gamma' FROM stored WHERE file_hash < '5'),
gone AS (SELECT concept_id FROM mine WHERE concept_id NOT IN (SELECT concept_id FROM manifest))
SELECT concept_id, CASE WHEN concept_id IN (SELECT concept_id FROM containment WHERE bundle_name <> 'alpha') THEN 'release' ELSE 'delete' END AS fate FROM gone"""
)
def sync_split_gc(spark, d):
    manifest, stored = view(spark, d, "manifest"), view(spark, d, "stored")
    containment = stored.select("concept_id", "bundle_name").union(stored.where("file_hash < '5'").select("concept_id", F.lit("gamma")))
    deletes = sync.plan_sync(manifest, stored, "alpha").where("action = 'delete'")
    return sync.split_gc(deletes, containment, "alpha")


@register("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))


#: A page's URL without scheme and query serves as a concept's path.
PATHS = "paths AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages), split AS (SELECT string_split(p, '/') AS parts FROM paths)"


@register(f"WITH {PATHS} SELECT DISTINCT array_to_string(parts[1:k], '/') AS parent_id, array_to_string(parts[1:k + 1], '/') AS child_id FROM split, unnest(range(1, len(parts))) AS u(k)")
def hierarchy_edges(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return bundle.hierarchy(pages.select(path.alias("concept_id")).distinct())


#: Each page as a markdown concept that cites its URL and links to its neighbour.
@register(
    """SELECT concat('p/', page_id) AS source_id, concat('p/', page_id + 1) AS target_id, 'next' AS link_text FROM pages
UNION ALL SELECT concat('p/', page_id), url, 'source' FROM pages WHERE url NOT LIKE '%)%'"""
)
def extract_links(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    body = F.concat(F.lit("See [next](./"), (F.col("page_id") + 1).cast("string"), F.lit(".md#top), [source]("), F.col("url"), F.lit(") and ![image](x.md)."))
    concepts = pages.select(F.concat(F.lit("p/"), "page_id").alias("concept_id"), body.alias("body"), "url")
    return bundle.links(concepts).union(bundle.citations(concepts.where("url not like '%)%'")))


@register("SELECT page_id, concat(lower(regexp_extract(url, '^(.*?)://', 1)), '://', lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), regexp_replace(url, '^.*?://[^/?#]*', '')) AS ioc_value FROM pages")
def normalize_ioc_urls(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", normalize_ioc(F.lit("url"), F.col("url")).alias("ioc_value"))


FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(octet_length(encode(token))), lambda i: ('0x' || substr(hex(encode(token)), 2 * i + 1, 2))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@register(
    f"""WITH words AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[\\s\\x1c-\\x1f\\x85\\pZ]+', ' ', 'g')), ' ')) AS token FROM documents),
hashed AS (SELECT token, {FNV} AS h FROM (SELECT DISTINCT token FROM words WHERE token <> '')),
sums AS (SELECT doc_id, (h % 384)::INT AS place, sum(CASE WHEN (h // 384) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM words JOIN hashed USING (token) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM sums GROUP BY doc_id)
SELECT doc_id, place, round((v::DOUBLE / norm)::FLOAT::DOUBLE, 5) AS value FROM sums JOIN norms USING (doc_id) WHERE v <> 0
UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM norms WHERE norm > 0)"""
)
def stub_embed(spark, d):
    """The places of each text's vector that aren't zero. White space but blanks is left out, so that SQL splits texts alike."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[\s\x1c-\x1f\x85\p{Z}]+", " ").alias("text"))
    rows = retrieval.stub_embed(docs).select("doc_id", F.posexplode("embedding").alias("place", "v"))
    return rows.where("v <> 0").select("doc_id", "place", F.round(F.col("v").cast("double"), 5).alias("value"))


@register("SELECT concat('docs/', doc_id) AS concept_id, lang AS concept_type, source AS title, [lang, source] AS tags, sha256(concat('---\ntype: ', lang, '\ntitle: ', source, '\ntags: [', lang, ', ', source, ']\n---\n', text)) AS file_hash FROM documents")
def parse_concept(spark, d):
    """Each document as a markdown file with front matter, parsed."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    content = F.concat(F.lit("---\ntype: "), "lang", F.lit("\ntitle: "), "source", F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n"), "text")
    files = docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), content.alias("content"))
    return bundle.parse_files(files).select("concept_id", "concept_type", "title", "tags", "file_hash")


@register("SELECT concat('stix/attack-pattern/', p_partkey) AS concept_id, 'attack-pattern' AS type_hint, concat('T', p_partkey) AS attack_id FROM part UNION ALL SELECT concat('stix/url/', page_id), 'observable', NULL FROM pages")
def stix_to_records(spark, d):
    """Parts as attack patterns and page URLs as observables of a STIX bundle, read into concepts."""
    from tessera.sources import stix

    parts = spark.read.parquet(f"{d}/part.parquet")
    reference = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), "p_partkey").alias("external_id")))
    patterns = parts.select(F.to_json(F.struct(F.lit("attack-pattern").alias("type"), F.concat(F.lit("attack-pattern--"), "p_partkey").alias("id"), F.col("p_name").alias("name"), reference.alias("external_references"))).alias("object"))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    urls = pages.select(F.to_json(F.struct(F.lit("url").alias("type"), F.concat(F.lit("url--"), "page_id").alias("id"), F.col("url").alias("value"))).alias("object"))
    return stix.concepts(patterns.union(urls)).select("concept_id", "type_hint", "attack_id")


#: Empty steps and "." are passed over, and a link with an end slash names the directory.
@register(
    """WITH paths AS (SELECT concat('p/', page_id) AS concept_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages),
split AS (SELECT concept_id, string_split(p, '/') AS steps FROM paths), tails AS (SELECT concept_id, CASE WHEN len(steps) < 2 THEN [] ELSE steps[-2:] END AS two FROM split)
SELECT concept_id, regexp_replace(array_to_string(list_filter(two, lambda s: s NOT IN ('', '.')), '/'), CASE WHEN two[-1] = '' THEN '^$' ELSE '\\.md$' END, '') AS tail FROM tails"""
)
def resolve_paths(spark, d):
    """Links from inside each page's path to the path's own last two steps (none, if it has fewer), resolved."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    steps = F.split("p", "/")
    rows = pages.select(F.concat(F.lit("p/"), "page_id").alias("concept_id"), path.alias("p"))
    tail = F.when(F.size(steps) >= 2, F.array_join(F.slice(steps, -2, 2), "/")).otherwise("")
    return rows.select("concept_id", markdown.resolve_path(F.concat(F.lit("../"), tail, F.lit("?x=1#y")), F.lit("dir/concept")).alias("tail"))
