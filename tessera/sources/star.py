"""Projections of the star-schema tables onto the belief graph.

``VIEWS`` are portable SQL: {name} stands for a source table, {ntz} for the engine's naive timestamp type and {sha} for
its SHA-256 function. ``view`` gives the DataFrame; ``ctes`` the same text for another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "belief": """
SELECT concat('mem/bel/', o_orderkey) AS belief_id, o_orderkey AS k, concat('claim ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 11 = 0 THEN 'superseded' WHEN o_orderkey % 13 = 0 THEN 'contested' WHEN o_orderkey % 17 = 0 THEN 'retracted' ELSE 'asserted' END AS belief_state,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS confidence,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'axiom' WHEN '2-HIGH' THEN 'user-stated' WHEN '3-MEDIUM' THEN 'tool-derived' WHEN '4-NOT SPECIFIED' THEN 'inferred' ELSE 'llm' END AS entrenchment,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS valid_from,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 365 DAY END AS valid_to,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS salience,
  CAST(1.0 AS DOUBLE) AS base_activation, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS last_access
FROM {orders}""",
    "ownership": """
SELECT concat('mem/bel/', o_orderkey) AS owned, concat('agent-', o_custkey % 50) AS owner,
  CASE o_custkey % 4 WHEN 0 THEN 'team' WHEN 1 THEN 'shared' WHEN 2 THEN 'private' ELSE NULL END AS visibility FROM {orders}
UNION ALL SELECT concat('mem/bel/', o_orderkey), concat('agent-', (o_custkey + 1) % 50), NULL FROM {orders} WHERE o_orderkey % 10 = 0""",
    "supersession": """
SELECT concat('mem/bel/', o_orderkey) AS superseded, concat('mem/bel/', o_orderkey + 1) AS superseding, o_orderdate AS created_at
FROM {orders} WHERE o_orderkey % 22 = 0 AND o_orderkey + 1 <= (SELECT max(o_orderkey) FROM {orders})""",
    "derivation": """
SELECT concat('d', o_orderkey) AS rel_id, concat('mem/bel/', o_orderkey) AS derived, concat('mem/bel/', CAST(FLOOR(o_orderkey / 2) AS BIGINT)) AS source,
  CASE o_orderkey % 7 WHEN 0 THEN 'type-join' WHEN 1 THEN 'cardinality' WHEN 2 THEN 'functional-dependency' WHEN 3 THEN 'type-db-function'
       WHEN 4 THEN 'external-tool' WHEN 5 THEN 'human-assertion' ELSE 'llm-synthesis' END AS derivation_method FROM {orders} WHERE o_orderkey >= 2
UNION ALL SELECT concat('e', o_orderkey), concat('mem/bel/', o_orderkey), concat('mem/bel/', CAST(FLOOR(o_orderkey / 3) AS BIGINT)), 'llm-synthesis'
FROM {orders} WHERE o_orderkey >= 3 AND o_orderkey % 6 = 0""",
    "rests_on": """
SELECT concat('mem/bel/', o_orderkey) AS resting, concat('mem/bel/', CAST(FLOOR(o_orderkey / 3) AS BIGINT)) AS assumption FROM {orders} WHERE o_orderkey >= 3 AND o_orderkey % 5 = 0
UNION ALL SELECT 'mem/bel/3', 'mem/bel/100'""",
    "contradiction_claim": """
SELECT concat('x', CAST(FLOOR(o_orderkey / 3) AS BIGINT)) AS rel_id, concat('mem/bel/', o_orderkey) AS claim FROM {orders} WHERE o_orderkey % 30 < 3""",
    "episode": """
SELECT concat('mem/ep/', event_id) AS episode_id, 'episode' AS type, event_type AS title, CAST(ts AS DATE) AS event_time, ts AS ingest_time, concat('user-', user_id) AS owner,
  CASE WHEN event_id % 97 = 0 THEN 'tombstoned' END AS consolidation_state FROM {events}""",
    "population_member": """
SELECT concat('pop/', c_nationkey) AS spec_hash, concat('cust/', c_custkey) AS member, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE min(o_orderdate) END AS valid_from,
  CASE WHEN c_custkey % 3 = 0 THEN max(o_orderdate) END AS valid_to, max(o_orderdate) AS computed_at
FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey""",
    "scoped": """
SELECT concat('mem/bel/', o_orderkey) AS scoped_belief, concat('pop/', c_nationkey) AS spec_hash FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderkey % 20 = 0""",
    "resolves": """
SELECT concat('mem/bel/res', c_custkey) AS resolution, concat('cust/', c_custkey) AS record_a, concat('cust/', c_custkey + 1) AS record_b,
  CASE WHEN c_custkey % 9 = 0 THEN 'superseded' ELSE 'asserted' END AS belief_state, CAST('1996-01-01 00:00:00' AS {ntz}) AS valid_from,
  CASE WHEN c_custkey % 9 = 0 THEN CAST('1998-01-01 00:00:00' AS {ntz}) END AS valid_to
FROM {customer} WHERE c_custkey % 5 <> 0 AND c_custkey + 1 <= (SELECT max(c_custkey) FROM {customer})""",
    "resolution_derivation": """
SELECT concat('r', c_custkey) AS rel_id, concat('mem/bel/res', c_custkey) AS derived, concat('mem/ep/', c_custkey) AS source,
  CASE c_custkey % 7 WHEN 0 THEN 'type-join' WHEN 1 THEN 'cardinality' WHEN 2 THEN 'functional-dependency' WHEN 3 THEN 'external-tool' WHEN 4 THEN 'type-join' WHEN 5 THEN 'human-assertion' ELSE 'llm-synthesis' END AS derivation_method FROM {customer}
UNION ALL SELECT concat('s', c_custkey), concat('mem/bel/res', c_custkey), 'mem/ep/1', 'llm-synthesis' FROM {customer} WHERE c_custkey % 2 = 0""",
    "informs_synthesis": """
SELECT concat('mem/ep/re', CASE WHEN vec_id % 11 = 0 THEN vec_id + 1000 ELSE vec_id % 40 END) AS retrieval, concat('mem/bel/', vec_id) AS synthesized FROM {embeddings}""",
    "technique_detection": """
SELECT concat('logic/', l_suppkey, '-', l_partkey % 20) AS detecting_logic, concat('T', l_partkey) AS detected_technique, concat('mem/bel/', l_orderkey) AS detection_claim FROM {lineitem} WHERE l_linenumber = 1 AND l_partkey % 3 <> 0""",
    "requires_evidence": """
SELECT concat('T', p_partkey) AS technique, concat('dc/', p_brand) AS required FROM {part}""",
    "sensor_coverage": """
SELECT DISTINCT concat('sensor/', p_size % 5) AS covering_sensor, concat('dc/', p_brand) AS covered_component FROM {part} WHERE p_brand < 'Brand#4'""",
    "alert_disposition": """
SELECT concat('logic/', l_suppkey, '-', l_partkey % 20) AS dispositioned_logic, concat('mem/bel/', l_orderkey) AS disposition_belief, l_linenumber AS n,
  CASE l_returnflag WHEN 'A' THEN 'true-positive' WHEN 'R' THEN 'false-positive' ELSE 'benign-true' END AS detection_verdict FROM {lineitem} WHERE l_linenumber = 2""",
    "manifest": """
SELECT concat('doc/', doc_id) AS concept_id, {sha} AS file_hash FROM {documents} WHERE doc_id % 9 <> 0""",
    "stored": """
SELECT concat('doc/', doc_id) AS concept_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 41 = 0 THEN NULL ELSE {sha} END AS file_hash,
  CASE WHEN doc_id % 5 = 0 THEN 'beta' ELSE 'alpha' END AS bundle_name FROM {documents} WHERE doc_id % 8 <> 1""",
    "vector": """
SELECT concat('mem/bel/', vec_id) AS belief_id, embedding FROM {embeddings}""",
}
ENGINE = {"ntz", "sha"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame over the Parquet tables in sf_dir."""
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {*re.findall(r"\{(\w+)\}", text)} - ENGINE}
    return spark.sql(text.replace("{ntz}", "TIMESTAMP_NTZ").replace("{sha}", "sha2(text, 256)"), **tables)


def ctes(*names: str) -> str:
    """The projections as common table expressions in DuckDB's dialect."""
    made = []
    for n in names:
        text = VIEWS[n].replace("{ntz}", "TIMESTAMP").replace("{sha}", "sha256(text)")
        made.append(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', text)})")
    return ", ".join(made)
