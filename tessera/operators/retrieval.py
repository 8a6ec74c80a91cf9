"""Recall: exact similarity search behind the gate, ranking by activation and decay, and the retrieval ledger."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.beliefs import Time, believed_at
from tessera.session import ship
from tessera.store import Pointers

MAX_CHUNKS, OVER_FETCH = 8, 4
EMBED_ROWS = 1000
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similar_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "belief_id") -> DataFrame:
    """The k vectors most similar to query by cosine; ties go by id. Exact: partial top-k in each task, merged."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.size("embedding") == len(query)).withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k).select(id_col, "similarity")


def similar_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "belief_id", query_col: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, similarity, place): similar_topk for a stated set of queries (query, embedding), by products of matrices.

    Queries come in blocks of bounded size, each broadcast for one pass; a batch of vectors hands on k rows for each query.
    """
    ship(vectors.sparkSession)
    schema = T.StructType([queries.schema[query_col], vectors.schema[id_col], T.StructField("similarity", T.DoubleType())])
    parts, rows = [], queries.select(query_col, "embedding").where("embedding is not null").toLocalIterator()
    for own in batched(rows, block):
        wide = np.array([r["embedding"] for r in own], np.float64)
        held = vectors.sparkSession.sparkContext.broadcast((pa.array([r[query_col] for r in own]), wide / np.sqrt((wide * wide).sum(axis=1))[:, None]))

        def run(batches, held=held):
            names, q = held.value
            for batch in batches:
                fits = pc.equal(pc.list_value_length(batch.column(1)), q.shape[1]).fill_null(False)
                batch = batch.filter(fits)
                if not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                s = np.round((v / np.sqrt((v * v).sum(axis=1))[:, None]) @ q.T, 6)
                rank = pc.sort_indices(batch.column(0)).to_numpy()
                best = rank[np.argsort(-s[rank], axis=0, kind="stable")[:k]]  # ties by id
                number = np.broadcast_to(np.arange(s.shape[1]), best.shape).ravel()
                yield pa.record_batch([names.take(pa.array(number)), batch.column(0).take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, axis=0).ravel())], schema.names)

        parts.append(vectors.select(id_col, "embedding").mapInArrow(run, schema))
    if not parts:
        return vectors.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("place", T.IntegerType())]))
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("similarity"), id_col))
    return reduce(DataFrame.unionAll, parts).withColumn("place", place).where(F.col("place") <= k)


def recall_as_of(beliefs: DataFrame, t: Time, max_chunks: int = MAX_CHUNKS, gated: DataFrame | None = None) -> DataFrame:
    """Beliefs valid at t with their titles; the query's words don't matter, and no gate unless ``gated`` is given."""
    rows = believed_at(beliefs, t)
    if gated is not None:
        rows = rows.join(gated.select("belief_id"), "belief_id", "left_semi")
    return rows.orderBy("belief_id").limit(max_chunks).select("belief_id", F.col("title").alias("text"), F.lit(0.0).alias("score"))


def recall_fallback(selected: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Without an index: what the gate lets through, best rank first."""
    return selected.orderBy(F.desc("rank"), "belief_id").limit(max_chunks).select("belief_id", F.lit("").alias("text"), F.lit(0.0).alias("score"), "rank")


def recall_candidates(vectors: DataFrame, selected: DataFrame, query: list[float], max_chunks: int = MAX_CHUNKS, gate_after: bool = False) -> DataFrame:
    """The 4 * max_chunks most similar vectors with rank, all of which the retrieval ledger records. The gate is applied
    before the search, so that it takes no candidate's place; ``gate_after`` searches first."""
    k, ranks = OVER_FETCH * max(1, max_chunks), selected.select("belief_id", "rank")
    if gate_after:
        return similar_topk(vectors, query, k).join(ranks, "belief_id")
    return similar_topk(vectors.join(ranks, "belief_id", "left_semi"), query, k).join(ranks, "belief_id")


def recall_indexed(vectors: DataFrame, selected: DataFrame, query: list[float], max_chunks: int = MAX_CHUNKS, gate_after: bool = False) -> DataFrame:
    """The candidates with the highest rank; similarity decides only who is one."""
    found = recall_candidates(vectors, selected, query, max_chunks, gate_after)
    return found.orderBy(F.desc("rank"), "belief_id").limit(max_chunks)


def correlate_evidence(surfaced: DataFrame, evidence: DataFrame) -> DataFrame:
    """(retrieval, belief_id): retrievals of a run that surfaced some of the evidence a belief of the same run gives. surfaced: run_id, retrieval, concept_id; evidence: run_id, belief_id, concept_id."""
    return surfaced.join(evidence, ["run_id", "concept_id"]).select("retrieval", "belief_id").distinct()


def mark_used(surfaced: DataFrame, evidence: DataFrame) -> DataFrame:
    used = evidence.select("run_id", "concept_id").distinct().withColumn("hit", F.lit(True))
    return surfaced.join(used, ["run_id", "concept_id"], "left").withColumn("was_used", F.coalesce("hit", F.lit(False))).drop("hit")


def embeddables(beliefs: DataFrame, ownership: DataFrame, episodes: DataFrame, episode_owners: DataFrame) -> DataFrame:
    """What an index rebuild embeds: asserted beliefs with a start, an owner and a visibility, and live episodes; a row for each owner."""
    own = ownership.where("visibility is not null").select(F.col("owned").alias("id"), "owner", "visibility")
    b = beliefs.where("belief_state = 'asserted' and valid_from is not null").select(F.col("belief_id").alias("id"), F.col("title").alias("text"), F.lit("belief").alias("kind"), F.col("valid_from").alias("at"))
    e = episodes.where("type <> 'retrieval-event' and (consolidation_state is null or consolidation_state <> 'tombstoned')")
    e = e.select(F.col("episode_id").alias("id"), F.col("title").alias("text"), F.lit("episode").alias("kind"), F.col("event_time").cast("timestamp_ntz").alias("at"))
    eo = episode_owners.select(F.col("episode_id").alias("id"), "owner", F.lit(None).cast("string").alias("visibility"))
    return b.join(own, "id").unionByName(e.join(eo, "id"))


def prefilter(index: DataFrame, owner: str | None) -> DataFrame:
    """Index rows that aren't private to somebody else."""
    return index if owner is None else index.where((F.coalesce(F.col("visibility"), F.lit("")) != "private") | (F.col("owner") == owner))


def upsert(index: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """index with rows in place of those of the same id; vectors of another dimension are an error."""
    if rows.where(F.size("embedding") != dim).take(1):
        raise ValueError(f"a vector hasn't {dim} dimensions")
    return index.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def persist_index(index: DataFrame, path: str, model_id: str, dim: int) -> str:
    """Write an index as a new folder under path, sorted by id in its files, and point to it with the model and dimension; return the folder.
    Readers see the old snapshot or the new one."""
    pointers, folder = Pointers(index.sparkSession, f"{path.rstrip('/')}/versions"), f"data/{uuid.uuid4().hex}"
    index.sortWithinPartitions("id").write.parquet(f"{path.rstrip('/')}/{folder}")
    pointers.publish(pointers.latest() + 1, {"model_id": model_id, "dim": dim, "at": folder})
    return f"{path.rstrip('/')}/{folder}"


def open_index(spark: SparkSession, path: str, model_id: str, dim: int) -> DataFrame | None:
    """The latest snapshot under path; None, so that it is rebuilt, if there is none or another model or dimension made it."""
    pointers = Pointers(spark, f"{path.rstrip('/')}/versions")
    held = pointers.read(pointers.latest())
    if (held.get("model_id"), held.get("dim")) != (model_id, dim):
        return None
    return spark.read.parquet(f"{path.rstrip('/')}/{held['at']}")


def drain_dirty(index: DataFrame, dirty: DataFrame, embeddable: DataFrame) -> DataFrame:
    """index with the dirty ids embedded again where they still may be (beliefs and episodes), and dropped where not. embeddable has id and the index's columns."""
    again = embeddable.join(dirty.select("id").distinct(), "id", "left_semi")
    return remove(index, dirty).unionByName(again.select(index.columns))


#: White space by Unicode's property, without U+001C to U+001F.
BLANK = re.compile(r"[^\S\x1c-\x1f]+")


def fnv1a(tokens: list[bytes]) -> np.ndarray:
    """The 64-bit FNV-1a hash of each token, all tokens a byte at a time."""
    sizes = np.array([len(t) for t in tokens])
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64)
    begin, h = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.full(len(tokens), 0xCBF29CE484222325, np.uint64)
    own = np.arange(len(tokens))
    for k in range(int(sizes.max(initial=0))):
        own = own[sizes[own] > k]
        h[own] = (h[own] ^ data[begin[own] + k]) * np.uint64(0x100000001B3)
    return h


def stub_vectors(texts: list[str], dim: int = 384) -> np.ndarray:
    """Signed hashing of lower-case tokens to unit length, a row for each text; nothing gives the first unit vector."""
    words = [[t for t in BLANK.split(x.lower()) if t] for x in texts]
    number = {t: k for k, t in enumerate({t for w in words for t in w})}
    h = fnv1a([t.encode() for t in number])
    place, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h // np.uint64(dim) % np.uint64(2) == 0, 1.0, -1.0)
    token, row = np.array([number[t] for w in words for t in w], np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])
    v = np.bincount(row * dim + place[token], sign[token], len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((v * v).sum(axis=1))
    v[norm == 0, 0] = 1.0
    return (v / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)


def stub_vector(text: str, dim: int = 384) -> list[float]:
    return stub_vectors([text], dim)[0].tolist()


def stub_embed(df: DataFrame, text_col: str = "text", dim: int = 384) -> DataFrame:
    """df with ``embedding``: the stub vector of a text (null: empty). A batch's distinct tokens are hashed once."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        parts = [stub_vectors([t or "" for t in texts.iloc[k : k + EMBED_ROWS]], dim) for k in range(0, len(texts), EMBED_ROWS)]
        return pd.Series([v for p in parts for v in p], index=texts.index)

    return df.withColumn("embedding", embed(F.col(text_col)))
