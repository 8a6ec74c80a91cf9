"""Sharding by vector bin packing (operator 10).

Rows of equal text form a group. What is packed are groups of bounded number and size: a group that holds at least 1/LOTS
of all bytes, tokens or rows (there are at most 3 * LOTS of these) is packed by itself; the others, each under 1/256 of a
shard, are gathered by hash in LOTS lots, whole. Largest first, each goes to the shard where the dot product of its vector
(bytes, tokens, rows) with the residual capacity is highest, among those with room for it. A group that no shard has
room for is cut by a hash of the row ids in pieces of 1/LOTS, which go on one by one; the driver sees at most some 10 *
LOTS vectors of pieces, whatever the corpus. A lot or a piece that finds no room goes where the product is highest.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

LOTS_PER_SHARD = 256


def pack(vectors: np.ndarray, shards: int, groups: np.ndarray | None = None) -> np.ndarray:
    """The shard of each vector; those of one group have the same, if a shard has room for all when its turn comes."""
    total = np.maximum(vectors.sum(axis=0), 1)
    v = vectors / total * shards  # a shard's capacity is 1 in each dimension
    residual, out = np.ones((shards, v.shape[1])), np.zeros(len(v), np.int64)
    _, group = np.unique(np.arange(len(v)) if groups is None else groups, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1]) if len(v) else []
    whole = np.array([v[m].sum(axis=0) for m in members]).reshape(-1, v.shape[1])
    waiting = [(-whole[g].max(), g, m) for g, m in enumerate(members)]
    heapq.heapify(waiting)
    while waiting:
        _, g, m = heapq.heappop(waiting)
        x = v[m].sum(axis=0)
        score, fits = residual @ x, (residual >= x - 1e-12).all(axis=1)
        if not fits.any() and len(m) > 1:
            for k in m:
                heapq.heappush(waiting, (-v[k].max(), len(members) + int(k), np.array([k])))
            continue
        to = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
        out[m] = to
        residual[to] -= x
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lots_per_shard: int = LOTS_PER_SHARD) -> DataFrame:
    """One row per row of docs: the id, size (UTF-8 bytes plus 8), text_crc32, shard, slot (0, 1, ... in each shard).

    Sizes of shards are near equal (a unit apart at most), and so are their tokens and rows. Null text counts as empty.
    Rows that repeat both id and text keep together; ids may be null; ties go by id, then by hash; an empty table gives
    no rows. Only narrow rows are shuffled, never texts.
    """
    lots = shards * lots_per_shard
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = base.groupBy("key").agg(*sums)
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(1))).first()
    share = F.greatest(F.col("size") / F.lit(total[0]), F.col("tokens") / F.lit(max(total[1], 1)), F.col("n") / F.lit(total[2])) * lots
    heavy = groups.withColumn("pieces", F.ceil(share).cast("int")).where(share >= 1).select("key", "pieces").orderBy("key").collect()  # at most 3 * lots
    first = lots + np.cumsum([0, *(h["pieces"] for h in heavy)])
    spark = docs.sparkSession
    listed = spark.createDataFrame([(h["key"], h["pieces"], int(f)) for h, f in zip(heavy, first)], "key long, pieces int, first long")
    unit = F.when(F.col("pieces").isNull(), F.pmod(F.hash(F.col("key"), F.lit(7)), F.lit(lots)).cast("long")).otherwise(F.col("first") + F.pmod(F.xxhash64("id", F.lit(11)), F.col("pieces")))
    base = base.join(F.broadcast(listed), "key", "left").withColumn("unit", unit).drop("pieces", "first", "key")
    units = base.groupBy("unit").agg(*sums).orderBy("unit").collect()
    numbers = np.array([u["unit"] for u in units], np.int64)
    groups = np.where(numbers < lots, numbers, lots + np.searchsorted(first, numbers, "right"))
    where = pack(np.array([(u["size"], u["tokens"], u["n"]) for u in units], float).reshape(-1, 3), shards, groups)
    filled, rows = [0] * shards, []
    for u, s in zip(units, where.tolist()):
        rows.append((u["unit"], s, filled[s]))
        filled[s] += u["n"]
    placed = spark.createDataFrame(rows, "unit long, shard int, from_slot long")
    within = Window.partitionBy("unit").orderBy("id", "text_crc32", "size")
    ranked = base.withColumn("rank", F.row_number().over(within))
    out = ranked.join(F.broadcast(placed), "unit")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("from_slot") + F.col("rank") - 1).alias("slot"))
