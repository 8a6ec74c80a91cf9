"""Fixpoints: reachability and connected components.

A graph of checked size is broadcast, and each seed is followed to its end in one task. For larger ones a round costs one
join of the frontier with the edges and one anti-join with what was found so far, both read from files in the shared
folder, so that lineage stays short and a lost executor costs nothing that was finished.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import MOST_BROADCAST_ROWS, scratch, ship, stored

MOST_LOCAL_EDGES, MOST_LOCAL_BYTES = 1_000_000, 64 << 20
OUT_ROWS = 50_000
MOST_SEEN = 16 << 20  # pairs of a seed and a node that a task keeps track of at a time


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): all nodes that a path of at least one edge (src, dst) leads to from each seed. Cycles end: a pair is followed once."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seeds = seeds.select("seed").where("seed is not null").distinct()
    edges = stored(edges, "edges")
    bytes_ = F.sum(F.octet_length(F.col("src").cast("string")) + F.octet_length(F.col("dst").cast("string")))
    n, size = edges.agg(F.count("*"), F.coalesce(bytes_, F.lit(0))).first()
    return _reach_in_tasks(edges, seeds) if n <= MOST_LOCAL_EDGES and size <= MOST_LOCAL_BYTES else _reach_in_rounds(edges, seeds)


class Graph:
    """Edges by number of the node they leave, and the nodes' names."""

    def __init__(self, edges: pa.Table):
        both = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks], edges["src"].type).combine_chunks().dictionary_encode()
        numbers = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        src, dst = np.split(numbers, [edges.num_rows])
        order = np.argsort(src, kind="stable")
        self.names, self.dst = both.dictionary, dst[order].astype(np.int32)
        self.begin = np.searchsorted(src[order], np.arange(len(self.names) + 1))

    def after(self, starts: np.ndarray) -> np.ndarray:
        """start * (number of nodes) + node, for the nodes that paths from each start (by its place in starts) lead to, ascending."""
        n = len(self.names)
        seen, frontier = np.zeros(len(starts) * n, bool), np.arange(len(starts)) * n + starts
        while len(frontier):
            node = frontier % n
            begin, size = self.begin[node], self.begin[node + 1] - self.begin[node]
            at = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            found = np.repeat(frontier - node, size) + self.dst[at]
            found = found[~seen[found]]
            frontier = np.unique(found) if len(found) < len(seen) >> 6 else np.flatnonzero(np.bincount(found, minlength=len(seen)))
            seen[frontier] = True
        return np.flatnonzero(seen)


def _reach_in_tasks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    spark = ship(edges.sparkSession)
    graph = spark.sparkContext.broadcast(Graph(edges.toArrow()))  # at most MOST_LOCAL_EDGES
    kind = edges.schema["src"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = graph.value.names
        together = max(1, MOST_SEEN // max(len(names), 1))
        for batch in batches:
            own = batch.column(0)
            numbers = pc.index_in(own, value_set=names)
            known = pc.indices_nonzero(numbers.is_valid())
            own, numbers = own.take(known), numbers.take(known).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(own), together):
                pairs = graph.value.after(numbers[a : a + together])
                for k in range(0, len(pairs), OUT_ROWS):
                    seed, node = np.divmod(pairs[k : k + OUT_ROWS], len(names))
                    yield pa.record_batch([own.take(pa.array(a + seed)), names.take(pa.array(node))], ["seed", "node"])

    schema = T.StructType([T.StructField("seed", kind), T.StructField("node", kind)])
    return seeds.select(F.col("seed").cast(kind).alias("seed")).mapInArrow(run, schema)


def _reach_in_rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    few, parts = frontier.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS, []
    while True:
        near = frontier.withColumnRenamed("node", "src")
        found = edges.join(F.broadcast(near) if few else near, "src").select("seed", F.col("dst").alias("node")).distinct()
        if parts:
            found = found.join(_all(parts), ["seed", "node"], "left_anti")
        frontier = stored(found, "frontier")
        size = frontier.count()  # from the files' footers
        if not size:
            return _all(parts) if parts else frontier
        few = size <= MOST_BROADCAST_ROWS
        parts.append(frontier)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of undirected links (a, b); root is the smallest node reached. Minimum labels with pointer jumping."""
    with scratch(links.sparkSession) as keep:
        edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct(), "links")
        labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        labels = stored(labels, "labels")
        while True:
            near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
            hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
            jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            new = stored(hooked.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), "labels")
            labels = new.select("node", "root")
            if not new.where("root <> old").take(1):
                keep(new)
                return labels
