"""Jaccard similarity join of n-gram sets in their metric space (operator 9).

The Jaccard distance is a metric. Regions around pivot documents divide those that share something with a pivot, but all
documents that share nothing are at distance 1 from each other and from any pivot, so that Voronoi regions of the whole
corpus would leave most of it in one. The first division is therefore by content: two sets within the limit share a
shingle among the first |x| - ceil(0.85 |x|) + 1 of each, in any order of shingles that all documents share, so a document
belongs to the regions of those first shingles only. The order is rarest first, by a mergeable frequent-items summary over
all documents, so that frequent lines and passages come last. Of each such region the document with the smallest hash gives
the name, and regions of one name unite.

Inside, regions join recursively (``voronoi``). Some members are drawn as pivots, and all members are compared with them.
Members within the limit r link to a pivot. A member's home is the region of its nearest pivot, if that is nearer than
1 - r, else the far region. A member is also replicated to the region of any other pivot that is at most 2r further away
than its nearest one, and to the far region from 1 - 2r on: by the triangle inequality a partner's home is among these.
Regions whose members are all connected already are done: a group of copies of any size ends here. A region of more than
``LEAF`` members is divided by Spark in this way, and one that pivots don't shrink is cut into blocks, where each pair of
blocks is a region (of those members only that profiles, see below, allow a link with one that isn't connected yet).
Regions of at most LEAF members are divided further in one task that holds their sets, down to cells of ``CELL`` members.
In a cell, members serve as pivots in turn, and a pair is compared only where their distances to all earlier pivots differ
by r at most and no links connect them yet.

Before whole sets are moved there, members are held against each other by their profiles: the distances to SLICES
pivots, which are fixed slices of all shingles, in the metric of symmetric differences (the numbers of a set's shingles
in each slice). By the triangle inequality their differences, added up, bound the symmetric difference of two sets from
below; a member that this keeps from linking with any other of its region leaves it. Only links of a spanning forest
leave a region. Nothing is capped, and no two documents that a path of links connects
are parted.

Documents with equal sets are one node throughout. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, byte_class, fresh, grams, mix, scratch, ship, slices, stored, utf8
from tessera.operators.closure import components

#: Words are what stands between blanks, tabs and line ends; A-Z are folded.
MEMBER = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
FREQUENT, BUFFER = 200_000, 600_000
MOST_FREQUENT = 500_000
LEAF, CELL, WINDOWS, SEEN = 1024, 16, 8, 200_000
HOT, SALTS = 50_000, 64
SLICES, FINE, LONG = 128, 1024, 1500  # sets of more than LONG shingles have profiles of FINE slices
MOST_BROADCAST_ROWS = 500_000


def sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(*utf8(column), MEMBER)
    out = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        h = words.hashes[begin:end]
        out.append(np.unique(grams(h, min(n, len(h)))) if len(h) else h)
    return out


def node(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(s):
        return 0
    h = np.array([s.sum(), mix(s).sum(), len(s)], U64)
    return int(mix(grams(h, 3)).view(np.int64)[0])


def profile(s: np.ndarray) -> bytes:
    """The number of shingles in each slice, 255 at most (a difference of such numbers is still no larger than the true one)."""
    slices_ = FINE if len(s) > LONG else SLICES
    return np.minimum(np.bincount((s >> U64(40)).astype(np.int64) % slices_, minlength=slices_), 255).astype(np.uint8).tobytes()


def near_by_profile(profiles: list[bytes], sizes: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """Whether each member may link with another one of another root."""
    out, fine = np.zeros(len(sizes), bool), np.array([len(p) == FINE for p in profiles])
    held = [np.frombuffer(p, np.uint8) for p in profiles]
    coarse = np.stack([np.minimum(h.reshape(-1, SLICES).sum(axis=0, dtype=np.int32), 255) if len(h) == FINE else h.astype(np.int32) for h in held])
    at = np.cumsum(fine) - 1
    exact = np.stack([h for h in held if len(h) == FINE]).astype(np.int16) if fine.any() else None
    for x in range(len(sizes) - 1):
        y = x + 1 + np.flatnonzero(roots[x + 1 :] != roots[x])
        y = y[100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x])]
        for profile_of, usable in ((coarse, slice(None)), (exact, fine)):
            if not len(y) or (usable is fine and not fine[x]):
                continue
            pick = y if usable is not fine else y[fine[y]]
            rest = y[:0] if usable is not fine else y[~fine[y]]
            k, own = (pick, x) if usable is not fine else (at[pick], at[x])
            apart, together = np.abs(profile_of[k] - profile_of[own]).sum(axis=1, dtype=np.int64), sizes[pick] + sizes[x]
            y = np.concatenate([rest, pick[100 * (together - apart) >= percent * (together + apart)]])
        if len(y):
            out[x] = True
            out[y] = True
    return out


class Frequent:
    """A Misra-Gries summary: any item of more than 1/FREQUENT of those added is held, with a count that is that much too small at most."""

    def __init__(self):
        self.items, self.counts, self.new, self.size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, parts: list[np.ndarray]) -> None:
        self.new += parts
        self.size += sum(map(len, parts))
        if self.size > BUFFER:
            self.merge()

    def merge(self) -> None:
        u, n = np.unique(np.concatenate(self.new) if self.new else np.zeros(0, U64), return_counts=True)
        items, inverse = np.unique(np.concatenate([self.items, u]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([self.counts, n])).astype(np.int64) if len(items) else np.zeros(0, np.int64)
        if len(items) > FREQUENT:
            counts -= np.partition(counts, len(counts) - FREQUENT - 1)[len(counts) - FREQUENT - 1]
        self.items, self.counts, self.new, self.size = items[counts > 0], counts[counts > 0], [], 0


def frequencies(picked: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most MOST_FREQUENT, from all documents."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Frequent()
        for batch in batches:
            for piece in slices(batch, 1):
                held.add(sets(piece.column(1), n))
        held.merge()
        often = held.counts > 1
        yield pa.record_batch([pa.array(held.items[often].view(np.int64)), pa.array(held.counts[often])], ["token", "c"])

    counted = picked.mapInArrow(fresh(summary), "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).toArrow()
    tokens = rows["token"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(tokens)
    return tokens[order], rows["c"].to_numpy().astype(np.int64)[order]


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first |s| - ceil(percent |s| / 100) + 1 shingles, rarest first, and their known counts."""
    size = len(s) - -(-percent * len(s) // 100) + 1
    if not len(frequent):
        return s[:size], np.zeros(size, np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    c = np.where(frequent[at] == s, counts[at], 0)
    first = np.lexsort((s, c))[:size]
    return s[first], c[first]


def link(docs: DataFrame, percent: int = 85, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles; a text of fewer
    words is one shingle; a null or empty text, or one of blanks, has none and links with nothing. Rows that repeat an id
    have a row each. Null ids never become a component_id; a component of them alone has null. An empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                own = sets(piece.column(1), n)
                yield pa.record_batch([piece.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(map(node, own), pa.int64()), pa.array(map(profile, own), pa.binary())], ["id", "n", "node", "profile"])

    named = stored(picked.mapInArrow(fresh(name), f"id {kind}, n bigint, node bigint, profile binary"), "nodes")
    held = spark.sparkContext.broadcast(frequencies(picked, n))  # at most MOST_FREQUENT

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task; renewed when full
        for batch in batches:
            for piece in slices(batch, 1):
                own = {node(s): s for s in sets(piece.column(1), n) if len(s)}
                own = {name: s for name, s in own.items() if name not in seen}
                seen = seen | own.keys() if len(seen) < SEEN else {*own}
                parts = [prefix(s, *held.value, percent) for s in own.values()]
                tokens, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))
                nodes = np.repeat(np.array([*own], np.int64), [len(t) for t, _ in parts])
                salts = np.where(counts >= HOT, 1 + nodes % SALTS, 0).astype(np.int32)
                yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(salts), pa.array(nodes)], ["token", "salt", "node"])

    found = named.where("n > 0")
    profiles = found.groupBy("node").agg(F.first("profile").alias("profile"), F.first("n").alias("n"))
    with scratch(spark) as keep:
        links = linked_nodes(picked, picked.mapInArrow(fresh(first), "token bigint, salt int, node bigint"), profiles, percent, n)
        if hasattr(links, "stored_in"):
            keep(links)
    classes = found.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    joined = components(links)
    classes = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.where("copies > 1").select("root").union(joined.select("root")).distinct()
    wide = classes.join(least, "root", "left_semi")
    roots = stored(wide.join(wide.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "roots")
    out = named.join(F.broadcast(roots) if roots.count() <= MOST_BROADCAST_ROWS else roots, "node", "left")
    component = F.when((F.col("n") > 0), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def linked_nodes(picked: DataFrame, tokens: DataFrame, profiles: DataFrame, percent: int, n: int, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) between nodes that connect all nodes which a path of pairs within the limit connects.

    tokens: (token, salt, node); rows of frequent tokens are dealt by their salt, too, others have salt 0.
    """
    spark = picked.sparkSession
    rows = tokens.repartition("token", "salt").dropDuplicates(["token", "salt", "node"])  # a node comes once from a task, so copies are few here
    groups = rows.groupBy("token", "salt").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node", F.lit(5)).alias("at"), "node")).alias("least"), F.max("salt").alias("salted"))
    salted = groups.where("salted > 0").groupBy("token").agg(F.sum("m").alias("all_m"), F.min("least").alias("all_least"))  # at most MOST_FREQUENT
    groups = groups.join(F.broadcast(salted), "token", "left").where(F.coalesce("all_m", "m") > 1)
    regions = rows.join(groups.select("token", "salt", F.coalesce("all_least", "least")["node"].alias("region")), ["token", "salt"])
    regions = stored(regions.select("region", "node").distinct(), "regions")
    if not regions.take(1):
        return spark.createDataFrame([], "a bigint, b bigint")
    # root: a name that members share which links connect already
    regions = regions.join(regions.groupBy("region").agg(F.count("*").alias("m")), "region").withColumn("root", F.col("node"))
    regions = stored(_apart(regions.where(F.col("m") <= leaf), profiles, percent).unionByName(regions.where(F.col("m") > leaf)), "regions")
    held = node_sets(picked, regions.select("node").distinct(), n)
    # At first each member joins one region only, so that groups of near copies are linked before they are looked at again.
    own = regions.groupBy("node").agg(F.min_by("region", F.xxhash64("region", F.lit(17))).alias("region"))
    own = stored(own.join(own.groupBy("region").agg(F.count("*").alias("m")), "region").where("m > 1").withColumn("root", F.col("node")), "own")
    near_pivots = _split(own.where(F.col("m") > leaf), held, percent, leaf).where("b is not null").select(F.col("node").alias("a"), "b")
    links = stored(_join_leaves(own.where(F.col("m") <= leaf), held, percent).union(near_pivots).distinct(), "links")
    rooted = lambda df, labels: df.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    regions = stored(rooted(regions, components(links)), "regions")
    unfinished = regions.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("region")
    regions = regions.join(unfinished, "region", "left_semi")
    regions = stored(_apart(regions.where(F.col("m") <= leaf), profiles, percent).unionByName(regions.where(F.col("m") > leaf)), "regions")
    parts = []
    while True:
        parts.append(regions.where(F.col("m") <= leaf))
        large = regions.where(F.col("m") > leaf)
        if not large.take(1):
            break
        split = stored(_split(large, held, percent, leaf), "split")
        links = stored(links.union(split.where("b is not null").select(F.col("node").alias("a"), "b")).distinct(), "links")
        labels = components(links)
        following = stored(rooted(split.where("b is null").select("parent", "region", "node").distinct(), labels), "following")
        still = following.groupBy("parent", "region").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        still = stored(still.select("parent", "region", "m").join(large.groupBy(F.col("region").alias("parent")).agg(F.first("m").alias("before")), "parent"), "still")
        hard = still.groupBy("parent").agg(((F.sum("m") > 1.5 * F.first("before")) | (F.max("m") > 0.8 * F.first("before"))).alias("hard")).where("hard").select("parent")
        blocks = _blocks(rooted(large.join(hard.withColumnRenamed("parent", "region"), "region", "left_semi"), labels), leaf)
        parts.append(stored(_apart(blocks, profiles, percent), "blocks"))
        easy = still.join(hard, "parent", "left_anti").select("region", "m")
        regions = stored(following.drop("parent").distinct().join(easy, "region").select("region", "node", "m", "root"), "regions")
    return stored(links.union(_join_leaves(reduce(DataFrame.unionByName, parts), held, percent)).distinct(), "links")


def _with_sets(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows (node, ...) with their sets. Up to a checked number of rows these are broadcast, so that the sets aren't shuffled for it."""
    rows = stored(rows, "rows")
    return held.join(F.broadcast(rows) if rows.count() <= MOST_BROADCAST_ROWS else rows, "node")


def _join_leaves(regions: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) found inside regions of at most LEAF members."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["region"]):
            names = np.asarray(group.column("node"))
            if len(names) < 2:
                continue
            found = join_region([np.frombuffer(x.as_buffer(), U64) for x in group.column("shingles")], np.asarray(group.column("root")), percent)
            yield pa.record_batch([pa.array(names[[a for a, _ in found]]), pa.array(names[[b for _, b in found]])], ["a", "b"])

    joined = _with_sets(regions, held).repartition("region").sortWithinPartitions("region").select("region", "node", "root", "shingles")
    return joined.mapInArrow(fresh(leaves), "a bigint, b bigint")


def _apart(regions: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The members of small regions that their profiles don't keep from linking with another one."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("region", "node", "m", "root")
        rows = [[] for _ in columns]
        for group in runs(batches, ["region"]):
            near = near_by_profile(group.column("profile").to_pylist(), np.asarray(group.column("n")), np.asarray(group.column("root")), percent)
            for r, column in zip(rows, columns):
                r.append(np.asarray(group.column(column))[near])
            if len(rows[0]) >= 2000:
                yield pa.record_batch([pa.array(np.concatenate(r)) for r in rows], columns)
                rows = [[] for _ in columns]
        if rows[0]:
            yield pa.record_batch([pa.array(np.concatenate(r)) for r in rows], columns)

    joined = regions.join(profiles, "node").repartition("region").sortWithinPartitions("region")
    return joined.select("region", "node", "m", "root", "profile", "n").mapInArrow(fresh(choose), "region bigint, node bigint, m bigint, root bigint")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys; one run is held at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if kept:
            last = kept[-1]
            new[0] = any(last.column(last.schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns))
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (begin, end) in enumerate(zip(cut, cut[1:])):
            if k and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            if end > begin:
                kept.append(batch.slice(begin, end - begin))
    if kept:
        yield pa.Table.from_batches(kept)


def overlaps(s: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many items of the sorted set s each set of a flat list holds; no set is empty."""
    at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
    return np.add.reduceat((s[at] == flat).astype(np.int64), offsets[:-1])


def voronoi(members: list[np.ndarray], own: np.ndarray, pivots: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(membership, within): which of the members own belongs to the region of each pivot (a row each, the far region last), and which are within the limit of it."""
    sizes = np.array([len(members[k]) for k in own])
    flat, offsets = np.concatenate([members[k] for k in own]), np.concatenate([[0], np.cumsum(sizes)])
    shared = np.stack([overlaps(members[p], flat, offsets) for p in pivots])
    united = sizes + np.array([[len(members[p])] for p in pivots]) - shared
    return regions_of(1 - shared / united, 1 - percent / 100), 100 * shared >= percent * united


def spanning(within: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, members) of links that connect what all links (within and other: pivots x members) connect: one for each
    member, and more only where they connect pivots that aren't connected yet."""
    near = within & other
    first = near.argmax(axis=0)
    members = np.flatnonzero(near.any(axis=0))
    pivots, out_p, out_k = np.arange(len(near)), [first[members]], [members]
    for k in np.flatnonzero(within.sum(axis=0) > 1).tolist():
        p = np.flatnonzero(within[:, k])  # a pivot among the members connects itself with the others
        for q in p[1:].tolist():
            if pivots[q] != pivots[p[0]]:
                pivots[pivots == pivots[q]] = pivots[p[0]]
                for z in (p[0], q):
                    if other[z, k] and not (z == first[k] and near[z, k]):
                        out_p.append(np.array([z]))
                        out_k.append(np.array([k]))
    return np.concatenate(out_p), np.concatenate(out_k)


def regions_of(distance: np.ndarray, limit: float) -> np.ndarray:
    """Membership (regions x members) by distances (pivots x members): near regions by windows of 2 x limit, and the far one."""
    nearest = distance.min(axis=0)
    near = (distance <= nearest + 2 * limit + 1e-9) & (distance < 1)
    return np.vstack([near, nearest >= 1 - 2 * limit - 1e-9])


def join_region(members: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links by number that connect what pairs of members within the limit connect; members of equal roots are connected already."""
    _, group = np.unique(roots, return_inverse=True)
    found: list[tuple[int, int]] = []

    def unite(x: int, y: int) -> None:
        if group[x] != group[y]:
            group[group == group[y]] = group[x]
            found.append((x, y))

    waiting, drawn = [np.arange(len(members))], np.random.default_rng(len(members))
    while waiting:
        own = waiting.pop()
        if (group[own] == group[own[0]]).all():
            continue
        if len(own) > CELL:
            pivots = drawn.choice(own, -(-len(own) // CELL) + 1, replace=False)
            inside, within = voronoi(members, own, pivots, percent)
            for p, k in zip(*np.nonzero(within)):
                unite(int(pivots[p]), int(own[k]))
            counts = inside.sum(axis=1)
            if counts.sum() <= 1.5 * len(own) and counts.max() <= 0.8 * len(own):
                waiting += [own[x] for x in inside if x.sum() > 1]
                continue
        join_cell(members, own, group, unite, percent)
    return found


def join_cell(members: list[np.ndarray], own: np.ndarray, group: np.ndarray, unite, percent: int) -> None:
    """Compare the members own with each other, but for pairs that sizes, distances to earlier ones or links rule out."""
    m, sizes = len(own), np.array([len(members[k]) for k in own])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    items, flat = np.unique(np.concatenate([members[k] for k in own]), return_inverse=True)
    mark, seen, limit = np.zeros(len(items), bool), [], 1 - percent / 100 + 1e-9
    for x in range(m - 1):
        y = np.arange(x + 1, m)
        open_pair = (group[own[y]] != group[own[x]]) & (100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x]))
        for d in seen:
            open_pair &= np.abs(d[y] - d[x]) <= limit
        y = y[open_pair]
        if not len(y):
            continue
        mark[flat[offsets[x] : offsets[x + 1]]] = True
        if len(seen) < WINDOWS and len(y) > 16:
            shared = np.add.reduceat(mark[flat].astype(np.int32), offsets[:-1])
            seen.append(1 - shared / (sizes + sizes[x] - shared))
            shared = shared[y]
        else:
            shared = np.array([np.count_nonzero(mark[flat[offsets[k] : offsets[k + 1]]]) for k in y])
        mark[flat[offsets[x] : offsets[x + 1]]] = False
        for k in y[100 * shared >= percent * (sizes[y] + sizes[x] - shared)].tolist():
            unite(int(own[x]), int(own[k]))
        if (group[own] == group[own[0]]).all():
            return


def _split(large: DataFrame, held: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Rows (parent, region, node, b) of large regions: with b, a link to a pivot; without, membership in a region around a pivot."""
    at = F.xxhash64("node", "region")
    lowest = large.groupBy("region").agg(F.min(at).alias("lowest"))
    drawn = F.shiftrightunsigned(at, 11) / F.lit(float(1 << 53)) < (2 * F.ceil(F.col("m") / leaf) + 1) / F.col("m")
    members = large.join(lowest, "region").withColumn("pivot", ((at == F.col("lowest")) | drawn).cast("int")).drop("lowest")
    chunks = F.ceil(F.col("m") / (2 * leaf)).cast("int")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), chunks).cast("int")).withColumn("kind", F.lit(1))
    shown = members.where("pivot = 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("kind", F.lit(0))
    both = _with_sets(dealt.union(shown.select(dealt.columns)), held).repartition("region", "chunk").sortWithinPartitions("region", "chunk", "kind")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["region", "chunk"]):
            names, kind = np.asarray(group.column("node")), np.asarray(group.column("kind"))
            region = group.column("region")[0].as_py()
            whole = [np.frombuffer(x.as_buffer(), U64) for x in group.column("shingles")]
            centres, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            inside, within = voronoi(whole, own, centres, percent)
            c, k = spanning(within, names[own][None, :] != names[centres][:, None])
            j, x = np.nonzero(inside)
            near = mix(names[centres].view(U64))  # the far region has the number 0
            region_of = grams(np.array([region], np.int64).view(U64), 1)[0] + np.append(near, U64(0))
            a = np.concatenate([names[own[k]], names[own[x]]])
            b = pa.array(np.concatenate([names[centres[c]], np.zeros(len(x), np.int64)]), mask=np.concatenate([np.zeros(len(k), bool), np.ones(len(x), bool)]))
            r = np.concatenate([np.full(len(k), region, np.int64), region_of[j].view(np.int64)])
            yield pa.record_batch([pa.array(np.full(len(a), region)), pa.array(r), pa.array(a), b], ["parent", "region", "node", "b"])

    return both.select("region", "node", "chunk", "kind", "shingles").mapInArrow(fresh(deal), "parent bigint, region bigint, node bigint, b bigint")


def _blocks(stuck: DataFrame, leaf: int) -> DataFrame:
    """Regions for each pair of blocks of half a leaf, for regions that pivots don't divide."""
    blocks = F.ceil(2 * F.col("m") / leaf).cast("int")
    numbered = stuck.withColumn("block", F.pmod(F.xxhash64("node", F.lit(13)), blocks).cast("int"))
    paired = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return paired.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "node", "m", "root")


def node_sets(picked: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, shingles) for the nodes: their whole sets as sorted 64-bit integers."""
    few = nodes.count()
    wanted = picked.sparkSession.sparkContext.broadcast(np.sort(nodes.toArrow()["node"].to_numpy().astype(np.int64)) if few <= MOST_BROADCAST_ROWS else None)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                own = {node(s): s for s in sets(piece.column(1), n) if len(s)}
                names = np.array([*own], np.int64)
                keep = np.isin(names, wanted.value) if wanted.value is not None else np.ones(len(names), bool)
                yield pa.record_batch([pa.array(names[keep]), pa.array([s.tobytes() for s, k in zip(own.values(), keep.tolist()) if k], pa.binary())], ["node", "shingles"])

    all_sets = picked.mapInArrow(fresh(whole), "node bigint, shingles binary")
    if few > MOST_BROADCAST_ROWS:
        all_sets = all_sets.join(nodes, "node", "left_semi")
    return stored(all_sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
