"""Exact top-k search by BM25 over sharded inverted indexes with block-max WAND pruning (operator 4).

A shard is some ``SHARD_BYTES`` of texts: sorted term hashes, each with postings (document, term frequency). Its documents
are put in order of their commonest term and their length, so that the 64 documents of a block resemble each other. A
task that loads a shard derives impacts (BM25 without idf, by the global mean length) and, for each term, the largest
impact in every block and in the shard. Document counts, lengths and document frequencies are global, so scores don't
depend on shards.

A query with a floor (its k-th best score so far) is searched in a shard like this. The largest impacts of its terms in a
block, times idf, add up to the query's bound there; blocks whose bound is under the floor are skipped. (That is the
pivot's rule, too: terms before the pivot add up to less than the floor, so a block that has no other is under it.) The
bounds and the scores of what is left are worked out for ``QUERIES`` queries at a time, put together by their commonest
term: ``TILE`` blocks of documents against all queries that have a bound to reach. A term that many of both have takes a
row of two matrices, which are multiplied; any other's postings are added once for each query that has it. Both are in
single precision, and the floor is lowered by what that may cost; the few documents left are scored again in double
precision. Of documents with equal postings and lengths, a shard scores the first k by id.

Shards are searched in rounds of 1, 1, 2, 4, 8, ... of them (on average). After a round the k best of each query are
merged, and the k-th of them is the floor of the next round in every shard. A query gets about k rows from a round,
however many shards it has, so candidate rows grow as the number of queries, times the logarithm of the number of shards.

Ties go by id, also inside a shard, so that thousands of copies with equal scores give k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SLICE_BYTES, U64, Words, fresh, mix, ship, slices, stored, utf8
from tessera.llm.decontamination import MEMBER

K1, B = 1.2, 0.75
SHARD_BYTES = 16 << 20
BLOCK = 64
QUERY_TERMS = 2_000_000  # of a block of queries; one longer query makes a block of its own
QUERY_BLOCKS = 8  # searched at the same time; the driver holds no more of the queries
TILE = 8  # blocks of documents scored together
QUERIES = 2048  # scored together
DENSE = 600  # a posting added for a query costs as much as so many products in a matrix
ROWS, PAIRS = 1024, 500_000  # terms of a matrix, and postings times queries added at once
TINY = 1e-30
SLACK = 1e-8  # scores are rounded to 9 digits; bounds allow for that and for the order of sums


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: ids, lengths, terms, begin, posting documents and term frequencies."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, ids, hashes, docs_of, lengths = TaskContext.get().partitionId() << 32, 0, [], [], [], []

        def made() -> pa.RecordBatch:
            h, d, n = np.concatenate(hashes), np.concatenate(docs_of), np.concatenate(lengths).astype(np.int64)
            own = pa.concat_arrays(ids)
            for held in (ids, hashes, docs_of, lengths):
                held.clear()
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf, h, d = np.diff(np.append(new, len(h))).astype(np.int32), h[new], d[new]
            by_doc = np.lexsort((h, tf, d))
            last = np.searchsorted(d[by_doc], np.arange(len(n)), "right") - 1
            common = np.where(n > 0, h[by_doc][last], 0) if len(h) else np.zeros(len(n), U64)
            alike = np.lexsort((n, common))  # the commonest term, then the length
            place = np.empty(len(n), np.int32)
            place[alike] = np.arange(len(alike))
            d = place[d]
            order = np.lexsort((d, h))
            tf, h, d = tf[order], h[order], d[order]
            term = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            blobs = [n[alike], h[term], np.append(term, len(h)).astype(np.int64), d, tf]
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.take(pa.array(alike)))
            return pa.record_batch([listed, *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([shard], pa.int64())], schema.names)

        for batch in batches:  # a shard may take texts from several batches
            for part in slices(batch, 1, min(SLICE_BYTES, SHARD_BYTES)):  # scanned in small parts
                raw, at = utf8(part.column(1))
                if lengths and size + len(raw) > SHARD_BYTES:
                    yield made()
                    shard, size = shard + 1, 0
                words = Words(raw, at, MEMBER)
                hashes.append(words.hashes)
                docs_of.append((words.doc + sum(map(len, lengths))).astype(np.int32))
                lengths.append(words.counts())
                ids.append(part.column(0))
                size += len(raw)
        if lengths:
            yield made()

    schema = T.StructType([T.StructField("ids", T.ArrayType(picked.schema["id"].dataType))] + [T.StructField(c, T.BinaryType()) for c in ("lengths", "terms", "begin", "docs", "tf")] + [T.StructField("shard", T.LongType())])
    return stored(picked.mapInArrow(fresh(shards), schema), "bm25")


def frequencies(index: DataFrame) -> tuple[DataFrame, int, float]:
    """((term, df), number of documents, mean length) over all shards."""

    def per_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, begin in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.diff(np.frombuffer(begin.as_buffer(), np.int64)))], ["term", "df"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)]
            yield pa.record_batch([pa.array([len(x) for x in held], pa.int64()), pa.array([int(x.sum()) for x in held], pa.int64())], ["n", "total"])

    df = index.select("terms", "begin").mapInArrow(fresh(per_shard), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    n, total = index.select("lengths").mapInArrow(fresh(sizes), "n bigint, total bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return df, n, total / max(n, 1)


class Postings:
    """Runs of postings of one term each: numbers of the terms, where the runs begin (one more: the end), documents and impacts."""

    def __init__(self, number: np.ndarray, docs: np.ndarray, impact: np.ndarray):
        by_term = np.argsort(number, kind="stable")
        number, self.docs, self.impact = number[by_term], docs[by_term], impact[by_term]
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        self.number, self.begin = number[first], np.append(first, len(number))


class Shard:
    """A shard's postings by document, by tile, and the largest impact of each term in each block."""

    def __init__(self, row: list, rank: np.ndarray, mean: float, k: int):
        lengths, self.terms, begin, docs, tf = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, U64, np.int64, np.int32, np.int32)))
        n, norm = len(lengths), K1 * (1 - B + B * lengths / max(mean, 1e-9))
        order = np.argsort(docs.astype(np.uint16) if n < 1 << 16 else docs, kind="stable")
        of, tf = docs[order], tf[order]
        self.rank, self.number = rank, np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(begin))[order]
        self.impact = tf * (K1 + 1) / (tf + norm[of])
        self.begin = np.searchsorted(of, np.arange(n + 1))
        self.blocks = (n + BLOCK - 1) // BLOCK
        # copies: of documents with equal postings and length, only the first k by id can be among k best
        sums = np.append(U64(0), np.cumsum(mix(self.terms[self.number] * U64(0xD1342543DE82EF95) + tf.astype(U64))))
        same = sums[self.begin[1:]] - sums[self.begin[:-1]] ^ mix(lengths.astype(U64))
        alike = np.lexsort((rank, same))
        first = np.flatnonzero(np.append(True, same[alike][1:] != same[alike][:-1])) if n else np.zeros(0, np.int64)
        kept = np.zeros(n, bool)
        kept[alike] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) < k
        self.tiles, maxima = [], []
        for low in range(0, n, BLOCK * TILE):
            here = slice(self.begin[low], self.begin[min(n, low + BLOCK * TILE)])
            wanted = kept[of[here]]
            tile = Postings(self.number[here][wanted], of[here][wanted] - low, self.impact[here][wanted].astype(np.float32))
            self.tiles.append(tile)
            if len(tile.docs):
                block, start = tile.docs // BLOCK, np.zeros(len(tile.docs), bool)
                start[tile.begin[:-1]] = True
                start[1:] |= block[1:] != block[:-1]
                start = np.flatnonzero(start)
                number = np.repeat(tile.number, np.diff(tile.begin))[start]
                maxima.append((number, block[start] + low // BLOCK, np.maximum.reduceat(tile.impact, start)))
        none = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        self.maxima = Postings(*(np.concatenate(x) for x in zip(none, *maxima)))

    def search(self, batch: Batch, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query of the batch, document, rounded score) of the k best here of each query; what is under its floor may be left out."""
        at = np.minimum(np.searchsorted(batch.terms, self.terms), len(batch.terms) - 1)
        known = batch.terms[at] == self.terms
        at[~known] = -1
        n, part = len(floors), 1 - (np.diff(batch.offsets) + 16) * 2.0**-22  # of a sum, whatever single precision takes from it
        least = np.maximum(floors * part - SLACK, TINY).astype(np.float32)
        bounds, found = batch.sums(at, self.maxima, self.blocks), []
        for t, tile in enumerate(self.tiles):
            asked = np.flatnonzero((bounds[:, t * TILE : (t + 1) * TILE] >= (least * part)[:, None]).any(axis=1))
            if not len(asked):
                continue
            width = min(len(self.rank) - t * TILE * BLOCK, TILE * BLOCK)
            sums = batch.sums(at, tile, width, asked if len(asked) < n else None)
            cells = np.flatnonzero(sums >= least[asked, None])
            if len(cells) > k * len(asked) and width > k:  # their k-th best here is a floor, too
                least[asked] = np.maximum(least[asked], np.partition(sums, width - k, axis=1)[:, width - k] * part[asked])
                cells = np.flatnonzero(sums >= least[asked, None])
            found.append((asked[cells // width], cells % width + t * TILE * BLOCK, sums.ravel()[cells]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, docs, sums = _first(*(np.concatenate(x) for x in zip(*found)), k, part)
        return self.exact(batch, at, query, docs, k)

    def exact(self, batch: Batch, at: np.ndarray, query: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best by score in double precision, the terms of a query always added in the same order; in order of queries."""
        order, scores, impact = np.argsort(docs, kind="stable"), np.zeros(len(docs)), np.zeros(len(batch.terms))
        sizes, cuts = np.diff(batch.offsets), np.append(np.flatnonzero(np.append(True, np.diff(docs[order]))), len(docs)) if len(docs) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            d = docs[order[lo]]
            here = slice(self.begin[d], self.begin[d + 1])
            code = at[self.number[here]]
            known = np.flatnonzero(code >= 0)
            code = code[known]
            impact[code] = batch.idf[code] * self.impact[here][known]
            for some in (order[low : min(hi, low + 256)] for low in range(lo, hi, 256)):
                q = query[some]
                codes = batch.codes[ranges(batch.offsets[q], sizes[q])]
                scores[some] = np.bincount(np.repeat(np.arange(len(q)), sizes[q]), impact[codes], len(q))
            impact[code] = 0
        shared, scores = scores > 0, np.round(scores, 9)
        order = np.lexsort((self.rank[docs], -scores, query))
        first = np.append(0, np.cumsum(np.bincount(query, minlength=len(sizes))))
        order = order[(np.arange(len(order)) - first[query[order]] < k) & shared[order]]
        return query[order], docs[order], scores[order]


def _first(query: np.ndarray, docs: np.ndarray, sums: np.ndarray, k: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of queries, what may be among the k best of each by sums of single precision."""
    order = np.lexsort((-sums, query))
    query, docs, sums = query[order], docs[order], sums[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(query)))
    least = np.where(size > k, sums[np.minimum(first + k - 1, len(sums) - 1)] * part[query[first]], 0)
    may = sums >= np.repeat(least, size)
    return query[may], docs[may], sums[may]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + size[0] - 1, begin[1], ..."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class Batch:
    """Queries searched together: their terms' numbers (codes, by query), and which queries have each term."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, sizes: np.ndarray):
        order = np.argsort(terms, kind="stable")
        first = np.append(True, terms[order][1:] != terms[order][:-1])
        self.offsets = np.cumsum(np.append(0, sizes))
        self.codes = np.empty(len(terms), np.int32)
        self.codes[order] = np.cumsum(first) - 1
        self.terms, self.idf = terms[order][first], idf[order][first]
        self.begin = np.append(np.flatnonzero(first), len(terms))
        self.query = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]

    def sums(self, at: np.ndarray, held: Postings, width: int, asked: np.ndarray | None = None) -> np.ndarray:
        """For each query (of asked) and document, the impacts of the query's terms times idf, added in single precision.

        ``at`` has a code for each of the shard's terms, or -1. Terms that many of both have go through a product of matrices;
        the postings of all others are added for each query that has the term.
        """
        n, query, begins = len(self.offsets) - 1, self.query, self.begin
        if asked is not None:
            place = np.full(n, -1, np.int32)
            place[asked] = np.arange(len(asked))
            n, query = len(asked), place[query]
            begins = np.append(0, np.cumsum(query >= 0))[begins]
            query = query[query >= 0]
        at = at[held.number]
        run = np.flatnonzero(at >= 0)
        at = at[run]
        begin, size = held.begin[run], held.begin[run + 1] - held.begin[run]
        first, askers = begins[at], begins[at + 1] - begins[at]
        common = size * askers * DENSE > n * width
        out, of = np.zeros((n, width), np.float32), np.flatnonzero(common)
        for part in (of[low : low + ROWS] for low in range(0, len(of), ROWS)):
            left, right, row = np.zeros((len(part), n), np.float32), np.zeros((len(part), width), np.float32), np.arange(len(part))
            left[np.repeat(row, askers[part]), query[ranges(first[part], askers[part])]] = 1
            p = ranges(begin[part], size[part])
            right[np.repeat(row, size[part]), held.docs[p]] = held.impact[p] * np.repeat(self.idf[at[part]], size[part])
            out += left.T @ right
        of = np.flatnonzero(~common & (askers > 0))
        p, times, start = ranges(begin[of], size[of]), np.repeat(askers[of], size[of]), np.repeat(first[of], size[of])
        docs, weight = held.docs[p], (held.impact[p] * np.repeat(self.idf[at[of]], size[of])).astype(np.float32)
        row, sums, most = query.astype(np.int64) * width, out.reshape(-1), np.cumsum(times)
        cuts = np.searchsorted(most, np.arange(PAIRS, most[-1] + PAIRS, PAIRS), "right") if len(p) else []
        for lo, hi in zip(np.append(0, cuts[:-1]).astype(int), cuts):
            t = times[lo:hi]
            np.add.at(sums, row[ranges(start[lo:hi], t)] + np.repeat(docs[lo:hi], t), np.repeat(weight[lo:hi], t))
        return out


def query_terms(queries: DataFrame, df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(query, terms, idf) for each query: its distinct terms that the corpus holds, in order of their hashes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                words = Words(*utf8(piece.column(1)), MEMBER)
                pairs = np.unique(np.stack([words.doc.astype(U64), words.hashes]), axis=1) if len(words.doc) else np.zeros((2, 0), U64)
                yield pa.record_batch([piece.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], ["query", "term"])

    picked = queries.select(F.col(id_col).alias("query"), F.col(text_col).alias("text")).where("query is not null")
    rows = picked.mapInArrow(fresh(explode), f"query {picked.schema['query'].dataType.simpleString()}, term bigint").distinct()
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    listed = rows.join(df, "term").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t"))
    return listed.select("query", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, doc_id, score, place) for the k best documents of each query, whole texts on both sides.

    A query's document is found too if it is indexed. Queries of null or without known words have no rows; rows that
    repeat a query id are one query of all their words; documents that repeat an id are searched each. An empty index or
    an empty table of queries gives no rows. Scores are rounded to 9 digits, and ties go by id, null last. Other columns
    are ignored, also where they have names used here. A long text makes a shard, and a long query a block, of its own.
    """
    spark = ship(index.sparkSession)
    df, n, mean = frequencies(index)
    listed = query_terms(queries, df, n, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    listed = stored(listed, "queries")
    rounds = max(1, math.ceil(math.log2(max(index.count(), 1))) + 1)
    drawn = F.shiftrightunsigned(F.xxhash64("shard"), 11) / F.lit(float(1 << 53))  # from 0 to 1; half of the shards are in the last round
    dealt = index.withColumn("round", F.greatest(F.lit(0), F.lit(rounds) + F.floor(F.log2(drawn))).cast("int"))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    parts = []
    for group in batched(_blocks(listed), QUERY_BLOCKS):
        best, floors = None, [np.zeros(len(numbers)) for numbers, _ in group]
        for turn in range(rounds):
            own, held = dealt.where(F.col("round") == turn), []
            for (numbers, batches), floor in zip(group, floors):
                held.append(spark.sparkContext.broadcast((numbers, batches, floor)))  # at most QUERY_TERMS terms, or one query
            found = reduce(DataFrame.unionAll, [own.mapInArrow(fresh(_searcher(h, mean, k)), schema) for h in held])
            best = stored(_best(found if best is None else best.unionAll(found), k).drop("place"), "best")
            for h in held:
                h.destroy()
            if turn < rounds - 1:
                full = best.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
                now = full.select("number", "floor").toArrow()  # at most one row for each query of the group
                known, order = now["number"].to_numpy(), np.argsort(now["number"].to_numpy())
                for (numbers, _), floor in zip(group, floors):
                    if len(known):
                        at = order[np.minimum(np.searchsorted(known, numbers, sorter=order), len(known) - 1)]
                        floor[:] = np.where(known[at] == numbers, now["floor"].to_numpy()[at], 0.0)
        parts.append(best)
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    best = reduce(DataFrame.unionAll, parts).join(listed.select("number", "query"), "number")
    return _best(best, k).select("query", "doc_id", "score", "place")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _searcher(held, mean: float, k: int):
    """For each shard, at most k rows (number, doc_id, score) of each query of a block."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, batches, floors = held.value
        floors = floors.copy()
        for rows_of in rows:
            for r in range(rows_of.num_rows):
                ids = rows_of.column(0).slice(r, 1).flatten()
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                shard, begin = Shard([rows_of.column(c)[r].as_py() for c in range(1, 6)], rank, mean, k), 0
                for batch in batches:
                    of = slice(begin, begin := begin + len(batch.offsets) - 1)
                    query, docs, scores = shard.search(batch, floors[of], k)
                    count = np.bincount(query, minlength=of.stop - of.start)
                    full = np.flatnonzero(count == k)
                    floors[of][full] = np.maximum(floors[of][full], scores[np.cumsum(count)[full] - 1])
                    yield pa.record_batch([pa.array(numbers[of][query]), ids.take(pa.array(docs)), pa.array(scores)], ["number", "doc_id", "score"])

    return run


def _blocks(listed: DataFrame) -> Iterator[tuple[np.ndarray, list[Batch]]]:
    """Numbers of a block's queries, and batches of these in the same order; queries with the same commonest term stand together."""
    names, terms, idf, size = [], [], [], 0

    def made() -> tuple[np.ndarray, list[Batch]]:
        common = [t[x.argmin()] for t, x in zip(terms, idf)]
        order = np.lexsort((list(map(len, terms)), common))
        parts = [order[low : low + QUERIES] for low in range(0, len(order), QUERIES)]
        batches = [Batch(*(np.concatenate([x[q] for q in part]) for x in (terms, idf)), np.array([len(terms[q]) for q in part])) for part in parts]
        return np.array(names, np.int64)[order], batches

    for row in listed.toLocalIterator():
        if names and size + len(row["terms"]) > QUERY_TERMS:
            yield made()
            names, terms, idf, size = [], [], [], 0
        order = np.argsort(np.array(row["terms"], np.int64).view(U64))
        names.append(row["number"])
        terms.append(np.array(row["terms"], np.int64).view(U64)[order])
        idf.append(np.array(row["idf"], float)[order])
        size += len(row["terms"])
    if names:
        yield made()
