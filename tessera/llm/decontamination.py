"""Benchmark decontamination over a distributed positional inverted index (operator 6).

``build_index`` stores the postings of every token of the corpus, sharded by document: a row holds some 2 MB of texts as
sorted term hashes, where each term's postings begin, and the word positions, ascending. Positions count over the texts
of the shard end to end. ``search`` looks up the test terms in each shard, and for each window of an item begins with
the postings of the window's rarest term there, shifted by its offset; the other terms' lists, rarest first, keep only
starts that they hold at their own offset in the same document (``slop`` 0: exact phrase; more: each term within so many
words of its place, for one start of the window).
Shards are independent: nothing is shuffled, no term's list is gathered, and a lost executor repeats single shards.

Terms are 64-bit hashes of words; two words of a corpus share one with a probability under 2**-24 for 10**6 terms looked
up in 10**6 others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, Words, by_slice, byte_class, fresh, ship, stored, utf8

#: A-Z are folded first; the word characters are 0-9, a-z and all beyond ASCII.
MEMBER = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
SHARD_BYTES = 1 << 20
BLOCK_WORDS = 2_000_000  # items are searched in blocks of at most so many words (one longer item: alone)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per shard, with the ids of its documents in order."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def shard(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*utf8(piece.column(1)), MEMBER)
        order = np.argsort(words.hashes, kind="stable").astype(np.int32)
        sorted_terms = words.hashes[order]
        begin = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]]) if len(order) else np.zeros(0, np.int64)
        blobs = [words.first.astype(np.int64), sorted_terms[begin], np.r_[begin, len(order)].astype(np.int64), order]
        ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
        name = pa.array([uuid.uuid4().hex])
        return pa.record_batch([ids, *(pa.array([b.tobytes()], pa.binary()) for b in blobs), name], ["ids", "first", "terms", "begin", "positions", "shard"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(picked.schema["id"].dataType))] + [T.StructField(c, T.BinaryType()) for c in ("first", "terms", "begin", "positions")] + [T.StructField("shard", T.StringType())])
    return stored(picked.mapInArrow(by_slice(shard, most=SHARD_BYTES), schema), "postings")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Blocks of (item id as string, term hashes) for items that have words."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = Words(*utf8(pa.array([row[1]], pa.string())), MEMBER)
        if len(words.hashes):
            if size and size + len(words.hashes) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row[0] if row[0] is not None else "null", words.hashes))
            size += len(words.hashes)
    yield block


class Shard:
    def __init__(self, first: bytes, terms: bytes, begin: bytes, positions: bytes):
        self.first, self.terms = np.frombuffer(first, np.int64), np.frombuffer(terms, U64)
        self.begin, self.positions = np.frombuffer(begin, np.int64), np.frombuffer(positions, np.int32)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each term here (-1: absent) and how many postings it has."""
        if not len(self.terms):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at = np.where(self.terms[at] == hashes, at, -1)
        return at, np.where(at >= 0, self.begin[at + 1] - self.begin[at], 0)

    def postings(self, number: int) -> np.ndarray:
        return self.positions[self.begin[number] : self.begin[number + 1]]

    def phrase(self, numbers: np.ndarray, frequency: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts s in one text each, and the numbers of the texts, such that each term k is there from s + k - slop to s + k + slop."""
        order = np.argsort(frequency, kind="stable")
        held = self.postings(numbers[order[0]]).astype(np.int64)
        doc = np.searchsorted(self.first, held, "right") - 1
        start = held - order[0]
        if slop:
            shifts = np.arange(-slop, slop + 1)
            start, doc = (start[:, None] + shifts).ravel(), np.repeat(doc, len(shifts))
        for k in order[1:]:
            if not len(start):
                break
            held, low, high = self.postings(numbers[k]), self.first[doc], self.first[doc + 1]
            at = np.searchsorted(held, np.maximum(start + k - slop, low))
            found = at < len(held)
            found[found] = held[at[found]] < np.minimum(start + k + slop + 1, high)[found]
            start, doc = start[found], doc[found]
        return start, doc


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per indexed document: id, n_words, n_hit (words inside an occurrence of a window), items (ids as strings,
    sorted) with exact occurrences, near_items (those with a window such that, for one start, the document has each term
    within ``slop`` words of its place).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
    empty texts have no words, null items match nothing; an item id that is repeated counts once; repeated documents
    have a row each, ids may be null. An empty index gives no rows; an empty benchmark gives every document, without hits.
    Other columns are ignored, whatever their names. A text longer than a shard makes a shard of its own. Items are held in
    blocks of bounded size; each block is a pass over the index.
    """
    parts = [_search_block(index, block, window, slop) for block in item_blocks(items, item_id, item_text)]
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # several blocks: unite by place in the index
        merged = out.groupBy("shard", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"))
        out = merged.withColumn("hit", F.array_distinct("hit"))
    return out.select("id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near_items")).alias("near_items"))


def _search_block(index: DataFrame, block: list[tuple[str, np.ndarray]], window: int, slop: int) -> DataFrame:
    ship(index.sparkSession)
    names = [name for name, _ in block]
    lengths = [len(h) for _, h in block]
    terms, inverse = np.unique(np.concatenate([h for _, h in block]) if block else np.zeros(0, U64), return_inverse=True)
    held = index.sparkSession.sparkContext.broadcast((names, np.cumsum([0, *lengths]), terms, inverse))  # at most BLOCK_WORDS words

    def run(batches):
        from numpy.lib.stride_tricks import sliding_window_view

        names, offsets, terms, inverse = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                shard = Shard(*(batch.column(c)[r].as_py() for c in range(1, 5)))
                number, frequency = shard.lookup(terms)
                hit = np.zeros(int(shard.first[-1]), bool)
                exact: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                for item in range(len(names)):
                    at = inverse[offsets[item] : offsets[item + 1]]
                    size = min(window, len(at))
                    for w in np.flatnonzero(sliding_window_view(frequency[at], size).min(axis=1)):
                        term = at[w : w + size]
                        start, doc = shard.phrase(number[term], frequency[term], 0)
                        for k in range(size):
                            hit[start + k] = True
                        for d in np.unique(doc).tolist():
                            exact.setdefault(d, set()).add(item)
                        if slop:
                            for d in np.unique(shard.phrase(number[term], frequency[term], slop)[1]).tolist():
                                near.setdefault(d, set()).add(item)
                where = np.flatnonzero(hit)
                cut = np.searchsorted(where, shard.first)
                rows = range(len(ids))
                hits = [(where[cut[d] : cut[d + 1]] - shard.first[d]).tolist() for d in rows]
                listed = [[sorted({names[i] for i in part.get(d, ())}) for d in rows] for part in (exact, near)]
                yield pa.record_batch(
                    [ids, pa.array(np.diff(shard.first)), pa.array(hits, pa.list_(pa.int32())), pa.array(listed[0], pa.list_(pa.string())), pa.array(listed[1], pa.list_(pa.string())), pa.array([batch.column(5)[r].as_py()] * len(ids), pa.string()), pa.array(rows, pa.int32())],
                    ["id", "n_words", "hit", "items", "near_items", "shard", "place"],
                )

    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType())), T.StructField("shard", T.StringType()), T.StructField("place", T.IntegerType())])
    return index.mapInArrow(fresh(run), schema)
