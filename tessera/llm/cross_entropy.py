"""Language-model scoring by cross-entropy difference (operator 5).

Target and background model share one vocabulary: all distinct tokens of the corpus. The background is counted over every
document, the target over the trusted labelled ones. Both models interpolate in the same way: a share of the bigram's
relative frequency with a smoothed unigram. A document's score is the mean over its tokens of (target loss - background
loss); lower means nearer to the target.

The tables of words and of exact pairs (word before, word) grow with the corpus and are never held in one place. Texts
are cut into stored blocks of some ``BLOCK_BYTES``, as word hashes and a number for each token. Each block hands on the
counts of its own keys, sorted, to shards of the key space (some ``SHARD_TOKENS`` each); a shard adds them up over all
blocks and answers each with what the others have, in the block's order. Then a block is scored with the counts of its own
keys. Keys are 64-bit hashes of words and of pairs of them; arrays are moved compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, fresh, mix, pack, ship, slices, stored, unpack
from tessera.llm.lm_tokens import Tokens

BLOCK_BYTES, SHARD_TOKENS = 8 << 20, 2_000_000
MOST_BROADCAST_ROWS = 500_000
SHARE, PSEUDO = 0.5, 0.5
BLOBS = ["counts", "target", "words", "codes"]


def build_blocks(flagged: DataFrame) -> DataFrame:
    """Stored blocks of rows (id, text, target): ids, tokens of each, whether of the target, word hashes, and each token's number among them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def block() -> pa.RecordBatch:
            ids, counts, target, hashes = zip(*held)
            ids, of_target, counts = pa.concat_arrays(ids), np.concatenate(target), np.concatenate(counts).astype(np.int64)
            words, codes, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            rank = np.argsort(-n, kind="stable")  # frequent words have small numbers
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = [pa.array([pack(x)], pa.binary()) for x in (counts, of_target, words[rank], place[codes])]
            totals = [pa.array([int(n)], pa.int64()) for n in (counts.sum(), counts[of_target].sum(), (counts > 0).sum(), (counts[of_target] > 0).sum())]
            return pa.record_batch([pa.array([first + made], pa.int64()), listed, *blobs, *totals], names)

        for batch in batches:
            for piece in slices(batch, 1):
                if size and size + piece.column(1).nbytes > BLOCK_BYTES:
                    yield block()
                    made, size, held = made + 1, 0, []
                tokens = Tokens(piece.column(1))
                held.append((piece.column(0), np.bincount(tokens.doc, minlength=piece.num_rows), np.asarray(piece.column(2).to_numpy(zero_copy_only=False), bool), tokens.hashes))
                size += piece.column(1).nbytes
        if held:
            yield block()

    names = ["block", "ids", *BLOBS, "n_tokens", "n_target", "n_texts", "n_target_texts"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(flagged.schema["id"].dataType))] + [T.StructField(c, T.BinaryType()) for c in BLOBS] + [T.StructField(c, T.LongType()) for c in names[-4:]])
    return stored(flagged.select("id", "text", "target").mapInArrow(fresh(encode), schema), "blocks")


class Block:
    """A block's distinct words and pairs by ascending key, with its own counts, and the places of each token's word, word before and pair.

    ``sums`` has the rows background, target, ends of texts in either (words), and background, target (pairs)."""

    def __init__(self, *blobs: bytes):
        counts, of_target, words, codes = map(unpack, blobs)
        self.counts, order = counts[0].astype(np.int64), np.argsort(words[0])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.word, m = words[0][order], place[codes[0].astype(np.int64)], len(order)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        chosen = of_target[0].astype(bool)[self.doc]
        begins = np.ones(len(self.doc), bool)
        begins[1:] = self.doc[1:] != self.doc[:-1]
        ends = np.append(begins[1:], True)[: len(begins)]
        self.before = np.full(len(self.word), m)  # m stands before a text
        self.before[1:] = np.where(begins[1:], m, self.word[:-1])
        keys = mix(mix(np.append(self.words, U64(0))[self.before]) * U64(0xD1342543DE82EF95) + self.words[self.word])
        self.pairs, self.pair = np.unique(keys, return_inverse=True)
        self.word_sums = [np.bincount(self.word[x], minlength=m) for x in (slice(None), chosen, ends, ends & chosen)]
        self.pair_sums = [np.bincount(self.pair[x], minlength=len(self.pairs)) for x in (slice(None), chosen)]

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each shard of the key space begins among the words and the pairs (one more: the end)."""
        bounds = np.array([(k << 64) // shards for k in range(shards)], U64)
        return tuple(np.append(np.searchsorted(x, bounds), len(x)) for x in (self.words, self.pairs))

    def losses(self, model: int, n: float, texts: float, symbols: int) -> np.ndarray:
        """-log P of each token after the one before it."""
        words = self.word_sums[model].astype(float)
        before = np.append(words - self.word_sums[2 + model], texts)[self.before]
        one = (words[self.word] + PSEUDO) / (n + PSEUDO * symbols)
        two = self.pair_sums[model][self.pair] / np.maximum(before, 1)
        return -np.log(np.where(before > 0, SHARE * two + (1 - SHARE) * one, one))


def tally(shards: int):
    """The counts of each block's keys, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(*(batch.column(c)[r].as_py() for c in range(1, 5)))
                w, p = block.cuts(shards)
                filled = np.flatnonzero(np.diff(w) + np.diff(p))  # a block of a large corpus has nothing for most shards
                for own in np.array_split(filled, -(-len(filled) // 256)) if len(filled) else ():
                    blobs = [
                        pack(*(np.diff(x[c[k] : c[k + 1]], prepend=U64(0)) for x, c in ((block.words, w), (block.pairs, p))), *(x[w[k] : w[k + 1]] for x in block.word_sums), *(x[p[k] : p[k + 1]] for x in block.pair_sums)) for k in own
                    ]
                    yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array([batch.column(0)[r].as_py()] * len(own), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "block", "held"])

    return run


def add_up(table: pa.Table) -> pa.Table:
    """For each block of a shard, the counts that all others have of its keys."""
    held = [unpack(blob.as_py()) for blob in table.column("held")]
    rest: list[list[np.ndarray]] = [[] for _ in held]
    for kind, columns in ((1, (6, 7)), (0, (2, 3, 4, 5))):
        distinct, at = np.unique(np.concatenate([np.cumsum(h[kind], dtype=U64) for h in held]), return_inverse=True)
        cut = np.cumsum([len(h[kind]) for h in held])[:-1]
        for c in columns:
            own = np.concatenate([h[c] for h in held]).astype(np.int64)
            whole = np.bincount(at, own, len(distinct)).astype(np.int64)
            for r, x in zip(rest, np.split(whole[at] - own, cut)):
                r.append(x)
    blobs = [pack(*r) for r in rest]
    return pa.table([table.column("shard"), table.column("block"), pa.array(blobs, pa.binary())], ["shard", "block", "rest"])


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each block's words."""
    for batch in batches:
        for blob in batch.column(0):
            yield pa.record_batch([pa.array(unpack(blob.as_py())[0].view(np.int64))], ["h"])


def score(docs: DataFrame, labels: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens, target_loss and background_loss (means per token), difference, selected (difference < 0).

    The target is all trusted documents, or the ``sample`` of them with the smallest hashes of their ids. Texts without
    tokens (null, empty, blank) have null losses and aren't selected. Ids may be null or repeated; an empty table gives no
    rows; without any trusted document the target is the smoothed uniform model.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = labels.where(F.col(id_col).isNotNull() & F.expr("quality = 1 and coalesce(toxic, 0) = 0")).select(F.col(id_col).alias("id")).distinct()
    if sample is not None:
        trusted = trusted.orderBy(F.xxhash64("id"), "id").limit(sample)
    target_ids = stored(trusted, "target").withColumn("target", F.lit(True))
    flagged = picked.join(F.broadcast(target_ids) if target_ids.count() <= MOST_BROADCAST_ROWS else target_ids, "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = build_blocks(flagged)
    totals = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_target", "n_texts", "n_target_texts"))).first()
    shards = max(1, -(-totals[0] // SHARD_TOKENS))
    counted = blocks.select("block", *BLOBS).mapInArrow(fresh(tally(shards)), "shard int, block bigint, held binary")
    sums = counted.groupBy("shard").applyInArrow(add_up, "shard int, block bigint, rest binary")
    symbols = blocks.select("words").mapInArrow(fresh(vocabulary), "h bigint").distinct().count()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, *blobs = (left.column(c)[0] for c in ("ids", *BLOBS))
        block = Block(*(b.as_py() for b in blobs))
        right = right.sort_by("shard")
        rest = [np.concatenate(x).astype(np.int64) for x in zip(*(unpack(blob.as_py()) for blob in right.column("rest")))] or [np.zeros(0, np.int64)] * 6
        block.pair_sums = [a + b for a, b in zip(block.pair_sums, rest[:2])]
        block.word_sums = [a + b for a, b in zip(block.word_sums, rest[2:])]
        tokens = block.counts
        means = [np.bincount(block.doc, block.losses(model, totals[model], totals[2 + model], symbols), len(tokens)) / np.maximum(tokens, 1) for model in (1, 0)]
        return pa.table([ids.values, pa.array(tokens), *(pa.array(m, mask=tokens == 0) for m in means)], ["id", "n_tokens", "target_loss", "background_loss"])

    schema = f"id {picked.schema['id'].dataType.simpleString()}, n_tokens bigint, target_loss double, background_loss double"
    out = blocks.select("block", "ids", *BLOBS).groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(run, schema)
    difference = F.col("target_loss") - F.col("background_loss")
    return out.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", difference.alias("difference"), F.coalesce(difference < 0, F.lit(False)).alias("selected"))
