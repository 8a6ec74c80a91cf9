"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text (operator 3).

The model is trained on all trusted documents of the half, by a hash of the id, that is for training. Trigrams are dealt
to shards by their middle word, so that a shard has all that a trigram's probability needs: the counts of the trigram, of
its context, of its bigram and of that one's context. Only the discounts and the unigrams are sums over shards.

Texts are cut into blocks of some ``BLOCK_BYTES``. Training blocks hand on their trigram counts, sorted, and a shard adds
them up (``counted``). Then every block sends its trigrams, with the numbers of the rows they are in, to the shards, which
join them with their counts by trigram, context and bigram, and answer with a sum for each row, in steps of ``STEP``
(``score_all``). A task holds the counts of one shard and lets the blocks pass by; the commonest middle word is a task's
bound. ``train`` and ``score`` do the same with tables of the model, for one that is small or is to be looked at.

A document is kept if its perplexity is at most the ``quantile`` of those of the trusted documents in its language; these
are all trusted documents of the other half, that no model is trained on. Perplexities of short texts are
drawn to the language's mean by ``PRIOR`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, by_slice, free_name, fresh, numbered, pack, release, scratch, ship, slices, stored, unpack
from tessera.llm.lm_tokens import SHAPES, Tokens

BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20  # of texts; of training texts whose counts a shard holds, on average
MOST_BROADCAST_ROWS = 2_000_000
STEP = 2.0**-14  # of the sum of the log-probabilities that a row has from a shard
TRAINED = -(1 << 63)  # in place of a block's number, which is that of its first row
LEAST_COUNT, MOST_WORDS = 3, (1 << 17) - SHAPES - 3
SHARD_ROWS = 1_250_000  # of the model, in a pass over the documents
BITS = 17  # of a symbol in a key: 0 begins a text, 1 to SHAPES are shapes, then a word said again, and once more (as what follows only), then the vocabulary
AGAIN, FIRST_WORD = SHAPES + 1, SHAPES + 3
PRIOR = 20
QUANTILE = 0.999


def symbols(tokens: Tokens, vocabulary: np.ndarray) -> np.ndarray:
    """The symbol of each token: its rank in the sorted vocabulary, else its shape."""
    out = tokens.shapes.astype(np.int64) + 1
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, tokens.hashes), len(vocabulary) - 1)
        known = vocabulary[at] == tokens.hashes
        out[known] = at[known] + FIRST_WORD
    return out


def trigrams(tokens: Tokens, vocabulary: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The key of each token with the two before it, with the symbols in rank, if given, in place of those by hash."""
    w = symbols(tokens, vocabulary)
    w = w if rank is None else rank[w]
    v, u = np.zeros_like(w), np.zeros_like(w)
    if len(w) > 1:
        v[1:] = np.where(tokens.doc[1:] == tokens.doc[:-1], w[:-1], 0)
        u[2:] = np.where(tokens.doc[2:] == tokens.doc[:-2], w[:-2], 0)
    return (u << 2 * BITS) | (v << BITS) | np.where(tokens.repeats > 0, AGAIN - 1 + tokens.repeats, w)


def trusted(labels: DataFrame, id_col: str) -> DataFrame:
    """The ids of documents of quality 1 that aren't toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("id")).where("id is not null").distinct()


def held_out():
    """The half of the ids that the model is never trained on."""
    return F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == 1


def trusted_sample(docs: DataFrame, labels: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of the trusted half for training, or of ``sample`` documents of it, smallest hash of the id first."""
    ids = trusted(labels, id_col).where(~held_out())
    if sample is not None:
        ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = stored(ids, "training")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_ROWS else ids, "id")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of keys with count 1 to 4."""
    return _cut_off(counts.agg(*(F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4))).first())


def _cut_off(n) -> tuple[float, float, float]:
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9  # too little text to estimate
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def _smoothed(counts: DataFrame, context, discounts) -> tuple[DataFrame, DataFrame]:
    """(keys with discounted share alpha, contexts with backoff weight gamma) of counts (key, c)."""
    d = F.when(F.col("c") == 1, discounts[0]).when(F.col("c") == 2, discounts[1]).otherwise(discounts[2])
    counts = counts.withColumn("context", context).withColumn("d", d)
    contexts = counts.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("given"))
    contexts = contexts.select("context", "total", (F.col("given") / F.col("total")).alias("gamma"))
    joined = counts.join(contexts, "context").select("key", "context", "gamma", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
    return joined, contexts.select("context", "gamma")


def words_of(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary of training texts, sorted hashes of the commonest words, and symbols in the order of their counts in place of those by hash."""

    def words(piece: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Tokens(piece.column(1))
        h, n = np.unique(tokens.hashes, return_counts=True)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = texts.mapInArrow(by_slice(words), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    top = counted.orderBy(F.desc("n"), "h").limit(MOST_WORDS).select("h").toArrow()  # at most MOST_WORDS
    h = top["h"].to_numpy().astype(np.int64).view(U64)
    by_hash = np.argsort(h)
    return h[by_hash], np.concatenate([np.arange(FIRST_WORD), by_hash + FIRST_WORD])


def unigrams(counts: np.ndarray, d) -> np.ndarray:
    """The probability of each symbol; counts: of the words that it follows."""
    if not counts.any():
        return np.full(len(counts), 1 / len(counts))
    cut = np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])
    return (counts - cut) / counts.sum() + cut.sum() / counts.sum() / len(counts)


def train(texts: DataFrame) -> dict[str, DataFrame | np.ndarray]:
    """The model's shards: DataFrames tri and bi (key, p), ctx3 and ctx2 (context, gamma), and arrays vocabulary and uni."""
    spark = ship(texts.sparkSession)
    texts = stored(texts.select("id", "text"), "trusted")
    vocabulary, _ = words_of(texts)
    held = spark.sparkContext.broadcast(vocabulary)

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        k, n = np.unique(trigrams(Tokens(piece.column(1)), held.value), return_counts=True)
        return pa.record_batch([pa.array(k), pa.array(n)], ["key", "n"])

    tri = stored(texts.mapInArrow(by_slice(count), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("c")), "trigrams")
    low = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    bi = tri.groupBy(low(2 * BITS).alias("key")).agg(F.count("*").alias("c"))
    uni = bi.groupBy(low(BITS).alias("key")).agg(F.count("*").alias("c"))
    symbols_n = len(vocabulary) + FIRST_WORD
    rows = uni.toArrow()  # at most one for each symbol
    c1 = np.zeros(symbols_n)
    c1[rows["key"].to_numpy()] = rows["c"].to_numpy()
    p1 = unigrams(c1, _discounts(uni))
    p1_of = spark.createDataFrame(pa.table({"w": np.arange(symbols_n), "p1": p1}))
    alpha2, ctx2 = _smoothed(bi, F.shiftright("key", BITS), _discounts(bi))
    bi_p = alpha2.join(p1_of, F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)) == F.col("w")).select("key", (F.col("alpha") + F.col("gamma") * F.col("p1")).alias("p"))
    bi_p = stored(bi_p, "bigrams")
    alpha3, ctx3 = _smoothed(tri, F.shiftright("key", BITS), _discounts(tri))
    tri_p = alpha3.join(bi_p.select(F.col("key").alias("vw"), F.col("p").alias("p2")), F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)) == F.col("vw"))
    tri_p = tri_p.select("key", (F.col("alpha") + F.col("gamma") * F.col("p2")).alias("p"))
    return {"vocabulary": vocabulary, "uni": np.log(p1), "tri": stored(tri_p, "tri"), "bi": bi_p, "ctx3": stored(ctx3, "ctx3"), "ctx2": stored(ctx2, "ctx2")}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, lang, n_tokens, log_p (the sum over the text), carried (a number of the row; row_col if given).

    The model's tables are cut into shards by the middle word of a trigram, so that a shard has all that a trigram's
    probability needs: the trigram, its context, its bigram and that one's context. Each shard, of ``SHARD_ROWS`` rows or so,
    is joined with the documents' counts of its trigrams; the sums are added up. A shard's tables are broadcast whatever
    the size of the model, no document is shuffled but as one sum, and frequent trigrams gather nowhere.
    """
    spark = ship(docs.sparkSession)
    if row_col is None:
        row_col = free_name(docs, "row_number")
        docs = numbered(docs, row_col)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    names = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(row_col).cast("long").alias("carried"))
    texts = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    vocabulary = spark.sparkContext.broadcast(model["vocabulary"])  # at most MOST_WORDS
    shards = max(1, -(-sum(model[t].count() for t in ("tri", "ctx3", "bi")) // SHARD_ROWS))

    def count(shard: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, 1):
                    tokens = Tokens(piece.column(1))
                    keys = trigrams(tokens, vocabulary.value)
                    own = (keys >> BITS & (1 << BITS) - 1) % shards == shard
                    keys, doc = keys[own], tokens.doc[own]
                    order = np.lexsort((keys, doc))
                    keys, doc = keys[order], doc[order]
                    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.zeros(0, np.int64)
                    yield pa.record_batch([piece.column(0).take(pa.array(doc[new])), pa.array(keys[new]), pa.array(np.diff(np.append(new, len(keys))))], ["row", "key", "n"])

        return run

    sums = []
    for shard in range(shards):
        grams = texts.mapInArrow(fresh(count(shard)), "row bigint, key bigint, n bigint")
        scored = log_probabilities(grams, model | {t: own_shard(model[t], shards, shard) for t in ("tri", "ctx3", "bi", "ctx2")})
        sums.append(stored(scored.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("log_p")).alias("log_p")), "sums"))
    total = reduce(DataFrame.unionAll, sums).groupBy(F.col("row").alias("carried")).agg(F.sum("n").alias("n_tokens"), F.sum("log_p").alias("log_p"))
    out = names.join(total, "carried", "left")
    return out.select("id", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("log_p", F.lit(0.0)).alias("log_p"), "carried")


def own_shard(table: DataFrame, shards: int, shard: int) -> DataFrame:
    """The rows of a table of the model whose middle word belongs to the shard: the last but one of a key, the last of a context."""
    middle = F.shiftright("key", BITS) if "key" in table.columns else F.col("context")
    return table.where(F.pmod(middle.bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(shards)) == shard)


def log_probabilities(keyed: DataFrame, model: dict) -> DataFrame:
    """keyed (key, ...) with log_p: that of the trigram if the model has it, else that of the bigram, else that of the word, weighted back. The model's tables are broadcast."""
    mask = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    uni = keyed.sparkSession.createDataFrame(pa.table({"w": np.arange(len(model["uni"])), "p1": model["uni"]}))  # at most MOST_WORDS and the shapes
    keyed = keyed.withColumns({"w": mask(BITS), "vw": mask(2 * BITS), "v": F.shiftright(mask(2 * BITS), BITS), "uv": F.shiftright("key", BITS)})
    keyed = keyed.join(F.broadcast(model["tri"].select("key", F.log("p").alias("p3"))), "key", "left")
    keyed = keyed.join(F.broadcast(model["ctx3"].select(F.col("context").alias("uv"), F.log("gamma").alias("g3"))), "uv", "left")
    keyed = keyed.join(F.broadcast(model["bi"].select(F.col("key").alias("vw"), F.log("p").alias("p2"))), "vw", "left")
    keyed = keyed.join(F.broadcast(model["ctx2"].select(F.col("context").alias("v"), F.log("gamma").alias("g2"))), "v", "left")  # a row for each symbol
    zero = F.lit(0.0)
    log_p = F.coalesce("p3", F.coalesce("g3", zero) + F.coalesce("p2", F.coalesce("g2", zero) + F.col("p1")))
    return keyed.join(F.broadcast(uni), "w", "left").withColumn("log_p", log_p)


class Counts:
    """One shard's trigram counts as a model: log-probabilities of any trigrams with these middle words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, d2, d3, p1: np.ndarray):
        low = lambda x, bits: x & ((1 << bits) - 1)
        self.keys, self.log_p1 = keys, np.log(p1)
        pairs, at, c2 = np.unique(low(keys, 2 * BITS), return_inverse=True, return_counts=True)
        self.pairs = pairs
        self.before, alpha2, gamma2 = self.smoothed(pairs, c2, d2)
        p2 = alpha2 + gamma2[np.searchsorted(self.before, pairs >> BITS)] * p1[low(pairs, BITS)]
        self.contexts, alpha3, gamma3 = self.smoothed(keys, counts, d3)
        p3 = alpha3 + gamma3[np.searchsorted(self.contexts, keys >> BITS)] * p2[at]
        self.log_gamma2, self.log_p2, self.log_gamma3, self.log_p3 = map(np.log, (gamma2, p2, gamma3, p3))

    @staticmethod
    def smoothed(keys: np.ndarray, c: np.ndarray, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts, each key's discounted share, and each context's backoff weight."""
        cut = np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))
        contexts, at = np.unique(keys >> BITS, return_inverse=True)
        total = np.bincount(at, c, len(contexts))
        return contexts, (c - cut) / total[at], np.bincount(at, cut, len(contexts)) / total

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        def held(table: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise) -> np.ndarray:
            if not len(table):
                return np.broadcast_to(otherwise, wanted.shape)
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            return np.where(table[at] == wanted, values[at], otherwise)

        w, vw = keys & ((1 << BITS) - 1), keys & ((1 << 2 * BITS) - 1)
        backed = held(self.pairs, self.log_p2, vw, held(self.before, self.log_gamma2, vw >> BITS, 0.0) + self.log_p1[w])
        return held(self.keys, self.log_p3, keys, held(self.contexts, self.log_gamma3, keys >> BITS, 0.0) + backed)


LOW = (1 << BITS) - 1


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def gaps(x: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The first value of each run, and for the others, which ascend, what is between them and the one before."""
    out = np.diff(x, prepend=0) - 1
    out[runs] = x[runs]
    return out


def ascending(gap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, begin = np.cumsum(gap + 1), np.cumsum(sizes) - sizes
    return total - np.repeat(total[begin] - gap[begin], sizes)


def coded(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Distinct sorted keys of a shard in small numbers, for pack: words by context, middle words by first ones, first words, and how many."""
    own = runs_of(keys >> BITS)
    u, v = keys[own] >> 2 * BITS, (keys[own] >> BITS & LOW) // shards
    first = runs_of(u)
    return [gaps(keys & LOW, own), gaps(v, first), gaps(u[first], np.arange(len(first))[:1]), np.diff(own, append=len(keys)) - 1, np.diff(first, append=len(own)) - 1]


def decoded(parts: list[np.ndarray], shard: int, shards: int) -> np.ndarray:
    w, v, u, own, first = (p.astype(np.int64) for p in parts)
    v = ascending(v, first + 1) * shards + shard
    contexts = np.repeat(ascending(u, np.array([len(u)])), first + 1) << BITS | v
    return np.repeat(contexts, own + 1) << BITS | ascending(w, own + 1)


def blocks(batches: Iterator[pa.RecordBatch], vocabulary: tuple[np.ndarray, np.ndarray], shards: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows (id, text) with some BLOCK_BYTES of texts: their ids, the trigrams by shard and key, the row of each, and where shards begin (one more: the end)."""

    def dealt() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, row = np.concatenate(keys), np.concatenate(of)
        keys.clear(), of.clear()  # one copy at a time
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        own = ((key >> BITS & LOW) % shards).astype(np.int16 if shards < 1 << 15 else np.int64)
        order = np.argsort(own, kind="stable")
        return np.concatenate(ids), key[order], row[order], np.searchsorted(own[order], np.arange(shards + 1))

    ids, keys, of, size, n = [], [], [], 0, 0
    for batch in batches:
        for piece in slices(batch, 1):
            if ids and size + piece.column(1).nbytes > BLOCK_BYTES:
                yield dealt()
                ids, keys, of, size, n = [], [], [], 0, 0
                release()
            tokens = Tokens(piece.column(1))
            ids.append(piece.column(0).to_numpy(zero_copy_only=False))
            keys.append(trigrams(tokens, *vocabulary))
            of.append((tokens.doc + n).astype(np.int32))
            size, n = size + piece.column(1).nbytes, n + piece.num_rows
    if ids:
        yield dealt()


def counted(texts: DataFrame, vocabulary, shards: int) -> DataFrame:
    """One row per shard with trained trigrams: held (keys and counts), n1 to n8 (trigrams and bigrams of count 1 to 4), followers (last words, with the number of distinct words before)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, _, cut in blocks(batches, vocabulary.value, shards):
            for k in np.flatnonzero(np.diff(cut)):
                own, n = np.unique(keys[cut[k] : cut[k + 1]], return_counts=True)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(*coded(own, shards), n)], pa.binary())], ["shard", "held"])

    def add_up(table: pa.Table) -> pa.Table:
        shard, parts = table.column("shard")[0].as_py(), [unpack(blob.as_py()) for blob in table.column("held")]
        keys, at = np.unique(np.concatenate([decoded(p[:5], shard, shards) for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[5] for p in parts]).astype(np.int64)).astype(np.int64)
        pairs, c2 = np.unique(keys & ((1 << 2 * BITS) - 1), return_counts=True)
        last, before = np.unique(pairs & LOW, return_counts=True)
        numbers = [int((c == k).sum()) for c in (n, c2) for k in (1, 2, 3, 4)]
        blobs = [pa.array([pack(*coded(keys, shards), n)], pa.binary()), pa.array([pack(last, before)], pa.binary())]
        return pa.table([pa.array([shard], pa.int32()), *blobs, *(pa.array([x], pa.int64()) for x in numbers)], names)

    names = ["shard", "held", "followers", *(f"n{k}" for k in range(1, 9))]
    made = texts.mapInArrow(fresh(tally), "shard int, held binary")
    return stored(made.groupBy("shard").applyInArrow(add_up, "shard int, held binary, followers binary, " + ", ".join(f"{c} bigint" for c in names[3:])), "model")


def score_all(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``score`` by a model of all of texts (id, text), of any size. Numbers in row_col must be distinct."""
    spark = ship(docs.sparkSession)
    if row_col is None:
        row_col = free_name(docs, "row_number")
        docs = numbered(docs, row_col)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    names = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(row_col).cast("long").alias("carried"))
    rows = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    texts = texts.select("id", "text")
    vocabulary = spark.sparkContext.broadcast(words_of(texts))  # at most MOST_WORDS
    shards = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    model = counted(texts, vocabulary, shards)
    n = [x or 0 for x in model.agg(*(F.sum(f"n{k}") for k in range(1, 9))).first()]
    c1 = np.zeros(len(vocabulary.value[1]))
    for row in model.select("followers").toLocalIterator():
        last, before = unpack(bytes(row["followers"]))
        c1[last.astype(np.int64)] += before
    p1 = unigrams(c1, _cut_off([int((c1 == k).sum()) for k in (1, 2, 3, 4)]))
    known = spark.sparkContext.broadcast((_cut_off(n[4:]), _cut_off(n[:4]), p1))  # at most one for each symbol

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, of, cut in blocks(batches, vocabulary.value, shards):
            for k in np.flatnonzero(np.diff(cut)):
                own, (inside, at) = keys[cut[k] : cut[k + 1]], np.unique(of[cut[k] : cut[k + 1]], return_inverse=True)
                first = runs_of(own)
                held = pack(*coded(own[first], shards), np.diff(first, append=len(own)) - 1, at, np.diff(ids[inside], prepend=0))
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([held], pa.binary())], asked.names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(3))):
                shard, block, blob = (x.as_py() for x in row)
                parts = unpack(blob)
                keys = decoded(parts[:5], shard, shards)
                if block == TRAINED:
                    held, of = Counts(keys, parts[5].astype(np.int64), *known.value), shard
                    continue
                if shard != of:  # nothing was trained
                    held, of = Counts(keys[:0], np.zeros(0, np.int64), *known.value), shard
                logs = np.repeat(held.log_p(keys), parts[5].astype(np.int64) + 1)
                at = parts[6].astype(np.int64)
                steps = np.maximum(np.rint(np.bincount(at, logs) / -STEP), 0).astype(np.int64)
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([pack(parts[7], np.bincount(at), steps)], pa.binary())], asked.names)

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(blob.as_py()) for blob in table.column("held")]
        carried, at = np.unique(np.concatenate([np.cumsum(p[0].view(np.int64)) for p in parts]), return_inverse=True)
        tokens, steps = (np.bincount(at, np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in (1, 2))
        return pa.table([pa.array(carried), pa.array(tokens.astype(np.int64)), pa.array(steps * -STEP)], ["carried", "n_tokens", "log_p"])

    asked = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("held", T.BinaryType())])
    asks = rows.mapInArrow(fresh(ask), asked).unionAll(model.select("shard", F.lit(TRAINED).alias("block"), "held"))
    answers = asks.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(fresh(answer), asked)
    total = answers.groupBy("block").applyInArrow(add, "carried bigint, n_tokens bigint, log_p double")
    out = names.join(total, "carried", "left")
    return out.select("id", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("log_p", F.lit(0.0)).alias("log_p"), "carried")


def classify(docs: DataFrame, labels: DataFrame, sample: int | None = None, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: the id, lang, n_tokens, perplexity (null without tokens), threshold (of its language), keep; with row_col (a long), that too.

    Null and empty texts have no tokens and are kept: there is nothing against them. A language without trusted
    documents, and null, take the threshold of all languages; without any trusted document everything is kept. Ids may
    be null or repeated; an empty table gives no rows. The model is trained on the whole training
    half of the trusted documents (or ``sample`` of them); thresholds and language means cover the whole held-out half.
    """
    with scratch(docs.sparkSession) as keep:
        scored = keep(stored(score_all(docs, trusted_sample(docs, labels, sample, id_col, text_col), id_col, text_col, row_col=row_col), "scores"))
    out = judged(scored, labels, quantile, id_col).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("carried", row_col) if row_col else out.drop("carried")


def judged(scored: DataFrame, labels: DataFrame, quantile: float, id_col: str) -> DataFrame:
    known = scored.where("n_tokens > 0").join(trusted(labels, id_col).where(held_out()), "id", "left_semi")
    mean = F.sum("log_p") / F.sum("n_tokens")
    by_lang = known.groupBy("lang").agg(mean.alias("mean"))
    all_mean = known.agg(mean).first()[0] or 0.0

    def perplexity(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(by_lang), df["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"])  # a row for each language
        drawn = (F.col("log_p") + PRIOR * F.coalesce("mean", F.lit(all_mean))) / (F.col("n_tokens") + PRIOR)
        return df.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-drawn))).drop("mean")

    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    known = perplexity(known)
    limits = known.groupBy(F.col("lang").alias("of")).agg(at.alias("own"))
    common = F.lit(known.agg(at).first()[0]).cast("double")
    out = perplexity(scored)
    out = out.join(F.broadcast(limits), out["lang"].eqNullSafe(limits["of"]), "left")  # a row for each language
    threshold = F.coalesce("own", common)
    return out.select("id", "lang", "n_tokens", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"), "carried")
