"""Nulls, repeats, ties, empty tables, clashing columns and brute force, for the operators that other tests leave out."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bm25, cross_entropy, kneser_ney, sharding, warc

DOCS = "doc_id long, text string"


def sentences(seed, n, vocabulary=30):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice([f"word{k}" for k in range(vocabulary)]) for _ in range(rnd.randint(1, 20))) for _ in range(n)]


def test_cross_entropy_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "BLOCK_BYTES", 400)
    monkeypatch.setattr(cross_entropy, "SHARD_TOKENS", 100)
    texts = sentences(3, 40)
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[0]), (200, None), (201, ""), (202, " \t"), (203, "word1 " * 3000)]
    labels = [(k, 1 if k % 3 == 0 else 0, 0) for k in range(30)] + [(3, 1, 0), (9, 1, 1), (200, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as target", "2 as block", "'x' as ids")
    got = cross_entropy.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    trusted = {k for k, q, toxic in labels if q == 1 and toxic == 0}
    models = []
    symbols = len({w for _, t in rows for w in (t or "").split()})
    for keep in (lambda i: i in trusted, lambda i: True):
        words, before, pairs, n, filled = collections.Counter(), collections.Counter(), collections.Counter(), 0, 0
        for i, t in rows:
            w = (t or "").split() if keep(i) else []
            filled += bool(w)
            n += len(w)
            words.update(w)
            before.update(w[:-1])
            pairs.update(zip([None, *w], w))
        before[None] = filled
        models.append((words, before, pairs, n))

    def loss(model, w):
        words, before, pairs, n = model
        out = 0.0
        for a, b in zip([None, *w], w):
            one = (words[b] + cross_entropy.PSEUDO) / (n + cross_entropy.PSEUDO * symbols)
            p = cross_entropy.SHARE * pairs[a, b] / before[a] + (1 - cross_entropy.SHARE) * one if before[a] else one
            out -= math.log(p)
        return out / len(w)

    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, len((t or "").split()), *((loss(m, t.split()) for m in models) if (t or "").split() else (None, None))) for i, t in rows), key=key)
    have = sorted(((r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[2:], b[2:])), (a, b)
    assert not any(r["selected"] for r in got if r["n_tokens"] == 0)
    empty = cross_entropy.score(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_bm25_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 2000)
    same = "alpha beta gamma"
    rows = [(k, same) for k in range(50)] + [(None, same), (60, None), (61, ""), (62, "delta"), (62, "delta alpha"), (63, "omega " * 2000 + "delta")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as terms", "2 as number", "3 as shard")
    index = bm25.build_index(df)
    queries = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, None), (3, ""), (4, "unheard"), (None, "alpha"), (5, "delta")], DOCS)
    got = collections.defaultdict(list)
    for r in bm25.search(index, queries, 5).orderBy("query", "place").collect():
        got[r["query"]].append((r["place"], r["doc_id"]))
    assert got.keys() == {1, 5}
    assert got[1] == [(k + 1, k) for k in range(5)]  # ties go by id, whatever the number of copies
    assert [i for _, i in got[5]][:2] == [62, 62] and [i for _, i in got[5]][2] == 63
    assert bm25.search(index, queries.limit(0), 5).count() == 0
    assert bm25.search(bm25.build_index(df.limit(0)), queries, 5).count() == 0


def test_bm25_scores_many_queries_at_once(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # a shard takes the texts of several batches
    try:
        texts = [*sentences(9, 300, 60), *["common words of copies"] * 40, ""]
        df = spark.createDataFrame([*enumerate(texts)], DOCS).coalesce(1)
        rows = bm25.build_index(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 1
    row, k = rows[0], 5
    counts, n = [collections.Counter(bm25.Words(*bm25.utf8(pa.array([texts[i]])), bm25.MEMBER).hashes.tolist()) for i in row["ids"]], len(texts)
    df_, mean = collections.Counter(w for c in counts for w in c), sum(c.total() for c in counts) / n
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df_.items()}
    norm = [1.2 * (0.25 + 0.75 * c.total() / mean) for c in counts]
    queries = [sorted(c) for c in counts if c]
    batch = bm25.Batch(np.array([w for q in queries for w in q], np.uint64), np.array([idf[w] for q in queries for w in q]), np.array([*map(len, queries)]))
    monkeypatch.setattr(bm25, "BLOCK", 16)
    monkeypatch.setattr(bm25, "TILE", 4)
    want = []
    for i, q in enumerate(queries):
        scores = [(-round(sum(idf[w] * c[w] * 2.2 / (c[w] + x) for w in q if w in c), 9), d) for c, x, d in zip(counts, norm, row["ids"])]
        want += [(i, d, -s) for s, d in sorted(x for x in scores if x[0])[:k]]
    for dense, pairs in ((600, 500_000), (0, 700), (1 << 30, 700)):  # both ways, sums alone, products alone
        monkeypatch.setattr(bm25, "DENSE", dense)
        monkeypatch.setattr(bm25, "PAIRS", pairs)
        shard = bm25.Shard([row[c] for c in ("lengths", "terms", "begin", "docs", "tf")], np.array(row["ids"]), mean, k)
        floors, copies = np.zeros(len(queries)), shard.terms.tolist().index(bm25.Words(*bm25.utf8(pa.array(["copies"])), bm25.MEMBER).hashes[0])
        assert sum(t.begin[at + 1] - t.begin[at] for t in shard.tiles for at in np.flatnonzero(t.number == copies)) == k  # not 40
        for _ in range(2):  # without floors, then with the k-th best as floor
            query, docs, scores = shard.search(batch, floors, k)
            got = [*zip(query.tolist(), np.array(row["ids"])[docs].tolist(), scores.tolist())]
            assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose(scores, [x[2] for x in want], rtol=0, atol=2e-9)
            floors = np.array([min(s for i, _, s in want if i == q) if sum(i == q for i, *_ in want) == k else 0.0 for q in range(len(queries))])


def test_bm25_gives_about_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 1500)
    texts = sentences(8, 400, 300)
    df = spark.createDataFrame([*enumerate(texts)], DOCS)
    index, rows, real = bm25.build_index(df), [], bm25._best
    monkeypatch.setattr(bm25, "_best", lambda found, k: rows.append(found.count()) or real(found, k))
    shards = index.count()
    assert shards >= 16
    bm25.search(index, df.where("doc_id % 20 = 0"), 10).collect()
    assert max(rows[:-1]) <= 20 * 10 * 6  # not 10 from each shard
    with_all = 20 * 10 * shards
    assert max(rows[:-1]) < with_all / 2


def test_classifier_of_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    long = docs.limit(1).selectExpr("-5L as doc_id", "repeat(text, 300) as text", "lang", "source", "n_chars")
    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(long)
    odd = odd.withColumns({"row": F.lit("a"), "key": F.lit("b"), "n_tokens": F.lit("c"), "carried": F.lit("d")})
    got = kneser_ney.classify(odd, labels, sample=60).collect()
    assert len(got) == docs.count() + 8 and sum(r["doc_id"] is None for r in got) == 2
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_tokens"], r["perplexity"] and round(r["perplexity"], 6), r["keep"]))
    assert all(len(v) == 1 for k, v in by.items() if k is not None)


def test_sharding_packs_where_the_product_is_highest():
    rnd = np.random.default_rng(3)
    vectors = rnd.gamma(1.0, 1.0, (60, 3))
    where = sharding.pack(vectors, 4)
    v = vectors / vectors.sum(axis=0) * 4
    residual, want = np.ones((4, 3)), {}
    for k in sorted(range(60), key=lambda k: (-v[k].max(), k)):
        fits = [s for s in range(4) if (residual[s] >= v[k] - 1e-12).all()]
        best = max(fits or range(4), key=lambda s: (residual[s] @ v[k], -s))
        want[k] = best
        residual[best] -= v[k]
    assert where.tolist() == [want[k] for k in range(60)]
    load = np.array([v[where == s].sum(axis=0) for s in range(4)])
    assert abs(load - 1).max() < 0.2


@pytest.mark.parametrize("n", [40, 400])
def test_sharding_leaves_light_groups_whole(spark, n):
    """Groups far lighter than a shard are never cut, whatever the size of the table."""
    rnd = random.Random(n)
    rows = []
    for g in range(n):
        text = f"group {g} " + "word " * rnd.randint(1, 40)
        rows += [(len(rows) + k, text) for k in range(rnd.choice((1, 2, 3)))]
    rows += [(5, "tie"), (5, "tie"), (None, "tie"), (None, None)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as unit", "3 as rank"), 4).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_warc_of_clashing_columns(spark):
    rows = [(1, "u", "a", "x"), (2, None, None, "y"), (3, "w", "a" * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").selectExpr("*", "1 as id", "2 as payload", "3 as rank", "4 as first", "5 as n")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.write(pages)).collect()}
    assert got == {1: (1, "response", None), 2: (0, "response", None), 3: (300_000, "response", None)}


def odd_documents(spark, path, empty=False):
    """A table of documents as files, with nulls, empty and long texts, and repeated rows."""
    rows = [(1, "see api_key = " + "9f86d081884c7d65" + " here", "en"), (1, "see api_key = " + "9f86d081884c7d65" + " here", "en"), (None, None, None), (2, "", "de"), (3, "plain words " * 4000, "en"), (4, "plain words", None)]
    clashes = [f"{k} as {name}" for k, name in enumerate(("row_number", "file_name", "file_rank", "component_id", "place", "key", "spans", "base", "id"))]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars", *clashes)
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_stages_take_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline as C

    docs = odd_documents(spark, str(tmp_path / "documents.parquet"))
    for _, stage in C.STAGES:
        assert stage(spark, odd_documents(spark, str(tmp_path / stage.__name__), empty=True), sf).count() == 0
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    clean = C.redacted(spark, docs, sf).collect()
    want = [r.asDict() | ({"text": "see [REDACTED] here", "n_chars": 19} if r["doc_id"] == 1 else {}) for r in docs.collect()]
    assert sorted((r.asDict() for r in clean), key=key) == sorted(want, key=key)
    tokens = C.tokens(spark, docs, sf).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(C.tokenizer_path("byte_bpe_50k.json"))
    expected = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in tokens), key=repr) == sorted(expected, key=repr)
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens)
    kept = C.near_duplicates(spark, docs, sf).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=repr)


def test_rows_of_files_are_numbered_without_copies(spark, tmp_path):
    from tessera import session

    docs = odd_documents(spark, str(tmp_path / "a b.parquet"))
    name = session.free_name(docs, "row_number")
    numbered, again = session.numbered(docs, name), session.numbered(docs, name)
    rows = sorted((r[name], r["text"]) for r in numbered.where("text is not null").collect())
    assert name == "row_number_" and rows == sorted((r[name], r["text"]) for r in again.where("text is not null").repartition(5).collect())
    assert numbered.select(name).distinct().count() == docs.count() == numbered.count()
    assert "numbered-" not in numbered._jdf.queryExecution().toString()


def test_scratch_deletes_what_it_made(spark):
    import os

    from tessera.session import scratch, stored

    df = spark.range(5)
    with scratch(spark) as keep:
        a = stored(df, "a")
        with scratch(spark) as keep_inside:
            b, c = stored(df, "b"), keep_inside(stored(df, "c"))
        places = [x.stored_in.removeprefix("file:") for x in (a, b, c)]
        assert [os.path.exists(p) for p in places] == [True, False, True]
        keep(a)
    assert [os.path.exists(p) for p in places] == [True, False, False] and a.count() == 5
