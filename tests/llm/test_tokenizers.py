"""Operators 1 and 8 against the libraries themselves."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe_codec  # noqa: E402
from tessera.llm import token_counts as transducer  # noqa: E402
from tessera.llm.bpe_codec import Codec, encode  # noqa: E402
from tessera.llm.common import utf8  # noqa: E402
from tessera.llm.token_counts import Transducer, token_counts  # noqa: E402

PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\xa0", "éth", "'s", "中", " <", "<|endoftext|>", "<s>", "▁", "😀", "!", "12", "　", " \r\n", "<0x0A>", "\x85", "\u180e", "\u200b", "\u2028", "\ufeff", "I'll", "\x00", "٣", "ª", "e\u0301"]
EDGE = ["", " ", "a" * 5000, " " * 300, "word " * 3000, "▁▁a", "\n\n\n", "<|endoftext|>" * 3, "x<|endoftext|> y"]


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + EDGE


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize(("chunk", "deep", "window"), [(1, 3, 10), (3, 20, 64), (64, 256, 1 << 19), (50, 1, 7)])
def test_counts_for_any_chunks(sp, monkeypatch, chunk, deep, window):
    for name, value in (("CHUNK", chunk), ("DEEP", deep), ("WINDOW", window)):
        monkeypatch.setattr(transducer, name, value)
    t, rows = Transducer(P.path("piece_bpe_32k.model"), 300), texts(1, 300)
    assert t.count_all(rows).tolist() == [len(x) for x in sp.encode(rows)]
    assert [t.count_all([r])[0] for r in rows[:50]] == [len(x) for x in sp.encode(rows[:50])]


def test_transitions_are_compiled_once(sp):
    t, text = Transducer(P.path("piece_bpe_32k.model")), "the quick  brown fox\njumps over " * 40
    n = t.count_all([text])[0]
    states = t.states
    assert t.count_all([text[7:] + text, text])[1] == n == len(sp.encode(text)) and t.states <= states + 40
    emitted = t.read("▁the▁fox", np.array([*map(ord, "▁the▁fox")]), np.array([True, False, False, False, True, False, False, False]))
    assert emitted[:4].sum() == len(sp.encode("the")) and emitted[:2].sum() == len(sp.encode("t"))


def test_the_library_counts_each_distinct_string_once(sp):
    t, asked = Transducer(P.path("piece_bpe_32k.model")), []

    class Library:
        def encode(self, x, **more):
            asked.extend(x if isinstance(x, list) else [x])
            return sp.encode(x, **more)

    t.library, text = Library(), "extraordinary circumstances; extraordinary measures " * 30
    assert t.count_all([text, text[:200]]).tolist() == [len(sp.encode(text)), len(sp.encode(text[:200]))]
    assert len(asked) == len(set(asked)) <= 6  # not a call for each prefix of a word


def test_token_counts(spark, sp):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "é", "y"), (2, None, "z"), (3, "", "z"), (4, "word " * 6000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in token_counts(df, P.path("piece_bpe_32k.model")).na.fill(-1).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows)
    assert got == want
    assert token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_codec_equals_the_library(spark, monkeypatch, bits):
    monkeypatch.setattr(bpe_codec.cuts, "__defaults__", (bits,))
    c, rows = Codec(P.path("byte_bpe_50k.json")), texts(bits, 200)
    documents = []
    for t in rows:
        raw, at = utf8(pa.array([t]))
        begin = bpe_codec.cuts(raw, at).tolist()
        pieces = [raw[b:e].tobytes().decode() for b, e in zip(begin, [*begin[1:], len(raw)])]
        documents.append(bpe_codec.load(bpe_codec.dump(c.chunks(pieces))))
    assert any(chunk.ids is not None for d in documents for chunk in d)
    for text, ids in zip(rows, bpe_codec.assemble(c, documents), strict=True):
        assert ids.tolist() == c.library.encode(text, add_special_tokens=False).ids
        assert c.decode(ids.tolist()) == c.library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_disagreement_is_noticed():
    c = Codec(P.path("byte_bpe_50k.json"))
    chunks = c.chunks(["a word and  more ", "to come of it"])
    chunks[0].ids = chunks[0].ids + 1
    with pytest.raises(ValueError, match="no agreement"):
        bpe_codec.assemble(c, [chunks])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="anchor"):
        Codec(P.path("word_bpe_49k.json"))


def test_shared_passages_are_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(bpe_codec, "BLOCK_BYTES", 20_000)
    rnd = random.Random(2)
    passage = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(2000))
    rows = [(k, f"start {rnd.random()} " + passage + f" end {rnd.random()}") for k in range(40)]
    asked = bpe_codec.ask(spark.createDataFrame(rows, "id long, text string"), 3).toArrow()
    names = [x for r in asked["names"].to_pylist() if r is not None for x in (r[k : k + bpe_codec.NAME] for k in range(0, len(r), bpe_codec.NAME))]
    assert asked["names"].null_count > 10 and len(set(names)) <= 5 * 40 and len(set(names)) < len(names) / 3
    encoded = []
    for k in range(3):
        own = Codec(P.path("byte_bpe_50k.json"))
        monkeypatch.setattr(own, "chunks", lambda t, own=own: encoded.extend(t) or Codec.chunks(own, t))
        bpe_codec.answer(lambda own=own: own, asked.filter(pc.equal(asked["shard"], k)))
    assert sorted(encoded) == sorted(set(encoded)) and len(encoded) == len(set(names))


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as block", "3 as shard")
    got = encode(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in got) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert encode(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("most", [300, 1 << 22])
def test_encode_equals_the_library(spark, monkeypatch, most):
    for name in ("BLOCK_BYTES", "SHARD_BYTES"):
        monkeypatch.setattr(bpe_codec, name, most)
    library = Codec(P.path("byte_bpe_50k.json")).library
    rows = [(k, t) for k, t in enumerate(texts(7, 120) * 2)] + [(None, "x " * 40_000), (3, None)]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)
