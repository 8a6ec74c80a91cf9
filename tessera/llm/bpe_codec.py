"""Byte-level BPE encoding with content-defined chunk reuse, and decoding (operator 8).

A rolling hash over 16 bytes cuts texts where its high bits are zero, so equal passages are cut alike wherever they
stand. Each distinct chunk of the corpus is encoded once, whatever number of documents have it:

1. Texts are gathered in blocks of some ``BLOCK_BYTES``. A block has the numbers and names (96-bit hashes) of each
   document's chunks, and each distinct chunk's text once.
2. Every block hands its distinct chunks to shards of the name space. A shard encodes each name once and answers all
   blocks that have it. A chunk that is everywhere comes once from a block, so no shard is larger than others for it.
3. A block joins its answers by name and puts its documents together.

A chunk is encoded from its first to its last *anchor*: a place where white space follows another character. There the
tokenizer's pattern always ends a match and no merge crosses (``Codec`` verifies that it is such a tokenizer). Joins of
chunks are repaired: what lies between the last anchor of a chunk and the first of the next (chunks without two anchors lie
between) is encoded again, together with the last stretch between anchors before it and the first one after it. The
repair is done when this agrees with both neighbours' own tokens. Since anchors are boundaries, one stretch on either side
is always enough; if it weren't, the encoding would fail rather than be inexact.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SLICE_BYTES, U64, fresh, mix, pack, release, resident, ship, slices, squeeze, unpack, unsqueeze, utf8

#: White space by every definition of it; Python's \s has also U+001C to U+001F.
ANCHOR = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
LAST_ANCHOR = re.compile(r"[\s\S]*[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")
FIRST_STRETCH = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+")
WINDOW, CUT_BITS = 16, 9
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
OUT_ROWS = 256
LEVEL = 15  # of compression: texts and ids are what is shuffled
NAME = 12  # bytes of a chunk's name: 96 bits, so that 10**12 chunks collide with a probability under 10**-5
TOGETHER = 2000  # chunks that the library has at a time
# Fixed value: where byte-level tokenizers cut before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_gear = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)


def cuts(raw: np.ndarray, at: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks begin, in bytes of raw: at each text, and where the hash of the 16 bytes before is small (moved to the next character)."""
    begin = np.unique(at[:-1])
    if len(raw) <= WINDOW:
        return begin[begin < len(raw)]
    h, reach, factor = _gear[raw], 1, 0x2545F491
    while reach < WINDOW:
        h[reach:] = h[reach:] + np.uint32(factor) * h[:-reach]
        reach, factor = reach * 2, factor * factor & 0xFFFFFFFF
    p = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    p = p[p < len(raw)]
    p = p[p - at[np.searchsorted(at, p, "right") - 1] >= WINDOW]  # the window lies in one text
    for _ in range(3):
        later = (raw[np.minimum(p, len(raw) - 1)] & 0xC0) == 0x80
        p = p + later
    return np.unique(np.concatenate([begin[begin < len(raw)], p[p < len(raw)]]))


class Codec:
    """The library and a decoding table."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        kind = json.loads(self.library.to_str())
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] is not None or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("white space after another character is an anchor for byte-level tokenizers only, without normaliser or prefix")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in kind["added_tokens"]):
            raise ValueError("an added token may cross anchors")
        self._table: list[bytes] | None = None
        self.engine = self._engine(kind)

    def _engine(self, kind: dict):
        """The same merges in a faster library, if ids are in the order of merges and only special tokens were added; else None."""
        model, letter, added = kind["model"], self._letters(), kind["added_tokens"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        own = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        special = {t["content"]: t["id"] for t in added if t["special"] and not t["normalized"]}
        ranks = {bytes(map(letter.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        if len(special) < len(added) or own != sorted(own) or len(single) != 256 or max(single) > min(own) or len(own) + 256 != len(ranks):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids that the library gives for each text; distinct texts are encoded once."""
        distinct = [*dict.fromkeys(texts)]
        ids: dict[str, np.ndarray] = {}
        if self.engine is not None:
            one = self.engine.encode
            ids = {t: np.array(one(t, allowed_special="all"), np.int32) for t in distinct}
            distinct = []
        for some in batched(distinct, TOGETHER):
            ids.update(zip(some, (np.array(e.ids, np.int32) for e in self.library.encode_batch_fast([*some], add_special_tokens=False)), strict=True))
        return [ids[t] for t in texts]

    def chunks(self, texts: list[str]) -> list[Chunk]:
        """The texts, encoded from their first to their last anchor."""
        out, middles = [Chunk(t) for t in texts], []
        for chunk, text in zip(out, texts):
            m = ANCHOR.search(text)
            if m and m.start() < (end := LAST_ANCHOR.match(text).end()):
                chunk.head, middle, chunk.tail = text[: m.start()], text[m.start() : end], text[end:]
                inner = LAST_ANCHOR.match(middle)
                middles.append((chunk, middle, FIRST_STRETCH.match(middle)[0], middle[inner.end() :] if inner else middle))
        whole, *edges = (self.encode([row[k] for row in middles]) for k in (1, 2, 3))
        for (chunk, *_), ids, first, last in zip(middles, whole, *edges, strict=True):
            chunk.ids, chunk.n_first, chunk.n_last = ids, len(first), len(last)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        if self._table is None:
            letter = self._letters()
            size = self.library.get_vocab_size(with_added_tokens=True)
            tokens = [self.library.id_to_token(i) or "" for i in range(size)]
            self._table = [bytes(map(letter.__getitem__, t)) if all(c in letter for c in t) else t.encode() for t in tokens]
        return b"".join(map(self._table.__getitem__, ids)).decode("utf-8", "replace")

    @staticmethod
    def _letters() -> dict[str, int]:
        """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes are numbered from U+0100."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunk:
    """An encoded chunk: the text before its first anchor (all of it, if it has no two), the ids of what comes up to the last one, the text after
    that, and how many ids the first and last stretch between anchors have, by which joins are judged."""

    __slots__ = ("head", "ids", "n_first", "n_last", "tail")

    def __init__(self, head: str, n_first: int = 0, n_last: int = 0, ids: np.ndarray | None = None, tail: str = ""):
        self.head, self.n_first, self.n_last, self.ids, self.tail = head, n_first, n_last, ids, tail


def assemble(codec: Codec, documents: list[list[Chunk]]) -> list[np.ndarray]:
    """The ids of documents from those of their chunks, joins repaired."""
    rows, joins, edge = [], [], Chunk("", ids=np.zeros(0, np.int32))
    for chunks in documents:
        row, left, text = [], edge, ""
        for chunk in chunks:
            text += chunk.head
            if chunk.ids is not None:
                joins.append((left, text, chunk))
                row += (len(joins) - 1, chunk.ids)
                left, text = chunk, chunk.tail
        joins.append((left, text, edge))
        rows.append([*row, len(joins) - 1])
    windows = [codec.decode(a.ids[len(a.ids) - a.n_last :].tolist()) + text + codec.decode(b.ids[: b.n_first].tolist()) for a, text, b in joins]
    repaired = []
    for (a, _, b), window, ids in zip(joins, windows, codec.encode(windows)):
        end = len(ids) - b.n_first
        if a.n_last > end or ids[: a.n_last].tobytes() != a.ids[len(a.ids) - a.n_last :].tobytes() or ids[end:].tobytes() != b.ids[: b.n_first].tobytes():
            raise ValueError(f"no agreement around {window!r}: white space isn't an anchor of this tokenizer")
        repaired.append(ids[a.n_last : end])
    return [np.concatenate([repaired[x] if isinstance(x, int) else x for x in row]) for row in rows]


def ask(picked: DataFrame, shards: int) -> DataFrame:
    """Rows for the shards of the name space: the distinct chunks of a block that belong to the shard (names, sizes, texts), and for each block one row
    of its ids, chunks per document, and the number of each chunk among the block's distinct ones by ascending name."""
    kind = T.ArrayType(picked.schema["id"].dataType)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("names", "sizes", "texts")), T.StructField("ids", kind), *(T.StructField(c, T.BinaryType()) for c in ("counts", "codes"))])
    bounds = np.array([(k << 64) // shards for k in range(shards)], U64)

    def rows(block: int, ids: list[pa.Array], counts: list[np.ndarray], codes: list[int], known: dict[bytes, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        names = sorted(known)
        place = np.zeros(len(known), np.int64)
        place[[known[x][0] for x in names]] = np.arange(len(names))
        listed, coded = pa.concat_arrays(ids), place[np.array(codes, np.int64)] if codes else np.zeros(0, np.int64)
        head = [pa.array([block % shards], pa.int32()), pa.array([block], pa.int64()), *[pa.nulls(1, pa.binary())] * 3]
        yield pa.record_batch([*head, pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), pa.array([pack(np.concatenate(counts))], pa.binary()), pa.array([pack(coded)], pa.binary())], schema.names)
        high = np.array([int.from_bytes(x[:8], "big") for x in names], U64)
        cut = np.append(np.searchsorted(high, bounds), len(names)).tolist()
        for shard in np.flatnonzero(np.diff(cut)).tolist():
            own = names[cut[shard] : cut[shard + 1]]
            texts = [known[x][1] for x in own]
            blobs = [b"".join(own), pack(np.array([*map(len, texts)])), squeeze(b"".join(texts), LEVEL)]
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.nulls(1, pa.list_(listed.type)), *[pa.nulls(1, pa.binary())] * 2], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, counts, codes, known = TaskContext.get().partitionId() << 32, 0, [], [], [], {}
        for batch in batches:
            for piece in slices(batch, 1, min(SLICE_BYTES, BLOCK_BYTES)):
                raw, at = utf8(piece.column(1))
                if ids and size + len(raw) > BLOCK_BYTES:
                    yield from rows(number, ids, counts, codes, known)
                    number, size, ids, counts, codes, known = number + 1, 0, [], [], [], {}
                begin = cuts(raw, at)
                data, first = raw.tobytes(), np.searchsorted(begin, at)
                for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(raw)]):
                    chunk = data[b:e]
                    name = hashlib.blake2b(chunk, digest_size=NAME).digest()
                    codes.append(known.setdefault(name, (len(known), chunk))[0])
                ids.append(piece.column(0))
                counts.append(np.diff(first))
                size += len(raw)
        if ids:
            yield from rows(number, ids, counts, codes, known)

    return picked.mapInArrow(fresh(run), schema)


def answer(codec, table: pa.Table) -> pa.Table:
    """Each distinct chunk of a shard, encoded once, for every block that has it; the blocks' own rows pass through."""
    asked = [[x[NAME * k : NAME * (k + 1)] for k in range(len(x) // NAME)] if x is not None else None for x in table["names"].to_pylist()]
    texts: dict[bytes, str] = {}
    for names, sizes, blob in zip(asked, table["sizes"], table["texts"]):
        if names is None or all(n in texts for n in names):
            continue
        raw, at = unsqueeze(blob.as_py()), 0
        for name, size in zip(names, unpack(sizes.as_py())[0].tolist()):
            if name not in texts:
                texts[name] = raw[at : at + size].decode()
            at += size
    known = dict(zip(texts, codec().chunks([*texts.values()])))
    release()
    chunks = pa.array([None if names is None else dump([known[n] for n in names]) for names in asked], pa.binary())
    return pa.table([table["block"], table["shard"], chunks, table["ids"], table["counts"], table["codes"]], ["block", "shard", "chunks", "ids", "counts", "codes"])


def dump(chunks: list[Chunk]) -> bytes:
    texts = [t.encode() for c in chunks for t in (c.head, c.tail)]
    ids = [np.zeros(0, np.int32) if c.ids is None else c.ids for c in chunks]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    narrow = int(flat.max(initial=0) < 1 << 16)  # left in order, so that repeated words compress
    numbers = pack([*map(len, ids)], [c.n_first for c in chunks], [c.n_last for c in chunks], [*map(len, texts)], [narrow])
    rest = flat.astype("<u2" if narrow else "<u4").tobytes() + b"".join(texts)
    return len(numbers).to_bytes(8, "little") + numbers + squeeze(rest, LEVEL)


def load(blob: bytes) -> list[Chunk]:
    size = int.from_bytes(blob[:8], "little")
    counts, n_first, n_last, lengths, narrow = (x.astype(np.int64) for x in unpack(blob[8 : 8 + size]))
    raw, kind = unsqueeze(blob[8 + size :]), np.dtype("<u2" if narrow[0] else "<u4")
    ids = np.frombuffer(raw, kind, int(counts.sum())).astype(np.int32)
    ends, cut = (len(ids) * kind.itemsize + np.cumsum(lengths)).tolist(), np.cumsum(counts).tolist()
    texts = iter([raw[a:b].decode() for a, b in zip([len(ids) * kind.itemsize, *ends], ends)])
    rows = zip(texts, texts, n_first.tolist(), n_last.tolist(), [0, *cut], cut)
    return [Chunk(head, f, n, ids[a:b] if b > a else None, tail) for head, tail, f, n, a, b in rows]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per row of docs: the id, ids array<int>, and with decoded, the text that these ids give back.

    Null and empty texts have no ids and decode to ''. Ids may be null or repeated; other columns are not read, whatever
    their names; an empty table gives no rows. Memory is bounded by the longest text plus a block and a shard; chunks are
    shuffled compressed, once for each block that has them, as texts to the shards and as ids back.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType
    shards = max(1, (picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    codec = lambda: resident(("codec", tokenizer_path), lambda: Codec(tokenizer_path))
    answers = ask(picked, shards).groupBy("shard").applyInArrow(lambda t: answer(codec, t), T.StructType([T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("chunks", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("counts", T.BinaryType()), T.StructField("codes", T.BinaryType())]))
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded)

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table["chunks"]))
        ids, counts, codes = own["ids"][0].values, unpack(own["counts"][0].as_py())[0].astype(np.int64), unpack(own["codes"][0].as_py())[0].astype(np.int64).tolist()
        held = table.filter(pc.is_valid(table["chunks"])).sort_by("shard")
        known = [c for blob in held["chunks"] for c in load(blob.as_py())]
        ends = np.cumsum(counts).tolist()
        coded = assemble(codec(), [[known[c] for c in codes[a:b]] for a, b in zip([0, *ends], ends)])
        del known, held, table
        out = []
        for k in range(0, len(coded), OUT_ROWS):
            some = coded[k : k + OUT_ROWS]
            offsets = np.concatenate([[0], np.cumsum([*map(len, some)])])
            columns = [ids.slice(k, len(some)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(some), pa.int32()))]
            if decoded:
                columns.append(pa.array([codec().decode(c.tolist()) for c in some], pa.string()))
            out.append(pa.record_batch(columns, schema.names))
            coded[k : k + OUT_ROWS] = [None] * len(some)
        release()
        return pa.Table.from_batches(out)

    out = answers.groupBy("block").applyInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])
