"""Token counts by a compiled transducer (operator 1).

The tokenizer (merges by rank, white space as U+2581) never joins U+2581 to what stands before it: no piece of the
vocabulary has U+2581 after another character, which ``Transducer`` verifies. The transducer reads one character at a
time. Its states are what has been read since the last U+2581 that followed another character; each has the number of
tokens of that string. A transition is annotated with the tokens it emits, the difference of its two states' numbers
(negative where a merge takes tokens back), so that the emissions along a path add up to the tokens of what it reads.
U+2581 after another character is a *reset*: it leads from every state to state 0. Transitions are compiled on first
use and kept in one hash table of bounded size. What a path emits between two resets is the number of the state that it
ends in, so the library is asked for a state's number when a path first ends there, and for those in between only by
``read``, which gives the emissions of single transitions; a string that was counted before is never tokenised again.

All texts of a slice are read as one stream, which is cut into chunks of ``CHUNK`` characters; the chunks are read side
by side, a character of each at a time. The map of a chunk sends the state before it to the state after it and the tokens
emitted. Where the chunk has a reset, what comes after it doesn't depend on the state before: this constant part is read
first, for all chunks. Then maps compose: a chunk's entry is its left neighbour's exit, which is constant wherever that
has a reset, so the rest of all such chunks is read at once, too; only chunks without a reset pass on a state that must be
known first, and each round of the scan settles all whose left neighbour is settled. Strings between resets that are longer
than ``DEEP`` aren't compiled (each would add a state a character); the library counts them whole. So at most DEEP / CHUNK + 1
rounds are needed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, fresh_but_for, ship, slices, utf8

SPACE = "▁"
CHUNK, DEEP = 64, 256
WINDOW = 1 << 19  # characters read at a time
MOST_STATES = 1_500_000
CHARACTER_BITS = np.int64(21)
_MIX = U64(0x9E3779B97F4A7C15)


class Transducer:
    """Counts of tokens for a sentencepiece BPE model that turns white space to U+2581 and puts one in front."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece has white space after another character; resets would not be independent")
        if self.library.encode("a  b ", out_type=str)[-1] != SPACE or self.library.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("the model changes white space; only identity normalisation with one space in front is compiled")
        self.alone = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.most = most_states
        self.clear()

    def clear(self, bits: int = 16) -> None:
        """State 0 (just U+2581 read) is all that is left."""
        self.states, self.tokens = 1, np.full(1 << bits, -1, np.int32)  # tokens: of each state, -1 if never asked for
        self.tokens[0] = self.alone
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        """A table of transitions: (state, character) in one integer, and the next state."""
        self.bits, self.keys, self.next = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, or the free one where it would be, and what is held there."""
        at = ((keys.view(U64) * _MIX) >> U64(64 - self.bits)).view(np.int64)
        held = self.keys.take(at)
        open_ = np.flatnonzero(held != keys)
        open_ = open_[held[open_] >= 0]
        while len(open_):
            at[open_] = further = (at[open_] + 1) & (len(self.keys) - 1)
            held[open_] = now = self.keys.take(further)
            open_ = open_[(now != keys[open_]) & (now >= 0)]
        return at, held

    def insert(self, keys: np.ndarray, states: np.ndarray) -> None:
        """Add transitions whose keys are new and distinct."""
        while len(keys):
            at, _ = self.slots(keys)
            self.keys[at] = keys
            own = self.keys[at] == keys
            self.next[at[own]] = states[own]
            keys, states = keys[~own], states[~own]

    def compile(self, keys: np.ndarray) -> None:
        """Add transitions (state, character) to states of their own."""
        while self.states + len(keys) > len(self.keys) >> 1:
            filled = np.flatnonzero(self.keys >= 0)
            old = self.keys[filled], self.next[filled]
            self._empty(self.bits + 1)
            self.tokens = np.append(self.tokens, np.full(len(self.tokens), -1, np.int32))
            self.insert(*old)
        self.insert(keys, np.arange(self.states, self.states + len(keys), dtype=np.int32))
        self.states += len(keys)

    def numbers(self, text: str, since: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The tokens of states, which hold what was read from since (U+2581) to ends."""
        new = np.flatnonzero(self.tokens[states] < 0)
        if len(new):
            own, first = np.unique(states[new], return_index=True)
            first = new[first]
            strings = [text[a + 1 : b + 1] for a, b in zip(since[first].tolist(), ends[first].tolist())]
            self.tokens[own] = np.fromiter(map(len, self.library.encode(strings, num_threads=1)), np.int32, len(strings))
        return self.tokens[states]

    def read(self, text: str, codes: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The tokens emitted at each character of a stream that begins with a reset."""
        place, states = np.arange(len(codes)), self.walk(codes, reset)
        held = self.numbers(text, np.maximum.accumulate(np.where(reset, place, 0)), place, states)
        return held - np.where(reset, 0, np.append(0, held[:-1]))

    def walk(self, codes: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The state after each character of a stream that begins with a reset."""
        if self.states > self.most:
            self.clear()
        n, chunks = len(codes), -(-len(codes) // CHUNK)
        fill = chunks * CHUNK - n
        columns = np.ascontiguousarray(np.append(codes, np.zeros(fill, np.int64)).reshape(chunks, CHUNK).T)
        resets = np.ascontiguousarray(np.append(reset, np.ones(fill, bool)).reshape(chunks, CHUNK).T)
        out = np.zeros((CHUNK, chunks), np.int32)

        def step(p: int, lanes: np.ndarray, state: np.ndarray) -> np.ndarray:
            keys = state << CHARACTER_BITS | columns[p].take(lanes)
            at, held = self.slots(keys)
            missing = np.flatnonzero(held != keys)
            if len(missing):
                self.compile(np.unique(keys[missing]))
                at, _ = self.slots(keys)
            out[p, lanes] = state = self.next.take(at)
            return state

        # The constant part of each chunk's map: from its first reset on.
        exits = np.full(chunks, -1, np.int64)
        for p in range(CHUNK):
            lanes = np.flatnonzero((exits >= 0) & ~resets[p])
            exits[lanes] = step(p, lanes, exits[lanes])
            exits[resets[p]] = 0
        # Composition with the exits of the left neighbours.
        heads = np.where(resets.any(axis=0), resets.argmax(axis=0), CHUNK)
        waiting = np.flatnonzero(heads > 0)
        while len(waiting):
            ready = exits[waiting - 1] >= 0  # the first chunk begins with a reset and never waits
            lanes, waiting = waiting[ready], waiting[~ready]
            state = exits[lanes - 1]
            for p in range(int(heads[lanes].max())):
                inside = heads[lanes] > p
                state[inside] = step(p, lanes[inside], state[inside])
            whole = heads[lanes] == CHUNK
            exits[lanes[whole]] = state[whole]
        return out.T.reshape(-1)[:n]

    def count_all(self, texts: list[str]) -> np.ndarray:
        """The number of tokens that the library gives for each text; an empty text has none."""
        counts = np.zeros(len(texts), np.int64)
        filled = np.array([k for k, t in enumerate(texts) if t], np.int64)
        if not len(filled):
            return counts
        stream = "".join(SPACE + texts[k] for k in filled).replace(" ", SPACE)
        codes = np.frombuffer(stream.encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) + 1 for k in filled])[:-1]])
        space = codes == ord(SPACE)
        reset = np.zeros(len(codes), bool)
        reset[starts] = True
        reset[1:] |= space[1:] & ~space[:-1]
        begins = np.flatnonzero(reset)
        sizes = np.diff(np.append(begins, len(codes)))
        deep = sizes > DEEP
        aside = np.repeat(deep, sizes)
        reset |= aside
        emitted, a = np.zeros(len(codes), np.int64), 0
        ends = np.append(begins[1:], len(codes)) - 1
        while a < len(codes):  # windows end before a reset
            b = len(codes) if len(codes) - a <= WINDOW else int(begins[np.searchsorted(begins, a + WINDOW, "right") - 1])
            if b <= a:  # one string that the library counts, longer than a window
                b = int(np.append(begins, len(codes))[np.searchsorted(begins, a, "right")])
            states = self.walk(codes[a:b], reset[a:b])
            own = slice(*np.searchsorted(begins, [a, b]))
            shallow = ~deep[own]
            since, last = begins[own][shallow], ends[own][shallow]
            emitted[since] = self.numbers(stream, since, last, states[last - a])
            a = b
        for x, size in zip(begins[deep].tolist(), sizes[deep].tolist()):
            emitted[x] = len(self.library.encode(stream[x + 1 : x + size]))
        counts[filled] = np.add.reduceat(emitted, starts)
        return counts


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; ids may be null or repeated, each row has its own result; other
    columns are not read, whatever their names; an empty table gives no rows. No shuffle; memory is bounded by the longest
    text plus some ``MOST_STATES`` states.
    """
    ship(docs.sparkSession)

    def run(compiled: Transducer, batches):
        for batch in batches:
            for piece in slices(batch, 1):
                counts = compiled.count_all([t or "" for t in piece.column(1).to_pylist()])
                yield pa.record_batch([piece.column(0), pa.array(np.diff(utf8(piece.column(1))[1])), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keep = fresh_but_for(("transducer", model_path), lambda: Transducer(model_path), run)
    out = picked.mapInArrow(keep, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
