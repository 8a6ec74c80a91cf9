"""Tokens for the language models: words, runs of one punctuation mark, and line ends, with hashes and shapes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.common import IDENTITY, U64, Words, byte_class, mix, utf8

WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
MARK = byte_class(lambda b: b == 10 or 33 <= b <= 126 and not chr(b).isalnum())
#: Shapes of words that a vocabulary lacks.
LOWER, CAPITAL, UPPER, NUMBER, MARKS = range(5)
SHAPES = 5


class Tokens:
    """Hash, shape and text number of each token of texts, in order, and how often a word has just been said before (0, 1, 2 or more)."""

    def __init__(self, column: pa.Array):
        raw, self.at = utf8(column)
        n = len(raw)
        words = Words(raw, self.at, WORD, IDENTITY)
        if not n:
            self.hashes, self.shapes, self.repeats, self.doc = np.zeros(0, U64), np.zeros(0, np.int8), np.zeros(0, np.int8), np.zeros(0, np.int64)
            return
        mark = MARK[raw]
        fresh = np.ones(n, bool)
        fresh[1:] = raw[1:] != raw[:-1]
        fresh[self.at[:-1][self.at[:-1] < n]] = True
        mark_start = np.flatnonzero(mark & fresh)
        edge = np.flatnonzero(fresh)
        mark_end = np.append(edge, n)[np.searchsorted(edge, mark_start, "right")]
        mark_hash = mix(raw[mark_start].astype(U64) * U64(1000003) + np.minimum(mark_end - mark_start, 4).astype(U64))
        second = np.zeros(n, bool)
        second[1:] = raw[:-1] == 0xC3  # Latin-1 letters beyond ASCII
        up = (raw >= 65) & (raw <= 90) | second & (raw >= 0x80) & (raw <= 0x9E)
        low = (raw >= 97) & (raw <= 122) | second & (raw >= 0xA0)
        digit = (raw >= 48) & (raw <= 57)

        def per_word(flags: np.ndarray) -> np.ndarray:
            total = np.cumsum(flags)
            return total[words.ends - 1] - total[words.starts] + flags[words.starts]

        ups = per_word(up)
        shape = np.where(per_word(digit) > 0, NUMBER, np.where((ups >= 2) & (per_word(low) == 0), UPPER, np.where(ups > 0, CAPITAL, LOWER))).astype(np.int8)
        same = np.zeros(len(shape), bool)
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        starts = np.concatenate([words.starts, mark_start])
        order = np.argsort(starts, kind="stable")
        self.hashes = np.concatenate([words.hashes, mark_hash])[order]
        self.shapes = np.concatenate([shape, np.full(len(mark_start), MARKS, np.int8)])[order]
        again = same.astype(np.int8)
        again[1:] += same[1:] & same[:-1]
        self.repeats = np.concatenate([again, np.zeros(len(mark_start), np.int8)])[order]
        self.doc = np.searchsorted(self.at, starts[order], "right") - 1
