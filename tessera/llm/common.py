"""What the operators share: shipping code to workers, the shared folder, and vectorised text scanning.

Texts reach Python as Arrow batches. ``slices`` cuts a batch into pieces of a bounded number of bytes, so that memory
per task doesn't follow the number of rows; one longer text makes a piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tessera.session import free_name, numbered, scratch, shared_dir, ship, stored

__all__ = ["Words", "by_slice", "byte_class", "free_name", "fresh", "fresh_but_for", "grams", "mix", "numbered", "pack", "powers", "release", "resident", "scratch", "shared_path", "ship", "slices", "squeeze", "stored", "unpack", "unsqueeze", "utf8"]
SLICE_BYTES = 256 << 10
MOST_POWERS = 1 << 18  # kept; more are made for a longer text and let go
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]
_resident: dict[Any, Any] = {}
_zstd = pa.Codec("zstd", compression_level=3)


def release() -> None:
    """Give memory that this worker no longer uses back to the system; workers outlive tasks and operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in this worker for later tasks of the same key; whatever another operator kept goes first."""
    if key not in _resident:
        leave()
        _resident[key] = make()
    return _resident[key]


def leave() -> None:
    """Drop what an operator kept in this worker."""
    if _resident:
        _resident.clear()
        release()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def strings(column: pa.Array) -> pa.Array:
    """One contiguous array of 64-bit offsets; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more: the end)."""
    column = strings(column)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column no. text) have at most ``most`` bytes, or one row."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def fresh(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, in a worker without what other operators kept, and with its memory given back at the end."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave()
        yield from run(batches)
        release()

    return alone


def fresh_but_for(key: Any, make: Callable[[], Any], run: Callable[[Any, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run(make(), batches) for mapInArrow; a worker keeps what make() gave until another operator runs there."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(resident(key, make), batches)

    return alone


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES):
    """A function for mapInArrow that applies work to bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, most):
                yield work(piece)

    return fresh(run)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64, and of its inverse."""
    made = _powers
    if len(made[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, MOST_POWERS), base, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n <= MOST_POWERS:
            _powers[:] = made
    return made[0][:n], made[1][:n]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers that aren't negative, byte plane by byte plane (as many as the largest needs), compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        a = np.asarray(a).astype("<u8")
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        head += [len(a), width]
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return squeeze(np.array(head, "<u8").tobytes() + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(unsqueeze(blob), np.uint8)
    number = int(raw[:8].view("<u8")[0])
    head, out, at = raw[8 : 8 + 16 * number].view("<u8").astype(np.int64).reshape(-1, 2).tolist(), [], 8 + 16 * number
    for n, width in head:
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(a.view(U64).reshape(n))
        at += n * width
    return out


def squeeze(raw: bytes, level: int | None = None) -> bytes:
    codec = _zstd if level is None else pa.Codec("zstd", compression_level=level)
    return len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return _zstd.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def byte_class(wanted: Callable[[int], bool]) -> np.ndarray:
    return np.array([wanted(b) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IDENTITY = np.arange(256, dtype=np.uint8)


class Words:
    """The words of texts: first and past-last byte, 64-bit hash and text number of each; hashes take the folded bytes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, member: np.ndarray, fold: np.ndarray = LOWER):
        self.at, n = at, len(raw)
        if not n:
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            self.hashes, self.folded, self.first = np.zeros(0, U64), raw, np.zeros(len(at), np.int64)
            return
        self.folded = b = fold[raw]
        inside = member[b]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (cut[:-1] | ~before))
        self.ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
        up, down = powers(n)
        total = np.cumsum((b.astype(U64) + U64(1)) * up)
        h = total[self.ends - 1]
        later = self.starts > 0
        h[later] -= total[self.starts[later] - 1]
        self.hashes = mix(h * down[self.starts] + (self.ends - self.starts).astype(U64))
        self.first = np.searchsorted(self.starts, at)  # number of the first word of each text
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, k: int) -> bytes:
        return self.folded[self.starts[k] : self.ends[k]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n successive words; shorter at the end by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.zeros(m, U64)
    for k in range(n):
        h = h * U64(0xD1342543DE82EF95) + hashes[k : k + m]
    return mix(h)
