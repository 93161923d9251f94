"""Numpy kernels over the bytes of a column of texts: words and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Space and U+0009 to U+000D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as texts need it."""
    have = _powers.get(base, np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts or byte strings laid end to end, and where each starts (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    # byte strings need not be whole characters
    kind, none = (pa.large_binary(), b"") if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else (pa.large_string(), "")
    col = pc.fill_null(col.cast(kind), none)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], (offs - offs[0] if len(offs) else np.zeros(1, np.int64))


def slices(offs: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together, at least one text each; long texts stay whole."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def running(raw: np.ndarray) -> np.ndarray:
    """Sums from which run_hashes() takes the hash of any run."""
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(_R, len(raw)), out=total[1:])
    return total


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte run raw[start:end]."""
    total = running(raw) if total is None else total
    own = (total[ends] - total[starts]) * powers(_R_INV, len(raw) + 1)[starts]
    return mix(own ^ ((ends - starts).astype(U64) << U64(48)))


def word_spans(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and end; bytes marked in `space` are between words."""
    gap = space[raw]
    first, last = ~gap, ~gap
    if len(raw):
        first[1:] &= gap[:-1] | False
        last[:-1] &= gap[1:]
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(raw))]  # texts touch without a space
        first[inner] |= ~gap[inner]
        last[inner - 1] |= ~gap[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts in order, and where each text's words start."""
    starts, ends = word_spans(raw, offs)
    return run_hashes(LOWER[raw], starts, ends), np.searchsorted(starts, offs)


def cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """The byte runs raw[start:end] as a column; for texts, runs are whole characters."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def class_runs(raw: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As words(), for runs of bytes of one class; class 0 separates.  Case is kept."""
    c = classes[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = c[1:] != c[:-1]
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = c[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return run_hashes(raw, starts, ends), np.searchsorted(starts, offs)
