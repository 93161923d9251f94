"""Compact arrays that are read in place: packed integers, Elias-Fano sequences, files of named arrays."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

U64 = np.uint64


#: Where the n-th one of a byte is, for all bytes.
PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def bits_for(most: int) -> int:
    return max(1, int(most).bit_length())


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits (at most 56) one after another, and eight spare bytes."""
    out = []
    for i in range(0, len(values), 1 << 16):
        v = np.ascontiguousarray(values[i : i + (1 << 16)], "<u8")
        bit = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bit.ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The packed values at those places."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    bit = at.astype(np.int64) * width
    return (wide[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << width) - 1)


def ef_encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A non-decreasing sequence: low bits packed, high bits in unary with a count of ones for each word."""
    n, most = len(values), int(values[-1]) if len(values) else 0
    low = min(56, max(0, (most // max(1, n)).bit_length() - 1))
    v = values.astype(U64)
    high = (v >> U64(low)).astype(np.int64)
    words = ((int(high[-1]) if n else 0) + n + 1 + 63) // 64
    flags = np.zeros(words * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    upper = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper).astype(np.int64))])
    out = {"upper": upper, "ones": ones, "meta": np.array([n, low], np.int64)}
    if low:
        out["low"] = pack(v & U64((1 << low) - 1), low)
    return {f"{name}.{k}": a for k, a in out.items()}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.upper, self.ones = arrays[f"{name}.upper"], arrays[f"{name}.ones"]
        self.n, self.low = map(int, arrays[f"{name}.meta"])
        self.lows = arrays.get(f"{name}.low")

    def _select(self, counts: np.ndarray, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(counts, k, "right") - 1
        byte = words[w].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(byte), axis=1, dtype=np.uint8)
        nth = (k - counts[w]).astype(np.uint8)
        at = (upto <= nth[:, None]).sum(1)  # the byte that holds it
        row = np.arange(len(k))
        inside = nth - np.where(at > 0, upto[row, at - 1], 0)
        return w * 64 + at * 8 + PLACES[byte[row, at], inside]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        high = (self._select(self.ones, self.upper, i) - i).astype(U64) << U64(self.low)
        return high | unpack(self.lows, self.low, i) if self.low else high

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of values x, best in ascending order; -1 where absent."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> U64(self.low)).astype(np.int64)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        known = np.flatnonzero(high < zeros[-1])
        high = high[known]
        empty = ~self.upper
        ends = self._select(zeros, empty, high) - high
        starts = np.zeros(len(high), np.int64)
        some = high > 0
        starts[some] = self._select(zeros, empty, high[some] - 1) - (high[some] - 1)
        live = np.flatnonzero(starts < ends)
        want = x[known] & U64((1 << self.low) - 1)
        at = starts.copy()
        while len(live):
            got = unpack(self.lows, self.low, at[live]) if self.low else np.zeros(len(live), U64)
            hit = got == want[live]
            out[known[live[hit]]] = at[live[hit]]
            live = live[~hit & (got < want[live])]
            at[live] += 1
            live = live[at[live] < ends[live]]
        return out


def _place(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; it appears whole or not at all, so a repeated task may write it again."""
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(np.array([len(text)], "<i8").tobytes() + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    store.move(own, path)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the shared folder is mounted, else read."""
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        buf = pa.memory_map(path).read_buffer()
    else:
        with store.open_input_file(path) as f:
            buf = f.read_buffer()
    raw = np.frombuffer(buf, np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head, base = json.loads(raw[8 : 8 + n].tobytes()), 8 + n
    return {k: raw[base + at : base + at + np.dtype(kind).itemsize * size].view(kind) for k, (kind, at, size) in head.items()}
