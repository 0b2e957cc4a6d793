"""Elias-Fano sequences over numpy arrays, and files of arrays that can be memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
import pyarrow.fs

U = np.uint64


def _in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the one number r (from 0) in each 64-bit word."""
    x, r = x.copy(), r.astype(np.int64)
    at = np.zeros(len(x), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        m = x & U((1 << s) - 1)
        c = np.bitwise_count(m).astype(np.int64)
        go = r >= c
        at += go * s
        r -= go * c
        x = np.where(go, x >> U(s), m)
    return at


class EliasFano:
    """A sorted sequence of integers below 2**64.

    The low bits of each value are packed; the high bits are unary in a bit vector
    with running counts of its ones and zeros. access() reads by position,
    successor() finds the first value that is not less than a given one: the high
    bits give a range of positions, the low bits are bisected within it.
    """

    FIELDS = ("head", "low", "high", "ones", "zeros")

    def __init__(self, head, low, high, ones, zeros) -> None:
        self.n, self.bits = int(head[0]), int(head[1])
        self.low_words, self.high, self.ones, self.zeros = low, high, ones, zeros
        self.head = head

    @classmethod
    def build(cls, v: np.ndarray) -> EliasFano:
        v = v.astype(U)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        at = (v >> U(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(n + (top >> bits) + 1) // 64) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(U)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(count)[:-1]))
        low = np.zeros(n * bits // 64 + 2, U)
        if bits and n:
            x, place = v & U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            w, off = place >> 6, (place & 63).astype(U)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1))
            low[w[starts]] += np.add.reduceat(x << off, starts)
            over = (place & 63) + bits > 64
            low[w[over] + 1] += x[over] >> (U(64) - off[over])
        return cls(np.array([n, bits], np.int64), low, high, ones.astype(np.int64), 64 * np.arange(len(high)) - ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return dict(zip(self.FIELDS, (self.head, self.low_words, self.high, self.ones, self.zeros), strict=True))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        place = i * self.bits
        w, off = place >> 6, (place & 63).astype(U)
        x = self.low_words[w] >> off
        x |= np.where((place & 63) + self.bits > 64, (self.low_words[w + 1] << U(1)) << (U(63) - off), U(0))
        return x & U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = i.astype(np.int64)
        w = np.searchsorted(self.ones, i, side="right") - 1
        at = w * 64 + _in_word(self.high[w], i - self.ones[w])
        return ((at - i).astype(U) << U(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x (n if none), and whether it equals x."""
        x = x.astype(U)
        h = (x >> U(self.bits)).astype(np.int64)
        inside = (h >= 0) & (h <= len(self.high) * 64 - self.n)
        h = np.where(inside, h, 0)
        first, stop = self._bucket(h), self._bucket(h + 1)
        first[~inside] = stop[~inside] = self.n
        low = x & U((1 << self.bits) - 1)
        i, end = first, stop.copy()
        live = np.flatnonzero(i < end)
        while len(live):
            middle = (i[live] + end[live]) >> 1
            less = self._low(middle) < low[live]
            i[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[i[live] < end[live]]
        equal = np.zeros(len(x), bool)
        some = np.flatnonzero(i < stop)
        equal[some] = self._low(i[some]) == low[some]
        return i, equal

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Position of the first value whose high bits are h or more: the ones before the zero of number h - 1."""
        out, some = np.zeros(len(h), np.int64), np.flatnonzero(h > 0)
        j = h[some] - 1
        out[some] = self.n
        known = j < len(self.high) * 64 - self.n
        j, some = j[known], some[known]
        w = np.searchsorted(self.zeros, j, side="right") - 1
        out[some] = w * 64 + _in_word(~self.high[w], j - self.zeros[w]) - j
        return out


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file, each at a multiple of 64 bytes behind a JSON head."""
    fs, at = _fs(path)
    fs.create_dir(os.path.dirname(at))
    head, offset = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), offset]
        offset += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with fs.open_output_stream(at) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that cannot be mapped it is first copied beside the worker."""
    fs, at = _fs(path)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), os.path.basename(at))
        if not os.path.exists(local):
            pyarrow.fs.copy_files(at, f"{local}.{os.getpid()}", source_filesystem=fs)
            os.replace(f"{local}.{os.getpid()}", local)
        at = local
    data = np.memmap(at, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, (kind, n, offset) in head.items():
        start = 8 + size + offset
        out[name] = data[start : start + n * np.dtype(kind).itemsize].view(kind)
    return out


def put(prefix: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": a for k, a in ef.arrays().items()}


def get(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(*(arrays[f"{prefix}.{k}"] for k in EliasFano.FIELDS))
