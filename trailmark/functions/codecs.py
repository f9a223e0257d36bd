"""Integer codecs: array<int> to binary and back, ``decode(encode(v)) == v``.

Null and empty arrays encode to null, which decodes to null. All but the delta
codecs take non-negative numbers only and raise on others. Parquet's own delta
encoding serves storage; these are functions for data that leaves it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _checked(v: np.ndarray) -> np.ndarray:
    if len(v) and v.min() < 0:
        raise ValueError("only delta codecs take negative numbers")
    return v


class Varint:
    """Groups of four: a byte with four lengths of one to four bytes, then the numbers, low byte first."""

    def encode(self, v: np.ndarray) -> bytes:
        v = _checked(v)
        raw = v.astype("<u4").tobytes()
        sizes = 1 + (v > 0xFF).astype(int) + (v > 0xFFFF) + (v > 0xFFFFFF)
        out = [struct.pack("<I", len(v))]
        for g in range(0, len(v), 4):
            part = sizes[g : g + 4].tolist()
            out.append(bytes([sum(s - 1 << 2 * i for i, s in enumerate(part))]))
            out += [raw[4 * (g + i) : 4 * (g + i) + s] for i, s in enumerate(part)]
        return b"".join(out)

    def decode(self, data: bytes) -> np.ndarray:
        n, at, out = struct.unpack_from("<I", data)[0], 4, []
        while len(out) < n:
            head, at = data[at], at + 1
            for i in range(min(4, n - len(out))):
                size = (head >> 2 * i & 3) + 1
                out.append(int.from_bytes(data[at : at + size], "little"))
                at += size
        return np.array(out, np.int64)


#: How many numbers of how many bits fill a 64-bit word, by selector.
WORDS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


class Simple8b:
    """64-bit words: a selector of four bits and as many numbers as its width lets in."""

    def encode(self, v: np.ndarray) -> bytes:
        values, at, out = _checked(v).tolist(), 0, [struct.pack("<I", len(v))]
        while at < len(values):
            for selector, (n, bits) in enumerate(WORDS):
                part = values[at : at + n]
                # zeros alone fill the words without bits, and only in full
                if max(part) < 1 << bits and (bits or len(part) == n):
                    out.append(struct.pack("<Q", selector | sum(x << 4 + i * bits for i, x in enumerate(part))))
                    at += n
                    break
        return b"".join(out)

    def decode(self, data: bytes) -> np.ndarray:
        n, out = struct.unpack_from("<I", data)[0], []
        for (word,) in struct.iter_unpack("<Q", data[4:]):
            count, bits = WORDS[word & 15]
            out += [word >> 4 + i * bits & (1 << bits) - 1 for i in range(count)]
        return np.array(out[:n], np.int64)


def _packed(v: np.ndarray, bits: int) -> bytes:
    return np.packbits((v[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    b = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits).astype(np.int64)
    return (b << np.arange(bits)).sum(1)


class PFor:
    """Low bits packed at one width; the rest of numbers that need more goes to the inner codec, with their places.

    ``width`` is a number of bits, "new" (the least that holds nine tenths of the numbers) or
    "opt" (the one with the shortest result).
    """

    def __init__(self, inner, width):
        self.inner, self.width = inner, width

    def _at(self, v: np.ndarray, bits: int) -> bytes:
        over = np.flatnonzero(v >> bits)
        places, high = (self.inner.encode(x) if len(x) else b"" for x in (over, v[over] >> bits))
        return struct.pack("<IBI", len(v), bits, len(places)) + _packed(v & (1 << bits) - 1, bits) + places + high

    def encode(self, v: np.ndarray) -> bytes:
        v = _checked(v)
        need = np.sort([max(1, int(x).bit_length()) for x in v])
        if self.width == "new":
            return self._at(v, int(need[-(-9 * len(v) // 10) - 1]))
        if self.width == "opt":
            return min((self._at(v, int(b)) for b in np.unique(need)), key=len)
        return self._at(v, self.width)

    def decode(self, data: bytes) -> np.ndarray:
        n, bits, size = struct.unpack_from("<IBI", data)
        at, low = 9, -(-n * bits // 8)
        v = _unpacked(data[at : at + low], n, bits)
        at += low
        if size:
            v[self.inner.decode(data[at : at + size])] += self.inner.decode(data[at + size :]) << bits
        return v


class Delta:
    """Differences from the least number, or, of ascending numbers, from the one before; to the inner codec."""

    def __init__(self, inner, ascending: bool = False):
        self.inner, self.ascending = inner, ascending

    def encode(self, v: np.ndarray) -> bytes:
        steps = self.ascending and bool((np.diff(v) >= 0).all())
        base = int(v[0] if steps else v.min())
        return struct.pack("<?q", steps, base) + self.inner.encode(np.diff(v, prepend=v[0]) if steps else v - base)

    def decode(self, data: bytes) -> np.ndarray:
        steps, base = struct.unpack_from("<?q", data)
        v = self.inner.decode(data[9:])
        return (np.cumsum(v) if steps else v) + base


class Steps:
    """The first number, then differences folded to non-negative numbers, seven bits a byte."""

    def encode(self, v: np.ndarray) -> bytes:
        d = np.diff(v, prepend=0)
        out = bytearray()
        for x in np.where(d < 0, -2 * d - 1, 2 * d).tolist():
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        return bytes(out)

    def decode(self, data: bytes) -> np.ndarray:
        out, x, shift = [], 0, 0
        for b in data:
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                out.append(-(x + 1) // 2 if x & 1 else x // 2)
                x = shift = 0
        return np.cumsum(np.array(out, np.int64))


#: The codecs' names.
CODECS = {
    "VGB": Varint(),
    "DELTA_COMPRESS_VGB": Delta(Varint()),
    "DELTA_COMPRESS_SIMPLE8B": Delta(Simple8b()),
    "DELTA_COMPRESS_NEW_PFD_SIMPLE8B": Delta(PFor(Simple8b(), "new")),
    "DELTA_COMPRESS_NEW_PFD_SIMPLE8B_SORTED": Delta(PFor(Simple8b(), "new"), ascending=True),
    "DELTA_COMPRESS_OPT_PFD_SIMPLE8B": Delta(PFor(Simple8b(), "opt")),
    "DELTA_COMPRESS2": Steps(),
    "PFOR_VGB_20": PFor(Varint(), 20),
    "PFOR_SIMPLE8B_20": PFor(Simple8b(), 20),
    "NEW_PFD_VGB": PFor(Varint(), "new"),
    "OPT_PFD_VGB": PFor(Varint(), "opt"),
    "NEW_PFD_SIMPLE8B": PFor(Simple8b(), "new"),
    "OPT_PFD_SIMPLE8B": PFor(Simple8b(), "opt"),
}
NAMES = tuple(CODECS)


def encode(name: str, values) -> bytes | None:
    return CODECS[name].encode(np.asarray(values, np.int64)) if values is not None and len(values) else None


def decode(name: str, data: bytes | None) -> list[int] | None:
    return CODECS[name].decode(data).tolist() if data else None


def encoded(name: str) -> Callable:
    """Column of array<int> to binary."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: encode(name, x))

    return run


def decoded(name: str) -> Callable:
    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: decode(name, x))

    return run
