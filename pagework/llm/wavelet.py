"""Wavelet matrix of a sequence of token ids, and the file that holds one with its documents.

The matrix keeps one bit-plane for each bit of the ids, most significant first. Each plane is the bit of
the ids in the order that sorting stably by the bits before it leaves. With counts of ones at every
512th place, a token, the number of its occurrences before a place, and the place of its k-th
occurrence are each found in one step a plane.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"WVMX0001"
_BLOCK = 512


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: packed bits
        self.counts = [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        ones = np.bitwise_count(plane)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK // 8), dtype=np.int64) if len(ones) else []
        return np.concatenate([[0], np.cumsum(sums, dtype=np.int64)])

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        bits = int(ids.max()).bit_length() if len(ids) else 0
        ids = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, n = [], [], len(ids)
        for bit in range(bits - 1, -1, -1):
            on = (ids & ids.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(on))
            sorted_ = np.empty_like(ids)
            ones = np.count_nonzero(on)
            np.compress(on, ids, out=sorted_[n - ones :])
            np.compress(~on, ids, out=sorted_[: n - ones])
            zeros.append(int(n - ones))
            ids = sorted_
        return WaveletMatrix(n, planes, zeros)

    def _rank(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block = at // _BLOCK
        plane, begin = self.planes[level], block * _BLOCK // 8
        ones = int(self.counts[level][block]) + int(np.bitwise_count(plane[begin : at // 8]).sum())
        rest = at % 8
        return ones + (int(plane[at // 8]) >> (8 - rest)).bit_count() if rest else ones

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._rank(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value * 2 + bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``end`` stand after the last plane."""
        if value < 0 or value.bit_length() > len(self.planes):
            return 0, 0
        low, high = 0, end
        for level in range(len(self.planes)):
            below, upto = self._rank(level, low), self._rank(level, high)
            if value >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + below, self.zeros[level] + upto
            else:
                low, high = low - below, high - upto
        return low, high

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` before place ``end``, by default in the whole."""
        low, high = self._range(value, self.n if end is None else end)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of ``value``, counted from 0."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            wanted = at - self.zeros[level] if one else at
            a, b = 0, self.n  # the first place with more than ``wanted`` such bits up to it
            while a < b:
                middle = (a + b) // 2
                ones = self._rank(level, middle + 1)
                if (ones if one else middle + 1 - ones) > wanted:
                    b = middle
                else:
                    a = middle + 1
            at = a
        return at

    def locate(self, value: int) -> list[int]:
        """Places of all occurrences."""
        return [self.select(value, k) for k in range(self.count(value))]

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's sorting is undone and its bit set."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            on = np.unpackbits(self.planes[level], count=self.n).view(bool)
            values[self.zeros[level] :] |= kind(1 << len(self.planes) - 1 - level)
            before = np.empty_like(values)
            before[on] = values[self.zeros[level] :]
            before[~on] = values[: self.zeros[level]]
            values = before
        return values


def to_bytes(shard: int, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """One file: magic, length of the header, header, and the compressed parts it names the sizes of."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids], bool)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [pack(x.tobytes()) for x in (np.packbits(known), ids, np.asarray(lengths, np.int64), *matrix.planes)]
    head = {"shard": shard, "docs": len(doc_ids), "n": matrix.n, "zeros": matrix.zeros, "sizes": [len(p) for p in parts]}
    body = b"".join(parts)
    head["crc32"] = zlib.crc32(body)
    text = json.dumps(head).encode()
    return MAGIC + struct.pack("<I", len(text)) + text + body


def from_bytes(data: bytes) -> tuple[int, list[int | None], np.ndarray, WaveletMatrix]:
    """Shard number, document ids, tokens of each document, and the matrix."""
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack("<I", data[8:12])
    head = json.loads(data[12 : 12 + size])
    body = data[12 + size :]
    if zlib.crc32(body) != head["crc32"]:
        raise ValueError("a token file is damaged")
    ends = np.cumsum(head["sizes"])
    unpack = zstandard.ZstdDecompressor().decompress
    known, ids, lengths, *planes = (unpack(body[e - s : e]) for s, e in zip(head["sizes"], ends))
    known = np.unpackbits(np.frombuffer(known, np.uint8), count=head["docs"])
    doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(ids, np.int64), known)]
    matrix = WaveletMatrix(head["n"], [np.frombuffer(p, np.uint8) for p in planes], head["zeros"])
    return head["shard"], doc_ids, np.frombuffer(lengths, np.int64), matrix
