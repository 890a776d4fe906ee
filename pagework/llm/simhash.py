"""Near-duplicate texts by SimHash and the general pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The bits are grouped into partitions by
correlation. By the general pigeonhole principle, if thresholds T_i of -1 or more add up to
radius - partitions + 1, every fingerprint within the radius of q differs from q in at most T_i bits of
some partition i (-1: the partition is not asked). Dynamic programming chooses the thresholds for each
fingerprint on its own, by the number of candidates estimated from histograms of the bits. It probes
the partitions accordingly and verifies the candidates.

A probe that meets more than ``bucket_limit`` fingerprints has no use; such dense fingerprints are
linked exactly through their one-bit neighbourhoods: two of them differ in at most two bits if and only
if some value is within one bit of both, so grouping by these values finds all links within the dense,
and links to the others are found by the probes of the others. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, map_texts, texts
from pagework.llm.components import component_roots
from pagework.sources.scratch import Scratch

BITS, SHINGLE, SEED = 64, 3, 42
RADIUS = 2
#: Fingerprints that a probe may meet before its fingerprint counts as dense.
BUCKET_LIMIT = 128
_SUB = 8  # bits of a histogram


def fingerprint(raw: bytes) -> int:
    """Unsigned SimHash of a text: words are separated by ASCII white space, letters A-Z are lower-cased,
    a bit is set if it is set in more than half the XXH64 of the shingles, repeats included."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        shingles = [joined]
        digests = xxhash.xxh64_digest(joined, SEED)
        return int.from_bytes(digests, "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    votes, n = np.zeros(BITS, np.int64), len(words) - SHINGLE + 1
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(begins[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist())
        shingles = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(shingles, np.uint8).reshape(-1, BITS // 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tie, fp)`` for every row: ``tie`` is a hash of the text, ``fp`` the fingerprint as a signed
    long. Null text has none of the words and the fingerprint 0."""
    rows = texts(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")), "doc_id", "tie"
    )

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(b) for b in bodies(part)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("tie"), pa.array(fps)], ["doc_id", "tie", "fp"]
        )

    return map_texts(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def _matrix(fps: np.ndarray) -> np.ndarray:
    """Bit j of each fingerprint in column j."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cells(rows: DataFrame, count) -> np.ndarray:
    """Sum of the vectors that ``count`` makes of batches. The vector has a fixed length, so a task adds
    a fixed number of rows whatever it reads."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = count(_numbers(batch))
            total = made if total is None else total + made
        if total is not None:
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    summed = rows.select("fp").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    vector = np.zeros(1 + max((r["cell"] for r in summed), default=0), np.int64)
    for r in summed:
        vector[r["cell"]] = r["n"]
    return vector


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of about equal size with bits that correlate, from the counts of joint ones."""
    ones = np.diag(joint) / max(n, 1)
    deviation = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    strength = np.abs((joint / max(n, 1) - np.outer(ones, ones)) / np.outer(deviation, deviation))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), parts)):
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda b: strength[b, group].sum()))
        free -= set(group)
        groups.append(group)
    return groups


def choose_parts(n: int, radius: int = RADIUS) -> int:
    """Number of partitions with the fewest probes and chance candidates, equal thresholds and even
    bits supposed. Any number gives the same links."""
    from math import comb

    def cost(parts: int) -> float:
        width, units, total = BITS // parts, radius + 1, 0.0
        for i in range(parts):
            threshold = units // parts + (i < units % parts) - 1
            ball = sum(comb(width, d) for d in range(threshold + 1))
            total += ball * (1 + n / 2.0**width)
        return total

    return min(range(1, radius + 3), key=cost)


class Partitions:
    """Values of partitions, estimated candidates, and the choice of thresholds."""

    def __init__(self, groups: list[list[int]], histograms: np.ndarray | None, n: int, radius: int):
        self.groups, self.n, self.radius = groups, n, radius
        self.masks = [
            [np.uint64(sum(1 << i for i in c)) for d in range(radius + 1) for c in combinations(range(len(g)), d)]
            for g in groups
        ]
        self.ball = [[sum(1 for c in m if int(c).bit_count() <= t) for t in range(radius + 1)] for m in self.masks]
        subs = [g[i : i + _SUB] for g in groups for i in range(0, len(g), _SUB)]
        self.owner = [p for p, g in enumerate(groups) for _ in range(0, len(g), _SUB)]
        self.subs = subs
        if histograms is not None:
            # near[s][v, d]: share of fingerprints whose sub-block s differs from v in d bits
            values = np.arange(1 << _SUB)
            distance = np.bitwise_count(values[:, None] ^ values[None, :])
            self.near = [
                np.stack([(distance == d) @ h for d in range(radius + 1)], axis=1) / max(n, 1)
                for h in histograms.reshape(len(subs), 1 << _SUB)
            ]

    @staticmethod
    def _pack(bits: np.ndarray, columns: list[int]) -> np.ndarray:
        return bits[:, columns].astype(np.uint64) @ (np.uint64(1) << np.arange(len(columns), dtype=np.uint64))

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        bits = _matrix(fps)
        return [self._pack(bits, g) for g in self.groups]

    def count_subs(self, fps: np.ndarray) -> np.ndarray:
        bits = _matrix(fps)
        return np.concatenate(
            [np.bincount(self._pack(bits, s).astype(np.int64), minlength=1 << _SUB) for s in self.subs]
        )

    def estimates(self, fps: np.ndarray) -> np.ndarray:
        """Candidates plus probes of each fingerprint, partition and threshold, sub-blocks taken to be
        independent of each other."""
        bits, out = _matrix(fps), np.zeros((len(fps), len(self.groups), self.radius + 1))
        shares: list[np.ndarray | None] = [None] * len(self.groups)
        for sub, part, near in zip(self.subs, self.owner, self.near):
            own = near[self._pack(bits, sub).astype(np.int64)]
            if shares[part] is None:
                shares[part] = own
            else:
                old = shares[part]
                shares[part] = np.stack(
                    [sum(old[:, k] * own[:, d - k] for k in range(d + 1)) for d in range(self.radius + 1)], axis=1
                )
        for part, share in enumerate(shares):
            out[:, part] = self.n * np.cumsum(share, axis=1) + np.array(self.ball[part])
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """Per fingerprint the cheapest thresholds that add up to radius - partitions + 1. The state of
        the dynamic programme is the sum of T_i + 1 so far."""
        costs, units = self.estimates(fps), self.radius + 1
        best = np.full((len(fps), units + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for part in range(len(self.groups)):
            options = np.full((len(fps), units + 1, units + 1), np.inf)  # state after, units taken
            for used in range(units + 1):
                cost = costs[:, part, used - 1] if used else 0.0
                options[:, used:, used] = best[:, : units + 1 - used] + (cost[:, None] if used else 0.0)
            taken.append(options.argmin(axis=2))
            best = options.min(axis=2)
        chosen, state = np.zeros((len(fps), len(self.groups)), np.int64), np.full(len(fps), units)
        for part in range(len(self.groups) - 1, -1, -1):
            used = taken[part][np.arange(len(fps)), state]
            chosen[:, part], state = used - 1, state - used
        return chosen

    def probes(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen, values = self.thresholds(fps), self.values(fps)
        parts = []
        for part, own in enumerate(values):
            for t in range(self.radius + 1):
                at = np.nonzero(chosen[:, part] == t)[0]
                if len(at):
                    masks = np.array(self.masks[part][: self.ball[part][t]], np.uint64)
                    probe = (own[at, None] ^ masks).ravel()
                    parts.append((np.repeat(fps[at], len(masks)), np.full(len(probe), part, np.int32), probe))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _emit(rows: DataFrame, work, step: int = 4096) -> DataFrame:
    """``(fp, part, value)`` rows that ``work`` makes of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _numbers(batch)
            for at in range(0, len(fps), step):
                fp, part, value = work(fps[at : at + step])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(part), pa.array(value.view(np.int64))], ["fp", "part", "value"]
                )

    return rows.select("fp").mapInArrow(run, "fp long, part int, value long")


def near_links(
    nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, parts: int | None = None, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """Links ``(a, b)``, a < b, between different fingerprints ``fp`` of ``nodes`` that differ in at most
    ``radius`` bits. Between dense fingerprints only a spanning part of the links is given, of which
    everything that is connected stays connected. ``radius`` is 2 at most where fingerprints are dense."""
    n = nodes.count()
    joint = _cells(nodes, lambda fps: (_matrix(fps).astype(np.float32).T @ _matrix(fps).astype(np.float32)).ravel().astype(np.int64))
    joint = np.pad(joint, (0, BITS * BITS - len(joint))).reshape(BITS, BITS)
    groups = group_bits(joint, n, parts or choose_parts(n, radius))
    plain = Partitions(groups, None, n, radius)
    histograms = _cells(nodes, plain.count_subs)
    size = len(plain.subs) << _SUB
    own = Partitions(groups, np.pad(histograms, (0, size - len(histograms))), n, radius)

    def index_rows(fps: np.ndarray):
        values = own.values(fps)
        return (
            np.tile(fps, len(values)),
            np.repeat(np.arange(len(values), dtype=np.int32), len(fps)),
            np.concatenate(values),
        )

    index = scratch.keep(_emit(nodes, index_rows), "index")
    probes = scratch.keep(_emit(nodes, own.probes), "probes")
    crowded = scratch.keep(
        index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_limit), "crowded"
    ).select("part", "value")
    if crowded.isEmpty():
        usable, dense = index, None
    else:
        usable = index.join(crowded, ["part", "value"], "left_anti")
        dense = scratch.keep(probes.join(crowded, ["part", "value"], "left_semi").select("fp").distinct(), "dense")
    found = (
        probes.select(F.col("fp").alias("q"), "part", "value")
        .join(usable, ["part", "value"])
        .filter((F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius))
    )
    links = found.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b"))
    if dense is not None:
        if radius > 2:
            raise ValueError("dense fingerprints need a radius of 2 at most; raise bucket_limit")
        flips = [F.col("fp")]
        if radius:
            flips += [F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << b).view(np.int64))).cast("long")) for b in range(BITS)]
        around = dense.select("fp", F.explode(F.array(*flips)).alias("value"))
        # At most 65 different fingerprints are within one bit of a value.
        balls = around.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members"))
        star = balls.select("a", F.explode("members").alias("b")).filter("a < b")
        if radius < 2:
            star = star.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        links = links.unionByName(star)
    return links.distinct()


def grouped(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
    parts: int | None = None, bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """``(doc_id, tie, fp, root, component_id)`` for every row; ``root`` is the same inside a component."""
    marked = scratch.keep(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = component_roots(near_links(nodes, scratch, radius, parts, bucket_limit), scratch)
    rooted = nodes.join(roots, nodes["fp"] == roots["a"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = scratch.keep(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, scratch: Scratch, *args, **options) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; arguments as for ``grouped``.

    ``component_id`` is the smallest id reachable over links. Null and empty text have the fingerprint
    0 and are linked like any other. A row with null id takes part and gets a component, but its id
    names none; where no row of a component has an id, its component is null. Repeated rows come out
    one each. An empty table gives an empty result.
    """
    return grouped(docs, scratch, *args, **options).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, scratch: Scratch, *args, **options) -> DataFrame:
    """``(doc_id, tie)`` of one row of each component: the least id, null last, then the least hash of the
    text; arguments as for ``grouped``. An empty table gives an empty result."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    chosen = grouped(docs, scratch, *args, **options).groupBy("root").agg(F.min(order).alias("c"))
    return chosen.select("c.doc_id", "c.tie")
