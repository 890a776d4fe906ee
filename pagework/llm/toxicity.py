"""Toxic text: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters by two vectors, one of the hashed word and one the mean of its hashed character
n-grams. A text is cut into overlapping windows; the network gives each window a logit, and the text
is toxic if any window is. All windows of the whole text are scored. The network is fitted with
``score = 1 - prod(1 - sigmoid(logit))`` on a bounded sample of labelled rows and broadcast (under 1 MB).

The product alone would call every text toxic that is long enough, as clean windows have a small probability
each. So a text is scored by its strongest window and by what the others have beyond the measure of as many
clean windows, which is taken from the clean texts of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, free_name, map_texts
from pagework.llm.words import Letters, WordTable

WINDOW, STRIDE = 24, 16
WORD_BUCKETS, GRAM_BUCKETS, GRAM_ORDERS = 1 << 14, 1 << 12, (3, 4, 5)
EMBED, HIDDEN, ATTEND = 8, 8, 8
#: Rows of each label that the network is fitted on, at most.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 4000
EPOCHS, DOCS_A_STEP, RATE = 3, 32, 5e-3
#: Steps of the fit at least: few rows are gone through more often.
LEAST_STEPS = 300
#: Words in fewer texts of the sample are hidden from the fit, which would learn texts by heart from them.
LEAST_TEXTS = 3
#: Windows whose states are held at once for the backward pass of a step, about 12 kB each.
WINDOWS_HELD = 8192
#: Clean texts that the evidence of a clean window is measured on, and how often it is taken off.
QUIET_TEXTS, QUIET_TIMES = 1000, 2.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words laid end to end: the first word of each window, its number of words,
    and its text. A text without words has one empty window."""
    counts = [1 + max(0, -(-(n - WINDOW) // STRIDE)) for n in lengths]
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.concatenate([np.arange(c) for c in counts]) * STRIDE if counts else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    sizes = np.minimum(np.asarray(lengths)[owner] - first, WINDOW)
    return first + offsets[owner], sizes, owner


def _grid(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)
    inside = steps < sizes[:, None]
    at = np.where(inside, first[:, None] + steps, 0)
    return (flat[at] if len(flat) else np.zeros(at.shape, np.int64)), inside


@dataclass
class Network:
    """Parameters by name; recurrent ones have a row for each direction."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the answer of a network that had nothing to learn from
    quiet: float = 0.0  # mean evidence of a window of clean texts

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = {
            "word": (WORD_BUCKETS, EMBED), "gram": (GRAM_BUCKETS, EMBED),
            "x": (2, 2 * EMBED, 3 * HIDDEN), "xb": (2, 3 * HIDDEN),
            "u": (2, HIDDEN, 2 * HIDDEN), "uc": (2, HIDDEN, HIDDEN),
            "a": (2 * HIDDEN, ATTEND), "ab": (ATTEND,), "av": (ATTEND,),
            "o": (2 * HIDDEN,), "ob": (1,),
        }
        scale = {"word": 0.1, "gram": 0.1, "xb": 0.0, "ab": 0.0, "ob": 0.0, "av": 0.5}
        p = {k: (rng.standard_normal(s) * scale.get(k, 0.35)).astype(np.float32) for k, s in shape.items()}
        p["ob"] -= 4
        return Network(p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, list]:
        """Input vector of each word, and what the backward pass needs of the way there."""
        letters = Letters(words)
        word = (letters.words() % np.uint64(WORD_BUCKETS)).astype(np.int64)
        owner = np.append(np.repeat(np.arange(len(words)), letters.lengths + 1), 0)
        buckets, owners = [], []
        for bucket, valid in letters.grams(GRAM_ORDERS, GRAM_BUCKETS):
            buckets.append(bucket[valid])
            owners.append(owner[valid])
        bucket, owner = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        count = np.bincount(owner, minlength=len(words))
        sums = np.zeros((len(words), EMBED), np.float32)
        some = np.nonzero(count)[0]
        if len(some):
            begins = np.cumsum(count)[some] - count[some]
            sums[some] = np.add.reduceat(self.p["gram"][bucket], begins, axis=0)
        share = (1 / np.maximum(count, 1)).astype(np.float32)
        return np.concatenate([self.p["word"][word], sums * share[:, None]], axis=1), [word, bucket, owner, share]

    def project(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of either direction: (words, 2, 3 * HIDDEN)."""
        return np.einsum("we,deg->wdg", x, self.p["x"], optimize=True) + self.p["xb"]

    def forward(self, table: np.ndarray, ids: np.ndarray, inside: np.ndarray, keep: list | None = None):
        """Logit of each window. ``keep`` collects what the backward pass needs."""
        p, n = self.p, len(ids)
        states = np.zeros((n, WINDOW, 2 * HIDDEN), np.float32)
        full = inside.all(axis=0)
        for d, steps in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                gates = table[ids[:, t], d]
                zr = _sigmoid(gates[:, : 2 * HIDDEN] + h @ p["u"][d])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                if not full[t]:
                    z = z * inside[:, t, None]
                c = np.tanh(gates[:, 2 * HIDDEN :] + (r * h) @ p["uc"][d])
                if keep is not None:
                    keep.append((d, t, h, z, r, c))
                h = h + z * (c - h)
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        seen = np.tanh(states @ p["a"] + p["ab"])
        weight = np.exp(seen @ p["av"]) * inside
        weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states, optimize=True)
        if keep is not None:
            keep.extend((states, seen, weight, pooled))
        return pooled @ p["o"] + p["ob"][0]

    def backward(self, d_logit, table_size, ids, inside, keep) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters after the inputs, and of each word's projection."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        states, seen, weight, pooled = keep[-4:]
        g["o"], g["ob"] = d_logit @ pooled, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled, optimize=True)
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["av"] = np.einsum("nt,nta->a", d_raw, seen, optimize=True)
        d_seen = d_raw[:, :, None] * p["av"] * (1 - seen * seen)
        g["a"] = np.einsum("nth,nta->ha", states, d_seen, optimize=True)
        g["ab"] = d_seen.sum(axis=(0, 1))
        d_states = d_states + d_seen @ p["a"].T
        d_table = np.zeros((table_size, 2, 3 * HIDDEN), np.float32)
        d_next = np.zeros((2, len(ids), HIDDEN), np.float32)
        for d, t, h, z, r, c in reversed(keep[:-4]):
            d_h = d_next[d] + d_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            d_c = d_h * z * (1 - c * c)
            d_z = d_h * (c - h) * z * (1 - z) * inside[:, t, None]
            d_rh = d_c @ p["uc"][d].T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            g["u"][d] += h.T @ d_zr
            g["uc"][d] += (r * h).T @ d_c
            np.add.at(d_table[:, d], ids[:, t], np.concatenate([d_zr, d_c], axis=1))
            d_next[d] = d_h * (1 - z) + d_rh * r + d_zr @ p["u"][d].T
        return g, d_table

    def step_gradients(self, words: list[bytes], flat: np.ndarray, lengths: list[int], label: np.ndarray):
        """Loss and gradients over some texts; ``flat`` numbers their words end to end."""
        x, (word, bucket, owner, share) = self.inputs(words)
        ids, inside = _grid(flat, *(w := windows(lengths))[:2])
        table = self.project(x)
        # Many windows are gone through in blocks, forward once more for each: what the backward pass needs of a
        # block is all that is held.
        blocks = [slice(i, i + WINDOWS_HELD) for i in range(0, len(ids), WINDOWS_HELD)]
        keep: list = []
        if len(blocks) == 1:
            logit = self.forward(table, ids, inside, keep)
        else:
            logit = np.concatenate([self.forward(table, ids[b], inside[b]) for b in blocks])
        evidence = np.bincount(w[2], weights=np.logaddexp(0, logit), minlength=len(lengths))
        prob = np.clip(-np.expm1(-evidence), 1e-7, 1 - 1e-7)
        loss = -np.mean(np.where(label > 0, np.log(prob), np.log1p(-prob)))
        d_evidence = np.where(label > 0, -(1 - prob) / prob, 1.0) / len(lengths)
        d_logit = (d_evidence[w[2]] * _sigmoid(logit)).astype(np.float32)
        if len(blocks) == 1:
            g, d_table = self.backward(d_logit, len(words), ids, inside, keep)
        else:
            g, d_table = {k: np.zeros_like(v) for k, v in self.p.items()}, np.zeros((len(words), 2, 3 * HIDDEN), np.float32)
            for b in blocks:
                self.forward(table, ids[b], inside[b], keep := [])
                more, d_more = self.backward(d_logit[b], len(words), ids[b], inside[b], keep)
                d_table += d_more
                for k, v in more.items():
                    g[k] += v
        g["x"] = np.einsum("we,wdg->deg", x, d_table, optimize=True)
        g["xb"] = d_table.sum(axis=0)
        d_x = np.einsum("wdg,deg->we", d_table, self.p["x"], optimize=True)
        np.add.at(g["word"], word, d_x[:, :EMBED])
        np.add.at(g["gram"], bucket, (d_x[:, EMBED:] * share[:, None])[owner])
        return loss, g


def fit(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit with Adam. Without texts of both labels the network answers the share of label 1."""
    label = np.array(labels, np.float64)
    if not len(label) or label.min() == label.max():
        return Network(constant=float(label.mean()) if len(label) else 0.0)
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    # The words of the texts are held as numbers of distinct words; one bytes object for each would be many times that.
    known: dict[bytes, int] = {b"": 0}
    tokens = [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int32) for t in texts]
    seen = np.zeros(len(known), np.int64)
    for t in tokens:
        seen[np.unique(t)] += 1
    vocabulary = list(known)
    del known
    tokens = [np.where(seen[t] >= LEAST_TEXTS, t, 0) for t in tokens]
    steps, an_epoch = 0, -(-len(texts) // DOCS_A_STEP)
    epochs = max(epochs, -(-LEAST_STEPS // an_epoch))
    total = epochs * an_epoch
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), DOCS_A_STEP):
            some, number = order[at : at + DOCS_A_STEP], {}
            flat = np.array([number.setdefault(w, len(number)) for i in some for w in tokens[i].tolist()], np.int64)
            words = [vocabulary[w] for w in number] or [b""]
            _, g = net.step_gradients(words, flat, [len(tokens[i]) for i in some], label[some])
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    clean = [t for t, y in zip(texts, label) if y == 0][:QUIET_TEXTS]
    # A few texts at a time: the letters of all their new words are held at once.
    scorer = _Scorer(net)
    evidence = np.concatenate([scorer.evidence(clean[at : at + DOCS_A_STEP])[0] for at in range(0, len(clean), DOCS_A_STEP)])
    net.quiet = float(evidence.mean())
    return net


def pool(evidence: np.ndarray, owner: np.ndarray, n: int, quiet: float) -> np.ndarray:
    """Score of each text from the evidence of its windows: the strongest window counts in full, the others by
    what they have together beyond QUIET_TIMES the evidence of as many clean windows."""
    counts, total = np.bincount(owner, minlength=n), np.bincount(owner, evidence, n)
    most = np.zeros(n)
    np.maximum.at(most, owner, evidence)
    rest = total - most - QUIET_TIMES * quiet * np.maximum(counts - 1, 0)
    return -np.expm1(-(most + np.maximum(rest, 0)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE,
) -> Network:
    """Fit on at most ``toxic_sample`` + ``clean_sample`` labelled rows, chosen by a hash of their id.

    Null labels and ids are left out; of repeated labels the larger counts; repeated rows count as
    often as they come."""
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
        .filter("id is not null and y is not null")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    present = docs.select(F.col(doc_id).alias("id")).distinct().join(known, "id")
    chosen = None
    for y, most in ((1, toxic_sample), (0, clean_sample)):
        some = present.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("body"))
    sample = rows.join(F.broadcast(chosen), "id").collect()
    sample = sorted((r["id"], bytes(r["body"] or b""), r["y"]) for r in sample)
    return fit([s[1] for s in sample], [s[2] for s in sample])


class _Scorer:
    def __init__(self, net: Network):
        self.net = net
        self.table = WordTable(lambda words: net.project(net.inputs(words)[0]))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        return pool(*self.evidence(texts), len(texts), self.net.quiet)

    def evidence(self, texts: list[bytes], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Minus the log of the probability that a window is clean, for each window, and the window's text."""
        encoded = self.table.encode(texts)
        flat = np.concatenate(encoded) if encoded else np.empty(0, np.int64)
        first, sizes, owner = windows([len(e) for e in encoded])
        rows = self.table.rows if self.table.rows is not None else np.zeros((1, 2, 3 * HIDDEN), np.float32)
        found = np.empty(len(first))
        for at in range(0, len(first), block):
            ids, inside = _grid(flat, first[at : at + block], sizes[at : at + block])
            found[at : at + block] = np.logaddexp(0, self.net.forward(rows, ids, inside))
        return found, owner


def score_toxicity(
    docs: DataFrame, net: Network, *columns: str | Column, text: str = "text", given: str | None = None
) -> DataFrame:
    """The given columns with ``score`` from 0 to 1. Null text counts as empty; an empty text gets the
    answer for an empty window. Repeated rows get the same score, one each. ``given`` names the column
    among the given ones that is the text, so that it need not go twice."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*columns)
    names = kept.columns
    raw = free_name(names)
    state: list[_Scorer] = []

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(_Scorer(held.value))
        scores = state[0](bodies(part, given or raw))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores)], [*names, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = kept if given else docs.select(*columns, F.col(text).cast("binary").alias(raw))
    return map_texts(rows, score, f"{fields}score double", column=given or raw)
