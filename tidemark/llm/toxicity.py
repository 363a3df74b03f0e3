"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its words (runs of letters, lower case) and their first four and five letters,
hashed to 31 bits; a text is the set of its terms. The machine adds to the bias and the weights of a text's
terms the inner products of the factors of every pair of them, so that it learns pairs, such as an insult
beside a mention of a group, that additive weights miss.

A term may enter for its weight or for its factors. Of all terms in `min_docs` texts of the sample, those
enter whose own frequency tells the labels apart (`min_z`), and those in `pair_share` of the texts whose pairs
do: the gradient of the loss by all factors that a term meets, seen through random signs of its partners, is larger
than chance has it (`min_pair`). Whether the terms of pairs are kept is settled by the loss on a fifth of the
sample that a first training leaves out: without true pairs they fit noise.

Learning takes a sample bounded by `per_class` labelled ids of each label; the scores are then moved to
the share of the labels in all labelled rows. The driver sees the counts and terms of the sample, no more.

Defined cases: null and empty texts have no terms and get the score of the bias. With labels of one kind
only, or none, every score is that share (0.0 without labels). Null labels teach nothing; an id labelled
several times counts so often for the shares, and each label once in the sample; of several texts with one id the
one with the smallest hash teaches. Repeated rows and null ids are scored like any others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc_mod, mixed, staged

BITS = 31
PROBES = 32  # random signs of a term
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


class Terms(dict):
    """word -> its term buckets, remembered for up to `limit` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        forms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
        found = self[word] = tuple(xxhash.xxh3_64_intdigest(f.encode()) >> (64 - BITS) for f in forms)
        return found


def term_sets(texts: list[str | None], terms: Terms) -> list[set[int]]:
    return [set().union(*map(terms.__getitem__, set(LETTERS.findall(t.lower())))) if t else set() for t in texts]


@dataclass
class Model:
    inputs: np.ndarray  # buckets, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # inputs x rank

    def margins(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The margin of n texts; text owner[i] has input feature[i], owners rising."""
        return margins(self.bias, self.weights, self.factors, owner, feature, n)[0]


def margins(bias, weights, factors, owner, feature, n):
    out = np.full(n, bias)
    sums = np.zeros((n, factors.shape[1]))
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[first]
        f = factors[feature]
        sums[who] = np.add.reduceat(f, first, axis=0)
        out[who] += np.add.reduceat(weights[feature], first) + 0.5 * ((sums[who] ** 2).sum(1) - np.add.reduceat((f * f).sum(1), first))
    return out, sums


def rows_of(sizes: np.ndarray, feature: np.ndarray, rows: np.ndarray):
    """owner (numbered anew) and feature of some rows; row i has sizes[i] of the features, one row after the other."""
    n = sizes[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, feature[np.repeat((np.cumsum(sizes) - sizes)[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def train(owner, feature, y, width: int, rank: int = 4, steps: int = 150, rate: float = 0.05, decay: float = 1e-3, batch: int = 4096) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, both labels weighing the same, by Adam; a step sees `batch` rows, all in turn. Deterministic."""
    rng = np.random.default_rng(5)
    w = [np.zeros(1), np.zeros(width), rng.normal(0, 0.05, (width, rank))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    sizes, decay, waiting = np.bincount(owner, minlength=len(y)), decay / max(1, width), np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        rows = np.arange(len(y))
        if len(y) > batch:
            if len(waiting) < batch:
                waiting = rng.permutation(len(y))
            rows, waiting = waiting[:batch], waiting[batch:]
        own, f = rows_of(sizes, feature, rows)
        margin, sums = margins(w[0][0], w[1], w[2], own, f, len(rows))
        g = weight[rows] * (len(y) / len(rows)) * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows])
        per = g[own]
        slope = np.stack([np.bincount(f, weights=per * (sums[own, j] - w[2][f, j]), minlength=width) for j in range(rank)], axis=1)
        grads = [np.array([g.sum()]), np.bincount(f, weights=per, minlength=width) + decay * w[1], slope + decay * w[2]]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return float(w[0][0]), w[1], w[2]


def pair_scores(sizes: np.ndarray, feature: np.ndarray, y: np.ndarray, width: int, chunk: int = 1000) -> np.ndarray:
    """By how many deviations the pairs of each input move the loss more than chance: text i has sizes[i] of the
    features, texts one after the other. For random signs u of the inputs, sum(g * x_a * sum(u_b * x_b)) over the
    texts holds the gradients of all pairs of a; its square, over PROBES signs, is compared with its expectation."""
    g = np.where(y == 1, -0.25 / max(1, (y == 1).sum()), 0.25 / max(1, (y == 0).sum()))
    signs = ((mixed(np.arange(width, dtype=np.uint64), 41)[:, None] >> np.arange(PROBES, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1
    start, total, expected = np.cumsum(sizes) - sizes, np.zeros((PROBES, width)), np.zeros(width)
    for a in range(0, len(sizes), chunk):
        n = len(sizes[a : a + chunk])
        f = feature[start[a] : start[a] + sizes[a : a + chunk].sum()]
        owner = np.repeat(np.arange(n), sizes[a : a + chunk])
        per = g[a : a + chunk][owner]
        expected += np.bincount(f, weights=per * per * (sizes[a : a + chunk] - 1)[owner], minlength=width)
        for j in range(PROBES):
            u = signs[f, j]
            total[j] += np.bincount(f, weights=per * (np.bincount(owner, weights=u, minlength=n)[owner] - u), minlength=width)
    return ((total**2).sum(0) / np.maximum(expected, 1e-300) - PROBES) / np.sqrt(2 * PROBES)


def loss(margin: np.ndarray, y: np.ndarray) -> float:
    """Logistic loss, both labels weighing the same."""
    each = np.logaddexp(0, np.where(y == 1, -margin, margin))
    return float(sum(each[y == v].mean() for v in (0, 1) if (y == v).any()))


def fit(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", label="toxic", per_class: int = 10_000, min_docs: int = 5, min_z: float = 4.0, pair_class: int = 2000, pair_share: float = 0.005, min_pair: float = 10.0, rank: int = 4) -> Model:
    empty = lambda share: Model(np.array([], np.int64), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, rank)))
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = staged(known.groupBy("_id", "_y").agg(F.count("*").alias("_n")))
    counts = {r["_y"]: (r["n"], r["ids"]) for r in known.groupBy("_y").agg(F.sum("_n").alias("n"), F.count("*").alias("ids")).collect()}
    total = sum(n for n, _ in counts.values())
    if len(counts) < 2:
        return empty(counts.get(1, (0, 0))[0] / max(1, total))
    odds = float(np.log(counts[1][0] / counts[0][0]))
    rate = F.when(F.col("_y") == 1, min(1.0, per_class / counts[1][1])).otherwise(min(1.0, per_class / counts[0][1]))
    drawn = staged(known.where(F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1 << 20)) < rate * (1 << 20)).select("_id", "_y"))
    few = drawn.count() <= 4 * per_class + 1000  # two numbers a row, about 2 * per_class rows
    joined = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn) if few else drawn, "_id").withColumn("_h", F.xxhash64("_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in bounded(batches, "_text", 4 << 20):
            found = term_sets(batch.column("_text").to_pylist(), terms)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_y", "_h")), pa.array([sorted(s) for s in found], pa.list_(pa.int32()))], names=["id", "y", "h", "terms"])

    kind = joined.schema["_id"].dataType.simpleString()
    each = joined.select("_id", "_y", "_h", "_text").mapInArrow(features, f"id {kind}, y int, h long, terms array<int>")
    sample = staged(each.groupBy("id", "y").agg(F.min_by("terms", "h").alias("terms")))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return empty(counts[1][0] / total)
    df = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    p, q, mean = F.col("a") / n1, (F.col("n") - F.col("a")) / n0, F.col("n") / (n1 + n0)
    z = F.abs(p - q) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-12)
    found = df.select("term", (z >= min_z).alias("apart"), (F.col("n") >= pair_share * (n1 + n0)).alias("often")).where("apart or often").orderBy("term").toArrow()
    terms, apart, often = found["term"].to_numpy(), found["apart"].to_numpy(), found["often"].to_numpy()

    def fetched(rows: DataFrame, inputs: np.ndarray):
        """The sample's rows in order of id and label: how many of the inputs each has, which, and the labels."""

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                here = [np.flatnonzero(np.isin(inputs, x, assume_unique=True)).astype(np.int32) for x in batch.column("terms").to_pylist()]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in here])], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(here)))], names=["id", "y", "inputs"])

        got = rows.mapInArrow(kept, f"id {kind}, y int, inputs array<int>").orderBy("id", "y").toArrow().combine_chunks()
        lists = got["inputs"].combine_chunks() if isinstance(got["inputs"], pa.ChunkedArray) else got["inputs"]
        return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().astype(np.int64), got["y"].to_numpy()

    # Pairs are judged on about pair_class rows of each label.
    part = F.when(F.col("y") == 1, min(1.0, pair_class / n1)).otherwise(min(1.0, pair_class / n0))
    sizes, feature, y = fetched(sample.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < part * (1 << 20)), terms[often])
    pairs = np.zeros(len(terms), bool)
    pairs[often] = pair_scores(sizes, feature, y, int(often.sum())) >= min_pair
    terms, apart = terms[apart | pairs], apart[apart | pairs]
    sizes, feature, y = fetched(sample, terms)

    def trained(support: np.ndarray, rows: np.ndarray):
        """The machine over these inputs (a mask), learned from these rows."""
        owner, f = rows_of(sizes, feature, rows)
        keep = support[f]
        return train(owner[keep], (np.cumsum(support) - 1)[f[keep]], y[rows], int(support.sum()), rank)

    def left_out(support: np.ndarray, learn: np.ndarray, rest: np.ndarray) -> float:
        """The loss on rows that training left out."""
        machine, found = trained(support, learn), []
        for a in range(0, len(rest), 2000):
            owner, f = rows_of(sizes, feature, rest[a : a + 2000])
            keep = support[f]
            found.append(margins(*machine, owner[keep], (np.cumsum(support) - 1)[f[keep]], len(rest[a : a + 2000]))[0])
        return loss(np.concatenate(found), y[rest])

    fold = mixed(np.arange(len(y), dtype=np.uint64), 43) % np.uint64(5) == 0
    learn, rest, support = np.flatnonzero(~fold), np.flatnonzero(fold), apart
    if not apart.all() and len(set(y[learn])) == len(set(y[rest])) == 2:
        both = np.ones(len(terms), bool)
        support = both if left_out(both, learn, rest) < left_out(apart, learn, rest) else apart
    if not support.any():
        return empty(counts[1][0] / total)
    bias, weights, factors = trained(support, np.arange(len(y)))
    return Model(terms[support].astype(np.int64), bias + odds, weights, factors)


def score(docs: DataFrame, model: Model, *, text="text", keep=("doc_id",)) -> DataFrame:
    """keep, score and predicted for every text; no shuffle."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(b): i for i, b in enumerate(model.inputs)}
        known = KnownTerms(place)
        for batch in bounded(batches, "_text", 8 << 20):
            rows = [sorted(set().union(*map(known.__getitem__, LETTERS.findall(t.lower())))) if t else [] for t in batch.column("_text").to_pylist()]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            feature = np.fromiter((i for r in rows for i in r), np.int64, len(owner))
            s = 1 / (1 + np.exp(-np.clip(model.margins(owner, feature, len(rows)), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, schema)


class KnownTerms(Terms):
    """word -> the model's inputs among its terms (mostly none, kept as one shared empty tuple)."""

    def __init__(self, place: dict[int, int]):
        super().__init__(400_000)
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = super().__missing__(word)
        known = self[word] = tuple(self.place[b] for b in found if b in self.place)
        return known


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: learn where crc32(doc_id) mod 5 is not 0, score every text."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
