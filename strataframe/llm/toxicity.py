"""Toxicity: a second-order factorization machine over hashed terms.

A document's terms are its distinct folded words (runs of letters and digits) and the first four, five and six bytes of each.
A term hashes to one of 2**BITS features. Besides a weight, every feature has a factor vector, and the inner product of
two features' vectors is the weight of their meeting in one document. The model is fitted on the driver to a bounded
sample of labelled rows (``fit_rows``, half of each label) and has a fixed size, so scoring ships it with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan
from .common import one_per_id, read


BITS, FACTORS = 18, 4
FIT_ROWS = 12000
FOLDS = 5
STARTS = (4, 5, 6)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct term of each row, in order."""
    s = wordscan.scan(column, fold=True, apart=wordscan.NOT_TERM)
    data = wordscan.FOLD[s.data]
    made = [s.hash] + [wordscan.spans(data, s.start, np.minimum(s.end, s.start + n)) ^ np.uint64(n) for n in STARTS]
    keys = [(s.row.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h in made]
    both = np.unique(np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


class Machine:
    """bias + sum of weights + half of (square of the summed vectors - sum of their squares)."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray):
        self.bias, self.weight, self.vector = bias, weight, vector

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        out = np.full(rows, self.bias, np.float64)
        at = 0
        while at < len(row):  # whole rows, about a million terms at a time
            to = len(row) if at + (1 << 20) >= len(row) else int(np.searchsorted(row, row[at + (1 << 20)]))
            to = to if to > at else int(np.searchsorted(row, row[at], side="right"))
            r, f = row[at:to], feature[at:to]
            edges = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            v = self.vector[f]
            total, squares = np.add.reduceat(v, edges), np.add.reduceat(v * v, edges)
            out[r[edges]] += np.add.reduceat(self.weight[f], edges) + 0.5 * (total * total - squares).sum(1)
            at = to
        return out


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, prior: float, rounds: int = 20, batch: int = 256, seed: int = 7, least_z: float = 4.0) -> Machine:
    """AdaGrad on the logistic loss with a small quadratic penalty. ``prior``: share of label 1 among all labelled rows,
    to which the balanced sample's bias is set back."""
    size, n = 1 << BITS, len(label)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32))
    if not n or label.min() == label.max():
        m.vector[:] = 0
        m.bias = -20.0 if not n or not label.max() else 20.0
        return m
    # Of features seen in three documents those that are rarer or more frequent than chance among label 1; neutral words
    # would only add noise. A word that matters in company alone is also more frequent where the company is.
    df, hit = np.bincount(feature, minlength=size), np.bincount(feature, label[row], size)
    share = label.mean()
    seen = (df >= 3) & (np.abs(hit - df * share) > least_z * np.sqrt(df * share * (1 - share)))
    keep = seen[feature]
    row, feature = row[keep], feature[keep]
    m.vector[~seen] = 0
    edges = np.searchsorted(row, np.arange(n + 1))
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = order[lo : lo + batch]
            f = np.concatenate([feature[edges[i] : edges[i + 1]] for i in pick])
            size_of = edges[pick + 1] - edges[pick]
            own = np.repeat(np.arange(len(pick)), size_of)
            v = m.vector[f]
            total = np.zeros((len(pick), FACTORS), np.float32)
            np.add.at(total, own, v)
            pair = 0.5 * ((total**2).sum(1) - np.bincount(own, (v * v).sum(1), len(pick)))
            z = m.bias + np.bincount(own, m.weight[f], len(pick)) + pair
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)).astype(np.float32)
            m.bias -= 0.1 * d.sum() / np.sqrt(gb := gb + d.sum() ** 2)
            uniq, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, d[own], len(uniq)).astype(np.float32) + 2e-6 * m.weight[uniq]
            gw[uniq] += dw * dw
            m.weight[uniq] -= 0.1 * dw / np.sqrt(gw[uniq])
            dv = np.zeros((len(uniq), FACTORS), np.float32)
            np.add.at(dv, place, d[own, None] * (total[own] - v))
            dv += 2e-5 * m.vector[uniq]
            gv[uniq] += dv * dv
            m.vector[uniq] -= 0.02 * dv / np.sqrt(gv[uniq])
    m.bias += float(np.log(prior / (1 - prior)) - np.log(label.mean() / (1 - label.mean())))
    return m


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on labelled rows outside the held-out fold: at most ``fit_rows / 2`` of each label, least hash of doc_id first."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    share = dict(marked.groupBy("toxic").count().collect())  # two rows
    least = [marked.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for v in (0, 1)]
    sample = F.broadcast(least[0].unionByName(least[1]))  # at most fit_rows rows
    got = one_per_id(docs, "doc_id", "text").join(sample, "doc_id").select(F.col("doc_id").alias("_d"), "toxic", "text").mapInArrow(_terms, "_d long, toxic int, terms array<int>").toArrow().sort_by("_d")  # so many rows at most
    terms = got["terms"].combine_chunks()
    feature = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    return fit(row, feature, got["toxic"].to_numpy().astype(np.float32), share.get(1, 0) / max(1, sum(share.values())))


def _terms(batches):
    for b in batches:
        for at, part in wordscan.pieces(b["text"]):
            row, feature = features(part)
            ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["_d"].slice(at, len(part)), b["toxic"].slice(at, len(part)).cast(pa.int32()), pa.ListArray.from_arrays(ends, feature.astype(np.int32))], ["_d", "toxic", "terms"])


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its whole text alone.

    Nulls: a null text scores as an empty one, which gets the model's bias. Rows without doc_id are no documents; of
    rows that share one the least text stays. Other columns are ignored. An empty table gives an empty result."""

    def run(batches):
        for b in batches:
            for at, part in wordscan.pieces(b["text"]):
                row, feature = features(part)
                z = model.margins(row, feature, len(part))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(part)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    own = one_per_id(docs, "doc_id", "text")
    scored = own.select("doc_id", "text").mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
