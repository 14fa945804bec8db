"""Bounds of the quality classifier and likenesses of fingerprints against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strataframe.llm import fingerprints, quality


def drawn(x, n, mean):
    return (x + quality.PRIOR_WORDS * mean) / (n + quality.PRIOR_WORDS)


def test_bounds_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = []
    for lang, k, mean in (("en", 400, 7.0), ("de", 60, 9.0), ("xx", 3, 5.0), (None, 5, 8.0)):
        for _ in range(k):
            n = int(rng.integers(20, 900))
            rows.append((lang, n, int(n * rng.uniform(0.7, 1.0)), float(n * (mean + rng.normal(0, 0.4)))))
    by, mean, noise, echo = quality.bounds(spark.createDataFrame(rows, "lang string, n_words long, n_fresh long, loss double"))
    assert mean == pytest.approx(sum(r[3] for r in rows) / sum(r[1] for r in rows))
    means = {}
    for lang in ("en", "de", "xx"):
        own = [r for r in rows if r[0] == lang]
        means[lang] = (sum(r[3] for r in own) + quality.LANGUAGE_WORDS * mean) / (sum(r[1] for r in own) + quality.LANGUAGE_WORDS)
    score = {}
    for lang, n, fresh, loss in rows:
        m = means.get(lang, mean)
        score.setdefault(lang, []).append((drawn(loss, n, m) - m, m - drawn(max(loss / n, m) * fresh, n, m)))

    def most(v):
        v = sorted(v)
        at = lambda q: v[max(0, math.ceil(q * len(v)) - 1)]
        mid, edge = at(0.5), at(1 - quality.TAIL)
        over = [x - edge for x in v if x > edge]
        size = (sum(over) + quality.PRIOR_EXCESSES * (edge - mid) / math.log(0.5 / quality.TAIL)) / (len(over) + quality.PRIOR_EXCESSES)
        return edge + size * math.log(quality.TAIL / quality.QUANTILE)

    every = [x for v in score.values() for x in v]
    assert (noise, echo) == (pytest.approx(most([x[0] for x in every])), pytest.approx(most([x[1] for x in every])))
    got = {r["lang"]: r for r in by.collect()}
    assert set(got) == {"en", "de", "xx"}
    for lang, r in got.items():
        k = len(score[lang])
        assert r["mean"] == pytest.approx(means[lang])
        for i, (name, pooled) in enumerate((("most_noise", noise), ("most_echo", echo))):
            own = most([x[i] for x in score[lang]])
            assert r[name] == pytest.approx((k * own + quality.LANGUAGE_DOCS * pooled) / (k + quality.LANGUAGE_DOCS))


def test_no_trusted_text_bounds_nothing(spark):
    assert quality.bounds(spark.createDataFrame([], "lang string, n_words long, n_fresh long, loss double")) is None


def test_repetition_is_rejected(spark, table, prose):
    rng = random.Random(1)
    rows = [(i, prose(rng.randrange(60, 300), i), "en", "s") for i in range(400)] + [(900 + k, " ".join([w] * 80 + [w[::-1]] * 80), "en", "s") for k, w in enumerate(("beka", "lon", "tisun"))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(table(rows), labels).collect()}
    assert sum(got[i] for i in range(400)) >= 398 and not any(got[900 + k] for k in range(3))


def exact_likeness(a: str, b: str) -> float:
    def counts(t):
        c = Counter()
        for line in t.split("\n"):
            w = line.split()
            if w:
                c.update(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))
        return c

    x, y = counts(a), counts(b)
    apart = sum((x[k] - y[k]) ** 2 for k in x.keys() | y.keys())
    both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return max(0.0, 1 - apart / both) if both else float(x == y)


def test_likeness_against_exact(spark, table, prose):
    """Estimates from the sketch lie about the likeness that the shingle counts give."""
    rng = random.Random(2)
    texts = {}
    for i in range(80):
        own = prose(rng.randrange(60, 400), i).split()
        texts[2 * i] = " ".join(own)
        for _ in range(rng.randrange(0, 40)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        texts[2 * i + 1] = " ".join(own)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(table(list(texts.items()))).collect()}
    ids = sorted(texts)
    off = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        off += [got[i]["near_next"] - exact_likeness(texts[i], texts[j]), got[i]["near_edited"] - exact_likeness(texts[i], edited)]
    assert abs(np.mean(off)) < 0.03 and np.mean(np.abs(off)) < 0.08 and np.max(np.abs(off)) < 0.45
