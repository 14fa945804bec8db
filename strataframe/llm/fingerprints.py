"""Homomorphic multiset fingerprints of documents [DataFrame functions only].

A paragraph (a line with at least one word) hashes to a wide vector: EXACT lanes from seeded 64-bit hashes of the whole
paragraph, and SKETCH lanes that hold, for each of its three-word shingles, the bits of the shingle's hash. A document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo 2**32. Sums commute, so equal multisets of
paragraphs have equal fingerprints in any order, and ``combine`` adds or takes away parts without the rest of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, one_per_id, settle, successors

SEEDS = 4  # of the exact part; each gives two lanes of 32 bits
SHIFTS = 32  # of the sketch; each gives two lanes
LANES = 2 * SEEDS + 1 + 2 * SHIFTS
PAIR, HALF = (1 << 32) + 1, (1 << 32) - 1


def _and(a, b) -> Column:
    return a.bitwiseAND(F.lit(b).cast("bigint"))


def vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, lanes``: an array of LANES numbers modulo 2**32 for each row of ``texts``; keys must be unique. Null and
    empty texts have the zero vector. Every text is read whole; a row's partial sums meet, never its words."""
    lines = texts.select(*keys, F.explode_outer(F.filter(F.split(F.col(text), "\n"), lambda p: F.length(F.translate(p, " \t\r\x0b\x0c", "")) > 0)).alias("_p"))
    parts = lines.select(*keys, *[F.xxhash64(F.lit(k), "_p").alias(f"_x{k}") for k in range(SEEDS)], "_p", F.array_remove(F.split("_p", WHITE), "").alias("_w"))
    shingles = F.when(F.col("_p").isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, F.lit(3)))))
    rows = parts.select(*keys, *[f"_x{k}" for k in range(SEEDS)], F.posexplode_outer(shingles).alias("_i", "_h"))
    once = lambda c: F.when(F.col("_i") == 0, c)  # noqa: E731 - a paragraph's own hash counts once, not for each shingle
    sums = [F.sum(once(_and(F.col(f"_x{k}"), HALF))) for k in range(SEEDS)] + [F.sum(once(F.shiftrightunsigned(f"_x{k}", 32))) for k in range(SEEDS)]
    sums = [s.alias(f"_e{k}") for k, s in enumerate(sums)] + [F.count("_h").alias("_c")] + [F.sum(_and(F.shiftrightunsigned("_h", j), PAIR)).alias(f"_s{j}") for j in range(SHIFTS)]
    mod = lambda c: _and(F.coalesce(c, F.lit(0).cast("bigint")), HALF)
    lanes = [mod(F.col(f"_e{k}")) for k in range(2 * SEEDS)] + [mod(F.col("_c"))] + [mod(F.col(f"_s{j}")) for j in range(SHIFTS)] + [mod(F.shiftrightunsigned(f"_s{j}", 32)) for j in range(SHIFTS)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*lanes).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of two parts together, or with ``sign=-1`` of the first without the second."""
    return F.zip_with(a, b, lambda x, y: _and(x + sign * y + (HALF + 1), HALF))


def as_hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _sketch(lanes: Column) -> Column:
    """Each sketch lane as a centred number: twice the ones less the count, modulo 2**32."""
    n = F.element_at(lanes, 2 * SEEDS + 1)
    return F.transform(F.slice(lanes, 2 * SEEDS + 2, 2 * SHIFTS), lambda x: _centred(2 * x - n))


def _centred(x: Column) -> Column:
    return _and(x + F.lit(1 << 31) + F.lit(1 << 34), HALF) - F.lit(1 << 31)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else one less the estimated squared distance of the shingle counts over the sum of
    their squared lengths, at least 0. The standard error is about 0.1."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    x, y = _sketch(a), _sketch(b)
    apart, both = square(F.zip_with(x, y, lambda p, q: _centred(p - q))), square(x) + square(y)
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), 1 - apart / both)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document and of its text after an edit, and how alike they look.

    Nulls: a null text counts as empty; rows without doc_id are no documents; of rows that share a doc_id the one with
    the least text stays. Other columns are ignored, whatever their names. An empty table gives an empty result; the
    only document of a table is its own next one."""
    own = one_per_id(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    link = successors(own.select("doc_id"), "doc_id").join(own.select("doc_id", F.length("text").cast("long").alias("n_chars")), "doc_id")
    asks = link.select(F.col("next"), F.col("doc_id").alias("_to"), F.expr("cast(n_chars div 2 as int)").alias("_half"))
    heads = own.join(asks, own["doc_id"] == asks["next"]).select(F.col("_to").alias("doc_id"), "next", "_half", F.expr("substring(text, 1, _half)").alias("_head"))
    both = own.join(heads, "doc_id").select("doc_id", "next", "text", F.expr("concat(substring(text, 1, length(text) - _half), _head)").alias("_edited"))
    rows = both.select("doc_id", "next", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))).alias("_x"))
    rows = rows.select("doc_id", "next", "n_chars", "edited_sha256", F.col("_x.v").alias("_v"), F.col("_x.t").alias("_t"))
    prints = vectors(rows, ["doc_id", "next", "n_chars", "edited_sha256", "_v"], "_t")
    # Each fingerprint is computed once: as half as wide numbers they are written to the shared folder.
    small = lambda v: F.max(F.when(F.col("_v") == v, F.transform("lanes", lambda x: _centred(x).cast("int"))))
    told = settle(prints.groupBy("doc_id", "next", "n_chars", "edited_sha256").agg(small(0).alias("own"), small(1).alias("edited")), "prints")
    wide = told.withColumns({c: F.transform(c, lambda x: _and(x.cast("bigint"), HALF)) for c in ("own", "edited")})
    after = wide.select(F.col("doc_id").alias("next"), F.col("own").alias("_after"))
    out = wide.join(after, "next")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("_after")).alias("near_next"))


def total(lanes: list[Column]) -> Column:
    """The fingerprint of many parts together."""
    return reduce(combine, lanes)
