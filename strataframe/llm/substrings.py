"""Substring de-duplication by level-wise doubling.

Level 10: of the ten-word windows, those that are least among the eleven that some twenty-word window holds are counted;
equal windows of twenty words hold the same least one. Level 20: only windows whose least half-window was seen twice are
extended to twice that length and compared, and the earliest of equal ones is found. ``longer_repeats`` goes on doubling
until no candidates survive.

Which half-windows were seen twice reaches the documents as a Bloom filter with BITS_A_KEY bits for each; what it lets
through too much the next level removes. Too many for one filter are divided by their hash, and the documents are read
once for each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, wordscan
from .common import forget, one_per_id, read, settle


WINDOW = 20
PIECE = 1 << 20  # bytes of text hashed at a time
BITS_A_KEY = 16
#: The largest filter that travels with a function: 2 ** 27 bits, 16 MB, for eight million keys.
MOST_BITS = 27


def halves(s: wordscan.Scan, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of half-windows, for each whole window its least half-window, whether it lies within a row, and which
    half-windows are the least of some window."""
    half = window // 2
    h, _ = wordscan.windows(s.hash, s.row, half)
    n = len(s.hash) - window + 1
    if n <= 0:
        return h, h[:0], np.zeros(0, bool), np.zeros(len(h), bool)
    inside = s.row[window - 1 :] == s.row[:n]
    low = wordscan.least(h, half + 1)[:n]
    pad = np.zeros(half, np.uint64)
    most = wordscan.least(np.r_[pad, np.where(inside, low, 0), pad], half + 1, most=True)[: len(h)]
    return h, low, inside, (most == h) & (most > 0)


def _least_halves(window: int):
    def run(batches):
        for b in batches:
            for _, part in wordscan.pieces(b["text"], PIECE):
                h, _, _, chosen = halves(wordscan.scan(part), window)
                yield pa.RecordBatch.from_arrays([wordscan.as_long(h[chosen])], ["g"])

    return run


class Filter:
    """A Bloom filter of hashes that are ``part`` modulo ``parts``: 2 ** ``bits`` bits, packed; two for each hash."""

    def __init__(self, bits: int, part: int, parts: int):
        self.bits, self.part, self.parts = bits, part, parts
        self.packed = np.zeros(1 << max(bits - 3, 2), np.uint8)

    @staticmethod
    def of(keys: DataFrame, n: int, part: int = 0, parts: int = 1) -> Filter:
        """The filter of column g of ``keys``, of which ``n`` are expected; made by the executors, word by word."""
        out = Filter(min(MOST_BITS, max(10, (n * BITS_A_KEY).bit_length())), part, parts)
        own = keys.filter(F.pmod("g", F.lit(parts)) == part) if parts > 1 else keys
        bits = [F.shiftrightunsigned("g", 64 - out.bits), F.shiftrightunsigned("g", 8).bitwiseAND(F.lit((1 << out.bits) - 1))]
        each = own.select(F.explode(F.array(*bits)).alias("b"))
        rows = each.groupBy(F.expr("b div 32").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("v")).toArrow()  # at most 2 ** (MOST_BITS - 5) rows
        words = np.zeros(1 << (out.bits - 5), np.uint32)
        words[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint32)
        out.packed = words.view(np.uint8)
        return out

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        a = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        b = ((h >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        hit = ((self.packed[a >> 3] >> (a & 7).astype(np.uint8)) & (self.packed[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
        return hit & (h.view(np.int64) % self.parts == self.part) if self.parts > 1 else hit


def _candidates(window: int, seen: Filter):
    def run(batches):
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for at, part in wordscan.pieces(b["text"], PIECE):
                s = wordscan.scan(part)
                h, low, inside, _ = halves(s, window)
                at_word = np.flatnonzero(inside)
                at_word = at_word[seen.may_hold(low[at_word])]
                if len(at_word):
                    row = s.row[at_word]
                    twice = wordscan.joined(h[at_word], h[at_word + window // 2])
                    yield pa.RecordBatch.from_arrays([wordscan.as_long(twice), pa.array(ids[at + row].astype(np.int64)), pa.array((at_word - s.bounds()[row]).astype(np.int32))], ["h", "doc_id", "p"])

    return run


def repeated(own: DataFrame, window: int = WINDOW, firsts: bool = False) -> DataFrame:
    """``doc_id, p``: every window of ``window`` words (an even number) whose sequence also starts earlier. With
    ``firsts`` the earliest of equal windows too, and ``later`` tells them apart."""
    text = own.select("text")
    g = text.mapInArrow(_least_halves(window), "g long")
    twice = settle(g.groupBy("g").count().filter("count > 1").select("g"), "halves")
    n = twice.count()
    parts = max(1, -(-n * BITS_A_KEY >> MOST_BITS))
    spots = None
    for k in range(parts):
        seen = Filter.of(twice, n // parts, k, parts)
        some = settle(own.select("doc_id", "text").mapInArrow(_candidates(window, seen), "h long, doc_id long, p int"), "windows")
        spots = some if spots is None else spots.unionByName(some)
    forget(twice)
    # A window's place, in order: one number if document and position fit in 63 bits, else both.
    lo, hi, most = spots.agg(F.min("doc_id"), F.max("doc_id"), F.max("p")).first()
    bits = int(most or 0).bit_length()
    place = F.shiftleft(F.col("doc_id") - F.lit(lo or 0), bits) + F.col("p") if lo is None or int(hi - lo).bit_length() + bits < 63 else F.struct("doc_id", "p")
    first = spots.select("h", place.alias("_at")).groupBy("h").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("h", "_first")
    first = settle(first, "firsts")
    both = spots.select("h", "doc_id", "p", place.alias("_at")).join(first, "h")
    return both.select("doc_id", "p", F.expr("_at > _first").alias("later")) if firsts else both.filter("_at > _first").select("doc_id", "p")


def longer_repeats(own: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, p, n_words``: repeated windows of ``window`` words, doubled until no candidates survive. Windows of twice
    the length can only be equal in documents that hold a repeated window, be it the first or a later one. Each start
    of a later one is given with its greatest level."""
    near, found = own, None
    while True:
        level = settle(repeated(near, window, firsts=True), "level")
        if level.isEmpty():
            break
        later = level.filter("later").select("doc_id", "p", F.lit(window).cast("long").alias("n_words"))
        found = later if found is None else found.unionByName(later)
        near = own.join(level.select("doc_id").distinct(), "doc_id", "left_semi")
        window *= 2
    empty = own.sparkSession.createDataFrame([], "doc_id long, p int, n_words long")
    return (found or empty).groupBy("doc_id", "p").agg(F.max("n_words").alias("n_words"))


def _cut(window: int):
    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for doc, text, at in zip(b["doc_id"].to_pylist(), b["text"], b["at"], strict=True):
                kept = (text.as_py() or "").encode().split()
                n = len(kept)
                if at.is_valid and len(at):
                    p = np.asarray(at.values, np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    kept = [kept[i] for i in np.flatnonzero(~covered)]
                for col, v in zip(out, (doc, n, n - len(kept), b" ".join(kept)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array([x.decode() for x in out[3]], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each document without the words that a window which starts earlier covers.

    Nulls: a null text has no words. Rows without doc_id are no documents; of rows that share one the least text stays.
    Texts of fewer than ``window`` words are kept. Repeated texts are emptied but for the first. Other columns are
    ignored. An empty table gives an empty result. Words are compared by 64-bit hashes of the windows."""
    own = one_per_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    at = settle(repeated(own, window).groupBy("doc_id").agg(F.collect_list("p").alias("at")), "places")
    # Only texts that may lose words are moved to their places; the others are read where they are.
    marked = bloom.sifted(own, at, "doc_id")
    moved = marked.filter("_maybe").join(at, "doc_id", "left").select("doc_id", "text", "at")
    rest = marked.filter("not _maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"))
    return moved.unionByName(rest).mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d),
x AS (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(array_to_string(w[p:p + 19], ' ')) ORDER BY doc_id, p) AS k FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM x WHERE k > 1),
a AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
        CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN a ON d.doc_id = a.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""
