"""N-gram Jaccard join with set-relation skipping.

A document is the set of its word shingles. Equal sets are one set from the start. A set with too many shingles that no
other set has can have no link and leaves. The others are ordered rarest shingle first, and the first ones of each, so
many that two linked sets must share one, make the index: a list for each shingle, divided into blocks by set size.

Skipping in the index: a set meets the blocks of its own size and the next ones only, and in them only sets for
which the positions of the shared shingle leave room for a link. Skipping by answers: the sets of a block are compared
with its first set alone. What that links is one class, and linked sets need no answers of their own: only pairs of sets
from different classes of a touching cluster are compared later, in bounded cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan
from .bloom import semi_join
from .common import forget, one_per_id, read, settle
from .components import components


SHINGLE, PERCENT = 5, 80
#: Sets without partners are told apart on a share of the shingles (by hash) before the rest is counted: so many times
#: the share that a set with a partner may have to itself.
TRIED = 1.5
CELL_ROWS, CELL_COLS = 128, 256


def shingles(column: pa.Array, n: int, fold: bool = True):
    """For each row of a string column its distinct shingles' hashes, sorted; none without words."""
    for at, part in wordscan.pieces(column):
        s = wordscan.scan(part, fold=fold)
        bounds = s.bounds()
        h, _ = wordscan.windows(s.hash, s.row, n)
        for i in range(len(part)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= n:
                yield at + i, np.unique(h[lo : hi - n + 1])
            elif hi > lo:
                yield at + i, wordscan.windows(s.hash[lo:hi], s.row[lo:hi], int(hi - lo))[0]
            else:
                yield at + i, np.zeros(0, np.uint64)


def _parts(batches, *names: str):
    """The named columns and the texts of a few megabytes at a time."""
    for b in batches:
        for at, part in wordscan.pieces(b["text"]):
            yield [b[c].slice(at, len(part)) for c in names], part


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int64), wordscan.as_long(flat)).cast(pa.list_(pa.int64()))


def _outline(n: int, tried: float):
    """Size and 128-bit hash of each set, and its shingles of the least hashes."""
    top = np.uint64(int(tried * 2**64))

    def run(batches):
        for names, part in _parts(batches, "doc_id"):
            out = ([], [], [], [])
            for _, t in shingles(part, n):
                for col, v in zip(out, (len(t), int(wordscan.mix(t ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)), int(wordscan.mix(t ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)), t[: np.searchsorted(t, top)]), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*names, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), _lists(out[3])], ["doc_id", "n", "s1", "s2", "some"])

    return run


def _whole(n: int):
    def run(batches):
        for names, part in _parts(batches, "doc_id", "n"):
            yield pa.RecordBatch.from_arrays([*names, _lists([t for _, t in shingles(part, n)])], ["doc_id", "n", "t"])

    return run


def _prefixes(percent: int):
    """From the shared shingles of a set, rarest first, those within its prefix, with their positions."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for doc, n, shared in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["shared"], strict=True):
                alone = n - len(shared)
                last = n - (percent * n + 99) // 100 + 1
                if alone < last:
                    df, t = (np.asarray(shared.values.field(i)) for i in (0, 1))
                    order = np.lexsort((t, df))[: last - alone]
                    for col, v in zip(out, (t[order], np.full(len(order), doc), np.full(len(order), n), np.arange(alone, alone + len(order))), strict=True):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["t", "doc_id", "n", "pos"])

    return run


def links(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _cell(percent: int):
    """Links between the sets of two blocks whose classes differ: for each set of the first, one for each other class."""

    def run(table):
        row = table["row"].to_numpy(zero_copy_only=False).astype(bool)
        doc, comp, n = (table[c].to_numpy() for c in ("doc_id", "comp", "n"))
        t = table["t"].combine_chunks()
        ends = np.r_[0, np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))]
        _, code = np.unique(t.flatten().to_numpy(), return_inverse=True)
        rows, cols = np.flatnonzero(row), np.flatnonzero(~row)
        has = np.zeros((int(code.max(initial=0)) + 1, len(rows)), np.uint8)
        for k, i in enumerate(rows):
            has[code[ends[i] : ends[i + 1]], k] = 1
        found = ([], [])
        for j in cols:
            fit = (comp[rows] != comp[j]) & (100 * np.minimum(n[rows], n[j]) >= percent * np.maximum(n[rows], n[j]))
            if fit.any():
                common = has[code[ends[j] : ends[j + 1]]].sum(0, dtype=np.int64)
                hit = rows[fit & links(common, n[rows], n[j], percent)]
                _, one = np.unique(comp[hit], return_index=True)
                found[0].extend(doc[hit[one]])
                found[1].extend([doc[j]] * len(one))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that link."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("_na"), F.col("t").alias("_ta")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("_nb"), F.col("t").alias("_tb")), "b")
    return both.withColumn("_o", F.size(F.array_intersect("_ta", "_tb"))).filter(links(F.col("_o"), F.col("_na"), F.col("_nb"), percent)).select("a", "b")


def cells(clusters: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different classes in each cluster of more than one class. Sets outside a cluster's largest
    class meet all others in cells of about CELL_ROWS by CELL_COLS sets."""
    member = settle(clusters.join(classes, "doc_id", "left").select("cluster", "doc_id", F.coalesce("comp", "doc_id").alias("comp")), "members")
    count = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    plan = count.groupBy("cluster").agg(F.sum("k").alias("g"), F.max("k").alias("most"), F.max_by("comp", "k").alias("main")).filter("g > most")
    plan = settle(plan.select("cluster", "main", F.ceil((F.col("g") - F.col("most")) / CELL_ROWS).alias("nr"), F.ceil(F.col("g") / CELL_COLS).alias("nc")), "plan")
    open_ = member.join(plan, "cluster").withColumn("_h", F.xxhash64("doc_id"))
    cols = open_.select("cluster", "doc_id", "comp", F.lit(False).alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nr") - 1)).alias("r"), F.pmod("_h", "nc").alias("c"))
    rows = open_.filter("comp <> main").select("cluster", "doc_id", "comp", F.lit(True).alias("row"), F.pmod("_h", "nr").alias("r"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nc") - 1)).alias("c"))
    full = cols.unionByName(rows).join(sets, "doc_id")
    return full.groupBy("cluster", "r", "c").applyInArrow(_cell(percent), "a long, b long")


def similar_classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, tried: float = TRIED) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose sets of ``n``-word shingles (A-Z lower-cased) reach
    ``percent`` of intersection over union are linked; a component has the least doc_id of those reachable.

    A null or empty text has an empty set and is linked with nothing. A text of fewer than ``n`` words is one shingle.
    Rows without doc_id are no documents; of rows that share one the least text stays. Other columns are ignored. An
    empty table gives an empty result. Shingles are 64-bit hashes; sets are equal if 128 bits of them are."""
    own = one_per_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    share = min(0.999, tried * (100 - percent) / 100)
    outline = settle(own.select("doc_id", "text").mapInArrow(_outline(n, share), "doc_id long, n long, s1 long, s2 long, some array<long>"), "outline")

    # One set for equal ones; sets with too many shingles of their own leave.
    equal = ["n", "s1", "s2"]
    one = settle(outline.filter("n > 0").groupBy(*equal).agg(F.min("doc_id").alias("rep")), "sets")
    owner = outline.select("s1", F.explode("some").alias("t")).groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("_m")).filter("s1 = _m").groupBy("s1").agg(F.count(F.lit(1)).alias("_alone"))
    alive = one.join(owner, "s1", "left").filter(f"100 * (n - coalesce(_alone, 0)) >= {percent} * n").select(F.col("rep").alias("doc_id"), "n")
    alive = settle(alive, "alive")
    sets = settle(semi_join(own, alive, "doc_id").join(alive, "doc_id").select("doc_id", "n", "text").mapInArrow(_whole(n), "doc_id long, n long, t array<long>"), "shingles")

    # The index: prefixes, rarest first, in blocks by shingle and size.
    each = sets.select("doc_id", "n", F.explode("t").alias("t"))
    df = settle(each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "df")
    shared = each.join(df, "t").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "t")).alias("shared"))
    index = shared.mapInArrow(_prefixes(percent), "t long, doc_id long, n long, pos long")
    index = settle(index.withColumn("size", F.floor(F.log("n") / np.log(100 / percent))), "index")

    # Each block's first set against the others; blocks of the next size through their first sets.
    first = index.groupBy("t", "size").agg(F.min("doc_id").alias("head"))
    heads = index.join(first, ["t", "size"]).filter("doc_id = head").select("t", "size", "head", F.col("n").alias("hn"), F.col("pos").alias("hpos"))
    heads = settle(heads, "heads")
    after = heads.select("t", (F.col("size") + 1).alias("size"), "head", "hn", "hpos")
    meet = index.join(heads.unionByName(after), ["t", "size"]).filter("doc_id <> head")
    touch = settle(meet.select("doc_id", "head", "n", "hn", "pos", "hpos"), "touch")
    room = F.least("pos", "hpos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("hn") - F.col("hpos")) - 1
    likely = touch.filter((100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")) & links(room, F.col("n"), F.col("hn"), percent))
    pairs = settle(likely.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct(), "pairs")
    star = settle(verified(pairs, sets, percent), "star")
    classes = settle(components(star).select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "classes")
    clusters = components(touch.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    more = settle(cells(clusters, classes, sets, percent), "more")

    final = components(star.unionByName(more)).select(F.col("node").alias("rep"), "component")
    whole = one.join(final, "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component"))
    out = outline.select("doc_id", *equal).join(whole, equal, "left")
    forget(df, index)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read(spark, sf_dir, "documents"), n=4, percent=85)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 4 THEN range(1, len(w) - 2) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
r AS (SELECT doc_id, doc_id AS at FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.at) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
