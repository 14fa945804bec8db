"""Quality classifier: an interpolated modified Kneser-Ney bigram model trained on trusted text.

A document's log probability is the sum, over its words, of what backing off gives with the frequent words alone, which
needs only tables of bounded size, and of the gain of each rare word and of each bigram that the trusted text has, which
comes from a join of the documents' rare words and bigrams with the trusted counts, shard by shard. No word that the
trusted text has is left out; the share of a word that it doesn't have comes from the words seen once and twice.

Two scores come of it, both drawn towards the language's mean for short texts: the mean loss a word, which is high for
noise, and the loss that the distinct bigrams alone bring a word, which is low for repetition (text that the model knows
by heart counts there as average). Each is compared with the QUANTILE of trusted documents of the same language that
the model wasn't trained on, estimated from the excesses over the TAIL quantile; languages with few such documents
borrow from all, the more the fewer they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngramlm, wordscan
from .bloom import semi_join
from .common import forget, one_per_id, read, settle


HELD_FOLDS = 2  # one in so many trusted documents sets the bounds
QUANTILE = 1e-4  # the share of a language's trusted documents beyond each bound
TAIL = 0.05  # the share of them whose excesses the bound is estimated from
PRIOR_EXCESSES = 5
PRIOR_WORDS = 50  # words of average loss that each document is given
LANGUAGE_WORDS, LANGUAGE_DOCS = 2000, 20  # by so much a language's mean and bounds are drawn to those of all
SHARD_BYTES = 64 << 20  # of trusted text


def _vocabulary_counts(batches):
    for b in batches:
        for _, part in wordscan.pieces(b["text"], ngramlm.PIECE):
            h, n = np.unique(wordscan.scan(part).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([wordscan.as_long(h), pa.array(n.astype(np.int64))], ["h", "n"])


def _trusted_bigrams(vocabulary, place, shards):
    def run(batches):
        for b in batches:
            for _, part in wordscan.pieces(b["text"], ngramlm.PIECE):
                s = wordscan.scan(part)
                word = ngramlm.ids(s, vocabulary, place)
                before, gram = ngramlm.bigrams(s, word)
                rare = gram >= ngramlm.HASHED
                gram, n = np.unique(gram[~rare], return_counts=True)
                left, right, m = ngramlm.tally(before[rare], word[rare], np.ones(int(rare.sum()), np.int64))
                own, others = ngramlm.shard_of(gram, shards), ngramlm.shard_of(ngramlm.owner(left, right, right), shards)
                for k in np.union1d(own, others):
                    yield pa.RecordBatch.from_pylist([_counted(k, gram[own == k], n[own == k], left[others == k], right[others == k], m[others == k])], COUNTED)

    return run


COUNTS = "shard int, gram binary, n binary, before binary, word binary, m binary"
COUNTED = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("gram", "n", "before", "word", "m")]])


def _counted(shard, gram, n, before, word, m) -> dict:
    """A row of counts: bigrams of frequent words as one number, the others as pairs."""
    small = lambda x: ngramlm.pack(x.astype(np.uint32))
    return {"shard": int(shard), "gram": ngramlm.pack_sorted(gram), "n": small(n), "before": ngramlm.pack_sorted(before), "word": ngramlm.pack(word), "m": small(m)}


def _pairs(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with a rare word of a row of counts."""
    return ngramlm.unpack_sorted(row["before"], np.int64), ngramlm.unpack(row["word"], np.int64), ngramlm.unpack(row["m"], np.uint32).astype(np.int64)


def _merge(table):
    """One shard's counts, summed over batches."""
    rows = table.to_pylist()
    gram = np.concatenate([ngramlm.unpack_sorted(r["gram"], np.int64) for r in rows])
    n = np.concatenate([ngramlm.unpack(r["n"], np.uint32) for r in rows]).astype(np.int64)
    _, gram, n = ngramlm.tally(np.zeros(len(gram), np.int8), gram, n)
    pairs = ngramlm.tally(*[np.concatenate(x) for x in zip(*map(_pairs, rows), strict=True)])
    return pa.Table.from_pylist([_counted(rows[0]["shard"], gram, n, *pairs)], COUNTED)


def _shard_sums(batches):
    """For each small id: tokens after it, its bigrams by count, ids before it; and under id -1 - c how many bigrams have count c."""
    for b in batches:
        for row in b.to_pylist():
            gram, n = ngramlm.unpack_sorted(row["gram"], np.int64), ngramlm.unpack(row["n"], np.uint32).astype(np.int64)
            left, right, m = _pairs(row)
            before, word, n = np.r_[gram // ngramlm.IDS, left], np.r_[gram % ngramlm.IDS, right], np.r_[n, m]
            cc = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            into = np.bincount(word[word < ngramlm.IDS], minlength=ngramlm.IDS)
            small = before < ngramlm.IDS
            before, n = before[small], n[small]
            sums = [np.bincount(before, n, ngramlm.IDS)] + [np.bincount(before[np.minimum(n, 3) == c], minlength=ngramlm.IDS) for c in (1, 2, 3)] + [into]
            some = np.flatnonzero(sums[0] + sums[4])
            ids = np.r_[some, -1 - np.arange(1, 5)]
            cols = [np.r_[x[some], cc if k == 0 else np.zeros(4)].astype(np.int64) for k, x in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *map(pa.array, cols)], ["id", "total", "k1", "k2", "k3", "into"])


def _asked(shards):
    """Rare words after other rare words, to the shards that own them: how many distinct ones come before."""

    def run(batches):
        for b in batches:
            for row in b.select(["shard", "before", "word", "m"]).to_pylist():
                before, word, _ = _pairs(row)
                word, k = np.unique(word[(before >= ngramlm.IDS) & (word >= ngramlm.IDS)], return_counts=True)
                own = ngramlm.shard_of(word, shards)
                for to in np.unique(own):
                    yield pa.RecordBatch.from_arrays([pa.array([int(to)], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([ngramlm.pack_sorted(word[own == to])], pa.binary()), pa.array([ngramlm.pack(k[own == to].astype(np.uint32))], pa.binary())], ["shard", "source", "word", "k"])

    return run


RARE = "shard int, own boolean, words binary, into binary, c1 long, c2 long, c3 long, c4 long, c5 long, total long"
RARES = pa.schema([("shard", pa.int32()), ("own", pa.bool_()), ("words", pa.binary()), ("into", pa.binary()), *[(c, pa.int64()) for c in ("c1", "c2", "c3", "c4", "c5", "total")]])


def _answered(counts, asked):
    """A shard's rare words with the number of distinct words before each, for itself and for the shards that ask."""
    shard = (counts if counts.num_rows else asked)["shard"][0].as_py()
    words, into = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in counts.to_pylist():
        before, word, _ = _pairs(row)
        w, k = np.unique(word[(before < ngramlm.IDS) & (word >= ngramlm.IDS)], return_counts=True)
        words.append(w)
        into.append(k)
    asked = [(r["source"], ngramlm.unpack_sorted(r["word"], np.int64), ngramlm.unpack(r["k"], np.uint32).astype(np.int64)) for r in asked.to_pylist()]
    w = np.concatenate(words + [a[1] for a in asked])
    _, w, k = ngramlm.tally(np.zeros(len(w), np.int8), w, np.concatenate(into + [a[2] for a in asked]))
    row = lambda to, own, w, k: {"shard": to, "own": own, "words": ngramlm.pack_sorted(w), "into": ngramlm.pack(k.astype(np.uint32)), **{f"c{c}": int((np.minimum(k, 5) == c).sum()) for c in range(1, 6)}, "total": int(k.sum())}
    return pa.Table.from_pylist([row(shard, True, w, k)] + [row(to, False, x, k[np.searchsorted(w, x)]) for to, x, _ in asked], RARES)


def counted(trusted: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, DataFrame, DataFrame]:
    """The frequent words' hashes in order and their ids, the bigram counts by shard, and the rare words by shard."""
    words = trusted.select("text").mapInArrow(_vocabulary_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "h").limit(ngramlm.VOCABULARY).toArrow()  # the words with small ids, not all words
    vocabulary = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, place = vocabulary[order], order.astype(np.int64)
    counts = trusted.select("text").mapInArrow(_trusted_bigrams(vocabulary, place, shards), COUNTS)
    counts = settle(counts.groupBy("shard").applyInArrow(_merge, COUNTS), "bigrams")
    asked = counts.mapInArrow(_asked(shards), "shard int, source int, word binary, k binary")
    rare = counts.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_answered, RARE)
    return vocabulary, place, counts, settle(rare, "rare")


def estimated(vocabulary: np.ndarray, place: np.ndarray, counts: DataFrame, rare: DataFrame) -> ngramlm.Model:
    cols = ["total", "k1", "k2", "k3", "into"]
    sums = counts.mapInArrow(_shard_sums, "id long, total long, k1 long, k2 long, k3 long, into long").groupBy("id").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # one row a small id
    at, x = sums["id"].to_numpy(), np.stack([sums[c].to_numpy() for c in cols], 1) if len(sums) else np.zeros((0, 5), np.int64)
    table = np.zeros((ngramlm.IDS, 5), np.int64)
    table[at[at >= 0]] = x[at >= 0]
    of = np.zeros(6, np.int64)
    of[-1 - at[at < 0]] = x[at < 0, 0]
    into = table[:, 4]
    more = rare.filter("own").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("c1", "c2", "c3", "c4", "c5", "total")]).first()
    of_into = np.bincount(np.minimum(into, 5), minlength=6) + np.r_[0, more[:5]]
    # As many words are unknown as Chao's estimate says, from the words seen after one and after two others.
    unknown = max(1.0, float(of_into[1]) ** 2 / (2 * max(of_into[2], 1)))
    return ngramlm.Model(vocabulary, place, table[:, 0], table[:, 1:4], into, of, of_into, int(into.sum()) + more[5], int(of_into[1:].sum()) + unknown)


def train(trusted: DataFrame, shards: int) -> tuple[ngramlm.Model, DataFrame]:
    """The bounded part of the model and the table of trusted bigram counts by shard."""
    vocabulary, place, counts, rare = counted(trusted, shards)
    return estimated(vocabulary, place, counts, rare), counts


def _backing_off(model: ngramlm.Model):
    """For each document its words, its distinct bigrams and the loss of backing off throughout, as if every rare word
    were unknown."""

    def run(batches):
        for b in batches:
            for at, part in wordscan.pieces(b["text"], ngramlm.PIECE):
                s = wordscan.scan(part)
                word = ngramlm.ids(s, model.vocabulary, model.place)
                before, gram = ngramlm.bigrams(s, word)
                order = np.lexsort((gram, s.row))
                g, d = gram[order], s.row[order]
                fresh = np.bincount(d[np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(d)]], minlength=len(part))
                before = np.minimum(before, ngramlm.IDS)
                loss = -np.bincount(s.row, log_back[before] + log_share[np.minimum(word, ngramlm.IDS)], len(part))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(part)), pa.array(np.bincount(s.row, minlength=len(part)).astype(np.int64)), pa.array(fresh.astype(np.int64)), pa.array(loss.astype(np.float64))], ["doc_id", "n_words", "n_fresh", "loss"])

    log_back, log_share = np.r_[model.log_back, 0.0], np.r_[model.log_share, np.log(model.unknown)]
    return run


def _document_bigrams(vocabulary, place, shards):
    """A row for each batch and shard: the batch's bigrams and rare words, how many documents hold each, which, and how often."""

    def run(batches):
        for b in batches:
            for first, part in wordscan.pieces(b["text"], ngramlm.PIECE):
                s = wordscan.scan(part)
                word = ngramlm.ids(s, vocabulary, place)
                if not len(word):
                    continue
                before, gram = ngramlm.bigrams(s, word)
                rare = np.flatnonzero(word >= ngramlm.IDS)
                last = rare[np.r_[s.row[1:] != s.row[:-1], True][rare]]
                own = ngramlm.shard_of(np.r_[ngramlm.owner(before, word, gram), word[rare], word[last]], shards)
                gram = np.r_[gram, ngramlm.key(word[rare], ngramlm.ALONE), ngramlm.key(word[last], ngramlm.LAST)]
                doc = np.r_[s.row, s.row[rare], s.row[last]]
                names = np.asarray(b["doc_id"].slice(first, len(part))).astype(np.int64)
                order = np.argsort(own.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
                ends = np.searchsorted(own[order], np.arange(shards + 1))
                for k in np.flatnonzero(np.diff(ends)):
                    at = order[ends[k] : ends[k + 1]]
                    at = at[np.argsort(gram[at], kind="stable")]  # documents stay in order within a bigram
                    g, d = gram[at], doc[at]
                    new = np.r_[True, g[1:] != g[:-1]]
                    each = np.flatnonzero(new | np.r_[True, d[1:] != d[:-1]])
                    c = np.diff(np.r_[each, len(g)]).astype(np.uint32)
                    edge = np.flatnonzero(new[each])
                    many = np.diff(np.r_[edge, len(each)]).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *[pa.array([x], pa.binary()) for x in (ngramlm.pack(names), ngramlm.pack_sorted(g[new]), ngramlm.pack(many), ngramlm.pack_runs(d[each].astype(np.uint32), edge), ngramlm.pack(c))]], ["shard", "docs", "gram", "many", "doc", "n"])

    return run


def _known(model: ngramlm.Model, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys in order and the gain of each, from its counts and rare words."""
    row = next((r for r in rows if r["gram"] is not None), None) or _counted(0, *[np.zeros(0, np.int64)] * 5)
    lists = [(ngramlm.unpack_sorted(r["words"], np.int64), ngramlm.unpack(r["into"], np.uint32).astype(np.int64), r["own"]) for r in rows if r["gram"] is None]
    words = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in lists]])
    into = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in lists]])
    own = np.concatenate([np.zeros(0, bool), *[np.full(len(x[0]), x[2]) for x in lists]])
    order = np.argsort(words, kind="stable")
    gram = ngramlm.unpack_sorted(row["gram"], np.int64)
    gain = model.gain(gram, ngramlm.unpack(row["n"], np.uint32).astype(np.int64))
    keys, more = model.rare_gains(*_pairs(row), (words[order], into[order]), own[order])
    at = np.argsort(keys)
    return np.r_[gram, keys[at]], np.r_[gain, more[at]]


def _gains(model: ngramlm.Model):
    """The join within a shard: documents' bigrams with trusted counts; a sum for each document of a row. A shard's
    counts come first and stay while the documents' rows stream by."""

    def run(batches):
        shard, counts, have, gain = None, [], None, None
        for b in batches:
            for i in range(len(b)):
                row = {c: b[c][i].as_py() for c in b.schema.names}
                if row["shard"] != shard:
                    shard, counts, have = row["shard"], [], None
                if not row["asks"]:
                    counts.append(row)
                    continue
                if have is None:
                    have, gain = _known(model, counts)
                    counts = []
                if not len(have):
                    continue
                names, gram = ngramlm.unpack(row["docs"], np.int64), ngramlm.unpack_sorted(row["gram"], np.int64)
                at = np.minimum(np.searchsorted(have, gram), len(have) - 1)
                many = ngramlm.unpack(row["many"], np.uint32)
                value = np.repeat(np.where(have[at] == gram, gain[at], 0.0), many)
                total = np.bincount(ngramlm.unpack_runs(row["doc"], np.uint32, many), value * ngramlm.unpack(row["n"], np.uint32), len(names))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some])], ["doc_id", "gain"])

    return run


def shards_for(trusted: DataFrame) -> int:
    """Shards of about SHARD_BYTES of trusted text, so that the counts of one fit in a task however much there is."""
    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-size // SHARD_BYTES))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_fresh, loss`` of every document: its words, its distinct bigrams and the negative log
    probability of its whole text."""
    shards = shards_for(trusted)
    vocabulary, place, counts, rare = counted(trusted, shards)
    model = estimated(vocabulary, place, counts, rare)
    known = counts.unionByName(rare.select("shard", "own", "words", "into"), allowMissingColumns=True).withColumn("asks", F.lit(False))
    sent = docs.select("doc_id", "text").mapInArrow(_document_bigrams(vocabulary, place, shards), "shard int, docs binary, gram binary, many binary, doc binary, n binary")
    both = known.unionByName(sent.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    gains = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(_gains(model), "doc_id long, gain double")
    base = docs.select("doc_id", "text").mapInArrow(_backing_off(model), "doc_id long, n_words long, n_fresh long, loss double")
    # One aggregation instead of a join: a document's gains from the shards and its row from backing off.
    nothing = F.lit(None).cast("long")
    parts = gains.select("doc_id", nothing.alias("n_words"), nothing.alias("n_fresh"), (-F.col("gain")).alias("loss")).unionByName(base)
    return parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("n_fresh").alias("n_fresh"), F.sum("loss").alias("loss"))


def scores(mean) -> list:
    """Of a document with words: how far its loss a word lies above its language's mean, and how far the loss that its
    distinct bigrams bring lies below it."""
    fresh = F.greatest(F.col("loss") / F.col("n_words"), mean) * F.col("n_fresh")
    drawn = lambda x: (x + PRIOR_WORDS * mean) / (F.col("n_words") + PRIOR_WORDS)
    return [(drawn(F.col("loss")) - mean).alias("noise"), (mean - drawn(fresh)).alias("echo")]


def _beyond(sample: DataFrame, *by: str) -> DataFrame:
    """The QUANTILE of ``noise`` and ``echo``: the TAIL quantile and, as excesses over it fall off exponentially, their
    mean times the log of the ratio of both shares. PRIOR_EXCESSES of the size that the way from the median to the TAIL
    quantile suggests steady that mean where there are few."""
    kinds = ("noise", "echo")
    edge = sample.groupBy(*by).agg(*[F.percentile_approx(c, [0.5, 1 - TAIL], 10000).alias(f"_{c}") for c in kinds], F.count(F.lit(1)).alias("k"))
    both = sample.join(edge, list(by)) if by else sample.crossJoin(F.broadcast(edge))  # a single row
    over = lambda c: F.greatest(F.col(c) - F.col(f"_{c}")[1], F.lit(0.0))
    sums = both.groupBy(*by).agg(F.first("k").alias("k"), *[F.first(f"_{c}").alias(f"_{c}") for c in kinds], *[F.sum(over(c)).alias(f"_s{c}") for c in kinds], *[F.count_if(over(c) > 0).alias(f"_n{c}") for c in kinds])

    def most(c: str):
        typical = (F.col(f"_{c}")[1] - F.col(f"_{c}")[0]) / float(np.log(0.5 / TAIL))
        mean = (F.col(f"_s{c}") + PRIOR_EXCESSES * typical) / (F.col(f"_n{c}") + PRIOR_EXCESSES)
        return (F.col(f"_{c}")[1] + mean * float(np.log(TAIL / QUANTILE))).alias(f"most_{c}")

    return sums.select(*by, "k", *map(most, kinds))


def bounds(sure: DataFrame) -> tuple[DataFrame, float, float, float] | None:
    """``lang, mean, most_noise, most_echo`` from documents ``lang, n_words, n_fresh, loss``, and the three of all
    languages together; None without any."""
    loss, n = sure.agg(F.sum("loss"), F.sum("n_words")).first()  # two numbers
    if not n:
        return None
    mean = float(loss) / n
    by = sure.filter("lang is not null").groupBy("lang").agg(((F.sum("loss") + LANGUAGE_WORDS * mean) / (F.sum("n_words") + LANGUAGE_WORDS)).alias("mean"))
    sample = sure.join(by, "lang", "left")
    sample = settle(sample.select("lang", *scores(F.coalesce("mean", F.lit(mean)))), "sample")
    pooled = _beyond(sample).first()  # three numbers
    near = lambda c: ((F.col("k") * F.col(c) + LANGUAGE_DOCS * F.lit(pooled[c])) / (F.col("k") + LANGUAGE_DOCS)).alias(c)
    each = _beyond(sample.filter("lang is not null"), "lang").select("lang", near("most_noise"), near("most_echo"))
    return settle(by.join(each, "lang"), "bounds"), mean, pooled["most_noise"], pooled["most_echo"]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, perplexity, noise, echo, kept`` for every document. ``labels`` marks trusted documents
    with quality 1; one in HELD_FOLDS of them sets the bounds, the others train the model.

    Nulls: a null text has no words; a text without words has no perplexity and is kept, as there is no evidence against
    it. A null language, or one without held-out documents, uses the bounds of all languages; without trusted text
    everything is kept. Rows without doc_id are no documents; of rows that share one the least by text and language
    stays. Other columns are ignored. An empty table gives an empty result."""
    own = one_per_id(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_FOLDS)) == 0
    trusted = settle(semi_join(own.select("doc_id", "text"), good.filter(~held), "doc_id"), "trusted")
    losses = perplexities(own, trusted)
    forget(trusted)  # the counts are settled
    scored = settle(losses.join(own.select("doc_id", "lang"), "doc_id"), "scored")
    found = bounds(scored.join(good.filter(held), "doc_id", "left_semi").filter("n_words > 0").select("lang", "n_words", "n_fresh", "loss"))
    some = F.col("n_words") > 0
    cols = ["doc_id", "lang", "n_words", F.when(some, F.exp(F.col("loss") / F.col("n_words"))).alias("perplexity")]
    if found is None:
        return scored.select(*cols, *[F.lit(None).cast("double").alias(c) for c in ("noise", "echo")], F.lit(True).alias("kept"))
    by_lang, mean, most_noise, most_echo = found
    full = scored.join(by_lang, "lang", "left").withColumn("mean", F.coalesce("mean", F.lit(mean)))
    noise, echo = (F.when(some, c) for c in scores(F.col("mean")))
    within = (noise <= F.coalesce("most_noise", F.lit(most_noise))) & (echo <= F.coalesce("most_echo", F.lit(most_echo)))
    return full.select(*cols, noise.alias("noise"), echo.alias("echo"), F.coalesce(within, F.lit(True)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))
