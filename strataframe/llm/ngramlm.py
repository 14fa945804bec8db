"""What the n-gram model does on batches of texts: word ids, packed bigram tables, Kneser-Ney estimates.

Words are ids: the frequent words of the trusted text have small ones, whose estimates every executor holds; any other
word has its hash, and its estimates are joined by shard. A bigram of two small ids is one number, any other a hash.
Tables of bigrams travel sorted, as differences, packed; a batch of documents sends each bigram once with the documents
that hold it, divided over shards by the rare word in it, if there is one, or else by the bigram's hash.
"""

from __future__ import annotations

import numpy as np
import zstandard

from . import wordscan

VOCABULARY, SHAPES = 60_000, 0  # words with a small id; no ids are shared
START = VOCABULARY + SHAPES
IDS = START + 1
PIECE = 4 << 20
#: Rare words are numbered from IDS on by the upper bits of their hash; keys that are hashes, of KEY_BITS within a shard, begin at HASHED.
RARE_SHIFT, KEY_BITS, HASHED = 20, 40, 1 << 48
ALONE, LAST = -1, -2


def pack(x: np.ndarray) -> bytes:
    """Bytes of like weight together, so that small numbers shrink."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(b, kind), dtype=kind)


def pack_runs(x: np.ndarray, first: np.ndarray) -> bytes:
    """Whole numbers that ascend within runs, which begin at ``first``: each as the step from the one before it."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    steps[first] = x[first]
    return pack(steps)


def unpack_runs(b: bytes, kind, many: np.ndarray) -> np.ndarray:
    """The numbers of ``pack_runs``; ``many``: the runs' lengths, none of them 0."""
    steps = unpack(b, kind)
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(many, dtype=np.int64) - many
    return total - np.repeat(total[first] - steps[first], many)


def ids(s: wordscan.Scan, vocabulary: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The id of each word; ``vocabulary``: sorted hashes of the frequent words, ``place``: their ids."""
    rare = IDS + (s.hash >> np.uint64(RARE_SHIFT)).astype(np.int64)
    if not len(rare) or not len(vocabulary):
        return rare
    at = np.minimum(np.searchsorted(vocabulary, s.hash), len(vocabulary) - 1)
    return np.where(vocabulary[at] == s.hash, place[at], rare)


def key(before: np.ndarray, word) -> np.ndarray:
    """The key of a bigram with a rare word; of one rare word where the second is ALONE or LAST."""
    h = wordscan.joined(before.astype(np.uint64), np.asarray(word, np.int64).astype(np.uint64))
    return HASHED + (h >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def bigrams(s: wordscan.Scan, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the id before it, START at a text's beginning, and the bigram."""
    before = np.r_[START, word[:-1]] if len(word) else word
    if len(word):
        before[np.r_[True, s.row[1:] != s.row[:-1]]] = START
    gram = before * IDS + word
    rare = (before >= IDS) | (word >= IDS)
    gram[rare] = key(before[rare], word[rare])
    return before, gram


def shard_of(own: np.ndarray, shards: int) -> np.ndarray:
    return (wordscan.mix(own.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def owner(before: np.ndarray, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """What decides a bigram's shard: the rare word before, else the rare word, else the bigram."""
    return np.where(before >= IDS, before, np.where(word >= IDS, word, gram))


def tally(before: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order and the sum of ``n`` for each."""
    order = np.lexsort((word, before))
    before, word, n = before[order], word[order], n[order]
    edge = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])][: len(word)])
    return before[edge], word[edge], np.add.reduceat(n, edge) if len(edge) else n


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n = np.maximum(n[1:5].astype(float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.where((d > 0) & (d < np.array([1, 1, 2, 3])), d, np.array([0, 0.5, 0.75, 0.9]))


class Model:
    """The part of bounded size: for each small id its log share as a continuation and its log back-off weight as a
    context, and the few numbers that give both for a rare word."""

    def __init__(self, vocabulary: np.ndarray, place: np.ndarray, total: np.ndarray, kinds: np.ndarray, into: np.ndarray, of: np.ndarray, of_into: np.ndarray, everything: int | None = None, types: float | None = None):
        """``total``: tokens after each id; ``kinds``: its distinct bigrams by count 1, 2, 3+; ``into``: distinct ids
        before each id; ``of`` and ``of_into``: how many bigrams, and how many words, have count 1 to 4 (and more).
        ``everything``: the sum of ``into`` and ``types``: the number of words, both with rare and unknown ones."""
        self.vocabulary, self.place, self.total = vocabulary, place, np.maximum(total, 1)
        self.discount, self.less = discounts(of), discounts(of_into)
        self.everything = max(into.sum() if everything is None else everything, 1)
        lost = (of_into[1:6] * self.less[[1, 2, 3, 3, 3]]).sum() / self.everything
        self.unknown = (lost if of_into[1:6].any() else 1.0) / (IDS if types is None else types)
        self.back, self.share = self.backs(total, kinds), self.shares(into)
        self.log_back, self.log_share = np.log(np.maximum(self.back, 1e-12)), np.log(self.share)

    def backs(self, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.where(total > 0, (kinds * self.discount[1:]).sum(1) / np.maximum(total, 1), 1.0)

    def shares(self, into: np.ndarray) -> np.ndarray:
        return np.maximum(into - self.less[np.minimum(into, 3)], 0) / self.everything + self.unknown

    def gain(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """By how much a seen bigram's log probability exceeds that of backing off."""
        before, word = gram // IDS, gram % IDS
        return self._gain(count, self.total[before], self.back[before], self.share[word])

    def _gain(self, count, total, back, share):
        seen = (count - self.discount[np.minimum(count, 3)]) / total + back * share
        return np.log(seen) - np.log(np.maximum(back, 1e-12)) - np.log(share)

    def rare_gains(self, before: np.ndarray, word: np.ndarray, n: np.ndarray, asked: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a shard's rare words and of its bigrams with rare words, and what each adds to backing off as an
        unknown word. ``asked``: rare words in order and their ``into``, of which ``own`` marks the shard's."""
        words, into = asked
        share = self.shares(into)
        of, at = np.unique(before, return_inverse=True)
        kinds = np.stack([np.bincount(at[np.minimum(n, 3) == c], minlength=len(of)) for c in (1, 2, 3)], 1)
        total = np.bincount(at, n, len(of))
        back, common = self.backs(total, kinds), of < IDS
        total[common], back[common] = self.total[of[common]], self.back[of[common]]
        mine = np.empty(len(word))
        small = word < IDS
        mine[small], mine[~small] = self.share[word[small]], share[np.searchsorted(words, word[~small])]
        pairs = self._gain(n, total[at], back[at], mine)
        # A rare word's own key stands for the word and for the context that it is, unless it is a text's last.
        w = words[own]
        log_back = np.zeros(len(w))
        if len(of):
            place = np.minimum(np.searchsorted(of, w), len(of) - 1)
            log_back = np.where(of[place] == w, np.log(np.maximum(back[place], 1e-12)), 0.0)
        alone = np.log(share[own]) - np.log(self.unknown) + log_back
        return np.r_[key(before, word), key(w, ALONE), key(w, LAST)], np.r_[pairs, alone, -log_back]
