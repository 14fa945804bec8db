"""Token counts by section: every document is encoded once, whole, and its tokens are attributed by their spans.

Sections are given as spans of the text; by default they are its lines, each with the line end that closes it. Tokens and
sections are both in order, so their spans are joined by binary search on the boundaries. The rule for a token
that crosses a boundary: it belongs to the section that holds most of its bytes, of equal ones to the last.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.caches import Cache
from .common import one_per_id, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id {}, section long, first_char long, n_chars long, n_tokens long, n_crossing long, doc_tokens long"
_encodings: dict[int, tuple] = Cache()


def encoding(vocabulary: bytes):
    """The encoder and the length in bytes of each of its tokens."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(x) for x in ranks]
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _encodings[key]


def lines(data: np.ndarray) -> np.ndarray:
    """Where the sections of a text begin, in bytes."""
    at = np.flatnonzero(data == 10) + 1
    return np.r_[0, at[at < len(data)]]


def attribute(ends: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each section the tokens that belong to it and how many of them cross a boundary; of sections with equally many
    bytes of a token the last has it, as it holds where the token ends. ``ends``: where tokens end, in bytes, in order and without gaps; ``bounds``: where sections begin."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    first, last = np.searchsorted(bounds, starts, side="right") - 1, np.searchsorted(bounds, ends - 1, side="right") - 1
    cross = np.flatnonzero(first != last)
    stops = np.r_[bounds[1:], size]
    own = first.copy()
    for t in cross:
        span = np.arange(last[t], first[t] - 1, -1)
        own[t] = span[np.argmax(np.minimum(stops[span], ends[t]) - np.maximum(bounds[span], starts[t]))]
    return np.bincount(own, minlength=len(bounds)), np.bincount(own[cross], minlength=len(bounds))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, sections=lines) -> DataFrame:
    """``doc_id, section, first_char, n_chars, n_tokens, n_crossing, doc_tokens``: one row for each section of each
    document. Sections cover a text without gaps, so the sum of n_tokens is doc_tokens.

    A null or empty text has one empty section with 0 tokens. Rows without doc_id are no documents; of rows that share
    one the least text stays. Other columns are ignored. An empty table gives an empty result. The vocabulary's file is
    read on the driver and travels with the function."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(batches):
        encoder, size = encoding(ranks)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            held = 0
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(size[encoder.encode_ordinary(text)]) if text else np.zeros(0, np.int64)
                bounds = sections(data)
                n, c = attribute(ends, bounds, len(data)) if len(ends) else (np.zeros(1, np.int64),) * 2
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                stops = np.r_[bounds[1:], len(data)]
                for col, v in zip(cols, ([doc] * len(bounds), np.arange(len(bounds)), chars[bounds], chars[stops] - chars[bounds], n, c, np.full(len(bounds), len(ends))), strict=True):
                    col.append(v)
                held += len(bounds)
                if held > 20_000:
                    yield _batch(cols, b["doc_id"].type)
                    cols, held = [[] for _ in range(7)], 0
            if held:
                yield _batch(cols, b["doc_id"].type)

    own = one_per_id(docs, "doc_id", "text")
    return own.select("doc_id", "text").mapInArrow(run, SCHEMA.format(own.schema["doc_id"].dataType.simpleString()))


def _batch(cols: list[list], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing", "doc_tokens"]
    return pa.RecordBatch.from_arrays([pa.array([x for part in cols[0] for x in part], kind), *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:]]], names)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
