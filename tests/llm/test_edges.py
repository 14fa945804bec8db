"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from strataframe.llm import bloom, decontaminate, fingerprints, jaccard, mixing, pii, quality, substrings, tokencounts, toxicity, urlfilter


def run(spark, name, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "a passage that nobody has written yet in any text"), (1, None), (None, "x"), (2, "")], "item_id long, text string")
    return {
        "quality": lambda: quality.classify(docs, labels), "substrings": lambda: substrings.drop_repeats(docs), "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "leaks": lambda: decontaminate.leaks(docs, items), "jaccard": lambda: jaccard.similar_classes(docs), "tokens": lambda: tokencounts.count_tokens(docs),
        "pii": lambda: pii.replace_private(docs), "fingerprints": lambda: fingerprints.fingerprint_edits(docs), "mixing": lambda: mixing.mix_counts(docs),
    }[name]()


NAMES = ["quality", "substrings", "toxicity", "leaks", "jaccard", "tokens", "pii", "fingerprints", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, table, name):
    assert run(spark, name, table([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, table, prose, name):
    long = prose(60_000, 1)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one"), (6, "one"), (7, prose(50, 2)), (7, prose(50, 2)), (8, "é \u00a0 ü\U0001f600 x"), (None, "lost"), (9, long), (-5, "minus"), (7, "another text of seven")]
    rows = [(i, t, None if i == 3 else "en", None if i == 2 else f"s{(i or 0) % 2}") for i, t in rows]
    got = run(spark, name, table(rows)).toPandas()
    if name == "pii":
        assert len(got) == len(rows) and got["text"].isna().sum() == 1
    elif name == "leaks":
        assert len(got) == 0
    else:
        assert set(got["doc_id"]) == {1, 2, 3, 4, 5, 6, 7, 8, 9, -5}
        assert name == "tokens" or len(got) == 10
    if name == "substrings":
        g = got.set_index("doc_id")
        assert g.loc[9, "n_removed"] == 60_000 and g.loc[4, "n_removed"] == 0 and g.loc[1, "n_words"] == 0
    if name == "jaccard":
        g = got.set_index("doc_id")
        assert g.loc[6, "component_id"] == 5 and g.loc[9, "component_id"] == 4 and g.loc[1, "component_id"] == 1 and g.loc[2, "n_shingles"] == 0
    if name == "toxicity":
        assert got["score"].between(0, 1).all()
    if name == "fingerprints":
        g = got.set_index("doc_id")
        assert g.loc[5, "fingerprint"] == g.loc[6, "fingerprint"] and g.loc[1, "fingerprint"] == g.loc[3, "fingerprint"] and g.loc[5, "near_next"] == 1.0
    if name == "mixing":
        assert (got["taken"] <= 3 * got["size"]).all()


def test_odd_urls(spark):
    """Null, repeated and very long urls, null page_ids and clashing columns: every row stays and has a verdict."""
    long = "http://listed.io/" + "p/" * 200_000
    rows = [(1, None), (None, "http://listed.io/p"), (2, "http://listed.io/p"), (2, "http://listed.io/p"), (3, long), (4, ""), (5, "://"), (6, "http://LISTED.io/p/#x")]
    pages = spark.createDataFrame([(i, u, "a", "b", "c", True) for i, u in rows], "page_id long, url string, host string, rule string, verdict string, _maybe boolean")
    listed = spark.createDataFrame([("listed.io", "/p"), (None, "/x"), ("listed.io", None)], "host string, path string")
    got = sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, listed).collect())
    assert got == [(0, "listed.io", 2, None, "block"), (1, "", 0, None, "allow"), (2, "listed.io", 2, None, "block"), (2, "listed.io", 2, None, "block"), (3, "listed.io", len(long) - 16, None, "allow"), (4, "", 0, None, "allow"), (5, "", 0, None, "allow"), (6, "listed.io", 3, None, "block")]
    many = spark.range(3000).selectExpr("concat('h', id % 1000, '.com') host", "concat('/', id) path")
    hit = spark.range(6000).selectExpr("id page_id", "concat('http://h', id % 1000, '.com/', id) url")
    for blocks in (1, None):  # a filter that is full, and one sized to the list
        assert urlfilter.filter_urls(hit, many, blocks=blocks).filter("verdict = 'block'").count() == 3000
    assert bloom.blocks_for(1000) * 256 >= 12_000 and bloom.blocks_for(0) == 1


def test_lists_beyond_the_largest_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 2)
    keys, rows = spark.range(500).selectExpr("id k"), spark.range(1000).selectExpr("id k", "id v")
    assert bloom.semi_join(rows, keys, "k").count() == 500


def test_half_windows_in_several_filters(spark, table, prose, monkeypatch):
    """More repeated half-windows than one filter holds: the same words go."""
    a = prose(200, 1)
    docs = table([(1, a), (2, prose(20, 2) + " " + a), (3, prose(60, 3)), (4, a + " " + prose(30, 4))])
    want = sorted(map(tuple, substrings.drop_repeats(docs).collect()))
    monkeypatch.setattr(substrings, "MOST_BITS", 10)
    assert sorted(map(tuple, substrings.drop_repeats(docs).collect())) == want


def test_large_and_negative_ids(spark, table, prose):
    """Places of documents whose ids span all of a long."""
    a = prose(40, 1)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(table([(-(1 << 62), a), (1 << 62, a), (0, a)])).collect()}
    assert got == {-(1 << 62): 0, 0: 40, 1 << 62: 40}
