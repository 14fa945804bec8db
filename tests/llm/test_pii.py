"""Surrogates against a replacement written in plain Python, coreference, more values than outcomes and clashing names."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from strataframe.llm import pii


def test_hmac(spark):
    for key in ("k", "long key " * 20):
        got = spark.range(1).select(pii._hmac(key, F.lit("message é"))).first()[0]
        assert got == hmac.new(key.encode(), "message é".encode(), hashlib.sha256).hexdigest()


def test_more_values_than_outcomes(spark):
    """A hundred numbers of two digits, all of them real, and ten single letters: the loop ends and none is shared."""
    rows = [("phone", f"{i:02d}") for i in range(100)] + [("local", c) for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.collisions(spark.createDataFrame(rows, "kind string, core string"), "k").collect()
    assert len(got) == len(rows) == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(rows)


def test_people_keep_their_surrogate_through_a_text(spark, table):
    text = "Mr. John Smith met Smith. John Smith left, Smithson stayed. Dr. John Jones called John."
    got = {r["doc_id"]: r["text"] for r in pii.replace_private(table([(1, text), (2, "John Smith, untitled"), (3, "Mrs. Eva Smith")])).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+)\. (\w+) (\w+) left, Smithson stayed\. Dr\. (\w+) (\w+) called (\w+)\.", got[1])
    given, family = m[1], m[2]
    assert m[3] == m[5] == family and m[4] == m[6] == m[8] == given and len({given, family, m[7], "John", "Smith", "Jones"}) == 6
    assert got[2] == "John Smith, untitled" and got[3].endswith(family)


def test_domains_change_alike_but_reserved_ones(spark, table):
    text = "jane@smith-family.com bob@smith-family.com ann@mail.firm.co.uk x@example.com y@sub.example.org"
    out = pii.replace_private(table([(1, text)])).first()["text"].split()
    assert out[0].split("@")[1] == out[1].split("@")[1] != "smith-family.com" and re.fullmatch(r"[a-z]{5}-[a-z]{6}\.com", out[0].split("@")[1])
    assert re.fullmatch(r"[a-z]{3}@[a-z]{4}\.[a-z]{4}\.co\.uk", out[2]) and "firm" not in out[2]
    assert re.fullmatch(r"[a-z]@example\.com", out[3]) and re.fullmatch(r"[a-z]@[a-z]{3}\.example\.org", out[4])


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_cards_are_told_by_their_check_digit(spark, table):
    text = "4041 8949 7460 8795 and 1234567890123456"
    row = pii.replace_private(table([(1, text)])).first()
    card, other = row["text"].split(" and ")
    assert other == "1234567890123456" and row["n_entities"] == 1 and card[0] == "4" and card != "4041 8949 7460 8795" and luhn(card)


def test_against_plain_replacement(spark, table):
    """The rebuilt texts are what replacing each part by its surrogate in plain Python gives, over many shared values."""
    texts = {}
    for i in range(120):
        texts[i] = f"Call {100 + i % 7}-555-01{i % 10}0 or write u{i % 5}@h{i % 3}.net; token: abcdefgh{i % 11:02d} from 10.0.{i % 4}.{i % 9 + 1} end"
    key = "k"
    got = {r["doc_id"]: r for r in pii.replace_private(table(list(texts.items())), key=key).collect()}
    maps = {}
    for i, t in texts.items():
        old = re.fullmatch(r"Call (\S+) or write (\S+)@(\S+); token: (\S+) from (\S+) end", t).groups()
        new = re.fullmatch(r"Call (\S+) or write (\S+)@(\S+); token: (\S+) from (\S+) end", got[i]["text"]).groups()
        assert got[i]["n_entities"] == 4
        for kind, a, b in zip(("phone", "local", "domain", "secret", "address"), old, new, strict=True):
            assert maps.setdefault((kind, a), b) == b
    for kind in ("phone", "local", "domain", "secret", "address"):
        own = {a: b for (k, a), b in maps.items() if k == kind}
        assert len(set(own.values())) == len(own) and not set(own) & set(own.values())
    parts = spark.createDataFrame(list(maps), "kind string, core string")
    first = {(r["kind"], r["core"]): r["s"] for r in parts.select("kind", "core", pii.surrogate(F.col("kind"), F.col("core"), 0, key).alias("s")).collect()}
    late = {(r["kind"], r["core"]): r["surrogate"] for r in pii.collisions(parts, key).collect()}
    assert {**first, **late} == maps


def test_keys_tell_surrogates_apart(spark, table):
    docs = table([(1, "write to ann.lee@mail.somewhere.net now")])
    a, b, c = (pii.replace_private(docs, key=k).first()["text"] for k in ("one", "two", "one"))
    assert a == c != b and pii.replace_private(docs).first()["text"] == pii.replace_private(docs).first()["text"]


@pytest.mark.parametrize("names", [["_parts", "_known", "_row"], ["_mine", "_P", "N_ENTITIES"]])
def test_clashing_names(spark, names):
    df = spark.createDataFrame([(1, "password=abcdefgh12", "x", "y", "z")], ["doc_id", "text", *names])
    row = pii.replace_private(df).first()
    assert [row[n] for n in names if n != "N_ENTITIES"] == ["x", "y", "z"][: len([n for n in names if n != "N_ENTITIES"])] and "abcdefgh12" not in row["text"]
