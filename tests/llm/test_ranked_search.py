"""Ranked search against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    found = [(i, Counter(cut(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    total, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    pooled = {}
    for item, text in dict.fromkeys(items):
        pooled.setdefault(item, []).extend(cut(text))
    rows = []
    for item, words in pooled.items():
        scored = []
        for i, c in found:
            m = 100 - 75 + 75 * sum(c.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1)))
                    * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda r: r[:3])[:top])]
    return sorted(rows, key=repr)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in rs.rank_documents(docs, items, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    words = ["alpha", "BETA", "gamma", "été", "x1", "delta", "zwölf", "la", "one", "nowhere"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(12)]
    return rows + [(20, None), (21, "..."), (22, "nowhere"), rows[0], (rows[1][0], "two texts alpha")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Été", "été", "x1", "delta", "la", "the", "of", "ZWÖLF"]
    rows = [(k * 2, rng.choice([" ", "\n", "-"]).join(rng.choices(words, k=rng.randint(0, 30))))
            for k in range(150)]
    rows += [(1000 - k, "alpha beta x1") for k in range(40)]          # many copies, falling ids
    rows += [(2000 + k, "x1 alpha Beta") for k in range(5)]           # the same bag in another order
    rows += [(1, None), (3, ""), (5, " -- "), (None, "alpha beta x1"), (None, "gamma"), (7, "é" * 5000),
             (9, "alpha " * 5000), rows[0], rows[0]]
    return rows


def test_equals_plain_counting(spark, make, texts, items):
    docs = make(texts, 5)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", rs.F.lit(1))
    assert ranked(docs, table) == brute(texts, items)
    assert ranked(docs, table, top=3) == brute(texts, items, top=3)


def test_blocks_of_items_give_the_same(spark, make, texts, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(rs.item_blocks(table, "item_id", "text", block_bytes=250))
    assert len(blocks) > 1
    assert ranked(make(texts), table, block_bytes=250) == brute(texts, items)


def test_a_hash_collision_merges_nothing(spark, make, texts, items, monkeypatch):
    plain = rs.classes_of
    monkeypatch.setattr(rs, "classes_of", lambda *a: plain(*a).withColumn("h", rs.F.lit(1).cast("long")))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(make(texts), table) == brute(texts, items)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked(make([(1, "alpha"), (2, None)]), none) == []
    assert ranked(make([(1, None), (2, "..")]), some) == []
    assert ranked(make([(1, "beta")]).where("false"), some) == []
    assert rs.rank_documents(make([(1, "a")]), none).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_class_is_scored_once(make):
    found = rs.classes_of(rs.bags(make([(k, "alpha beta") for k in range(50)] + [(99, "beta alpha")]),
                                  {b"alpha": 0, b"beta": 1}, "doc_id", "text"), 51, 102)
    assert found.select("h", "m", "terms", "tfs").distinct().count() == 1
