"""Spaced seeds against comparing all windows."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import decontaminate as d


def brute(docs, items, window=13, similarity=0.8, least=5):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = defaultdict(set)
    for (ident, text), (item, passage) in itertools.product(docs, items):
        a, b = cut(text), cut(passage)
        n = min(window, len(b))
        if n < least:
            continue
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                differ = sum(x != y for x, y in zip(a[i:i + n], b[j:j + n]))
                if differ <= d.tolerance(n, similarity):
                    found[ident, item].add((i, i + n - 1))
    return sorted(((k[0], k[1], len({s for s, _ in v}), min(s for s, _ in v), max(e for _, e in v))
                   for k, v in found.items()), key=str)


@pytest.mark.parametrize("length", range(5, 14))
def test_masks_find_all_tolerated_differences(length):
    t = d.tolerance(length, 0.8)
    words = np.arange(100, 100 + length, dtype=np.uint64)
    plain = [int(k[0]) for k in d.seeds(words, length, 0.8)]
    for places in itertools.combinations(range(length), t):
        other = words.copy()
        other[list(places)] += np.uint64(1000)
        assert any(a == int(k[0]) for a, k in zip(plain, d.seeds(other, length, 0.8)))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(400)]
    prose = lambda n: rng.choices(words, k=n)
    items = [(i, prose(n)) for i, n in enumerate([40, 20, 13, 12, 8, 6, 5, 4, 1])]
    docs = []
    for i in range(40):
        item = list(rng.choice(items)[1])
        for k in range(0, len(item), rng.randint(4, 9)):
            if rng.random() < 0.5:
                item[k] = "other"
        docs.append((i, " ".join(prose(rng.randint(0, 60)) + item + prose(10))))
    docs += [(100 + i, " ".join(prose(80))) for i in range(10)]
    docs += [(200, None), (201, ""), (None, " ".join(items[0][1])), docs[0], docs[0],
             (202, "! ".join(items[0][1]).upper())]
    items = [(i, " ".join(w).capitalize() + ".") for i, w in items] + [(50, None), (51, "")]
    return docs, items


@pytest.mark.parametrize("limit", [4_000_000, 10])
def test_overlaps(spark, make, tables, limit):
    docs, items = tables
    bench = make(items).withColumnRenamed("doc_id", "item_id")
    found = d.overlaps(make(docs), bench, max_filter_hashes=limit)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_removal_keeps_clean_rows_whole(spark, make, tables):
    docs, items = tables
    bench = make(items).withColumnRenamed("doc_id", "item_id")
    bad = {r[0] for r in brute(docs, items)}
    kept = d.remove_contaminated(make(docs), bench).collect()
    assert sorted((r.doc_id, r.tag, r.n) for r in kept) == sorted(
        (i, "t", 4) for i, _ in docs if i not in bad)


def test_empty_tables(make, tables):
    docs, items = tables
    bench = make(items).withColumnRenamed("doc_id", "item_id")
    assert d.overlaps(make([]), bench).count() == 0
    assert d.overlaps(make(docs), bench.limit(0)).count() == 0
    assert d.remove_contaminated(make(docs), bench.limit(0)).count() == len(docs)


def test_short_items_and_scripts_without_spaces(make):
    chinese = "\u4eca\u5929\u7684\u5929\u6c14\u975e\u5e38\u597d\u6211\u4eec\u51fa\u53bb\u8d70\u8d70\u5427"
    items = make([(1, "Photosynthesis requires chlorophyll!"), (2, chinese), (3, "It is so"),
                  (4, "Photosynthesis")]).withColumnRenamed("doc_id", "item_id")
    other = chinese[:7] + "\u574f" + chinese[8:]              # one character in the middle
    docs = make([
        (10, "we know photosynthesis requires CHLOROPHYLL in plants, and it is so"),
        (11, "we know photosynthesis needs chlorophyll"), (12, "\u4ed6\u8bf4" + chinese + "\u3002ok"),
        (13, other), (14, chinese[:6] + " " + chinese[9:]), (15, "chinese " + chinese + "x"), (16, chinese[:5])])
    found = {(r.doc_id, r.item_id): r for r in d.overlaps(docs, items).collect()}
    assert set(found) == {(10, 1), (12, 2), (13, 2), (15, 2)}
    assert tuple(found[10, 1])[2:] == (1, 2, 4)
    assert tuple(found[12, 2])[2:] == (2, 2, 15)
    assert {r.doc_id for r in d.remove_contaminated(docs, items).collect()} == {11, 14, 16}
