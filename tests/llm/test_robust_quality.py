"""Counts and outliers against plain loops over all rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import robust_quality as rq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def vector(c):
    share = lambda a, b: math.asin(math.sqrt(min(1, a / b)))
    return [round(200 * x) for x in (math.log(c[0]), math.log(c[1] / c[0]), share(c[2], c[1]),
                                     share(c[3], c[0]), share(c[4], c[0]))]


def scatter(cov, n):
    prior, floor = (np.diag((200 * np.array(x)) ** 2) for x in (
        (1, .05, .05, .05, .12), (.1, .02, .05, .05, .12)))
    return (n * cov + 20 * prior) / (n + 20) + floor


def consistency(share):
    return share / rq.chi2_cdf(rq.chi2_quantile(share, 5), 7)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def brute_distances(x):
    """Rows of one group, each counted."""
    n = len(x)
    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(abs(x - middle), axis=0), 200 * np.array(rq.FLOOR))
    y = np.round(1000 * np.tanh((x - middle) / spread))
    squashed = np.cov(y.T, bias=True)
    size = np.sqrt(np.maximum(np.diag(squashed), 1e-9))
    correlation = squashed / np.outer(size, size)
    np.fill_diagonal(correlation, 1)
    begin = [(middle, np.diag(spread ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True)),
             (middle, correlation * np.outer(spread, spread))]
    best = None
    for start, (mean, cov) in enumerate(begin):
        cov = scatter(cov, n)
        for _ in range(rq.STEPS):
            bins = rq.bin_of(distances(x, mean, cov))
            kept = x[bins <= np.sort(bins)[math.ceil(.75 * n) - 1]]
            mean = kept.mean(axis=0)
            cov = scatter(consistency(.75) * np.cov(kept.T, bias=True), len(kept))
        found = (np.linalg.slogdet(cov)[1], start, mean, cov)
        if best is None or found[0] < best[0] - 1e-9:
            best = found
    _, _, mean, cov = best
    bins = rq.bin_of(distances(x, mean, cov))
    kept = x[bins <= rq.bin_of(rq.chi2_quantile(.975, 5))]
    kept = kept if len(kept) else x[bins == bins.min()]
    return distances(x, kept.mean(axis=0),
                     scatter(consistency(.975) * np.cov(kept.T, bias=True), len(kept)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []

    def text(junk):
        words = ["".join(rng.choices("abcdé", k=rng.randint(2, 8))) for _ in range(rng.randint(40, 300))]
        if junk == "symbols":
            words = [w + rng.choice(["###", "$$", "&&&"]) for w in words]
        elif junk == "lines":
            words = words[:60] + ["\nagain and again\n"] * 8
        elif junk == "letters":
            words = [w * 9 for w in words]
        return " ".join(words).replace(" a", "\na")

    for k in range(400):
        junk = rng.choice(["symbols", "lines", "letters"]) if k % 12 == 0 else None
        out.append((k, text(junk), rng.choice(["en", "fr", None]), rng.choice(["one", "two"])))
    out += [(1000 + k, out[1][1], "en", "one") for k in range(120)]            # a hot group of copies
    out += [(2000, None, "en", "one"), (2001, "", None, None), (2002, text(None), "de", None),
            (2003, text(None), "", ""), (None, text(None), "en", "two"), (2004, "# " * 400, "fr", "one"),
            (2005, "  thin " * 80, "fr", "one"), (2006, "word " * 9000, "fr", "two")]
    return out + [out[3], out[3]]


def test_counts_and_verdicts_equal_plain_loops(spark, rows):
    docs = spark.createDataFrame(
        [(*r, 1.0, 2, "x") for r in rows],
        "doc_id long, text string, lang string, source string, mean double, w long, v0 string").repartition(5)
    got = {}
    for r in rq.judge(docs).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    groups = {}
    for r in rows:
        if not failed(counts(r[1])):
            groups.setdefault((r[2], r[3]), []).append(vector(counts(r[1])))
    far = {}
    for key, x in groups.items():
        for v, d in zip(x, brute_distances(np.array(x, float))):
            far[key, tuple(v)] = d
    limit = rq.chi2_quantile(1 - 1e-5, 5)
    for doc_id, text, lang, source in rows:
        c = counts(text)
        (found,) = got[doc_id]
        assert found[:5] == c and found[5] == failed(c)
        if failed(c):
            assert found[6] is False and found[7] is None
        else:
            d = far[(lang, source), tuple(vector(c))]
            assert found[7] == pytest.approx(d, rel=1e-6) and found[6] == (d <= limit)
    rejected = {i for i, v in got.items() for r in v if not r[5] and not r[6]}
    assert rejected and all(i is not None and i % 12 == 0 for i in rejected if i is None or i < 400)


def test_the_result_does_not_depend_on_the_partitions(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, two = (sorted(map(repr, rq.judge(docs.repartition(n)).collect())) for n in (2, 7))
    assert one == two


def test_a_group_of_copies_keeps_its_neighbours(spark):
    rng = random.Random(2)
    prose = [" ".join("".join(rng.choices("abcde", k=rng.randint(2, 8))) for _ in range(rng.randint(80, 400)))
             for _ in range(60)]
    rows = [(k, prose[0], "en", "s") for k in range(300)] + [(400 + k, t, "en", "s") for k, t in enumerate(prose)]
    found = rq.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert found.where("NOT kept AND NOT base_failed").count() == 0


def test_chi_squared():
    assert rq.chi2_cdf(rq.chi2_quantile(.975, 5), 5) == pytest.approx(.975)
    assert rq.chi2_quantile(.5, 2) == pytest.approx(2 * math.log(2))
    assert rq.chi2_quantile(.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_long_texts_are_counted_whole():
    rng = random.Random(1)
    words = [str(rng.randrange(10 ** 9)).encode() for _ in range(2_200_000)]
    words += words[:7]
    assert rq.repeated_words([words, words[:9], []]).tolist() == [14, 0, 0]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rq.judge(none).collect() == []
