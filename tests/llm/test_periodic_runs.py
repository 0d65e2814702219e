"""Runs against comparing words at every distance."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def left_over(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def samples(seed):
    rng = random.Random(seed)
    for _ in range(40):
        n, kind = rng.randint(0, 420), rng.randint(0, 5)
        block = [rng.choice("aab") for _ in range(rng.randint(1, 9))]
        if kind == 0:
            words = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            words = fibonacci(n)
        elif kind == 2:                            # two stretches of one short period out of step
            words = (block * 60)[:n] + ["a"] * rng.randint(0, 3) + (block * 60)[:rng.randint(0, 400)]
        elif kind == 3:
            words = [rng.choice("abc") for _ in range(rng.randint(1, 100))] * rng.randint(2, 9)
        elif kind == 4:                            # repeats of repeats
            words = block[:3]
            while len(words) < 150:
                words = words * rng.randint(1, 12) + [rng.choice("abc") for _ in range(rng.randint(0, 2))]
            words = (words * 3)[:1200]
        else:                                      # Thue-Morse: no hash may take it for periodic
            words = [str(bin(k).count("1") % 2) for k in range(n)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            if words:
                words[rng.randrange(len(words))] = rng.choice("abz")
        yield [w.encode() for w in words]


@pytest.mark.parametrize("seed", range(6))
def test_equals_comparing_at_every_distance(seed):
    texts = list(samples(seed))
    for words, runs, kept in zip(texts, *pr.batch_runs(texts)):
        assert [tuple(r) for r in runs.tolist()] == brute(words)
        assert [w for w, k in zip(words, kept) if k] == left_over(words, brute(words))


def test_both_kinds_of_proposals_are_needed(monkeypatch):
    hidden = [b"a", b"a", b"b"] * 100 + [b"a"] + [b"a", b"a", b"b"] * 100
    plain = [str(k).encode() for k in range(50)] * 3
    all_runs = [len(r) for r in pr.batch_runs([hidden, plain])[0]]
    assert all_runs == [len(brute(hidden)), 1] and all_runs[0] > 80
    with monkeypatch.context() as m:
        m.setattr(pr, "neighbour_proposals", lambda hashes, runs: np.zeros((0, 2), np.int64))
        assert len(pr.batch_runs([hidden])[0][0]) < 20
    monkeypatch.setattr(pr, "equal_contexts", lambda hashes, at, t: iter(()))
    assert len(pr.batch_runs([plain])[0][0]) == 0


def test_synchronising_positions_follow_their_context_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50, 300)
    words = np.concatenate([rng.integers(0, 50, 117), passage, rng.integers(0, 50, 61), passage])
    at = pr.synchronising_set(pr.PrefixHash(words), len(words), 16, np.zeros((0, 3), np.int64))
    inside = [set(at[(at >= b) & (at <= b + 300 - 32)] - b) for b in (117, 117 + 300 + 61)]
    assert inside[0] == inside[1] and len(inside[0]) > 10
    assert np.diff(at).max() <= 16


def test_a_wrong_hash_costs_time_only(monkeypatch):
    texts = [t for t in samples(9) if len(t) < 200][:8]
    true = pr.PrefixHash.of
    # every stretch longer than 40 words hashes alike
    monkeypatch.setattr(pr.PrefixHash, "of", lambda self, s, n: np.where(
        np.asarray(n) > 40, np.uint64(1), true(self, s, n)))
    for words, runs in zip(texts, pr.batch_runs(texts)[0]):
        assert set(map(tuple, runs.tolist())) <= set(brute(words))


def turned(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = turned(doc_id, text)
    runs = brute(words)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    found = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *found, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(left_over(words, runs)).encode()).hexdigest())


def digests(docs):
    found = pr.digests(pr.periodic_runs(docs, text=pr.repeat_some()))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query_rows(spark, make, corpus):
    rows = [(i, t[:6000] if t else t) for i, t in corpus]
    rows += [(5000 + k, "\t".join(b.decode() for b in t)) for k, t in enumerate(samples(20))]
    assert digests(make(rows)) == sorted((expected(i, t) for i, t in rows), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 4000 OR text IS NULL")
    assert digests(short) == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=repr)


def test_empty_table(make):
    found = pr.digests(pr.periodic_runs(make([(1, "a")]).where("false")))
    assert found.collect() == [] and found.columns[1:6] == [
        "n_runs", "start", "length", "period", "exponent_milli"]
