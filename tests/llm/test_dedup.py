"""Operators that remove repeats, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import (
    automaton_dedup, exact_dedup, jaccard_join, kernels, line_dedup, queries, repeats, suffix_dedup)
from plumbline.llm.components import components


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def brute_bytes(rows, size):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + size] for _, b in bodies for k in range(len(b) - size + 1))
    for ident, body in bodies:
        gone = bytearray(len(body))
        for k in range(len(body) - size + 1):
            if seen[body[k:k + size]] > 1:
                gone[k:k + size] = b"\1" * size
        kept = bytes(c for c, g in zip(body, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        yield ident, len(body), sum(gone), spans, sha(kept)


@pytest.mark.parametrize("size,spread", [(400, 96), (100, 30), (24, 20)])
def test_suffix_dedup(make, corpus, size, spread):
    found = suffix_dedup.digests(suffix_dedup.repeated_spans(make(corpus), size=size, spread=spread))
    assert rows_of(found) == Counter(brute_bytes(corpus, size))


def test_suffix_dedup_judges_bytes_not_words(make):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))
    short, long = prose(80)[:399], prose(80)[:400]
    assert min(len(short.split()), len(long.split())) > 50
    rows = [(k, f"{prose(90)}{k}{p}{k + 4}{prose(90)}") for k, p in enumerate([short, short, long, long])]
    rows.append((4, prose(300)))
    found = suffix_dedup.digests(suffix_dedup.repeated_spans(make(rows)))
    assert rows_of(found) == Counter(brute_bytes(rows, 400))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {0: 0, 1: 0, 2: 400, 3: 400, 4: 0}


def test_suffix_dedup_cuts_long_texts(make, corpus):
    found = suffix_dedup.digests(suffix_dedup.repeated_spans(
        make(corpus), size=100, spread=30, slice_units=500))
    assert rows_of(found) == Counter(brute_bytes(corpus, 100))


def brute_windows(rows, size):
    order = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: -1 << 70 if i is None else i
    for ident, words in split:
        for k in range(len(words) - size + 1):
            w, here = tuple(words[k:k + size]), (key(ident), k)
            order[w] = min(order.get(w, here), here)
    for ident, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if order[tuple(words[k:k + size])] < (key(ident), k):
                gone[k:k + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        yield ident, len(words), sum(gone), sha(kept)


@pytest.mark.parametrize("size,spread,shard", [(20, 11, 4096), (20, 11, 3), (8, 6, 2)])
def test_automaton_dedup(make, corpus, size, spread, shard):
    found = automaton_dedup.digests(automaton_dedup.earlier_spans(
        make(corpus), size=size, spread=spread, shard_ranges=shard))
    assert rows_of(found) == Counter(brute_windows(corpus, size))


def test_automaton_dedup_cuts_long_texts(make, corpus):
    found = automaton_dedup.digests(automaton_dedup.earlier_spans(make(corpus), slice_units=150))
    assert rows_of(found) == Counter(brute_windows(corpus, 20))


def test_suffix_automaton_knows_first_occurrences():
    automaton = automaton_dedup.SuffixAutomaton()
    automaton.add([1, 2, 3, 1, 2])
    automaton.add([2, 3, 1])
    assert dict(automaton.first_ends([9, 1, 2, 3, 1], 2)) == {1: 1, 2: 2, 3: 3}
    assert list(automaton.first_ends([2, 2], 2)) == []       # not across a separator


def brute_lines(rows, size):
    split = [(i, [] if t is None else t.split("\n")) for i, t in rows]
    key = lambda i: -1 << 70 if i is None else i
    first = {}
    for ident, lines in split:
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k:k + size])
            if any(c.isalnum() for x in w for c in x):
                first[w] = min(first.get(w, (key(ident), k)), (key(ident), k))
    for ident, lines in split:
        gone = [False] * len(lines)
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k:k + size])
            if w in first and first[w] < (key(ident), k):
                gone[k:k + size] = [True] * size
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        yield ident, len(lines), sum(gone), sha(kept)


def test_line_dedup(make, corpus):
    texts = corpus + [(2000 + i, "\n".join(["a", "b", "c", "d"] * 3 + [str(i)])) for i in range(5)]
    texts += [(2100, "\n\n\n\n\n"), (2101, "\n\n\n\n"), (2102, "a\nb\nc"), (2103, "b\nc\nd\n9")]
    found = line_dedup.digests(line_dedup.dedup_lines(make(texts)))
    assert rows_of(found) == Counter(brute_lines(texts, 3))
    assert any(n for _, _, n, _ in brute_lines(texts, 3))


def brute_components(rows, size, percent):
    sets = defaultdict(set)
    for ident, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets[ident] |= {tuple(words[k:k + size]) for k in range(max(0, len(words) - size + 1))} or (
            {tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    idents = sorted(sets, key=lambda i: (i is not None, i or 0))
    for k, a in enumerate(idents):
        for b in idents[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                if x != y:
                    first = min(x, y, key=idents.index)
                    parent[x] = parent[y] = first
    return Counter((i, len(sets[i]), find(i)) for i, _ in rows)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (3, 50)])
def test_jaccard_join(make, corpus, size, percent):
    # identifiers whose rows differ would be one document; the fixture has none
    found = jaccard_join.near_duplicates(make(corpus), shingle=size, percent=percent)
    assert rows_of(found) == brute_components(corpus, size, percent)


def test_jaccard_chains_reach_the_end(make):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[k:k + 100])) for k in range(60)]      # neighbours link, ends do not
    found = jaccard_join.near_duplicates(make(rows))
    assert {r.component_id for r in found.collect()} == {0}
    kept = jaccard_join.keep_representatives(make(rows)).collect()
    assert [(r.doc_id, r.node, r.tag) for r in kept] == [(0, 3, "t")]


def test_a_common_passage_joins_only_texts_that_are_mostly_passage(make, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(60))) for i in range(240)]
    rows += [(1000 + i, f"{passage} end{i}") for i in range(6)]          # these link
    joined = []
    first = jaccard_join._first_pairs
    monkeypatch.setattr(jaccard_join, "_first_pairs",
                        lambda members, percent: joined.append(members.count()) or first(members, percent))
    found = jaccard_join.near_duplicates(make(rows), shingle=5, percent=80)
    assert rows_of(found) == brute_components(rows, 5, 80)
    assert joined[0] <= 20


def test_a_family_without_its_first_one_is_linked_without_its_pairs(make, monkeypatch):
    base = [f"w{k}" for k in range(160)]

    def edited(i, places):
        return " ".join(f"e{i}" if k in places else w for k, w in enumerate(base))

    # the first one holds what all others share but is too long; they link with each other
    rows = [(0, " ".join(base + [f"more{k}" for k in range(35)]))]
    rows += [(i, edited(i, {10 + i})) for i in range(1, 121)]
    verified = []
    links = jaccard_join._links

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_links", counted)
    found = jaccard_join.near_duplicates(make(rows), shingle=5, percent=80)
    assert rows_of(found) == brute_components(rows, 5, 80)
    assert sum(verified) <= 30 * len(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (20, 10), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {
        **{i: 1 for i in range(1, 7)}, 10: 10, 11: 10, 20: 10}


def brute_owners(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[text or ""].append(ident)
    for ident, text in rows:
        same = groups[text or ""]
        keep = max((i for i in same if i is not None), default=None)
        yield ident, keep, len(same), ident == keep, sha(text or "")


@pytest.mark.parametrize("spill", [64 << 20, 2000])
def test_exact_dedup(make, corpus, spill):
    rows = corpus + [(None, "nobody's"), (5000, "x" * 2999 + "y"), (5001, "x" * 2999)]
    found = exact_dedup.exact_dedup(make(rows), spill_bytes=spill)
    assert rows_of(found) == Counter(brute_owners(rows))


def test_exact_dedup_keeps_columns_and_smallest(make):
    rows = [(3, "a"), (1, "a"), (2, None), (4, "")]
    kept = exact_dedup.keep_owners(make(rows), keep="smallest").collect()
    assert sorted((r.doc_id, r.tag, r.keep_id) for r in kept) == [(1, "t", 5), (2, "t", 5)]


def test_radix_trie_holds_prefixes_and_spills():
    trie = exact_dedup.RadixTrie(larger_wins=False)
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"\xff\0", b"\xff"]
    for k, key in enumerate(keys + keys):
        trie.insert(key, k, 1)
    assert {t.terminal: (t.owner, t.count) for t in trie.terminals()} == {
        key: (k, 2) for k, key in enumerate(keys)}
    cut = {t.terminal for t in trie.cut_largest()}
    assert cut == {b"a", b"ab", b"abc", b"abd"}
    assert {t.terminal for t in trie.terminals()} == set(keys) - cut


def test_empty_tables(make):
    empty = make([])
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert automaton_dedup.earlier_spans(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_every_operator_is_registered():
    names = queries.registered()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.statements()) <= set(names)


@pytest.fixture(scope="module")
def crowded(corpus):
    """Identifiers with several texts, and many rows without one."""
    texts = [t for _, t in corpus if t and len(t) > 200]
    rows = [(7, texts[0]), (7, texts[1][:150]), (7, texts[2]), (7, texts[3]), (9, texts[0][:60]), (9, texts[4])]
    return rows + [(None, f"{k} {texts[k % 20][:400]} {k}") for k in range(60)] + [(i, t) for i, t in corpus if i]


@pytest.mark.parametrize("bits", [24, 4])
def test_texts_of_one_identifier_are_told_apart(make, crowded, bits, monkeypatch):
    monkeypatch.setitem(repeats._MASK, "tag", (1 << bits) - 1)
    found = suffix_dedup.digests(suffix_dedup.repeated_spans(make(crowded), size=100, spread=30))
    assert rows_of(found) == Counter(brute_bytes(crowded, 100))
    # which of several texts without an order comes first is open, what is unique to one is not
    spans = automaton_dedup.earlier_spans(make(crowded))
    whole = {(r.doc_id, r.n_words) for r in spans.collect()}
    assert whole == {(i, len((t or "").encode().split())) for i, t in crowded}


def test_ten_thousand_rows_without_an_identifier(spark):
    rows = spark.range(10_000).selectExpr(
        "CAST(NULL AS bigint) AS doc_id", "concat_ws(' ', transform(sequence(1, 30), k -> id * 31 + k)) AS text")
    found = automaton_dedup.digests(automaton_dedup.earlier_spans(rows))
    assert found.where("n_words = 30 AND doc_id IS NULL").count() == 10_000
    lost = found.where("n_removed > 0").count()
    assert lost == 0


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_patterned_long_words_are_not_taken_for_each_other(make):
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    same = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {one}")]
    found = {r.doc_id: r.n_removed for r in automaton_dedup.digests(automaton_dedup.earlier_spans(make(rows))).collect()}
    assert found == {1: 0, 2: 0, 3: 20}
    parts = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(make([(1, one), (2, two), (3, one)])).collect()}
    assert parts == {1: 1, 2: 2, 3: 1}


def test_words_of_many_megabytes_count_once():
    data = (b"a " + b"x" * (3 << 20) + b" b " + b"y" * 100 + b" ") * 2 + b"z" * (5 << 20)
    flat = np.frombuffer(data, np.uint8)
    words, below = kernels.word_hashes(flat, np.array([0, len(flat)]))
    assert len(words) == below[-1] == 9 and len(set(words.tolist())) == 5
    assert words[:4].tolist() == words[4:8].tolist()
