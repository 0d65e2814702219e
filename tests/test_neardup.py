import itertools
import random
import re
from difflib import SequenceMatcher

import pytest

from plumbline.functions.similarity import character_bits
from plumbline.operators.neardup import (
    VARIANTS, _common_texts, _segments, _short_lengths, candidates, near_duplicates, pair_evidence)


def _email(v):
    return (v.strip().lower() or None) if v is not None else None


def _phone(v):
    return (re.sub(r"\D+", "", v) or None) if v is not None else None


def _block(row):
    email, phone = _email(row[2]), _phone(row[3])
    return "email:" + email[:3] if email else ("phone:" + phone[-6:] if phone else None)


def brute_force(rows):
    """Number of matching record pairs, and the similar pairs of different names."""
    first = {}
    for r in rows:
        first.setdefault((_block(r), (r[1] or "").strip().lower()), r[0])
    pairs, similar = 0, set()
    for a, b in itertools.combinations(rows, 2):
        block = _block(a)
        if block is None or block != _block(b) or a[1:] == b[1:]:
            continue
        match = bool(_email(a[2])) and _email(a[2]) == _email(b[2])
        match |= bool(_phone(a[3])) and _phone(a[3]) == _phone(b[3])
        x, y = sorted(((r[1] or "").strip().lower() for r in (a, b)),
                      key=lambda n: first[block, n])
        if x and y and SequenceMatcher(None, x, y).ratio() >= 0.82:
            match = True
            if x != y:
                similar.add((block, x, y))
        pairs += match
    return pairs, similar


@pytest.fixture(scope="module")
def people():
    random.seed(3)
    given = ["anna", "anne", "hanna", "john", "jon", "johan", "maria", "marie", "mario", "Peter", " petra ", "x"]
    family = ["smith", "smyth", "smithe", "meyer", "meier", "maier", "o'neil", "oneill"]
    rows = []
    for i in range(220):
        name = f"{random.choice(given)} {random.choice(family)}" if random.random() > 0.05 else None
        # one mailbox is shared by about a third of all people
        email = random.choice([None, f"joe{random.randint(0, 15)}@x.com", "kim@y.org "])
        phone = random.choice([None, f"+1 555 {random.randint(0, 30):04d}"])
        rows.append((i, name, email, phone, random.randint(0, 3)))
    return rows + [(300 + i, *rows[i][1:]) for i in range(40)]


@pytest.mark.parametrize("cell_names", [2000, 5])
def test_against_brute_force(spark, people, cell_names):
    df = spark.createDataFrame(people, "_row_id long, name string, email string, phone string, z int")
    rows = near_duplicates(df, "name", "email", "phone", cell_names).collect()
    pairs, similar = brute_force(people)
    assert sum(r.pair_count for r in rows) == pairs
    assert {(r.block, r.name_a, r.name_b) for r in rows if r.kind == "similar_name"} == similar


def test_result_stays_linear_for_a_shared_mailbox(spark):
    df = spark.range(3000).selectExpr(
        "id AS _row_id", "md5(string(id)) AS name", "'office@example.com' AS email", "string(id) AS phone")
    rows = near_duplicates(df, "name", "email", "phone").where("kind = 'email'").collect()
    assert [(r.record_count, r.pair_count) for r in rows] == [(3000, 3000 * 2999 // 2)]


def test_missing_contacts_do_not_meet(spark):
    df = spark.createDataFrame([(1, "ann", None, None), (2, "ann", None, None)],
                               "_row_id long, name string, email string, phone string")
    assert near_duplicates(df, "name", "email", "phone").count() == 0


def odd_name(rng):
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["anna", "anne", "johan", "maria", "x", "al"]) + " " + rng.choice(["smith", "meyer"])
    if kind < 0.6:
        return "".join(rng.choices("ab\u00e9\u4e2d", k=rng.randint(1, 14)))
    if kind < 0.75:
        return "".join(rng.choices("ab c", k=rng.randint(25, 60)))
    return f"person {rng.randint(0, 500):06d}"


@pytest.mark.parametrize("direct_names, common_pairs", [(48, 4096), (1, 4096), (1, 0)])
def test_no_similar_pair_is_lost(spark, direct_names, common_pairs):
    rng = random.Random(7)
    names = {(b, odd_name(rng)) for b in "one two three".split() for _ in range(120 if b == "one" else 30)}
    rows = [(b, n, i) for i, (b, n) in enumerate(sorted(names))]
    table = spark.createDataFrame(rows, "block string, name string, first_row long")
    found = candidates(table, direct_names=direct_names, common_pairs=common_pairs).collect()
    pairs = {(r.block, r.name_a, r.name_b) for r in found}
    wanted = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2)
              if a[0] == b[0] and SequenceMatcher(None, a[1], b[1]).ratio() >= 0.82}
    assert len(pairs) == len(found) and wanted <= pairs and len(wanted) > 100
    assert all(r.first_row_a < r.first_row_b for r in found)


def test_evidence_names_what_agrees_and_differs(spark, people):
    df = spark.createDataFrame(people, "_row_id long, name string, email string, phone string, z int")
    found = pair_evidence(df, "name", "email", "phone").collect()
    by_id = {r[0]: r for r in people}
    linked = {}

    def root(i):
        while linked.get(i, i) != i:
            i = linked[i]
        return i

    for r in found:
        a, b = by_id[r.row_a], by_id[r.row_b]
        assert r.row_a <= r.row_b and _block(a) == _block(b)
        matching, conflicting, similarity = [], [], 0.0
        for field, clean, k in (("email", _email, 2), ("phone", _phone, 3)):
            if clean(a[k]) and clean(b[k]):
                (matching if clean(a[k]) == clean(b[k]) else conflicting).append(field)
        x, y = ((v[1] or "").strip().lower() for v in (a, b))
        if x and y:
            similarity = SequenceMatcher(None, x, y).ratio()
            if similarity >= 0.82:
                matching.append("name" if x == y else "name~")
            elif x != y:
                conflicting.append("name")
        assert (list(r.matching_fields), list(r.conflicting_fields)) == (matching, conflicting)
        assert matching and r.similarity == pytest.approx(similarity, abs=6e-4)
        assert (r.confidence, r.recommended_action) == ("LOW", "Review manually; do not auto-merge or delete.")
        linked[root(r.row_b)] = root(r.row_a)
    # records that match, directly or through others, are linked, and no others
    wanted = {}

    def other_root(i):
        while wanted.get(i, i) != i:
            i = wanted[i]
        return i

    contact = {}
    for r in people:
        contact.setdefault((_block(r), (r[1] or "").strip().lower(), _email(r[2]), _phone(r[3])), r[0])
    first = {r[0]: contact[_block(r), (r[1] or "").strip().lower(), _email(r[2]), _phone(r[3])] for r in people}
    for a, b in itertools.combinations(people, 2):
        if _block(a) and _block(a) == _block(b):
            x, y = ((v[1] or "").strip().lower() for v in (a, b))
            if ((_email(a[2]) and _email(a[2]) == _email(b[2])) or (_phone(a[3]) and _phone(a[3]) == _phone(b[3]))
                    or (x and y and SequenceMatcher(None, x, y).ratio() >= 0.82)):
                wanted[other_root(first[b[0]])] = other_root(first[a[0]])
    ids = set(first.values())
    groups = lambda find: {frozenset(i for i in ids if find(i) == k) for k in {find(i) for i in ids}}
    assert groups(root) == groups(other_root)


def test_evidence_stays_linear_for_a_shared_mailbox(spark):
    df = spark.range(3000).selectExpr(
        "id AS _row_id", "md5(string(id)) AS name", "'office@example.com' AS email", "string(id) AS phone")
    assert pair_evidence(df, "name", "email", "phone").count() == 2999


def test_pairs_of_one_hot_block_stay_below_its_square(spark):
    rng = random.Random(1)
    syllables = [c + v for c in "bcdfghjklmnprstvw" for v in "aeiou"]
    names = sorted({"".join(rng.choices(syllables, k=rng.randint(2, 4))) + " smith" for _ in range(4000)})
    counts = []
    for n in (1000, 2000):
        rows = [("one", name, i) for i, name in enumerate(rng.sample(names, n))]
        counts.append(candidates(spark.createDataFrame(rows, "block string, name string, first_row long")).count())
    assert counts[1] < 5 * counts[0] and counts[1] < 2000 * 1999 // 2 * 0.02


@pytest.mark.parametrize("variants", [0, 60, 256])
def test_names_that_meet_by_texts_or_segments_are_all_found(spark, variants):
    rng = random.Random(11)
    names = {(b, odd_name(rng)) for b in ("one", "two") for _ in range(150)}
    names |= {("one", "".join(rng.choices("aab", k=rng.randint(1, 17)))) for _ in range(80)}
    rows = [(b, n, i) for i, (b, n) in enumerate(sorted(names))]
    table = spark.createDataFrame(rows, "block string, name string, first_row long")
    found = candidates(table, direct_names=1, common_pairs=0, variants=variants).collect()
    pairs = {(r.block, r.name_a, r.name_b) for r in found}
    wanted = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2)
              if a[0] == b[0] and SequenceMatcher(None, a[1], b[1]).ratio() >= 0.82}
    assert len(pairs) == len(found) and wanted <= pairs and len(wanted) > 100


def test_short_names_of_a_hot_block_meet_only_by_what_they_share(spark):
    # 12 random characters have a segment in common with many names, ten in order with hardly any
    lengths = _short_lengths(VARIANTS)
    assert (12, 12, 10) in lengths and (12, 13, 11) in lengths
    names = spark.range(3000).selectExpr(
        "'one' AS block", "substr(md5(string(id)), 1, 12) AS name", "id AS first_row")
    sized = names.selectExpr("*", "length(name) AS len", "array(12) AS lengths",
                             "inline(array(" + character_bits("name") + "))")
    assert _segments(sized, False, lengths).isEmpty() and _segments(sized, True, lengths).isEmpty()
    assert _common_texts(sized, lengths).count() < 30
