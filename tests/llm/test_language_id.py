"""Language labels: held-out accuracy, code-switched text and odd rows."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import language_id as lid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tus"], "bb": ["sch", "ein", "ung", "der"],
             "cc": ["oi", "eau", "é", "la"]}


def prose(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, " ".join(prose(rng, lang, rng.randint(3, 80))), lang)
            for i in range(150) for lang in [rng.choice(list(SYLLABLES))]]


@pytest.fixture(scope="module")
def model(rows):
    return lid.fit([(lang, text) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1])


def test_held_out_accuracy(spark, rows):
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 | 34 !", "cc"), (1005, "\u00bd \u00b2 \u2167 \u2460 12", "aa"), (None, "kalomi", "aa"),
           (1003, rows[0][1], None), (1003, rows[0][1], None), (1004, "kalo " * 5000, "bb")]
    table = spark.createDataFrame(
        [(i, t, lang, "x", 1.0) for i, t, lang in rows + odd],
        "doc_id long, text string, lang string, label string, score double")
    found = lid.identify(table, lid.train(table)).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.lang_pred == truth[r.doc_id] for r in found if r.doc_id in truth and r.held_out]
    assert sum(right) >= 0.95 * len(right) and len(right) > 20
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002, 1005))
    assert by_id[None].lang_pred == "aa" and by_id[1003].lang_pred == rows[0][2]
    kept = lid.keep_identified(table, lid.train(table))
    assert kept.columns == table.columns
    assert not {1000, 1001, 1002, 1005} & {r.doc_id for r in kept.collect()}


def test_code_switched_words_get_their_own_labels(model):
    rng = random.Random(2)
    words = prose(rng, "aa", 12) + prose(rng, "bb", 12)
    found, _ = model.marginals(model.evidence(words)[None], np.ones((1, 24)))
    best = [model.labels[k] for k in found[0].argmax(axis=1)]
    assert sum(a == b for a, b in zip(best, ["aa"] * 12 + ["bb"] * 12)) >= 22


def test_marginals_equal_summing_all_paths(model):
    rng = np.random.default_rng(0)
    evidence, n = rng.normal(size=(1, 4, 3)), 3
    model.moves, kept = rng.normal(size=(3, 3)), model.moves
    try:
        total, each = 0.0, np.zeros((4, 3))
        for path in np.ndindex(*[n] * 4):
            score = np.exp(sum(evidence[0, t, y] for t, y in enumerate(path))
                           + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
            total += score
            for t, y in enumerate(path):
                each[t, y] += score
        found, moved = model.marginals(evidence, np.ones((1, 4)))
        padded = np.concatenate([evidence, rng.normal(size=(1, 3, 3))], axis=1)
        mask = np.array([[1, 1, 1, 1, 0, 0, 0]], float)
        assert np.allclose(found[0], each / total)
        assert np.allclose(model.marginals(padded, mask)[0][0, :4], each / total)
        assert np.isclose(moved.sum(), 3)
    finally:
        model.moves = kept


def test_without_labels_everything_is_unknown(spark):
    table = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in lid.identify(table, lid.train(table)).collect()] == [("und", 0.0)]
    empty = table.limit(0)
    assert lid.identify(empty, lid.train(empty)).count() == 0


def test_runs_without_spaces_are_judged_whole(model):
    rng = random.Random(4)
    run = "".join(prose(rng, "aa", 30))[:40] + "".join(prose(rng, "bb", 200))
    assert lid.Labeller(model).label([run])[0][0] == "bb"
    assert sum(map(len, lid.words_of(run))) == len(run)


def test_rare_labels_are_learned_unless_a_limit_is_given(spark):
    table = spark.createDataFrame(
        [(i, f"text of {i}", f"l{i % 600}") for i in range(2400)],
        "doc_id long, text string, lang string")
    args = "doc_id", "text", "lang"
    taken = {r.label for r in lid.training_sample(table, *args).select("label").collect()}
    known = {r.lang for r in table.where(~lid.held_out("doc_id")).select("lang").collect()}
    assert taken == known and len(known) > 500
    small = table.where("doc_id % 600 < 3")
    assert len(lid.train(small, max_labels=2).labels) == 2
    assert len(lid.train(small).labels) == 3


def test_switched_languages_are_sure_and_noise_is_not(model):
    rng = random.Random(6)
    mixed = " ".join(w for _ in range(20) for lang in SYLLABLES for w in prose(rng, lang, 6))
    noise = " ".join("".join(rng.choices("qwxzjy", k=rng.randint(2, 9))) for _ in range(200))
    (_, score, sure), = lid.Labeller(model).label([mixed])
    assert score < 0.6 and sure > 0.85
    assert lid.Labeller(model).label([noise])[0][2] < sure


def test_many_labels_keep_the_model_bounded(monkeypatch):
    monkeypatch.setattr(lid, "MODEL_CELLS", 1 << 12)
    model = lid.fit([(f"l{k}", f"{chr(97 + k)}{chr(97 + k)}x word" * 3) for k in range(20)])
    assert len(model.labels) == 20 and model.weights.size <= 1 << 12


def test_training_memory_follows_the_block():
    import tracemalloc

    rng = random.Random(7)
    texts = [(lang, " ".join(w + "".join(rng.choices("abc", k=3)) for w in prose(rng, lang, 200)) + " " + "x" * 40)
             for lang in SYLLABLES for _ in range(200)]
    tracemalloc.start()
    lid.fit(texts, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
