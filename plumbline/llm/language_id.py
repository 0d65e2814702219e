"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a distribution over languages by forward-backward: its own evidence
(affixes, character n-grams, the word itself where the training sample holds it often enough)
and learned transitions between neighbours, so that a text that switches languages is labelled
word by word. A document's language is the one with the largest mean marginal, its score that
mean. How sure the model is of a document is the mean of each word's largest marginal, whichever
language that is.

Training takes a bounded sample: of each label (of the ``max_labels`` most frequent ones, where
that is given) at most ``per_label`` documents, drawn by a hash of their identifier, of each at
most ``sample_chars`` characters, and fewer documents per label where all labels together would
exceed ``SAMPLE_TOTAL`` characters. Training chains mix stretches of documents of different
languages, which teaches the transitions. The model is broadcast and has at most ``MODEL_CELLS``
weights: with very many labels features share cells, no label is left out. Training works in
blocks of chains, whose size bounds its memory beside the sample and the model. Prediction reads
whole texts; a text is cut into chains of ``CHAIN`` words. A run of more than ``LONGEST`` letters,
as in scripts without spaces, is cut into consecutive words of a chain.

Defined cases: a null text or one without a letter (digits, fractions and other numbers are none)
is ``und`` with score 0; without any labelled document everything is ``und``; a null identifier is
not held out and not learned from; rows that repeat are predicted alike; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

UNKNOWN = "und"
#: Documents the model is less sure of are rejected; switched languages and short texts stay above.
LEAST_SURE = 0.4
PER_LABEL = 600
SAMPLE_CHARS = 1500
SAMPLE_TOTAL = 32_000_000
MODEL_CELLS = 1 << 25
LONGEST = 40
CHAIN = 128
REMEMBERED_WORDS = 200_000
_DIMENSIONS = 1 << 16
_HASHES = 1 << 40
_LEXICON_COUNT = 4
_EPOCHS = 6
#: Chains of a training block.
_BLOCK = 512
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, long ones cut."""
    found = []
    for run in _RUN.findall(text.lower()):
        # the pattern also takes numbers that are no digits, such as fractions
        parts = [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
        for word in parts:
            if len(word) <= LONGEST:
                found.append(word)
            else:
                found += [word[k:k + LONGEST] for k in range(0, len(word), LONGEST)]
    return found


def features(word: str, lexicon: set[str], dimensions: int = _DIMENSIONS) -> list[int]:
    """Hashed features of a lower-case word."""
    marked = f"^{word}$"
    found = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3, 4)]
    found += [f"b{marked[i:i + 2]}" for i in range(len(marked) - 1)]
    found += [f"t{marked[i:i + 3]}" for i in range(len(marked) - 2)]
    found.append(f"w{word}" if word in lexicon else "w")
    return [zlib.crc32(f.encode()) % dimensions for f in found]


class Model:
    """Weights per feature and label, transitions between labels, and the lexicon."""

    def __init__(self, labels: list[str], lexicon: set[str]):
        self.labels, self.lexicon = labels, lexicon
        self.dimensions = _DIMENSIONS
        while self.dimensions > 1 and self.dimensions * len(labels) > MODEL_CELLS:
            self.dimensions //= 2
        self.weights = np.zeros((self.dimensions, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def cells(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all words one after the other, and where each word's begin."""
        flat, begin = [], []
        for w in words:
            begin.append(len(flat))
            flat += features(w, self.lexicon, self.dimensions)
        return np.array(flat, np.int32), np.array(begin, np.int64)

    def evidence(self, words: list[str]) -> np.ndarray:
        flat, begin = self.cells(words)
        if not len(begin):
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.weights[flat], begin, axis=0).astype(np.float64)

    def marginals(self, evidence: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of padded chains (chain, place, label) and expected moves.

        ``mask`` is 1 on words; padding follows a chain's words.
        """
        chains, places, n = evidence.shape
        local = np.exp(evidence - evidence.max(axis=2, keepdims=True))
        move = np.exp(self.moves)
        forward = np.empty_like(local)
        forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, places):
            x = forward[:, t - 1] @ move * local[:, t]
            forward[:, t] = x / x.sum(axis=1, keepdims=True)
        back = np.ones((chains, n))
        found = np.empty_like(local)
        moved = np.zeros((n, n))
        for t in range(places - 1, -1, -1):
            x = forward[:, t] * back
            found[:, t] = x / x.sum(axis=1, keepdims=True)
            if t:
                ahead = local[:, t] * back
                inside = mask[:, t, None]
                total = ((forward[:, t - 1] @ move) * ahead).sum(axis=1, keepdims=True)
                moved += (forward[:, t - 1] * inside / total).T @ ahead * move
                # beyond the end of a chain nothing is known
                back = np.where(inside > 0, ahead @ move.T, 1.0)
                back /= back.sum(axis=1, keepdims=True)
        return found, moved


def _chains(texts: list[tuple[int, np.ndarray]], length: int, random) -> list[list[np.ndarray]]:
    """Chains as (word numbers, labels), in random order; a third mix stretches of two documents."""
    chains = []
    for label, words in texts:
        for at in range(0, len(words), length):
            part = words[at:at + length]
            chains.append([part, np.full(len(part), label, np.int32)])
    for i in range(0, len(chains) - 1, 3):
        other = chains[random.integers(len(chains))]
        cut, take = random.integers(1, length), random.integers(1, length)
        chains[i] = [np.concatenate([mine[:cut], theirs[:take]])[:length]
                     for mine, theirs in zip(chains[i], other)]
    return [chains[i] for i in random.permutation(len(chains))]


class _Block:
    """Some chains with the features of their words."""

    def __init__(self, chains: list[list[np.ndarray]], cells: np.ndarray, begin: np.ndarray, labels: int):
        longest = max(len(words) for words, _ in chains)
        words = np.zeros((len(chains), longest), np.int64)
        self.gold = np.zeros((len(chains), longest), np.int32)
        self.mask = np.zeros((len(chains), longest))
        for i, (w, y) in enumerate(chains):
            words[i, :len(w)], self.gold[i, :len(y)], self.mask[i, :len(w)] = w, y, 1
        known, place = np.unique(words, return_inverse=True)
        self.place = place.reshape(words.shape)
        self.sizes = begin[known + 1] - begin[known]
        self.begin = np.cumsum(self.sizes) - self.sizes
        at = np.repeat(begin[known] - self.begin, self.sizes) + np.arange(self.sizes.sum())
        self.cells = cells[at]
        self.moves = np.zeros((labels, labels))
        both = self.mask[:, 1:] > 0
        np.add.at(self.moves, (self.gold[:, :-1][both], self.gold[:, 1:][both]), 1)

    def gradients(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        labels = len(model.labels)
        evidence = np.add.reduceat(model.weights[self.cells], self.begin, axis=0).astype(np.float64)
        found, moved = model.marginals(evidence[self.place], self.mask)
        error = (np.arange(labels) == self.gold[:, :, None]) - found
        error *= self.mask[:, :, None]
        up = np.empty(model.weights.shape, np.float32)
        for k in range(labels):
            per_word = np.bincount(self.place.ravel(), error[:, :, k].ravel(), len(self.begin))
            up[:, k] = np.bincount(self.cells, np.repeat(per_word, self.sizes), model.dimensions)
        total = self.mask.sum()
        return (up / np.float32(total) - np.float32(1e-6) * model.weights,
                (self.moves - moved) / total - 1e-6 * model.moves)


def fit(texts: list[tuple[str, str]], length: int = 40, epochs: int = _EPOCHS, seed: int = 7) -> Model:
    """Train on (label, text) pairs by Adam on the penalised likelihood, block by block."""
    split = [(label, words_of(text)) for label, text in texts]
    split = [(label, words) for label, words in split if words]
    labels = sorted({label for label, _ in split})
    counts = Counter(w for _, words in split for w in words)
    model = Model(labels, {w for w, n in counts.items() if n >= _LEXICON_COUNT})
    if len(labels) < 2:
        return model
    numbers = {w: k for k, w in enumerate(sorted(counts))}
    places = {label: k for k, label in enumerate(labels)}
    docs = [(places[label], np.array([numbers[w] for w in words], np.int32)) for label, words in split]
    cells, begin = model.cells(list(numbers))
    begin = np.append(begin, len(cells))
    del split, counts, numbers
    chains = _chains(docs, length, np.random.default_rng(seed))
    # a corpus of few chains is seen more often, so that every model takes at least some steps
    blocks = -(-len(chains) // _BLOCK)
    epochs = max(epochs, -(-10 * epochs // blocks))
    state = [np.zeros_like(x) for x in (model.weights, model.weights, model.moves, model.moves)]
    step, steps = 0, epochs * blocks
    for _ in range(epochs):
        for at in range(0, len(chains), _BLOCK):
            step += 1
            rate = 0.1 * (1 - step / (steps + 1))
            gradients = _Block(chains[at:at + _BLOCK], cells, begin, len(labels)).gradients(model)
            for k, (value, gradient) in enumerate(zip((model.weights, model.moves), gradients)):
                mean, square = state[2 * k], state[2 * k + 1]
                mean += 0.1 * (gradient - mean)
                square += 0.01 * (gradient * gradient - square)
                value += rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return model


class Labeller:
    """Predicts documents; remembers the evidence of words it has met."""

    def __init__(self, model: Model, remembered: int = REMEMBERED_WORDS):
        self.model, self.remembered = model, remembered
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.labels)))

    def _indices(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list({w for words in texts for w in words}.difference(self.places))
        if new:
            if len(self.places) + len(new) > self.remembered:
                self.forget()
                new = list({w for words in texts for w in words})
            for k, w in enumerate(new, len(self.places)):
                self.places[w] = k
            parts = [self.model.evidence(new[i:i + 20_000]) for i in range(0, len(new), 20_000)]
            self.rows = np.concatenate([self.rows, *parts])
        places = self.places
        return [np.array([places[w] for w in words], np.int64) for words in texts]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, how sure) of every text."""
        labels = self.model.labels
        split = [words_of(t) if t else [] for t in texts]
        if not labels:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        sums, sure = np.zeros((len(texts), len(labels))), np.zeros(len(texts))
        pieces = [(doc, ids[at:at + CHAIN]) for doc, ids in enumerate(self._indices(split))
                  for at in range(0, len(ids), CHAIN)]
        pieces.sort(key=lambda p: len(p[1]))
        for at in range(0, len(pieces), 1024):
            group = pieces[at:at + 1024]
            longest = len(group[-1][1])
            index = np.zeros((len(group), longest), np.int64)
            mask = np.zeros((len(group), longest))
            for k, (_, ids) in enumerate(group):
                index[k, :len(ids)] = ids
                mask[k, :len(ids)] = 1
            found, _ = self.model.marginals(self.rows[index], mask)
            docs = [doc for doc, _ in group]
            np.add.at(sums, docs, (found * mask[:, :, None]).sum(axis=1))
            np.add.at(sure, docs, (found.max(axis=2) * mask).sum(axis=1))
        out = []
        for words, total, each in zip(split, sums, sure.tolist()):
            if not words:
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                best = int(total.argmax())
                out.append((labels[best], min(1.0, float(total[best] / len(words))),
                            min(1.0, each / len(words))))
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                    per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS,
                    max_labels: int | None = None) -> DataFrame:
    """At most ``per_label`` labelled documents of each label, none of them held out.

    ``max_labels`` leaves out all but that many of the most frequent labels.
    """
    rows = docs.where(
        F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
        & ~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("id"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"),
        F.substring(text_col, 1, sample_chars).alias("text"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    counts = (counts if max_labels is None else counts.limit(max_labels)).collect()
    if not counts:
        return rows.limit(0).withColumn("k", F.lit(0))
    per_label = max(1, min(per_label, SAMPLE_TOTAL // (sample_chars * len(counts))))
    # a label of n documents sends about twice the sample to the sort, whatever n is
    share = F.create_map(*[F.lit(x) for r in counts for x in (
        r.label, min(_HASHES, 2 * per_label * _HASHES // r.n + 1))])
    order = Window.partitionBy("label").orderBy("h", "id")
    return (rows.where(F.pmod("h", F.lit(_HASHES)) < share[F.col("label")])
            .withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label)
            .select("label", "text", "k"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS,
          max_labels: int | None = None) -> Model:
    rows = training_sample(
        docs, id_col, text_col, lang_col, per_label, sample_chars, max_labels).collect()
    return fit([(r.label, r.text) for r in sorted(rows, key=lambda r: (r.label, r.k, r.text))])


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(broadcast.value)
        for batch in batches:
            at, texts = 0, batch.column(2).to_pylist()
            found: list[tuple[str, float, float]] = []
            while at < len(texts):                # a few MB of text at a time
                until, size = at, 0
                while until < len(texts) and (until == at or size < 1 << 21):
                    size += len(texts[until] or "")
                    until += 1
                found += labeller.label(texts[at:until])
                at = until
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The identifier, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(
        F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(_predict(shared), "id long, held_out boolean, lang_pred string, score double"
                 ).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text",
                    least_sure: float = LEAST_SURE) -> DataFrame:
    """The rows of ``docs`` whose words' languages the model is sure of by ``least_sure`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    place = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = labeller.label(part.column(place).to_pylist())
                yield part.filter(pa.array([f[0] != UNKNOWN and f[2] >= least_sure for f in found]))

    return docs.mapInArrow(run, schema)
