"""Quality rules, then robust multivariate outliers per language and source.

Every text is counted: words, their characters, symbols, repeated lines, words in repeated windows
of three words. Two plain rules come first. What passes them is judged by a vector of transformed
statistics: logarithms of the number and the mean length of words, and arc sines of the root of
the shares of symbols, repeated lines and repeated words. A document is rejected if its Mahalanobis
distance from its group, a language of a source, has a probability below ``TAIL``.

Location and scatter of a group are its minimum covariance determinant: those of the ``SUBSET``
share of its documents whose scatter has the smallest determinant. They are found by concentration
steps from three starts (medians with absolute deviations; mean and covariance; correlations of
squashed values): measure all distances, keep the closest share, estimate anew. The start with the
smallest determinant wins, and one more step takes all documents within the 97.5 % ellipsoid.

All documents count in every step, in Spark: vectors are whole multiples of ``1 / UNIT``, so
documents with equal vectors are one row with a count, sums are exact in any order, and a step is
one grouping by the distance's bin, combined on the map side, then a scan over a group's few
thousand bins. The closest share therefore ends with a whole bin. A group or a vector that holds a
third of all rows is a row like any other.

Scatter is kept away from zero: ``PRIOR`` counts like ``PRIOR_ROWS`` documents of usual spread, and
``FLOOR`` is added, so that groups of one document, or of copies only, work as well. Small groups
are thus judged mildly; none is skipped.

Defined cases: a null text has no words and fails; a null language or source is a group of its
own; a null identifier and rows that repeat are judged like others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.repeats import binary_views, slices
from plumbline.storage import materialise

LEAST_WORDS = 50
MOST_REPEATED = 50
SUBSET = 0.75
TAIL = 1e-5
STEPS = 5
UNIT = 200
#: Usual and least spread of the five transformed statistics.
PRIOR = (1.0, 0.05, 0.05, 0.05, 0.12)
FLOOR = (0.1, 0.02, 0.05, 0.05, 0.12)
PRIOR_ROWS = 20
_SIZE = len(PRIOR)
_V = [f"v{k}" for k in range(_SIZE)]
_PAIRS = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]
_GROUP = ["lang", "source"]
_SQUASHED = 1000
_INNER = 0.975

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def chi2_cdf(x: float, k: int) -> float:
    """Probability that chi-squared of k degrees is at most x (series of the incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-17:
        term *= half / (a + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def _consistency(share: float) -> float:
    """What the covariance of the inner ``share`` of a normal distribution must be widened by."""
    return share / chi2_cdf(chi2_quantile(share, _SIZE), _SIZE + 2)


def _windows(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for the three words from each place on; equal words, equal numbers."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if distinct < 1 << 21:
        return (a << 42) | (b << 21) | c
    _, pair = np.unique(a * distinct + b, return_inverse=True)
    return pair * distinct + c


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """Per text the words inside windows of three words that the text holds more than once."""
    flat: list[int] = []
    total = 0
    for words in texts:                            # numbers are never shared between texts
        numbers: dict[bytes, int] = {}
        flat += [total + numbers.setdefault(w, len(numbers)) for w in words]
        total += len(numbers)
    cuts = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    marks = np.zeros(len(flat) + 1, np.int64)
    if len(flat) > 2:
        ids = np.array(flat, np.int64)
        _, window, count = np.unique(_windows(ids, total), return_inverse=True, return_counts=True)
        # a window over a text's end occurs once: numbers of different texts differ
        at = np.flatnonzero(count[window] > 1)
        for k in range(3):
            marks[at + k] = 1
    below = np.concatenate([[0], np.cumsum(marks)])
    return below[cuts[1:]] - below[cuts[:-1]]


def text_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 texts."""
    begin = int(offsets[0])
    part = flat[begin:int(offsets[-1])]
    cuts = offsets - begin

    def per_text(marks: np.ndarray) -> np.ndarray:
        below = np.concatenate([[0], np.cumsum(marks)])
        return below[cuts[1:]] - below[cuts[:-1]]

    texts, lines = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        body = part[a:b].tobytes()
        texts.append(body.split())
        said = [line for line in body.split(b"\n") if line.strip()]
        lines.append(len(said) - len(set(said)))
    return np.stack([
        np.array([len(w) for w in texts], np.int64),
        per_text(~_SPACE[part] & ((part & 0xC0) != 0x80)),
        per_text(_SYMBOL[part]), np.array(lines, np.int64), repeated_words(texts)], axis=1)


def transformed(counts: np.ndarray) -> np.ndarray:
    """Vectors of whole numbers, multiples of 1 / ``UNIT``; meaningless without words."""
    words, chars = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 1], 1)

    def share(part, whole):
        return np.arcsin(np.sqrt(np.minimum(1, part / whole)))

    vector = np.stack([
        np.log(words), np.log(chars / words), share(counts[:, 2], chars),
        share(counts[:, 3], words), share(counts[:, 4], words)], axis=1)
    return np.rint(vector * UNIT).astype(np.int64)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_STATS = ", ".join(["id long", "lang string", "source string",
                    *(f"{c} long" for c in _COUNTS), *(f"{v} long" for v in _V)])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, at = binary_views(batch.column(3))
        for low, high in slices(at, 1 << 22):
            counts = text_counts(flat, at[low:high + 1])
            table = np.concatenate([counts, transformed(counts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(low, high - low) for k in range(3)),
                 *(pa.array(table[:, k].copy()) for k in range(table.shape[1]))],
                names=["id", *_GROUP, *_COUNTS, *_V])


def _group_key(name: str) -> Column:
    """A group's name, never null and never mistaken for another one."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, vector and ``base_failed`` of every row."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("id"), _group_key(lang_col).alias("lang"),
        _group_key(source_col).alias("source"), body.alias("body")).mapInArrow(
        _statistics, _STATS).withColumn("base_failed", F.expr(
            f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


#: Rows of a table of groups that is small enough to be sent to all tasks, about 300 bytes each.
_FEW_GROUPS = 50_000


def _per_group(table: DataFrame) -> DataFrame:
    """Write a table with a few rows per group; it is broadcast if it is small, which is checked.

    A join by group would deal a hot group's rows to one task."""
    table = materialise(table)
    return F.broadcast(table) if table.count() <= _FEW_GROUPS else table


_MOMENTS = ["w", *(f"s{i}" for i in range(_SIZE)), *(f"p{i}{j}" for i, j in _PAIRS)]
_ESTIMATE = "start int, determinant double, mean array<double>, inverse array<double>"
ESTIMATES = f"lang string, source string, {_ESTIMATE}"


def _moments(values: list[str]) -> list[Column]:
    return [F.sum("w").alias("w"),
            *(F.expr(f"sum(w * {values[i]})").alias(f"s{i}") for i in range(_SIZE)),
            *(F.expr(f"sum(w * {values[i]} * {values[j]})").alias(f"p{i}{j}") for i, j in _PAIRS)]


def mean_and_covariance(sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """From exact sums: the count, the values, their products."""
    n, first, second = sums[0], sums[1:1 + _SIZE], sums[1 + _SIZE:]
    covariance = np.empty((_SIZE, _SIZE))
    for (i, j), both in zip(_PAIRS, second):
        covariance[i, j] = covariance[j, i] = (n * both - first[i] * first[j]) / (n * n)
    return np.array([s / n for s in first]), covariance


def estimate(start: int, mean: np.ndarray, covariance: np.ndarray, rows: int) -> dict:
    """An estimate's row, its scatter kept away from zero."""
    prior, floor = (np.diag((np.array(x) * UNIT) ** 2) for x in (PRIOR, FLOOR))
    scatter = (rows * covariance + PRIOR_ROWS * prior) / (rows + PRIOR_ROWS) + floor
    return {"start": start, "determinant": float(np.linalg.slogdet(scatter)[1]),
            "mean": mean.tolist(), "inverse": np.linalg.inv(scatter).ravel().tolist()}


def starts(row) -> list[dict]:
    """The three starting estimates of a group from medians, spreads and two sets of moments."""
    middle = np.array([row[f"m{k}"] for k in range(_SIZE)])
    spread = np.array([row[f"d{k}"] for k in range(_SIZE)])
    sums = [[int(row[f"{kind}{name}"]) for name in _MOMENTS] for kind in ("plain_", "squashed_")]
    mean, covariance = mean_and_covariance(sums[0])
    _, squashed = mean_and_covariance(sums[1])
    size = np.sqrt(np.maximum(np.diag(squashed), 1e-9))
    correlation = squashed / np.outer(size, size)
    np.fill_diagonal(correlation, 1)
    n = sums[0][0]
    return [estimate(0, middle, np.diag(spread ** 2), n), estimate(1, mean, covariance, n),
            estimate(2, middle, correlation * np.outer(spread, spread), n)]


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([{"lang": r["lang"], "source": r["source"], **e}
                            for r in frame.to_dict("records") for e in starts(r)],
                           columns=[*_GROUP, "start", "determinant", "mean", "inverse"])


def starting_estimates(classes: DataFrame) -> DataFrame:
    middles = _per_group(classes.groupBy(*_GROUP).agg(
        *(F.percentile(v, F.lit(0.5), F.col("w")).alias(f"m{k}") for k, v in enumerate(_V))))
    far = classes.join(middles, _GROUP)
    spreads = _per_group(far.groupBy(*_GROUP).agg(*(
        F.percentile(F.expr(f"abs({v} - m{k})"), F.lit(0.5), F.col("w")).alias(f"d{k}")
        for k, v in enumerate(_V))).select(*_GROUP, *(
            F.greatest(1.4826 * F.col(f"d{k}"), F.lit(UNIT * FLOOR[k])).alias(f"d{k}")
            for k in range(_SIZE))))
    near = far.join(spreads, _GROUP)
    for k, v in enumerate(_V):
        near = near.withColumn(f"y{k}", F.expr(
            f"CAST(round({_SQUASHED} * tanh(({v} - m{k}) / d{k})) AS bigint)"))
    plain, squashed = (
        [c.alias(f"{kind}{name}") for c, name in zip(_moments(values), _MOMENTS)]
        for kind, values in (("plain_", _V), ("squashed_", [f"y{k}" for k in range(_SIZE)])))
    sums = near.groupBy(*_GROUP).agg(*plain, *squashed)
    return _per_group(sums.join(middles, _GROUP).join(spreads, _GROUP)
                      .mapInPandas(_starts, ESTIMATES))


def distance() -> Column:
    """Squared Mahalanobis distance of v0, v1, ... for the columns ``mean`` and ``inverse``."""
    return F.expr(" + ".join(
        f"{1 if i == j else 2}D * inverse[{i * _SIZE + j}] * (v{i} - mean[{i}]) * (v{j} - mean[{j}])"
        for i, j in _PAIRS))


def bin_of(d: np.ndarray | float):
    """The bin of a squared distance; about two per cent wide."""
    return np.floor(32 * np.log2(1 + 16 * np.maximum(d, 0))).astype(np.int64)


def closest(frame: pd.DataFrame, most: int | None) -> pd.DataFrame:
    """Bins that a step keeps: up to ``most``, or those that hold the closest share of rows."""
    frame = frame.sort_values("bin")
    if most is not None:
        inner = frame[frame["bin"] <= most]
        return inner if len(inner) else frame.head(1)
    need = -(-frame["w"].sum() * int(SUBSET * 100) // 100)
    return frame[frame["w"].cumsum() - frame["w"] < need]


def _step(most: int | None, share: float):
    widened = _consistency(share)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        kept = closest(frame, most)
        sums = [sum(int(x) for x in kept[name]) for name in _MOMENTS]
        mean, covariance = mean_and_covariance(sums)
        row = estimate(int(key[2]), mean, widened * covariance, sums[0])
        return pd.DataFrame([{"lang": key[0], "source": key[1], **row}])

    return run


def concentrate(classes: DataFrame, estimates: DataFrame, most: int | None = None,
                share: float = SUBSET) -> DataFrame:
    """One step from each estimate."""
    far = classes.join(estimates, _GROUP).withColumn("d", distance())
    bins = far.groupBy(*_GROUP, "start", F.expr(
        "CAST(floor(32 * log2(1 + 16 * greatest(d, 0D))) AS bigint)").alias("bin")).agg(*_moments(_V))
    return _per_group(bins.groupBy(*_GROUP, "start").applyInPandas(_step(most, share), ESTIMATES))


def robust_estimates(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """Location and inverse scatter of each group of the rows that passed the plain rules."""
    classes = materialise(stats.where("NOT base_failed").groupBy(*_GROUP, *_V)
                          .agg(F.count("*").alias("w")))
    found = starting_estimates(classes)
    for _ in range(steps):
        found = concentrate(classes, found)
    best = _per_group(found.groupBy(*_GROUP).agg(
        F.min_by(F.struct("start", "determinant", "mean", "inverse"),
                 F.struct("determinant", "start")).alias("e")).select(*_GROUP, "e.*"))
    return concentrate(classes, best, int(bin_of(chi2_quantile(_INNER, _SIZE))), _INNER)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", tail: float = TAIL, steps: int = STEPS) -> DataFrame:
    """The identifier, the counts, ``base_failed``, ``kept`` and the squared ``distance``."""
    stats = materialise(statistics(docs, id_col, text_col, lang_col, source_col))
    found = robust_estimates(stats, steps)
    far = F.when(~F.col("base_failed"), distance())
    limit = chi2_quantile(1 - tail, _SIZE)
    return stats.join(found.select(*_GROUP, "mean", "inverse"), _GROUP, "left").withColumn("distance", far).select(
        F.col("id").alias(id_col), *_COUNTS, "base_failed",
        F.coalesce(F.col("distance") <= limit, F.lit(False)).alias("kept"), "distance")
