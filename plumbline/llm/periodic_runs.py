"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words with a smallest period q and at least ``2 q`` words. Documents
are worked on in batches, back to back with a separator of its own after each, so that one pass
of array operations serves them all; no run crosses a separator.

*Synchronising sets.* At scale t every window of t words gets a hashed identifier, none if it has
a period of t / 3 or less. Position i is in the set if the smallest identifier among the windows
at i .. i + t is that of i or of i + t. Whether i belongs depends on the ``2 t`` words from i
alone, and of t consecutive positions one belongs unless the ``3 t - 1`` words there are highly
periodic. So a run of period p in [3 t, 6 t) holds a position i of the set together with i + p,
and both have the same context of ``2 t`` words: all pairs of positions with equal contexts at such
a distance propose their distance as a period. Positions of equal context lie more than t / 3
apart, so each has at most eighteen partners. Scales double from ``SCALE`` on.

*Highly periodic regions.* Periods below ``3 SCALE`` are found by comparing the words that far
apart. The set has no position in a stretch with a period r of t / 3 or less. A run that is hidden
by this begins with such a stretch of at least p words, ends with another one of the same r, and
the two, found before as runs of period r, touch or overlap by less than r. Neighbours of that
kind propose the distances that bring their periods into step.

Every proposal is extended to both sides with hashes of prefixes modulo 2**61 - 1 and then compared
word by word, so a proposal can only cost time; of stretches found with several periods the
smallest period is kept.

Nothing is shuffled: a document is judged alone. Memory follows the batch, or one longer document.

Defined cases: a null or empty text has no words and no runs; a document of fewer than ``LEAST``
words has none; rows that repeat, null identifiers and an empty table need no special care; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.kernels import mix
from plumbline.llm.repeats import binary_views

#: Words of the shortest run.
LEAST = 12
SCALE = 8
#: Words of a batch.
BATCH = 1 << 18
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x0F1BBCDCBFA53E0B
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(k) for k in (1, 30, 31, 61))
RUN = "struct<start: long, length: long, period: long>"


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _61)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it."""
    high, low, his, los = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = low * his + high * los
    return _fold(((high * his) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + low * los)


class PrefixHash:
    """Hashes of all stretches of a sequence, modulo 2**61 - 1."""

    _tables: dict[int, np.ndarray] = {}

    def __init__(self, values: np.ndarray):
        n = len(values)
        terms = _times(_fold(mix(values.astype(np.uint64) + _1)), self._powers(_BASE, n))
        high, low = np.cumsum(terms >> _31, dtype=np.uint64), np.cumsum(terms & _LOW31, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _fold(((high & _LOW30) << _31) + (high >> _30) + low)
        self.inverse = self._powers(pow(_BASE, -1, int(_PRIME)), n + 1)

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        table = cls._tables.get(base, np.ones(1, np.uint64))
        while len(table) < n:
            step = np.uint64(pow(base, len(table), int(_PRIME)))
            table = np.concatenate([table, _times(table, step)])
        if n <= 2 * BATCH:                      # a longer document's table is not kept
            cls._tables[base] = table
        return table[:n]

    def of(self, start, length) -> np.ndarray:
        return _times(_fold(self.sums[start + length] + _PRIME - self.sums[start]), self.inverse[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, _NONE)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def synchronising_set(hashes: PrefixHash, n: int, t: int, regions: np.ndarray) -> np.ndarray:
    """Positions of scale t; ``regions`` are runs (start, end, period) found so far."""
    names = mix(hashes.of(np.arange(n - t + 1), t)) >> _1
    dull = regions[(regions[:, 2] * 3 <= t) & (regions[:, 1] - regions[:, 0] >= t)]
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, np.minimum(dull[:, 0], n), 1)
    np.add.at(marks, np.minimum(dull[:, 1] - t + 1, n), -1)
    names[np.cumsum(marks)[:len(names)] > 0] = _NONE
    least = sliding_min(names, t + 1)
    first = names[:len(least)]
    return np.flatnonzero((least != _NONE) & ((first == least) | (names[t:t + len(least)] == least)))


def equal_contexts(hashes: PrefixHash, at: np.ndarray, t: int) -> Iterator[np.ndarray]:
    """Proposals (position, period) of positions whose next 2 t words are equal."""
    names = hashes.of(at, 2 * t)
    order = np.argsort(names, kind="stable")
    names, at = names[order], at[order]
    for k in range(1, len(at)):
        near = (names[k:] == names[:-k]) & (at[k:] - at[:-k] < 6 * t)
        if not near.any():
            break
        first, gap = at[:-k][near], (at[k:] - at[:-k])[near]
        yield np.stack([first, gap], axis=1)[gap >= 3 * t]


def neighbour_proposals(hashes: PrefixHash, runs: np.ndarray) -> np.ndarray:
    """Proposals of runs of one period that touch or overlap."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    one, two = runs[:-1], runs[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1]) & (two[:, 0] > one[:, 1] - one[:, 2])
    one, two = one[meet], two[meet]
    # the shift that brings the second run's words under the first one's
    period = one[:, 2]
    pair = np.repeat(np.arange(len(one)), period)
    shift = np.arange(len(pair)) - np.repeat(np.cumsum(period) - period, period)
    same = hashes.of(two[pair, 0] + shift, period[pair]) == hashes.of(one[pair, 0], period[pair])
    pair, shift = pair[same], shift[same]
    one, two, period = one[pair], two[pair], period[pair]
    step = (two[:, 0] + shift - one[:, 0]) % period
    least = np.maximum(3 * SCALE, 9 * period)
    lowest = step + -(-(least - step) // period) * period
    most = np.minimum(one[:, 1] - one[:, 0], two[:, 1] - two[:, 0]) + 2 * period
    count = np.maximum(0, (most - lowest) // period + 1)
    pair = np.repeat(np.arange(len(one)), count)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    proposed = lowest[pair] + nth * period[pair]
    return np.stack([np.maximum(one[pair, 0], two[pair, 0] - proposed), proposed], axis=1)


def _reach(hashes: PrefixHash, i: np.ndarray, j: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
    """How many words from i and j (i < j) on, or before them (``side`` -1), are equal."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        back = middle if side < 0 else 0
        same = hashes.of(i - back, middle) == hashes.of(j - back, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _exact(words: np.ndarray, start: int, end: int, period: int, seed: int) -> tuple[int, int]:
    """The stretch of this period around ``seed``; nearly always the one given."""
    n = len(words)
    if (np.array_equal(words[start:end - period], words[start + period:end])
            and (start == 0 or words[start - 1] != words[start - 1 + period])
            and (end == n or words[end] != words[end - period])):
        return start, end
    differ = np.flatnonzero(words[:n - period] != words[period:])
    at = np.searchsorted(differ, seed)
    start = int(differ[at - 1]) + 1 if at else 0
    return start, (int(differ[at]) if at < len(differ) else n - period) + period


def _verified(words: np.ndarray, hashes: PrefixHash, proposals: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) around proposals (position, period)."""
    i, p = np.unique(proposals, axis=0).T
    right = _reach(hashes, i, i + p, len(words) - i - p, 1)
    left = _reach(hashes, i, i + p, i, -1)
    start, end = i - left, i + p + right
    fits = end - start >= np.maximum(2 * p, LEAST)
    _, once = np.unique(np.stack([start, end, p], axis=1)[fits], axis=0, return_index=True)
    rows = np.stack([start, end, p, i], axis=1)[fits][once]
    found = [(*_exact(words, *r), r[2]) for r in rows.tolist()]
    found = [r for r in found if r[1] - r[0] >= max(2 * r[2], LEAST)]
    return np.array(found, np.int64).reshape(-1, 3)


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[keep]


def _near_repeats(words: np.ndarray) -> np.ndarray:
    """Stretches of at least ``SCALE`` words with a period below ``3 SCALE``."""
    found = []
    for q in range(1, min(3 * SCALE, len(words))):
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = words[:-q] == words[q:]
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, end = edges[::2], edges[1::2] + q
        keep = end - start >= max(2 * q, SCALE)
        found.append(np.stack([start[keep], end[keep], np.full(keep.sum(), q)], axis=1))
    return _smallest_periods(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def find_runs(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    """All runs (start, end, period) of at least ``LEAST`` words in a batch.

    ``words`` are word numbers of documents of falling ``lengths``, each followed by a number that
    occurs only there.
    """
    hashes = PrefixHash(words)
    runs = _near_repeats(words)
    waiting = neighbour_proposals(hashes, runs)
    ends = np.cumsum(np.array(lengths, np.int64) + 1)
    falling = -np.array(lengths, np.int64)
    t = SCALE
    while lengths and 6 * t <= lengths[0]:
        # only documents that can hold a run of this scale
        n = int(ends[np.searchsorted(falling, -6 * t, "right") - 1])
        now = (waiting[:, 1] >= 3 * t) & (waiting[:, 1] < 6 * t)
        at = synchronising_set(hashes, n, t, runs)
        proposals = np.concatenate([waiting[now], *equal_contexts(hashes, at, t)])
        waiting = waiting[waiting[:, 1] >= 6 * t]
        if len(proposals):
            new = _verified(words, hashes, proposals)
            runs = _smallest_periods(np.concatenate([runs, new]))
            mine = runs[(runs[:, 2] >= 3 * t) & (runs[:, 2] < 6 * t)]
            waiting = np.concatenate([waiting, neighbour_proposals(hashes, mine)])
        t *= 2
    return runs[runs[:, 1] - runs[:, 0] >= LEAST]


def batch_runs(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text its runs (start, length, period), ordered by start and period, and which words
    stay: those outside of runs and the first period of each."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    for k in order:
        flat += [numbers.setdefault(w, len(numbers)) for w in texts[k]]
        flat.append(-1)
    words = np.array(flat, np.int64)
    apart = words < 0
    words[apart] = len(numbers) + np.arange(apart.sum())
    lengths = [len(texts[k]) for k in order]
    runs = find_runs(words, lengths)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 1], -1)
    stays = np.cumsum(covered) == 0
    begins = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
    cuts = np.searchsorted(runs[:, 0], begins)
    found, kept = [None] * len(texts), [None] * len(texts)
    for place, k in enumerate(order):
        part, begin = runs[cuts[place]:cuts[place + 1]], begins[place]
        found[k] = np.stack([part[:, 0] - begin, part[:, 1] - part[:, 0], part[:, 2]], axis=1)
        kept[k] = stays[begin:begin + len(texts[k])]
    return found, kept


def _groups(bodies: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of consecutive rows, about ``BATCH`` words in all."""
    flat, at = binary_views(bodies)
    begin, held, size = 0, [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        words = flat[a:b].tobytes().split()
        if held and size + len(words) > BATCH:
            yield begin, held
            begin, held, size = row, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield begin, held


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in _groups(batch.column(1)):
            found, kept = batch_runs(texts)
            sizes = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            rows = np.concatenate(found)
            runs = pa.StructArray.from_arrays(
                [pa.array(rows[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
            left = [b" ".join(words) if stays.all() else
                    b" ".join(w for w, s in zip(words, stays.tolist()) if s)
                    for words, stays in zip(texts, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, len(texts)),
                 pa.array([len(words) for words in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), runs),
                 pa.array(left, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed_text"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id",
                  text: str | Column = "text") -> DataFrame:
    """The identifier, ``n_words``, ``runs`` and ``collapsed_text`` of every row.

    ``runs`` is ordered by start and period, in words from 0; ``collapsed_text`` has the words that
    no run contains after its first period, joined by one space.
    """
    text = F.col(text) if isinstance(text, str) else text
    body = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).mapInArrow(
        _run, f"id long, n_words long, runs array<{RUN}>, collapsed_text string"
    ).withColumnRenamed("id", id_col)


def repeat_some(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with its end turned into repeats, in about every tenth document.

    With h the unsigned crc32 of the decimal identifier, g = h div 10 and n words: where h ends
    in 0, word i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    text = F.col(text_col).cast("string")
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    # whole periods, cut to the old length; a word is not looked up one by one
    rest = F.slice(F.flatten(F.array_repeat(
        F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.concat(F.slice(words, F.lit(1), a), rest)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one, and digests of the runs and of what is left."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", best)
    length = -F.col("best.less")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less DIV best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
