"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words of letters and digits; a run in a script without spaces
gives its overlapping pairs of characters as words. A document is contaminated by an item where
``window`` consecutive words (or a shorter item as a whole) agree in all but a fifth of the places.
Items of fewer than ``min_words`` words are matched as a whole and without differences if they
have ``min_chars`` letters and digits; shorter ones occur anywhere.

Fixed masks ignore selected places: a window of 13 words may differ in two, so its
places fall into four interleaved groups and each of six masks ignores two of them. Whatever two
places differ, one mask ignores both, so equal masked hashes find every such window. Hits are
joined with the benchmark, the windows compared word by word, and verified windows that overlap
on one diagonal are one overlap.

The benchmark's hashes serve as a filter before the shuffle while they are few
(``max_filter_hashes``, checked); beyond that all masked hashes are joined. The join and what
follows it are the same either way, and Spark may split it where one item is everywhere.

Defined cases: null texts have no words and match nothing; items of fewer than ``min_words``
words and ``min_chars`` letters and digits are not matched; a null identifier stays null; rows
that repeat are one document, items that repeat are one item; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import repeats
from plumbline.llm.kernels import mix, word_hashes
from plumbline.storage import materialise

WINDOW = 13
SIMILARITY = 0.8
MIN_WORDS = 5
MIN_CHARS = 20
MAX_FILTER_HASHES = 4_000_000
_SLICE = 1 << 16
_TABLE_BITS = 23
_OTHER = r"[^\p{L}\p{N}]+"
#: Letters of scripts that are written without spaces; the last is the mark of long vowels.
_UNSPACED = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
             r"\p{IsTibetan}\u30FC&&[\p{L}\p{N}]]")
#: Where the first of these scripts begins; texts below it are not looked at character by character.
_HIGH = r"[\u0E00-\x{10FFFF}]"


def tolerance(length: int, similarity: float) -> int:
    """How many places of a window may differ."""
    return int(length * (1 - similarity) + 1e-9)


def masks(length: int, similarity: float) -> list[tuple[int, ...]]:
    """The groups of places each mask looks at: all ways to ignore as many groups as may differ."""
    t = tolerance(length, similarity)
    groups = 1 if t == 0 else min(t + 2, length)
    return list(itertools.combinations(range(groups), groups - t))


def seeds(words: np.ndarray, length: int, similarity: float) -> list[np.ndarray]:
    """Masked hashes of all windows of ``length`` words, one array per mask."""
    n = len(words) - length + 1
    looks = masks(length, similarity)
    groups = max(g for look in looks for g in look) + 1
    if tolerance(length, similarity):
        groups = min(tolerance(length, similarity) + 2, length)
    sums = [np.zeros(n, np.uint64) for _ in range(groups)]
    factors = mix(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    for place in range(length):
        sums[place % groups] += words[place:place + n] * factors[place]
    found = []
    for k, look in enumerate(looks):
        total = np.full(n, (length << 8 | k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for g in look:
            total += sums[g]
        found.append(mix(total))
    return found


def _normal(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.regexp_replace(F.lower(text), _OTHER, " ")
    # abc becomes ab bc c, and then loses the character that its last pair has already
    apart = F.regexp_replace(plain, f"({_UNSPACED}+)", " $1 ")
    pairs = F.regexp_replace(apart, f"({_UNSPACED})(?=({_UNSPACED}))", "$1$2 ")
    pairs = F.regexp_replace(pairs, f"(?<={_UNSPACED}{{2}} ){_UNSPACED}(?= )", "")
    plain = F.when(text.rlike(_HIGH), pairs).otherwise(plain)
    return table.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)).alias("id"),
        F.xxhash64(text).alias("tag"), plain.cast("binary").alias("body"))


_SEEDS = "id long, tag long, at long, n int, key long, words array<long>"


def _seed_rows(lengths: list[int], similarity: dict[int, float], wanted, whole_below: int):
    """Masked hashes as rows. ``wanted``: a broadcast sorted array that holds the useful ones.

    ``similarity`` is given by window length. With ``whole_below`` texts of fewer words give one
    window, the whole text.
    """
    def emit(ids, tags, doc, at, words, place, length, key):
        picked = np.lib.stride_tricks.sliding_window_view(words, length)[place]
        offsets = np.arange(0, picked.size + 1, length, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[doc]), pa.array(tags[doc]), pa.array(at),
             pa.array(np.full(len(place), length, np.int32)), pa.array(key.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                 np.ascontiguousarray(picked).view(np.int64).ravel()))],
            names=["id", "tag", "at", "n", "key", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known = None
        if wanted is not None:
            known = wanted.value
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(known >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            flat, offsets = repeats.binary_views(batch.column(2))
            for low, high in repeats.slices(offsets, 1 << 20):
                begin = int(offsets[low])
                words, below = word_hashes(flat[begin:int(offsets[high])],
                                           offsets[low:high + 1] - begin)
                for length, a, b in ((n, a, b) for a, b in repeats.slices(below, _SLICE)
                                     for n in lengths):
                    first, stop = int(below[a]), int(below[b])
                    for start in range(first, max(first + 1, stop - length + 1), _SLICE):
                        until = min(stop, start + _SLICE + length - 1) if b == a + 1 else stop
                        part = words[start:until]
                        if len(part) >= length:
                            doc = np.searchsorted(
                                below, np.arange(start, until - length + 1), "right") - 1
                            fits = np.arange(start, until - length + 1) + length <= below[doc + 1]
                            if whole_below:
                                sizes = below[doc + 1] - below[doc]
                                fits &= (sizes == length) | (length == whole_below) & (
                                    sizes > length)
                            for key in seeds(part, length, similarity[length]):
                                hit = fits
                                if table is not None:
                                    hit = fits & table[
                                        (key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
                                place = np.flatnonzero(hit)
                                if table is not None and len(place):
                                    near = np.searchsorted(known, key[place])
                                    near[near == len(known)] = 0
                                    place = place[known[near] == key[place]]
                                if len(place):
                                    yield emit(ids, tags, doc[place] + low,
                                               place + start - below[doc[place]], part, place,
                                               length, key[place])
                        if b > a + 1:
                            break

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
             text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
             window: int = WINDOW, similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
             max_filter_hashes: int = MAX_FILTER_HASHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and item that overlap.

    Returns both identifiers, ``n_windows`` (verified windows, by their places in the document),
    ``first_word`` and ``last_word`` (from 0, inclusive) of the overlap in the document's words.
    """
    spark = docs.sparkSession
    lengths = list(range(min_words, window + 1))
    short = list(range(1, min_words))
    alike = {n: similarity for n in lengths} | {n: 1.0 for n in short}
    said = F.length(F.regexp_replace(F.lower(F.col(item_text_col).cast("string")), _OTHER, ""))
    found = _normal(benchmark, item_col, item_text_col).mapInArrow(
        _seed_rows(lengths, alike, None, window), _SEEDS)
    if short:
        found = found.unionByName(
            _normal(benchmark.where(said >= min_chars), item_col, item_text_col).mapInArrow(
                _seed_rows(short, alike, None, window), _SEEDS))
    items = materialise(
        found.select(F.col("id").alias("item"), F.col("at").alias("item_at"), "n", "key",
                     F.col("words").alias("item_words")).distinct())
    present = sorted(r.n for r in items.select("n").distinct().collect())   # at most ``window`` rows
    if not present:
        present = [window]
    keys = items.select("key").distinct()
    wanted = None
    if keys.limit(max_filter_hashes + 1).count() <= max_filter_hashes:
        # eight bytes each, never a row object
        known = np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64))
        if not len(known):
            known = np.zeros(1, np.uint64)
        wanted = spark.sparkContext.broadcast(known)
    hits = _normal(docs, id_col, text_col).mapInArrow(
        _seed_rows(present, alike, wanted, 0), _SEEDS)
    agree = F.size(F.filter(F.zip_with("words", "item_words", lambda a, b: a == b), lambda x: x))
    # the number of places that may differ, by window length
    allowed = F.create_map(*[F.lit(x) for n in alike for x in (n, tolerance(n, alike[n]))])
    verified = (hits.join(items.withColumnRenamed("n", "item_n"), "key")
                .where((F.col("n") == F.col("item_n")) & (F.col("n") - agree <= allowed[F.col("n")]))
                .select("id", "tag", "item", "at", "n", "item_at"))
    return (verified.groupBy("id", "tag", "item")
            .agg(F.count_distinct("at").alias("n_windows"), F.min("at").alias("first_word"),
                 (F.max(F.col("at") + F.col("n")) - 1).alias("last_word"))
            .select(repeats.public_id(id_col),
                    F.when(F.col("item") != repeats.NO_ID, F.col("item")).alias(item_col),
                    "n_windows", "first_word", "last_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                        **options) -> DataFrame:
    """The rows of ``docs`` that no item overlaps, with all their columns.

    Documents are told by their identifier; rows without one are judged by a null identifier.
    """
    found = overlaps(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[id_col]), "left_anti")
