"""Finding windows that occur more than once, in steps that drop what is unique as early as possible.

A *window* is ``size`` consecutive units (bytes or words) of one document. Each window has an
anchor, the leftmost smallest gram among its first ``spread`` positions, so equal windows have
their anchors at equal offsets. Consecutive windows with one anchor form a *range*, a row of the
anchor table with two keys:

``f``  names the content that all windows at this anchor share, whatever their offset;
``e``  names the whole content of the range, and where the anchor lies in it.

Ranges with a unique ``f`` hold no repeated window. Ranges equal in ``f`` and ``e`` repeat each
other window by window. What is left are ranges that share ``f`` but not ``e``: one of each ``e``
goes on to the operator's exact step, window by window. Nothing is compared pairwise, every
grouping combines on the map side first and every join back is one that Spark may split.

``p`` is a document's position key: 24 bits that tell texts of one identifier apart, 32 bits of
the first window's start, 8 bits of the number of windows less one. The 24 bits come from a hash of
the text under the first seed that gives different texts of one identifier different bits; that is
checked over all rows. Rows without an identifier get one of their own from their text, below all
others, so that any number of them can be told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.storage import materialise

NO_ID = -(1 << 63)
_MASK = {"tag": (1 << 24) - 1, "start": (1 << 32) - 1, "more": 255}
ANCHORS = "id long, p long, f long, e long"


#: Rows without an identifier lie below this one, by a hash of their text.
_UNNAMED = -(1 << 62)
_MOST_SEEDS = 64


def _tag(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "one", "two").bitwiseAND(F.lit(_MASK["tag"])).alias("tag")


def bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``tag`` and ``body`` (UTF-8) of every row; null text is empty.

    Identifiers must lie above -2**62. One that is shared by more than about ten thousand different
    texts raises an error.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one, two = F.xxhash64(text).alias("one"), F.xxhash64(F.lit("two"), text).alias("two")
    unnamed = F.lit(NO_ID) + F.xxhash64(F.lit("unnamed"), text).bitwiseAND(F.lit((1 << 62) - 1))
    identity = F.coalesce(F.col(id_col).cast("long"), unnamed).alias("id")
    # only identifiers that carry several texts can clash; they are few or none
    rows = docs.select(identity, one, two)
    shared = materialise(
        rows.groupBy("id").agg(F.min("one").alias("low"), F.max("one").alias("high"))
        .where("low <> high").select("id"))
    seed = 0
    if not shared.isEmpty():
        texts = materialise(rows.join(shared, "id").distinct())
        while not texts.groupBy("id", _tag(seed)).count().where("count > 1").isEmpty():
            seed += 1
            if seed == _MOST_SEEDS:
                raise ValueError("one identifier is shared by too many different texts; number the rows")
    return docs.select(identity, one, two, text.cast("binary").alias("body")).select(
        "id", _tag(seed), "body")


def public_id(name: str) -> Column:
    return F.when(F.col("id") != NO_ID, F.col("id")).alias(name)


def named_id(name: str) -> Column:
    """The identifier of rows of ``bodies``."""
    return F.when(F.col("id") >= _UNNAMED, F.col("id")).alias(name)


def tag_of(p: str) -> Column:
    return F.shiftrightunsigned(p, 40)


def pack(tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (tag.astype(np.int64) << 40) | (start.astype(np.int64) << 8) | (count - 1)


def starts_and_counts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (p >> 8) & _MASK["start"], (p & _MASK["more"]) + 1


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the texts' offsets in them, without copying."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, at


def slices(offsets: np.ndarray, units: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``units`` in total; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + units, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def window_ranges(anchor: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each range of windows with one anchor; none crosses a text's end."""
    n = len(anchor)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    begin = 0
    for end in ends.tolist():
        inside[max(begin, end - size + 1):end] = False
        begin = end
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [n]]) - 1
    keep = inside[first]
    return first[keep], last[keep]


def live_ranges(anchors: DataFrame) -> DataFrame:
    """Ranges whose ``f`` occurs more than once, with their class.

    Adds ``first`` (the class's smallest (id, p)), ``m`` (its size) and ``several`` (whether its
    ``f`` has other classes). The result is written to the shared folder.
    """
    anchors = anchors.persist(StorageLevel.MEMORY_AND_DISK)
    owner = F.struct("id", "p")
    # written before the join: Spark splits a hot key only where no aggregate stands under the join
    by_f = materialise(
        anchors.groupBy("f")
        .agg(F.count("*").alias("m"), F.min("e").alias("low"), F.max("e").alias("high"),
             F.min(owner).alias("first"))
        .where("m > 1").selectExpr("f", "m", "first", "low <> high AS several"))
    rows = materialise(anchors.join(by_f, "f"))
    anchors.unpersist()
    mixed = rows.where("several")
    by_class = materialise(
        mixed.groupBy("f", "e").agg(F.count("*").alias("m"), F.min(owner).alias("first")))
    split = mixed.drop("m", "first").join(by_class, ["f", "e"])
    return materialise(rows.where("NOT several").unionByName(split))
