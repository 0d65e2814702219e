"""Ranked lexical search over bags: equal documents are scored once.

A search sees of a document only how often it holds each word of the items, and its length
measure ``m``. Documents are cut down to that: one pass counts all their terms and keeps the
counts of the items' vocabulary. Documents with the same counts and the same ``m`` are a class;
classes are found by a hash and told apart by the vectors themselves, so a collision merges
nothing. Every class is scored once against all items, in blocks of classes; each task keeps, per
item, the ten best classes by score and smallest document. That is enough: a class beyond them is
preceded by ten documents. Only then are the members of the winning classes looked up, in
ascending order and at most ten of each, and ranked.

Terms are maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased.
The score is in whole numbers (see ``rank_documents``) and sums exactly in any order.

The items go to the tasks in blocks whose texts are at most ``BLOCK_BYTES`` together (one longer
text is a block of its own); a larger query set means more blocks, each of which reads the
documents again.

Defined cases: a null or empty text has no terms, counts in neither N nor L, and is never found;
an item without terms has no rows; rows that share an item identifier are one item with the terms
of all its different texts; every row of the documents is a document, rows with equal identifier
and score take consecutive ranks; a null identifier ranks behind equal scores with one; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.repeats import binary_views
from plumbline.storage import local_table, materialise

TOP = 10
BLOCK_BYTES = 8 << 20
#: Scores of one block of classes, as entries of a table of classes by items.
_CELLS = 1 << 21
#: Stands for a null identifier, behind all others.
_NO_ID = (1 << 63) - 1


def _term_table() -> bytes:
    """Maps bytes to term characters; everything else becomes a space."""
    kept = set(range(0x80, 0x100)) | set(b"0123456789abcdefghijklmnopqrstuvwxyz")
    lower = bytes(range(256)).lower()
    return bytes(lower[b] if lower[b] in kept else 0x20 for b in range(256))


_TERMS = _term_table()


def terms(body: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return body.translate(_TERMS).split()


def _binary(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def item_blocks(items: DataFrame, id_col: str, text_col: str,
                block_bytes: int = BLOCK_BYTES) -> Iterator[dict[int, Counter]]:
    """Blocks of items with the terms of each, one at a time; a block's texts are bounded in bytes."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), _binary(text_col).alias("body")
                        ).where("item IS NOT NULL").distinct()
    sizes = rows.groupBy("item").agg(F.sum(F.length("body")).alias("bytes"))
    total = sizes.agg(F.sum("bytes"), F.count("*")).first()
    if not total[1]:
        return
    rows = rows.withColumn("h", F.xxhash64("item"))
    blocks = max(1, -(-(total[0] or 0) // block_bytes))
    while blocks < total[1]:
        # one number comes back: the largest block, unless it is a single item
        worst = (rows.groupBy(F.pmod("h", F.lit(blocks)).alias("block"))
                 .agg(F.sum(F.length("body")).alias("bytes"), F.countDistinct("item").alias("n"))
                 .where("n > 1").agg(F.max("bytes")).first()[0])
        if (worst or 0) <= block_bytes:
            break
        blocks *= 2
    for k in range(blocks):
        part: dict[int, Counter] = {}
        for row in rows.where(F.pmod("h", F.lit(blocks)) == k).toLocalIterator():
            part.setdefault(row.item, Counter()).update(terms(bytes(row.body)))
        if any(part.values()):
            yield {item: words for item, words in sorted(part.items()) if words}


_BAGS = "id long, n long, terms array<int>, tfs array<int>"


def _bags(vocabulary):
    """Length of each document in terms, and its counts of the vocabulary's terms by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        for batch in batches:
            flat, at = binary_views(batch.column(1))
            lengths, sizes, numbers, counts = [], [0], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                words = terms(flat[a:b].tobytes())
                bag = sorted((places[w], c) for w, c in Counter(words).items() if w in places)
                lengths.append(len(words))
                numbers += [t for t, _ in bag]
                counts += [c for _, c in bag]
                sizes.append(len(numbers))
            cuts = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(cuts, pa.array(numbers, pa.int32())),
                 pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int32()))],
                names=["id", "n", "terms", "tfs"])

    return run


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col(id_col).cast("long").alias("id"), _binary(text_col).alias("body")
                       ).mapInArrow(_bags(shared), _BAGS)


def classes_of(found: DataFrame, documents: int, length: int) -> DataFrame:
    """Adds ``m`` and the hash ``h`` of all that scoring sees."""
    m = F.expr(f"25 + (CAST(75 AS decimal(38, 0)) * n * {documents}) DIV {length}").cast("long")
    return (found.where("size(terms) > 0").withColumn("m", m)
            .withColumn("h", F.xxhash64("m", "terms", "tfs")))


def postings(block: dict[int, Counter], vocabulary: dict[bytes, int], weights: dict[int, int]):
    """Per term number the places of the items that hold it and their weights; a term's entries
    are ``start[t]:start[t + 1]``."""
    entries = sorted((vocabulary[w], k, weights[vocabulary[w]] * c)
                     for k, words in enumerate(block.values()) for w, c in words.items()
                     if vocabulary[w] in weights)
    term, item, weight = (np.array(x, np.int64) for x in (zip(*entries) if entries else ((), (), ())))
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return start, item, weight


def scores(m: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray,
           index, items: int) -> np.ndarray:
    """Scores of classes (rows) for items (columns)."""
    start, item, weight = index
    row = np.repeat(np.arange(len(m)), np.diff(offsets))
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
    many = start[term + 1] - start[term]
    entry = np.repeat(np.arange(len(term)), many)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + start[term][entry]
    out = np.zeros(len(m) * items, np.int64)
    np.add.at(out, row[entry] * items + item[place], weight[place] * impact[entry])
    return out.reshape(len(m), items)


def _first_per_item(kept: list[np.ndarray], top: int) -> np.ndarray:
    """Of rows (item, score, first document, class), the ``top`` of each item."""
    rows = np.concatenate(kept)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    begin = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - begin < top]


def _best_classes(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = shared.value
        best = np.zeros((0, 4), np.int64)
        bound = np.zeros(items, np.int64)          # what a class must reach to matter
        for batch in batches:
            key, first, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            block = max(1, _CELLS // items)
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                tids, tfs = part.column(3), part.column(4)
                cuts = np.concatenate([[0], np.cumsum(tids.value_lengths().to_numpy())])
                found = scores(m[low:low + block].astype(np.int64), cuts,
                               tids.flatten().to_numpy().astype(np.int64),
                               tfs.flatten().to_numpy().astype(np.int64), index, items)
                row, item = np.nonzero((found > 0) & (found >= bound))
                rows = np.stack([item, found[row, item], first[low + row], key[low + row]], axis=1)
                best = _first_per_item([best, rows.astype(np.int64)], top)
                full = np.flatnonzero(np.bincount(best[:, 0], minlength=items) == top)
                ends = np.searchsorted(best[:, 0], full, "right") - 1
                bound[full] = best[ends, 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[:, k].copy()) for k in range(4)], names=["item", "score", "first", "class"])

    return run


def _rank_block(docs: DataFrame, block: dict[int, Counter], id_col: str, text_col: str,
                item_col: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for bag in block.values() for w in bag}))}
    found = materialise(bags(docs, vocabulary, id_col, text_col))
    # at most a row per word of the vocabulary
    documents, length = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    held = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = {r.t: math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
               for r in held.collect()}
    if not weights:
        return local_table(spark, [], f"{item_col} long, rank int, {id_col} long, score long")
    vectors = classes_of(found, documents, length)
    key = ["h", "m", "terms", "tfs"]
    first = F.coalesce(F.min("id"), F.lit(_NO_ID))
    classes = materialise(vectors.groupBy(*key).agg(first.alias("first"))
                          .withColumn("class", F.monotonically_increasing_id()))
    items = list(block)
    shared = spark.sparkContext.broadcast((len(items), postings(block, vocabulary, weights)))
    won = classes.select("class", "first", "m", "terms", "tfs").mapInArrow(
        _best_classes(shared, top), "item long, score long, first long, class long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    won = materialise(won.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
                      .select("item", "score", "class"))
    # the first members of each class that won, whatever its size
    winners = materialise(classes.join(won.select("class").distinct(), "class", "left_semi")
                          .select("class", *key))
    inside = Window.partitionBy(*key).orderBy(F.asc_nulls_last("id"))
    members = (vectors.join(winners.select("h").distinct(), "h", "left_semi")
               .select("id", *key).withColumn("k", F.row_number().over(inside))
               .where(F.col("k") <= top).join(winners, key))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    names = local_table(spark, [{"item": k, "name": i} for k, i in enumerate(items)],
                        "item long, name long")
    return (won.join(members.select("class", "id"), "class")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(names, "item")
            .select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias(id_col), "score"))


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", top: int = TOP,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each item: ``item_col``, ``rank``, ``id_col`` and ``score``.

    With N documents that have terms, L terms in all and df documents holding a term, its weight
    is ``floor(1000 ln((2N + 2) / (2df + 1)))``; a document of n terms has
    ``m = 25 + 75nN div L``, and an item's term that occurs tf times in it adds
    ``weight * (10**9 tf div (1000tf + 8m))``, once per occurrence in the item.
    """
    ranked = None
    for block in item_blocks(items, item_col, text_col, block_bytes):
        part = _rank_block(docs, block, id_col, text_col, item_col, top)
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        return local_table(docs.sparkSession, [],
                           f"{item_col} long, rank int, {id_col} long, score long")
    return ranked
