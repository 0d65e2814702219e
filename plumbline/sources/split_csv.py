"""Delimited files with line ends inside quotes, split over tasks.

Where a task starts in the middle of a file it cannot know whether it stands inside a quoted cell.
There are two possibilities only, so a first pass reads every block under both and notes the state
in which each leaves it. One scan over these notes, a row per block, tells every block's true state
at its start. The second pass cuts each block into whole records; a record that reaches over block
ends leaves its pieces apart, and only those are put together by a shuffle.

A quote opens a cell only at its start, a doubled quote inside a quoted cell is a quote, and text
behind a closing quote runs to the next separator, as in Spark's own parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.storage import materialise

#: Encodings in which a line end is one byte, as in ASCII.
SPLITTABLE_ENCODINGS = {"utf-8", "us-ascii", "iso-8859-1", "windows-1252"}
#: Blocks that begin inside a quoted cell, at most; their starts travel with the tasks.
_MOST_OPEN = 2_000_000
_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_SPLIT = "spark.sql.files.maxPartitionBytes"
#: Blocks per core of a large input; its blocks are larger than asked for, up to the session's size.
_BLOCKS_PER_CORE = 4
_RECORD, _TAIL, _MIDDLE, _HEAD, _HEADER = range(5)


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open after a line."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            found = _CLOSING.match(line, at if inside else at + 1)
            if found is None:
                return True
            at, inside = found.end(), False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").option("encoding", encoding).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(3)))


def _transitions(sep: str):
    """Per block the states after it: from outside and from inside of a quoted cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes: dict[tuple[str, int], list[bool]] = {}
        key, states = None, [False, True]
        for file, block, line in _rows(batches):
            if (file, block) != key:
                key = file, block
                states = notes.setdefault(key, [False, True])
            if states[0] == states[1]:                 # the two have met
                states[0] = states[1] = inside_after(line, states[0], sep)
            else:
                states[0] = inside_after(line, states[0], sep)
                states[1] = inside_after(line, states[1], sep)
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([k[0] for k in notes], pa.string()),
            "block": pa.array([k[1] for k in notes], pa.int64()),
            "from_outside": pa.array([s[0] for s in notes.values()], pa.bool_()),
            "from_inside": pa.array([s[1] for s in notes.values()], pa.bool_())})

    return run


def _open_blocks(lines: DataFrame, sep: str) -> set[tuple[str, int]]:
    """Blocks that begin inside a quoted cell."""
    notes = materialise(lines.mapInArrow(
        _transitions(sep), "file string, block long, from_outside boolean, from_inside boolean"))
    order = Window.partitionBy("file").orderBy("block")
    # blocks whose end state is known whatever came before, and how often it turned since then
    sure = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turns = F.col("from_outside") & ~F.col("from_inside")
    placed = notes.withColumn("sure", sure).withColumn("span", F.count("sure").over(order))
    within = Window.partitionBy("file", "span").orderBy("block")
    after = (F.coalesce(F.first("sure").over(within), F.lit(False)).cast("int")
             + F.sum(F.when(F.col("sure").isNull() & turns, 1).otherwise(0)).over(within)) % 2
    begun = placed.withColumn("after", after).withColumn("before", F.lag("after", 1, 0).over(order))
    found = begun.where("before = 1").select("file", "block").limit(_MOST_OPEN + 1).collect()
    if len(found) > _MOST_OPEN:
        raise ValueError("too many blocks begin inside a quoted cell")
    return {(r.file, r.block) for r in found}


def _records(sep: str, opened):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        key, held, inside, kind, size = None, [], False, _RECORD, 0

        def close(last: bool) -> None:
            nonlocal held, kind
            if held:
                ended = kind if not last else {_RECORD: _TAIL, _HEADER: _TAIL, _HEAD: _MIDDLE}[kind]
                text = "\n".join(held)
                if text or ended not in (_RECORD, _HEADER):
                    out.append((*key, ended, text))
                    kind = _RECORD if kind == _HEADER or kind == _HEAD else kind
            held = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))],
                names=["file", "block", "kind", "value"])

        for file, block, line in _rows(batches):
            if (file, block) != key:
                close(last=inside)
                key = file, block
                inside = key in opened.value
                kind = _HEAD if inside else _HEADER if block == 0 else _RECORD
                if block == 0:
                    line = line.removeprefix("﻿")
            held.append(line.removesuffix("\r"))
            inside = inside_after(line, inside, sep)
            if not inside:
                close(last=False)
            size += len(line)
            if size > 1 << 22:
                yield flush()
                size = 0
        close(last=inside)
        yield flush()

    return run


def block_bytes(spark: SparkSession, path: str, least: int) -> int:
    """The size of a block: a few per core, so that tasks and files do not grow with the input."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SPLIT))
    share = total // (_BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return max(least, min(share, most))


def split_records(spark: SparkSession, path: str, sep: str, encoding: str,
                  split_bytes: int | None = None) -> DataFrame:
    """``value``: the records of delimited files without their headers, each as one text.

    ``split_bytes`` is the least size of a block, the session's unless given; the session's setting
    is restored.
    """
    before = spark.conf.get(_SPLIT)
    try:
        if split_bytes:
            spark.conf.set(_SPLIT, f"{block_bytes(spark, path, split_bytes)}b")
        lines = _lines(spark, path, encoding)
        opened = spark.sparkContext.broadcast(_open_blocks(lines, sep))
        found = materialise(lines.mapInArrow(
            _records(sep, opened), "file string, block long, kind int, value string"))
    finally:
        spark.conf.set(_SPLIT, before)
    pieces = found.where(f"kind IN ({_TAIL}, {_MIDDLE}, {_HEAD})")
    # the end of one record stands before the begin of another in the same block
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    joined = (pieces.withColumn("chain", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
              .groupBy("file", "chain").agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("block", "value"))),
                  lambda p: p["value"]), "\n").alias("value")))
    return found.where(f"kind = {_RECORD}").select("value").unionByName(joined.select("value"))
