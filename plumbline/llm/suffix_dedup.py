"""Suffix-array dedup by bucket-pointer refinement.

Suffixes are put into buckets by their first bytes, and a bucket is refined by the bucket
identifiers of its suffixes at later offsets: two suffixes that agree on h bytes and, h bytes on,
again on h bytes agree on 2h. Each level reuses the identifiers of the level before, for the
refined suffixes as for those that point to them, so depth doubles: 3, 6, 12 ... bytes. Buckets
of one suffix are final and leave.

Two things make it a Spark job. An identifier is a fingerprint of the bucket's content, not its
rank, so tasks agree on it without a global sort and a bucket's members need never meet. And not
all suffixes are sorted: of each window of ``size`` bytes one anchor suffix is (see ``repeats``);
the windows around an anchor are decided together as far as possible and one by one only where
the texts part. Sizes of buckets are counted with map-side combining, so a bucket with a third of
all suffixes is a row per task.

Defined cases: a null text is empty; texts shorter than the window lose nothing; a null
identifier stays null; rows that repeat are copies of each other and lose everything they share;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import repeats
from plumbline.llm.kernels import window_argmin
from plumbline.storage import materialise

SIZE = 400
SPREAD = 96
#: Bytes that a task refines at once.
SLICE = 1 << 18
_FIRST = 3
_K1, _K2, _K3 = (np.uint64(k) for k in
                 (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of the bucket whose suffixes have identifier a here and b later on."""
    x = a * _K1
    x ^= x >> np.uint64(32)
    x += b * _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


class Buckets:
    """Bucket identifiers of all suffixes of a byte string, by depth."""

    def __init__(self, data: np.ndarray, depth: int):
        wide = data.astype(np.uint64)
        first = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
        self.levels = {_FIRST: _pair(first, first)}
        h = _FIRST
        while 2 * h <= depth and len(self.levels[h]) > h:
            ids = self.levels[h]
            self.levels[2 * h] = _pair(ids[:-h], ids[h:])
            h *= 2

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Identifiers at the depths ``length``, all within a factor of two of one level."""
        h = max(h for h in self.levels if h <= length.min())
        assert length.max() <= 2 * h
        ids = self.levels[h]
        return _pair(_pair(ids[start], ids[start + length - h]), length.astype(np.uint64))


def _anchor_rows(size: int, spread: int, slice_units: int):
    gram = max(h for h in (_FIRST << k for k in range(16)) if h <= min(24, size - spread + 1))

    def ranges(data: np.ndarray, ends: np.ndarray):
        count = len(data) - size + 1
        if count <= 0:
            return None
        buckets = Buckets(data, size)
        anchor = window_argmin(buckets.levels[gram][:count + spread - 1], spread)
        first, last = repeats.window_ranges(anchor, ends, size)
        if not len(first):
            return None
        at = anchor[first]
        f = buckets.of(at, np.full(len(at), size - spread + 1))
        e = buckets.of(first, last - first + size)
        e = _pair(e, ((at - first) << 8 | last - first).astype(np.uint64))
        return first, last - first + 1, f, e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            flat, offsets = repeats.binary_views(batch.column(2))
            for low, high in repeats.slices(offsets, slice_units):
                begin, stop = int(offsets[low]), int(offsets[high])
                step = slice_units
                # a long text is cut into slices that share size - 1 bytes: no window is lost
                for at in range(begin, max(begin + 1, stop - size + 1), step):
                    until = min(stop, at + step + size - 1) if high == low + 1 else stop
                    found = ranges(flat[at:until], offsets[low + 1:high + 1] - at)
                    if found is not None:
                        first, count, f, e = found
                        doc = np.searchsorted(offsets, first + at, "right") - 1
                        start = first + at - offsets[doc]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[doc]), pa.array(repeats.pack(tags[doc], start, count)),
                             pa.array(f.view(np.int64)), pa.array(e.view(np.int64))],
                            names=["id", "p", "f", "e"])
                    if high > low + 1:
                        break

    return run


_STAGE = ("id long, tag long, n_bytes long, spans array<struct<start:long,end:long>>, "
          "kept_sha256 string, body binary, sure array<long>, "
          "windows array<struct<p:long,f:long,h:long>>")


def _spans(n: int, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows of the given ranges of starts."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    low, high = first[order], np.maximum.accumulate((first + count - 1 + size)[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new], np.concatenate([high[:-1][new[1:]], high[-1:]])


def _result(body: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
    digest, at = hashlib.sha256(), 0
    view = memoryview(body)
    for a, b in zip(low.tolist(), high.tolist()):
        digest.update(view[at:a])
        at = b
    digest.update(view[at:])
    return len(body), [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())], \
        digest.hexdigest()


def _decide(size: int):
    """Finish documents without open ranges; name the windows of the others' open ranges."""
    schema = pa.schema([
        ("id", pa.int64()), ("tag", pa.int64()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_sha256", pa.string()), ("body", pa.binary()), ("sure", pa.list_(pa.int64())),
        ("windows", pa.list_(pa.struct([("p", pa.int64()), ("f", pa.int64()), ("h", pa.int64())])))])

    def windows(body: bytes, tag: int, opened: list[dict]) -> list[dict]:
        data = np.frombuffer(body, np.uint8)
        found, seen = [], set()
        for one in opened:
            if one["p"] in seen:                 # rows that repeat have their ranges twice
                continue
            seen.add(one["p"])
            start, count = (int(x) for x in repeats.starts_and_counts(np.int64(one["p"])))
            part = data[start:start + count - 1 + size]
            at = np.arange(count)
            ids = Buckets(part, size).of(at, np.full(count, size)).view(np.int64)
            packed = repeats.pack(np.int64(tag), start + at, np.int64(1))
            found += [{"p": p, "f": one["f"], "h": h} for p, h in zip(packed.tolist(), ids.tolist())]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for ident, tag, body, sure, opened in zip(*(batch.column(i) for i in range(5))):
                ident, tag, body = ident.as_py(), tag.as_py(), body.as_py()
                sure, opened = sure.as_py() or [], opened.as_py() or []
                if opened:
                    out.append((ident, tag, None, None, None, body, sure,
                                windows(body, tag, opened)))
                    held += len(body) + 64 * len(out[-1][-1])
                else:
                    first, count = repeats.starts_and_counts(np.array(sure, np.int64))
                    out.append((ident, tag, *_result(body, *_spans(len(body), first, count, size)),
                                None, None, None))
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


_RESULT = ("id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def _finish(size: int):
    schema = pa.schema([
        ("id", pa.int64()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, body, sure in zip(*(batch.column(i) for i in range(3))):
                body = body.as_py()
                first, count = repeats.starts_and_counts(np.array(sure.as_py(), np.int64))
                out.append((ident.as_py(),
                            *_result(body, *_spans(len(body), first, count, size))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE, spread: int = SPREAD,
                   slice_units: int = SLICE) -> DataFrame:
    """Per row the maximal runs of bytes covered by strings of ``size`` bytes that recur.

    Returns the identifier, ``n_bytes``, ``spans`` (start, end) in bytes and ``kept_sha256`` of
    the bytes outside them. Strings are judged on the input, within and across documents.
    """
    deepest = max(h for h in (_FIRST << k for k in range(32)) if h <= max(size, _FIRST))
    if not 1 < spread <= min(256, size - 2, 2 * deepest - size + 1):
        raise ValueError("spread must be from 2 to 256 and well below the window")
    texts = repeats.bodies(docs, id_col, text_col)
    anchors = texts.mapInArrow(_anchor_rows(size, spread, slice_units), repeats.ANCHORS)
    live = repeats.live_ranges(anchors)
    # a class of several ranges repeats itself; one member of each class meets the other classes
    sure, opened = F.expr("m > 1"), F.expr("several AND id = first.id AND p = first.p")
    per_doc = live.groupBy("id", repeats.tag_of("p").alias("tag")).agg(
        F.collect_list(F.when(sure, F.col("p"))).alias("sure"),
        F.collect_list(F.when(opened, F.struct("p", "f"))).alias("opened"))
    stage = materialise(
        texts.join(per_doc, ["id", "tag"], "left").select("id", "tag", "body", "sure", "opened")
        .mapInArrow(_decide(size), _STAGE))
    windows = stage.where("windows IS NOT NULL").select("id", F.inline("windows"))
    recurring = windows.groupBy("f", "h").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    found = (windows.join(recurring, ["f", "h"])
             .groupBy("id", repeats.tag_of("p").alias("tag"))
             .agg(F.collect_list("p").alias("found")))
    pending = (stage.where("body IS NOT NULL").join(found, ["id", "tag"], "left")
               .select("id", "body", F.concat("sure", F.coalesce("found", F.array().cast("array<long>")))
                       .alias("sure")))
    done = stage.where("body IS NULL").select("id", "n_bytes", "spans", "kept_sha256")
    return (done.unionByName(pending.mapInArrow(_finish(size), _RESULT))
            .select(repeats.named_id(id_col), "n_bytes", "spans", "kept_sha256"))


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select(id_col, "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
