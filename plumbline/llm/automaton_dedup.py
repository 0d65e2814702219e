"""Substring dedup of word sequences with suffix automata of reference shards.

A word goes when a window of ``size`` words that covers it also starts earlier in the corpus
(a smaller identifier, or the same document further up). Ranges of windows that can recur are
found first (see ``repeats``). Ranges that are equal as a whole are decided by their class: all
but the first go. One range of each other class is a *reference*: references that share an anchor
form a bucket, a bucket is cut into shards of about ``shard_ranges`` ranges, and each shard
becomes one suffix automaton whose states know their first occurrence. The bucket's ranges are
streamed through it; where the matching statistics reach ``size`` words, the state tells whether
that window occurs earlier.

A shard's automaton lives in the task that its bucket's ranges are sent to instead of being
broadcast: the references of the corpus against itself grow with the corpus, so there is no size
to prove. A bucket of any size is spread over shards; a range is a reference in one shard of its
bucket and is streamed through all of them.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null
identifier comes before all others; rows that repeat identifier and text are one occurrence, so
neither is earlier; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import repeats
from plumbline.llm.kernels import RangeHash, mix, window_argmin, word_hashes
from plumbline.storage import materialise

SIZE = 20
SPREAD = 11
SHARD_RANGES = 4096
#: Words that a task hashes at once.
SLICE = 1 << 17
_GRAM = 3


class SuffixAutomaton:
    """All substrings of the texts added, with the place of their first occurrence."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]               # end of the first occurrence, counted over all texts
        self.last = 0
        self.end = 0

    def add(self, words: list[int]) -> None:
        """Append a text; a separator of its own keeps matches inside one text."""
        for word in words:
            self._extend(word)
        self._extend((self.end,))

    def _extend(self, symbol) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        here = len(length)
        nexts.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        first.append(self.end)
        self.end += 1
        at = self.last
        while at != -1 and symbol not in nexts[at]:
            nexts[at][symbol] = here
            at = link[at]
        if at != -1:
            to = nexts[at][symbol]
            if length[to] == length[at] + 1:
                link[here] = to
            else:
                copy = len(length)
                nexts.append(dict(nexts[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                first.append(first[to])
                while at != -1 and nexts[at].get(symbol) == to:
                    nexts[at][symbol] = copy
                    at = link[at]
                link[to] = link[here] = copy
        self.last = here

    def first_ends(self, words: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(start in ``words``, end of the first occurrence) of each window that occurs."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= size:
                state = link[state]
            matched = min(matched, length[state])
            if matched >= size:
                yield i + 1 - size, self.first[state]


def _words_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = int(offsets[0]), int(offsets[-1])
    return word_hashes(flat[low:high], offsets - low)


def _anchor_rows(size: int, spread: int, slice_units: int):
    def ranges(words: np.ndarray, ends: np.ndarray):
        count = len(words) - size + 1
        if count <= 0:
            return None
        hashed = RangeHash(words)
        anchor = window_argmin(hashed.grams(_GRAM)[:count + spread - 1], spread)
        first, last = repeats.window_ranges(anchor, ends, size)
        if not len(first):
            return None
        at = anchor[first]
        f = hashed.ranges(at, at + size - spread + 1)
        place = ((at - first) << 8 | last - first).astype(np.uint64)
        return first, last - first + 1, f, mix(hashed.ranges(first, last + size) ^ mix(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            flat, offsets = repeats.binary_views(batch.column(2))
            for low, high in repeats.slices(offsets, 1 << 20):
                words, below = _words_of(flat, offsets[low:high + 1])
                for a, b in repeats.slices(below, slice_units):
                    begin, stop = int(below[a]), int(below[b])
                    for at in range(begin, max(begin + 1, stop - size + 1), slice_units):
                        until = min(stop, at + slice_units + size - 1) if b == a + 1 else stop
                        found = ranges(words[at:until], below[a + 1:b + 1] - at)
                        if found is not None:
                            first, count, f, e = found
                            doc = np.searchsorted(below, first + at, "right") - 1
                            start = first + at - below[doc]
                            doc += low
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[doc]),
                                 pa.array(repeats.pack(tags[doc], start, count)),
                                 pa.array(f.view(np.int64)), pa.array(e.view(np.int64))],
                                names=["id", "p", "f", "e"])
                        if b > a + 1:
                            break

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_STAGE = ("id long, tag long, n_words long, spans array<struct<start:long,end:long>>, "
          "kept_sha256 string, body binary, sure array<long>, "
          "ranges array<struct<p:long,f:long,words:array<long>>>")
_RESULT = "id long, n_words long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def _cut(body: bytes, sure: np.ndarray, size: int) -> tuple:
    """Words, removed spans and the digest of what stays, given ranges of windows to remove."""
    words = body.split()
    first, count = repeats.starts_and_counts(sure)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + count - 1 + size, -1)
    removed = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
    spans = edges.reshape(-1, 2).tolist()
    if spans:
        words = [w for w, gone in zip(words, removed.tolist()) if not gone]
    return (len(removed), [{"start": a, "end": b} for a, b in spans],
            hashlib.sha256(b" ".join(words)).hexdigest())


def _decide(size: int):
    schema = pa.schema([
        ("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS),
        ("kept_sha256", pa.string()), ("body", pa.binary()), ("sure", pa.list_(pa.int64())),
        ("ranges", pa.list_(pa.struct([("p", pa.int64()), ("f", pa.int64()),
                                       ("words", pa.list_(pa.int64()))])))])

    def segments(body: bytes, opened: list[dict]) -> list[dict]:
        data = np.frombuffer(body, np.uint8)
        words = word_hashes(data, np.array([0, len(data)]))[0].view(np.int64)
        found = {}
        for one in opened:                       # rows that repeat have their ranges twice
            start, count = (int(x) for x in repeats.starts_and_counts(np.int64(one["p"])))
            found[one["p"]] = {"p": one["p"], "f": one["f"],
                               "words": words[start:start + count - 1 + size]}
        return list(found.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for ident, tag, body, sure, opened in zip(*(batch.column(i) for i in range(5))):
                ident, tag, body = ident.as_py(), tag.as_py(), body.as_py()
                sure, opened = sure.as_py() or [], opened.as_py() or []
                if opened:
                    out.append((ident, tag, None, None, None, body, sure, segments(body, opened)))
                    held += len(body) + 300 * len(out[-1][-1])
                else:
                    out.append((ident, tag, *_cut(body, np.array(sure, np.int64), size),
                                None, None, None))
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def _stream(size: int):
    """Shards arrive sorted, references first; yields the windows that occur earlier."""
    def flush(references: list[tuple], held: list) -> SuffixAutomaton:
        automaton, at = SuffixAutomaton(), 0
        references.sort(key=lambda r: (r[0], r[2], r[1]))      # by document and start
        held.clear()
        for ident, tag, start, words in references:
            automaton.add(words)
            held.append((at, ident, start))
            at = automaton.end
        return automaton

    def earlier(automaton: SuffixAutomaton, begins: list, held: list, one: tuple) -> list[int]:
        ident, _, start, words = one
        found = []
        for offset, end in automaton.first_ends(words, size):
            k = int(np.searchsorted(begins, end, "right")) - 1
            begin, other, first = held[k]
            if (other, first + end - begin - size + 1) < (ident, start + offset):
                found.append(offset)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, references, held, begins = None, [], [], None
        automaton = None
        out_id: list[int] = []
        out_p: list[int] = []

        def answer(one: tuple) -> None:
            ident, tag, start, _ = one
            for offset in earlier(automaton, begins, held, one):
                out_id.append(ident)
                out_p.append(tag << 40 | (start + offset) << 8)

        def build() -> None:
            nonlocal automaton, begins
            automaton = flush(references, held)
            begins = np.array([h[0] for h in held])
            for one in references:
                answer(one)

        for batch in batches:
            for f, shard, query, ident, p, words in zip(
                    *(batch.column(i).to_pylist() for i in range(6))):
                if (f, shard) != current:
                    if references and automaton is None:
                        build()
                    current, references, automaton = (f, shard), [], None
                one = (ident, p >> 40, p >> 8 & 0xFFFFFFFF, words)
                if not query:
                    references.append(one)
                elif references:
                    if automaton is None:
                        build()
                    answer(one)
            if out_id:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_id, pa.int64()), pa.array(out_p, pa.int64())], names=["id", "p"])
                out_id.clear()
                out_p.clear()
        if references and automaton is None:
            build()
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_id, pa.int64()), pa.array(out_p, pa.int64())], names=["id", "p"])

    return run


def _finish(size: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS),
                        ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(ident.as_py(), *_cut(body.as_py(), np.array(sure.as_py(), np.int64), size))
                   for ident, body, sure in zip(*(batch.column(i) for i in range(3)))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def earlier_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = SIZE, spread: int = SPREAD,
                  shard_ranges: int = SHARD_RANGES, slice_units: int = SLICE) -> DataFrame:
    """Per row the maximal runs of words covered by windows of ``size`` words seen earlier.

    Returns the identifier, ``n_words``, ``spans`` (start, end) in words and ``kept_sha256`` of
    the words outside them, joined by one space. Windows are judged on the input.
    """
    if not 1 < spread <= size - _GRAM + 1 or spread > 256:
        raise ValueError(f"spread must lie between 2 and size - {_GRAM - 1}")
    texts = repeats.bodies(docs, id_col, text_col)
    anchors = texts.mapInArrow(_anchor_rows(size, spread, slice_units), repeats.ANCHORS)
    live = repeats.live_ranges(anchors)
    is_first = F.expr("id = first.id AND p = first.p")
    per_doc = live.groupBy("id", repeats.tag_of("p").alias("tag")).agg(
        F.collect_list(F.when(~is_first, F.col("p"))).alias("sure"),
        F.collect_list(F.when(is_first & F.col("several"), F.struct("p", "f"))).alias("opened"))
    stage = materialise(
        texts.join(per_doc, ["id", "tag"], "left").select("id", "tag", "body", "sure", "opened")
        .mapInArrow(_decide(size), _STAGE))
    segments = stage.where("ranges IS NOT NULL").select("id", F.inline("ranges"))
    shards = live.where(is_first & F.col("several")).groupBy("f").agg(
        F.ceil(F.count("*") / shard_ranges).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("id", "p"), F.col("shards")).cast("int")
    routed = (segments.join(shards, "f")
              .withColumn("own", own)
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .select("f", "shard", (F.col("shard") != F.col("own")).alias("query"), "id", "p",
                      "words"))
    found = (routed.repartition("f", "shard").sortWithinPartitions("f", "shard", "query")
             .mapInArrow(_stream(size), "id long, p long")
             .groupBy("id", repeats.tag_of("p").alias("tag"))
             .agg(F.collect_set("p").alias("found")))
    pending = (stage.where("body IS NOT NULL").join(found, ["id", "tag"], "left")
               .select("id", "body", F.concat("sure", F.coalesce("found", F.array().cast("array<long>")))
                       .alias("sure")))
    done = stage.where("body IS NULL").select("id", "n_words", "spans", "kept_sha256")
    return (done.unionByName(pending.mapInArrow(_finish(size), _RESULT))
            .select(repeats.named_id(id_col), "n_words", "spans", "kept_sha256"))


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select(id_col, "n_words", removed.alias("n_removed"), "kept_sha256")
