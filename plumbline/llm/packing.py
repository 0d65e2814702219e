"""Packing documents into token windows by online sum-of-squares placement.

Each input task tokenizes its documents and places them one by one. A document of more than a
window is cut into whole windows; its rest is placed whole. ``levels[h]`` counts the open windows
filled to ``h`` tokens; a rest goes to the level (a new window counts as level 0) after which the
sum of the squared counts is smallest, ties to the fuller window. When a task has read all its
rows, the windows still open are closed without padding: pieces are cut freely to fill windows to
the brim, and the last incomplete one is cut into powers of two, which need no padding.

Nothing is shuffled: windows of different tasks are independent and numbered by task. The state
of a task is the level array and the pieces of its open windows with their token ids, as these may
be cut again at the end. The method keeps open windows few, but where nothing fits together (all
rests just over half a window) they are all of the task's input. The same input split gives the
same windows again after a lost executor.

Defined cases: a null text is empty and yields the end token only; a null identifier stays null;
rows that repeat are packed as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a task remembers; beyond that it starts again.
REMEMBERED_WORDS = 400_000

_SCHEMA = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
           "offset long")


#: The vocabulary's own pattern for pieces of a text that merges never cross (fixed value).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable characters up to U+017F but U+0130: they are in composed form and all engines class them alike.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*")
_END = b"\xff"


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary never joins across white space, so the ids of a text are the ids of the
    strings between its spaces and line ends, and one met before is looked up. New plain strings
    are cut into pieces by the vocabulary's pattern and merged by rank in ``tiktoken``; the byte
    0xFF, which no UTF-8 text holds, stands for the end of a piece. Merging by rank equals merging
    by rule because each token of this vocabulary encodes to itself (checked in the tests).
    Any other string goes through ``tokenizers`` as it is.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        import regex
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.find = regex.compile(_PIECES).findall
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        # the tokenizer's letters for bytes, read off the library
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        text = "".join(map(chr, range(0x800)))
        bytes_of = dict(zip(letters.pre_tokenize_str(text)[0][0], text.encode()))
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        ranks = {_END: 0}
        ids = [-1]
        single = [t for t in vocabulary if len(t.removesuffix("</w>")) == 1]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        for token in sorted(single, key=len) + merged:
            raw = token.removesuffix("</w>")
            if all(c in bytes_of for c in raw):
                key = bytes(bytes_of[c] for c in raw) + (_END if token.endswith("</w>") else b"")
                ranks[key] = len(ids)
                ids.append(vocabulary[token])
        for b in range(256):                     # the library wants a rank for each byte
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = len(ids)
                ids.append(-1)
        self.coded = [np.array([i], "<u4").tobytes() if i >= 0 else None for i in ids]
        self.merge = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks,
                                       special_tokens={})._encode_single_piece

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            coded = self.coded
            found = self.pieces[piece] = b"".join(
                [coded[r] for r in self.merge(piece.encode() + _END)])
        return found

    def _new(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._piece(p) for p in self.find(word.lower())])
        coded = self.model.encode(word, add_special_tokens=False)
        return np.array(coded.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        for word in set(words).difference(known):
            known[word] = self._new(word)
        coded = b"".join([known[w] for w in words])
        if len(known) > self.remembered:
            known.clear()
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        return coded


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


class SumOfSquares:
    """Open windows by fill level, with the pieces in each."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Add a piece of fewer tokens than a window; returns the window's pieces if now full."""
        room = self.window - size
        counts = self.levels[:room + 1]
        # change of the sum of squares when a window leaves level h and enters level h + size
        change = 2 * (self.levels[size:size + room + 1] - counts) + 2
        change[room] = 1 - 2 * counts[room]                 # full windows are not counted
        change[0] = 2 * self.levels[size] + 1               # a new window leaves no level
        usable = np.flatnonzero(counts > 0)
        best, at = change[0], 0
        if len(usable):
            costs = change[usable]
            least = costs.min()
            if least <= best:
                at = int(usable[np.flatnonzero(costs == least)[-1]])
        pieces = self._take(at) if at else []
        pieces.append(piece)
        if at + size == self.window:
            return pieces
        self.levels[at + size] += 1
        self.open.setdefault(at + size, []).append(pieces)
        return None

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        return self.open[level].pop()

    def rest(self) -> list[list]:
        """The windows still open, the fullest first."""
        found = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels[:] = {}, 0
        return found


def _close(windows: list[list], window: int) -> Iterator[list]:
    """Cut pieces freely so that open windows become full ones and powers of two.

    A piece is (document, start, length). The fullest windows are filled from the emptiest.
    """
    windows = [list(w) for w in windows]
    front, back = 0, len(windows) - 1
    while front < back:
        target, need = windows[front], window - sum(p[2] for p in windows[front])
        while need and front < back:
            source = windows[back]
            if not source:
                back -= 1
                continue
            doc, start, length = source.pop()
            taken = min(need, length)
            target.append((doc, start + length - taken, taken))
            if taken < length:
                source.append((doc, start, length - taken))
            need -= taken
        if need == 0:
            yield target
            front += 1
    last = windows[front] if front < len(windows) else []
    left = sum(p[2] for p in last)
    while left:
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            doc, start, length = last.pop()
            taken = min(need, length)
            part.append((doc, start + length - taken, taken))
            if taken < length:
                last.append((doc, start, length - taken))
            need -= taken
        yield part
        left -= size


def _pack(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = tokenizer_of(path), SumOfSquares(window)
        first_id = TaskContext.get().partitionId() << 40
        serial = 0
        waiting: dict[int, tuple] = {}          # documents with a piece in an open window
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal serial
            offset = 0
            for doc, start, length in pieces:
                ident, ids, total, base = waiting[doc]
                crc = zlib.crc32(ids[4 * (start - base):4 * (start - base + length)])
                rows.append((ident, start, length, crc, total, first_id + serial, offset))
                offset += length
            serial += 1

        doc = 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokenizer.encode(text or "") + end
                total = len(ids) // 4
                waiting[doc] = (ident, ids, total, 0)
                whole = total // window * window
                for start in range(0, whole, window):
                    emit([(doc, start, window)])
                if whole < total:
                    waiting[doc] = (ident, ids[4 * whole:], total, whole)
                    full = packer.place((doc, whole, total - whole), total - whole)
                    if full:
                        emit(full)
                        for d, _, _ in full:
                            del waiting[d]
                else:
                    del waiting[doc]
                doc += 1
            if len(rows) >= 4000:
                yield _batch(rows)
                rows.clear()
        for pieces in _close(packer.rest(), window):
            emit(pieces)
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    Returns the identifier, ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), ``doc_tokens``, ``sequence_id`` and ``offset``. A sequence whose
    length is neither the window nor a power of two does not occur, so nothing is padded.
    ``tokenizer_path`` must name a file that every executor can read.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _pack(tokenizer_path, window, end_id), _SCHEMA).withColumnRenamed("id", id_col)
