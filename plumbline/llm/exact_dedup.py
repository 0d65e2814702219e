"""Exact dedup with Patricia-trie owners.

Every input task inserts its texts into a compressed radix trie whose terminal nodes hold the
owner, so a text that fills a third of all rows leaves a task as one row. The distinct texts are
partitioned by length and content hash; each partition reads them in that order and inserts the
full byte strings into a trie that holds one (length, hash) group at a time. Equality is decided
by the bytes on the trie's edges; the hash only places a text.

Memory: the first trie spills by subtree. When its strings pass ``spill_bytes``, the subtree that
holds most of them is emitted as partial owners and cut off; the second trie merges them.

Defined cases: a null text is the empty text; a null identifier loses to any other and is its own
keeper only where all are null; rows that repeat identifier and text carry the same result; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPILL_BYTES = 64 << 20

_PARTIAL = "length long, hash long, body binary, owner long, n long"
_OWNERS = "text_sha256 string, keep_id long, group_size long"


class RadixTrie:
    """Compressed trie over byte strings; an edge is a range of the first key that needed it."""

    def __init__(self, larger_wins: bool):
        self.larger_wins = larger_wins
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.root = _Node(b"", 0, 0)

    def insert(self, key: bytes, owner: int | None, n: int) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key, at, size)
                node.children[key[at]] = child
                self.bytes += size
                node = child
                break
            length = child.end - child.start
            if key[at:at + length] != child.key[child.start:child.end]:
                child = self._split(node, child, _common(key, at, child))
                length = child.end - child.start
            node = child
            at += length
        if node.count:
            if owner is not None and (node.owner is None or
                                      (owner > node.owner) == self.larger_wins):
                node.owner = owner
        else:
            node.terminal, node.owner = key, owner
        node.count += n

    @staticmethod
    def _split(parent: "_Node", child: "_Node", common: int) -> "_Node":
        middle = _Node(child.key, child.start, child.start + common)
        parent.children[child.key[child.start]] = middle
        child.start += common
        middle.children[child.key[child.start]] = child
        return middle

    def terminals(self, node: "_Node | None" = None) -> Iterator["_Node"]:
        stack = [node or self.root]
        while stack:
            node = stack.pop()
            if node.count:
                yield node
            stack.extend(node.children.values())

    def cut_largest(self) -> list["_Node"]:
        """Remove the subtree under the root that holds most bytes and return its terminals."""
        sizes = {first: sum(len(t.terminal) for t in self.terminals(child))
                 for first, child in self.root.children.items()}
        first = max(sizes, key=sizes.get)
        found = list(self.terminals(self.root.children.pop(first)))
        self.bytes -= sizes[first]
        return found


class _Node:
    __slots__ = ("key", "start", "end", "children", "terminal", "owner", "count")

    def __init__(self, key: bytes, start: int, end: int):
        self.key, self.start, self.end = key, start, end
        self.children: dict[int, _Node] = {}
        self.terminal, self.owner, self.count = None, None, 0


def _common(key: bytes, at: int, child: _Node) -> int:
    """How many bytes ``key`` from ``at`` shares with the child's edge, by halving."""
    low, high = 0, min(len(key) - at, child.end - child.start)
    while low < high:
        middle = (low + high + 1) // 2
        if key[at:at + middle] == child.key[child.start:child.start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _rows(nodes: list[_Node], hashes: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([len(t.terminal) for t in nodes], pa.int64()),
        pa.array([hashes[t.terminal] for t in nodes], pa.int64()),
        pa.array([t.terminal for t in nodes], pa.binary()),
        pa.array([t.owner for t in nodes], pa.int64()),
        pa.array([t.count for t in nodes], pa.int64())],
        names=["length", "hash", "body", "owner", "n"])


def _collapse(larger_wins: bool, spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hashes = RadixTrie(larger_wins), {}
        for batch in batches:
            for body, hashed, owner in zip(*(batch.column(i) for i in range(3))):
                body = body.as_py()
                hashes[body] = hashed.as_py()
                trie.insert(body, owner.as_py(), 1)
                if trie.bytes > spill_bytes and trie.root.children:
                    cut = trie.cut_largest()
                    yield from _pieces(cut, hashes)
                    for t in cut:
                        hashes.pop(t.terminal)
        yield from _pieces(list(trie.terminals()), hashes)

    return run


def _pieces(nodes: list[_Node], hashes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(nodes), 2000):
        yield _rows(nodes[i:i + 2000], hashes)


def _own(larger_wins: bool):
    def flush(trie: RadixTrie, out: list[tuple]) -> None:
        for t in trie.terminals():
            out.append((hashlib.sha256(t.terminal).hexdigest(), t.owner, t.count))
        trie.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = RadixTrie(larger_wins), None
        for batch in batches:
            out: list[tuple] = []
            for length, hashed, body, owner, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (length, hashed) != current:
                    flush(trie, out)
                    current = (length, hashed)
                trie.insert(body, owner, n)
            yield _owner_rows(out)
        out = []
        flush(trie, out)
        yield _owner_rows(out)

    return run


def _owner_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.int64())], names=["text_sha256", "keep_id", "group_size"])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
           spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct text: ``text_sha256``, ``keep_id`` and ``group_size``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    larger_wins = keep == "largest"
    body = F.coalesce(F.col(text_col), F.lit(""))
    partial = docs.select(
        body.cast("binary").alias("body"), F.xxhash64(body).alias("hash"),
        F.col(id_col).cast("long").alias("owner"),
    ).mapInArrow(_collapse(larger_wins, spill_bytes), _PARTIAL)
    return (partial.repartition("length", "hash").sortWithinPartitions("length", "hash")
            .mapInArrow(_own(larger_wins), _OWNERS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "largest", spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Every row of ``docs`` with the owner of its text.

    Returns the identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), digest.alias("text_sha256"))
    found = owners(docs, id_col, text_col, keep, spill_bytes)
    return rows.join(found, "text_sha256").select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def keep_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that own their text, with all their columns."""
    found = owners(docs, id_col, text_col, keep)
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    return docs.join(found, (digest == found["text_sha256"]) & docs[id_col].cast("long").eqNullSafe(
        found["keep_id"]), "left_semi")
