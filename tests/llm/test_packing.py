"""Packing: every id once, no padding, the ids of the public tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing, queries

PATH = queries.tokenizer_path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_each_token_of_the_vocabulary_encodes_to_itself(plain):
    """What makes merging by rank equal to merging by rule."""
    vocabulary = plain.get_vocab(with_added_tokens=False)
    whole = [t for t in vocabulary if t.endswith("</w>") and t != "</w>"]
    model = plain.model
    assert all([x.id for x in model.tokenize(t.removesuffix("</w>"))] == [vocabulary[t]]
               for t in whole)


@pytest.mark.parametrize("text", [
    "", " ", "Plain words, don't I'LL they've", "Straße ΣΟΦΟΣ İstanbul ½ ² a\tb", "x́ é",
    "<|endoftext|> <|startoftext|>", "日本語 — “q” 😀", "a b c\x1cd", "12345 1a2b", "__--!!",
    "­ªſı"])
def test_ids_are_the_tokenizers(plain, text):
    found = np.frombuffer(packing.WordTokenizer(PATH).encode(text), "<u4").tolist()
    assert found == plain.encode(text, add_special_tokens=False).ids


def check(plain, rows, pieces, window):
    wanted = defaultdict(list)
    for ident, text in rows:
        wanted[ident].append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(wanted)
    for ident, found in by_doc.items():
        if len(wanted[ident]) > 1:               # repeated rows: as many ids in all
            assert sum(p.length for p in found) == sum(map(len, wanted[ident]))
            continue
        ids, at = np.array(wanted[ident][0], "<u4"), 0
        for p in sorted(found, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for lengths in by_sequence.values():
        at = 0
        for offset, length in sorted(lengths):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("window", [16, 256, 2048])
def test_pack(make, corpus, plain, window):
    pieces = packing.pack_documents(make(corpus), PATH, window=window).collect()
    check(plain, corpus, pieces, window)
    assert packing.pack_documents(make([]), PATH).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(4)
    packer = packing.SumOfSquares(64)
    for k in range(400):
        size = int(rng.integers(1, 64))
        before = packer.levels[:64].copy()

        def after(level):
            counts = before.copy()
            counts[0] = 0
            if level:
                counts[level] -= 1
            if level + size < 64:
                counts[level + size] += 1
            return int((counts ** 2).sum())

        options = [0] + [h for h in range(1, 65 - size) if before[h]]
        packer.place((k, 0, size), size)
        now = packer.levels[:64].copy()
        now[0] = 0
        assert int((now ** 2).sum()) == min(after(h) for h in options)


def test_closing_leaves_no_padding():
    windows = [[(0, 0, 60)], [(1, 5, 50), (2, 0, 3)], [(3, 0, 30)], [(4, 0, 7)]]
    closed = list(packing._close(windows, 64))
    sizes = [sum(p[2] for p in w) for w in closed]
    assert sum(sizes) == 150 and all(s & (s - 1) == 0 for s in sizes)
    ids = sorted((d, k) for w in closed for d, s, n in w for k in range(s, s + n))
    assert ids == sorted((d, k) for w in windows for d, s, n in w for k in range(s, s + n))
