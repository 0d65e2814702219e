"""Name similarity. Ratcliff-Obershelp matching has no built-in Spark expression, so this
is the library's one Python UDF; it only sees candidate pairs that passed exact bounds."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T

# Fixed value: pairs of names at or above this ratio are similar.
NAME_THRESHOLD = 0.82

# The least share of a name's characters that a similar name must contain.
LEAST_SHARE = NAME_THRESHOLD / (2 - NAME_THRESHOLD)

# Letters from rare to common; characters not listed count as rarer still.
_COMMON = "qjxzwvkfybhgpmucdltsrinoae "


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(None)
    previous = None
    ratios = []
    for left, right in zip(a, b):
        # the matcher caches work on its second text, so keep it while it repeats
        if right != previous:
            matcher.set_seq2(right)
            previous = right
        matcher.set_seq1(left)
        ratios.append(matcher.ratio())
    return pd.Series(ratios, dtype="float64")


def character_tokens(c: str) -> str:
    """The text's characters as a set that numbers repeats ('anna' -> a1 n1 n2 a2).

    Tokens are ordered from rare to common, the same way for every text. The overlap of two
    such sets is the number of characters the texts share, an upper bound for what any
    alignment of them can match.
    """
    chars = f"filter(split({c}, ''), x -> x != '')"
    numbered = (
        f"transform({chars}, (x, i) -> named_struct("
        f"'repeat', -size(filter(slice({chars}, 1, i + 1), y -> y = x)),"
        f" 'common', instr('{_COMMON}', x), 'char', x))")
    return f"transform(array_sort({numbered}), t -> concat(t.char, -t.repeat))"


def leading_tokens(tokens: str) -> str:
    """The rarest tokens; two similar names must share at least one of theirs."""
    return (f"slice({tokens}, 1, size({tokens})"
            f" - cast(ceil(size({tokens}) * {LEAST_SHARE}D - 1e-9D) AS int) + 1)")


def fewest_matches(a: str, b: str) -> str:
    """How many characters two texts of these lengths must have in common to be similar."""
    return f"cast(ceil({NAME_THRESHOLD / 2}D * ({a} + {b}) - 1e-9D) AS int)"


def character_bits(c: str) -> str:
    """``bits`` marks the first and second occurrence of a text's characters, in 32 classes;
    ``more`` counts all further ones. Texts share at most as many characters as they share bits,
    and the smaller of their further ones."""
    counts = f"""aggregate(filter(split({c}, ''), x -> x != ''),
        named_struct('bits', 0L, 'more', 0),
        (s, x) -> named_struct(
            'bits', s.bits | IF((s.bits & shiftleft(1L, ascii(x) % 32 * 2)) = 0,
                shiftleft(1L, ascii(x) % 32 * 2), shiftleft(2L, ascii(x) % 32 * 2)),
            'more', s.more + IF((s.bits & shiftleft(2L, ascii(x) % 32 * 2)) = 0, 0, 1)))"""
    return counts


def similar_bound(a: str, b: str) -> str:
    """Necessary conditions for the similarity of names, on columns with these suffixes."""
    least = fewest_matches(f"len{a}", f"len{b}")
    return (f"least(len{a}, len{b}) >= {least}"
            f" AND bit_count(bits{a} & bits{b}) + least(more{a}, more{b}) >= {least}"
            f" AND levenshtein(name{a}, name{b}, len{a} + len{b} - 2 * {least}) >= 0")
