"""Near-duplicate records: blocked pair search that stays linear in hot blocks.

Records are blocked by e-mail prefix or phone suffix. Two records match when their e-mails or
phones are equal or their names are similar. Instead of building every pair of a block:

* identical contacts collapse to one record with a count before anything is joined;
* equal e-mails and phones are reported as groups with their exact number of pairs, so a
  value shared by a third of all rows is one result row;
* similar names of a large block are found by what they have in common. The blocks that the ratio
  matches are in order in both names, so names of two lengths that are similar keep a common text
  of ``m`` characters when the others are left out. Names with few such texts (``VARIANTS``) are
  joined on block and text: only names that share ``m`` characters in order ever meet;
* for longer names there is a segment index: a ratio of 0.82 leaves at most ``d`` characters of the
  two names unmatched. Of ``d + 1`` segments of the longer name one is whole in the shorter name,
  moved by no more places than characters are unmatched; names are joined on block, both
  lengths, segment and its text. Where a segment is as common as a family name, the rest of the
  longer name is cut into ``d + 1`` segments in turn, and one of those must be there as well.
  Small blocks are compared directly, and names beyond ``LONGEST`` characters are joined on rare
  characters: two similar names share so many that their rarest ones must overlap. Whatever meets
  passes exact bounds (lengths, shared characters, edit distance) before its ratio is taken, so no
  similar pair is lost. Hot join keys are cut into a grid of bounded cells.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.similarity import (
    LEAST_SHARE, NAME_THRESHOLD, character_bits, character_tokens, fewest_matches, leading_tokens,
    name_ratio, similar_bound)
from plumbline.functions.text import block_key, column, email_key, literal, phone_key, strip
from plumbline.operators.columns import ROW_ID, data_columns
from plumbline.storage import local_table, materialise

# Names meeting in one task cell of a hot join key.
CELL_NAMES = 2000
# Blocks of up to this many names are compared directly.
DIRECT_NAMES = 48
# Characters of the longest name in the segment index; its number of keys grows with the cube.
LONGEST = 32
# Names of two lengths meet by their common text where neither has more texts of that length.
VARIANTS = 256
# Pairs that a segment may bring together before the rest of the name is looked at, too.
COMMON_PAIRS = 4096

# Fixed values of the evidence.
CONFIDENCE = "LOW"
ACTION = "Review manually; do not auto-merge or delete."

RESULT_COLUMNS = [
    "kind", "block", "key", "name_a", "name_b", "first_row_a", "first_row_b",
    "similarity", "record_count", "pair_count",
]


def contacts(df: DataFrame, person: str, email: str | None, phone: str | None) -> DataFrame:
    """Distinct normalised (block, name, email, phone) with their records.

    ``identical_pairs`` counts pairs of records equal in every column, which are exact
    duplicates and not near ones.
    """
    def key(make, name):
        return make(f"cast({column(name)} AS string)") if name else "cast(null AS string)"

    # names may be the same column as a contact column, so rows are compared on all of them
    others = [c for c in data_columns(df) if c not in (person, email, phone)]
    used = [c for c in (person, email, phone) if c]
    keyed = df.selectExpr(
        f"coalesce(lower({strip(f'cast({column(person)} AS string)')}), '') AS name",
        f"{key(email_key, email)} AS email", f"{key(phone_key, phone)} AS phone",
        ROW_ID, f"sha2(to_json(struct({', '.join(map(column, used + others))})), 256) AS whole")
    block = block_key("email" if email else None, "phone" if phone else None)
    copies = (
        keyed.selectExpr("*", f"{block} AS block").where("block IS NOT NULL")
        .groupBy("block", "name", "email", "phone", "whole")
        .agg(F.expr("count(*) AS n"), F.expr(f"min({ROW_ID}) AS first_row")))
    return copies.groupBy("block", "name", "email", "phone").agg(*map(F.expr, [
        "sum(n) AS n", "sum(n * (n - 1) DIV 2) AS identical_pairs",
        "min(first_row) AS first_row"]))


def _pairs(n: str) -> str:
    return f"({n} * ({n} - 1) DIV 2)"


def equal_groups(found: DataFrame) -> DataFrame:
    """Groups of records with the same e-mail, phone or name inside a block.

    Pair counts do not overlap: phone groups leave out pairs that share the e-mail, name
    groups those that share either.
    """
    by_email = (
        found.where("email IS NOT NULL").groupBy("block", F.expr("email AS key"))
        .agg(*map(F.expr, [
            "'email' AS kind", "sum(n) AS record_count",
            f"{_pairs('sum(n)')} - sum(identical_pairs) AS pair_count"])))
    per_email = (
        found.where("phone IS NOT NULL").groupBy("block", "phone", "email")
        .agg(F.expr("sum(n) AS n"), F.expr("sum(identical_pairs) AS identical_pairs")))
    by_phone = per_email.groupBy("block", F.expr("phone AS key")).agg(*map(F.expr, [
        "'phone' AS kind", "sum(n) AS record_count",
        f"{_pairs('sum(n)')} - coalesce(sum(CASE WHEN email IS NOT NULL THEN {_pairs('n')} END), 0)"
        " - coalesce(sum(CASE WHEN email IS NULL THEN identical_pairs END), 0) AS pair_count"]))
    named = found.where("name != ''")
    parts = named.groupBy("block", "name").agg(F.expr("sum(n) AS n"))
    shared = named.selectExpr(
        "block", "name", "n",
        """inline(filter(array(
            named_struct('sign', 1, 'email', email, 'phone', cast(null AS string)),
            named_struct('sign', 1, 'email', cast(null AS string), 'phone', phone),
            named_struct('sign', -1, 'email', email, 'phone', phone)),
            x -> (x.sign = 1 AND (x.email IS NOT NULL OR x.phone IS NOT NULL))
                OR (x.email IS NOT NULL AND x.phone IS NOT NULL)))""")
    explained = (
        shared.groupBy("block", "name", "sign", "email", "phone")
        .agg(F.expr("sum(n) AS n"))
        .groupBy("block", "name").agg(F.expr(f"sum(sign * {_pairs('n')}) AS explained")))
    by_name = parts.where("n > 1").join(explained, ["block", "name"], "left").selectExpr(
        "block", "name AS key", "'name' AS kind", "n AS record_count",
        f"{_pairs('n')} - coalesce(explained, 0) AS pair_count")
    return by_email.unionByName(by_phone).unionByName(by_name).where("pair_count > 0")


def _sides(names: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of rows for a self-join, their name columns told apart."""
    columns = ["name", "first_row", "len", "bits", "more"]
    return tuple(names.selectExpr(*keep, *(f"{c} AS {c}_{side}" for c in columns)) for side in "ab")


def _direct(names: DataFrame) -> DataFrame:
    a, b = _sides(names, "block")
    return a.join(b, "block").where(f"name_a < name_b AND {similar_bound('_a', '_b')}")


def _short_lengths(variants: int) -> list[tuple[int, int, int]]:
    """Lengths (shorter, longer) of names that meet by a common text, and the length of the text."""
    found = []
    for lb in range(1, LONGEST + 1):
        for la in range(1, lb + 1):
            m = ceil(NAME_THRESHOLD / 2 * (la + lb) - 1e-9)
            if m <= la and 2 * m < la + lb and max(comb(la, m), comb(lb, m)) <= variants:
                found.append((la, lb, m))
    return found


def _common_texts(names: DataFrame, lengths: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs of names of these lengths that have enough characters in common, in order.

    Each name is left with ``m`` characters in every way, for the lengths its block holds. The
    shuffle carries the hash of block and text, two numbers and the row id that names the name.
    """
    partners: dict[int, set] = {}
    for la, lb, m in lengths:
        partners.setdefault(la, set()).add((lb, m))
        partners.setdefault(lb, set()).add((la, m))
    known = local_table(names.sparkSession, [
        {"len": n, "others": [{"other": o, "m": m} for o, m in sorted(others)]}
        for n, others in partners.items()], "len int, others array<struct<other:int,m:int>>")
    texts = names.join(F.broadcast(known), "len").selectExpr(
        "block", "first_row", "len", "name AS text", "1 AS at",
        """explode(array_distinct(transform(
            filter(others, o -> array_contains(lengths, o.other)), o -> o.m))) AS m""")
    for step in range(max((lb - m for _, lb, m in lengths), default=0)):
        # characters go in order; of equal neighbours the first goes first
        texts = texts.selectExpr(
            "*", f"explode(IF({step} < len - m, sequence(at, m + 1), array(0))) AS p").where(
            "p <= at OR substring(text, p, 1) != substring(text, p - 1, 1)").selectExpr(
            "block", "first_row", "len", "m", "IF(p = 0, at, p) AS at",
            "IF(p = 0, text, concat(substring(text, 1, p - 1), substring(text, p + 1))) AS text")
    keyed = texts.selectExpr("xxhash64(block, m, text) AS k", "m", "len", "first_row")
    a, b = (keyed.selectExpr("k", *(f"{c} AS {c}_{side}" for c in ("m", "len", "first_row"))) for side in "ab")
    met = a.join(b, "k").where(
        f"first_row_a < first_row_b AND m_a = m_b AND m_a = {fewest_matches('len_a', 'len_b')}").select(
        "first_row_a", "first_row_b").distinct()
    one, two = (names.selectExpr(*(f"{c} AS {c}_{side}" for c in (
        "block", "name", "first_row", "len", "bits", "more"))) for side in "ab")
    return met.join(one, "first_row_a").join(two, "first_row_b").where(
        f"block_a = block_b AND {similar_bound('_a', '_b')}").withColumnRenamed("block_a", "block")


def _segments(names: DataFrame, longer: bool, short: list[tuple[int, int, int]]) -> DataFrame:
    """Segments of names as the longer name of a pair, or where they may lie in a shorter one.
    Only lengths that the block holds make pairs; those in ``short`` are left out.

    ``la`` and ``lb`` are the lengths of the shorter and the longer name, ``d`` how many of their
    characters may be unmatched, ``low`` and ``high`` how far a segment may have moved.
    """
    share = f"{LEAST_SHARE}D"
    if longer:
        sized = names.where("len > 1").selectExpr(
            "*", "len AS lb", f"explode(sequence(cast(ceil(len * {share} - 1e-9D) AS int), len)) AS la")
    else:
        sized = names.where("len > 0").selectExpr(
            "*", "len AS la", f"explode(sequence(len, cast(floor(len / {share} + 1e-9D) AS int))) AS lb"
        ).where(f"lb <= {LONGEST}")
    listed = ", ".join(str(la * (LONGEST + 1) + lb) for la, lb, _ in short) or "-1"
    sized = sized.where(f"array_contains(lengths, {'la' if longer else 'lb'})"
                        f" AND la * {LONGEST + 1} + lb NOT IN ({listed})")
    # equal lengths without an unmatched character are equal names
    sized = sized.selectExpr("*", f"{fewest_matches('la', 'lb')} AS m").selectExpr(
        "*", "la + lb - 2 * m AS d", "m - lb AS low", "la - m AS high").where("d > 0 AND la >= m")
    return sized.selectExpr("*", "explode(sequence(0, d)) AS segment").selectExpr(
        "*", "cast(segment * lb DIV (d + 1) AS int) AS start",
        "cast((segment + 1) * lb DIV (d + 1) AS int) AS stop")


def _texts(rows: DataFrame, key: str, start: str, size: str, longer: bool) -> DataFrame:
    """``k``: the hash of ``key`` and of the text there, for the shorter name at every place it
    may have moved to."""
    if longer:
        return rows.selectExpr("*", f"xxhash64({key}, substring(name, {start} + 1, {size})) AS k")
    places = f"sequence(greatest(0, {start} + low), least(la - {size}, {start} + high))"
    return rows.where(f"greatest(0, {start} + low) <= least(la - {size}, {start} + high)").selectExpr(
        "*", f"explode(array_distinct(transform({places}, p -> xxhash64({key},"
        f" substring(name, p + 1, {size}))))) AS k")


def _segment_pairs(names: DataFrame, common_pairs: int, short: list[tuple[int, int, int]]) -> DataFrame:
    key, size = "block, la, lb, segment", "(stop - start)"
    longer, shorter = (_texts(_segments(names, side, short), key, "start", size, side) for side in (True, False))
    counts = [rows.groupBy("k").agg(F.count("*").alias(n)) for rows, n in ((longer, "n"), (shorter, "m"))]
    met = counts[0].join(counts[1], "k")
    met = materialise(met.selectExpr("k", f"n * m > {common_pairs} AS common"))
    longer, shorter = (rows.join(met, "k") for rows in (longer, shorter))
    columns = ["block", "name", "first_row", "len", "bits", "more"]

    def pairs(one: DataFrame, two: DataFrame) -> DataFrame:
        a = one.selectExpr("k", *(f"{c} AS {c}_a" for c in columns))
        b = two.selectExpr("k", *(f"{c} AS {c}_b" for c in columns))
        # a hash that names two texts only costs time
        return a.join(b, "k").where(
            "block_a = block_b AND (len_a > len_b OR (len_a = len_b AND name_a < name_b))"
            f" AND {similar_bound('_a', '_b')}").selectExpr(
            "block_a AS block", "name_a", "name_b", "first_row_a", "first_row_b")

    # the rest of the longer name in d + 1 parts; one over the segment ends before it
    rest = f"(lb - {size})"
    begin, end = f"(part * {rest} DIV (d + 1))", f"((part + 1) * {rest} DIV (d + 1))"
    fine = [
        _texts(rows.where("common").withColumnRenamed("k", "whole").selectExpr(
            "*", "explode(sequence(0, d)) AS part").selectExpr(
            "*", f"cast({begin} + IF({begin} >= start, {size}, 0) AS int) AS at",
            f"cast(IF({begin} < start AND {end} > start, start, {end}) - {begin} AS int) AS width"),
            "whole, part", "at", "width", side)
        for rows, side in ((longer, True), (shorter, False))]
    return pairs(longer.where("NOT common"), shorter.where("NOT common")).unionByName(pairs(*fine))


def _rare_characters(names: DataFrame, cell_names: int) -> DataFrame:
    """Pairs of distinct names of a block that share a rare character and enough others."""
    tokens = names.selectExpr("*", f"{character_tokens('name')} AS tokens")
    keyed = tokens.selectExpr("*", f"{leading_tokens('tokens')} AS leading").selectExpr(
        "*", "explode(leading) AS token")
    sizes = (
        keyed.groupBy("block", "token").agg(F.expr("count(*) AS size"))
        .where(f"size > {cell_names}")
        .selectExpr("block", "token", f"cast(ceil(size / {cell_names}) AS int) AS side"))
    placed = keyed.join(sizes, ["block", "token"], "left").selectExpr(
        "block", "token", "name", "first_row", "len", "bits", "more", "leading",
        "coalesce(side, 1) AS side",
        "cast(pmod(xxhash64(name), coalesce(side, 1)) AS int) AS cell")
    # cell (p, q) of the grid joins the names of part p with those of part q
    a, b = _sides(placed, "block", "token", "side", "cell", "leading")
    a = a.selectExpr("*", "cell AS p", "explode(sequence(cell, side - 1)) AS q").drop("cell", "side")
    b = b.selectExpr("*", "explode(sequence(0, cell)) AS p", "cell AS q").drop("cell", "side")
    return (
        a.withColumnRenamed("leading", "leading_a")
        .join(b.withColumnRenamed("leading", "leading_b"), ["block", "token", "p", "q"])
        .where(f"p < q OR name_a < name_b").where(f"greatest(len_a, len_b) > {LONGEST}")
        .where(similar_bound("_a", "_b"))
        # a pair meets under every shared token: keep its rarest one only
        .where("array_intersect(leading_a, leading_b)[0] = token"))


def candidates(names: DataFrame, cell_names: int = CELL_NAMES, direct_names: int = DIRECT_NAMES,
               common_pairs: int = COMMON_PAIRS, variants: int = VARIANTS) -> DataFrame:
    """Pairs of distinct names of a block that may be similar, the one that appears first first.

    ``first_row`` is the first row of a block and name, so no two names share one.
    """
    names = names.selectExpr("block", "name", "first_row", "length(name) AS len",
                             f"inline(array({character_bits('name')}))")
    sizes = names.groupBy("block").agg(
        F.count("*").alias("size"), F.expr(f"collect_set(IF(len <= {LONGEST}, len, NULL)) AS lengths"))
    large = materialise(sizes.where(f"size > {direct_names}").select("block", "lengths"))
    small = materialise(sizes.where(f"size > 1 AND size <= {direct_names}").select("block"))
    inside = materialise(names.join(large, "block"))
    short = _short_lengths(variants)
    indexed = inside.where(f"len <= {LONGEST}")
    columns = ["block", "name_a", "name_b", "first_row_a", "first_row_b"]
    found = (
        _direct(names.join(small, "block", "left_semi")).select(*columns)
        .unionByName(_common_texts(indexed, short).select(*columns))
        .unionByName(_segment_pairs(indexed, common_pairs, short).select(*columns))
        .unionByName(_rare_characters(
            inside.where(f"len >= floor({LONGEST} * {LEAST_SHARE}D)"), cell_names).select(*columns)))
    return found.selectExpr(
        "block",
        "CASE WHEN first_row_a <= first_row_b THEN name_a ELSE name_b END AS name_a",
        "CASE WHEN first_row_a <= first_row_b THEN name_b ELSE name_a END AS name_b",
        "least(first_row_a, first_row_b) AS first_row_a",
        "greatest(first_row_a, first_row_b) AS first_row_b").distinct()


def similar_names(found: DataFrame, cell_names: int = CELL_NAMES) -> DataFrame:
    """Pairs of different but similar names inside a block.

    The ratio depends on the order of its arguments; the name that appears first comes first.
    ``pair_count`` counts record pairs that share neither e-mail nor phone.
    """
    names = found.where("name != ''").groupBy("block", "name").agg(
        F.expr("sum(n) AS n"), F.expr("min(first_row) AS first_row"))
    similar = materialise(
        candidates(names, cell_names)
        .withColumn("similarity", name_ratio("name_a", "name_b"))
        .where(f"similarity >= {NAME_THRESHOLD}D"))
    counts = names.select("block", "name", "n")
    similar = similar.join(
        counts.withColumnsRenamed({"name": "name_a", "n": "n_a"}), ["block", "name_a"]).join(
        counts.withColumnsRenamed({"name": "name_b", "n": "n_b"}), ["block", "name_b"])
    keys = found.where("name != ''").selectExpr(
        "block", "name", "n",
        """inline(filter(array(
            named_struct('sign', 1, 'key', concat('e', email)),
            named_struct('sign', 1, 'key', concat('p', phone)),
            named_struct('sign', -1, 'key', concat('b', email, ' ', phone))),
            x -> x.key IS NOT NULL))""").groupBy("block", "name", "sign", "key").agg(
        F.expr("sum(n) AS n"))
    left = keys.withColumnsRenamed({"name": "name_a", "n": "m_a"})
    right = keys.withColumnsRenamed({"name": "name_b", "n": "m_b"})
    explained = (
        similar.select("block", "name_a", "name_b")
        .join(left, ["block", "name_a"]).join(right, ["block", "name_b", "sign", "key"])
        .groupBy("block", "name_a", "name_b")
        .agg(F.expr("sum(sign * m_a * m_b) AS explained")))
    return similar.join(explained, ["block", "name_a", "name_b"], "left").selectExpr(
        "'similar_name' AS kind", "block", "name_a", "name_b", "first_row_a", "first_row_b",
        "bround(similarity, 3) AS similarity", "n_a + n_b AS record_count",
        "n_a * n_b - coalesce(explained, 0) AS pair_count")


def near_duplicates(
    df: DataFrame, person: str | None, email: str | None, phone: str | None,
    cell_names: int = CELL_NAMES,
) -> DataFrame:
    """Groups of equal contacts and pairs of similar names; ``pair_count`` adds up to the
    number of matching record pairs."""
    found = contacts(df, person or email or phone, email, phone)
    groups = equal_groups(found)
    pairs = similar_names(found, cell_names)
    return groups.unionByName(pairs, allowMissingColumns=True).select(*RESULT_COLUMNS)


def pair_evidence(
    df: DataFrame, person: str | None, email: str | None, phone: str | None,
    cell_names: int = CELL_NAMES,
) -> DataFrame:
    """Pairs of records to review, with what agrees and what differs.

    ``row_a`` and ``row_b`` (the earlier row first), ``similarity`` of the names, the names of
    ``matching_fields`` (a similar, not equal name is marked with ``~``) and of
    ``conflicting_fields``, ``confidence`` and ``recommended_action``. A record stands for all
    with its name, e-mail and phone. Records of one e-mail, phone or name are linked to the first
    of them instead of to each other, so a shared mailbox gives a row per record; similar names
    are linked by their first records.
    """
    found = materialise(contacts(df, person or email or phone, email, phone))
    links = None
    for key in ("email", "phone", "name"):
        held = found.where(f"coalesce({key}, '') != ''")
        first = held.groupBy("block", key).agg(F.min("first_row").alias("row_a"), F.count("*").alias("m"))
        one = held.join(first.where("m > 1"), ["block", key]).where("row_a < first_row").selectExpr(
            "row_a", "first_row AS row_b")
        links = one if links is None else links.unionByName(one)
    similar = similar_names(found, cell_names).selectExpr("first_row_a AS row_a", "first_row_b AS row_b")
    sides = [found.selectExpr(f"first_row AS row_{x}", *(f"{c} AS {c}_{x}" for c in ("name", "email", "phone")))
             for x in "ab"]
    pairs = links.unionByName(similar).distinct().join(sides[0], "row_a").join(sides[1], "row_b")
    # records that are equal in all three but not in the rest of their columns
    alike = found.where("n * (n - 1) DIV 2 > identical_pairs").selectExpr(
        "first_row AS row_a", "first_row AS row_b", *(
            f"{c} AS {c}_{x}" for x in "ab" for c in ("name", "email", "phone")))
    named = "(name_a != '' AND name_b != '')"
    pairs = pairs.unionByName(alike).withColumn("ratio", name_ratio("name_a", "name_b")).selectExpr(
        "*", f"IF({named}, ratio, 0D) AS similarity")
    fields = [(c, name) for c, name in (("email", email), ("phone", phone)) if name]
    agree = [f"IF({c}_a = {c}_b, {literal(name)}, null)" for c, name in fields]
    differ = [f"IF({c}_a != {c}_b, {literal(name)}, null)" for c, name in fields]
    if person:
        close = f"similarity >= {NAME_THRESHOLD}D"
        agree.append(f"CASE WHEN NOT {named} THEN null WHEN name_a = name_b THEN {literal(person)}"
                     f" WHEN {close} THEN {literal(person + '~')} END")
        differ.append(f"IF({named} AND name_a != name_b AND NOT {close}, {literal(person)}, null)")
    kept = "filter(array({}), x -> x IS NOT NULL)"
    return pairs.selectExpr(
        "row_a", "row_b", "bround(similarity, 3) AS similarity",
        f"{kept.format(', '.join(agree))} AS matching_fields",
        f"{kept.format(', '.join(differ))} AS conflicting_fields",
        f"{literal(CONFIDENCE)} AS confidence", f"{literal(ACTION)} AS recommended_action")
