"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles of each in any common order. Here rare shingles come first: shingles
whose hash falls into the counted part of the hash space are ordered by how many documents hold
them, all others after them by hash. Shingles found common in a part of the documents come last, the
rarest of them first: a text joins by a passage that many hold only where the passage is nearly all
of it. Which part is looked at changes the order and so the work, never the links. Only shingles that
several documents hold can join, so what is left of a prefix is short and mostly empty.

Sets with the same size and the same joinable prefix form a group, and groups that share a prefix
shingle are candidates. They are joined in three steps. First each group is paired with the first
group of each of its shingles, and each member with the first of its group: as many pairs as
there are prefix shingles. What these links leave in different components is grouped again, now
by size, prefix and component. Second each group is compared with a few others drawn from those of
each of its shingles, and of each component drawn the most similar one is verified: a large family
of near copies, whose members are often not similar enough to its first one, meets here without its
pairs. Third all pairs of groups of components that still differ and share a prefix shingle are
filtered, expanded to their members and verified. So no link between different
texts is lost in the components, and members of one component are not compared with each other.

Pairs of groups are filtered by size, by how much they can still overlap from the shared shingle
on, and by a bitmap. A set's bitmap has a bit for each of ``BITS`` parts of the hash space, set
where it has an odd number of shingles; two sets differ in at least as many shingles as bits. A
group compares only bits in which all its members agree.

Copies are one set: they join nothing and take the set's component. Counting combines on the map
side and joins on hot keys are ones that Spark may split.

Defined cases: a null text or one without words has the empty set and is linked with nothing;
rows that share an identifier (or have none) are one document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import repeats
from plumbline.llm.components import components
from plumbline.llm.kernels import lower_ascii, mix, word_hashes
from plumbline.storage import materialise

SHINGLE = 3
PERCENT = 90
#: The part of the hash space whose shingles are counted, as a multiple of a prefix's share: a
#: document joins by a passage that others hold only where it has too few rare shingles.
COUNTED = 1.6
#: Common shingles are looked for in one of this many documents, ...
SAMPLE = 16
#: ... which must hold them so often. At most ``COMMON`` are kept, the most frequent ones.
OFTEN = 4
COMMON = 1 << 19
#: Groups drawn for each shingle in the second step.
DRAWN = 4
#: Bits of a set's bitmap.
BITS = 256
_WORDS = [f"b{k}" for k in range(BITS // 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words, below = word_hashes(lower_ascii(data), offsets)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        sums += words[k:len(words) - size + 1 + k] * factors[k] if len(sums) else np.uint64(0)
    sums = mix(sums)
    for a, b in zip(below[:-1].tolist(), below[1:].tolist()):
        if b - a >= size:
            yield np.unique(sums[a:b - size + 1])
        elif b > a:
            part = (words[a:b] * factors[:b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mix(part + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n, percent: int):
    """How many first shingles of a set of n must be looked at."""
    return n - (percent * n + 99) // 100 + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


_PROFILE = ("id long, n long, d1 long, d2 long, counted int, head array<long>, "
            + ", ".join(f"{w} long" for w in _WORDS))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each part, as 64-bit words."""
    odd = np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = repeats.binary_views(batch.column(1))
            for low, high in repeats.slices(offsets, 1 << 21):
                begin = int(offsets[low])
                for s in shingle_sets(flat[begin:int(offsets[high])], offsets[low:high + 1] - begin, size):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    return run


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many of the looked-at documents hold, and their order."""
    found = (texts.where(f"pmod(xxhash64(id), {SAMPLE}) = 0")
             .mapInArrow(_shingles(size), "token long")
             .groupBy("token").agg(F.count("*").alias("docs")).where(f"docs >= {OFTEN}")
             .orderBy(F.desc("docs"), "token").limit(COMMON).select("token").toArrow())
    tokens = found.column("token").combine_chunks().to_numpy().view(np.uint64)
    at = np.argsort(tokens)
    return tokens[at], (len(tokens) - at).astype(np.int32)


def common_last(sets: list[np.ndarray], common: np.ndarray, order: np.ndarray):
    """Each set with its common shingles at its end, and the number of others."""
    if not len(common) or not sets:
        return sets, [len(s) for s in sets]
    flat = np.concatenate(sets)
    at = np.searchsorted(common, flat)
    at[at == len(common)] = 0
    rank = np.where(common[at] == flat, order[at], 0)
    moved, others, begin = [], [], 0
    for s in sets:
        here = rank[begin:begin + len(s)]
        begin += len(s)
        few = len(s) - np.count_nonzero(here)
        moved.append(s if few == len(s) else s[np.argsort(here, kind="stable")])
        others.append(few)
    return moved, others


def _profiles(size: int, percent: int, counted: float, shared):
    """Set size, a digest of the set, and the shingles that can be in its prefix."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) * counted * (100 - percent) / 100)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            flat, offsets = repeats.binary_views(batch.column(1))
            for low, high in repeats.slices(offsets, 1 << 21):
                begin = int(offsets[low])
                n, d1, d2, among, heads, maps = [], [], [], [], [], []
                sets = list(shingle_sets(flat[begin:int(offsets[high])],
                                         offsets[low:high + 1] - begin, size))
                for s, others in zip(*common_last(sets, *shared.value)):
                    inside = int(np.searchsorted(s[:others], limit))
                    n.append(len(s))
                    d1.append(mix(s).sum(dtype=np.uint64))
                    d2.append(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    among.append(inside)
                    maps.append(bitmap(s))
                    heads.append(s[:max(inside, prefix_length(len(s), percent) if len(s) else 0)])
                at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                words = np.array(maps, np.int64).reshape(-1, len(_WORDS))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(n, pa.int64()),
                     pa.array(np.array(d1, np.uint64).view(np.int64)),
                     pa.array(np.array(d2, np.uint64).view(np.int64)),
                     pa.array(among, pa.int32()),
                     pa.ListArray.from_arrays(
                         pa.array(at), pa.array(np.concatenate(heads).view(np.int64))),
                     *(pa.array(words[:, k]) for k in range(len(_WORDS)))],
                    names=["id", "n", "d1", "d2", "counted", "head", *_WORDS])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = repeats.binary_views(batch.column(1))
            for low, high in repeats.slices(offsets, 1 << 21):
                begin = int(offsets[low])
                sets = list(shingle_sets(flat[begin:int(offsets[high])],
                                         offsets[low:high + 1] - begin, size))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(
                        pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["node", "shingles"])

    return run


def _prefixes(profiles: DataFrame, percent: int) -> DataFrame:
    """``id`` and ``prefix``: the joinable shingles of each document's prefix, with their rank."""
    held = profiles.select(
        "id", "n", "counted", F.posexplode("head").alias("pos", "token"))
    often = held.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    # counted shingles rank by number of documents, the others follow by hash
    entry = F.struct(
        F.when(F.col("pos") < F.col("counted"), F.col("docs")).otherwise(F.lit((1 << 62))).alias("docs"),
        "pos", "token")
    live = held.join(often, "token").groupBy("id", "n", "counted").agg(
        F.sort_array(F.collect_list(entry)).alias("live"),
        F.count_if(F.col("pos") < F.col("counted")).alias("inside"))
    ranked = F.transform("live", lambda x, i: F.struct(
        x["token"].alias("token"),
        F.when(x["pos"] < F.col("counted"), F.col("counted") - F.col("inside") + i)
        .otherwise(x["pos"]).cast("int").alias("rank")))
    length = F.expr(f"n - floor(({percent} * n + 99) / 100) + 1")
    return (live.withColumn("prefix", F.filter(ranked, lambda x: x["rank"] < length))
            .where("size(prefix) > 0").select("id", "n", "prefix"))


def _differ(left: list[str], right: list[str], mask: list[str] | None = None) -> str:
    """SQL for the number of bits that differ."""
    masks = [f" & {m}" for m in mask] if mask else [""] * len(left)
    return " + ".join(f"bit_count(({x} ^ {y}){m})" for x, y, m in zip(left, right, masks))


def _close(mine: str, theirs: str, percent: int, masks: tuple[str, ...] = ()) -> str:
    """SQL for what two sizes and bitmaps allow; prefixes name the two sides' columns and those of
    the masks that count."""
    bits = " + ".join(
        f"bit_count(({mine}v{k} ^ {theirs}v{k})" + "".join(f" & {m}a{k}" for m in masks) + ")"
        for k in range(len(_WORDS)))
    n, m = f"{mine}n", f"{theirs}n"
    return (f"100 * {n} >= {percent} * {m} AND 100 * {m} >= {percent} * {n}"
            f" AND {bits} <= floor({100 - percent} * ({n} + {m}) / {100 + percent}.0)")


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): a group's first member and the first of a shingle or of the own group."""
    groups = members.groupBy("n", "prefix").agg(F.min("node").alias("g"))
    index = groups.select("g", F.explode("prefix.token").alias("token"))
    heads = materialise(index.groupBy("token").agg(F.min("g").alias("head"), F.count("*").alias("m"))
                        .where("m > 1").select("token", "head"))
    across = index.join(heads, "token").where("head < g").selectExpr("head AS a", "g AS b")
    inside = members.join(groups, ["n", "prefix"]).where("g < node").selectExpr("g AS a", "node AS b")
    sides = members.select("node", "n", *(F.col(w).alias(f"v{k}") for k, w in enumerate(_WORDS)))
    x = sides.toDF("a", *(f"x_{c}" for c in sides.columns[1:]))
    y = sides.toDF("b", *(f"y_{c}" for c in sides.columns[1:]))
    return (across.unionByName(inside).distinct().join(x, "a").join(y, "b")
            .where(_close("x_", "y_", percent)).select("a", "b"))


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with the component they are in, themselves if in none."""
    return materialise(
        members.join(parts, "node", "left")
        .withColumn("part", F.coalesce("component", "node")).drop("component"))


def _mixed(index: DataFrame) -> DataFrame:
    """The rows of shingles that several components hold; others pair nothing."""
    mixed = materialise(index.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"))
                        .where("low < high").select("token"))
    return materialise(index.join(mixed, "token"))


def _overlap(percent: int) -> str:
    """SQL: overlap needed, ceil(percent (n + m) / (100 + percent)), and possible from this shingle on."""
    return (f"least(x.n - x.rank, y.n - y.rank)"
            f" >= ceil({percent} * (x.n + y.n) / {100 + percent}.0)")


def _drawn_pairs(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): a group's first member and, of the groups drawn for its shingles, the first
    member of the one nearest by bitmap in each other component."""
    groups = _placed(members, parts).groupBy("n", "prefix", "part").agg(F.min("node").alias("g"))
    index = _mixed(groups.select("g", "n", "part", F.inline("prefix")))
    drawn = index.groupBy("token").agg(F.array_distinct(F.array(*(
        F.min_by(F.struct(F.col("g").alias("h"), "n", "part", "rank"), F.xxhash64("g", "token", F.lit(k)))
        for k in range(DRAWN)))).alias("drawn")).select("token", F.inline("drawn"))
    found = (index.alias("x").join(drawn.alias("y"), F.col("x.token") == F.col("y.token"))
             .where(f"x.part <> y.part AND {_overlap(percent)}")
             .selectExpr("x.g AS a", "y.h AS b", "y.part AS part").distinct())
    sides = members.select("node", "n", *(F.col(w).alias(f"v{k}") for k, w in enumerate(_WORDS)))
    x = sides.toDF("a", *(f"x_{c}" for c in sides.columns[1:]))
    y = sides.toDF("b", *(f"y_{c}" for c in sides.columns[1:]))
    words = range(len(_WORDS))
    differ = _differ([f"x_v{k}" for k in words], [f"y_v{k}" for k in words])
    return (found.join(x, "a").join(y, "b").where(_close("x_", "y_", percent))
            .groupBy("a", "part").agg(F.min_by("b", F.expr(differ)).alias("b")).select("a", "b"))


def _other_pairs(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that the filters let pass."""
    placed = _placed(members, parts)
    key = ["n", "prefix", "part"]
    groups = placed.groupBy(*key).agg(
        F.min("node").alias("g"),
        *(F.bit_and(w).alias(f"v{k}") for k, w in enumerate(_WORDS)),
        # bits in which all members agree
        *(F.bitwise_not(F.bit_or(w).bitwiseXOR(F.bit_and(w))).alias(f"a{k}")
          for k, w in enumerate(_WORDS)))
    index = _mixed(groups.select("g", "n", "part", F.inline("prefix"),
                                 *(f"{c}{k}" for c in "va" for k in range(len(_WORDS)))))
    columns = ["n", *(f"{c}{k}" for c in "va" for k in range(len(_WORDS)))]
    pairs = (index.alias("x").join(index.alias("y"), F.col("x.token") == F.col("y.token"))
             .where(f"x.part < y.part AND {_overlap(percent)}"
                    f" AND {_close('x.', 'y.', percent, masks=('x.', 'y.'))}")
             .selectExpr("x.g AS g", "y.g AS h", *(f"y.{c} AS h_{c}" for c in columns)).distinct())
    inside = placed.join(groups.select(*key, "g"), key).select(
        "g", "node", "n", *(F.col(w).alias(f"v{k}") for k, w in enumerate(_WORDS)))
    x = inside.toDF("g", "a", *(f"x_{c}" for c in inside.columns[2:]))
    y = inside.toDF("h", "b", *(f"y_{c}" for c in inside.columns[2:]))
    # a member is held against the other group before that group's members take its place
    return (pairs.join(x, "g").where(_close("x_", "h_", percent, masks=("h_",)))
            .join(y, "h").where(_close("x_", "y_", percent)).select("a", "b"))


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar enough."""
    pairs = materialise(pairs)
    nodes = materialise(
        pairs.selectExpr("a AS id").unionByName(pairs.selectExpr("b AS id")).distinct())
    sets = materialise(texts.join(nodes, "id").mapInArrow(
        _full_sets(shingle), "node long, shingles array<long>"))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn(
        "common", F.size(F.array_intersect("x", "y")))
    return materialise(
        both.where(f"100 * common >= {percent} * (size(x) + size(y) - common)").select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, percent: int = PERCENT,
                    counted: float = COUNTED) -> DataFrame:
    """The identifier, ``n_shingles`` and ``component_id`` of every row.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    """
    texts = _texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle))
    profiles = materialise(texts.mapInArrow(_profiles(shingle, percent, counted, shared), _PROFILE))
    sets = profiles.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("node"))
    # one node per distinct set with a joinable prefix
    members = materialise(
        _prefixes(profiles, percent).join(profiles.drop("n", "counted", "head"), "id")
        .groupBy("n", "d1", "d2", "prefix", *_WORDS).agg(F.min("id").alias("node")))
    links = _links(_first_pairs(members, percent), texts, shingle, percent)
    parts = components(links)
    for pairs in (_drawn_pairs, _other_pairs):
        later = _links(pairs(members, parts, percent), texts, shingle, percent)
        if not later.isEmpty():
            links = links.unionByName(later)
            parts = components(links)
    rows = profiles.select("id", "n", "d1", "d2").join(sets, ["n", "d1", "d2"], "left")
    node = F.coalesce("node", "id")
    component = F.coalesce("component", "node")
    return (rows.withColumn("node", node).join(parts, "node", "left")
            .withColumn("component", component)
            .select(repeats.public_id(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("component") != repeats.NO_ID, F.col("component"))
                    .alias("component_id")))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with all their columns."""
    found = near_duplicates(docs, id_col=id_col, **options).where(
        F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[id_col]), "left_semi")
