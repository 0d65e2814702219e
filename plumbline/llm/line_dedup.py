"""Line dedup by winnowing, in DataFrame functions only.

A text is cut at line ends and every line is hashed. Of each window of ``lines`` consecutive
lines the leftmost smallest hash is its fingerprint, so two equal runs of that length are sure to
share one. Fingerprints that occur once are dropped; the positions of the others are joined and
matches are extended both ways, line by line, to all windows that contain the fingerprint. A
window that occurs again goes in its later occurrences (a larger identifier, or further down the
same document), and with it every line it covers; the first occurrence stays.

Equal windows are found by grouping their hashes with map-side combining, not by pairing their
positions, so a run that a third of all documents share is a row per task and a join that Spark
may split. Windows without any letter or digit are left alone: empty lines are layout.

Defined cases: a null text has no lines; texts shorter than a window lose nothing; a null
identifier comes before all others; rows that repeat identifier and text are one occurrence;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm import repeats
from plumbline.storage import materialise

LINES = 3


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"),
        F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>")).alias("lines"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """Winnowed fingerprints: ``id``, ``tag``, ``f``, first window's start and the line hashes
    of all windows that the fingerprint stands for."""
    hashed = _lines(docs, id_col, text_col).select(
        "id", "tag", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")).alias("said"))
    hashed = hashed.where(F.size("h") >= lines)
    # the place of each window's leftmost smallest hash
    at = F.transform(
        F.sequence(F.lit(1), F.size("h") - lines + 1),
        lambda i: i + F.array_position(
            F.slice("h", i, F.lit(lines)), F.array_min(F.slice("h", i, F.lit(lines)))).cast("int")
        - 1)
    placed = hashed.withColumn("at", at)
    # windows with one fingerprint are consecutive: each begins where the place changes
    begins = F.filter(F.sequence(F.lit(1), F.size("at")), lambda i: (i == 1) | (
        F.element_at("at", i) != F.element_at("at", F.greatest(i - 1, F.lit(1)))))
    runs = placed.withColumn("b", begins).select(
        "id", "tag", F.explode(F.transform("b", lambda i, k: F.struct(
            i.alias("start"),
            (F.coalesce(F.get("b", k + 1), F.size("at") + 1) - i).alias("count"),
            F.element_at("h", F.element_at("at", i)).alias("f"),
            F.slice("h", i, F.coalesce(F.get("b", k + 1), F.size("at") + 1) - i + lines - 1)
            .alias("around"),
            F.slice("said", i, F.coalesce(F.get("b", k + 1), F.size("at") + 1) - i + lines - 1)
            .alias("said")))).alias("r"))
    return runs.select("id", "tag", "r.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lines: int = LINES) -> DataFrame:
    """Starts (from 1) of the windows of ``lines`` lines that occur earlier, per document."""
    found = materialise(fingerprints(docs, id_col, text_col, lines))
    often = found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    live = found.join(often, "f")
    windows = live.select("id", "tag", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("count")), lambda k: F.struct(
            (F.col("start") + k - 1).alias("at"),
            F.xxhash64(F.slice("around", k, F.lit(lines))).alias("w"),
            F.hash(F.slice("around", k, F.lit(lines))).alias("v"),
            F.exists(F.slice("said", k, F.lit(lines)), lambda x: x).alias("said")))).alias("r")
    ).select("id", "tag", "r.*").where("said").drop("said")
    windows = materialise(windows)
    place = F.struct("id", "at")
    first = (windows.groupBy("w", "v").agg(F.count("*").alias("n"), F.min(place).alias("first"))
             .where("n > 1").drop("n"))
    return (windows.join(first, ["w", "v"])
            .where("id > first.id OR (id = first.id AND at > first.at)")
            .groupBy("id", "tag").agg(F.array_sort(F.collect_set("at")).alias("starts")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lines: int = LINES) -> DataFrame:
    """The identifier, ``n_lines``, ``n_removed`` and ``kept_text`` of every row."""
    starts = repeated_runs(docs, id_col, text_col, lines)
    # windows that overlap are one span: it begins where a start lies beyond the one before
    begins = F.filter(F.sequence(F.lit(1), F.size("starts")), lambda k: (k == 1) | (
        F.element_at("starts", k) - F.element_at("starts", F.greatest(k - 1, F.lit(1))) > lines))
    spans = starts.withColumn("b", begins).select("id", "tag", F.transform(
        "b", lambda k, j: F.struct(
            F.element_at("starts", k).alias("a"),
            (F.element_at("starts", F.coalesce(F.get("b", j + 1) - 1, F.size("starts")))
             + lines - 1).alias("b"))).alias("spans"))
    joined = _lines(docs, id_col, text_col).join(spans, ["id", "tag"], "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")))
    # lines between the spans: after the end of one up to the start of the next
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"]))
    begins = F.concat(F.transform("spans", lambda s: s["a"]), F.array(F.size("lines") + 1))
    kept = F.flatten(F.transform(
        F.arrays_zip(ends.alias("e"), begins.alias("s")),
        lambda g: F.slice("lines", g["e"] + 1, g["s"] - g["e"] - 1)))
    return joined.withColumn("kept", kept).select(
        repeats.public_id(id_col), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept_text"))


def digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_lines", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
