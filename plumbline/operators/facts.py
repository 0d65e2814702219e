"""Column and dataset profiles over a whole catalogue of tables.

The data is read for the value-frequency table and for the row fingerprints; everything else
aggregates those. What reaches the driver has one row per column or dataset.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from plumbline.functions import dates, text
from plumbline.operators.columns import (
    ROW_ID, ColumnInfo, column_rows, column_table, data_columns, describe_columns)
from plumbline.operators.frequencies import (
    NUMBER_KINDS, has_signal, signal, value_frequencies)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.storage import local_table, prefer_compiled_methods

# Thresholds of the profile.
NEAR_CONSTANT_SHARE = 0.95
RARE_SHARE = 0.01
EXAMPLES = 5
ID_UNIQUENESS = 0.9
CATEGORY_MAX_DISTINCT = 50
CATEGORY_MAX_RATIO = 0.5
DATE_SAMPLE = 20

# Distinct values are spread over this many groups per column while examples are searched.
_SPREAD = 32
_COUNTED = [
    "whitespace", "blank", "unicode", "placeholder", "numeric_like", "multi_value",
    "bad_email", "money_hint", "date_parsed", "date_missing", "date_ambiguous",
]
_CATEGORY = "array<struct<value:string,count:bigint>>"
PROFILE_SCHEMA = (
    "cid int, dataset string, position int, column string, clean_name string, dtype string, "
    "kind string, inferred_type string, row_count bigint, missing_count bigint, "
    "missing_percentage double, unique_count bigint, unique_percentage double, "
    "example_values array<string>, min double, max double, mean double, median double, "
    "std double, mode double, zero_count bigint, negative_count bigint, "
    "numeric_extra struct<q25:double,q50:double,q75:double,outlier_count:bigint>, "
    f"categorical_extra struct<top_categories:{_CATEGORY},rare_categories:{_CATEGORY},"
    "potential_inconsistencies:array<array<string>>>, "
    "date_extra struct<min:string,max:string,invalid_count:bigint,future_count:bigint,"
    "ambiguous_count:bigint>, "
    "text_extra struct<whitespace_issue_count:bigint,empty_string_count:bigint,"
    "case_variation_count:bigint,unicode_issue_count:bigint>, date_convention string, "
    "constant boolean, near_constant boolean, empty boolean, longest_example bigint, "
    "value_count bigint, num_count bigint, out_of_range bigint, negative_values bigint, "
    "money_values bigint, seen int, range_low double, range_high double, "
    + ", ".join(f"n_{s} bigint" for s in _COUNTED)
)
DATASET_SCHEMA = (
    "dataset string, row_count bigint, column_count int, duplicate_row_count bigint, "
    "empty_row_count bigint, empty_column_count int, constant_columns array<string>, "
    "near_constant_columns array<string>"
)


@dataclass
class Facts:
    """What later steps need to know about a catalogue.

    ``columns`` and ``tables`` are the records behind the ``profile`` and ``datasets`` frames.
    """

    spark: SparkSession
    frames: dict[str, DataFrame]
    infos: list[ColumnInfo]
    freq: DataFrame
    columns: list[dict]
    tables: list[dict]

    @cached_property
    def profile(self) -> DataFrame:
        extra = ", ".join(f"{k} boolean" for k in self.columns[0] if k.startswith("is_"))
        return local_table(self.spark, _finite(self.columns), f"{PROFILE_SCHEMA}, {extra}")

    @cached_property
    def datasets(self) -> DataFrame:
        return local_table(self.spark, self.tables, DATASET_SCHEMA)

    def of(self, dataset: str) -> list[dict]:
        return [c for c in self.columns if c["dataset"] == dataset]


def row_fingerprint(df: DataFrame) -> list[str]:
    """128 bits over all data columns. NULLs are skipped by the hash, so their places count."""
    values = [
        f"to_json({text.column(c)})" if "map<" in df.schema[c].dataType.simpleString()
        else text.column(c) for c in data_columns(df)]
    # a bit per column
    missing = ", ".join(
        " | ".join(f"CASE WHEN {v} IS NULL THEN {1 << i}L ELSE 0L END"
                   for i, v in enumerate(values[at:at + 62])) for at in range(0, len(values), 62))
    listed = ", ".join(values)
    return [f"xxhash64({missing}, {listed}) AS h1",
            f"xxhash64('plumbline', {listed}, {missing}) AS h2"]


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, row_count, duplicate_row_count, empty_row_count).

    Rows meet by fingerprint, so the shuffle carries hashes instead of rows and copies
    collapse before it.
    """
    rows = None
    for place, df in enumerate(frames.values()):
        empty = " AND ".join(f"{text.column(c)} IS NULL" for c in data_columns(df))
        hashed = df.selectExpr(f"{place} AS place", *row_fingerprint(df), f"{empty} AS empty")
        rows = hashed if rows is None else rows.unionByName(hashed)
    groups = rows.groupBy("place", "h1", "h2", "empty").agg(F.expr("count(*) AS n"))
    names = ", ".join(text.literal(dataset) for dataset in frames)
    return groups.groupBy(F.expr(f"array({names})[place]").alias("dataset")).agg(
        F.expr("sum(n) AS row_count"),
        F.expr("sum(n - 1) AS duplicate_row_count"),
        F.expr("sum(CASE WHEN empty THEN n ELSE 0 END) AS empty_row_count"))


def column_statistics(freq: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """One pass over the frequency table: everything that sums up per column."""
    sums = {
        "value_count": "cnt",
        **{f"n_{s}": f"CASE WHEN {signal(s)} THEN cnt END" for s in _COUNTED},
        "money_values":
            f"CASE WHEN {signal('money')} AND NOT {signal('numeric_like')} THEN cnt END",
        "num_count": "CASE WHEN num IS NOT NULL THEN cnt END",
        "num_total": "num * cnt",
        "zero_count": "CASE WHEN num = 0 THEN cnt END",
        "negative_values": "CASE WHEN num < 0 THEN cnt END",
        "fraction_count": "CASE WHEN num % 1 != 0 THEN cnt END",
        "out_of_range": "CASE WHEN num < range_low OR num > range_high THEN cnt END",
        "timed_count": "CASE WHEN lng % 86400000000 != 0 THEN cnt END",
    }
    ranges = column_table(freq.sparkSession, infos).select("cid", "range_low", "range_high")
    partial = (
        freq.join(F.broadcast(ranges), "cid")
        .groupBy("cid", F.expr(f"pmod(xxhash64(txt, dbl, lng), {_SPREAD}) AS part"))
        .agg(*map(F.expr, [
            "count(*) AS unique_count", "max(cnt) AS top_count", "bit_or(flags) AS seen",
            "min(first_row) AS part_first", "min(num) AS num_min", "max(num) AS num_max",
            "max(CASE WHEN num IS NOT NULL THEN cnt END) AS num_top",
            *(f"sum({v}) AS {k}" for k, v in sums.items())])))
    return partial.groupBy("cid").agg(*map(F.expr, [
        "sum(unique_count) AS unique_count", "max(top_count) AS top_count",
        "bit_or(seen) AS seen", "max(num_top) AS num_top",
        "min(num_min) AS num_min", "max(num_max) AS num_max",
        f"try_element_at(sort_array(collect_list(part_first)), {EXAMPLES}) AS example_bound",
        *(f"coalesce(sum({k}), 0) AS {k}" for k in sums)]))


def modes(freq: DataFrame, statistics: dict[int, Row]) -> dict[int, float]:
    """The most frequent number of every column, the smallest of several.

    A column whose numbers differ throughout has its smallest one, without a pass.
    """
    found = {c: r.num_min for c, r in statistics.items() if r.num_top == 1}
    tops = [{"cid": c, "num_top": r.num_top} for c, r in statistics.items() if (r.num_top or 0) > 1]
    if tops:
        table = F.broadcast(local_table(freq.sparkSession, tops, "cid int, num_top bigint"))
        found |= {r.cid: r.mode for r in freq.where("num IS NOT NULL").join(table, "cid").where(
            "cnt = num_top").groupBy("cid").agg(F.min("num").alias("mode")).collect()}
    return found


def _date_columns(frames, infos, statistics: dict[int, Row]) -> set[int]:
    """Text columns whose first values look like dates and whose values mostly are.

    The first values are fetched in row order, only for columns that pass the value test.
    """
    samples = None
    for cid, r in statistics.items():
        info = infos[cid]
        if info.kind != "text" or 2 * (r.n_date_parsed + r.n_date_ambiguous) <= r.value_count:
            continue
        c = text.column(info.name)
        head = (frames[info.dataset].where(f"{c} IS NOT NULL")
                .selectExpr(ROW_ID, f"{c} AS v").orderBy(ROW_ID).limit(DATE_SAMPLE)
                .selectExpr(f"{cid} AS cid", f"v RLIKE {text.raw(dates.DATE_LIKE)} AS looks"))
        samples = head if samples is None else samples.unionByName(head)
    if samples is None:
        return set()
    share = samples.groupBy("cid").agg(F.expr("avg(int(looks)) AS share"))
    return {r.cid for r in share.collect() if r.share > 0.5}


def inferred_type(info: dict, stats: Row | None, is_date: bool) -> str:
    """Semantic type of one column from its statistics."""
    kind = info["kind"]
    if stats is None:
        return "string"
    if kind == "boolean":
        return "boolean"
    if kind == "date":
        return "date"
    if kind == "timestamp":
        return "datetime" if stats.timed_count else "date"
    ratio = stats.unique_count / stats.value_count
    is_id = info["is_identifier"] and ratio >= ID_UNIQUENESS
    if kind in NUMBER_KINDS:
        if stats.fraction_count:
            return "float"
        return "id" if is_id else "integer"
    if is_date:
        return "date"
    if is_id:
        return "id"
    few = ratio <= CATEGORY_MAX_RATIO and stats.unique_count <= CATEGORY_MAX_DISTINCT
    return "categorical" if few and kind == "text" else "string"


def _examples(freq, statistics, infos, frames) -> dict[int, tuple[list[str], int | None]]:
    """First distinct values of every column in row order, and the longest text among them."""
    bounds = [{"cid": c, "bound": r.example_bound} for c, r in statistics.items()]
    bound = F.broadcast(local_table(freq.sparkSession, bounds, "cid int, bound bigint"))
    first = (
        freq.join(bound, "cid").where("bound IS NULL OR first_row <= bound")
        .withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("first_row")))
        .where(f"place <= {EXAMPLES}"))
    found: dict[int, list] = {}
    for r in first.select("cid", "place", "first_row", "txt", "dbl", "lng",
                          F.expr("cast(date_from_unix_date(int(lng % 2147483647)) AS string) AS day"),
                          F.expr("cast(timestampadd(MICROSECOND, lng, timestamp_ntz'1970-01-01')"
                                 " AS string) AS at")).collect():
        found.setdefault(r.cid, []).append(r)
    result = {}
    for cid, rows in found.items():
        kind = infos[cid].kind
        shown = []
        for r in sorted(rows, key=lambda r: r.place):
            if kind == "text":
                shown.append(r.txt)
            elif kind == "date":
                shown.append(r.day)
            elif kind == "timestamp":
                shown.append(r.at)
            elif kind == "boolean":
                shown.append(str(bool(r.lng)))
            elif kind == "nested":
                continue
            else:
                shown.append(r.txt or str(r.lng if r.dbl is None else r.dbl))
        longest = max((len(v) for v in shown), default=None) if kind == "text" else None
        result[cid] = (shown, longest)
    return result


def top_categories(freq: DataFrame, categorical: list[int]) -> dict[int, dict]:
    """Top and rare categories and spelling groups; a category column has few values."""
    values = freq.where(F.col("cid").isin(categorical)).selectExpr(
        "cid", "txt AS value", "cnt AS count", "first_row", "coalesce(skey, txt) AS key")
    by_column: dict[int, list[Row]] = {}
    for r in values.collect():
        by_column.setdefault(r.cid, []).append(r)
    result = {}
    for cid, rows in by_column.items():
        rows.sort(key=lambda r: (-r["count"], r.first_row))
        total = sum(r["count"] for r in rows)
        items = [{"value": r.value, "count": r["count"]} for r in rows]
        groups: dict[str, list[str]] = {}
        for r in rows:
            groups.setdefault(r.key, []).append(r.value)
        result[cid] = {
            "top_categories": items[:EXAMPLES],
            "rare_categories": [
                i for i in items if i["count"] == 1 or i["count"] / total <= RARE_SHARE],
            "potential_inconsistencies": [sorted(g) for g in groups.values() if len(g) > 1]}
    return result


def spelling_groups(freq: DataFrame, columns: list[int]) -> DataFrame:
    """(cid, key, spellings, cells) for every key written in more than one way."""
    return (
        freq.where(F.col("cid").isin(columns))
        .groupBy("cid", F.expr("coalesce(skey, txt) AS key"))
        .agg(F.expr("count(*) AS spellings"), F.expr("sum(cnt) AS cells"))
        .where("spellings > 1"))


def case_variations(freq: DataFrame, columns: list[int]) -> dict[int, int]:
    """How many keys of each column are written in more than one way.

    Only counted, so keys meet by a 128-bit fingerprint and no text is shuffled.
    """
    key = "coalesce(skey, txt)"
    groups = (
        freq.where(F.col("cid").isin(columns))
        .groupBy("cid", F.expr(f"xxhash64({key}) AS h1"), F.expr(f"xxhash64('plumbline', {key}) AS h2"))
        .agg(F.expr("count(*) AS spellings")).where("spellings > 1"))
    return {r.cid: r["count"] for r in groups.groupBy("cid").count().collect()}


def date_statistics(freq, infos, conventions: dict[int, str | None], as_of: str) -> DataFrame:
    """Minimum, maximum and status counts of date columns under their convention."""
    texts = [c for c in conventions if infos[c].kind == "text"]
    native = [c for c in conventions if infos[c].kind != "text"]
    parts = []
    if texts:
        cases = " ".join(f"WHEN {c} THEN '{v}'" for c, v in conventions.items() if v)
        convention = f"CASE cid {cases} END" if cases else "cast(null AS string)"
        resolved = freq.where(F.col("cid").isin(texts)).selectExpr(
            "cid", "cnt", "reading", f"{convention} AS convention").selectExpr(
            "cid", "cnt", f"{dates.resolve('reading', 'convention')} AS r")
        parts.append(resolved.selectExpr(
            "cid", "cnt", "r.status AS status",
            "cast(cast(r.iso AS date) AS timestamp_ntz) AS at"))
    if native:
        days = [str(c) for c in native if infos[c].kind == "date"] or ["-1"]
        parts.append(freq.where(F.col("cid").isin(native)).selectExpr(
            "cid", "cnt", "'parsed' AS status",
            f"CASE WHEN cid IN ({', '.join(days)}) THEN"
            " timestampadd(DAY, int(lng), timestamp_ntz'1970-01-01') ELSE"
            " timestampadd(MICROSECOND, lng, timestamp_ntz'1970-01-01') END AS at"))
    values = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    iso = "yyyy-MM-dd\\'T\\'HH:mm:ss"
    return values.groupBy("cid").agg(*map(F.expr, [
        f"date_format(min(at), '{iso}') AS min", f"date_format(max(at), '{iso}') AS max",
        "coalesce(sum(CASE WHEN status = 'invalid' THEN cnt END), 0) AS invalid_count",
        f"coalesce(sum(CASE WHEN status = 'parsed' AND at > {as_of} THEN cnt END), 0)"
        " AS future_count",
        "coalesce(sum(CASE WHEN status = 'ambiguous' THEN cnt END), 0) AS ambiguous_count"]))


def spread(freq: DataFrame, fences: list[dict]) -> DataFrame:
    """Sum of squared distances from the mean and the count of values outside the fences."""
    table = F.broadcast(local_table(
        freq.sparkSession, fences, "cid int, mean double, low double, high double"))
    return freq.where("num IS NOT NULL").join(table, "cid").groupBy("cid").agg(*map(F.expr, [
        "sum((num - mean) * (num - mean) * cnt) AS squares",
        "coalesce(sum(CASE WHEN num < low OR num > high THEN cnt END), 0) AS outlier_count"]))


def spread_input(df: DataFrame) -> DataFrame:
    """Give a table that is read by a few tasks only to all cores.

    Unpivoting and classifying cells is much more work than reading them. Tables with enough
    splits are left alone; rows move by their unique id, so no partition gets more than others.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, ROW_ID) if df.rdd.getNumPartitions() * 2 <= cores else df


def _finite(value):
    """Reports hold no infinities and no NaN: such a figure is missing."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def _percent(part: int, whole: int) -> float:
    return round(part / whole * 100, 4) if whole else 0.0


def build_facts(frames: Mapping[str, DataFrame], as_of: str | None = None) -> Facts:
    """Profile every dataset of the catalogue. Frames carry a unique ``_row_id`` column."""
    frames = {name: spread_input(df) for name, df in frames.items()}
    spark = next(iter(frames.values())).sparkSession
    prefer_compiled_methods(spark)
    infos = [i for name, df in frames.items() for i in describe_columns(name, df)]
    described = column_rows(infos)
    now = f"timestamp_ntz'{as_of}'" if as_of else "localtimestamp()"

    # independent jobs are submitted together and share the cluster
    with ThreadPoolExecutor(max_workers=6) as pool:
        counting = pool.submit(lambda: {r.dataset: r for r in row_counts(frames).collect()})
        freq = value_frequencies(frames, infos)
        statistics = {r.cid: r for r in column_statistics(freq, infos).collect()}
        examples = pool.submit(_examples, freq, statistics, infos, frames)
        date_texts = _date_columns(frames, infos, statistics)
        types = {c["cid"]: inferred_type(c, statistics.get(c["cid"]), c["cid"] in date_texts)
                 for c in described}

        categorical = [c for c, t in types.items() if t == "categorical"]
        strings = [c for c, t in types.items()
                   if t == "string" and infos[c].kind == "text" and c in statistics]
        conventions = {
            c: dates.convention_of(has_signal(statistics[c].seen, "proves_day_first"),
                                   has_signal(statistics[c].seen, "proves_month_first"))
            for c, t in types.items() if t in ("date", "datetime") and c in statistics}
        categories = pool.submit(
            lambda: top_categories(freq, categorical) if categorical else {})
        variation = pool.submit(lambda: case_variations(freq, strings) if strings else {})
        dated = pool.submit(lambda: {
            r.cid: r.asDict() for r in
            date_statistics(freq, infos, conventions, now).collect()} if conventions else {})

        numeric = {c: statistics[c] for c in statistics if infos[c].kind in NUMBER_KINDS}
        extents = {c: (r.num_count, r.unique_count, r.num_min, r.num_max)
                   for c, r in numeric.items()}
        quartiles, spreads, top_numbers = {}, {}, {}
        if extents:
            modal = pool.submit(modes, freq, numeric)
            values = freq.where(F.col("cid").isin(list(extents))).selectExpr(
                "cid", "num AS v", "cnt")
            quartiles = exact_quantiles(values, extents)
            fences = [
                {"cid": c, "mean": numeric[c].num_total / numeric[c].num_count,
                 "low": q1 - 1.5 * (q3 - q1), "high": q3 + 1.5 * (q3 - q1)}
                for c, (q1, _, q3) in quartiles.items()]
            spreads = {r.cid: r for r in spread(freq, fences).collect()}
            top_numbers = modal.result()

        totals = counting.result()
        columns = [
            _profile_row(
                c, types[c["cid"]], statistics.get(c["cid"]),
                totals[c["dataset"]].row_count if c["dataset"] in totals else 0,
                examples.result().get(c["cid"], ([], None)), quartiles.get(c["cid"]),
                spreads.get(c["cid"]), top_numbers.get(c["cid"]), categories.result().get(c["cid"]),
                variation.result().get(c["cid"], 0), dated.result().get(c["cid"]),
                conventions.get(c["cid"]))
            for c in described]
    tables = [_dataset_row(name, totals.get(name), [c for c in columns if c["dataset"] == name])
              for name in frames]
    return Facts(spark, frames, infos, freq, columns, tables)


def _profile_row(info, kind_of, stats, rows, examples, quartiles, spreads, mode, categories,
                 variation, dated, convention) -> dict:
    s = stats.asDict() if stats else {}
    present, unique = s.get("value_count", 0), s.get("unique_count", 0)
    missing = rows - present
    numeric = info["kind"] in NUMBER_KINDS and present > 0
    string = kind_of == "string" and info["kind"] == "text" and present > 0
    constant = unique == 1 and missing == 0 and info["kind"] != "nested"
    n = s.get("num_count", 0)
    row = {
        **info, "inferred_type": kind_of, "row_count": rows, "missing_count": missing,
        "missing_percentage": _percent(missing, rows),
        "unique_count": None if info["kind"] == "nested" else unique,
        "unique_percentage": 0.0 if info["kind"] == "nested" else _percent(unique, present),
        "example_values": examples[0], "longest_example": examples[1],
        "constant": constant, "empty": missing == rows,
        "near_constant": present > 0 and not constant and info["kind"] != "nested"
        and s["top_count"] / present >= NEAR_CONSTANT_SHARE,
        "date_extra": {k: dated[k] for k in (
            "min", "max", "invalid_count", "future_count", "ambiguous_count")} if dated else None,
        "date_convention": convention, "categorical_extra": categories,
        "value_count": present, "seen": s.get("seen"),
        **{k: s.get(k, 0) for k in (
            "num_count", "out_of_range", "negative_values", "money_values",
            *(f"n_{x}" for x in _COUNTED))},
    }
    if numeric:
        row.update(
            min=s["num_min"], max=s["num_max"], mean=s["num_total"] / n, median=quartiles[1],
            std=(spreads.squares / (n - 1)) ** 0.5 if n > 1 else 0.0, mode=mode,
            zero_count=s["zero_count"], negative_count=s["negative_values"])
        if kind_of in ("integer", "float"):
            row["numeric_extra"] = {
                "q25": quartiles[0], "q50": quartiles[1], "q75": quartiles[2],
                "outlier_count": spreads.outlier_count}
    if string:
        row["text_extra"] = {
            "whitespace_issue_count": s["n_whitespace"], "empty_string_count": s["n_blank"],
            "case_variation_count": variation, "unicode_issue_count": s["n_unicode"]}
    return row


def _dataset_row(name: str, counts: Row | None, columns: list[dict]) -> dict:
    return {
        "dataset": name, "row_count": counts.row_count if counts else 0,
        "column_count": len(columns),
        "duplicate_row_count": counts.duplicate_row_count if counts else 0,
        "empty_row_count": counts.empty_row_count if counts else 0,
        "empty_column_count": sum(c["empty"] for c in columns),
        "constant_columns": [c["column"] for c in columns if c["constant"]],
        "near_constant_columns": [c["column"] for c in columns if c["near_constant"]],
    }
