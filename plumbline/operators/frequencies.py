"""The value-frequency table: every distinct value of every column, counted once.

Almost all statistics and detectors of the library are functions of a value and its count.
So the data is unpivoted and aggregated in one shuffle for texts and one for all other values,
each distinct text is classified once, and the result is written to shared storage. Counting starts before the shuffle, so
a value that fills a third of the rows travels as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import dates, numbers, text
from plumbline.operators.columns import ROW_ID, ColumnInfo
from plumbline.storage import materialise_union

# Columns unpivoted by one expression; wider tables use several, each reading its own columns.
UNPIVOT_WIDTH = 40

SIGNALS = [
    "whitespace", "blank", "unicode", "placeholder", "numeric_like", "multi_value",
    "bad_email", "money_hint", "money",
    "date_parsed", "date_missing", "date_ambiguous", "proves_day_first", "proves_month_first",
    "slash_day_first", "slash_month_first", "slash_either",
    "INR", "USD", "EUR", "GBP",
]
_PARTS = ("txt", "dbl", "lng")
NUMBER_KINDS = ("integer", "float", "decimal")


def signal(name: str, flags: str = "flags") -> str:
    return f"({flags} & {1 << SIGNALS.index(name)}) != 0"


def has_signal(seen: int | None, name: str) -> bool:
    return bool((seen or 0) & (1 << SIGNALS.index(name)))


def _pack(conditions: dict[str, str]) -> str:
    return "(" + " | ".join(
        f"CASE WHEN {condition} THEN {1 << SIGNALS.index(name)} ELSE 0 END"
        for name, condition in conditions.items()) + ")"


def _shape_signals(c: str, bare: str, plain: str, key: str) -> dict[str, str]:
    """Conditions on a text; ``bare`` is the text without white space around it, ``plain`` that
    with plain blanks only, ``key`` its spelling key."""
    return {
        "whitespace": f"({bare} != {c} OR contains({plain}, '  '))",
        "blank": f"({bare} = '')",
        "unicode": text.has_unicode_issue(c),
        "placeholder": text.is_placeholder(bare, stripped=True),
        "numeric_like": text.is_numeric_like(bare, stripped=True),
        "multi_value": text.is_multi_value(bare),
        "bad_email": f"(NOT contains({bare}, '@')"
                     f" OR ({text.email_problem(bare, stripped=True)}) != 'valid')",
        "money_hint": numbers.has_currency_hint(bare, key),
    }


def _cell(info: ColumnInfo) -> tuple[str, str, str]:
    """A cell as (txt, dbl, lng); exactly the parts that identify its value."""
    c = text.column(info.name)
    txt, dbl, lng = "cast(null AS string)", "cast(null AS double)", "cast(null AS bigint)"
    if info.kind == "text":
        txt = f"cast({c} AS string)"
    elif info.kind == "integer":
        lng = f"cast({c} AS bigint)"
    elif info.kind == "float":
        dbl = f"CASE WHEN NOT isnan({c}) THEN cast({c} AS double) END"
    elif info.kind == "decimal":
        txt, dbl = f"cast({c} AS string)", f"cast({c} AS double)"
    elif info.kind == "boolean":
        lng = f"cast(cast({c} AS int) AS bigint)"
    elif info.kind == "date":
        lng = f"cast(unix_date({c}) AS bigint)"
    elif info.kind == "timestamp":
        lng = (f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01',"
               f" cast({c} AS timestamp_ntz))")
    else:
        lng = f"CASE WHEN {c} IS NOT NULL THEN 1L END"
    return txt, dbl, lng


def cells(frames: Mapping[str, DataFrame], infos: list[ColumnInfo], cids: list[int]) -> DataFrame:
    """Every non-missing cell of these columns as a typed (_row_id, cid, txt, dbl, lng)."""
    result = None
    for dataset, df in frames.items():
        numbered = [(cid, infos[cid]) for cid in cids if infos[cid].dataset == dataset]
        for start in range(0, len(numbered), UNPIVOT_WIDTH):
            block = numbered[start:start + UNPIVOT_WIDTH]
            parts = {f"{n}{cid}": part for cid, info in block
                     for n, part in zip(("c", *_PARTS), (str(cid), *_cell(info)))}
            # unpivoting expands rows in place; an array of structs makes objects of every cell
            groups = ", ".join(f"(c{cid}, txt{cid}, dbl{cid}, lng{cid})" for cid, _ in block)
            typed = df.selectExpr(ROW_ID, *(f"{part} AS {n}" for n, part in parts.items()))
            cell = df.sparkSession.sql(
                f"SELECT {ROW_ID}, cid, txt, dbl, lng FROM {{typed}}"
                f" UNPIVOT INCLUDE NULLS ((cid, txt, dbl, lng) FOR place IN ({groups}))"
                " WHERE txt IS NOT NULL OR dbl IS NOT NULL OR lng IS NOT NULL", typed=typed)
            result = cell if result is None else result.unionByName(cell)
    return result


def _classify(counted: DataFrame) -> DataFrame:
    """Signals, spelling key, date reading and number of every distinct text."""
    # each pass over the characters of a long text counts, so what several tests need is made once
    staged = counted.selectExpr("*", f"{text.strip('txt')} AS bare")
    staged = staged.selectExpr("*", f"{text.plain_blanks('bare')} AS plain")
    staged = staged.selectExpr("*", f"lower({text.single_blanks('plain')}) AS key")
    staged = dates.add_reading(staged, "bare", "reading", stripped=True, words_column="key")
    staged = numbers.add_currency(staged, "bare", "money", stripped=True)
    staged = staged.selectExpr(
        "*",
        f"{_pack(_shape_signals('txt', 'bare', 'plain', 'key'))} AS shape_flags",
        _pack({
            "money": "money.confidence = 'HIGH'",
            "date_parsed": "reading.status = 'parsed'",
            "date_missing": "reading.status = 'missing'",
            "date_ambiguous": "reading.status = 'ambiguous'",
            "proves_day_first": "reading.evidence = 'DD/MM'",
            "proves_month_first": "reading.evidence = 'MM/DD'",
            "slash_day_first": "reading.slash = 'DD/MM'",
            "slash_month_first": "reading.slash = 'MM/DD'",
            "slash_either": "reading.slash = 'either'",
            **{code: f"money.currency = '{code}'" for code in numbers.CURRENCY_SYMBOLS.values()},
        }) + " AS more_flags")
    return staged.selectExpr(
        "cid", "txt", "cast(null AS double) AS dbl", "cast(null AS bigint) AS lng", "cnt", "first_row",
        "shape_flags | more_flags AS flags", "nullif(key, txt) AS skey",
        f"{numbers.to_number('bare', stripped=True)} AS num", "reading")


def value_frequencies(
    frames: Mapping[str, DataFrame], infos: list[ColumnInfo]) -> DataFrame:
    """(cid, txt, dbl, lng, cnt, first_row, flags, skey, num, reading), one row per value.

    ``num`` is the value as a number, also for texts that are numbers as a whole; ``skey``
    is the spelling key of a text where it differs from the text; ``reading`` is the date a
    text stands for. Texts of any length are classified whole.
    """
    texts = [cid for cid, info in enumerate(infos) if info.kind == "text"]
    integers = [str(cid) for cid, info in enumerate(infos) if info.kind == "integer"]
    number = "dbl"
    if integers:
        number = (f"coalesce(dbl, CASE WHEN cid IN ({', '.join(integers)})"
                  " THEN cast(lng AS double) END)")
    counts = [F.expr("count(*) AS cnt"), F.expr(f"min({ROW_ID}) AS first_row")]
    # texts are classified, all other values need none of that and are counted by themselves
    written = typed = None
    if texts:
        written = _classify(cells(frames, infos, texts).groupBy("cid", "txt").agg(*counts))
    others = [cid for cid in range(len(infos)) if cid not in texts]
    if others:
        # only decimals have a text beside their number
        keys = ["cid", "txt", "dbl", "lng"] if any(infos[c].kind == "decimal" for c in others) else [
            "cid", "dbl", "lng"]
        reading = f"cast(null AS {written.schema['reading'].dataType.simpleString()})" if texts else None
        typed = cells(frames, infos, others).groupBy(*keys).agg(*counts).selectExpr(
            "cid", "txt" if "txt" in keys else "cast(null AS string) AS txt", "dbl", "lng", "cnt",
            "first_row", "cast(null AS int) AS flags", "cast(null AS string) AS skey",
            f"{number} AS num", *([f"{reading} AS reading"] if texts else []))
    # separate jobs: each has tasks for all cores, and texts take longer than their bytes tell
    return materialise_union([df for df in (written, typed) if df is not None])
