"""Readers: every format ends as a DataFrame with a stable ``_row_id`` column."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions import text
from plumbline.operators.columns import ROW_ID
from plumbline.sources.arrow_files import read_arrow_files
from plumbline.sources.split_csv import SPLITTABLE_ENCODINGS, split_records
from plumbline.storage import checkpoint_dir, local_table

# Rows a single file may hold in the row id; the file number takes the bits above.
_ROW_BITS = 40
# Paths travel to the executors in one table; refuse catalogues whose listing would not fit.
_MAX_LISTING_BYTES = 256 << 20

_INTEGER, _DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Whole numbers of more digits than a double holds; they become integers, decimals or stay text.
_WIDE = r"^[+-]?[0-9]{16,}$"
# A doubled quote ends one match and starts the next; a group of alternatives would recurse per character.
QUOTED = '"[^"]*"'
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".txt": "csv", ".json": "json", ".parquet": "parquet",
    ".feather": "feather", ".xml": "xml",
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(
        F.expr(f"CASE WHEN NOT isnan({text.column(c)}) THEN {text.column(c)} END").alias(c)
        if c in floats else F.col(text.column(c)) for c in df.columns))


def blanks_to_null(df: DataFrame) -> DataFrame:
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*(
        F.expr(text.blank_to_null(text.column(c))).alias(c) if c in strings
        else F.col(text.column(c)) for c in df.columns))


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Use an existing unique integer column as the row id."""
    return df.withColumn(ROW_ID, F.col(text.column(key)).cast("long"))


def with_row_ids(df: DataFrame) -> DataFrame:
    """Number rows by file and position; the same on every read of the same files.

    Only formats that expose row positions (Parquet) support this; others get ids in the
    order in which partitions read them, which for one file is file order.
    """
    spark = df.sparkSession
    try:
        located = df.select("*", "_metadata.file_path", "_metadata.row_index")
    except Exception:  # the source has no row positions
        return df.withColumn(ROW_ID, F.monotonically_increasing_id())
    files = sorted(df.inputFiles())
    if len(files) == 1:
        return located.withColumn(ROW_ID, F.col("row_index")).drop("file_path", "row_index")
    if sum(map(len, files)) > _MAX_LISTING_BYTES:
        raise ValueError("too many files to number; use with_key with a key column")
    listing = local_table(
        spark, [{"file": unquote(f), "file_no": i} for i, f in enumerate(files)],
        "file string, file_no bigint")
    path = F.expr("url_decode(replace(regexp_replace(file_path, '^file:/+', 'file:///'), '+', '%2B'))")
    return (
        located.withColumn("file", path).join(F.broadcast(listing), "file", "left")
        .withColumn(ROW_ID, F.expr(f"shiftleft(file_no, {_ROW_BITS}) + row_index"))
        .drop("file", "file_path", "row_index", "file_no"))


def read_parquet(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(with_key(df, key) if key else with_row_ids(df))


def promote_types(df: DataFrame, nulls_allowed: bool = True) -> DataFrame:
    """Turn text columns into integers, doubles or booleans where every cell is one.

    Without ``nulls_allowed`` a column with a missing cell stays text. One scan, no shuffle.
    """
    texts = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name != ROW_ID]
    if not texts:
        return df
    # no type may lose digits, so the first that holds every cell wins
    tests = {
        "bigint": "{c} RLIKE " + text.raw(_INTEGER) + " AND try_cast({c} AS bigint) IS NOT NULL",
        "decimal(38,0)": "{c} RLIKE " + text.raw(_INTEGER)
                         + " AND try_cast({c} AS decimal(38,0)) IS NOT NULL",
        "double": "{c} RLIKE " + text.raw(_DECIMAL) + " AND NOT {c} RLIKE " + text.raw(_WIDE),
        "boolean": "{c} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')"}
    counts = []
    for i, c in enumerate(texts):
        counts += [f"count({text.column(c)}) AS n{i}"] + [
            f"count_if({t.replace('{c}', text.column(c))}) AS t{k}_{i}"
            for k, t in enumerate(tests.values())]
    row = df.agg(F.expr("count(*) AS n"), *map(F.expr, counts)).first()
    target = {}
    for i, c in enumerate(texts):
        present = row[f"n{i}"]
        if present and (nulls_allowed or present == row["n"]):
            target[c] = next((t for k, t in enumerate(tests) if row[f"t{k}_{i}"] == present), None)
    return df.select(*(
        F.expr(f"try_cast({text.column(c)} AS {target[c]})").alias(c) if target.get(c)
        else F.col(text.column(c)) for c in df.columns))


def raw_headers(
    spark: SparkSession, path: str, dataset: str, sep: str = ",", encoding: str = "UTF-8",
) -> DataFrame:
    """(dataset, position, column): the header cells of a delimited file as they are written."""
    first = (spark.read.option("sep", sep).option("encoding", encoding).option("quote", '"')
             .option("escape", '"').option("multiLine", True).csv(path).limit(1))
    cells = ", ".join(f"coalesce({text.column(c)}, '')" for c in first.columns)
    return first.selectExpr(
        f"{text.literal(dataset)} AS dataset", f"posexplode(array({cells})) AS (position, column)")


def _worth_splitting(spark: SparkSession, path: str, encoding: str, split_bytes: int | None) -> bool:
    if encoding.lower() not in SPLITTABLE_ENCODINGS:
        return False
    limit = f"{split_bytes}b" if split_bytes else spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = spark.read.format("binaryFile").load(path).select("length")
    # one number comes back
    largest = sizes.agg(F.max("length")).first()[0] or 0
    return largest > spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
    strict_reference: bool = False, splittable: bool = False, split_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A delimited file with a header, and the number of rows skipped for extra fields.

    Quoted cells may hold separators, doubled quotes and line ends. Only empty cells are
    missing; short rows are padded, rows with too many fields (empty ones included) are left
    out and counted. Headers that are equal but for case get a numbered suffix.

    Files beyond ``split_bytes`` (the session's size of a split unless given) are read by several
    tasks, line ends inside quotes included; see ``split_csv``. Encodings in which a line end is
    not one byte are read by one task per file. ``splittable`` promises that no cell holds a line
    end, which saves a pass.
    """
    reader = (spark.read.option("sep", sep).option("encoding", encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", not splittable)
              .option("columnPruning", False))
    header = reader.option("header", False).csv(path).first()
    if header is None:
        raise ValueError("File has no columns after parsing.")
    names, seen = [], {}
    for i, h in enumerate(header):
        name = h if h is not None else f"Unnamed: {i}"
        while name.lower() in seen:
            seen[name.lower()] += 1
            name = f"{name}.{seen[name.lower()]}"
        seen[name.lower()] = 0
        names.append(name)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record"]])
    # a record whose number of fields differs is handed over whole; fields are counted outside quotes
    outside = f"regexp_replace(_corrupt_record, {text.literal(QUOTED)}, '')"
    fields = f"length({outside}) - length(replace({outside}, {text.literal(sep)}, '')) + 1"
    # the source wants its columns referenced beside the record it hands over
    read = f"length(concat_ws('', {', '.join(map(text.column, names))})) >= 0"
    extra = f"_corrupt_record IS NOT NULL AND {fields} > {len(names)} AND {read}"
    if not splittable and _worth_splitting(spark, path, encoding, split_bytes):
        ddl = ", ".join(f"{text.column(f.name)} STRING" for f in schema.fields)
        cells = F.from_csv("value", ddl, {
            "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "",
            "columnNameOfCorruptRecord": "_corrupt_record"})
        parsed = split_records(spark, path, sep, encoding, split_bytes).select(
            cells.alias("cells")).select("cells.*")
    else:
        parsed = (
            reader.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("nullValue", "").option("emptyValue", "").schema(schema).csv(path))
    rows = (
        parsed.withColumn(ROW_ID, F.monotonically_increasing_id())
        .withColumn("_extra", F.expr(f"coalesce({extra}, false)")))
    data = blanks_to_null(rows.where("NOT _extra").drop("_corrupt_record", "_extra"))
    skipped = rows.agg(F.expr("count_if(_extra) AS skipped_rows"))
    return promote_types(data, nulls_allowed=not strict_reference), skipped


def flatten(df: DataFrame) -> DataFrame:
    """Expand nested structs into dotted columns; lists stay lists."""
    columns = []

    def expand(path: list[str], t: T.DataType):
        if isinstance(t, T.StructType):
            for f in t.fields:
                expand([*path, f.name], f.dataType)
        else:
            columns.append(F.col(".".join(text.column(p) for p in path)).alias(".".join(path)))

    for f in df.schema.fields:
        expand([f.name], f.dataType)
    return df.select(*columns)


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a whole record, so that every line is one."""
    first = spark.read.text(path).where("trim(value) != ''").first()
    try:
        return first is not None and isinstance(json.loads(first.value), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON records, one per line or as one document per file; found out unless given."""
    if lines is None:
        lines = _is_json_lines(spark, path)
    df = flatten(spark.read.option("multiLine", not lines).json(path))
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


_ROW_TAG = "_plumbline_row"
#: How markup begins and how it ends; all else is a tag.
_MARKUP = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


def _child_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements inside each file's root, as texts under one tag.

    Rows are (file, value), in file order; a value is a file's text up to the next ``>``.
    """
    def rows(found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": pa.array(found, pa.string())})

    file, depth, pending, parts = None, 0, "", []
    held, until = [], None                                    # a comment or section still open, and its end
    yield rows(["<rows>"])                                    # the parser reads one root per file
    for batch in batches:
        found = []
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                if depth:
                    raise ValueError("XML ends inside an element")
                file, pending, parts, held, until = name, "", [], [], None
            if until:                                         # a ">" inside; only its last piece is looked at
                held.append(value + ">")
                if not held[-1].endswith(until):
                    continue
                pending, held, until = "".join(held), [], None
            else:
                pending += value + ">"
            at = pending.find("<")
            if at < 0:
                parts.append(pending)
                pending = ""
                continue
            tag = pending[at:]
            end = next((e for b, e in _MARKUP if tag.startswith(b)), None)
            if end:
                if not tag.endswith(end) or len(tag) < (7 if end == "-->" else 0):
                    held, until, pending = [pending], end, ""
                    continue
            elif tag.startswith("<!"):
                if tag.count("[") != tag.count("]"):
                    continue
            elif re.sub("\"[^\"]*\"|'[^']*'", "", tag).count('"') or re.sub(
                    "\"[^\"]*\"|'[^']*'", "", tag).count("'"):
                continue                                      # a > inside an attribute
            text_before, pending = pending[:at], ""
            if end or tag.startswith("<!"):
                parts += [text_before, tag if end == "]]>" else ""]
                continue
            closes, empty = tag.startswith("</"), tag.endswith("/>")
            if not closes and depth == 1:
                parts, tag = [], re.sub(r"^<[^\s/>]+", f"<{_ROW_TAG}", tag)
            elif closes and depth == 2:
                tag = f"</{_ROW_TAG}>"
            if depth > 1:
                parts.append(text_before)
            parts.append(tag)
            before, depth = depth, depth + (0 if empty else -1 if closes else 1)
            if (closes and depth == 1) or (empty and before == 1):
                found.append("".join(parts))
                parts = []
        yield rows(found)
    if depth:
        raise ValueError("XML ends inside an element")
    yield rows(["</rows>"])


def _whole_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings under which every file is one split of its own, read in order by one task."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return {"spark.sql.files.maxPartitionBytes": f"{largest + 1}b",
            "spark.sql.files.openCostInBytes": f"{largest + 1}b"}


def _rows_of_root(spark: SparkSession, path: str) -> str:
    """A folder with every element inside the roots, whatever its tag, as one kind of element.

    A file streams through its task in the order in which it is read; nothing of it is sorted.
    """
    folder = f"{checkpoint_dir(spark)}/xml-{uuid.uuid4().hex}"
    # a session of its own: files of a folder are loaded side by side
    session = spark.newSession()
    for k, v in _whole_files(spark, path).items():
        session.conf.set(k, v)
    session.read.option("lineSep", ">").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value"),
    ).mapInArrow(_child_elements, "value string").write.text(folder)
    return folder


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """A repeated element as rows, nested values flattened; every element inside the root is a
    row unless a tag is given."""
    source, tag = (path, row_tag) if row_tag else (_rows_of_root(spark, path), _ROW_TAG)
    df = spark.read.format("xml").option("rowTag", tag).load(source)
    if not df.columns:
        raise ValueError(f"no <{tag}> element with content" if row_tag
                         else "XML without elements inside its root")
    return blanks_to_null(flatten(df)).withColumn(ROW_ID, F.monotonically_increasing_id())


def read_feather(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Arrow files, read batch by batch; the schema is that of the first file unless given."""
    return read_arrow_files(spark, path, schema).withColumn(ROW_ID, F.monotonically_increasing_id())


def dataset_names(paths: list[str]) -> list[str]:
    """File names, with as many folders before them as it takes to tell the paths apart."""
    parts = [PurePosixPath(p).parts for p in paths]
    depth = [1] * len(paths)
    while True:
        names = ["/".join(p[-d:]) for p, d in zip(parts, depth)]
        count = Counter(names)
        again = [i for i, n in enumerate(names) if count[n] > 1 and depth[i] < len(parts[i])]
        if not again:
            return names
        for i in again:
            depth[i] += 1


def _load(spark: SparkSession, path: str, kind: str | None, options: Mapping[str, str]) -> DataFrame:
    """One dataset; its header, type and schema jobs run here."""
    if kind is None:
        raise ValueError("unsupported or unrecognized file type")
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, **{"sep": "\t" if kind == "tsv" else ",", **options})[0]
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "parquet":
        return read_parquet(spark, path, **options)
    if kind == "xml":
        return read_xml(spark, path, **options)
    return read_feather(spark, path, **options)


def read_folder(
    spark: SparkSession, paths: list[str], feather_schemas: dict[str, str] | None = None,
    xml_row_tag: str | None = None, options: Mapping[str, Mapping[str, str]] | None = None,
    workers: int = 8,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every file or table folder of a run as a dataset, failures kept apart.

    ``options`` gives a path's reader its arguments, such as ``sep`` and ``encoding``. Returns the
    readable datasets by name and one (dataset, format, status, reason) row per path. Unknown
    extensions are rejected, never guessed. The small jobs that find headers and types of several
    datasets run side by side.
    """
    names = dataset_names(paths)
    kinds = [FORMATS.get(PurePosixPath(p).suffix.lower()) for p in paths]

    def load(path: str, name: str, kind: str | None) -> DataFrame | Exception:
        given = dict((options or {}).get(path, {}))
        if kind == "xml" and xml_row_tag:
            given.setdefault("row_tag", xml_row_tag)
        if kind == "feather" and name in (feather_schemas or {}):
            given.setdefault("schema", feather_schemas[name])
        try:
            return _load(spark, path, kind, given)
        except Exception as error:  # one bad file must not stop the others
            return error

    with ThreadPoolExecutor(max_workers=workers) as pool:
        found = list(pool.map(load, paths, names, kinds))
    status = [{"dataset": name, "format": kind,
               "status": "failed" if isinstance(one, Exception) else "loaded",
               "reason": str(one).splitlines()[0] if isinstance(one, Exception) else None}
              for one, name, kind in zip(found, names, kinds)]
    return {n: f for n, f in zip(names, found) if not isinstance(f, Exception)}, local_table(
        spark, status, "dataset string, format string, status string, reason string")
