"""Quoted files cut into blocks of any size read like whole ones."""

import csv
import io
import random

import pytest

from plumbline.operators.columns import ROW_ID
from plumbline.sources import readers, split_csv


def test_state_after_a_line():
    after = split_csv.inside_after
    assert not after('a,"b",c', False, ",") and after('a,"b', False, ",")
    assert after('b""c', True, ",") and not after('b"",c",d', True, ",")
    assert not after('5" pipe,3', False, ",")                # a quote inside an unquoted cell
    assert not after('"a"b"c,d', False, ",") and after('"a","', False, ",")
    assert after('x",y,"z', True, ",") and not after('"",""', False, ",")
    assert after('a;"b,', False, ";") and not after("", False, ",") and after("", True, ",")


def cells(rng):
    kind = rng.random()
    if kind < 0.15:
        return ""
    if kind < 0.3:
        return "\n" * rng.randint(1, 40)
    if kind < 0.5:
        return "".join(rng.choices('ab",\n \u00e9', k=rng.randint(0, 60)))
    if kind < 0.55:
        return "long " * 400 + '"\n'
    return "".join(rng.choices("abc", k=rng.randint(1, 9)))


@pytest.mark.parametrize("split_bytes, ends", [(64, "\n"), (300, "\r\n"), (5000, "\n")])
def test_random_files(spark, tmp_path, split_bytes, ends):
    rng = random.Random(split_bytes)
    wanted = []
    for name in ("a", "b", "c"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ends)
        writer.writerow(["id", "t", "u"])
        for k in range(120 if split_bytes > 100 else 15):
            row = [f"{name}{k}", cells(rng), cells(rng)]
            writer.writerow(row)
            wanted.append(tuple(row))
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    records = split_csv.split_records(spark, str(tmp_path), ",", "UTF-8", split_bytes)
    assert records.count() == len(wanted)
    df, skipped = readers.read_delimited(spark, str(tmp_path), split_bytes=split_bytes)
    blank = lambda s: s if s.strip() else None
    assert sorted(map(repr, (tuple(r) for r in df.drop(ROW_ID).collect()))) == sorted(
        repr((a, blank(b), blank(c))) for a, b, c in wanted)
    assert skipped.first().skipped_rows == 0
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(split_bytes)


def test_split_files_are_read_like_whole_ones(spark, tmp_path):
    rng = random.Random(3)
    lines = ["\ufeffid,Name,name,wide"]
    for k in range(150):
        quoted = '"' + cells(rng).replace('"', '""') + '"'
        lines.append(rng.choice([
            f"{k},{quoted},a,12345678901234567890", f"{k},{quoted}", f"{k},5\" pipe,x,1", f"{k},{quoted},x,1,extra",
            f'{k},"a"b,c,2', "", f"{k},,,"]))
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    path = str(tmp_path / "m.csv")
    whole, lost = readers.read_delimited(spark, path)
    parts, lost_too = readers.read_delimited(spark, path, split_bytes=500)
    assert whole.drop(ROW_ID).dtypes == parts.drop(ROW_ID).dtypes
    assert sorted(map(repr, whole.drop(ROW_ID).collect())) == sorted(map(repr, parts.drop(ROW_ID).collect()))
    assert lost.first() == lost_too.first() and lost.first().skipped_rows > 3
    assert parts.select(ROW_ID).distinct().count() == parts.count()


def test_one_file_goes_to_many_tasks(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n" + '1,"x\ny"\n' * 8_000)
    notes = []
    real = split_csv._open_blocks

    def watch(lines, sep):
        notes.append(lines.rdd.getNumPartitions())
        return real(lines, sep)

    split_csv._open_blocks, kept = watch, real
    try:
        df, _ = readers.read_delimited(spark, str(tmp_path / "one.csv"), split_bytes=4_000)
    finally:
        split_csv._open_blocks = kept
    assert notes[0] >= 8 and df.where("b = 'x\\ny'").count() == 8_000


def test_blocks_of_a_large_file_are_larger_than_asked_for(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(40000)))
    most = split_csv._BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism
    size = split_csv.block_bytes(spark, str(path), 1000)
    assert path.stat().st_size // size <= most + 1 < path.stat().st_size // 1000
    assert split_csv.block_bytes(spark, str(path), 1 << 20) == 1 << 20
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = split_csv.split_records(spark, str(path), ",", "utf-8", 1000)
    assert {r.value for r in rows.collect()} == {f'{i},"x\n{i}"' for i in range(40000)}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
