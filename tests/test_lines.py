"""Lines as a data source: whole writes or none, exact rotation, files pruned by category and day, streams written once."""

import json
import os
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_audit import make

from auditloom.sources import lines
from auditloom.sources.lines import LinesSink, as_lines, read_lines, register, stream_lines

T0 = datetime(2024, 1, 15, 10, 30)


def events(spark, n=40, **fields):
    return make(spark, [{"timestamp": T0 + timedelta(hours=6 * i), "category": ("auth", "data")[i % 2], "metadata": json.dumps({"i": i})} | fields for i in range(n)])


def files(path):
    return sorted(str(p) for p in Path(path).rglob("*.jsonl"))


def test_read_back_pruned(spark, tmp_path):
    path = str(tmp_path / "l")
    sink = LinesSink(path)
    sink.write(events(spark))
    sink.write(events(spark, 4, category="a/b=ü"))
    found = read_lines(spark, path)
    assert sorted(r.value for r in found.collect()) == sorted(r.value for r in as_lines(events(spark)).union(as_lines(events(spark, 4, category="a/b=ü"))).collect())
    assert found.where("category = 'a/b=ü'").count() == 4
    for name in files(path):
        if "category==auth/day=2024-01-17" not in name:
            os.remove(name)  # a file that is opened without need fails the query
    for wanted in ("day = DATE '2024-01-17'", "day > DATE '2024-01-16' AND day <= DATE '2024-01-17'", "day IN (DATE '2024-01-17', DATE '2023-01-01')"):
        rows = found.where(f"category = 'auth' AND {wanted} AND value LIKE '%auth%'").collect()
        assert len(rows) == 2 and {(r.category, r.day) for r in rows} == {("auth", date(2024, 1, 17))}
    with pytest.raises(Exception, match="No such file"):
        found.where("category = 'data'").count()


def test_rotation_to_the_byte(spark, tmp_path):
    """A file is closed when it has the most bytes or more before the next line; bytes are those of the payloads."""
    path, one_day = str(tmp_path / "l"), events(spark, 30, timestamp=T0, category="auth").coalesce(1)
    want = [r.value.encode() + b"\n" for r in as_lines(one_day).collect()]
    most = len(want[0]) * 3 + 1
    register(spark)
    as_lines(one_day).write.format("auditlines").option("max_bytes", most).mode("append").save(path)
    parts = [Path(f).read_bytes() for f in files(path)]
    assert b"".join(parts) == b"".join(want)
    assert all(len(p) >= most and len(p) - len(p.splitlines(True)[-1]) < most for p in parts[:-1]) and len(parts) > 5


def test_failed_task_leaves_no_line(spark, tmp_path):
    path = str(tmp_path / "l")
    LinesSink(path).write(events(spark))
    before = files(path)
    broken = as_lines(events(spark, 400)).repartition(4).withColumn("value", F.when(F.rand(1) > 0.98, F.raise_error(F.lit("broken half-way"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken half-way"):
        broken.write.format("auditlines").mode("append").save(path)
    assert read_lines(spark, path).count() == 40
    assert set(before) <= set(files(path))
    LinesSink(path).write(events(spark, 400))
    assert read_lines(spark, path).count() == 440


def test_named_write_replaces_its_earlier_try(spark, tmp_path):
    path = str(tmp_path / "l")
    sink = LinesSink(path)
    sink.write_named(events(spark, 8), "run 1/a")
    place = sink.write_named(events(spark, 8), "run 1/a")
    sink.write_named(events(spark, 3), "run 2")
    assert os.path.isfile(place) and read_lines(spark, path).count() == 11
    assert sum(Path(f).read_bytes().count(b"\n") for f in files(path)) == 11
    with pytest.raises(Exception, match="only appended"):
        as_lines(events(spark, 1)).write.format("auditlines").mode("overwrite").save(path)


def test_empty_and_nulls(spark, tmp_path):
    path = str(tmp_path / "l")
    assert read_lines(spark, path).count() == 0
    LinesSink(path).write(events(spark, 0))
    assert read_lines(spark, path).count() == 0
    register(spark)
    odd = spark.createDataFrame([("a", None, None), ("b b", "", date(2024, 1, 1)), ("c", "_null", date(2024, 1, 1))], lines.SCHEMA)
    odd.write.format("auditlines").mode("append").save(path)
    found = read_lines(spark, path)
    assert sorted(found.collect(), key=lambda r: r.value) == odd.collect()
    assert found.where("category = ''").count() == 1 and found.where("category IS NULL").count() == 1 and found.where("category <> ''").count() == 1


def test_many_open_files(spark, tmp_path):
    path = str(tmp_path / "l")
    many = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("value"), F.concat(F.lit("c"), (F.col("id") % 100).cast("string")).alias("category"), F.lit(date(2024, 1, 1)).alias("day"))
    register(spark)
    many.write.format("auditlines").mode("append").save(path)
    assert read_lines(spark, path).groupBy("category").count().where("count = 4").count() == 100


def test_stream_written_once_over_restarts(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("s", "l", "c"))
    for i in range(2):
        events(spark, 10, action=f"a{i}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, 1).schema).parquet(source)
        stream_lines(stream, path, state, "main").awaitTermination()
    os.remove(Path(state) / "commits" / "1")  # the last batch was written but not noted: it is written again
    if (Path(state) / "commits" / ".1.crc").exists():
        os.remove(Path(state) / "commits" / ".1.crc")
    stream_lines(stream, path, state, "main").awaitTermination()
    assert read_lines(spark, path).groupBy(F.get_json_object("value", "$.action").alias("a")).count().where("count = 10").count() == 2
    assert read_lines(spark, path).count() == 20
    with pytest.raises(Exception, match="its name over restarts"):
        as_lines(stream).writeStream.format("auditlines").options(path=path, checkpointLocation=str(tmp_path / "d")).start().awaitTermination()
