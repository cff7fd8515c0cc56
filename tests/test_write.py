"""Lines that are packed where it pays, and files that change only when all of them are written."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidewire.sources import write


def files_of(path):
    """What a reader takes: nothing below a name that begins with an underscore."""
    found = ((p.relative_to(path), p) for p in path.rglob("*") if not any(n[0] in "_." for n in p.relative_to(path).parts))
    return {str(name): p.read_bytes() for name, p in found if p.is_file()}


def rows_of(spark, path, schema):
    return sorted((tuple(r) for r in spark.read.schema(schema).json(str(path)).collect()), key=str)


def test_files_are_packed_only_where_smaller(spark, tmp_path):
    rows = [(1, "x", True), (2, "y " * 4000, False), (3, None, None), (4, 'q"\n 漢', True)]
    df = spark.createDataFrame(rows, "id long, text string, flag boolean").repartition(1)
    write.write_packed(df, str(tmp_path / "out"), ("flag",))
    got = files_of(tmp_path / "out")
    assert {n.split("/")[0]: n.endswith(".gz") for n in got} == {"flag=true": False, "flag=false": True, f"flag={write.NO_VALUE}": False}
    for name, body in got.items():
        text = gzip.decompress(body) if name.endswith(".gz") else body
        assert len(body) <= len(text) and (name.endswith(".gz") or len(gzip.compress(text, write.LEVEL)) >= len(body))
    assert rows_of(spark, tmp_path / "out", "id long, text string, flag boolean") == sorted(rows, key=str)


def test_a_failing_task_leaves_the_old_files(spark, tmp_path):
    path, schema = tmp_path / "out", "id long, text string"
    df = spark.range(100, numPartitions=4).withColumn("text", F.repeat(F.lit("word "), 50))
    write.write_packed(df, str(path))
    before = files_of(path)
    assert len(before) == 4 and all(n.endswith(".gz") for n in before)
    with pytest.raises(Exception, match="broken"):
        write.write_packed(df.withColumn("text", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("new"))), str(path))
    assert files_of(path) == before  # a task that was still writing may leave files in the job's hidden folder
    write.write_packed(df.limit(3), str(path), mode="append")
    assert len(rows_of(spark, path, schema)) == 103 and set(before) < set(files_of(path))
    write.write_packed(df.where("id < 2"), str(path))
    assert [r[0] for r in rows_of(spark, path, schema)] == [0, 1] and not set(before) & set(files_of(path))
    write.write_packed(df.limit(0), str(path))
    assert rows_of(spark, path, schema) == []


def test_folders_that_end_up_empty_go_and_other_files_stay(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(6).selectExpr("id", "cast(id % 3 as int) as k", "id > 2 as late")
    write.write_packed(df, str(path), ("late", "k"))
    (path / "_notes").mkdir()
    (path / "_notes" / "kept").write_text("x")
    write.write_packed(df.where("k = 1 and late"), str(path), ("late", "k"))
    assert {p.name for p in path.iterdir()} == {"late=true", "_notes"} and {p.name for p in (path / "late=true").iterdir()} == {"k=1"}
    assert (path / "_notes" / "kept").read_text() == "x"
    with pytest.raises(ValueError):
        write.write_packed(df.withColumn("k", F.lit("a/b")), str(path), ("k",))


def test_files_of_lost_attempts_are_not_committed(tmp_path):
    writer = write.PackedWriter({"path": str(tmp_path)}, True)
    rows = [{"folder": "", "value": "{}"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.files != kept.files
    writer.commit([kept, None])
    assert list(files_of(tmp_path)) == kept.files and [p.name for p in tmp_path.iterdir()] == kept.files
