"""Files as a sink: whole or not at all, whatever fails."""

import os

import pytest
from lodestone.operators import assets
from lodestone.sources import sink
from pyspark.sql import functions as F


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def frame(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("a/b"), F.col("id") % 3, F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").cast("binary").alias("content"))


def test_files_are_written_and_replaced(spark, tmp_path):
    for _ in range(2):
        sink.write_files(frame(spark, 20), str(tmp_path))
    assert tree(tmp_path) == {f"a/b{i % 3}/{i}.md": f"text {i}".encode() for i in range(20)}
    sink.write_files(frame(spark, 1).withColumn("content", F.lit(b"new")), f"file://{tmp_path}")
    assert tree(tmp_path)["a/b0/0.md"] == b"new"
    sink.write_files(frame(spark, 0), str(tmp_path))
    assert len(tree(tmp_path)) == 20


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = frame(spark, 20).withColumn("content", F.when(F.col("path") == "a/b1/19.md", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(broken, str(tmp_path))
    assert tree(tmp_path) == {}
    for bad in ("../out.md", "/etc/x", "a/../../x", ""):
        with pytest.raises(Exception, match="not a path"):
            sink.write_files(frame(spark, 1).withColumn("path", F.lit(bad)), str(tmp_path / "in"))
    assert tree(tmp_path) == {}


def test_a_lost_driver(tmp_path, monkeypatch):
    """Half of the moves are made when the driver goes; another process makes the rest."""
    writer = sink.FilesWriter(str(tmp_path))
    staged = [writer.write(iter([{"path": f"x/{t}{i}", "content": b"c"} for i in range(3)])) for t in "ab"]
    whole = sink.make_moves

    def half(fs, moves):
        whole(fs, moves[:2])
        raise KeyboardInterrupt

    monkeypatch.setattr(sink, "make_moves", half)
    with pytest.raises(KeyboardInterrupt):
        writer.commit(staged)
    monkeypatch.undo()
    # Another job had staged files only.
    other = sink.FilesWriter(str(tmp_path))
    other.write(iter([{"path": "never", "content": b"c"}]))
    assert sink.finish_moves(str(tmp_path)) == 2 and sink.finish_moves(str(tmp_path)) == 0
    assert sorted(tree(tmp_path)) == ["x/a0", "x/a1", "x/a2", "x/b0", "x/b1", "x/b2"]


def test_assets(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1.png", b"one"), ("s", "1.png", b"one"), ("t", "2.svg", b"two")], "slug string, name string, content binary")
    assert assets.write_assets(rows, str(tmp_path)) == 2
    assert tree(tmp_path) == {"assets/s/1.png": b"one", "assets/t/2.svg": b"two"}
