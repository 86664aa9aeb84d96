import io
import zipfile

import pytest

from papyra.sources import readers, sinks
from papyra.streaming import streams


def test_publish_replaces_whole(spark, tmp_path):
    to = f"file://{tmp_path}/t"
    sinks.publish({to: spark.range(3)})
    sinks.publish({to: spark.range(5)})
    assert spark.read.parquet(to).count() == 5
    with pytest.raises(Exception):
        sinks.publish({to: spark.range(7), f"file://{tmp_path}/u": spark.sql("SELECT raise_error('no') AS x")})
    assert spark.read.parquet(to).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_snapshot_version(spark, tmp_path):
    to = f"file://{tmp_path}/s"
    sinks.write_snapshot(spark.range(4), to, 2, "sig")
    assert readers.snapshot(spark, to, 2).count() == 4
    assert readers.snapshot(spark, to, 1).count() == 0


def test_texts_and_binaries(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo")
    (tmp_path / "y.md").write_text("y")
    (tmp_path / "empty.md").write_text("")
    assert sorted(r.text for r in readers.texts(spark, str(tmp_path)).collect()) == ["one\ntwo", "y"]
    assert readers.file_tree(spark, str(tmp_path)).count() == 2


def test_json_is_permissive(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"a": 1}\nnot json\n')
    rows = readers.json_files(spark, str(tmp_path), "a int", lines=True).collect()
    assert sorted((r.a or 0, r._corrupt_record is not None) for r in rows) == [(0, True), (1, False)]


def test_zip_entries(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/full.md", "text")
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = readers.zip_entries(readers.binaries(spark, str(tmp_path), "*.zip")).collect()
    assert sorted((r.name or "", r.crc_ok) for r in rows) == [("", False), ("d/full.md", True)]


def test_frames_cut_anywhere():
    text = "event: a\ndata: x\ndata: y\n\n: note\n\ndata: z\n\n"
    for step in (1, 3, 7, 100):
        p, out = streams.FrameParser(), []
        for i in range(0, len(text), step):
            out += p.push(text[i : i + step], final=i + step >= len(text))
        assert out == [("a", "x\ny"), ("message", "z")]


def test_reply_emits_only_what_is_new():
    r = streams.Reply()
    r.apply({"op": "APPEND", "value": "ab"})
    assert r.emit() == "ab"
    r.apply({"op": "SET", "value": "abcd"})
    assert r.emit() == "cd" and r.emit() == ""


def test_thinking_is_parted():
    assert streams.split_thinking(["a<thi", "nk>b</th", "ink>c"]) == ("ac", "b")


def test_streamed_frames(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, chunk in enumerate(["data: a", "\n\ndata: b\n", "\n"]):
        spark.createDataFrame([("s", i, chunk)], "stream string, seq long, chunk string").coalesce(1).write.mode("append").parquet(str(src))
    found = streams.frames(spark.readStream.schema("stream string, seq long, chunk string").parquet(str(src)))
    q = found.writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.data for r in spark.table("frames_out").collect()) == ["a", "b"]
