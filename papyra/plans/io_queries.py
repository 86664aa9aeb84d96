"""Queries of readers, sinks and streams: each writes rows of a driver's table and reads them back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers, sinks
from ..sources.scratch import scratch
from ..streaming import streams
from .registry import load, query


@query("sc07_json_files", "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS c_name, c_custkey % 10 = 0 AS corrupt FROM customer")
def json_files(spark, sf_dir):
    to = scratch(spark, "json")
    line = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit('{"k": '), F.col("c_custkey").cast("string"), F.lit(', "name": {'))).otherwise(F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))))
    load(spark, sf_dir, "customer").select(line.alias("value")).write.text(to)
    rows = readers.json_files(spark, to, "k long, name string", lines=True)
    key = F.coalesce("k", F.regexp_extract("_corrupt_record", r"(\d+)", 1).cast("long"))
    return rows.select(key.alias("c_custkey"), F.when(F.col("_corrupt_record").isNull(), F.col("name")).alias("c_name"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Every nation a file of its own, in a tree of folders."""
    to = scratch(spark, "files")
    n = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    n.write.partitionBy("r", "k").text(to)
    return to


def _key(path):
    return F.regexp_extract(path, r"/k=(\d+)/", 1).cast("int")


@query("sc08_texts", "SELECT n_nationkey, n_name || chr(10) AS text FROM nation")
def texts(spark, sf_dir):
    return readers.texts(spark, _files(spark, sf_dir)).select(_key(F.col("path")).alias("n_nationkey"), "text")


@query("sc09_binaries", "SELECT n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def binaries(spark, sf_dir):
    return readers.binaries(spark, _files(spark, sf_dir), "*.txt").select(_key(F.col("path")).alias("n_nationkey"), "length", F.sha2("content", 256).alias("sha256"))


@query("sc10_file_tree", "SELECT n_regionkey, count(*) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def file_tree(spark, sf_dir):
    tree = readers.file_tree(spark, _files(spark, sf_dir)).where("path LIKE '%.txt'")
    return tree.groupBy(F.regexp_extract("path", r"/r=(\d+)/", 1).cast("int").alias("n_regionkey")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@F.pandas_udf(T.BinaryType())
def _zipped(names: pd.Series, keys: pd.Series) -> pd.Series:
    def one(name: str, key: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a/name.txt", name, zipfile.ZIP_DEFLATED)
            z.writestr("a/", "")
            z.writestr("b.txt", "plain text")
        data = out.getvalue()
        if key % 5 == 1:  # a byte of the stored entry changed
            data = data.replace(b"plain text", b"plain tex!")
        return data if key % 5 != 2 else data[:30]

    return pd.Series([one(n, k) for n, k in zip(names, keys, strict=True)])


@query("sc17_zip_entries", """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 2 THEN n END AS name, CASE WHEN c_custkey % 5 <> 2 THEN CASE n WHEN 'b.txt' THEN 10 ELSE length(c_name) END END AS size, c_custkey % 5 <> 2 AND NOT (c_custkey % 5 = 1 AND n = 'b.txt') AS crc_ok,
       CASE WHEN c_custkey % 5 = 2 OR (c_custkey % 5 = 1 AND n = 'b.txt') THEN NULL WHEN n = 'b.txt' THEN 'plain text' ELSE c_name END AS data
FROM customer, (VALUES ('a/name.txt'), ('b.txt')) t(n) WHERE c_custkey % 5 <> 2 OR n = 'b.txt'""")
def zip_entries(spark, sf_dir):
    files = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), _zipped("c_name", "c_custkey").alias("content"))
    return readers.zip_entries(files).select(F.col("path").cast("long").alias("c_custkey"), "name", "size", "crc_ok", F.decode("data", "UTF-8").alias("data"))


PDF = "CASE c_custkey % 4 WHEN 0 THEN '%PDF-1.7' || repeat('x', 2000) || '%%EOF' WHEN 1 THEN '%PDF-1.7 %%EOF' WHEN 2 THEN 'x%PDF-' || repeat('x', 99) || '%%EOF' ELSE '%PDF-1.4' || repeat('x', 80) || '%%EOF' || repeat(' ', 2000) END"


@query("sf67_valid_pdfs", "SELECT c_custkey, c_custkey % 4 = 0 AS valid FROM customer")
def valid_pdfs(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", readers.valid_pdf(F.expr(f"CAST({PDF} AS BINARY)")).alias("valid"))


# --- sinks -------------------------------------------------------------------------------------


@query("sk01_published", "SELECT 'customers' AS name, CAST(c_custkey AS BIGINT) AS id FROM customer UNION ALL SELECT 'nations', n_nationkey FROM nation")
def published(spark, sf_dir):
    """Two tables published together, over older ones."""
    to = scratch(spark, "published")
    c, n = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    sinks.publish({f"{to}/customers": c.limit(1), f"{to}/nations": n.limit(1)})
    sinks.publish({f"{to}/customers": c, f"{to}/nations": n})
    return _named(spark, to, "customers").unionByName(_named(spark, to, "nations"))


def _named(spark: SparkSession, to: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{to}/{name}").select(F.lit(name).alias("name"), "id")


@query("sk02_kept_after_an_error", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation")
def kept_after_an_error(spark, sf_dir):
    """A publication that fails half way leaves what was there."""
    to = scratch(spark, "kept")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    sinks.publish({f"{to}/nations": n})
    try:
        sinks.publish({f"{to}/nations": n.limit(1), f"{to}/torn": n.select(F.raise_error(F.lit("torn")).alias("id"))})
    except Exception:  # noqa: BLE001  the error that is asked for
        pass
    return spark.read.parquet(f"{to}/nations")


@query("sk03_index", "SELECT c_custkey, c_name, 3 AS schema_version, 'sig' AS source_signature FROM customer")
def index(spark, sf_dir):
    """A full refresh: the second snapshot replaces the first."""
    to = scratch(spark, "index")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.write_snapshot(c.limit(5), to, 2, "old")
    sinks.write_snapshot(c, to, 3, "sig")
    return readers.snapshot(spark, to, 3)


@query("sk04_other_versions", "SELECT count(*) AS rows FROM customer WHERE FALSE")
def other_versions(spark, sf_dir):
    """A snapshot of another version is an empty index."""
    to = scratch(spark, "version")
    sinks.write_snapshot(load(spark, sf_dir, "customer").select("c_custkey"), to, 2)
    return readers.snapshot(spark, to, 3).agg(F.count("*").alias("rows"))


@query("sk05_log", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, 'again' FROM events WHERE event_id % 3 = 0")
def log(spark, sf_dir):
    to = scratch(spark, "log")
    e = load(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append_log(e, to)
    sinks.append_log(e.where("event_id % 3 = 0").withColumn("event_type", F.lit("again")), to)
    return readers.json_files(spark, to, "event_id long, event_type string", lines=True).drop("_corrupt_record")


@query("sk09_bundles", "SELECT conv_id, count(*) AS blocks, 1 AS files FROM conversations GROUP BY 1")
def bundles(spark, sf_dir):
    """Every conversation's rows in one file."""
    to = scratch(spark, "bundle")
    sinks.write_bundle(load(spark, sf_dir, "conversations"), to, "conv_id", 4)
    rows = spark.read.schema("conv_id long, turn long, role string, text string").json(to).withColumn("file", F.input_file_name())
    return rows.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.count_distinct("file").cast("int").alias("files"))


# --- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table as a stream of its files: a folder of them, or one in the tables' folder."""
    reader = spark.readStream.schema(load(spark, sf_dir, name).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("sm01_frames_of_a_stream", "SELECT CAST(conv_id AS VARCHAR) AS stream, role AS event, 'a' || chr(10) || 'b' AS data FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) c WHERE turn < last")
def frames_of_a_stream(spark, sf_dir):
    """Chunks that end in the middle of the next frame; each stream's last frame is never ended."""
    c = _stream(spark, sf_dir, "conversations")
    chunk = F.concat(F.lit("event: "), F.col("role"), F.lit("\r\ndata: a\r\ndata:b"))
    parts = c.select(F.col("conv_id").cast("string").alias("stream"), "turn", F.posexplode(F.array(F.lit("\n\n"), chunk)).alias("p", "chunk"))
    return streams.drained(streams.frames(parts.select("stream", (F.col("turn") * 2 + F.col("p")).alias("seq"), "chunk")), scratch(spark, "frames"))


@query("sm03_emissions", "SELECT CAST(conv_id AS VARCHAR) AS stream, turn AS seq, 'part ' || CAST(turn AS VARCHAR) || '.' AS delta FROM conversations")
def emissions(spark, sf_dir):
    """Every second record is a snapshot of all so far: only its new part is emitted."""
    part = lambda t: F.concat(F.lit("part "), t.cast("string"), F.lit("."))
    sofar = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn")), part), "")
    record = F.when(F.col("turn") % 2 == 1, F.to_json(F.struct(sofar.alias("snapshot")))).otherwise(F.to_json(F.struct(F.lit("APPEND").alias("op"), part(F.col("turn")).alias("value"))))
    e = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("seq"), record.alias("record"))
    return streams.drained(streams.emissions(e), scratch(spark, "emissions"))


@query("sm04_completions", "SELECT CAST(conv_id AS VARCHAR) AS stream, string_agg(role, '' ORDER BY turn) AS text, 'r' || string_agg('why' || CAST(turn AS VARCHAR), '' ORDER BY turn) AS reasoning FROM conversations GROUP BY 1")
def completions(spark, sf_dir):
    """Deltas whose <think> tags and frames are cut between chunks, some as bare JSON."""
    event = lambda text: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    frame = F.concat(event(F.concat("role", F.lit("<thi"))), event(F.concat(F.lit("nk>why"), F.col("turn").cast("string"), F.lit("</th"))), event(F.lit("ink>")))
    half = F.floor(F.length(frame) / 2).cast("int")
    first = F.when(F.col("turn") == 0, '{"type":"content_block_delta","delta":{"type":"thinking_delta","thinking":"r"}}').otherwise("")
    chunks = F.array(first, F.left(frame, half), F.substr(frame, half + 1))
    c = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), "turn", F.posexplode(chunks).alias("p", "chunk"))
    return streams.drained(streams.completions(c.select("stream", (F.col("turn") * 3 + F.col("p")).alias("seq"), "chunk")), scratch(spark, "completions"), "update")


@query("sm07_committed", "SELECT event_id, event_type, 0 AS batch FROM events")
def committed(spark, sf_dir):
    """A stream committed batch by batch; started again from its checkpoint it has nothing left to do."""
    to = scratch(spark, "committed")
    for _ in range(2):
        e = _stream(spark, sf_dir, "events").select("event_id", "event_type")
        sinks.commit_batches(e, f"{to}/rows", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string, batch int").parquet(f"{to}/rows")
