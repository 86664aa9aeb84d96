"""Readers: document folders, JSON and line logs, archives, snapshots with a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents; what does not parse is a row of nulls with its text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", not lines).json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file as one text, folders included."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of every file below path; Spark passes over files of no bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def file_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file; contents are not read."""
    return binaries(spark, path).select("path", "length")


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A written index, empty if its rows are of another version."""
    return spark.read.parquet(path).where(F.col("schema_version") == version)


def corpus(sources: DataFrame, translations: DataFrame, titles: DataFrame) -> DataFrame:
    """One row a document of (document_id, source), (document_id, translation), (document_id, title).

    The first non-empty translation in name order counts; a document without source,
    translation and title is left out.
    """
    first = translations.where("trim(translation) <> ''").groupBy("document_id").agg(F.min_by("translation", "name").alias("translation"))
    rows = sources.join(first, "document_id", "full").join(titles, "document_id", "full")
    return rows.where("coalesce(source, translation, title) IS NOT NULL AND concat(coalesce(source, ''), coalesce(translation, ''), coalesce(title, '')) <> ''")


def cards(rows: DataFrame, schema: str) -> DataFrame:
    """(identity, payload) of a store: the payload parsed; rows that do not parse are left out."""
    return rows.withColumn("card", F.from_json("payload", schema)).where("card IS NOT NULL AND try_parse_json(payload) IS NOT NULL").select("identity", "card")


def multi_part_pages(parts: DataFrame) -> DataFrame:
    """(document_id, part, page_index, ...) of split uploads -> page_index counted through the parts."""
    from pyspark.sql import Window

    sizes = parts.groupBy("document_id", "part").agg((F.max("page_index") + 1).alias("_pages"))
    w = Window.partitionBy("document_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("document_id", "part", F.coalesce(F.sum("_pages").over(w), F.lit(0)).alias("_offset"))
    return parts.join(offsets, ["document_id", "part"]).withColumn("page_index", F.col("page_index") + F.col("_offset")).drop("_offset")


def archive_roots(entries: DataFrame, archive: str, path: str) -> DataFrame:
    """(archive, root, score): the folder of an archive that most looks like a parsed document's.

    Every folder above a file scores: 10 for a Markdown file, 8 for a model, content,
    middle or layout JSON file, 2 for a file below images; ties go to the shorter name.
    """
    from pyspark.sql import Window

    low = F.lower(F.col(path))
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    score = F.when(name.endswith(".md"), 10).when(name.rlike(r"(model|content|middle|layout)[^/]*\.json$"), 8).otherwise(0) + F.when(low.rlike("(^|/)images/"), 2).otherwise(0)
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = entries.select(archive, score.alias("score"), F.explode(above).alias("root")).groupBy(archive, "root").agg(F.sum("score").alias("score"))
    w = Window.partitionBy(archive).orderBy(F.col("score").desc(), F.length("root"), "root")
    return folders.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, content) of archives -> (path, name, size, crc_ok, data) of their entries, one archive a task."""
    import pyarrow as pa

    def read(batches):
        import io
        import zipfile

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for e in z.infolist():
                            if not e.is_dir():
                                try:
                                    rows.append((path, e.filename, e.file_size, True, z.read(e)))
                                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                                    rows.append((path, e.filename, e.file_size, False, None))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, False, None))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "name", "size", "crc_ok", "data"])

    return files.select("path", "content").mapInArrow(read, "path string, name string, size long, crc_ok boolean, data binary")


def container_format(content):
    """What a file is by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("434A"), "caj").when(head.startswith("4B4448"), "kdh").when(head.startswith("484E"), "hn").otherwise("unknown")


def valid_pdf(content):
    """Header, trailer and some size."""
    tail = F.decode(F.substring(content, -1024, 1024), "ISO-8859-1")
    return (F.length(content) >= 64) & (F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-") & tail.contains("%%EOF")
