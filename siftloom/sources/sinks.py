"""Writers: metadata lines, manifests, structured records and speech datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.functions import media


def key_category(key: Column, run_folder: Column) -> Column:
    """Folder of a storage key below its run."""
    folder = F.regexp_replace(F.regexp_replace(key, r"^/+", ""), r"/?[^/]*$", "")
    return F.when(
        F.startswith(folder, F.concat(run_folder, F.lit("/"))),
        F.substring(folder, F.length(run_folder) + 2, F.length(folder)),
    ).otherwise(folder)


#: Tasks that share a folder, rows of one file, and folders that one task writes.
SPREAD = 8
FILE_ROWS = 1_000_000
TASK_FOLDERS = 2000


def _tasks(rows: DataFrame, key: str) -> int:
    """Tasks for a folder per ``key``: a file costs the same however small, and adaptive execution counts bytes only."""
    folders = rows.agg(F.approx_count_distinct(key)).collect()[0][0]
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-folders // TASK_FOLDERS))


def _by_folder(rows: DataFrame, *keys: str):
    """Writer of one folder per key combination, with at most ``SPREAD`` tasks writing to a folder."""
    salt = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SPREAD))
    placed = rows.repartition(*[F.col(k) for k in keys], salt)
    return placed.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*keys)


def write_metadata(files: DataFrame, out: str, run: str = "run_pk", category: str = "category") -> None:
    """One JSON line per file, once per run and once per category folder.

    Rows are gathered by run, so a folder gets a few part files however many tasks read
    the table.
    """
    columns = [c for c in files.columns if c != category]
    _by_folder(files.select(*columns, F.col(run).alias("run")), "run").json(f"{out}/runs")
    by_category = files.select(
        *columns, F.col(run).alias("run"), F.replace(F.col(category), F.lit("/"), F.lit("__")).alias("category")
    )
    _by_folder(by_category.where("category <> ''"), "run", "category").json(f"{out}/categories")


def write_manifests(manifests: DataFrame, out: str) -> None:
    """Run manifests as JSON text, one folder per run."""
    rows = manifests.select(F.to_json(F.struct(*manifests.columns)).alias("value"), F.col("run_id").alias("run"))
    _by_folder(rows, "run").text(f"{out}/runs")


def write_category_manifests(summary: DataFrame, parts: DataFrame, out: str) -> None:
    """Category manifests: a summary line, and the file list in numbered parts."""
    folder = lambda df: df.withColumns(
        {"run": F.col("run_id"), "cat": F.replace(F.col("category"), F.lit("/"), F.lit("__"))}
    )
    for name, table in (("summary", summary), ("files", parts)):
        rows = folder(table).select(F.to_json(F.struct(*table.columns)).alias("value"), "run", "cat")
        _by_folder(rows, "run", "cat").text(f"{out}/{name}")


def record_keys(records: DataFrame, run_folder: Column) -> DataFrame:
    """Records with ``record_sha``, ``file_name`` and ``storage_key``."""
    body = F.to_json(F.struct(*records.columns))
    digest = F.sha2(body, 256)
    return records.withColumn("record_sha", digest).withColumn(
        "file_name", FN.record_name(F.col("title"), F.col("record_sha"))
    ).withColumn("storage_key", F.concat(run_folder, F.lit("/data/web_content/"), "file_name"))


def write_records(records: DataFrame, out: str, fmt: str = "json") -> None:
    """Structured records, one folder per source domain."""
    rows = records.withColumn("domain", F.col("source_domain"))
    _by_folder(rows, "domain").format(fmt).save(f"{out}/data/web_content")


def write_speech_datasets(segments: DataFrame, out: str) -> None:
    """STT and TTS JSON lines, and the transcript text of every medium.

    The lines name their medium, so they need no folder per medium, and are written by the
    tasks that read them.  The folder of a medium's transcript holds its parts in one sorted
    file, which is cut after ``FILE_ROWS`` parts: read in the order of their names, the files
    are the text.
    """
    stt = media.stt_records(segments)
    lines = lambda df: df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    lines(stt.drop("chunk_index")).json(f"{out}/stt")
    lines(media.tts_records(stt)).json(f"{out}/tts")
    parts = media.transcript_parts(stt)
    header = F.concat(F.lit("Source: "), "title", F.lit("\nURL: "), "source_url", F.lit("\n\n"))
    text = parts.withColumn("value", F.when(F.col("part_no") == 0, F.concat(header, "text")).otherwise(F.col("text")))
    placed = text.repartition(_tasks(segments, "medium_id"), "medium_id").sortWithinPartitions("medium_id", "part_no").select("value", "medium_id")
    lines(placed).partitionBy("medium_id").text(f"{out}/transcript")
