"""Readers: catalog tables, JSON lines, manifests, storage trees and file bodies."""

from __future__ import annotations

import io
import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.functions import urls
from siftloom.sources import schemas

# --- catalog -----------------------------------------------------------------


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Catalog table kept as Parquet, with its fixed schema."""
    return spark.read.schema(schemas.CATALOG[table]).parquet(f"{root}/{table}")


def read_catalog_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
    partitions: int, **options: str,
) -> DataFrame:
    """Live catalog table, read in parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), **options,
        )
        .load()
    )


# --- JSON lines and manifests ------------------------------------------------


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of JSON-lines files: blank lines dropped, bad lines kept as {raw}.

    ``line`` is always valid JSON.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return tolerant_lines(text.select(F.col("_metadata.file_path").alias("path"), "value"))


def tolerant_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    value = F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))
    kept = lines.withColumn(column, value).where(F.col(column) != "")
    ok = F.try_parse_json(F.col(column)).isNotNull()
    line = F.when(ok, F.col(column)).otherwise(F.to_json(F.struct(F.col(column).alias("raw"))))
    return kept.withColumn("line", line).withColumn("is_json", ok).drop(column)


def manifest_candidates(runs: DataFrame) -> DataFrame:
    """(run_pk, key, rank): where a run's manifest may be, best place first.

    ``runs``: run_pk, run_id, slug, collector_type, manifest_key.
    """
    zone = F.when(F.lower("collector_type") == "telegram", "telegram").otherwise("web")
    slug = F.coalesce("slug", F.lit("unknown"))
    at = lambda *parts: F.concat_ws("/", *parts, F.lit("manifest.json"))
    keys = F.array(
        F.nullif(F.col("manifest_key"), F.lit("")),
        at(F.lit("00_raw"), zone, slug, F.col("run_id")),
        at(F.lit("00_raw"), zone, slug, F.col("run_pk")),
        at(F.lit("00_raw"), slug, F.col("run_id")),
        at(slug, F.col("run_id")),
    )
    return runs.select("run_pk", F.posexplode(keys).alias("rank", "key")).where("key IS NOT NULL")


def read_manifests(runs: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifest of each run from the first candidate that exists.

    ``objects``: key, content.  Content that is not JSON is returned as ``raw``.
    """
    bodies = objects.where(F.col("key").endswith("manifest.json")).select("key", "content")
    found = (
        manifest_candidates(runs)
        .join(bodies, "key")
        .groupBy("run_pk")
        .agg(F.min_by(F.struct("key", "content"), "rank").alias("m"))
    )
    text = F.decode("m.content", "UTF-8")
    ok = F.try_parse_json(text).isNotNull()
    return found.select(
        "run_pk",
        F.col("m.key").alias("manifest_key"),
        F.when(ok, F.from_json(text, schemas.MANIFEST)).alias("manifest"),
        F.when(~ok, text).alias("raw"),
    )


# --- storage tree ------------------------------------------------------------


def read_storage(spark: SparkSession, root: str) -> DataFrame:
    """Every object under ``root``: key, kind, content, size, modified, sha256.

    Bodies stay lazy: a query that does not touch ``content`` or ``sha256`` reads
    the listing only.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = os.path.abspath(root) if "://" not in root else root
    key = F.regexp_replace(
        F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(prefix.rstrip("/")) + "/", ""
    )
    name = urls.basename(F.col("key"))
    return raw.withColumn("key", key).select(
        "key",
        F.when(name == "manifest.json", "manifest").when(name == "metadata.jsonl", "metadata").otherwise("content").alias("kind"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
    )


TEXT_EXTENSIONS = [".txt", ".md", ".rst", ".csv", ".tsv", ".json", ".jsonl", ".xml", ".html", ".htm"]


#: Stands for a replacement character of the file itself while bad bytes are left out.
_OWN_REPLACEMENT = "\0\1own\1\0"


def plain_text(content: Column, chars: int | None = None) -> Column:
    """Body as text; bad bytes are left out, replacement characters of the file stay.

    ``chars`` cuts the text for a preview.
    """
    raw = F.replace(content.cast("string"), F.lit("�"), F.lit(_OWN_REPLACEMENT))
    text = F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    text = F.replace(text, F.lit(_OWN_REPLACEMENT), F.lit("�"))
    return text if chars is None else F.substring(text, 1, chars)


def _epub_text(archive: zipfile.ZipFile) -> tuple[str, str | None]:
    names = set(archive.namelist())
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    package_path = container.find(".//{*}rootfile").attrib["full-path"]
    package = ElementTree.fromstring(archive.read(package_path))
    title = package.find(".//{*}title")
    chapters = []
    for item in package.findall(".//{*}item"):
        href = item.attrib.get("href", "")
        member = os.path.join(os.path.dirname(package_path), href)
        if href.endswith((".html", ".xhtml", ".htm")) and member in names:
            chapters.append(re.sub(r"<[^>]+>", " ", archive.read(member).decode("utf-8", "ignore")))
    return " ".join(chapters), title.text if title is not None else None


def _docx_text(archive: zipfile.ZipFile) -> tuple[str, str | None]:
    names = set(archive.namelist())
    text, title = "", None
    if "word/document.xml" in names:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
        text = " ".join(t.text for p in body.findall(".//{*}p") for t in p.findall(".//{*}t") if t.text)
    if "docProps/core.xml" in names:
        found = ElementTree.fromstring(archive.read("docProps/core.xml")).find(".//{*}title")
        title = found.text if found is not None else None
    return text, title


def _read_archive(extension: str, content: bytes, chars: int | None) -> tuple[str | None, str | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            text, title = (_epub_text if extension == ".epub" else _docx_text)(archive)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError) as e:
        return None, None, f"BAD_ARCHIVE: {e}"
    except (ElementTree.ParseError, KeyError, AttributeError) as e:
        return None, None, f"BAD_CONTENT: {e}"
    except (NotImplementedError, RuntimeError) as e:  # an unknown compression, or encrypted
        return None, None, f"UNSUPPORTED_ARCHIVE: {e}"
    return text[:chars], (title or "").strip() or None, None


def archive_texts(objects: DataFrame, chars: int | None = None) -> DataFrame:
    """(key, text, title, error) of EPUB and DOCX objects (key, content).

    Unpacking is a codec step that no column function covers; it runs per Arrow
    batch inside the scan's own tasks, on these file types only.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read_archive(e, c, chars) for e, c in zip(batch["ext"], batch["content"])]
            columns = {name: [f[i] for f in found] for i, name in enumerate(("text", "title", "error"))}
            yield pd.DataFrame({"key": batch["key"], **columns}, dtype=object)

    ext = F.lower(urls.extension_of(F.col("key")))
    wanted = objects.select("key", "content", ext.alias("ext")).where(F.col("ext").isin(".epub", ".docx"))
    return wanted.mapInPandas(unpack, "key string, text string, title string, error string")


def extract_texts(objects: DataFrame, chars: int | None = None) -> DataFrame:
    """(key, text, title, error) of text files, EPUBs and DOCX files."""
    ext = F.lower(urls.extension_of(F.col("key")))
    plain = objects.where(ext.isin(TEXT_EXTENSIONS)).select(
        "key", plain_text(F.col("content"), chars).alias("text"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("error"),
    )
    return plain.unionByName(archive_texts(objects, chars))


def json_previews(files: DataFrame, objects: DataFrame) -> DataFrame:
    """(file_pk, is_json, data, raw): parsed body, raw body, or a record of catalog columns."""
    bodies = objects.select(F.col("key").alias("storage_key"), F.decode("content", "UTF-8").alias("body"))
    joined = files.join(bodies, "storage_key", "left")
    ok = F.try_parse_json("body").isNotNull()
    given = F.when(F.try_parse_json("metadata").isNotNull() & ~F.trim("metadata").isin("{}", "null"), F.col("metadata"))
    fallback = F.to_json(
        F.struct(
            *[F.col(c) for c in ("file_id", "file_name", "mime_type", "file_size", "sha256", "status",
                                 "storage_key", "source_url", "approval_status") if c in files.columns]
        )
    )
    absent = F.col("body").isNull()
    return joined.select(
        "file_pk",
        (absent | ok).alias("is_json"),
        F.when(absent, F.coalesce(given, fallback)).when(ok, F.col("body")).alias("data"),
        F.when(~absent & ~ok, F.col("body")).alias("raw"),
    )


# --- recovery ----------------------------------------------------------------


def recover_runs(manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """Run rows for manifests whose run the catalog lacks.

    ``manifests``: key, text.  Counts come from flat fields or from ``stats``; of
    several manifests for one run the shortest key (the run's own) is used.
    """
    at = FN.storage_key_parts(F.col("key"))
    parsed = manifests.select(
        "key", at.alias("at"), F.from_json("text", schemas.MANIFEST).alias("m"),
        F.try_parse_json("text").isNotNull().alias("ok"),
    ).where("ok")
    nz = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in cs], F.lit(0)).cast("int")
    rows = parsed.select(
        F.coalesce("m.run_id", "at.run_key").alias("run_id"),
        F.lower(F.coalesce("m.source_slug", "m.target_slug", "at.source_slug")).alias("source_slug"),
        F.coalesce("m.status", F.lit("COMPLETED")).alias("status"),
        F.to_timestamp("m.started_at").alias("started_at"),
        F.to_timestamp("m.completed_at").alias("completed_at"),
        nz("m.pages_crawled", "m.stats.pages_crawled", "m.stats.pages_visited").alias("pages_crawled"),
        nz("m.files_downloaded", "m.stats.files_downloaded", "m.stats.total_files").alias("files_downloaded"),
        nz("m.files_found", "m.stats.files_found").alias("files_found"),
        nz("m.files_duplicate", "m.stats.files_duplicate").alias("files_duplicate"),
        nz("m.files_failed", "m.stats.files_failed").alias("files_failed"),
        F.col("key").alias("manifest_key"),
    ).where("run_id IS NOT NULL")
    fields = [c for c in rows.columns if c != "run_id"]
    own = rows.groupBy("run_id").agg(
        F.min_by(F.struct(*fields), F.struct(F.length("manifest_key"), F.col("manifest_key"))).alias("r")
    ).select("run_id", "r.*")
    known = runs.select("run_id").union(runs.select("run_pk")).distinct()
    return own.join(known, "run_id", "left_anti")


def attach_manifest_keys(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs that lack a manifest key get that of their manifest."""
    own = manifests.select(
        F.coalesce(F.get_json_object("text", "$.run_id"), FN.storage_key_parts(F.col("key"))["run_key"]).alias("run_id"),
        "key",
    ).groupBy("run_id").agg(F.min_by("key", F.struct(F.length("key"), F.col("key"))).alias("_key"))
    # only runs without a key need the join
    lacks = F.coalesce("manifest_key", F.lit("")) == ""
    found = runs.where(lacks).join(own, "run_id", "left")
    filled = found.withColumn("manifest_key", F.col("_key")).select(*runs.columns)
    return runs.where(~lacks).unionByName(filled)


def files_from_metadata(lines: DataFrame) -> DataFrame:
    """Candidate file rows from metadata lines (path key of the file, line)."""
    m = F.from_json("line", schemas.METADATA_LINE)
    folder = F.regexp_replace("key", r"/?[^/]*$", "")
    staged = lines.where("is_json").select(
        "line", m.alias("m"), folder.alias("folder"), FN.storage_key_parts(folder).alias("at")
    )
    key = F.coalesce("m.relative_path", "m.r2_key", F.concat("folder", F.lit("/"), "m.file_name"))
    name = F.coalesce("m.file_name", "m.title", urls.basename(key), F.lit("document"))
    ext = F.coalesce("m.extension", F.nullif(F.lower(urls.extension_of(name)), F.lit("")), F.lit(".json"))
    guess = F.when(ext == ".pdf", "application/pdf").when(ext == ".json", "application/json").otherwise("application/octet-stream")
    valid_id = F.when(~F.col("m.file_id").contains("UNKNOWN"), F.col("m.file_id"))
    return staged.select(
        valid_id.alias("file_id"),
        F.lower(F.coalesce("m.source_slug", "at.source_slug")).alias("source_slug"),
        F.coalesce("m.run_id", "at.run_key").alias("run_key"),
        F.coalesce("m.url", "m.source_url").alias("source_url"),
        F.coalesce("m.final_url", "m.url").alias("final_url"),
        name.alias("file_name"),
        F.coalesce("m.original_filename", name).alias("original_filename"),
        ext.alias("extension"),
        F.coalesce("m.mime_type", guess).alias("mime_type"),
        F.coalesce("m.file_size", "m.size", F.lit(0)).cast("long").alias("file_size"),
        F.nullif(F.lower("m.sha256"), F.lit("")).alias("sha256"),
        F.coalesce(key, F.concat("folder", F.lit("/"), name)).alias("storage_key"),
        F.lit("UPLOADED").alias("status"),
        F.col("line").alias("metadata"),
    )


def files_from_objects(objects: DataFrame) -> DataFrame:
    """Candidate file rows from stored objects that are not manifests or metadata."""
    ext = F.lower(urls.extension_of(F.col("key")))
    at = FN.storage_key_parts(F.col("key"))
    name = urls.basename(F.col("key"))
    text = F.when(ext == ".json", F.decode("content", "UTF-8"))
    return objects.where("kind = 'content'").select(
        F.lit(None).cast("string").alias("file_id"),
        F.lower(at["source_slug"]).alias("source_slug"),
        at["run_key"].alias("run_key"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("final_url"),
        name.alias("file_name"),
        name.alias("original_filename"),
        ext.alias("extension"),
        FN.disk_mime(ext).alias("mime_type"),
        F.col("size").cast("long").alias("file_size"),
        "sha256",
        F.col("key").alias("storage_key"),
        F.lit("UPLOADED").alias("status"),
        F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]"), text).alias("metadata"),
    )


def recover_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates the catalog does not have by hash or key, one per content.

    Repeats among the candidates go first (by hash, else by key), keeping the
    smallest key; both catalog checks are anti joins.
    """
    identity = F.coalesce("sha256", F.concat(F.lit("key:"), "storage_key"))
    columns = candidates.columns
    unique = (
        candidates.groupBy(identity.alias("_id"))
        .agg(F.min_by(F.struct(*columns), "storage_key").alias("c"))
        .select("c.*")
    )
    hashes = files.where(F.coalesce("sha256", F.lit("")) != "").select(F.lower("sha256").alias("sha256")).distinct()
    keys = files.where("storage_key IS NOT NULL").select(FN.clean_key(F.col("storage_key")).alias("storage_key")).distinct()
    return unique.join(hashes, "sha256", "left_anti").join(keys, "storage_key", "left_anti").select(*columns)


def attach_orphans(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files without a run get the run named in their storage key."""
    known = runs.select(F.lower("run_id").alias("_k"), F.col("run_pk").alias("_run")).union(
        runs.select(F.lower("run_pk"), "run_pk")
    ).groupBy("_k").agg(F.min("_run").alias("_run"))
    # only the orphans are joined; files that have a run stay where they are
    named = F.lower(FN.storage_key_parts(F.col("storage_key"))["run_key"])
    orphans = files.where("run_pk IS NULL").withColumn("_k", named).join(known, "_k", "left")
    return files.where("run_pk IS NOT NULL").unionByName(orphans.withColumn("run_pk", F.col("_run")).select(*files.columns))
