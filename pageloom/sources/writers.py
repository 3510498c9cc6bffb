"""Writing raw pages, documents, ratings and the compiled text."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import document_file_name, raw_file_name
from pageloom.operators.storage import materialize
from pageloom.settings import Settings

# The rule between parts, and the lines of the compiled text.
RULE = "=" * 80
COMPILED_HEAD = "=== Compilation Generated: "
COMPILED_SOURCE = "=== Source Directory: "
COMPILED_FILE = "\U0001f4c4 Source File: "
COMPILED_END = "✅ End of Compilation"


def manifest_dir(directory: str) -> str:
    """Where the list of a directory's files lies: beside it, so that it is none of them."""
    return directory.rstrip("/") + "_manifest"


def _store(directory: str) -> tuple[fs.FileSystem, str]:
    filesystem, root = fs.FileSystem.from_uri(directory)
    filesystem.create_dir(root, recursive=True)
    return filesystem, root


class _Committed:
    """A file that has its name only once it is whole: written under its attempt's name, renamed at the end, removed if writing fails."""

    def __init__(self, filesystem: fs.FileSystem, root: str, name: str):
        self._fs, self._path = filesystem, f"{root}/{name}"
        self._part = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"

    def __enter__(self):
        self._out = self._fs.open_output_stream(self._part)
        return self._out

    def __exit__(self, kind, value, trace):
        self._out.close()
        if kind is None:
            self._fs.move(self._part, self._path)
        else:
            self._fs.delete_file(self._part)


def write_files(df: DataFrame, directory: str, name: str, text: str) -> DataFrame:
    """One file per row in a directory that all executors reach (local, S3, HDFS, GCS); rows without a text have none.

    A file appears whole or not at all, and a repeated task writes the same files
    again. The files written, file_name and n_bytes, are listed in a Parquet table
    beside the directory (see manifest_dir), which appears once all are there; it is returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _store(directory)
        for batch in batches:
            names, sizes = [], []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "ignore")
                with _Committed(filesystem, root, row["name"]) as out:
                    out.write(data)
                names.append(row["name"])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file_name", "n_bytes"])

    rows = df.select(F.col(name).alias("name"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return _listed(rows.mapInArrow(write, "file_name string, n_bytes bigint"), directory)


def _listed(written: DataFrame, directory: str) -> DataFrame:
    written.write.mode("overwrite").parquet(manifest_dir(directory))
    return written.sparkSession.read.schema(written.schema).parquet(manifest_dir(directory))


def with_raw_names(corpus: DataFrame) -> DataFrame:
    """corpus with raw_file; Markdown is named after its path in the repository."""
    repo_path = F.when(F.col("type") == "markdown", F.col("path"))
    return corpus.withColumn("raw_file", raw_file_name(F.col("url"), repo_path))


def write_raw(corpus: DataFrame, directory: str, file_per_page: bool = False) -> None:
    """The kept pages with a raw_file column as Parquet, or as one file each."""
    named = with_raw_names(corpus)
    if file_per_page:
        write_files(named, directory, "raw_file", "content")
    else:
        named.write.mode("overwrite").parquet(directory)


def document_text(body: Column, topic: Column, domain: Column, source_url: Column, generated_at: Column,
                  settings: Settings = Settings(), filtered: bool = True) -> Column:
    """A document with its seven header lines."""
    threshold = f"{settings.relevance_threshold:.2f}" if filtered and settings.relevance_threshold <= 1 else "Disabled"
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Documentation for: "), topic, F.lit(" ("), domain, F.lit(")")),
        F.concat(F.lit("Generated: "), generated_at),
        F.concat(F.lit("Source URL: "), source_url),
        F.lit(f"Max Depth: {settings.max_depth}"),
        F.lit(f"Extraction Model: {settings.extraction_model}"),
        F.lit(f"Consolidation Model: {settings.merge_model}"),
        F.lit(f"Content Filter Settings: Semantic Similarity={threshold}"),
        F.lit(RULE),
    )
    return F.concat(head, F.lit("\n\n"), body)


def with_document_files(docs: DataFrame, generated_at: str, settings: Settings = Settings()) -> DataFrame:
    """docs(topic, domain, source_url, body) with file_name and the whole file's text."""
    return docs.withColumn("file_name", document_file_name(F.col("topic"), F.col("domain"))).withColumn(
        "text",
        document_text(
            F.col("body"), F.col("topic"), F.col("domain"), F.col("source_url"), F.lit(generated_at), settings
        ),
    )


def _marked(docs: DataFrame, mark: Column) -> DataFrame:
    """docs(file_name, …); a name that several rows share gets a mark before its ending."""
    shared = docs.groupBy("file_name").agg((F.count(F.lit(1)) > 1).alias("_shared")).filter("_shared")
    own = F.concat(
        F.regexp_extract("file_name", r"^(.*?)(?:\.[a-z]+)?$", 1), F.lit("_"), F.substring(F.sha1(F.encode(mark, "UTF-8")), 1, 8),
        F.regexp_extract("file_name", r"(\.[a-z]+)?$", 1),
    )
    joined = docs.join(shared, "file_name", "left")
    return joined.withColumn("file_name", F.when(F.col("_shared"), own).otherwise(F.col("file_name"))).drop("_shared")


def with_own_names(docs: DataFrame) -> DataFrame:
    """docs(file_name, source_url, …); a name that several documents share gets a mark of the source, and one of the whole row if they share that too.

    Only rows that are equal in every column keep one name, and so one file.
    """
    return _marked(_marked(docs, F.col("source_url")), F.to_json(F.struct(*docs.columns)))


def write_documents(docs: DataFrame, directory: str, generated_at: str, settings: Settings = Settings()) -> None:
    """One text file per document, each under a name of its own."""
    write_files(with_own_names(with_document_files(docs, generated_at, settings)), directory, "file_name", "text")


def write_ratings(ratings: DataFrame, directory: str, file_per_document: bool = False) -> None:
    """Ratings(topic, domain, rating_…) as JSON lines, or as one JSON file per document."""
    fields = ["rating_score", "rating_justification", "rating_suggestions", "raw_rating_output"]
    if file_per_document:
        named = ratings.select(
            document_file_name(F.col("topic"), F.col("domain"), "_quality_assessment.json").alias("file_name"),
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "true"}).alias("text"),
        )
        named = _marked(named, F.col("text"))
        write_files(named, directory, "file_name", "text")
    else:
        ratings.write.mode("overwrite").option("ignoreNullFields", "false").json(directory)


def compile_documents(docs: DataFrame, generated_at: str, source_dir: str) -> DataFrame:
    """The compiled text of documents(file_name, text) as rows (section, file_name, part_no, text).

    In the order of the first three columns, each text followed by a newline,
    they are the compiled file: a header, then every document by name, then a
    footer; no row at all if there is no document. A null text becomes an error
    line.
    """
    part = F.explode(
        F.array(
            F.struct(
                F.lit(0).alias("part_no"),
                F.concat(F.lit(f"{RULE}\n{COMPILED_FILE}"), F.col("file_name"), F.lit(f"\n{RULE}\n")).alias("text"),
            ),
            F.struct(
                F.lit(1).alias("part_no"),
                F.when(F.col("text").isNotNull(), F.concat("text", F.lit("\n")))
                .otherwise(F.concat(F.lit("[Compiler Error: Could not read file '"), F.col("file_name"), F.lit("']\n")))
                .alias("text"),
            ),
        )
    ).alias("_part")
    bodies = docs.select(F.lit(1).alias("section"), "file_name", part).select("section", "file_name", "_part.*")
    head = f"{COMPILED_HEAD}{generated_at} ===\n{COMPILED_SOURCE}{source_dir} ===\n"
    foot = f"{RULE}\n{COMPILED_END}\n{RULE}"
    frame = F.explode(
        F.array(
            F.struct(F.lit(0).alias("section"), F.lit(head).alias("text")),
            F.struct(F.lit(2).alias("section"), F.lit(foot).alias("text")),
        )
    ).alias("_frame")
    ends = docs.limit(1).select(frame).select(
        "_frame.section", F.lit("").alias("file_name"), F.lit(0).alias("part_no"), "_frame.text"
    )
    return bodies.unionByName(ends)


def write_compiled(docs: DataFrame, directory: str, generated_at: str, source_dir: str) -> DataFrame | None:
    """The compiled text as part files that follow one another in name order; nothing without documents.

    The rows are dealt out by ranges of their order and each task writes its range
    as one part, whole or not at all. The manifest beside the directory lists part,
    file_name, first_byte and n_bytes, so that any piece of the text can be
    read, or the parts be put together, without reading those before. Parts of an earlier
    run are removed first.
    """
    if docs.isEmpty():
        return None
    spark = docs.sparkSession
    order = ["section", "file_name", "part_no"]
    rows = compile_documents(docs, generated_at, source_dir).repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for batch in batches for t in batch.column(0).to_pylist())
        first = next(texts, None)
        if first is None:
            return
        filesystem, root = _store(directory)
        part, size = TaskContext.get().partitionId(), 0
        name = f"part-{part:05d}.txt"
        with _Committed(filesystem, root, name) as out:
            for text in itertools.chain([first], texts):
                data = f"{text}\n".encode("utf-8", "ignore")
                out.write(data)
                size += len(data)
        yield pa.RecordBatch.from_pylist([{"part": part, "file_name": name, "n_bytes": size}], schema=listed)

    listed = pa.schema([("part", pa.int32()), ("file_name", pa.string()), ("n_bytes", pa.int64())])
    filesystem, root = _store(directory)
    filesystem.delete_dir_contents(root)
    written = materialize(rows.select("text").mapInArrow(write, "part int, file_name string, n_bytes bigint"))
    # One row for each part: as many as shuffle partitions at most.
    offsets, at = [], 0
    for r in sorted(written.collect()):
        offsets.append((r["part"], r["file_name"], at, r["n_bytes"]))
        at += r["n_bytes"]
    return _listed(spark.createDataFrame(offsets, "part int, file_name string, first_byte bigint, n_bytes bigint").coalesce(1), directory)
