import json
import os

import pytest
from pyspark.sql import functions as F

from pageloom.sources import readers, writers


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.md").write_bytes(b"# A\xff")
    (tmp_path / "sub" / "B.MDX").write_text("b")
    (tmp_path / "sub" / "deep" / "c.Markdown").write_text("c")
    (tmp_path / "d.txt").write_text("d")
    got = {r.path: r for r in readers.load_markdown_tree(spark, str(tmp_path)).collect()}
    assert {p: r.content for p, r in got.items()} == {"a.md": "# A", "sub/B.MDX": "b", "sub/deep/c.Markdown": "c"}
    assert got["a.md"].type == "markdown" and got["a.md"].depth == 0


def test_repo_items(spark):
    rows = [
        ("a.md", "file", "u1", "d1"), ("b.MDX", "file", "u2", "d2"), ("c.txt", "file", "u3", "d3"), ("d.md", "dir", "u4", "d4"),
        ("e.md", "file", "u5", None), (None, "file", "u6", "d6"), ("f.md", "file", None, "d7"), ("z.md", "file", "u1", "d8"), ("g.md", None, "u9", "d9"),
    ]
    df = spark.createDataFrame(rows, "path string, type string, html_url string, download_url string")
    got = readers.select_repo_items(df).orderBy("html_url").collect()
    assert [(r.html_url, r.path, r.download_url) for r in got] == [("u1", "a.md", "d1"), ("u2", "b.MDX", "d2")]


def test_html_only(spark):
    rows = [("a", "Text/HTML; charset=x", bytearray(b"<p>\xff")), ("b", "image/png", bytearray(b"x")), ("c", None, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "url string, content_type string, body binary")
    assert {r.url: r.html for r in readers.html_only(df).collect()} == {"a": "<p>", "b": None, "c": None}


def test_raw_pages(spark, tmp_path):
    rows = [("http://a.com/x", "<p>é", "html", "/x"), ("https://github.com/o/r/y.md", "# y", "markdown", "docs/y.md")]
    corpus = spark.createDataFrame(rows, "url string, content string, type string, path string")
    writers.write_raw(corpus, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    names = sorted(r.raw_file for r in table.collect())
    assert names[0].startswith("raw_a_com_x_") and names[1].startswith("raw_github_com_docs_y.md_") and names[1].endswith(".md")
    writers.write_raw(corpus, str(tmp_path / "files"), file_per_page=True)
    assert sorted(os.listdir(tmp_path / "files")) == names
    assert (tmp_path / "files" / names[0]).read_text("utf-8") == "<p>é"


def documents(spark):
    rows = [("Topic A", "a.com", "http://a.com/", "Body é\nline"), ("Topic B", "b.com", "http://b.com/", "Other")]
    return spark.createDataFrame(rows, "topic string, domain string, source_url string, body string")


def test_documents_are_written_read_and_compiled(spark, tmp_path):
    out = tmp_path / "out"
    writers.write_documents(documents(spark), str(out), "2025-01-01 00:00:00")
    assert sorted(os.listdir(out)) == ["topic_a_a.com.txt", "topic_b_b.com.txt"]
    lines = (out / "topic_a_a.com.txt").read_text("utf-8").split("\n")
    assert lines[0] == "Documentation for: Topic A (a.com)" and lines[7] == "=" * 80 and lines[8:] == ["", "Body é", "line"]
    assert lines[6] == "Content Filter Settings: Semantic Similarity=0.30" and len(lines[:7]) == 7

    (out / "sub").mkdir()
    (out / "sub" / "no.txt").write_text("no")
    (out / "no.json").write_text("no")
    (out / "bad.txt").write_bytes(b"ok\xff!")
    read = readers.read_documents(spark, str(out))
    assert {r.file_name: r.text for r in read.collect()}["bad.txt"] == "ok!" and read.count() == 3

    writers.write_compiled(read, str(tmp_path / "compiled"), "NOW", "/src")
    parts = sorted(p for p in os.listdir(tmp_path / "compiled") if p.startswith("part-"))
    whole = "".join((tmp_path / "compiled" / p).read_text("utf-8") for p in parts)
    rule = "=" * 80
    expected = "=== Compilation Generated: NOW ===\n=== Source Directory: /src ===\n\n"
    for name in ("bad.txt", "topic_a_a.com.txt", "topic_b_b.com.txt"):
        text = "ok!" if name == "bad.txt" else (out / name).read_text("utf-8")
        expected += f"{rule}\n\U0001f4c4 Source File: {name}\n{rule}\n\n{text}\n\n"
    assert whole == expected + f"{rule}\n✅ End of Compilation\n{rule}\n"


def test_documents_of_one_name_are_kept_apart(spark, tmp_path):
    rows = [("T", "a.com", f"http://a.com/{i}", f"body {i}") for i in range(3)] + [("U", "a.com", "http://a.com/", "body")]
    docs = spark.createDataFrame(rows, "topic string, domain string, source_url string, body string")
    writers.write_documents(docs, str(tmp_path / "out"), "NOW")
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 4 and "u_a.com.txt" in names and all(n.endswith(".txt") for n in names)
    assert sum(n.startswith("t_a.com_") for n in names) == 3


def test_nothing_to_compile(spark, tmp_path):
    none = spark.createDataFrame([], "file_name string, text string")
    assert writers.compile_documents(none, "NOW", "/src").count() == 0
    writers.write_compiled(none, str(tmp_path / "compiled"), "NOW", "/src")
    assert not (tmp_path / "compiled").exists()


def test_unreadable_file_leaves_a_line(spark):
    df = spark.createDataFrame([("a.txt", None)], "file_name string, text string")
    texts = [r.text for r in writers.compile_documents(df, "NOW", "/src").filter("part_no = 1").collect()]
    assert texts == ["[Compiler Error: Could not read file 'a.txt']\n"]


def test_ratings(spark, tmp_path):
    rows = [("T", "d.com", None, "gut ü", "keine", "raw")]
    df = spark.createDataFrame(
        rows, "topic string, domain string, rating_score int, rating_justification string, rating_suggestions string, raw_rating_output string"
    )
    writers.write_ratings(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).first().rating_justification == "gut ü"
    writers.write_ratings(df, str(tmp_path / "files"), file_per_document=True)
    text = (tmp_path / "files" / "t_d.com_quality_assessment.json").read_text("utf-8")
    assert json.loads(text)["rating_score"] is None and "ü" in text


def test_small_tables_use_all_cores(spark, sf):
    df = readers.read_table(spark, f"{sf}/documents.parquet")
    assert df.select(F.spark_partition_id()).distinct().count() == 8


def test_no_file_is_overwritten(spark, tmp_path):
    rows = [("T", "a.com", "https://a.com/", f"body {i}") for i in range(3)] + [("T", "a.com", "https://a.com/x", "body")]
    docs = spark.createDataFrame(rows, "topic string, domain string, source_url string, body string")
    writers.write_documents(docs, str(tmp_path / "docs"), "NOW")
    assert len(list((tmp_path / "docs").glob("*.txt"))) == 4
    rated = spark.createDataFrame(
        [("T", "a.com", i, "j", "s", "r") for i in range(3)],
        "topic string, domain string, rating_score int, rating_justification string, rating_suggestions string, raw_rating_output string",
    )
    writers.write_ratings(rated, str(tmp_path / "rated"), file_per_document=True)
    assert len(list((tmp_path / "rated").glob("*.json"))) == 3


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    """A task that fails on the way leaves no part of a file, under no name, and no manifest; the next run completes all."""
    rows = spark.createDataFrame([(f"{i}.txt", "x" * 1000 * i) for i in range(6)], "name string, text string").coalesce(1)
    bad = rows.withColumn("text", F.when(F.col("name") == "4.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        writers.write_files(bad, str(out), "name", "text")
    assert not os.path.exists(tmp_path / "out_manifest" / "_SUCCESS")
    left = os.listdir(out) if out.exists() else []
    assert all(not n.startswith(".") and len((out / n).read_text()) == 1000 * int(n[0]) for n in left)
    listed = writers.write_files(rows, str(out), "name", "text")
    assert {(r.file_name, r.n_bytes) for r in listed.collect()} == {(f"{i}.txt", 1000 * i) for i in range(6)}
    assert sorted(os.listdir(out)) == [f"{i}.txt" for i in range(6)]


def test_a_file_that_fails_while_written_is_removed(spark, tmp_path):
    def run(rows):
        from pyarrow import fs as stores

        store, root = stores.FileSystem.from_uri(str(tmp_path))
        try:
            with writers._Committed(store, root, "half.txt") as out:
                out.write(b"first half")
                raise OSError("gone")
        except OSError:
            pass
        yield from rows

    spark.range(1).coalesce(1).mapInArrow(run, "id bigint").collect()
    assert os.listdir(tmp_path) == []


def test_compiled_parts_are_listed_with_their_places(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i:03d}.txt", f"text {i} ü" * (i % 7)) for i in range(200)], "file_name string, text string")
    target = tmp_path / "compiled"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with texts enough for several tasks
    try:
        for _ in range(2):
            listed = writers.write_compiled(docs, str(target), "NOW", "/src").orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = writers.compile_documents(docs, "NOW", "/src").orderBy("section", "file_name", "part_no").collect()
    whole = "".join(r.text + "\n" for r in rows).encode()
    assert len(listed) > 1 and sorted(os.listdir(target)) == [r.file_name for r in listed]
    assert sum(r.n_bytes for r in listed) == len(whole)
    for r in listed:
        assert (target / r.file_name).read_bytes() == whole[r.first_byte : r.first_byte + r.n_bytes]
