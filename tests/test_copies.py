"""Copies of a library that fail half-way, and hashes of files that fit no row."""

import hashlib
import tracemalloc

import pandas as pd
import pytest

from scholia.sources import library_copy as C
from scholia.sources import tables as T


@pytest.fixture
def library(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    for name in ("a.pdf", "b.md", "c.html"):
        (source / name).write_bytes(name.encode() * 1000)
    body = b"%PDF material"
    sha = hashlib.sha256(body).hexdigest()
    (source / f"{sha[:16]}.pdf").write_bytes(body)
    documents = spark.createDataFrame([("d1", "k", "a.pdf", "b.md", None, ""), ("d2", "k", "a.pdf", None, None, "c.html")], "id string, course_id string, pdf_path string, md_path string, doc_path string, html_path string")
    materials = spark.createDataFrame([("m1", "k", sha), ("m2", "j", sha)], "id string, course_id string, sha string")
    courses = spark.createDataFrame([("k", "Course")], "id string, name string")
    files = spark.createDataFrame([(p.name, p.stat().st_size) for p in source.iterdir()], "name string, size long")
    return {"documents": documents, "materials": materials, "courses": courses}, files, source


def uri(path):
    return f"file://{path}"


def test_a_copy_has_new_keys_and_all_files(spark, tmp_path, library):
    tables, files, source = library
    target = uri(tmp_path / "target")
    report = {r["fact"]: r["value"] for r in C.copy_library(tables, files, uri(source), target, "copy1", 10**6).collect()}
    assert report == {"files": 5.0, "missing": 0.0, "oversized": 0.0, "megabytes": pytest.approx(0.020013), "clashes": 0.0} and C.read_copy(spark, target) == {}
    C.copy_library(tables, files, uri(source), target, "copy1", 10**6, apply=True)
    copied = C.read_copy(spark, target)
    rows = {r["id"]: r for r in copied["documents"].collect()}
    assert rows["d1"]["pdf_path"] != rows["d2"]["pdf_path"] and rows["d1"]["doc_path"] is None and rows["d1"]["html_path"] == "" and copied["courses"].count() == 1
    for r in rows.values():
        for column, name in (("pdf_path", "a.pdf"), ("md_path", "b.md"), ("html_path", "c.html")):
            if r[column]:
                assert r[column].startswith(f"documents/{r['id']}/") and (tmp_path / "target" / "files" / r[column]).read_bytes() == (source / name).read_bytes()
    with pytest.raises(ValueError, match="has a library"):
        C.copy_library(tables, files, uri(source), target, "copy2", 10**6, apply=True)
    assert C.current_copy(spark, target) == "copy1"


def test_a_copy_that_fails_leaves_the_target_empty(spark, tmp_path, library):
    tables, files, source = library
    target = uri(tmp_path / "target")
    with pytest.raises(ValueError, match="can't be copied"):
        C.copy_library(tables, files.where("name != 'b.md'"), uri(source), target, "c", 10**6, apply=True)
    with pytest.raises(ValueError, match="can't be copied"):
        C.copy_library(tables, files, uri(source), target, "c", 10, apply=True)
    broken = dict(tables, zz=tables["courses"].selectExpr("raise_error('half-way') as x"))
    with pytest.raises(Exception, match="half-way"):
        C.copy_library(broken, files, uri(source), target, "c", 10**6, apply=True)
    assert (tmp_path / "target" / "copies" / "c" / "documents").exists() and C.current_copy(spark, target) is None and C.read_copy(spark, target) == {}
    C.copy_library(tables, files, uri(source), target, "c", 10**6, apply=True)
    assert set(C.read_copy(spark, target)) == set(tables)


def test_a_material_with_other_contents_stops_the_copy(spark, tmp_path, library):
    tables, files, source = library
    next(p for p in source.iterdir() if len(p.stem) == 16).write_bytes(b"%PDF otherwise")
    with pytest.raises(ValueError, match="other contents"):
        C.copy_library(tables, files, uri(source), uri(tmp_path / "t"), "c", 10**6, apply=True)
    assert C.current_copy(spark, uri(tmp_path / "t")) is None


def test_hashes_of_small_and_streamed_files(spark, tmp_path):
    for name, size in (("small.pdf", 100), ("large one.pdf", 300_000), ("ünï.pdf", 200_001)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    got = {r["name"]: (r["size"], r["sha"]) for r in T.read_blobs(spark, str(tmp_path), stream_from=1000, block=4096).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}


def test_a_streamed_hash_holds_a_block(tmp_path):
    path = tmp_path / "big"
    with open(path, "wb") as f:
        f.truncate(96 << 20)
    tracemalloc.start()
    out = list(T._hashed(iter([pd.DataFrame({"path": [str(path)], "length": [96 << 20]})]), 1 << 20))[0]["sha"][0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == hashlib.sha256(bytes(96 << 20)).hexdigest() and peak < 16 << 20
