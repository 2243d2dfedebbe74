import hashlib
import os

import pytest
from pyspark.sql import functions as F

from leaseloom.sources import grids


@pytest.fixture
def books(tmp_path):
    """Files as they come, among them one with blanks and signs in its name, and a lock file."""
    content = {"rr_199201.xlsx": os.urandom(300_000), "rr 50%_#1.xlsx": b"PK\r\n\x00\n" * 100, "av_199201.xlsx": b"\xef\xbb\xbf\xff", "~$rr_199201.xlsx": b"lock", "notes.txt": b"none"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in content.items() if n.endswith(".xlsx") and not n.startswith("~$")}


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    names = []

    def put(name, value):
        names.append(name)
        spark.conf.set(name, value)

    yield put
    for name in names:
        spark.conf.unset(name)


def test_files_beyond_what_a_row_may_hold_are_hashed_whole(spark, books, settings):
    """The binary reader refuses a content above this limit, 2 GiB at most."""
    folder, known = books
    settings("spark.sql.sources.binaryFile.maxLength", "2")
    found = grids.file_inventory(spark, {"rent_roll": str(folder)})
    assert {r.file_name: (r.sha256, r.byte_size) for r in found.collect()} == known
    assert {(r.dataset, r.file_path) for r in found.collect()} == {("rent_roll", f"file:{folder}/{n}") for n in known}


def test_unchanged_files_beyond_that_limit_are_skipped(spark, books, settings):
    folder, known = books
    settings("spark.sql.sources.binaryFile.maxLength", "2")
    found = grids.file_inventory(spark, {"rent_roll": str(folder)})
    manifest = found.filter(F.col("file_name").startswith("rr")).withColumn(
        "sha256", F.when(F.col("file_name") == "rr_199201.xlsx", F.reverse("sha256")).otherwise(F.col("sha256"))).select("dataset", "file_name", "sha256")
    assert {r.file_name for r in grids.skip_unchanged(found, manifest).collect()} == {"rr_199201.xlsx", "av_199201.xlsx"}


def test_no_content_is_held_in_a_row(spark, books):
    folder, _ = books
    plan = grids.file_inventory(spark, {"rent_roll": str(folder)})._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan and "content:" not in plan


def test_files_of_a_store_the_session_names(spark, books, settings):
    """Tasks open files with the settings of the session."""
    folder, known = books
    settings("fs.viewfs.mounttable.reports.link./books", f"file://{folder}")
    found = grids.file_inventory(spark, {"rent_roll": "viewfs://reports/books"})
    assert {r.file_name: (r.sha256, r.byte_size) for r in found.collect()} == known
