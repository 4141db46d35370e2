"""Streams over a page table that is a folder of files, as tasks write it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfscope.session import rocksdb_state
from shelfscope.streaming import first_seen

HTML = "<ul>{}</ul>"


@pytest.fixture
def sf(spark, tmp_path):
    pages = [(n, f"u{n}", HTML.format("".join(f'<li><a href="/p/{k}">x{k}</a></li>' for k in (n, n // 2)))) for n in range(8)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows.repartition(3, "page_id").write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    return str(tmp_path / "sf")


def test_unique_links_of_a_folder_of_files(spark, sf):
    out = contract.queries()["str_ingest_cards_stream"](spark, sf)
    assert sorted(r.link for r in out.collect()) == [f"/p/{k}" for k in range(8)]


def test_first_cards_of_a_folder_of_files(spark, sf):
    out = contract.queries()["str_first_cards"](spark, sf)
    first = {r.product_id: (r.page_id, r.pos) for r in out.collect()}
    assert first == {"/p/0": (0, 0), **{f"/p/{k}": (k, 0) for k in range(1, 8)}, "/p/1": (1, 0)}


def test_steps_by_bytes_and_by_files_end_alike(spark, sf, tmp_path):
    steps = {}
    for name, more in (("bytes", {"bytes_per_step": 1 << 30}), ("files", {"files_per_step": 1})):
        out = str(tmp_path / name)
        with rocksdb_state(spark):
            first_seen.ingest_first_cards(
                spark, sf, out, str(tmp_path / f"state-{name}"), rules=contract.collection.HREF_CARD, file_name="pages.parquet", **more).awaitTermination()
        rows = first_seen.snapshot(spark, out).select("link", "page_id", "pos").collect()
        taken = spark.read.parquet(out).filter(F.col("change") == first_seen.NEW).select("step").distinct().count()
        steps[name] = sorted(map(tuple, rows)), taken
    assert steps["bytes"][0] == steps["files"][0] and steps["bytes"][1] == 1 < steps["files"][1]
