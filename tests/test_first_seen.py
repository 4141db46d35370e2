"""The stream of first cards: equal to de-duplicating all pages, whatever the file order, and after a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.operators.collection import dedup_by_link
from shelfscope.session import rocksdb_state
from shelfscope.sources import pages as pg
from shelfscope.streaming import first_seen

HOST = "https://shop.example"
SCHEMA = "page_id bigint, url string, html string, collected_at timestamp"
START = datetime.datetime(2024, 1, 1)


def page(n, *numbers, day=None):
    cards = "".join(f'<a class="{fv.CARD_CLASS}" href="/p/{k}" data-item-id="{n}-{k}"></a>' for k in numbers)
    return n, f"u{n}", cards, START + datetime.timedelta(days=n if day is None else day)


@pytest.fixture
def put(spark, tmp_path):
    def write(name, *pages):
        staged = tmp_path / "staged" / name
        spark.createDataFrame(list(pages), SCHEMA).coalesce(1).write.parquet(str(staged))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(next(staged.glob("part-*.parquet")).read_bytes())

    return write


def run(spark, tmp_path, out="out", **more):
    with rocksdb_state(spark):
        query = first_seen.ingest_first_cards(
            spark, str(tmp_path / "in"), str(tmp_path / out), str(tmp_path / f"state-{out}"), host=HOST, schema=SCHEMA, **more)
        query.awaitTermination()
    return str(tmp_path / out)


def rows(df):
    return sorted(map(tuple, df.select("link", "page_id", "pos", "product_id", "url").collect()))


def first_of(spark, tmp_path):
    cards = pg.extract_product_cards(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")))
    return rows(dedup_by_link(cards, ["page_id", "pos"], HOST))


def test_snapshots_equal_the_batch_in_any_file_order_and_after_a_restart(spark, tmp_path, put):
    put("a", page(3, 1, 2, 1), page(4, 5))
    put("b", page(1, 2, 7), page(2, 7, 1))
    out = run(spark, tmp_path, delay="30 days")
    assert rows(first_seen.snapshot(spark, out)) == first_of(spark, tmp_path)
    put("c", page(0, 5, 9), page(5, 1))
    assert run(spark, tmp_path, delay="30 days") == out
    assert rows(first_seen.snapshot(spark, out)) == first_of(spark, tmp_path)
    assert run(spark, tmp_path, delay="30 days") == out and rows(first_seen.snapshot(spark, out)) == first_of(spark, tmp_path)
    changes = spark.read.parquet(out)
    assert changes.filter(F.col("change") == first_seen.NEW).select("link").distinct().count() == changes.filter(F.col("change") == first_seen.NEW).count() == 5
    # The snapshot after the first step is what its file holds.
    first = rows(first_seen.snapshot(spark, out, step=0))
    assert len(first) in (3, 2) and set(r[0] for r in first) <= set(r[0] for r in first_of(spark, tmp_path))


def test_links_settle_when_the_watermark_passes_and_are_forgotten(spark, tmp_path, put):
    put("a", page(1, 1, 2))
    run(spark, tmp_path, delay="2 days", horizon_days=5)
    put("b", page(4, 3))
    out = run(spark, tmp_path, delay="2 days", horizon_days=5)
    put("c", page(6, 4))
    run(spark, tmp_path, delay="2 days", horizon_days=5)
    done = {r.link[-1]: r.page_id for r in first_seen.settled(spark, out).collect()}
    assert done["1"] == done["2"] == 1 and "4" not in done
    # A settled link is not taken again, until it is forgotten.
    put("d", page(7, 1))
    run(spark, tmp_path, delay="2 days", horizon_days=5)
    assert spark.read.parquet(out).filter(F.col("link").endswith("/1") & (F.col("change") == first_seen.NEW)).count() == 1
    put("e", page(30, 8))
    run(spark, tmp_path, delay="2 days", horizon_days=5)
    put("f", page(31, 1))
    run(spark, tmp_path, delay="2 days", horizon_days=5)
    assert spark.read.parquet(out).filter(F.col("link").endswith("/1") & (F.col("change") == first_seen.NEW)).count() == 2


def test_collection_stops_when_steps_bring_nothing_new(spark, tmp_path, put):
    for k in range(9):
        put(f"f{k}", page(k, *((k, k + 1) if k < 3 else (1, 2))))
    out = run(spark, tmp_path, quiet_steps=1, at_least=3, delay="100 days")
    steps = {r.step for r in spark.read.parquet(out).select("step").distinct().collect()}
    assert len([1 for r in first_seen.snapshot(spark, out).collect()]) == 4 and max(steps) < 8
    whole = run(spark, tmp_path, out="whole", delay="100 days")
    assert rows(first_seen.snapshot(spark, whole)) == first_of(spark, tmp_path)
