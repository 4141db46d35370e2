import pytest
from pyspark.sql import functions as F

from shelfscope.operators import bins, filters, ordering, quantiles, stats, styles
from shelfscope.plans import reports

PRODUCTS = [
    ("001", "A", "플로럴 꽃 원피스", 30000.0, 0.0), ("1", "A", "체크 셔츠", 30001.0, 10.0),
    ("2", "B", "ÉCLAT 데님", 200000.0, 30.0), ("3", "B", "청바지", 200001.0, 31.0),
    ("4", None, None, None, None), ("5", "NA", "베이지", 0.0, 100.0), ("6", "C", "블랙", -1.0, 50.0),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        PRODUCTS, "product_id string, brand string, name string, price double, discount_pct double")


def ids(df):
    return [r.product_id for r in df.collect()]


def test_search_is_case_insensitive_beyond_ascii(products):
    assert ids(filters.search_keyword(products, "éclat")) == ["2"]
    assert ids(filters.search_keyword(products, "^b$")) == ["2", "3"]
    assert ids(filters.search_keyword(products.drop("name", "brand"), "a")) == []


def test_lowest_filter_band_holds_zero_but_report_band_does_not(products):
    assert sorted(ids(filters.price_band_filter(products, "~3만원"))) == ["001", "5", "6"]
    counts = {r.band: r.n for r in bins.price_bands(products).collect()}
    assert counts == {"~3만원": 1, "3-5만원": 1, "5-10만원": 0, "10-20만원": 1, "20만원~": 1}


def test_discount_bands(products):
    counts = {r.band: r.n for r in bins.discount_bands(products).collect()}
    assert counts == {"0-10%": 1, "10-20%": 0, "20-30%": 1, "30-40%": 1, "40-50%": 1, "50% 이상": 1}


def test_discount_filters(products):
    assert "4" not in ids(filters.min_discount_filter(products, 0))
    assert filters.high_discount_count(products).first().n == 3
    assert filters.brand_in_filter(products, [], empty_keeps_all=False).count() == 0
    assert filters.brand_in_filter(products, []).count() == len(PRODUCTS)


@pytest.mark.parametrize("by", ["price_asc", "price_desc", "discount_desc", "brand"])
def test_missing_values_sort_last(products, by):
    assert ids(ordering.sort_products(products, by, ["product_id"]))[-1] == "4"


def test_pages_make_up_the_whole_sort(products):
    order = ordering.sort_order("price_asc", ["product_id"])
    whole = ids(ordering.sort_products(products, "price_asc", ["product_id"]))
    pages = [i for n in (1, 2, 3) for i in ids(ordering.page(products, n, order, 3))]
    assert pages == whole
    assert ordering.page_count(products, 3).first().pages == 3


def test_pages_are_slices_of_the_numbered_rows(products):
    order = ordering.sort_order("price_asc", ["product_id"])
    rows = ordering.numbered(products.repartition(3), order)
    assert sorted(r.row_no for r in rows.collect()) == list(range(1, products.count() + 1))
    for n in (1, 2, 4):
        of_page = rows.filter(F.col("row_no").between(2 * n - 1, 2 * n)).orderBy("row_no")
        assert ids(ordering.page(products, n, order, 2)) == ids(of_page)


def test_group_cut_is_the_same_with_and_without_salt(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("g"), F.col("id").alias("k"))
    few = ordering.first_n_per_group(rows, ["g"], ["k"], 40, few_groups=True)
    got = {(r.g, r.k) for r in ordering.first_n_per_group(rows, ["g"], ["k"], 40).collect()}
    assert got == {(r.g, r.k) for r in few.collect()}
    want = {}
    for r in rows.orderBy("k").collect():
        want.setdefault(r.g, []).append(r.k)
    assert got == {(g, k) for g, ks in want.items() for k in ks[:40]}


def test_top_discount_fills_with_missing(products):
    assert ids(ordering.top_discount(products, ["product_id"], 7))[-1] == "4"


def test_equal_prices(spark):
    same = spark.createDataFrame([(5.0, 10.0)] * 3, "price double, discount_pct double")
    assert [(r.bin, r.n) for r in bins.histogram(same, "price", 30).collect()] == [(1, 3)]
    assert [r.value_score for r in styles.value_score(same).collect()] == [None] * 3


def test_styles(products):
    assert {r.category: r.n for r in styles.style_counts(products).collect()} == {
        "플로럴": 2, "체크": 1, "데님": 2}
    full = {r.category: r.n for r in styles.style_counts_full(products).collect()}
    assert full["레이스"] == 0 and full["셔츠"] == 1


def test_exact_quantiles(spark):
    import pandas as pd

    values = [((i * 7919) % 1009) ** 3 / 7.0 - 50 for i in range(2000)] + [3.0] * 1500 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.p: r.value for r in quantiles.exact_quantiles(quantiles.cells_of(df, ["v"]), probabilities).collect()}
    want = pd.Series(values).dropna().quantile(probabilities)
    assert got == pytest.approx(want.to_dict(), rel=1e-12)


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "brand string, price double, discount_pct double")
    row = stats.price_stats(empty).first()
    assert (row.slider_min, row.slider_max) == (0, 1000000)
    assert stats.price_positioning(empty).first().median_price is None


def test_catalogue_report_runs(products):
    query = reports.CatalogueQuery(key=["product_id"], sort="할인율 높은순")
    for name, table in reports.catalogue_report(products, query).items():
        assert table.collect() is not None, name


def test_batch_search_tags_each_term(products):
    found = filters.batch_keyword_search(products, ["A", " 셔츠 ", "", "A"])
    assert sorted((r.search_term, r.product_id) for r in found.collect()) == [
        ("A", "001"), ("A", "1"), ("A", "2"), ("A", "5"), ("셔츠", "1")]


def test_price_filter_reaches_the_scan(spark, tmp_path, products):
    products.write.parquet(str(tmp_path / "p"))
    found = filters.price_range_filter(spark.read.parquet(str(tmp_path / "p")), 10, 20).select("product_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(price,10.0)" in plan and "ReadSchema: struct<product_id:string,price:double>" in plan
