import pytest

from shelfscope.lexicon import AGE, FACTOR, POSITION
from shelfscope.operators import brands
from shelfscope.plans import reports

REVIEWS = [
    (1, "p1", "A", "고급 고급 소재 심플 깔끔 예쁘", 1, "Y", 3.0),
    (2, "p1", "A", "대학 데이트 학생 예쁘 가격 품질", 2, "N", None),
    (3, "p2", "B", "아무 말", 1, "N", 1.0),
    (4, "p3", None, "고급", 1, "N", 1.0),
    (5, "p4", "C", "작아 실망 작은 꽉", 1, None, None),
]
PRODUCTS = [("A", 100.0, 10.0), ("A", 300.0, None), ("B", None, None), ("D", 5.0, 5.0)]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(
        REVIEWS, "review_id int, product_id string, brand string, text string, page_number int, "
        "has_image string, helpful_count double")


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, "brand string, price double, discount_pct double")


def test_positioning_counts_occurrences(reviews):
    text = " ".join(r[3] for r in REVIEWS if r[2] == "A")
    want = {c: sum(text.count(k) for k in ks) for c, ks in POSITION.categories}
    rows = [r for r in brands.positioning(reviews).collect() if r.brand == "A"]
    assert {r.position: r.score for r in rows} == want
    assert abs(sum(r.pct for r in rows) - 100) < 1e-9
    order = sorted(POSITION.names, key=lambda c: (-want[c], POSITION.names.index(c)))
    assert [r.position for r in sorted(rows, key=lambda r: r.rn)] == order


def test_all_zero_brand_takes_lexicon_order(reviews):
    rows = [r for r in brands.positioning(reviews).collect() if r.brand == "B"]
    assert len(rows) == len(POSITION.names) and {r.pct for r in rows} == {0.0}
    assert [r.position for r in rows if r.rn == 1] == [POSITION.names[0]]
    assert [r.group for r in brands.target_scores(reviews).collect() if r.brand == "B" and r.rn == 1] == [AGE.names[0]]


def test_factors_count_reviews(reviews):
    rows = {r.factor: (r.reviews, r.pct) for r in brands.purchase_factors(reviews).collect() if r.brand == "A"}
    want = {c: sum(any(k in r[3] for k in ks) for r in REVIEWS if r[2] == "A") for c, ks in FACTOR.categories}
    assert rows == {c: (n, n * 50.0) for c, n in want.items() if n}
    assert not [r for r in brands.purchase_factors(reviews).collect() if r.brand == "B"]


def test_basic_stats(reviews, products):
    rows = {r.brand: r for r in brands.brand_basic_stats(reviews, products).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].products, rows["A"].reviews, rows["A"].reviewed_products, rows["A"].avg_price) == (2, 2, 1, 200.0)
    assert rows["B"].avg_price is None and rows["B"].products == 1
    assert rows["C"].avg_price == 0.0 and rows["C"].products == 0


def test_report_and_suggestions(reviews, products):
    report = brands.brand_report(reviews, products)
    rows = {r.brand: r for r in report.collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["C"].negative_pct == 100.0 and rows["C"].weaknesses[0].category == "사이즈"
    pages = brands.page_distribution(reviews).filter("brand = 'A'").orderBy("page_number").collect()
    assert [(p.page_number, p.reviews) for p in pages] == [(1, 1), (2, 1)]
    told = {(r.brand, r.kind, r.rn): r for r in brands.marketing_suggestions(report).collect()}
    assert told["C", "improvement", 1].priority == "High"
    assert told["A", "positioning", 1].subject == rows["A"].position
    assert told["A", "advantage", 1].subject == "디자인 - 예쁘"


def test_saved_scores_give_the_same_report(reviews, products):
    from shelfscope.operators.sentiment import score_sentiment

    one = brands.brand_report(reviews, products).collect()
    two = brands.brand_report(reviews, products, scored=score_sentiment(reviews)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_comparison(reviews, products):
    rows = {r.brand: r for r in brands.compare_brands(["A", "B", "D"], reviews, products).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["B"].top_factor == "Unknown" and rows["B"].rank_price == 2
    assert rows["A"].rank_reviews == 1


def test_brand_dashboard_runs(reviews, products):
    for name, table in reports.brand_dashboard(reviews, products, n=2).items():
        assert table.collect(), name
