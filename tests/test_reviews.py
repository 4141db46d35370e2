import pytest
from pyspark.sql import functions as F

from shelfscope.lexicon import NEGATIVE, POSITIVE
from shelfscope.operators import insights, ordering, sentiment, stats, trends
from shelfscope.operators.sentiment import score_sentiment
from shelfscope.plans import reports
from shelfscope.sources.sinks import pack_reasons

ROWS = [
    (1, "p1", "A", "디자인이 예쁘고 만족해요", 1, "Y"),
    (2, "p1", "A", "너무 작아서 실망. 환불 필요. 끝", 1, "N"),
    (3, "p1", "A", "택배 왔습니다", 2, None),
    (4, "p2", "B", "최고 예쁘 예뻐 이쁘 세련", 1, "N"),
    (5, "p2", None, None, None, "Y"),
    (6, None, "B", "작아 좋아", 2, "N"),
]
SCHEMA = "review_id int, product_id string, brand string, text string, page_number int, has_image string"


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def scored(reviews):
    return score_sentiment(reviews)


def expected(text):
    pos = [f"{c}:{k}" for c, k in POSITIVE.entries if k in (text or "")]
    neg = [f"{c}:{k}" for c, k in NEGATIVE.entries if k in (text or "")]
    kind = "positive" if len(pos) > len(neg) else "negative" if len(neg) > len(pos) else "neutral"
    return kind, len(pos), len(neg), ", ".join(pos[:3]), ", ".join(neg[:3])


def test_scores_reasons_and_kept_columns(scored):
    rows = scored.withColumn("p", pack_reasons(F.col("positive_reasons"))).withColumn(
        "n", pack_reasons(F.col("negative_reasons"))).orderBy("review_id").collect()
    got = [(r.sentiment, r.positive_score, r.negative_score, r.p, r.n) for r in rows]
    assert got == [expected(r[3]) for r in ROWS]
    assert rows[3].p.count(",") == 2 and rows[3].positive_score > 3
    assert {"page_number", "has_image"} <= set(scored.columns)


def test_keyword_in_two_categories_counts_twice(spark):
    row = score_sentiment(spark.createDataFrame([("만족",)], "text string")).first()
    assert row.positive_score == 2


def test_all_reasons_on_request(scored, reviews):
    row = score_sentiment(reviews, max_reasons=None).filter("review_id = 4").first()
    assert len(row.positive_reasons) == row.positive_score


def test_counts_add_up(scored):
    rows = sentiment.sentiment_counts(scored).collect()
    assert sum(r.n for r in rows) == len(ROWS)
    assert abs(sum(r.pct for r in rows) - 100) < 1e-9


def test_results_do_not_depend_on_partitions(reviews):
    one = score_sentiment(reviews.repartition(1))
    many = score_sentiment(reviews.repartition(16))
    for table in (lambda s: insights.top_reasons(s, "positive"), insights.improvement_topics,
                  lambda s: ordering.samples_per_sentiment(s, ["review_id"])):
        assert sorted(map(str, table(one).collect())) == sorted(map(str, table(many).collect()))


def test_needs_stay_within_a_review(reviews):
    rows = insights.customer_needs(reviews, ["review_id"]).collect()
    assert [(r.keyword, r.rn, r.sentence) for r in rows] == [("필요", 1, " 환불 필요")]


def test_fanout_equals_raw_join(reviews, scored):
    got = {r.page_number: (r.positive, r.negative, r.neutral)
           for r in trends.page_sentiment_fanout(reviews, scored).collect()}
    left = reviews.filter("page_number IS NOT NULL").select("product_id", "page_number")
    right = scored.select(F.col("product_id").alias("q"), "sentiment")
    raw = left.join(right, F.col("product_id").eqNullSafe(F.col("q"))).groupBy("page_number").pivot(
        "sentiment", ["positive", "negative", "neutral"]).count().na.fill(0).collect()
    assert got == {r.page_number: (r.positive, r.negative, r.neutral) for r in raw}


def test_image_rate_is_by_product(reviews, scored):
    kept = scored.filter("product_id IN ('p1', 'p2')")
    want = 100.0 * kept.filter("sentiment = 'positive'").count() / kept.count()
    assert trends.image_product_positive_ratio(scored, reviews).first().pct == want
    assert trends.image_product_positive_ratio(scored).first().pct == want


def test_missing_brand_is_dropped(reviews):
    assert {r.brand for r in stats.brand_review_counts(reviews).collect()} == {"A", "B"}


def test_fixed_messages(scored):
    messages = {(r.category, r.keyword): r.message for r in insights.top_strengths(scored, 50).collect()}
    assert messages["디자인", "예쁘"] == "고객 100%가 인정한 세련된 디자인"
    suggestions = {r.keyword: r.suggestion for r in insights.top_weaknesses(scored, 50).collect()}
    assert suggestions["작아"] == "사이즈 재검토 및 상세 치수 정보 제공 필요"


def test_product_report(reviews):
    report = reports.product_report(reviews, ["review_id"], product_ids=["p1"])
    assert [r.total for r in report["sentiment"].collect()] == [3]
    for table in report.values():
        assert {r.product_id for r in table.collect()} <= {"p1"}


def test_review_dashboard_tables_run(reviews, scored):
    for name, table in reports.review_dashboard(reviews, scored, ["review_id"]).items():
        assert table.collect() is not None, name
