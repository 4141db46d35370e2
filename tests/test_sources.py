import datetime
import random

import dom
import pytest
from pyspark.sql import functions as F

from shelfscope.operators.collection import dedup_by_link, recent_reviews
from shelfscope.operators.ordering import cap_per_product
from shelfscope.operators.sentiment import score_sentiment
from shelfscope.plans.reports import score_job
from shelfscope.sources import sinks, tables
from shelfscope.sources import pages as pg
from shelfscope.streaming.ingest import ingest_cards_stream

HOST = "https://shop.example"
TEXT = 'line one\nline "two", end'


def test_csv_round_trip_with_bom_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("001", TEXT), ("NA", None)], "product_id string, text string")
    path = str(tmp_path / "r")
    sinks.write_csv_bom(df, path, single_file=True)
    part = next((tmp_path / "r").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfproduct_id,text")
    back = tables.read_reviews(spark, [str(tmp_path / "missing"), path])
    assert sorted((r.product_id, r.text) for r in back.collect()) == [("001", TEXT), ("NA", None)]
    assert "page_number" in back.columns


def test_files_without_line_breaks_are_split_and_rows_dealt(spark, tmp_path):
    file = tmp_path / "r.csv"
    file.write_text("product_id,text\n" + "".join(f'{n},"text ""{n}"""\n' for n in range(4000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert tables.read_reviews(spark, str(file)).rdd.getNumPartitions() == 1
        split = tables.read_reviews(spark, str(file), line_breaks=False)
        assert split.rdd.getNumPartitions() > 3
        assert split.filter("text = concat('text \"', product_id, '\"')").count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    dealt = tables.read_reviews(spark, str(file), partitions=6)
    assert dealt.rdd.getNumPartitions() == 6 and dealt.count() == 4000
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 4000 / 6


def test_read_products_headers_and_types(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("﻿상품ID,브랜드,가격,할인율,TEXT\n007,A, 45000 ,30%,A 원피스\n8,,\"59,900\",20,\n", encoding="utf-8")
    rows = {r.product_id: r for r in tables.read_products(spark, str(file)).collect()}
    assert (rows["007"].price, rows["007"].discount_pct, rows["007"].style_text) == (45000.0, None, "A 원피스")
    assert (rows["8"].brand, rows["8"].price, rows["8"].discount_pct) == (None, None, 20.0)


def test_no_readable_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_reviews(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_saved_sentiment_keeps_blank_reasons(spark, tmp_path):
    reviews = spark.createDataFrame([("1", "A", "예쁘"), ("2", "A", "말")], "product_id string, brand string, text string")
    scored = score_sentiment(reviews)
    path = str(tmp_path / "s")
    sinks.write_csv_bom(scored, path)
    back = {r.product_id: r for r in tables.read_sentiment(spark, path, reviews).collect()}
    assert back["2"].positive_reasons == [] and back["2"].sentiment == "neutral"
    assert [(x.category, x.keyword) for x in back["1"].positive_reasons] == [("디자인", "예쁘")]
    fresh = tables.read_sentiment(spark, str(tmp_path / "none"), reviews)
    assert {r.sentiment for r in fresh.collect()} == {"positive", "neutral"}


def test_score_job(spark, tmp_path):
    spark.createDataFrame([("1", "예쁘")], "product_id string, text string").write.parquet(str(tmp_path / "r.parquet"))
    counts = score_job(spark, [str(tmp_path / "r.parquet")], str(tmp_path / "out"), str(tmp_path / "csv"))
    assert [(r.sentiment, r.n) for r in counts.collect()] == [("positive", 1)]


def test_dated_path():
    assert sinks.dated_path("out/", "search 원 피스", datetime.date(2024, 1, 5)) == "out/search_원_피스_20240105.csv"


CARDS = """<!-- <a class="gtm-view-item-list" href="/no"></a> -->
<a class="x gtm-view-item-list" href="/p/1?a=1&amp;b=2" data-item-id="001" data-item-brand="A &amp; B" data-price="45000"
   data-original-price="50000" data-discount-rate="10" aria-label="원피스 &gt; 상품상세로 이동"><img alt=">" src="" data-src="i.jpg"></a>
<a class="other" href="/p/2">no</a>
<a class='gtm-view-item-list' href='https://x/p/3'><img src="j.jpg"/></a><a class="gtm-view-item-list">no link</a>"""


def test_product_cards(spark):
    pages = spark.createDataFrame([(1, "u", CARDS)], pg_schema())
    rows = pg.extract_product_cards(pages).orderBy("pos").collect()
    first = rows[0]
    assert [r.link for r in rows] == ["/p/1?a=1&b=2", "https://x/p/3", ""]
    assert (first.product_id, first.brand, first.price, first.list_price, first.discount_pct) == (
        "001", "A & B", "45000", "50000", "10")
    assert (first.name, first.image_url, rows[1].image_url) == ("원피스 >", "i.jpg", "j.jpg")


def pg_schema():
    return "page_id bigint, url string, html string"


DISPLAY = """<div class="sc-igtioI eSJwIO"><a class="gtm-select-item" href="/p/9"></a><img src="k.jpg">
<a aria-label="A 샵으로 이동"><span> A </span></a><a aria-label="코트 상품상세로 이동"><span>코트</span></a>
<div class="sc-hKDTPf"><span class="text-body_13px_semi text-red">30%</span><span class="text-body_13px_semi">59,900원</span></div></div>
<div class="sc-igtioI eSJwIO"><a class="gtm-select-item" href="/p/10"></a>
<span class="text-etc_11px_reg text-yellow">4.8</span><span>(12)</span><span aria-label="7000">7천</span></div>"""


def test_display_cards(spark):
    pages = spark.createDataFrame([(1, "u", DISPLAY)], pg_schema())
    row, = pg.extract_display_cards(pages).collect()
    assert (row.link, row.brand, row.name, row.price, row.discount_pct, row.text) == (
        "/p/9", "A", "코트", "59,900원", "30%", "A 코트")
    loose = {r.link: r for r in pg.extract_display_cards(pages, pg.LOOSE_DISPLAY).collect()}
    assert (loose["/p/10"].price, loose["/p/10"].rating, loose["/p/10"].review_count) == ("7000", "4.8", "(12)")


REVIEW = """<ul><li class="review-a"><div class="content-x">short</div><p class="review-text">정말 마음에 드는 원피스</p>
<svg class="star fill"></svg><svg class="star"></svg><span class="username">kim</span><span class="date">24.01.15</span>
<div class="option">M</div><button class="like">도움 7</button><img class="review-img"></li>
<li class="review-b"><p>only &amp; this</p><span class="rating-n">4점</span></li></ul>"""


def test_enhanced_review_blocks(spark):
    pages = spark.createDataFrame([(1, "p1", 2, REVIEW)], "page_id bigint, product_id string, page_number int, html string")
    a, b = pg.extract_review_blocks(pages).orderBy("pos").collect()
    assert (a.text, a.rating, a.author, a.date, a.option, a.helpful_count, a.has_image) == (
        "정말 마음에 드는 원피스", "1", "kim", "24.01.15", "M", "7", "Y")
    assert (b.text, b.rating, b.helpful_count, b.has_image) == ("only & this 4점", "4", "0", "N")
    assert (a.product_id, a.page_number) == ("p1", 2)
    assert (len(a.text), len(b.text)) == (13, 14)
    assert pg.valid_reviews(pg.extract_review_blocks(pages)).count() == 2
    assert [r.pos for r in pg.valid_reviews(pg.extract_review_blocks(pages), 13).collect()] == [1]


def test_basic_review_blocks(spark):
    pages = spark.createDataFrame([(1, REVIEW)], "page_id bigint, html string")
    a, b = pg.extract_review_blocks(pages, enhanced=False).orderBy("pos").collect()
    assert (a.text, a.rating, a.author) == ("short", "2", "kim")
    assert (b.text, b.rating) == ("only & this", "4")


def test_selectors():
    tree = dom.parse("<div class='a b'><p id=x>1<b>2</b></p><i>3</i></div><i>4</i>")
    assert [e.text() for e in tree.select("div.a.b p + i")] == ["3"]
    assert [e.text() for e in tree.select("p b, i")] == ["2", "3", "4"]
    assert [e.text(" ") for e in tree.select("p[id='x']")] == ["1 2"]


SELECTORS = ["p", "div p", "li + li b", "div.a", "p + b, i", "[id='x']", "div[class*='b'] i + p", "ul li a", "a[href^='/p'], a[href$='9']", "br + b", "script + p"]


def random_page(draw):
    opens = ["<p>", "<div class='a b'>", '<div class="b">', "<i>", "<b id=x>", "<li>", "<ul>", "<a href='/p/9'>", "<a href=/q9>", "<A HREF='x'>"]
    closes = ["</p>", "</div>", "</i>", "</b>", "</li>", "</ul>", "</a>", "</P >"]
    other = ["<br>", "<img src=k.jpg/>", "<!-- <p>no</p> -->", "<script>var t='</p><i>';</script>", "<style>p{}</style>", "<hr/>", "<!DOCTYPE html>", "<p/>"]
    words = [" one ", "two", "&amp;", " \n", "\u00a0three &lt;x&gt;", "é中"]
    return "".join(draw.choice(draw.choice([opens, opens, closes, other, words])) for _ in range(draw.randrange(60)))


def test_elements_equal_the_tree_on_any_markup(spark):
    draw = random.Random(12)
    pages = ["", None, "plain", "</p></div>", "<p>", DISPLAY, REVIEW, CARDS, "<p>" * 700 + "x" + "</p>" * 300] + [random_page(draw) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    page = pg._Page(rows, SELECTORS)
    shown = [
        F.transform(page.names[s], lambda e: F.struct(
            page.text(e, "|").alias("text"), page.text(e, strip=False).alias("raw"), e["depth"].alias("depth"), e["name"].alias("name"),
        )).alias(f"s{k}")
        for k, s in enumerate(SELECTORS)
    ]

    def depth(e):
        return 0 if e.parent is None else 1 + depth(e.parent)

    for row in page.frame.select("page_id", *shown).collect():
        tree = dom.parse(pages[row.page_id])
        for k, selector in enumerate(SELECTORS):
            want = [(e.text("|"), e.text(strip=False), depth(e), e.tag) for e in tree.select(selector)]
            assert [tuple(x) for x in row[f"s{k}"]] == want, (selector, pages[row.page_id])


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(1, "/p/1"), (2, HOST + "/p/1"), (3, ""), (4, None), (5, "/p/2"), (6, "/p/2")]
    df = spark.createDataFrame(rows, "k int, link string")
    once = dedup_by_link(df, ["k"], HOST)
    assert sorted((r.k, r.link) for r in once.collect()) == [(1, HOST + "/p/1"), (5, HOST + "/p/2")]
    assert sorted(dedup_by_link(once, ["k"], HOST).collect()) == sorted(once.collect())


def test_recent_reviews(spark):
    day = datetime.datetime
    rows = [("a", 1, 1, day(2024, 1, 19)), ("a", 1, 2, day(2023, 1, 1)), ("a", 2, 1, day(2024, 1, 18)),
            ("b", 1, 1, None), (None, 1, 1, day(2024, 1, 2)), (None, 1, 2, day(2020, 1, 2)), (None, 2, 2, day(2024, 1, 2))]
    df = spark.createDataFrame(rows, "product_id string, page_number int, pos int, date timestamp")
    as_of = F.lit(day(2024, 1, 20))
    assert recent_reviews(df, as_of).count() == 5
    strict = recent_reviews(df, as_of, strict=True).collect()
    assert sorted((str(r.product_id), r.page_number, r.pos) for r in strict) == [("None", 1, 1), ("a", 1, 1), ("b", 1, 1)]


def test_cap_per_product(spark):
    df = spark.range(300).select(F.lit("p").alias("product_id"), (F.col("id") / 20).cast("int").alias("page_number"),
                                 F.col("id").alias("pos"))
    assert [r.pos for r in cap_per_product(df).orderBy("pos").collect()] == list(range(100))


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    def card(n):
        return f'<a class="gtm-view-item-list" href="/p/{n}" data-item-id="{n}"></a>'

    def put(name, *numbers):
        rows = [(i, "u", card(n) + card(1)) for i, n in enumerate(numbers)]
        spark.createDataFrame(rows, pg_schema()).coalesce(1).write.parquet(str(tmp_path / "staged" / name))
        for part in (tmp_path / "staged" / name).glob("part-*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{name}.parquet").write_bytes(part.read_bytes())

    def run():
        query = ingest_cards_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"),
                                    host=HOST, max_files_per_trigger=1)
        query.awaitTermination()
        return sorted(r.link for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("one", 1, 2, 3)
    put("two", 3, 4)
    assert run() == [f"{HOST}/p/{n}" for n in (1, 2, 3, 4)]
    assert len(run()) == 4
    put("three", 2, 5)
    batch = dedup_by_link(pg.extract_product_cards(spark.read.parquet(str(tmp_path / "in"))), ["page_id", "pos"], HOST)
    assert run() == sorted(r.link for r in batch.collect())


def test_stream_remembers_for_good_when_asked(spark, tmp_path):
    from shelfscope import fixed_values as fv
    from shelfscope.streaming.ingest import FOR_GOOD

    pages = [(n, "u", f'<a class="{fv.CARD_CLASS}" href="/p/{n % 3}">x</a>') for n in range(7)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "in"))
    for horizon in (FOR_GOOD, "30 days"):
        out = str(tmp_path / f"out-{horizon}")
        ingest_cards_stream(spark, str(tmp_path / "in"), out, str(tmp_path / f"state-{horizon}"), horizon=horizon).awaitTermination()
        assert sorted(r.link for r in spark.read.parquet(out).collect()) == ["/p/0", "/p/1", "/p/2"]


def test_shared_folder_is_the_clusters(spark):
    from shelfscope.session import shared_folder

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark, "x").startswith(named) and shared_folder(spark, "x") != shared_folder(spark, "x")


def test_anchors_of_ordinary_html(spark):
    first = (
        """<a href="/1">one<p>x</p><a href="/2">two</a><a href=/3>three</a><!-- <a href="/c">no</a> -->"""
        """<script>"<a href='/s'>no</a>"</script><A data-x=" href='/bad'" HREF = '/5'>caf&eacute; &#44032;&#x42;&nope;&amp;lt;</A>"""
        """<abbr>no</abbr><a title=it's href="/4">it's</a><a href="/6">six"""
    )
    rows = spark.createDataFrame([(1, first), (2, "<a"), (3, ""), (4, None), (5, "<a disabled>x</a><a/>")], "page_id bigint, html string")
    found = [(r.page_id, r.pos, r.link, r.text) for r in pg.page_links(rows).orderBy("page_id", "pos").collect()]
    assert found == [
        (1, 0, "/1", "onex"), (1, 1, "/2", "two"), (1, 2, "/3", "three"), (1, 3, "/5", "caf\u00e9 \uac00B&nope;&lt;"),
        (1, 4, "/4", "it's"), (1, 5, "/6", "six"), (5, 0, "", "x"), (5, 1, "", ""),
    ]
