import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfscope.functions import matching
from shelfscope.lexicon import NEGATIVE, POSITIVE, Lexicon

WORDS = Lexicon.of({"a": ["ab", "abc", "aa"], "b": ["bc", "c", "aaaa"], "d": ["ab", "x.y", "it's"]})


def entries(spark, texts, lexicon):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = matching.with_hits(df, lexicon.keywords).select(
        "i", matching.entries_of(lexicon.keywords, lexicon).alias("e")).orderBy("i").collect()
    return [[(e.category, e.keyword) for e in r.e] for r in rows]


def brute(text, lexicon):
    return [(c, k) for c, k in lexicon.entries if k in (text or "")]


def test_entries_equal_substring_test(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcx.y 's\n") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "it's x.y", "aaaaa"]
    assert entries(spark, texts, WORDS) == [brute(t, WORDS) for t in texts]


def test_fixed_words_equal_substring_test(spark):
    rng = random.Random(3)
    words = POSITIVE.keywords + NEGATIVE.keywords + ["옷", " ", ".", "요"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(200)]
    for lexicon in (POSITIVE, NEGATIVE):
        assert entries(spark, texts, lexicon) == [brute(t, lexicon) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab", max_size=12), min_size=1, max_size=20))
def test_occurrences_do_not_overlap(spark, texts):
    keywords = ["a", "ab", "aa", "aba", "bb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    hits = df.select("i", F.explode(matching.occurrence_hits(F.col("text"), keywords)).alias("keyword"))
    for word in keywords:
        weight = F.expr(matching.occurrence_weight(keywords, [word]))
        counted = {r.i: r.n for r in hits.groupBy("i").agg(F.sum(weight).alias("n")).collect()}
        assert [counted.get(i, 0) or 0 for i in range(len(texts))] == [t.count(word) for t in texts]


def test_self_overlap():
    assert matching.overlaps_itself("aa") and matching.overlaps_itself("aba")
    assert not matching.overlaps_itself("ab")


def test_empty_lexicon(spark):
    assert entries(spark, ["abc"], Lexicon.of({})) == [[]]


def test_lexicon_frame_round_trip(spark):
    assert Lexicon.from_frame(WORDS.to_frame(spark, "w"), "w") == WORDS
    with pytest.raises(ValueError):
        Lexicon.from_frame(WORDS.to_frame(spark, "w"), "w", most=3)


def test_large_lexicon_equals_the_search_of_every_keyword(spark):
    """5,000 entries, some in two categories, some shorter than a q-gram."""
    from shelfscope.operators.large_lexicon import score_large_lexicon
    from shelfscope.operators.sentiment import score_sentiment

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.choice([2, 3, 5, 6, 7, 8])))
    sides = [Lexicon.of({f"{s}{c}": [word() for _ in range(500)] for c in range(5)}) for s in "pn"]
    texts = ["".join(rng.choices("abcdé \n", k=rng.randrange(200))) for _ in range(120)] + [None, "", "ab", "a"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[6], "other text, same id"), (None, texts[7], "y"), (None, texts[8], "z")]
    reviews = spark.createDataFrame(rows, "id int, text string, note string")
    entries_ = [(name, c, i, k, j) for name, lex in zip(("positive", "negative"), sides) for i, (c, ks) in enumerate(lex.categories) for j, k in enumerate(dict.fromkeys(ks))]
    table = spark.createDataFrame(entries_, "lexicon string, category string, cat_ord int, keyword string, kw_ord int")
    plain = Lexicon.of({c: list(dict.fromkeys(ks)) for c, ks in sides[0].categories}), Lexicon.of({c: list(dict.fromkeys(ks)) for c, ks in sides[1].categories})
    show = lambda df: sorted(map(str, df.select("id", "text", "note", "sentiment", "positive_score", "negative_score", "positive_reasons", "negative_reasons").collect()))

    def brute_rows():
        for i, t, note in rows:
            pos, neg = ([(c, k) for c, k in lex.entries if k in (t or "")] for lex in plain)
            yield i, note, len(pos), len(neg), pos[:3], neg[:3]

    got = score_large_lexicon(reviews, table, ["id"]).collect()
    assert sorted((str((r.id, r.note, r.positive_score, r.negative_score, [tuple(x) for x in r.positive_reasons], [tuple(x) for x in r.negative_reasons])) for r in got)) == sorted(map(str, brute_rows()))
    small = Lexicon.of({"p": ["ab", "cd"]}), Lexicon.of({"n": ["bc"]})
    rows_of = [("positive", "p", 0, "ab", 0), ("positive", "p", 0, "cd", 1), ("negative", "n", 0, "bc", 0)]
    few = spark.createDataFrame(rows_of, table.schema)
    assert show(score_large_lexicon(reviews, few, ["id"])) == show(score_sentiment(reviews, *small))
    assert score_large_lexicon(reviews, table.limit(0), ["id"]).filter("sentiment <> 'neutral'").count() == 0


def test_large_lexicon_is_one_walk_without_moving_texts_until_it_is_too_large(spark):
    from shelfscope.operators.large_lexicon import score_large_lexicon

    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abé-]^'\\\n\U0001F600", k=rng.randrange(1, 6))) for _ in range(300)})
    entries_ = [(side, c, i, k, j) for j, k in enumerate(words) for i, (c, side) in enumerate([("x", "positive"), ("y", "negative"), ("z", "positive")]) if (j + i) % 3]
    entries_ += [("positive", None, None, "ab", None), ("positive", "x", 0, "", 0), ("positive", "x", 0, None, 0)] + entries_[:3]
    table = spark.createDataFrame(entries_, "lexicon string, category string, cat_ord int, keyword string, kw_ord int")
    texts = ["".join(rng.choices("abé-]^'\\\n\U0001F600 ", k=rng.randrange(60))) for _ in range(60)] + [None, ""]
    reviews = spark.createDataFrame([(i % 55, t) for i, t in enumerate(texts)], "id int, text string")
    walk, join = (score_large_lexicon(reviews, table, ["id"], max_reasons=None, most_walked=most) for most in (len(entries_), 20))
    show = lambda df: sorted(map(str, df.select("id", "text", "sentiment", "positive_score", "negative_score", "positive_reasons", "negative_reasons").collect()))
    assert show(walk) == show(join)
    held = sum(len({e for e in entries_ if e[3] and e[3] in (t or "")}) for t in texts)
    assert held == sum(r.positive_score + r.negative_score for r in walk.collect()) > 500
    plan = walk._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_many_keywords_are_found_by_one_walk_whose_entries_follow_the_hits(spark):
    words = [a + b + c for a in "ab" for b in "cdefg" for c in ("", "a", "hb", "é", "a-", "]", "^x", "dda", "e", "ff")]
    lexicon = Lexicon.of({"one": words[::2], "two": words[1::2], "both": words[:9]})
    assert len(lexicon.keywords) > matching.FEW_KEYWORDS
    texts = ["", "acéacff", "bgehbbgadda", "ac]ad^xaca-", "zz", "agdda" * 3, None, "ace", "bda-bdhb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    hits = matching.with_hits(df, lexicon.keywords)
    found = hits.select("i", matching.entries_of(lexicon.keywords, lexicon).alias("e"), matching.categories_of(lexicon.keywords, lexicon).alias("c"))
    for r in found.collect():
        want = [(c, k) for c, k in lexicon.entries if k in (texts[r.i] or "")]
        assert [tuple(e) for e in r.e] == want and r.c == [c for c in lexicon.names if any(c == x for x, _ in want)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "contains" not in plan.lower().replace("array_contains", "")


def test_words_that_are_only_looked_for_do_not_change_counts(spark):
    counted, others = ["aba", "ab", "ba", "cc"], ["abab", "bac", "ccc", "aba"]
    keywords = list(dict.fromkeys([*counted, *others]))
    present_only = frozenset(keywords) - frozenset(counted)
    texts = ["ababab", "bacccc", "abacc", "", None, "ccccc abab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    hits = df.select("i", F.explode(matching.occurrence_hits(F.col("text"), keywords, present_only)).alias("keyword"))
    for word in counted:
        weight = F.expr(matching.occurrence_weight(keywords, [word], present_only=present_only))
        got = {r.i: r.n for r in hits.groupBy("i").agg(F.sum(weight).alias("n")).collect()}
        assert all(got.get(i, 0) == (t or "").count(word) for i, t in enumerate(texts))
