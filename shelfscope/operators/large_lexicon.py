"""Lexicons of thousands of entries, held as a table: keywords found together instead of one by one.

`sentiment.score_sentiment` searches every keyword in every text, so its work grows with the lexicon. Here
a lexicon of up to WALKED entries is found by one walk over the text, whose hits are looked up by number;
nothing is shuffled. In a larger one each keyword stands under its anchor, the rarest of its q-grams among all
keywords (a shorter keyword under itself). The distinct q-grams of a text are joined to the anchors, and only
keywords under an anchor that the text holds are searched in it. Work per text follows its own length and
its candidates, not the lexicon. The operator is chosen by the caller; all give the same rows.

Only keys and grams are shuffled by that join (or nothing, where the optimizer broadcasts the anchors);
texts move once, to meet their candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.matching import computed_once, keyword_hits, quoted
from shelfscope.lexicon import unique
from shelfscope.session import stored

Q = 4
#: Entries up to which a lexicon is one expression.
WALKED = 10_000
ENTRY = "struct<lexicon:string,cat_ord:int,kw_ord:int,category:string,keyword:string>"


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct substrings of the given lengths."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def entries_of(lexicon: DataFrame) -> DataFrame:
    """(word, entry) of a lexicon table (lexicon, category, cat_ord, keyword, kw_ord)."""
    return lexicon.filter(F.length("keyword") > 0).select(
        F.col("keyword").alias("word"), F.struct("lexicon", F.col("cat_ord").cast("int").alias("cat_ord"), F.col("kw_ord").cast("int").alias("kw_ord"), "category", "keyword").alias("entry")
    )


def numbers(hits: str, words: Sequence[str]) -> Column:
    """The sorted numbers of the entries (of which `words` are the keywords) behind the hits of a row, once each: a
    hit stands for the keywords it starts with. Hits are looked up in a literal table by their CRC-32, as a
    literal map is searched key by key."""
    own: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        own.setdefault(word, []).append(i)
    if not own:
        return F.array().cast("array<int>")
    slots: list[list[str]] = [[] for _ in own]
    for word in own:
        behind = [str(i) for end in range(1, len(word) + 1) for i in own.get(word[:end], ())]
        slots[zlib.crc32(word.encode()) % len(own)].append(f"struct({quoted(word)}, array({', '.join(behind)}))")
    table = ", ".join(f"array({', '.join(slot)})" if slot else "NULL" for slot in slots)
    known = f"cast(array({table}) AS array<array<struct<word:string,own:array<int>>>>)"
    one = f"flatten(transform(filter({known}[cast(crc32(h) % {len(own)} AS int)], e -> e.word = h), e -> e.own))"
    return F.expr(f"sort_array(array_distinct(flatten(transform({hits}, h -> {one}))))")


def walked(reviews: DataFrame, entries: Sequence, name: str) -> DataFrame:
    """`reviews` plus the given entries, sorted, whose keyword stands in the text, by one walk over it."""
    words = [e["keyword"] for e in entries]
    rows = computed_once(reviews, _hits=F.array_distinct(keyword_hits(F.col("text"), unique(words))))
    literal = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)
    listed = ", ".join(f"struct({', '.join(map(literal, e))})" for e in entries)
    known = F.expr(f"cast(array({listed}) AS array<{ENTRY}>)")
    found = rows.withColumn("_numbers", numbers("_hits", words))
    return found.withColumn(name, F.transform("_numbers", lambda i: known[i])).drop("_hits", "_numbers")


def anchors(lexicon: DataFrame, q: int = Q) -> DataFrame:
    """(gram, size, entries) of a lexicon table (lexicon, category, cat_ord, keyword, kw_ord)."""
    entries = entries_of(lexicon)
    words = entries.groupBy("word").agg(F.collect_set("entry").alias("entries"))
    size = F.least(F.length("word"), F.lit(q))
    cut = words.withColumn("size", size).withColumn(
        "gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1), lambda i: F.substring("word", i, F.col("size")))))
    )
    often = cut.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = cut.join(often, "gram").groupBy("word", "size", "entries").agg(F.min(F.struct("often", "gram")).alias("rarest"))
    return rarest.groupBy(F.col("rarest.gram").alias("gram"), "size").agg(F.flatten(F.collect_list("entries")).alias("entries"))


def with_entries(reviews: DataFrame, lexicon: DataFrame, key: Sequence[str], q: int = Q, name: str = "_entries", most_walked: int = WALKED) -> DataFrame:
    """`reviews` plus all lexicon entries whose keyword stands in the text, in lexicon order.

    `key` names the columns that tell rows apart; rows of one key share candidates, not results. Reads the
    lexicon when called: up to `most_walked` entries to the driver; of more, the anchors are written.
    """
    listed = [r["entry"] for r in entries_of(lexicon).select("entry").distinct().orderBy("entry").limit(most_walked + 1).collect()]
    if len(listed) <= most_walked:
        return walked(reviews, listed, name)
    index = stored(anchors(lexicon, q), "anchors")
    sizes = [r["size"] for r in index.select("size").distinct().orderBy("size").collect()]  # 1 to q
    own = F.struct(*key)
    held = reviews.filter(F.col("text").isNotNull()).select(own.alias("_key"), F.explode(grams(F.col("text"), sizes)).alias("gram"))
    found = held.join(index.select("gram", "entries"), "gram").groupBy("_key").agg(F.flatten(F.collect_list("entries")).alias("_candidates"))
    joined = reviews.withColumn("_key", own).join(found.withColumnRenamed("_key", "_found"), F.col("_key").eqNullSafe(F.col("_found")), "left")
    none = F.array().cast(f"array<{ENTRY}>")
    hits = F.filter(F.coalesce("_candidates", none), lambda e: F.contains(F.coalesce("text", F.lit("")), e["keyword"]))
    # Neighbours are compared: array_distinct compares every two structs.
    sorted_ = joined.withColumn("_sorted", F.sort_array(hits))
    once = F.filter("_sorted", lambda e, i: (i == 0) | (e != F.col("_sorted")[F.greatest(i - 1, F.lit(0))]))
    return sorted_.withColumn(name, once).drop("_key", "_found", "_candidates", "_sorted")


def score_large_lexicon(
    reviews: DataFrame, lexicon: DataFrame, key: Sequence[str], max_reasons: int | None = 3, q: int = Q,
    positive: str = "positive", negative: str = "negative", most_walked: int = WALKED,
) -> DataFrame:
    """As `sentiment.score_sentiment`, with a lexicon table that holds both sides under their names."""
    rows = with_entries(reviews, lexicon, key, q, most_walked=most_walked)

    def side(which: str) -> Column:
        mine = F.filter("_entries", lambda e: e["lexicon"] == which)
        return F.transform(mine, lambda e: F.struct(e["category"].alias("category"), e["keyword"].alias("keyword")))

    rows = rows.withColumns({"_pos": side(positive), "_neg": side(negative)})
    pos, neg = F.size("_pos"), F.size("_neg")

    def reasons(entries: str) -> Column:
        return F.col(entries) if max_reasons is None else F.slice(entries, 1, max_reasons)

    return rows.withColumns({
        "sentiment": F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"),
        "positive_score": pos, "negative_score": neg,
        "positive_reasons": reasons("_pos"), "negative_reasons": reasons("_neg"),
    }).drop("_entries", "_pos", "_neg")
