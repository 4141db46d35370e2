"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists.

Two words are near if exactly one inserted, deleted or replaced code point makes one of the other. Of such
a pair whose shorter word has m code points, either the first m // 2 or the last m - m // 2 are equal. So a
word stands in up to four lists: by its first and by its last half, as the shorter (m its length) and as
the longer one (m its length less one). Each list is sorted, words of a last half read backwards.

A list is scanned once for every word of length m in it, with the rows of a banded edit matrix: distances
along three diagonals, one row per character of the entry. Entries share the rows of their longest common
prefix (LCP). Up to the LCP with the query a row is 1 0 1 and serves the whole range of entries that go
on alike. Behind the first other letter no 0 is left, so of a range only entries that continue one of the
diagonals with a 1 letter by letter stay below two edits: the rest of the range is skipped, from one such
entry to the next. A pair is taken from the first-half list where that half is equal, and from the
last-half list otherwise, so each pair is found once.

A list of more than `longest` words is split further by the place of the edit: entries are dealt by what
stands before and after each place, which only words that differ in that place (or lack it) share. Such
lists are no longer than the alphabet, and the same scan reads them. Nothing is dropped.

A word's form is its near word of largest count, if that is `factor` times its own or more; counts grow
along forms, so following them ends. `roots` does so by doubling steps.

Defined results: null and empty texts have no words; ties of counts go to the smaller word in code-point
order; words without near words have no form and are their own root; repeated rows count each time; a
null document id is an empty text in the damage rule; no rows -> no rows. Other columns are not read. A
word of any length is one row; texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.storage import stored

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a list that one task scans as it is.
LONGEST_LIST = 20_000
PAIR = "word string, n long, other string, other_n long"


def runs(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, run) per maximal run of at least `shortest` letters in `text`, with A-Z as a-z."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(doc_id: Column, run: Column, one_in: int = 31) -> Column:
    """`run` without one of its letters, where a checksum of document and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """(word, n) of `words` (word) with at least `shortest` code points that occur `least` times or more."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def halves(words: DataFrame) -> DataFrame:
    """Each word (word, n) under its lists: m, back (read backwards), half, entry (the word as read)."""
    size = F.length("word")
    sides = F.array(*[
        F.struct((size - longer).alias("m"), F.lit(back).alias("back")) for longer in (0, 1) for back in (False, True)
    ])
    dealt = words.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.*")
    first = F.floor(F.col("m") / 2).cast("int")
    length = F.when(F.col("back"), F.col("m") - first).otherwise(first)
    return (
        dealt.withColumn("entry", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
        .withColumn("half", F.substring("entry", F.lit(1), length))
    )


def places(lists: DataFrame) -> DataFrame:
    """The entries of long lists, dealt by each place of an edit behind the half: what is before it and after it."""
    size, m, half = F.length("entry"), F.col("m"), F.length("half")
    # A word of length m lacks or replaces the place; one of length m + 1 has one character more there.
    spot = F.explode(F.sequence(half, m)).alias("spot")
    before = F.substring("entry", F.lit(1), F.col("spot"))
    tails = F.array(
        F.struct(F.lit("replaced").alias("kind"), F.substring("entry", F.col("spot") + 2, size).alias("tail")),
        F.struct(F.lit("inserted").alias("kind"), F.when(size == m, F.substring("entry", F.col("spot") + 1, size))
                 .otherwise(F.substring("entry", F.col("spot") + 2, size)).alias("tail")),
    )
    dealt = lists.select("*", spot).withColumn("tail", F.explode(tails))
    kept = F.when(F.col("tail.kind") == "replaced", (size == m) & (F.col("spot") < m)).otherwise(F.lit(True))
    return dealt.filter(kept).select(
        "word", "n", "m", "back", "entry", "half",
        F.concat_ws("|", "tail.kind", F.col("spot").cast("string"), before, "tail.tail").alias("place"),
    )


def near_in(entries: list[str], known: dict[str, int], shared: int, query: str) -> Iterator[str]:
    """Words one edit from `query` in the sorted `entries` (the keys of `known`), all of which are equal in
    their first `shared` characters."""
    size, depth, low, high = len(query), shared, 0, len(entries)
    while low < high:
        # entries[low:high] begin with the query's first `depth` characters; the row there is 1 0 1.
        prefix, own = query[:depth], query[depth : depth + 1]
        if len(entries[low]) == depth:
            if depth == size - 1:
                yield prefix
            low += 1
        at, stop = low, high
        low = high = stop
        while at < stop:
            letter = entries[at][depth]
            end = bisect_left(entries, prefix + chr(ord(letter) + 1), at + 1, stop)
            if letter == own:
                low, high = at, end
            else:
                behind = prefix + letter
                # The diagonals: the letter is one more, stands for the query's, or follows one that is missing.
                if (word := behind + query[depth:]) in known:
                    yield word
                if own:
                    if (word := behind + query[depth + 1 :]) in known:
                        yield word
                    if query[depth + 1 : depth + 2] == letter and (word := behind + query[depth + 2 :]) in known:
                        yield word
            at = end
        depth += 1


def pairs_of(m: int, back: bool, half: int, entries: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs of a sorted list whose shorter word has m characters, each once."""
    known = dict(zip(entries, counts, strict=True))
    for query, n in known.items():
        if len(query) != m:
            continue
        for other in near_in(entries, known, half, query):
            if len(other) < m or len(other) == m and other <= query:
                continue
            if not back:
                yield query, n, other, known[other]
            elif query[::-1][: m // 2] != other[::-1][: m // 2]:
                yield query[::-1], n, other[::-1], known[other]


def scanned(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Near pairs (word, n, other, other_n) within the lists that `keys` name; a list is one run of sorted rows."""
    place = F.col("place") if "place" in keys else F.lit("")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, counts = None, [], []
        found: list[tuple] = []

        def close() -> None:
            if len(entries) > 1:
                m, back, half, _ = key
                found.extend(pairs_of(m, back, len(half), entries, counts))

        def out() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            found.clear()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "n", "other", "other_n"])

        for batch in batches:
            for *own, entry, n in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if own != key:
                    close()
                    key, entries, counts = own, [], []
                    if len(found) > 10_000:
                        yield out()
                entries.append(entry)
                counts.append(n)
        close()
        yield out()

    return (
        lists.select("m", "back", "half", place.alias("place"), "entry", "n")
        .repartition(*keys).sortWithinPartitions("m", "back", "half", "place", "entry")
        .mapInArrow(scan, PAIR)
    )


def near_pairs(words: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """Near pairs (word, n, other, other_n) of distinct `words` (word, n), each once."""
    own = ["m", "back", "half"]
    lists = halves(words)
    long = stored(lists.groupBy(*own).agg(F.count("*").alias("entries")).filter(F.col("entries") > longest).select(*own), "long-lists")
    usual = scanned(lists.join(long, own, "left_anti"), own)
    split = places(lists.join(long, own, "left_semi"))
    return usual.unionByName(scanned(split, [*own, "place"]).distinct())


def forms(words: DataFrame, pairs: DataFrame, factor: int = 10) -> DataFrame:
    """`words` with n_near, form (null where none counts `factor` times as much) and form_n."""
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """`formed` (word, form) with `root`: the end of the chain of forms, or the word itself."""
    step = stored(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "form-steps")
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(
            step.join(after, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ), "form-steps")
        step = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return formed.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(words: DataFrame, factor: int = 10, longest: int = LONGEST_LIST) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct `words` (word, n)."""
    formed = stored(forms(words, near_pairs(words, longest), factor), "spelling-forms")
    return roots(formed)
