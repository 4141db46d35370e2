"""URL filter: allow and block rules, and logistic regression on hashed character n-grams for the rest.

Host and path are cut out of a URL by expressions. Their n-grams (3 to 5 characters, the host's and the
path's apart) are hashed into buckets; a URL's features are its distinct buckets, scaled to length one.
The regression is trained by full gradient steps over a small labelled table. The table is held as two
arrays (a URL's buckets, a bucket's URLs) in one row, and the steps are one fold over them, so training
is a single expression without shuffles between steps. `MOST_LABELLED` bounds that row. Weights are an
array of `buckets + 1` numbers (the last one is the bias), read as a scalar subquery, so judging pages
needs neither join nor shuffle. Everything is DataFrame functions.

A rule such as `example.org/es/` fits its host and all subdomains where the URL's path starts with the
rule's; the longest rule wins (of two equally long ones, that of the longer host, then block). Rules
are a parameter and become literals, so they should be hundreds, not millions.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and the verdict
allow; a URL without a path fits no rule; very long URLs are read whole; repeated rows
get equal verdicts; no pages -> no rows; columns named like the added ones are replaced (upper and lower
case do not differ). In the labelled table, rows without a label are left out, a null URL counts as
one without features, and without any row all weights are 0, which allows every URL that no rule blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.sharding import let
from shelfscope.llm.storage import free_name, stored

ALLOW, BLOCK = "allow", "block"
SIZES = (3, 4, 5)
BUCKETS = 1 << 14
#: The labelled table is one row while training; more rows than this are refused.
MOST_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table, written for this filter: hosts of ordinary sites and of advertising, betting,
#: adult and pill sites, under names that are reserved for examples.
ORDINARY = """
https://www.garden.example.com/en/12 http://weather.example.net/de/431 https://blog.harbour.example.org/fr/77.html
https://library.example.org/en/9021 http://m.theatre.example.com/es/58 https://northern.example.net/en/300
https://www.kitchen.example.net/fr/1204 http://blog.mountain.example.com/en/8 https://thistle.example.com/de/66
https://bauern.example.net/de/913/ http://museum.example.org/es/47 https://m.enseignant.example.net/fr/23
https://stadtarchiv.example.com/de/15.html https://nation.example.net/en/5150 http://www.therapist.example.com/en/640
https://blog.station.example.org/es/72/ https://other.example.net/en/118 http://m.things.example.com/fr/34
https://tribune.example.net/en/22010 https://www.history.example.org/de/701 http://thunder.example.net/es/389
https://blog.chemistry.example.com/en/41 http://hospital.example.net/fr/860 https://m.railway.example.org/en/99
https://www.universidad.example.net/es/2048 http://river.example.com/en/17 https://blog.forest.example.net/de/505
https://thirteen.example.org/en/33 https://brother.example.com/fr/610/ http://www.gathering.example.net/en/7
https://interior.example.com/es/1313 https://m.astronomy.example.net/en/254.html http://orchestra.example.org/de/84
https://www.election.example.com/en/4100 http://question.example.net/fr/59 https://blog.weaving.example.com/es/92
https://theorem.example.net/de/31415 http://m.rotation.example.com/en/271 https://www.bakery.example.org/en/828
https://cathedral.example.net/fr/1163 http://stories.example.com/en/640 https://blog.painting.example.net/en/15
https://nursery.example.com/es/202 http://www.theory.example.net/de/73 https://m.village.example.org/fr/444
https://intention.example.net/en/38200 https://haven.example.com/en/61 http://blog.tradition.example.net/es/5/
https://carpenter.example.net/en/913 http://bridge.example.com/de/207 https://www.anthem.example.org/en/11
https://m.thread.example.net/fr/6060 http://wheat.example.com/es/18 https://blog.leather.example.net/en/350
""".split()
UNWANTED = """
https://casino-win.example.com/en/12 http://www.big-casino.example.net/de/431 https://blog.casino-bonus.example.org/fr/77.html
https://cheap-pills.example.org/en/9021 http://m.pills-online.example.com/es/58 https://cheap-meds.example.net/en/300
https://www.spam-farm.example.net/fr/1204 http://blog.link-farm.example.com/en/8 https://spam-links.example.com/de/66
https://free-bets.example.net/de/913/ http://bets-now.example.org/es/47 https://m.free-spins.example.net/fr/23
https://ads-track.example.com/de/15.html https://ads-click.example.net/en/5150 http://www.track-click.example.com/en/640
https://blog.adult-x.example.org/es/72/ https://adult-cams.example.net/en/118 http://m.xxx-adult.example.com/fr/34
https://win-cash.example.net/en/22010 https://www.lucky-win.example.org/de/701 http://poker-win.example.net/es/389
https://blog.poker-bets.example.com/en/41 http://slots-free.example.net/fr/860 https://m.mega-slots.example.org/en/99
https://www.cheap-loans.example.net/es/2048 http://payday-loans.example.com/en/17 https://blog.fast-cash.example.net/de/505
https://pharma-cheap.example.org/en/33 https://diet-pills.example.com/fr/610/ http://www.pills-shop.example.net/en/7
https://click-ads.example.com/es/1313 https://m.popup-ads.example.net/en/254.html http://track-ads.example.org/de/84
https://www.free-download.example.com/en/4100 http://free-prize.example.net/fr/59 https://blog.prize-win.example.com/es/92
https://hot-adult.example.net/de/31415 http://m.xxx-cams.example.com/en/271 https://www.dating-adult.example.org/en/828
https://seo-farm.example.net/fr/1163 http://content-farm.example.com/en/640 https://blog.spam-mail.example.net/en/15
https://bets-casino.example.com/es/202 http://www.online-casino.example.net/de/73 https://m.casino-free.example.org/fr/444
https://replica-cheap.example.net/en/38200 https://cheap-watches.example.com/en/61 http://blog.spam-bots.example.net/es/5/
https://click-track.example.net/en/913 http://bonus-bets.example.com/de/207 https://www.free-casino.example.org/en/11
https://m.ads-server.example.net/fr/6060 http://ads-popup.example.com/es/18 https://blog.win-prize.example.net/en/350
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table above as (url, label); label 1 is unwanted."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for y, urls in ((0, ORDINARY), (1, UNWANTED)) for u in urls]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z as a-z."""
    return F.translate(F.regexp_extract(rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. `rules`: (verdict, host and path)."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[0] != BLOCK, r[1]))
    found = None
    for verdict, rule in ranked:
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        told = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told) if found is None else found.when(fits, told)
    return found


def grams(mark: str, text: Column) -> Column:
    """All n-grams of `text` between two dots, marked; linear in its length."""

    def of(chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), ""))),
            F.array().cast("array<string>"),
        )

    chars = F.regexp_extract_all(F.concat(F.lit("."), text, F.lit(".")), F.lit("(?s)."), F.lit(0))
    return let(chars, lambda c: F.concat(*[of(c, n) for n in SIZES]))


def buckets_of(host: Column, path: Column, buckets: int) -> Column:
    """The distinct buckets (0, 1, ...) of a URL's n-grams."""
    number = lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long")
    hashed = F.transform(F.concat(grams("h", host), grams("p", path)), lambda g: F.pmod(number(g), F.lit(buckets)).cast("int"))
    return F.array_distinct(hashed)


def scale(features: Column) -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double"))


def margin(features: Column, weights: Column, bias: Column) -> Column:
    total = F.aggregate(features, F.lit(0.0), lambda s, b: s + F.get(weights, b))
    return total * scale(features) + bias


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def train(
    labelled: DataFrame, buckets: int = BUCKETS, steps: int = 200, rate: float = 12.0, decay: float = 0.0002,
    unwanted: float = 0.25, most: int = MOST_LABELLED,
) -> DataFrame:
    """One row, `weights`, learned from `labelled` (url, label 0 or 1).

    `unwanted` is the share of unwanted URLs to be expected: it sets the bias, so a URL that tells nothing
    gets this score, and what the rows of label 1 weigh together, whatever their number.
    """
    rows = labelled.filter(F.col("label").isNotNull()).select(
        "url", (F.col("label") > 0).cast("double").alias("label")
    )
    urls = rows.groupBy("url", "label").agg(F.count("*").cast("double").alias("times"))
    distinct = urls.count()
    if distinct > most:
        raise ValueError(f"{distinct} labelled URLs, at most {most} are one row of the training expression")
    urls = urls.select(
        "label", "times", buckets_of(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("features"),
        F.col("url").alias("url"),
    )
    one = urls.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "label", "times", "features"))).alias("urls"))
    numbered = one.select(F.posexplode("urls").alias("no", "u")).select("no", F.explode("u.features").alias("bucket"))
    lists = numbered.groupBy("bucket").agg(F.sort_array(F.collect_list("no")).alias("members"))
    table = (
        labelled.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(lists, "bucket", "left")
        .groupBy().agg(F.sort_array(F.collect_list(F.struct(
            "bucket", F.coalesce("members", F.array().cast("array<int>")).alias("members"),
        ))).alias("table"))
        .select(F.col("table.members").alias("members"))
    )
    # Two tables of one row each, side by side.
    both = one.select("urls", table.scalar().alias("members"))

    bias = F.lit(math.log(unwanted / (1.0 - unwanted)))

    def step(weights: Column, _: Column) -> Column:
        def error(u: Column) -> Column:
            return (sigmoid(margin(u["features"], weights, bias)) - u["label"]) * u["share"]

        def moved(errors: Column) -> Column:
            pulls = F.zip_with(errors, "shares", lambda e, u: e * u["scale"])
            return let(pulls, lambda pulls: F.zip_with(
                weights, "members",
                lambda w, m: w - rate * (F.aggregate(m, F.lit(0.0), lambda s, u: s + F.get(pulls, u)) + decay * w),
            ))

        return let(F.transform("shares", error), moved)

    def of_class(label: float) -> Column:
        return F.aggregate("urls", F.lit(0.0), lambda s, u: s + F.when(u["label"] == label, u["times"]).otherwise(0.0))

    def weight(label: Column) -> Column:
        return F.when(label == 1.0, F.lit(unwanted) / F.col("ones")).otherwise(F.lit(1.0 - unwanted) / F.col("zeros"))

    weighed = both.select("members", "urls", of_class(0.0).alias("zeros"), of_class(1.0).alias("ones")).select(
        "members",
        F.transform("urls", lambda u: F.struct(
            u["features"].alias("features"), u["label"].alias("label"), scale(u["features"]).alias("scale"),
            (u["times"] * weight(u["label"])).alias("share"),
        )).alias("shares"),
    )
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(0.0), buckets), step)
    return stored(weighed.select(F.concat(fitted, F.array(bias)).alias("weights")), "url-weights")


def judge(pages: DataFrame, model: DataFrame, rules: list[tuple[str, str]], buckets: int = BUCKETS, threshold: float = 0.5) -> DataFrame:
    """`pages` (with `url`) plus host, path, rule, score (of the regression, 1 is unwanted) and verdict."""
    added = {"host", "path", "rule", "score", "verdict"}
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in added])
    weights, features = free_name(kept, "weights"), free_name(kept, "features")
    cut = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ready = cut.withColumns({
        weights: model.select("weights").scalar(), features: buckets_of(F.col("host"), F.col("path"), buckets),
        "rule": rule_of(F.col("host"), F.col("path"), rules),
    })
    scored = ready.withColumn("score", sigmoid(margin(F.col(features), F.col(weights), F.get(F.col(weights), F.lit(buckets)))))
    guess = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    judged = scored.withColumns({"rule": F.col("rule.rule"), "verdict": F.coalesce("rule.verdict", guess)})
    return judged.select(*[F.col(f"`{c}`") for c in kept.columns], "host", "path", "rule", "score", "verdict")
