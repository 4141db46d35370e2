"""Conversation repair, spelling variants and the URL filter, against brute force and their SQL."""

import hashlib
import itertools
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import repair, repair_queries, spelling, spelling_queries, url_queries, urls

# Conversation repair.

TURNS = "conv_id long, turn long, role string, text string, gone boolean"
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """Least (cost, audit, text) over all edits, with up to two inserted turns before each row and at the end."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    added = [x for k in range(3) for x in itertools.product(("user", "assistant"), repeat=k)]
    per_row = []
    for (role, text), fault in zip(rows, faults):
        edits = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            edits += [(extra, "K", (role, text))] + [(2 + extra, "R", (r, text)) for r in ("user", "assistant")]
        per_row.append([(2 * len(a) + cost, "I" * len(a) + letter, [(r, "") for r in a] + ([turn] if turn else []))
                        for a in added for cost, letter, turn in edits])
    per_row.append([(2 * len(a), "I" * len(a), [(r, "") for r in a]) for a in added])
    best = None
    for way in itertools.product(*per_row):
        cost, audit = sum(w[0] for w in way), "".join(w[1] for w in way)
        if best is None or (cost, audit) < best[:2]:
            turns = [t for w in way for t in w[2]]
            if all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
    return best


def test_cheapest_edits_against_brute_force(spark):
    draw = random.Random(5)
    texts = ["Yes.", "no", " \t", "Why?", "Fine! ", "é…", ""]
    conversations = {
        c: [(draw.choice(["user", "assistant", "assistant", "system", "tool", ""]), draw.choice(texts)) for _ in range(draw.choice([1, 2, 2, 3]))]
        for c in range(40)
    }
    rows = [(c, i, *turn, False) for c, turns in conversations.items() for i, turn in enumerate(turns)]
    found = repair.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert len(found) == len(conversations)
    for row in found:
        cost, audit, told = cheapest(conversations[row.conv_id])
        assert (row.cost, row.audit, row.repaired_sha256) == (cost, audit, hashlib.sha256(told.encode()).hexdigest())


def test_damaged_conversations_against_sql(spark):
    assert oracle.differences(repair_queries.op11_conversation_repair(spark, oracle.SF_DIR), oracle.connect(), repair_queries.REPAIR_SQL) is None


def test_repair_of_odd_rows(spark):
    rows = [
        (None, None, "user", "Hi.", False), (None, 3, "assistant", "Ho.", False), (None, 5, "assistant", "Ho.", False),
        (1, 0, None, None, False), (2, 0, "user", "Gone.", True), (3, 7, "user", "A.", False), (3, 7, "assistant", "B.", False),
        (4, 9, "user", "x" * 300_000, False), (4, 9, "user", "x" * 300_000, False),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit("other"))
    found = {r.conv_id: r for r in repair.repair(df).collect()}
    assert (found[None].audit, found[None].gaps, found[None].duplicate, found[None].illegal) == ("KKD", 1, 1, 1)
    assert (found[1].blank, found[1].audit, found[1].gaps) == (1, "D", 0)
    assert found[2][1:] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    # Equal turns stand by role.
    assert (found[3].audit, found[3].cost, found[3].gaps) == ("IKKI", 4, 0)
    assert (found[4].truncated, found[4].duplicate, found[4].audit) == (1, 1, "DD")
    assert repair.repair(df.limit(0)).collect() == []


def test_repair_of_a_giant_conversation_spills(spark, monkeypatch):
    n = 3000
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 7 < 4, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("Turn "), F.col("id").cast("string"), F.when(F.col("id") % 5 > 0, ".").otherwise("")).alias("text"),
    )
    spilled = repair.repair(turns, held=64).collect()
    assert spilled == repair.repair(turns).collect()
    audit = spilled[0].audit
    assert len(audit.replace("I", "")) == n and audit.count("K") > n / 4


def test_repaired_turns_have_the_digest(spark):
    turns = repair_queries.damaged(spark.read.parquet(f"{oracle.SF_DIR}/conversations.parquet"))
    summaries = repair.repair(turns)
    told = repair.repaired_turns(turns, summaries).groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text"))),
                                 lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n").alias("told"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda r: F.substring(r["role"], 1, 1)), "").alias("roles"),
    )
    both = summaries.join(told, "conv_id", "left").select(
        "repaired_sha256", F.sha2(F.coalesce("told", F.lit("")), 256).alias("want"), F.coalesce("roles", F.lit("")).alias("roles"))
    for row in both.collect():
        assert row.repaired_sha256 == row.want and re.fullmatch("(s?(ua)+)?", row.roles)


# Spelling variants.


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_of_one_family(seed):
    draw = random.Random(seed)
    words = set()
    for base in ("abababab", "étéétéété", "wordword", "wordwoord", "aaaaaaaa", "zyxwvutsrq"):
        for _ in range(30):
            w = list(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                at = draw.randrange(len(w))
                w[at : at + draw.choice([0, 1])] = draw.choice([[], ["a"], ["b"], ["é"], ["ÿ"]])
            if len(w) >= 7:
                words.add("".join(w))
    return {w: draw.choice([2, 3, 20, 30, 400]) for w in sorted(words)}


@pytest.mark.parametrize("longest", [20_000, 3])
def test_groups_against_brute_force(spark, longest):
    counts = words_of_one_family(3)
    found = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), longest=longest).collect()
    assert sorted(r.word for r in found) == list(counts)
    form = {}
    for word, n in counts.items():
        near = sorted((-m, w) for w, m in counts.items() if one_edit(w, word))
        form[word] = (len(near), *((near[0][1], -near[0][0]) if near and -near[0][0] >= 10 * n else (None, None)))
    for r in found:
        root = r.word
        while form[root][1]:
            root = form[root][1]
        assert (r.n_near, r.form, r.form_n, r.root) == (*form[r.word], root)


def test_spelling_variants_against_sql(spark):
    got = spelling_queries.op12_spelling_variants(spark, oracle.SF_DIR)
    assert oracle.differences(got, oracle.connect(), spelling_queries.SPELLING_SQL) is None


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Straßenbahn STRASSENBAHN ÀÀÀÀÀÀÀ short"), (None, "straßenbahn" + " Straßenbahn" * 3), (3, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("other"))
    runs = [r.run for r in spelling.runs(docs, 7).collect()]
    assert sorted(set(runs)) == sorted({"straßenbahn", "strassenbahn", "ÀÀÀÀÀÀÀ", "x" * 300_000}) and runs.count("straßenbahn") == 5
    assert spelling.runs(docs.limit(0), 7).collect() == []
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_groups(none).collect() == []


# URL filter.

ODD = [
    (1, "HTTPS://WWW.Example.ORG/es/1?x=/fr/", "www.example.org", "/es/1", "example.org/es/", "block"),
    (2, "http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    (3, "http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    (4, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (5, "http://shop.com/de/#x", "shop.com", "/de/", "com/de/", "block"),
    (6, "http://org", "org", "", None, "allow"),
    (7, "http://casino-pills.net?a=/b", "casino-pills.net", "", None, "block"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme.org/es/", "", "", None, "allow"),
    (10, "x://É.net/Ä b\nc", "É.net", "/Ä b\nc", None, "allow"),
    (11, "a://b://c.com/fr/", "b:", "//c.com/fr/", None, "allow"),
    (12, "", "", "", None, "allow"),
]


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_urls_by_hand(spark, url_model):
    rows = [(i, u, "old", 7) for i, u, *_ in ODD] + [(99, "http://h.net/" + "a" * 200_000, "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string, weights int")
    judged = {r.page_id: r for r in urls.judge(pages, url_model, url_queries.RULES).collect()}
    assert len(judged) == len(rows) and judged[99].verdict == "allow" and judged[99].weights == 7
    for i, _, host, path, rule, verdict in ODD:
        assert (judged[i].host, judged[i].path, judged[i].rule, judged[i].verdict) == (host, path, rule, verdict)
    assert urls.judge(pages.limit(0), url_model, []).collect() == []


def test_unseen_urls_are_told_apart(spark, url_model):
    """Sites made of the table's words in other pairs, and plain words that are not in it."""
    bad = [f"https://{a}-{b}.test.net/en/{i}" for i, (a, b) in enumerate(itertools.product(("casino", "pills", "adult", "spam"), ("cash", "click", "prize", "slots")))]
    good = [f"http://{w}.test.com/fr/{i}" for i, w in enumerate("morning window market school cooking letters travel medicine pottery drawing".split())]
    pages = spark.createDataFrame([(u, "block") for u in bad] + [(u, "allow") for u in good], "url string, want string")
    judged = urls.judge(pages, url_model, [])
    assert judged.filter("verdict = want").count() >= 0.9 * (len(bad) + len(good))


def test_url_filter_against_sql(spark):
    df = url_queries.op13_url_filter(spark, oracle.SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Join", plan)
    assert oracle.differences(df, oracle.connect(), url_queries.URL_SQL) is None


def test_without_labels_rules_decide(spark):
    none = spark.createDataFrame([("http://a.net/", None)], "url string, label int")
    model = urls.train(none)
    pages = spark.createDataFrame([("http://casino.net/",), ("http://x.com/de/1",)], "url string")
    assert [r.verdict for r in urls.judge(pages, model, url_queries.RULES).orderBy("url").collect()] == ["allow", "block"]
    with pytest.raises(ValueError):
        urls.train(urls.labelled_urls(spark), most=10)
