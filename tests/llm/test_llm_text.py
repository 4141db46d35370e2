"""Byte hashing helpers, token files, language, perplexity rules and toxicity against plain Python."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import language, perplexity, text, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "A b\x0bc", "é È x", "中文 😀", " lead", "trail ", "x" * 3000, "<|endoftext|> <|startoftext|>x", "\x01 b\x01", "İstanbul ΣΑΣ. ΣΑΣ", "é ́a", "it's 12 $$ don't"]


def some_texts(n=60, seed=4):
    random.seed(seed)
    return ODD + [" ".join(random.choice(["the", "of", "Ab", "c,", "d\n", "zz"]) for _ in range(random.randrange(1, 60))) for _ in range(n)]


def test_words_hash_alike_wherever_they_stand():
    texts = some_texts()
    for offset in (0, 3):
        column = pa.array(texts)[offset:]
        words, starts, first = text.words_of(text.texts_of(column), lower=True)
        seen = defaultdict(set)
        for i, t in enumerate(texts[offset:]):
            expected = WORD.findall((t or "").translate(LOWER))
            own = words[first[i] : first[i + 1]]
            assert len(own) == len(expected)
            for w, h in zip(expected, own.tolist()):
                seen[w].add(h)
        assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_shingles():
    words = np.arange(1, 8, dtype=np.uint64)
    assert len(text.shingles_of(words, 5)) == 3 and len(text.shingles_of(words[:3], 5)) == 1 and len(text.shingles_of(words[:0], 5)) == 0
    assert text.shingles_of(words, 5)[1] == text.shingles_of(words[1:], 5)[0]


def test_long_words_cross_pieces(monkeypatch):
    monkeypatch.setattr(text, "PIECE", 16)
    column = pa.array(["aa " * 30, "b" * 100 + " aa", None, "aa"])
    words, _, first = text.words_of(text.texts_of(column), lower=False)
    assert len(set(words[:30].tolist())) == 1 and words[0] == words[-1] == words[first[1] + 1]


# Token files


def test_token_files_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [(100 - k, t, "x") for k, t in enumerate(some_texts())] + [(None, "null id", "x"), (5, "tie", "x"), (5, "tie", "x"), (5, "other", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    plain = Tokenizer.from_file(path)
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [2]
    for by_words, vocabulary in ((True, 1 << 16), (False, 1 << 20)):
        out = token_files.read_token_files(spark, token_files.write_token_files(df, path, 2, by_words=by_words, vocabulary=vocabulary), ids_per_batch=200).collect()
        at = 0
        for r in sorted(out, key=lambda r: r["start"]):
            own = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] == at and r["n_tokens"] == len(own) and own[-1] == 2
            at += len(own)
        got = Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in out)
        assert got == Counter((i, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, _ in rows)
        order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
        assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.read_token_files(spark, token_files.write_token_files(df.limit(0), path, 2)).count() == 0


def test_letters_go_straight_to_the_model(monkeypatch, tmp_path):
    """Before, every new word went through all steps of the tokenizer, most of the time of a task."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    letters = [f"Word{a}{b}nes" for a in "abcXYZ" for b in "defghi"]
    odd = ["dog's", "'s", "it's,", "a<|endoftext|>", "<|endoftext|>,", "abc<|", "e\u0301t", "\u212aelvin", "\u0130x", "a1b", "...", "x" * 65, "caf\u00e9.", "a.b", "a.\u0301"]
    texts = [" ".join([*letters, *(x + t for x in letters for t in (".", ",***", "\"", "&%$)"))]), " ".join(odd), None, "\tI'll\n(we) ZEBRA!"]
    encoder, whole = token_files.WordEncoder(path, "<u2"), token_files.TextEncoder(path, "<u2")
    sent = []
    monkeypatch.setattr(encoder, "ids", lambda t, ids=encoder.ids: sent.append(t) or ids(t))
    for part in (texts[:1], texts):
        column = pa.array(part, pa.string())
        for got, wanted in zip(encoder.encode(column), whole.encode(column), strict=True):
            assert got.tolist() == wanted.tolist()
        if len(part) == 1:
            assert sorted(sent) == sorted([".", ",***", "\"", "&%$)"])
    other = json.loads(Path(path).read_text())
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(other))
    cased = token_files.WordEncoder(str(tmp_path / "cased.json"), "<u2")
    column = pa.array(texts, pa.string())
    assert not cased.by_runs and encoder.by_runs
    assert cased.encode(column)[0].tolist() == token_files.TextEncoder(str(tmp_path / "cased.json"), "<u2").encode(column)[0].tolist()


def test_word_encoder_forgets_and_agrees(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_files.WordEncoder, "REMEMBERED", 20)
    path = P.path("word_bpe_49k.json")
    texts = [*some_texts(200, 9), "x" * 500, " \x01 a\x01b <|endoftext|>", "", None]
    by_words, whole = token_files.WordEncoder(path, "<u2"), token_files.TextEncoder(path, "<u2")
    for k in range(0, len(texts), 20):  # each part forgets what the one before learned
        some = pa.array(["outside", *texts[k : k + 20]], pa.string()).slice(1)
        (a, n), (b, m) = by_words.encode(some), whole.encode(some)
        assert a.dtype == b.dtype and a.tolist() == b.tolist() and n.tolist() == m.tolist()


# Language


def languages(n, seed):
    random.seed(seed)
    words = {"en": "the of and to in that with this".split(), "fr": "le la des une pour dans les être".split(), "de": "der die und das nicht über ist ein".split()}
    return [(i, " ".join(random.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(random.choices(list(words), k=n))]


def test_language_held_out_accuracy_and_odd_texts(spark):
    train = [(i, t, lang, "x") for i, t, lang in languages(300, 1)] + [(1, None, "en", "x"), (2, "le le", None, "x")]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string, lang_pred string"))
    assert model.languages == ("de", "en", "fr")
    test = [(i, t, lang) for i, t, lang in languages(100, 2)]
    odd = [(1000 + k, t, None) for k, t in enumerate([None, "", "123 $$", "\n", "中文" * 5, "le " * 5000])]
    df = spark.createDataFrame(test + odd, "doc_id long, text string, lang_pred string")
    out = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in test]) > 0.95
    assert [out[1000 + k]["lang_pred"] for k in range(4)] == ["und"] * 4 and out[1000]["score"] == 0
    assert out[1004]["lang_pred"] in model.languages and out[1005]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == len(test) + len(odd)


def test_language_scores_match_plain_sums(spark):
    rows = languages(60, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, orders=(1, 2), bits=12)
    for t in ("le une über", "The of"):
        total = np.array(model.log_prior)
        lower, _ = language.characters()
        codes = lower[[ord(c) for c in t]]
        mixed = text.mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
        for n in (1, 2):
            for k in range(len(codes) - n + 1):
                h = 0
                for c in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + int(mixed[codes[k + c]])) % (1 << 64)
                total = total + model.log_probability[:, int(text.mixed(np.array([(h + n) % (1 << 64)], dtype=np.uint64))[0]) >> 52]
        _, score = language.scores(pa.array([t]), model)
        assert score[0] == pytest.approx(np.exp(total.max()) / np.exp(total).sum(), rel=1e-9)


def test_language_without_teachers(spark):
    df = spark.createDataFrame([(1, "le la", None)], "doc_id long, text string, lang string")
    assert language.predict(df, language.train(df)).first()["lang_pred"] == "und"
    assert language.predict(df.limit(0), language.train(df)).count() == 0


# Perplexity


def base(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_counts():
    texts = some_texts(150) + ["a b c d e a b c d e", "x\nx\n x\nx", "a|b#\n\na|b#\n", "q q q q q q q"]
    got = perplexity.base_counts(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in perplexity.BASE])) == [base(t) for t in texts]


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over characters, from dictionaries."""
    normal = ["".join("0" if "0" <= c <= "9" else " " if c <= " " else c for c in t or "") for t in texts]
    counts = [None] * (order + 1)
    counts[order] = Counter(t[i : i + order] for t in normal for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def cuts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k * 0.95) for k, x in zip((1, 2, 3), d)]

    p = [None] * (order + 1)
    d = cuts(counts[1])
    total = sum(counts[1].values())
    mass = sum(d[min(v, 3) - 1] for v in counts[1].values()) / total / (len(counts[1]) + 1)
    p[1] = {g: (v - d[min(v, 3) - 1]) / total + mass for g, v in counts[1].items()}
    for n in range(2, order + 1):
        d = cuts(counts[n])
        sums, cut = Counter(), Counter()
        for g, v in counts[n].items():
            sums[g[:-1]] += v
            cut[g[:-1]] += d[min(v, 3) - 1]
        p[n] = {g: (v - d[min(v, 3) - 1]) / sums[g[:-1]] + cut[g[:-1]] / sums[g[:-1]] * p[n - 1][g[1:]] for g, v in counts[n].items()}
    return [-np.mean([np.log(p[order][t[i : i + order]]) for i in range(len(t) - order + 1)]) if len(t) >= order else None for t in normal]


def test_perplexity_matches_dictionaries(spark):
    texts = [t for t in some_texts(40) if t is None or "\x01" not in t]
    rows = [(k, t, None if k % 7 == 0 else "en", "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").repartition(3)
    out = {r["doc_id"]: r for r in perplexity.judged(df, perplexity.train(df)).collect()}
    assert len(out) == len(texts)
    for k, want in enumerate(kneser_ney(texts, perplexity.ORDER)):
        got = out[k]["log_perplexity"]
        assert got is None if want is None else got == pytest.approx(want, rel=1e-5)
        n_words, _, _, _, repeat = base(texts[k])
        assert out[k]["base_failed"] == (n_words < 10 or 100 * repeat > 20 * n_words)
        assert not (out[k]["kept"] and out[k]["base_failed"])


def test_unseen_ngrams_back_off_and_outliers_go(spark):
    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa"]
    clean = [(k, " ".join(random.choices(words, k=40)), "en") for k in range(200)]
    folder = perplexity.train(spark.createDataFrame(clean, "doc_id long, text string, lang string"))
    junk = [(900, " ".join("".join(random.choices("qxzjkvw", k=6)) for _ in range(40)), "en")]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in perplexity.judged(df, folder).collect()}
    assert not out[900]["kept"] and out[900]["log_perplexity"] > 3
    assert np.mean([out[k]["kept"] for k in range(200) if not out[k]["base_failed"]]) == 1
    assert perplexity.judged(df.limit(0)).count() == 0


def test_planted_junk_goes_without_a_model(spark):
    """Texts judged by a model of the same rows: junk of all lengths goes, copies of it too, clean rows stay."""
    random.seed(3)
    parts = ["ther", "ing", "and", "est", "wh", "ou", "en", "ly", "ble", "re"]
    words = ["".join(random.choices(parts, k=random.randrange(1, 4))) for _ in range(300)]
    line = lambda n: " ".join(random.choices(words, k=n))
    clean = [(k, line(random.randrange(15, 400)), "en") for k in range(400)]
    letters = lambda n: " ".join("".join(random.choices("qxzjkvwyupf", k=random.randrange(2, 9))) for _ in range(n))
    symbols = lambda n: " ".join(random.choice(words) + random.choice(["###", "$$$", "***"]) for _ in range(n))
    junk = [letters(n) for n in (12, 15, 60, 600)] + [letters(12)] * 2 + [letters(200)] * 6 + [symbols(12)] * 4 + [symbols(100)]
    odd = [(1000 + k, t, "en") for k, t in enumerate(junk)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in perplexity.judged(df).collect()}
    assert [out[k]["kept"] for k, _, _ in odd] == [False] * len(odd) and not any(out[k]["base_failed"] for k, _, _ in odd)
    assert np.mean([out[k]["kept"] for k, _, _ in clean if not out[k]["base_failed"]]) > 0.98


def test_arrays_in_several_ranges(spark):
    random.seed(1)
    grams = spark.range(2000).select((F.col("id") * 7919).alias("hi"), (F.col("id") * 104729).alias("lo"), F.col("id").cast("double").alias("value"))
    from shelfscope.llm.storage import shared_folder

    folder = token_files.normal(shared_folder(spark, "arrays"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = perplexity.write_arrays(grams, folder, "p1").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) > 1
    fs, root = token_files.file_system(folder)
    arrays = perplexity.Arrays(fs, root, "p1", [(r["part"], r["n"]) for r in found])
    ids = np.arange(2000)
    values = arrays.find(perplexity.key_of(ids * 7919, ids * 104729))
    assert values.tolist() == ids.tolist()
    assert np.isnan(arrays.find(perplexity.key_of(ids * 7919 + 1, ids))).all()


# Toxicity


def toxic_rows(n, seed):
    random.seed(seed)
    out = []
    for k in range(n):
        words = [random.choice("abcdefghij") + random.choice("klmnop") + str(random.randrange(40)) for _ in range(random.randrange(5, 60))]
        bad = random.random() < 0.3
        if bad:
            words.insert(random.randrange(len(words)), random.choice(["Vile,", "rotten", "scum!"]))
        out.append((k, " ".join(words), int(bad), random.choice(["en", "fr"])))
    return out


def test_toxicity_held_out(spark):
    rows = spark.createDataFrame(toxic_rows(700, 1), "doc_id long, text string, label int, lang string")
    labels = rows.select("doc_id", "label").unionByName(spark.createDataFrame([(1, None), (None, 1), (99999, 1), (2, 7)], "doc_id long, label int"))
    model = toxicity.train(rows, labels, least_per_language=5)
    test = toxic_rows(200, 2)
    odd = [(1000, None, 0, None), (1001, "", 0, None), (1002, "scum", 1, None), (1003, "a " * 5000, 0, None)]
    df = spark.createDataFrame(test + odd, "doc_id long, text string, label int, score string")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, _, y, _ in test]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and out[1000] == out[1001] and out[1002] >= 0.5 > out[1003]


def test_pooling_matches_plain_loops():
    random = np.random.default_rng(0)
    known, first = toxicity.buckets_of(pa.array(["one two", "four"]))
    net = toxicity.initial([known[: first[1]], known[first[1] :]], np.array([0, 1]), random)
    column = pa.array(["one two three four", "", None, "x", "two one"])
    buckets, first = toxicity.buckets_of(column)
    got = toxicity.pooled(net, buckets, first)
    for i in range(5):
        own = buckets[first[i] : first[i + 1]]
        n = len(own) - 2
        want = np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS)
        for k, width in enumerate(toxicity.WIDTHS):
            for at in range(n):
                answer = net.biases[k] + sum(net.embedding[own[at + j]].sum(axis=0) @ net.filters[k][j] for j in range(width))
                part = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
                want[part] = np.maximum(want[part], answer)
        assert np.allclose(got[i], want, atol=1e-5)


def test_toxicity_without_or_with_one_label(spark):
    df = spark.createDataFrame([(1, "a b", 1, "en"), (2, "c", None, "en"), (3, "d", 5, "en")], "doc_id long, text string, label int, lang string")
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, df)).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, df.limit(0))).collect()} == {0.0}


def test_every_labelled_row_teaches_with_its_whole_text(spark):
    far = "plain words " * 9000
    rows = [(k, far + f"scum w{k}" if k % 2 else f"plain words w{k}", k % 2, "en") for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, lang string")
    model = toxicity.train(df, df)
    asked = spark.createDataFrame([(1, far + "scum"), (2, far)], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(asked, model).collect()} == {1: True, 2: False}
    many = spark.range(6500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), (F.col("id") % 2).cast("int").alias("label"), F.lit("en").alias("lang"))
    taught = toxicity.taught(many, many, 1000)
    assert taught.count() == 6500 and taught.rdd.getNumPartitions() == 7
    assert toxicity.seen_in(taught)[:, : 1 << toxicity.BITS].sum(axis=1).tolist() == [3250, 3250]
    taught.unpersist()


def test_replicas_learn_together_and_reruns_agree(spark):
    rows = spark.createDataFrame(toxic_rows(700, 1), "doc_id long, text string, label int, lang string")
    models = [toxicity.train(rows.repartition(n), rows, least_per_language=5, rows_each=150) for n in (1, 4)]
    assert np.array_equal(models[0].network.embedding, models[1].network.embedding) and models[0].thresholds == models[1].thresholds
    test = toxic_rows(200, 2)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string, label int, lang string"), models[0]).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, _, y, _ in test]) > 0.95


def test_threshold_of_bins_against_every_cut():
    random_ = np.random.default_rng(5)
    low = np.sort(random_.normal(size=30))
    zeros, ones = random_.integers(0, 9, 30), random_.integers(0, 9, 30)
    f1 = lambda cut: 2 * ones[low >= cut].sum() / ((ones + zeros)[low >= cut].sum() + ones.sum())
    got = toxicity.best_threshold(low, low, zeros, ones)
    assert f1(got) == max(f1(cut) for cut in [*low, low[-1] + 1]) and got not in low
