"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (lower-cased over A-Z, ASCII punctuation left out) is the sum of three hashed embeddings: of two
independent buckets of the word, so that a collision in one does not make two words alike, and of its
first four bytes, so that inflected forms are near each other. Filters of several widths slide over a text, each keeps its largest answer over the whole text, and a
logistic layer scores them. Every labelled row teaches, with its whole text: rows are dealt to replicas,
which run Adam over their rows in tasks; after each epoch Spark averages them (an embedding by how often
each replica moved it) and the next epoch starts there. A fourth of the rows, chosen by hash, is left out
of that and calibrates thresholds per language, from counts by logit that Spark adds up. Which language a text is
in comes from its characters (the Bayes classifier of `language`, learned on all labelled rows), never from a
column. Scoring reads every whole text in tasks. What reaches the driver is of the size of the model.

Replicas are dealt by hash and averaged in whole numbers, so reruns agree.

Defined results: null and empty text are scored by the bias alone; a text shorter than a filter is padded;
labels other than 0 and 1, null labels, ids without a text and null texts teach nothing; with labels of one kind only, that
kind's share is everybody's score; without labels every score is 0. Several labels of a row count each.
Columns of the input pass through; score is replaced where the input has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm import language
from shelfscope.llm.text import SEPARATORS, U64, Texts, batches_of, byte_values, mixed, run_hashes, texts_of, word_starts

BITS = 17
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
PARTS = 3
BEGINNING = 4
PAD = PARTS << BITS
AT_ONCE = 1 << 20
#: Labelled rows of a replica, and replicas at most: each sends up to 28 MB an epoch.
ROWS_EACH = 4096
REPLICAS = 64
#: Labels (id and label) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Parameters are averaged in whole multiples of this, logits are counted in bins of the other.
UNIT = 2.0**-20
BIN = 2.0**-8


def beginnings(texts: Texts, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the first bytes of every word."""
    out = np.zeros(len(starts), dtype=U64)
    inside = np.ones(len(starts), dtype=bool)
    ends = texts.ends[np.searchsorted(texts.ends, starts, side="right")]
    for k in range(BEGINNING):
        inside &= starts + k < ends
        byte = texts.data[np.minimum(starts + k, len(texts.data) - 1)]
        inside &= ~SEPARATORS[byte]
        out = out * U64(0x9E3779B97F4A7C15) + np.where(inside, values[byte], U64(0))
    return mixed(out)


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """PARTS buckets per word, with padding after each text, and where each text begins (one more at the end)."""
    texts = texts_of(column)
    starts = word_starts(texts)
    values = byte_values(True, True).copy()
    values[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0
    words = run_hashes(texts, starts, values)
    hashes = [words, mixed(words), beginnings(texts, starts, values) if len(starts) else words]
    first = np.searchsorted(starts, texts.ends)
    room = max(WIDTHS) - 1
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    out = np.full((len(words) + room * len(texts), PARTS), PAD, dtype=np.int32)
    for k, h in enumerate(hashes):
        out[np.arange(len(words)) + room * owner, k] = (h >> U64(64 - BITS)).astype(np.int32) + (k << BITS)
    return out, first + room * np.arange(len(first))


def vectors_of(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return sum(embedding[buckets[:, k]] for k in range(PARTS))


@dataclass
class Network:
    """Embeddings, filters per width (width x SIZE x FILTERS) with biases, and the logistic layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights]


@dataclass
class Model:
    """The network, the language classifier and the logit that counts as one half, by language."""

    network: Network | None
    languages: language.Model | None
    thresholds: dict[str, float]
    constant: float = 0.0


def pooled(network: Network, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest answer of every filter over each text, at least 0."""
    room = max(WIDTHS) - 1
    n_texts = len(first) - 1
    n_words = np.diff(first) - room
    out = np.zeros((n_texts, len(WIDTHS) * FILTERS), dtype=np.float32)
    full = np.flatnonzero(n_words > 0)
    if not len(full):
        return out
    edges = np.stack([first[full], first[full] + n_words[full]], axis=1).ravel()
    if edges[-1] >= len(buckets):
        edges = edges[:-1]
    vectors = vectors_of(network.embedding, buckets)
    for k, width in enumerate(WIDTHS):
        answers = network.biases[k] + sum(
            vectors[j : len(vectors) - (width - 1 - j)] @ network.filters[k][j] for j in range(width)
        )
        tail = np.zeros((len(buckets) - len(answers), FILTERS), dtype=np.float32)
        answers = np.concatenate([answers, tail]) if width > 1 else answers
        out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(answers, edges, axis=0)[::2]
    return np.maximum(out, 0)


def logits(network: Network, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    return pooled(network, buckets, first) @ network.weights + network.bias


def initial(buckets: list[np.ndarray], labels: np.ndarray, random: np.random.Generator) -> Network:
    """The network before training on texts given by their `buckets`."""
    seen = np.zeros((2, PAD + 1))
    for own, label in zip(buckets, labels, strict=True):
        seen[int(label), np.unique(own)] += 1
    return initial_of(seen, np.array([len(labels) - labels.sum(), labels.sum()]), random)


def initial_of(seen: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> Network:
    """Small random numbers; the first embedding coordinate starts as the log odds of the labels of the
    texts that hold the bucket, which the first filter of each width reads. `seen` holds the number of
    texts per label and bucket, `rows` per label."""
    odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
    odds *= np.minimum(1, seen.sum(axis=0) / 8)
    embedding = random.normal(0, 0.03, (PAD + 1, SIZE)).astype(np.float32)
    embedding[:, 0] = odds / (2 * PARTS)
    embedding[PAD] = 0
    filters = [random.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1
    weights = random.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    weights[::FILTERS] = 1
    return Network(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights, -1.0)


def seen_in(rows: DataFrame) -> np.ndarray:
    """The number of texts of `rows` (text, label) per label and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, PAD + 1), dtype=np.int64)
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                buckets, first = buckets_of(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                once = np.unique((owner[:, None] * (PAD + 1) + buckets).ravel())
                label = np.asarray(part.column("label"))[once // (PAD + 1)]
                for k in (0, 1):
                    seen[k] += np.bincount(once[label == k] % (PAD + 1), minlength=PAD + 1)
        held = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[0, held]), pa.array(seen[1, held])], names=["bucket", "zeros", "ones"])

    counts = rows.select("text", "label").mapInArrow(count, "bucket int, zeros long, ones long")
    table = counts.groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((2, PAD + 1))
    out[:, np.asarray(table.column("bucket"))] = [table.column("zeros"), table.column("ones")]
    return out


class Learner:
    """Adam on the weighted logistic loss, from a network on; `share` is the weight of a row by label."""

    def __init__(self, network: Network, share: np.ndarray, rate: float) -> None:
        self.net = Network(
            network.embedding.copy(), [f.copy() for f in network.filters], [b.copy() for b in network.biases], network.weights.copy(), network.bias,
        )
        self.share, self.rate, self.steps, self.rows = share, rate, 0, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.net.parameters()]
        self.bias_moments = [0.0, 0.0]
        self.moved = np.zeros(PAD + 1, dtype=np.int32)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """One step on texts of a word or more, given by their padded buckets."""
        net, room = self.net, max(WIDTHS) - 1
        lengths = np.array([len(x) for x in texts])
        starts = np.cumsum(lengths) - lengths
        own = np.concatenate(texts)
        vectors = vectors_of(net.embedding, own)
        filter_ = np.arange(FILTERS)
        peaks, values = [], []
        for k, width in enumerate(WIDTHS):
            answers = net.biases[k] + sum(vectors[j : len(vectors) - (width - 1 - j)] @ net.filters[k][j] for j in range(width))
            peak = np.stack([at + answers[at : at + n - room].argmax(axis=0) for at, n in zip(starts, lengths, strict=True)])
            peaks.append(peak)
            values.append(np.maximum(answers[peak, filter_], 0))
        hidden = np.concatenate(values, axis=1)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.bias, -30, 30)))
        error = ((p - labels) * self.share[labels] / len(texts)).astype(np.float32)
        back = error[:, None] * net.weights * (hidden > 0)
        filter_gradients = [np.zeros_like(f) for f in net.filters]
        bias_gradients, touched, pulls = [], [], []
        for k, width in enumerate(WIDTHS):
            pull = back[:, k * FILTERS : (k + 1) * FILTERS]
            bias_gradients.append(pull.sum(axis=0))
            text, which = np.nonzero(pull)
            for j in range(width):
                filter_gradients[k][j] = np.einsum("bfs,bf->sf", vectors[peaks[k] + j], pull)
                touched.append(own[peaks[k][text, which] + j])
                pulls.append(net.filters[k][j].T[which] * pull[text, which][:, None])
        self.move([*filter_gradients, *bias_gradients, error @ hidden], float(error.sum()), np.concatenate(touched), np.concatenate(pulls))
        self.rows += len(texts)

    def move(self, gradients: list[np.ndarray], bias_gradient: float, touched: np.ndarray, pulls: np.ndarray) -> None:
        net = self.net
        self.steps += 1
        fix1, fix2 = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        if len(touched):
            order = np.argsort(touched, axis=None, kind="stable")
            ids = touched.ravel()[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            sums = np.add.reduceat(pulls[order // PARTS], first, axis=0)
            ids = ids[first]
            sums[ids == PAD] = 0
            m, v = self.moments[0]
            m[ids] = 0.9 * m[ids] + 0.1 * sums
            v[ids] = 0.999 * v[ids] + 0.001 * sums**2
            net.embedding[ids] -= self.rate * (m[ids] / fix1) / (np.sqrt(v[ids] / fix2) + 1e-6)
            self.moved[ids] += 1
        for p, g, (m, v) in zip(net.parameters()[1:], gradients, self.moments[1:], strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            p -= self.rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
        one, two = self.bias_moments
        self.bias_moments = [0.9 * one + 0.1 * bias_gradient, 0.999 * two + 0.001 * bias_gradient**2]
        net.bias -= self.rate * (self.bias_moments[0] / fix1) / (np.sqrt(self.bias_moments[1] / fix2) + 1e-6)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was learned, as lines of SIZE numbers: place, weight in the mean, and the numbers in UNITs."""
        ids = np.flatnonzero(self.moved)
        dense = dense_of(self.net)
        places = np.concatenate([ids, PAD + 1 + np.arange(len(dense))])
        weights = np.concatenate([self.moved[ids], np.full(len(dense), self.rows)])
        numbers = np.concatenate([self.net.embedding[ids], dense])
        return places.astype(np.int32), weights.astype(np.int64), np.round(np.clip(numbers, -2000, 2000) / UNIT).astype(np.int32)


def dense_of(network: Network) -> np.ndarray:
    """All parameters but the embedding in lines of SIZE numbers, the last one filled with zeros."""
    flat = np.concatenate([*[p.ravel() for p in network.parameters()[1:]], [network.bias]])
    return np.concatenate([flat, np.zeros(-len(flat) % SIZE)]).reshape(-1, SIZE)


def with_lines(network: Network, places: np.ndarray, numbers: np.ndarray) -> Network:
    """`network` with the lines at `places` replaced."""
    embedding, dense = network.embedding.copy(), dense_of(network)
    inner = places <= PAD
    embedding[places[inner]] = numbers[inner]
    dense[places[~inner] - PAD - 1] = numbers[~inner]
    flat, parts, at = dense.ravel().astype(np.float32), [], 0
    for p in network.parameters()[1:]:
        parts.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return Network(embedding, parts[: len(WIDTHS)], parts[len(WIDTHS) : -1], parts[-1], float(flat[at]))


def epoch_over(rows: DataFrame, network: Network, share: np.ndarray, rate: float, seed: int, batch_rows: int = 32) -> Network:
    """The mean of the networks to which each partition of `rows` (text, label) has trained `network`."""
    sent = rows.sparkSession.sparkContext.broadcast(network)
    numbers = [f"x{k}" for k in range(SIZE)]

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, learner = np.random.default_rng(seed), None
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                buckets, first = buckets_of(part.column("text"))
                labels = np.asarray(part.column("label"))
                order = random.permutation(np.flatnonzero(np.diff(first) > max(WIDTHS) - 1))
                for at in range(0, len(order), batch_rows):
                    learner = learner or Learner(sent.value, share, rate)
                    some = order[at : at + batch_rows]
                    learner.learn([buckets[first[r] : first[r + 1]] for r in some], labels[some])
        if learner:
            places, weights, values = learner.lines()
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights), *[pa.array(values[:, k]) for k in range(SIZE)]], names=["place", "weight", *numbers])

    lines = rows.select("text", "label").mapInArrow(teach, f"place int, weight long, {', '.join(f'{x} int' for x in numbers)}")
    means = lines.groupBy("place").agg(*[(F.sum(F.col(x).cast("long") * F.col("weight")) * F.lit(UNIT) / F.sum("weight")).cast("float").alias(x) for x in numbers])
    table = means.toArrow()
    sent.destroy()
    return with_lines(network, np.asarray(table.column("place")), np.stack([np.asarray(table.column(x)) for x in numbers], axis=1))


def best_threshold(low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The logit between two bins at which F1 of label 1 is highest; in the middle of the widest best gap. Bins in
    ascending order: their least and largest logit, and the number of texts by label."""
    above = lambda n: np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
    right, called = above(ones), above(ones + zeros)
    f1 = 2 * right / np.maximum(called + ones.sum(), 1)
    left, end = np.concatenate([[low[0] - 2], high]), np.concatenate([low, [high[-1] + 2]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[(end - left)[best].argmax()]
    return float((left[k] + end[k]) / 2)


def thresholds_of(rows: DataFrame, model: Model, least_per_language: int) -> dict[str, float]:
    """The best threshold over `rows` (text, label), under '', and of every language with `least_per_language`
    texts of either label; from counts by language and BIN of the logit."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                column = part.column("text")
                values = logits(sent.value.network, *buckets_of(column)).astype(np.float64)
                names = pa.array(languages_of(column, sent.value.languages), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(values), part.column("label")], names=["lang", "value", "label"])

    found = rows.select("text", "label").mapInArrow(answer, "lang string, value double, label int")
    place = F.floor(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "value")) / F.lit(BIN))
    counts = found.groupBy("lang", place.alias("bin")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum(1 - F.col("label")).alias("zeros"), F.sum("label").alias("ones")
    ).toPandas()
    sent.destroy()
    whole = counts.groupby("bin", as_index=False).agg({"low": "min", "high": "max", "zeros": "sum", "ones": "sum"})
    out = {}
    for name, own in [("", whole), *counts[counts.lang != ""].groupby("lang")]:
        own = own.sort_values("bin")
        columns = [own[c].to_numpy() for c in ("low", "high", "zeros", "ones")]
        if name == "" or min(columns[2].sum(), columns[3].sum()) >= least_per_language:
            out[name] = best_threshold(*columns)
    return out


def taught(docs: DataFrame, labels: DataFrame, rows_each: int) -> DataFrame:
    """(text, lang, label, left_out) of all rows of `docs` with a text and a label, a partition per replica, in an
    order by hash. Kept on the executors' disks, as every epoch reads it."""
    chosen = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    n = chosen.count()
    key = F.xxhash64("doc_id", "text", "label")
    rows = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL").join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, "doc_id")
    rows = rows.select("text", "lang", "label", (F.pmod(key, F.lit(4)) == 0).alias("left_out"), key.alias("key"))
    dealt = rows.repartition(min(REPLICAS, 1 + n // rows_each), "key").sortWithinPartitions("key", "text", "label")
    return dealt.persist(StorageLevel.DISK_ONLY)


def train(
    docs: DataFrame, labels: DataFrame, epochs: int = 4, rate: float = 0.01, seed: int = 3, least_per_language: int = 20,
    rows_each: int = ROWS_EACH,
) -> Model:
    """The model of `docs` (doc_id, text, lang) labelled by `labels` (doc_id, label); lang only teaches the
    language classifier.

    A fourth of the labelled rows is left out of the network and calibrates the thresholds, unless it or the
    rest is of one label only; a language with fewer than `least_per_language` left-out texts of either
    label takes the threshold of all. `rows_each` is about the number of rows of a replica.
    """
    rows = taught(docs, labels, rows_each)
    try:
        n = np.zeros((2, 2), dtype=np.int64)
        for r in rows.groupBy("left_out", "label").count().collect():  # 4 rows
            n[int(r["left_out"]), r["label"]] = r["count"]
        marks = n.sum(axis=0)
        if not marks.all():
            return Model(None, None, {}, float(marks[1] / marks.sum()) if marks.any() else 0.0)
        kept, marks = (rows.filter("NOT left_out"), n[0]) if n[0].all() else (rows, marks)
        network = initial_of(seen_in(kept), marks, np.random.default_rng(seed))
        for epoch in range(epochs):
            network = epoch_over(kept, network, 0.5 * marks.sum() / marks, rate, seed + epoch)
        model = Model(network, language.train(rows), {})
        model.thresholds = thresholds_of(rows.filter("left_out") if n[1].all() else rows, model, least_per_language)
        return model
    finally:
        rows.unpersist()


def languages_of(column: pa.Array, model: language.Model | None) -> np.ndarray:
    """The predicted language of each text, '' where there is none."""
    if model is None or not model.languages:
        return np.full(len(column), "", dtype=object)
    best, _ = language.scores(column, model)
    names = np.array([*model.languages, ""], dtype=object)[best]
    return np.where(language.has_letter(column), names, "")


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Toxicity of each text, one half at the threshold of its language."""
    if model.network is None:
        return np.full(len(column), model.constant)
    buckets, first = buckets_of(column)
    values = logits(model.network, buckets, first).astype(np.float64)
    names = languages_of(column, model.languages)
    shift = np.array([model.thresholds.get(n, model.thresholds[""]) for n in names])
    return 1 / (1 + np.exp(-np.clip(values - shift, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`; only the column `text` is looked at."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                found = pa.array(scores(part.column("text"), sent.value), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "score"])

    return docs.mapInArrow(answer, schema)
