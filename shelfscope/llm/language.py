"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in tasks and adds them up in Spark; the log-probability matrix
(languages x buckets, a bound fixed by parameters) is broadcast; scoring gathers its entries for a batch
of texts in numpy and adds them up per text.

Defined results: null text, empty text or text without a letter -> `und` with score 0; rows of null
language or null text teach nothing; without any teaching row every text is `und`; of equal scores the
first language by code point wins. The posterior only says which learned language is nearest; whether a
text is in it at all is asked by `accepted`. A repeated row teaches and is answered as often as it occurs. Other
columns pass through untouched; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.perplexity import half
from shelfscope.llm.storage import free_name, stored
from shelfscope.llm.text import U64, batches_of, mixed, texts_of

UNDETERMINED = "und"
#: Bytes of text that a task works on at a time; it holds some fifty bytes for each.
AT_ONCE = 1 << 18
#: Defaults of `accepted`. On sf0.01 real Dutch, Portuguese and others reach at most 0.54 of the median, its own
#: rows 0.73 at least.
LEAST_FIT = 0.65
SHORT = 0.5


@lru_cache(1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case one, with 0x20 for everything but letters; and whether it is a letter."""
    lower = np.full(0x110000, 0x20, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for code in chain(range(0xD800), range(0xE000, 0x110000)):
        char = chr(code)
        if char.isalpha():
            letter[code] = True
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    return lower, letter


@lru_cache(1)
def character_hashes() -> np.ndarray:
    return mixed(np.arange(0x110000, dtype=U64) + U64(1))


@dataclass(frozen=True)
class Model:
    """log_probability[language, bucket], log_prior[language]."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_probability: np.ndarray
    orders: tuple[int, ...]
    bits: int


def ngrams(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram and the place in it where each text begins.

    Characters other than letters count as one kind of gap. N-grams across two texts go to an extra
    bucket, number 2 ** bits, that the caller leaves out.
    """
    texts = texts_of(column)
    first = (texts.data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[texts.ends]
    lower, _ = characters()
    chars = lower[np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    value = character_hashes()[chars]
    rolled = np.zeros(len(chars), dtype=U64)
    last = np.repeat(at[1:], np.diff(at))
    for k in range(1, max(orders) + 1):
        rolled = rolled * U64(0x9E3779B97F4A7C15)
        rolled[: len(value) - k + 1] += value[k - 1 :]
        if k in orders:
            bucket = (mixed(rolled + U64(k)) >> U64(64 - bits)).astype(np.int64)
            bucket[np.arange(len(bucket)) + k > last] = 1 << bits
            yield bucket, at


def counts_by_language(rows: DataFrame, orders: tuple[int, ...], bits: int, part: Column) -> DataFrame:
    """(lang, part, bucket, n): n-gram counts per language and part of the texts (0 or 1); bucket -1 holds the
    number of documents."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], np.ndarray] = {}
        docs: dict[tuple[str, int], int] = {}
        for batch in batches:
            for some in batches_of(batch, "text", AT_ONCE):
                names = list(zip(some.column("lang").to_pylist(), some.column("part").to_pylist(), strict=True))
                for name in set(names):
                    own = some.filter(pa.array([x == name for x in names]))
                    total = seen.setdefault(name, np.zeros(size + 1, dtype=np.int64))
                    docs[name] = docs.get(name, 0) + own.num_rows
                    for bucket, _ in ngrams(own.column("text"), orders, bits):
                        total += np.bincount(bucket, minlength=size + 1)
        for (lang, which), total in seen.items():
            where = np.flatnonzero(total[:size])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(where) + 1), pa.string()),
                "part": pa.array(np.full(len(where) + 1, which), pa.int32()),
                "bucket": pa.array(np.concatenate([[-1], where]), pa.int32()),
                "n": pa.array(np.concatenate([[docs[lang, which]], total[where]]), pa.int64()),
            })

    return (
        rows.select("lang", part.cast("int").alias("part"), "text")
        .mapInArrow(count, "lang string, part int, bucket int, n long")
        .groupBy("lang", "part", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def model_of(table: pd.DataFrame, orders: tuple[int, ...], bits: int, smoothing: float) -> Model:
    """The model of counts (lang, bucket, n), several rows of one bucket added up."""
    languages = sorted(table.lang.unique(), key=lambda x: x.encode())
    matrix = np.full((len(languages), 1 << bits), smoothing)
    prior = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = table[table.lang == name]
        prior[i] = own.n[own.bucket == -1].sum()
        own = own[own.bucket >= 0]
        np.add.at(matrix[i], own.bucket.to_numpy(), own.n.to_numpy())
    if languages:
        matrix = np.log(matrix) - np.log(matrix.sum(axis=1, keepdims=True))
        prior = np.log(prior / prior.sum())
    return Model(tuple(languages), prior, matrix, orders, bits)


def counted(rows: DataFrame, orders: tuple[int, ...], bits: int, most_languages: int, part: Column) -> pd.DataFrame:
    """What reaches the driver is at most 2 x `most_languages` x 2 ** bits sums; more languages are refused."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(counts_by_language(rows, orders, bits, part), "language-counts")
    if counts.filter("bucket = -1").select("lang").distinct().count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return counts.toPandas()


def train(rows: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5, most_languages: int = 500) -> Model:
    """The model of all rows with a language and a text."""
    return model_of(counted(rows, orders, bits, most_languages, F.lit(0)), orders, bits, smoothing)


def train_halves(
    rows: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5, most_languages: int = 500
) -> tuple[Model, Model, Model]:
    """From one reading: the model of all rows, that of the rows not in half 0, and that of the rows not in half 1."""
    table = counted(rows, orders, bits, most_languages, half())
    return tuple(model_of(part, orders, bits, smoothing) for part in (table, table[table.part == 1], table[table.part == 0]))


class Scores:
    """Sums of log probabilities per language and text, n-grams of one order after the other."""

    def __init__(self, model: Model, n: int) -> None:
        self.model = model
        self.total = np.repeat(model.log_prior[:, None], n, axis=1)
        self.padded = np.concatenate([model.log_probability, np.zeros((len(model.languages), 1))], axis=1)

    def add(self, bucket: np.ndarray, at: np.ndarray) -> None:
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for i in range(len(self.model.languages)):
                self.total[i, full] += np.add.reduceat(self.padded[i][bucket], at[full])

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (-1: none) and its posterior probability, per text."""
        n = self.total.shape[1]
        if not self.model.languages:
            return np.full(n, -1), np.zeros(n)
        return self.total.argmax(axis=0), 1 / np.exp(self.total - self.total.max(axis=0)).sum(axis=0)


def scores(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: undetermined) and its posterior probability, per text."""
    if not model.languages or not len(texts_of(column).data):
        return np.full(len(column), -1), np.zeros(len(column))
    own = Scores(model, len(column))
    for bucket, at in ngrams(column, model.orders, model.bits):
        own.add(bucket, at)
    return own.best()


def has_letter(column: pa.Array) -> np.ndarray:
    """Per text: whether it holds a letter."""
    texts = texts_of(column)
    ascii_letter = ((texts.data | 0x20) >= 97) & ((texts.data | 0x20) <= 122)
    before = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = np.diff(before[texts.ends]) > 0
    for i in np.flatnonzero(~out):
        text = column[int(i)].as_py()
        out[i] = bool(text) and any(map(str.isalpha, text))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score; only the column `text` is looked at."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                column = part.column("text")
                best, score = scores(column, model)
                none = ~has_letter(column) | (best < 0)
                best, score = np.where(none, len(names) - 1, best), np.where(none, 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"],
                )

    return docs.mapInArrow(answer, schema)


def fit_of(model: Model, best: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the mean log probability of its longest n-grams in its best language above that of a random
    n-gram (NaN where there is none), and their number."""
    n = np.diff(np.concatenate([[0], np.cumsum(bucket < 1 << model.bits)])[at])
    fit = np.full(len(n), np.nan)
    full = np.flatnonzero(n)
    if model.languages and len(full):
        above = model.log_probability - model.log_probability.mean(axis=1, keepdims=True)
        above = np.concatenate([above, np.zeros((len(above), 1))], axis=1)
        fit[full] = np.add.reduceat(above[np.repeat(best, np.diff(at)), bucket], at[full]) / n[full]
    return fit, n


def measured(column: pa.Array, which: np.ndarray, whole: Model, halves: tuple[Model, Model]) -> dict[str, pa.Array]:
    """Per text, from one walk over its n-grams: language and score by the whole model; language, fit and number of
    n-grams by the model of the half it is not in."""
    n = len(column)
    models = (whole, *halves)
    sums = [Scores(m, n) for m in models]
    bucket, at = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    if len(texts_of(column).data):
        for bucket, at in ngrams(column, whole.orders, whole.bits):
            for own in sums:
                own.add(bucket, at)
    (best, score), *others = [own.best() for own in sums]
    none = ~has_letter(column) | (best < 0)
    name = lambda m, b: np.array([*m.languages, UNDETERMINED], dtype=object)[b]
    guess, fit, grams = np.full(n, UNDETERMINED, dtype=object), np.full(n, np.nan), np.zeros(n, np.int64)
    for k, (model, (own, _)) in enumerate(zip(halves, others, strict=True)):
        mine = which == k
        value, count = fit_of(model, own, bucket, at)
        guess[mine], fit[mine], grams[mine] = name(model, own)[mine], value[mine], count[mine]
    return {
        "lang_pred": pa.array(np.where(none, UNDETERMINED, name(whole, best)), pa.string()),
        "score": pa.array(np.where(none, 0.0, score), pa.float64()),
        "guess": pa.array(guess, pa.string()), "fit": pa.array(fit, mask=np.isnan(fit)), "grams": pa.array(grams, pa.int64()),
    }


def accepted(docs: DataFrame, least_score: float = 0.5, least_fit: float = LEAST_FIT, short: float = SHORT) -> DataFrame:
    """The rows of `docs` (with `text` and `lang`) but those without a determined language and those whose text is
    in none of the learned languages.

    A text is compared with the model of the half of the texts it is not in, as n-grams that it taught
    itself fit; the measure is the mean over its n-grams against the median of the texts that have the
    language as label. A text fits from `least_fit` of that median on, less `short` over the square root of its
    number of n-grams. Of texts with a letter, those that nothing can be said of stay: no n-gram of the
    longest order, no other text, no labelled text. The texts are read twice, once to learn and once to
    measure; what is measured is stored with the rows.
    """
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(train_halves(docs))
    mark = free_name(docs, "half")
    names = {c: free_name(docs, f"measured_{c}") for c in ("lang_pred", "score", "guess", "fit", "grams")}
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "guess": T.StringType(), "fit": T.DoubleType(), "grams": T.LongType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[c], kinds[c]) for c in names]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, *halves = sent.value
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                found = measured(part.column("text"), np.asarray(part.column(mark)), whole, tuple(halves))
                own = part.drop_columns([mark])
                yield pa.RecordBatch.from_arrays([*own.columns, *[found[c] for c in names]], names=[*columns, *names.values()])

    rows = stored(docs.withColumn(mark, half()).mapInArrow(answer, schema), "language-measures")
    lang_pred, score, guess, fit, grams = (F.col(names[c]) for c in names)
    middle, name = free_name(rows, "middle"), free_name(rows, "middle_language")
    # A row per language.
    middles = rows.filter(F.col("lang") == guess).groupBy(guess.alias(name)).agg(F.percentile_approx(fit, 0.5, 10_000).alias(middle))
    whole = rows.join(F.broadcast(stored(middles, "language-middles")), guess == F.col(name), "left")
    fitting = F.coalesce(fit >= F.col(middle) * (least_fit - short / F.sqrt(grams)), F.lit(True)) | (F.col(middle) <= 0)
    return whole.filter((lang_pred != UNDETERMINED) & (score >= least_score) & fitting).select(*[F.col(f"`{c}`") for c in columns])
