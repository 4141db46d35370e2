"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of characters.

Spark counts the n-grams of all texts and derives the model with joins and sums on n-gram tables: counts
of the highest order, continuation counts below, three discounts per order from counts of counts. The
model goes to the shared folder as arrays of sorted 64-bit hashes with log values beside them, cut by
hash range; scoring tasks map the files and look n-grams up by a jump table and bisection, so they hold
no copy of the model and nothing of the corpus passes the driver but counts of counts. Texts are judged by
models of the half of the texts they are not in (equal texts are in one half), within bands per language
that come from quantiles of all such scores.

Defined results: null text -> no words, fails the base rules, null perplexity; a text shorter than one
n-gram has null perplexity and is left to the base rules; null language is a language of its own; a
language whose scores do not spread rejects nothing; no rows -> no rows. Repeated rows count as often as
they occur. Columns of the input other than text and language are not read here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.storage import shared_folder, stored
from shelfscope.llm.text import U64, Texts, batches_of, byte_values, mixed, run_hashes, texts_of, words_of
from shelfscope.llm.token_files import file_system, mapped, normal

ORDER = 5
BITS = 21
#: Defaults of `judged`, from the spread that clean texts of the given tables show: it falls with the square root
#: of the length up to about 3,000 characters, and 99.5 % of those labelled good lie within 5 quartile
#: distances (sf0.1).
SHORT = 3000.0
REACH = 5.0
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


# Characters and n-grams


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, white space as 0x20 and digits as 0x30, and where each text begins."""
    at = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.ends]
    codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).copy()
    codes[codes <= 0x20] = 0x20
    codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    return codes, at


def packed(codes: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of every n-gram within a text, and the position of its last character.

    lo holds the last three code points, hi those before.
    """
    n = len(codes) - order + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    wide = codes.astype(np.int64)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(order):
        part = wide[k : k + n]
        if order - k > 3:
            hi = (hi << BITS) | part
        else:
            lo = (lo << BITS) | part
    inside = np.ones(len(codes) + order, dtype=bool)
    for k in range(1, order):
        inside[np.maximum(at[1:] - k, 0)] = False
    keep = np.flatnonzero(inside[:n])
    return hi[keep], lo[keep], keep + order - 1


def key_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-grams, the same in counting and scoring."""
    return mixed(mixed(lo.view(U64) + U64(1)) + hi.view(U64) * U64(0x9E3779B97F4A7C15))


def distinct_grams(codes: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, n) of the distinct n-grams of a batch.

    Characters are numbered within the batch, so that an n-gram is one integer and sorting finds the
    equal ones; where the batch has too many kinds of characters for that, their hashes are sorted.
    """
    kinds = np.unique(codes)
    bits = max(1, (len(kinds) - 1).bit_length())
    hi, lo, place = packed(codes, at, order)
    if bits * order > 63:
        _, first, n = np.unique(key_of(hi, lo), return_index=True, return_counts=True)
        return hi[first], lo[first], n
    number = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, dtype=np.int64)
    number[kinds] = np.arange(len(kinds))
    dense = number[codes]
    gram = np.zeros(max(0, len(codes) - order + 1), dtype=np.int64)
    for k in range(order):
        gram = (gram << bits) | dense[k : k + len(gram)]
    gram = np.sort(gram[place - order + 1])
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else place
    n = np.diff(np.concatenate([first, [len(gram)]]))
    gram = gram[first]
    hi, lo = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for k in range(order):
        code = kinds[(gram >> bits * (order - 1 - k)) & ((1 << bits) - 1)].astype(np.int64)
        if order - k > 3:
            hi = (hi << BITS) | code
        else:
            lo = (lo << BITS) | code
    return hi, lo, n


def counted(docs: DataFrame, order: int) -> DataFrame:
    """(hi, lo, n) of all n-grams; each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hi, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, where = np.unique(key_of(hi, lo), return_index=True, return_inverse=True)
            return hi[first], lo[first], np.bincount(where, weights=n).astype(np.int64)

        for batch in batches:
            for part in batches_of(batch, "text"):
                held.append(distinct_grams(*characters(texts_of(part.column("text"))), order))
                if sum(len(x[0]) for x in held[1:]) > max(1 << 20, len(held[0][0])):
                    held = [merged()]
        if held:
            hi, lo, n = merged()
            for k in range(0, len(hi), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (hi, lo, n)], names=["hi", "lo", "n"])

    return docs.select("text").mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


# The model


def suffix(order: int) -> list:
    """(hi, lo) without the first character of an n-gram of `order` characters."""
    if order > 3:
        return [F.col("hi").bitwiseAND(F.lit((1 << BITS * (order - 4)) - 1)).alias("hi"), F.col("lo")]
    return [F.col("hi"), F.col("lo").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("lo")]


def context() -> list:
    """(chi, clo): all but the last character."""
    top = F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << BITS) - 1)), 2 * BITS)
    return [F.shiftright("hi", BITS).alias("chi"), F.shiftright("lo", BITS).bitwiseOR(top).alias("clo")]


def discounts(grams: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur once to four times."""
    row = grams.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [k - (k + 1) * y * b / a if a else float(k) * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k * 0.95) for k, d in zip((1, 2, 3), found, strict=True)]


def estimated(counts: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order from 1: (hi, lo, value) with log probabilities; per order from 2: the same of contexts,
    with the log weight that their unseen continuations take to the order below."""
    by_order = {order: counts}
    for n in range(order, 1, -1):
        by_order[n - 1] = stored(by_order[n].select(*suffix(n)).groupBy("hi", "lo").agg(F.count("*").alias("n")), f"grams-{n - 1}")
    probabilities: list[DataFrame] = []
    weights: list[DataFrame] = []
    kept = lambda d: F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
    total = by_order[1].agg(F.sum("n").alias("sum"), F.count("*").alias("kinds"), F.sum(kept(discounts(by_order[1]))).alias("cut")).first()
    d = discounts(by_order[1])
    if not total["kinds"]:
        return [by_order[1].select("hi", "lo", F.lit(0.0).alias("value"))], []
    probabilities.append(stored(
        by_order[1].select("hi", "lo", ((F.col("n") - kept(d)) / F.lit(float(total["sum"])) + F.lit(total["cut"] / total["sum"] / (total["kinds"] + 1))).alias("p")),
        "p-1",
    ))
    for n in range(2, order + 1):
        d = discounts(by_order[n])
        grams = by_order[n].select("hi", "lo", "n", *context(), *[c.alias(f"s{name}") for name, c in zip(("hi", "lo"), suffix(n), strict=True)])
        sums = stored(
            grams.groupBy("chi", "clo").agg(F.sum("n").alias("sum"), F.sum(kept(d)).alias("cut")).withColumn("gamma", F.col("cut") / F.col("sum")),
            f"contexts-{n}",
        )
        below = probabilities[-1].select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("below"))
        probabilities.append(stored(
            grams.join(sums, ["chi", "clo"]).join(below, ["shi", "slo"])
            .select("hi", "lo", ((F.col("n") - kept(d)) / F.col("sum") + F.col("gamma") * F.col("below")).alias("p")),
            f"p-{n}",
        ))
        weights.append(sums.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.ln("gamma").alias("value")))
    return [p.select("hi", "lo", F.ln("p").alias("value")) for p in probabilities], weights


ARRAY = "name string, part int, n long"


def write_arrays(table: DataFrame, folder: str, name: str) -> DataFrame:
    """(hi, lo, value) as files of sorted hashes and values, one pair per range of hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, value = (np.asarray(batch.column(c)) for c in ("hi", "lo", "value"))
            yield pa.RecordBatch.from_arrays([pa.array((key_of(hi, lo) ^ U64(1 << 63)).view(np.int64)), pa.array(value)], names=["key", "value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = file_system(folder)
        own = f"{root}/{name}-{context.partitionId():06d}"
        attempt, streams, n = f"{own}.{context.taskAttemptId()}", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                fs.create_dir(root, recursive=True)
                streams = [fs.open_output_stream(f"{attempt}.{x}") for x in ("keys", "values")]
            streams[0].write((np.asarray(batch.column("key")).view(U64) ^ U64(1 << 63)).tobytes())
            streams[1].write(np.asarray(batch.column("value")).astype("<f4").tobytes())
            n += batch.num_rows
        if streams is None:
            return
        for stream, x in zip(streams, ("keys", "values"), strict=True):
            stream.close()
            fs.move(f"{attempt}.{x}", f"{own}.{x}")
        yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "part": pa.array([context.partitionId()], pa.int32()), "n": pa.array([n], pa.int64())})

    keyed = table.mapInArrow(hashed, "key long, value double")
    return keyed.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, ARRAY)


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> str:
    """Count, estimate and write the model of the `text` of all rows; returns its folder."""
    return written(stored(counted(docs, order), f"grams-{order}"), order, folder)


def half() -> Column:
    """0 or 1 by a hash of the text, so that equal texts fall into one half."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(2)).cast("int")


def train_apart(docs: DataFrame, order: int = ORDER) -> tuple[str, str]:
    """Per half of the texts the model of the other half."""
    return tuple(written(stored(counted(docs.filter(half() == 1 - k), order), f"grams-{order}-{k}"), order) for k in (0, 1))


def written(counts: DataFrame, order: int, folder: str | None = None) -> str:
    """Estimate and write the model of the counts of the highest order; returns its folder."""
    folder = normal(folder or shared_folder(counts.sparkSession, "kneser-ney"))
    probabilities, weights = estimated(counts, order)
    files = [write_arrays(p, folder, f"p{n}") for n, p in enumerate(probabilities, 1)]
    files += [write_arrays(w, folder, f"w{n}") for n, w in enumerate(weights, 2)]
    whole = files[0]
    for x in files[1:]:
        whole = whole.unionByName(x)
    # partitionId() counts over the union, so each array's parts keep their order
    whole.write.parquet(f"{folder}/manifest")
    return folder


class Arrays:
    """Sorted hash arrays of one name, mapped from their files."""

    def __init__(self, fs, root: str, name: str, parts: list[tuple[int, int]]) -> None:
        self.keys, self.values, self.jumps, self.shifts, self.firsts = [], [], [], [], []
        for part, n in sorted(parts):
            keys = mapped(fs, f"{root}/{name}-{part:06d}.keys", "<u8")
            bits = min(22, max(1, n.bit_length() + 1))
            first, last = int(keys[0]), int(keys[-1])
            shift = max(0, (last - first).bit_length() - bits)
            edges = first + (np.arange(((last - first) >> shift) + 2, dtype=U64) << U64(shift))
            jump = np.searchsorted(keys, edges.astype(U64)).astype(np.int64)
            jump[-1] = n
            self.keys.append(keys)
            self.values.append(mapped(fs, f"{root}/{name}-{part:06d}.values", "<f4"))
            self.jumps.append(jump)
            self.shifts.append(shift)
            self.firsts.append((first, last))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Value per hash, NaN where there is none."""
        out = np.full(len(wanted), np.nan, dtype=np.float32)
        for keys, values, jump, shift, (first, last) in zip(self.keys, self.values, self.jumps, self.shifts, self.firsts, strict=True):
            here = np.flatnonzero((wanted >= U64(first)) & (wanted <= U64(last))) if len(self.keys) > 1 else None
            asked = wanted if here is None else wanted[here]
            asked = np.clip(asked, U64(first), U64(last)) if here is None else asked
            bucket = ((asked - U64(first)) >> U64(shift)).astype(np.int64)
            low, high = jump[bucket], jump[bucket + 1]
            open_ = np.flatnonzero(high - low > 1)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                less = keys[middle] <= asked[open_]
                low[open_] = np.where(less, middle, low[open_])
                high[open_] = np.where(less, high[open_], middle)
                open_ = open_[high[open_] - low[open_] > 1]
            low = np.minimum(low, len(keys) - 1)
            hit = keys[low] == (wanted if here is None else asked)
            found = np.where(hit, values[low], np.float32(np.nan))
            if here is None:
                out = found
            else:
                out[here] = found
        return out


class Model:
    """The arrays of a model folder."""

    def __init__(self, folder: str, parts: dict[str, list[tuple[int, int]]]) -> None:
        fs, root = file_system(folder)
        self.arrays = {name: Arrays(fs, root, name, own) for name, own in parts.items()}
        self.order = max(int(name[1:]) for name in parts if name[0] == "p") if parts else 0

    def log_probabilities(self, hi: np.ndarray, lo: np.ndarray, order: int) -> np.ndarray:
        """Of n-grams given their first characters; unseen ones by the order below, times their context's weight."""
        if order == 0:
            return np.full(len(hi), math.log(1e-7))
        out = self.arrays[f"p{order}"].find(key_of(hi, lo)).astype(np.float64)
        none = np.flatnonzero(np.isnan(out))
        if len(none):
            hi, lo = hi[none], lo[none]
            weight = np.zeros(len(none))
            if order > 1:
                context_lo = (lo >> BITS) | ((hi & ((1 << BITS) - 1)) << 2 * BITS)
                weight = np.nan_to_num(self.arrays[f"w{order}"].find(key_of(hi >> BITS, context_lo)).astype(np.float64), nan=0.0)
            if order > 3:
                hi = hi & ((1 << BITS * (order - 4)) - 1)
            else:
                lo = lo & ((1 << BITS * (order - 1)) - 1)
            out[none] = weight + self.log_probabilities(hi, lo, order - 1)
        return out


MODELS: dict[str, Model] = {}


def log_perplexities(column: pa.Array, model: Model) -> np.ndarray:
    """Mean negative log probability of a text's characters; NaN where it holds no n-gram."""
    texts = texts_of(column)
    out = np.full(len(column), np.nan)
    if not model.order or not len(texts.data):
        return out
    codes, at = characters(texts)
    hi, lo, place = packed(codes, at, model.order)
    if not len(place):
        return out
    logs = model.log_probabilities(hi, lo, model.order)
    starts = np.searchsorted(place, at)
    n = np.diff(starts)
    full = np.flatnonzero(n)
    out[full] = -np.add.reduceat(logs, starts[full]) / n[full]
    return out


# Base rules


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text."""
    texts = texts_of(column)
    n_docs, data = len(texts), texts.data
    words, starts, first = words_of(texts, lower=False)
    n_words = np.diff(first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[texts.ends])

    gaps = byte_values(False, True)[data] == 0
    out = {
        "n_words": n_words,
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~gaps),
        "n_symbols": per_text(SYMBOLS[data]),
    }
    lines = np.unique(np.concatenate([texts.ends[:-1], np.flatnonzero(data == 10) + 1]))
    lines = lines[lines < len(data)]
    values = byte_values(False, False).copy()
    values[10] = 0
    hashes = run_hashes(texts, lines, values)
    worded = np.unique(np.searchsorted(lines, starts, side="right") - 1)
    owner = np.searchsorted(texts.ends, lines[worded], side="right") - 1
    distinct = np.unique(hashes[worded] ^ mixed(owner.astype(U64) + U64(1)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=n_docs) - np.bincount(owner[distinct], minlength=n_docs)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    n = len(words) - 4
    if n > 0:
        window = np.zeros(n, dtype=U64)
        for k in range(5):
            window = mixed(window * U64(0x9E3779B97F4A7C15) + words[k : k + n])
        doc = np.repeat(np.arange(n_docs), n_words)
        inside = np.flatnonzero(doc[:n] == doc[4:])
        keys = window[inside] ^ mixed(doc[inside].astype(U64) + U64(1))
        by_key = np.argsort(keys, kind="stable")
        same = keys[by_key][1:] == keys[by_key][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[by_key[1:][same]] = True
        twice[by_key[:-1][same]] = True
        begin = inside[twice]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + 5, -1)
    marked = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(marked)])[first])
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def parts_of(spark: SparkSession, folder: str) -> dict[str, list[tuple[int, int]]]:
    parts: dict[str, list[tuple[int, int]]] = {}
    for row in spark.read.schema(ARRAY).parquet(f"{folder}/manifest").collect():
        parts.setdefault(row["name"], []).append((row["part"], row["n"]))
    return parts


def scored(docs: DataFrame, folders: tuple[str, ...], key: str = "doc_id", language: str = "lang") -> DataFrame:
    """Key, language, base counts and log perplexity of every row, by the model in one folder, or by the one
    of two for its half of the texts."""
    folders = tuple(normal(f) for f in folders)
    parts = {f: parts_of(docs.sparkSession, f) for f in folders}
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"key {kinds[key]}, language {kinds[language]}, {', '.join(f'{c} long' for c in BASE)}, log_perplexity double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not all(f in MODELS for f in folders):
            MODELS.clear()
            MODELS.update((f, Model(f, own)) for f, own in parts.items())
        for batch in batches:
            for part in batches_of(batch, "text"):
                counts = base_counts(part.column("text"))
                which = np.asarray(part.column("half")) % len(folders)
                logs = np.full(part.num_rows, np.nan)
                for k, f in enumerate(folders):
                    own = which == k
                    logs[own] = log_perplexities(part.column("text").filter(pa.array(own)), MODELS[f])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("language"), *[pa.array(counts[c], pa.int64()) for c in BASE], pa.array(logs, mask=np.isnan(logs))],
                    names=["key", "language", *BASE, "log_perplexity"],
                )

    return docs.select(F.col(key).alias("key"), F.col(language).alias("language"), "text", half().alias("half")).mapInArrow(score, schema)


def wider(short: float) -> Column:
    """How much wider the band of a text of c word characters is, as a mean over few of them varies more."""
    return F.sqrt(1.0 + F.lit(short) / F.greatest(F.col("word_chars"), F.lit(1)))


def bands(scores: DataFrame, reach: float = REACH, short: float = SHORT) -> DataFrame:
    """(language, middle, below, above): the median log perplexity, and how far a long text may lie from it:
    `reach` times the quartile, on that side, of the distances over `wider(short)`. A side without spread
    takes the other's."""
    quantiles = lambda c, q: F.percentile_approx(c, F.lit(q), 10_000)
    known = scores.filter("log_perplexity IS NOT NULL").select(F.col("language").alias("own"), "log_perplexity", "word_chars")
    middles = stored(known.groupBy(F.col("own").alias("language")).agg(quantiles("log_perplexity", 0.5).alias("middle")), "perplexity-middles")
    away = known.join(middles, F.col("own").eqNullSafe(F.col("language"))).withColumn("away", (F.col("log_perplexity") - F.col("middle")) / wider(short))
    sides = away.groupBy("language", "middle").agg(quantiles("away", [0.25, 0.75]).alias("q"))
    below, above = F.greatest(-F.col("q")[0], F.lit(0.0)), F.greatest(F.col("q")[1], F.lit(0.0))
    return sides.select(
        "language", "middle",
        (reach * F.when(below > 0, below).otherwise(above)).alias("below"),
        (reach * F.when(above > 0, above).otherwise(below)).alias("above"),
    )


def failing(min_words: int = 10, repeat_percent: int = 20):
    """The base rules on columns n_words and n_repeat_words."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def judged(
    docs: DataFrame, folder: str | None = None, key: str = "doc_id", language: str = "lang", reach: float = REACH, short: float = SHORT,
) -> DataFrame:
    """key, language, base counts, log_perplexity, its band (low, high), base_failed and kept per row.

    Without `folder` models are trained on the rows themselves, one for each half of the texts; a text is
    judged by the one that has not counted it, as one that counted it finds nothing odd in it. A band reaches
    `reach` quartile distances of its language from the median, wider by sqrt(1 + `short` / word characters).
    """
    folders = (folder,) if folder else train_apart(docs)
    rows = stored(scored(docs, folders, key, language).withColumn("base_failed", failing()), "perplexities")
    limits = stored(bands(rows.filter(~F.col("base_failed")), reach, short), "perplexity-bands")
    low, high = F.col("middle") - F.col("below") * wider(short), F.col("middle") + F.col("above") * wider(short)
    inside = F.coalesce(F.col("log_perplexity").between(low, high) | (F.col("below") + F.col("above") <= 0), F.lit(True))
    return (
        rows.alias("r").join(limits.alias("b"), F.col("r.language").eqNullSafe(F.col("b.language")), "left")
        .select(F.col("r.key").alias(key), F.col("r.language").alias("language"), *BASE, "log_perplexity", low.alias("low"), high.alias("high"), "base_failed",
                (~F.col("base_failed") & inside).alias("kept"))
    )
