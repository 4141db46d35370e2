"""Benchmark decontamination: item-sized windows of documents near benchmark items in edit distance.

A random walk (CGK) reads a window of words: at step t it writes the word under its pointer and moves on
by one place or none, as a random bit of (repetition, t, word) says. Equal words give equal bits, so
windows few edits apart fall into step again, and edit distance becomes Hamming distance between what
the walks write. Each repetition samples a few steps; a window is a candidate for an item when it wrote
the same word at all of them. Samples are taken in the order of the walk, so a window whose first sampled
word no item wrote there stops at once, which is what most windows do.

A window may start at any word. Items are embedded from several of their words on, so a changed
beginning does not hide the rest. Candidates are verified on the texts: the edit distance in characters
between the whole item and its best place around the window.

A window equal to the item is always found. The target recall of 0.9 is reached for items of 20 words and
more up to 10 percent of replaced characters, for shorter ones (down to 10 words) up to 5; between that and
`percent` pairs are reported when they meet, with falling probability (on the 200 items of sf0.1: 0.99 at
5, 0.93 at 10, some 0.85 at 13 percent). Items of fewer than 10 words are found verbatim only, and a script
without spaces counts as such, word by word of white space.

Defined results: null or empty text -> no match; items without words match nothing; an item longer than a
document matches when the distance allows it; equal items match alike, repeated rows are answered each;
null ids come back as null. Other columns of the documents are passed through by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfscope.llm.storage import free_name, stored
from shelfscope.llm.text import U64, Texts, batches_of, mixed, shingles_of, texts_of, words_of

EARLY = 10
EARLY_SAMPLES = 3
PAD = U64(0)


@dataclass(frozen=True)
class Settings:
    """`percent` of an item's characters may differ; `repetitions` walks with `samples` sampled steps each,
    from every `anchor`-th word of an item, from more of them where that makes fewer than `anchors`; windows
    shorter than `least` words are not embedded, but from the first four words of an item; a candidate's walk agrees with the
    item's in `agreement` percent of its words at least. Items shorter than EARLY words are only found
    verbatim."""

    percent: int = 20
    repetitions: int = 7
    samples: int = 3
    anchor: int = 4
    anchors: int = 10
    least: int = 12
    agreement: int = 30
    seed: int = 5


def hashed(words: np.ndarray, *what: int) -> np.ndarray:
    """64 random bits per word."""
    number = 0
    for x in what:
        number = number * 1_000_003 + x
    return mixed(words ^ mixed(np.array([number % (1 << 64)], dtype=U64)))


#: Repetitions whose early bits come from one hash of a word.
TOGETHER = 64 // EARLY


def early_bits(hashes: np.ndarray, repetition: int) -> np.ndarray:
    """The bits of the first EARLY steps, lowest first, out of the hash for its group of repetitions."""
    return hashes >> U64(EARLY * (repetition % TOGETHER))


def moves(word: np.ndarray, repetition: int, seed: int, t: int) -> np.ndarray:
    """Whether the walk moves on from a word at step t."""
    if t < EARLY:
        bits = early_bits(hashed(word, seed, 0, repetition // TOGETHER), repetition) >> U64(t)
    else:
        bits = hashed(word, seed, 1 + repetition, t >> 6) >> U64(t & 63)
    return (bits & U64(1)).astype(np.int64)


@dataclass
class Index:
    """The embedded items of one block of the benchmark."""

    ids: list
    texts: list[str]
    settings: Settings
    words: np.ndarray = field(default=None)
    starts: np.ndarray = field(default=None)  # of anchors: item, word offset, words from there on
    sizes: np.ndarray = field(default=None)
    known: np.ndarray = field(default=None)
    items: np.ndarray = field(default=None)
    walks: list = field(default_factory=list)
    normal: list[str] = field(default_factory=list)
    lengths: np.ndarray = field(default=None)  # in words
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # size -> hash of the whole item -> items

    def __post_init__(self) -> None:
        s = self.settings
        words, _, first = words_of(texts_of(folded(pa.array(self.texts, pa.string()))), lower=True)
        self.normal = [normal(t) for t in self.texts]
        self.lengths = np.diff(first)
        starts, sizes, items = [], [], []
        for i in range(len(self.texts)):
            n = int(first[i + 1] - first[i])
            if n < EARLY:
                continue
            for offset in range(0, n, max(1, min(s.anchor, n // s.anchors))):
                if n - offset >= min(s.least, n - 3):
                    starts.append(first[i] + offset)
                    sizes.append(n - offset)
                    items.append((i, offset))
        self.words = words
        self.known = np.zeros(1 << 20, dtype=bool)  # whether some word of an item has these leading bits
        self.known[(mixed(words) >> U64(44)).astype(np.int64)] = True
        self.starts, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.items = np.array(items, np.int64).reshape(-1, 2)
        for i in range(len(self.texts)):
            if 0 < first[i + 1] - first[i] < EARLY:
                own = words[first[i] : first[i + 1]]
                self.short.setdefault(len(own), {}).setdefault(int(shingles_of(own, len(own))[0]), []).append(i)
        random = np.random.default_rng(s.seed)
        for r in range(s.repetitions):
            early = np.array([r % 2, random.integers(3, 6), random.integers(7, EARLY)])
            late = np.sort(random.random(s.samples - EARLY_SAMPLES))
            symbols = walked(words, self.starts, self.sizes, sampled_steps(early, late, self.sizes), r, s.seed)
            key, tables = np.zeros(len(symbols), dtype=U64), []
            for k in range(EARLY_SAMPLES):
                key = mixed(key + symbols[:, k])
                tables.append(np.zeros(1 << 16, dtype=bool))
                tables[-1][(key >> U64(48)).astype(np.int64)] = True
            order = np.argsort(key, kind="stable")
            self.walks.append((early, late, symbols[order], key[order], order, tables))


def sampled_steps(early: np.ndarray, late: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Steps to sample per window: the early ones, the rest spread over the walk of its size."""
    spread = EARLY + (late[None, :] * np.maximum(1.6 * sizes[:, None] - EARLY, 1)).astype(np.int64)
    return np.concatenate([np.repeat(early[None, :], len(sizes), axis=0), spread], axis=1)


def walked(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: np.ndarray, repetition: int, seed: int) -> np.ndarray:
    """What the walk over words[start:start + size] writes at the given steps (ascending per row)."""
    out = np.zeros(steps.shape, dtype=U64)
    if not len(starts):
        return out
    place = starts.copy()
    ends = np.minimum(starts + sizes, len(words))
    final = steps.max(axis=1)
    for t in range(int(final.max()) + 1):
        inside = place < ends
        word = np.where(inside, words[np.minimum(place, len(words) - 1)], PAD)
        for column in range(steps.shape[1]):
            now = steps[:, column] == t
            out[now, column] = word[now]
        place += moves(word, repetition, seed, t) * inside
    return out


def agreeing(
    words: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_starts: np.ndarray, sizes: np.ndarray,
    repetition: int, seed: int, percent: int,
) -> np.ndarray:
    """Whether two walks write the same word at `percent` of the words that the first one comes to, over 1.6 times the
    size. Steps at which it stays on a word do not count: a common word on which both stay says little. A pair that
    cannot reach the share any more is not walked on."""
    steps = (1.6 * sizes).astype(np.int64)
    out = np.zeros(len(starts), dtype=bool)
    rows, a, b = np.arange(len(starts)), starts.copy(), other_starts.copy()
    came, same, all_came = (np.ones(len(starts), dtype=np.int64), *np.zeros((2, len(starts)), dtype=np.int64))
    t = 0
    while len(rows):
        x = np.where(a < ends[rows], words[np.minimum(a, len(words) - 1)], PAD)
        y = np.where(b < other_starts[rows] + sizes[rows], others[np.minimum(b, len(others) - 1)], PAD)
        same += came * ((x == y) & (x != PAD))
        all_came += came
        came = moves(x, repetition, seed, t)
        a += came
        b += moves(y, repetition, seed, t)
        t += 1
        left = steps[rows] - t
        done = left <= 0
        out[rows[done]] = 100 * same[done] >= percent * all_came[done]
        on = ~done & (100 * (same + left) >= percent * (all_came + left))
        if not on.all():
            rows, a, b, came, same, all_came = (z[on] for z in (rows, a, b, came, same, all_came))
    return out


def verbatim(words: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """(text, item, word position) of the short items, by the hash of all their words."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    for size, items in index.short.items():
        if len(words) < size:
            continue
        hashes = shingles_of(words, size)
        for at in np.flatnonzero(np.isin(hashes, np.array(list(items), dtype=U64))):
            text = int(np.searchsorted(first, at, side="right")) - 1
            if at + size <= first[text + 1]:
                found.append(np.array([[text, item, at] for item in items[int(hashes[at])]]))
    return np.concatenate(found)


def candidates(words: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (text, item, word position of the item's beginning) from all windows of a batch."""
    found = [verbatim(words, first, index)]
    n = len(words)
    if not n or not len(index.starts):
        return np.unique(found[0], axis=0)
    text_end = np.repeat(first[1:], np.diff(first))
    # A walk's first sample is its first word or, where it has moved on, the second one.
    known = index.known[(mixed(words) >> U64(44)).astype(np.int64)]
    second = np.append(known[1:], False)
    beginnings = (np.flatnonzero(known), np.flatnonzero(known | second))
    for r, (early, late, symbols, keys, order, tables) in enumerate(index.walks):
        if r % TOGETHER == 0:
            hashes = hashed(words, index.settings.seed, 0, r // TOGETHER)
        bits = early_bits(hashes, r)
        begin = beginnings[min(1, int(early[0]))]
        place, key, seen = begin, np.zeros(len(begin), dtype=U64), 0
        for t in range(int(early[-1]) + 1):
            if t == early[seen]:
                word = np.where(place < text_end[begin], words[np.minimum(place, n - 1)], PAD)
                key = mixed(key + word)
                alive = tables[seen][(key >> U64(48)).astype(np.int64)]
                begin, place, key, seen = begin[alive], place[alive], key[alive], seen + 1
            if t < early[-1]:
                place = place + ((bits[np.minimum(place, n - 1)] >> U64(t)) & U64(1)).astype(np.int64)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        hits = np.flatnonzero(high > low)
        if not len(hits):
            continue
        each = high[hits] - low[hits]
        window = np.repeat(begin[hits], each)
        entry = np.repeat(low[hits], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        sizes = np.minimum(index.sizes[order[entry]], text_end[window] - window)
        if len(late):
            steps = sampled_steps(early, late, index.sizes[order[entry]])
            agree = (walked(words, window, sizes, steps, r, index.settings.seed) == symbols[entry]).all(axis=1)
            window, entry, sizes = window[agree], entry[agree], sizes[agree]
        anchor = order[entry]
        agree = agreeing(
            words, window, window + sizes, index.words, index.starts[anchor], index.sizes[anchor], r, index.settings.seed, index.settings.agreement
        )
        window, entry = window[agree], entry[agree]
        item = index.items[order[entry]]
        text = np.searchsorted(first, window, side="right") - 1
        found.append(np.stack([text, item[:, 0], window - item[:, 1]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, all letters alike."""
    return pc.utf8_lower(column.cast(pa.string()))


def normal(text: str) -> str:
    """Lower case, runs of ASCII white space as one space."""
    return b" ".join(folded(pa.array([text]))[0].as_py().encode().split()).decode("utf-8", "replace")


@lru_cache(4096)
def letter_masks(item: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted letters of an item, and per letter (one more for all others) its places as bits of 64 places a word."""
    codes = np.frombuffer(item.encode("utf-32-le", "replace"), np.uint32)
    letters, which = np.unique(codes, return_inverse=True)
    masks = np.zeros((len(letters) + 1, max(1, -(-len(codes) // 64))), dtype=U64)
    place = np.arange(len(codes))
    np.bitwise_or.at(masks, (which, place // 64), U64(1) << (place % 64).astype(U64))
    return letters, masks


def distances(items: list[str], regions: list[str]) -> np.ndarray:
    """Edit distance between each item and the best part of its region, all pairs together.

    Columns of the edit matrix are held as bits of differences (Myers), 64 letters of an item to a word, so a
    letter of the regions takes a few operations on all pairs.
    """
    if not items:
        return np.zeros(0, dtype=np.int64)
    # Longest regions first: those that have ended are cut off behind.
    order = sorted(range(len(items)), key=lambda k: -len(regions[k]))
    items, regions = [items[k] for k in order], [regions[k] for k in order]
    of_item = {item: letter_masks(item) for item in set(items)}
    blocks_ = max(m.shape[1] for _, m in of_item.values())
    starts, table, at = {}, [], 0
    for item, (letters, masks) in of_item.items():
        starts[item] = at
        table.append(np.pad(masks, ((0, 0), (0, blocks_ - masks.shape[1]))))
        at += len(masks)
    table = np.concatenate(table)
    width = max(map(len, regions))
    codes = np.zeros((width, len(items)), dtype=np.int32)
    for k, (item, region) in enumerate(zip(items, regions, strict=True)):
        letters = of_item[item][0]
        text = np.frombuffer(region.encode("utf-32-le", "replace"), np.uint32)
        found = np.searchsorted(letters, text)
        known = found < len(letters)
        known[known] = letters[found[known]] == text[known]
        codes[:, k] = starts[item] + len(letters)
        codes[: len(text), k] = starts[item] + np.where(known, found, len(letters))
    m, ends = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    last, top = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(U64)
    up = [np.full(len(items), ~U64(0)) for _ in range(blocks_)]
    down = [np.zeros(len(items), dtype=U64) for _ in range(blocks_)]
    score, best, one, n = m.astype(np.int64), m.astype(np.int64), U64(1), len(items)
    here = [np.flatnonzero(last == k) for k in range(blocks_)]
    for j in range(width):
        if j % 16 == 0 and (on := int(np.searchsorted(-ends, -j, side="left"))) < n:
            n = on
            up, down, here = [x[:n] for x in up], [x[:n] for x in down], [x[x < n] for x in here]
        more = less = np.zeros(n, dtype=U64)  # what goes over from the block before
        for k in range(blocks_):
            equal, p, q = table[codes[j, :n], k], up[k], down[k]
            x = equal | q
            equal = equal | less
            h = (((equal & p) + p) ^ p) | equal
            hp, hn = q | ~(h | p), p & h
            rows = here[k]
            if len(rows):
                score[rows] += ((hp[rows] >> top[rows]) & one).astype(np.int64) - ((hn[rows] >> top[rows]) & one).astype(np.int64)
            over = (hp >> U64(63), hn >> U64(63))
            hp, hn = (hp << one) | more, (hn << one) | less
            up[k], down[k] = hn | ~(x | hp), hp & x
            more, less = over
        best[:n] = np.where(j < ends[:n], np.minimum(best[:n], score[:n]), best[:n])
    out = np.empty(len(items), dtype=np.int64)
    out[order] = np.where(m == 0, 0, best)
    return out


#: Letters of regions that are held at a time.
CELLS = 1 << 22


def regions_of(pairs: np.ndarray, first: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, last word) to search: neighbouring places joined, and cut into pieces that overlap by
    an item with its slack, so that no piece grows with a text that is one long repetition."""
    joined: list[list[int]] = []
    sizes = [int(n) for n in index.lengths]
    slack = [n * index.settings.percent // 100 + 2 for n in sizes]
    for text, item, at in pairs.tolist():
        if joined and joined[-1][:2] == [text, item] and at - joined[-1][3] <= slack[item]:
            joined[-1][3] = at  # the region is read on to the end of this place's
        else:
            joined.append([text, item, at, at])
    out = []
    for text, item, begin, end in joined:
        a, b = max(int(first[text]), begin - slack[item]), min(int(first[text + 1]), end + sizes[item] + 2 * slack[item] + 1)
        whole = sizes[item] + 2 * slack[item] + 1
        while b - a > 4 * whole:
            out.append((text, item, a, a + 4 * whole))
            a += 3 * whole
        out.append((text, item, a, b))
    return out


def matches(column: pa.Array, index: Index) -> list[list[dict]]:
    """Per text: the items found in it with their distance and length in characters."""
    texts: Texts = texts_of(folded(column))
    words, starts, first = words_of(texts, lower=True)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    pairs = candidates(words, first, index)
    if not len(pairs):
        return out
    ends = np.append(starts, len(texts.data))
    data = texts.data.tobytes()
    best: dict[tuple[int, int], int] = {}
    work = []
    for text, item, a, b in regions_of(pairs, first, index):
        region = b" ".join(data[ends[a] : min(int(ends[b]), int(texts.ends[text + 1]))].split()).decode("utf-8", "replace") if b > a else ""
        work.append((len(region), text, item, region))
    work.sort(key=lambda w: w[0])
    while work:
        rows = max(1, CELLS // max(1, work[-1][0]))
        some, work = work[-rows:], work[:-rows]
        for (_, text, item, _), distance in zip(some, distances([index.normal[w[2]] for w in some], [w[3] for w in some]).tolist(), strict=True):
            if 100 * distance <= index.settings.percent * len(index.normal[item]):
                best[text, item] = min(distance, best.get((text, item), distance))
    for (text, item), distance in sorted(best.items()):
        out[text].append({"item_id": index.ids[item], "distance": distance, "length": len(index.normal[item])})
    return out


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """The benchmark in parts of about `block_bytes` bytes of text, by a hash of the item."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // block_bytes
    for k in range(parts):
        yield benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_bytes: int = 16 << 20) -> DataFrame:
    """`docs` (with a column `text`) plus `benchmark_items`: what of the benchmark stands in each text.

    The benchmark (item_id, text) is the stated query set: it goes to all tasks in blocks of bounded
    size, one pass over the documents per block.
    """
    name = "benchmark_items"
    docs = docs.drop(name)
    id_type = benchmark.schema["item_id"].dataType
    match = T.StructType([T.StructField("item_id", id_type), T.StructField("distance", T.IntegerType()), T.StructField("length", T.IntegerType())])
    out = None
    for block in blocks(benchmark.select("item_id", "text").filter("text IS NOT NULL"), block_bytes):
        rows = block.collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], settings))
        # One Python stage a job: what the blocks before found is stored.
        base = docs if out is None else stored(out, "benchmark-block")
        column = name if out is None else free_name(base, "more_items")
        schema = T.StructType([*base.schema.fields, T.StructField(column, T.ArrayType(match))])

        def look(batches: Iterator[pa.RecordBatch], index=index, column=column) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("distance", pa.int32()), ("length", pa.int32())]))
            for batch in batches:
                for part in batches_of(batch, "text", 1 << 20):
                    found = pa.array(matches(part.column("text"), index.value), kind)
                    yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, column])

        base = base.mapInArrow(look, schema)
        out = base if out is None else base.withColumn(name, F.concat(name, column)).drop(column)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` without the documents that hold a benchmark item."""
    return find(docs, benchmark, settings).filter(F.size("benchmark_items") == 0).drop("benchmark_items")
