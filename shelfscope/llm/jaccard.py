"""N-gram Jaccard join: links between sets of word shingles, exact, and the components they make.

Equal sets are one class. Classes whose min-hashes agree are first compared with one pivot of their
group, which joins large groups of near copies at linear cost. Then every class is indexed under the
rarest part of its set (a prefix under one global order: any two sets that link share a prefix token),
and index lists are read with set relations:

- index level: lists are sorted by set size and cut into blocks; a block is skipped when its sizes,
  positions or component show that it holds no answer. Long lists are read with a parity sketch per set
  (a bit per residue of the hashes): sets differ in at least as many shingles as their sketches differ in
  bits, so most pairs end there and never leave the task. A component has the sketch of one member and
  the largest distance of the others from it, which the triangle inequality takes off. Long lists are
  read twice: first each set meets only the closest one of a list, which joins what pivots have not; then
  all pairs that this left apart are read. A pair is told in the longest list that it meets in, not in each, and
  leaves a task once; which entries met a group is told entry by entry, so rows grow with the entries;
- answer level: classes of one component need no comparison. Two components that meet are first told apart by
  sketches and distances, then asked by one pair of members per meeting. What a member of a group shares with another set follows
  from what its pivot shares, up to the few shingles in which member and pivot differ; only members for
  which that leaves the answer open are compared. Members of components that met are found by reading their lists
  again, member by member and sorted by component; no table of all pairs of members is made.

The global order is by how often a shingle's hash bucket occurs in all documents, then by hash.

Rows are told apart by a 64-bit hash of id and text, shingles by 64-bit hashes, classes by two of those
and the size.

Defined results: null or empty text and text without words -> an empty set, linked with nothing; null
document id -> an ordinary document that never names a component (null if it has no other id); texts of
one id are documents of their own; repeated rows are answered as often as they occur. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.components import components
from shelfscope.llm.storage import free_name, removed, stored
from shelfscope.llm.text import U64, batches_of, mixed, shingles_of, texts_of, words_of

SIZE = 5
PERCENT = 80
BINS = 8
BUCKET_BITS = 20
CHUNK = 1 << 12
BLOCK = 64
SHORT = 8
SKETCH_BITS = 1024
#: Long lists, the longest first, by which two entries tell whether they met in an earlier one.
EARLIEST = 8
#: Rows of ids and small numbers up to which a table is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
SALT_ROWS = 128


def links(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (n + m - shared)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased over A-Z."""
    words, _, first = words_of(texts_of(column), lower=True)
    for k in range(len(first) - 1):
        own = words[first[k] : first[k + 1]]
        yield np.unique(shingles_of(own, SIZE))


def sketch(tokens: np.ndarray) -> bytes:
    """For each residue of the hashes, whether an odd number of them has it."""
    odd = np.bincount((tokens & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bounded(small: DataFrame) -> DataFrame:
    """With a broadcast hint where the table is counted and small enough; else as it is."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


# Classes, bands and bucket counts


def summaries(docs: DataFrame) -> DataFrame:
    """A row per document (id, set size, two set hashes, band hashes), and rows (chunk, counts) of the task's
    bucket counts."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        for batch in batches:
            for part in batches_of(batch, "text"):
                rows: list[tuple] = []
                for tokens in sets_of(part.column("text")):
                    np.add.at(counts, (tokens >> U64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
                    edges = np.searchsorted(tokens, np.arange(BINS, dtype=U64) << U64(61))
                    least = [int(tokens[e]) if e < len(tokens) else 0 for e in edges]
                    full = [e < len(tokens) and int(tokens[e]) >> 61 == k for k, e in enumerate(edges)]
                    bands = [
                        int(mixed(np.array([(least[k] * 3 + least[k + 1] + k) % (1 << 64)], dtype=U64))[0]) for k in range(0, BINS, 2) if full[k] and full[k + 1]
                    ]
                    rows.append((len(tokens), tokens.sum(dtype=U64), mixed(tokens).sum(dtype=U64), bands, sketch(tokens)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "doc": part.column("doc"),
                    "n": pa.array([r[0] for r in rows], pa.int64()),
                    "one": pa.array(np.array([r[1] for r in rows], dtype=U64).view(np.int64)),
                    "two": pa.array(np.array([r[2] for r in rows], dtype=U64).view(np.int64)),
                    "bands": pa.array([np.array(r[3], dtype=U64).view(np.int64).tolist() for r in rows], pa.list_(pa.int64())),
                    "sketch": pa.array([r[4] for r in rows], pa.binary()),
                    "chunk": pa.nulls(len(rows), pa.int32()),
                    "counts": pa.nulls(len(rows), pa.binary()),
                })
        if counts.any():
            n = len(counts) // CHUNK
            yield pa.RecordBatch.from_pydict({
                **{c: pa.nulls(n, pa.int64()) for c in ("doc_id", "doc", "n", "one", "two")},
                "bands": pa.nulls(n, pa.list_(pa.int64())),
                "sketch": pa.nulls(n, pa.binary()),
                "chunk": pa.array(range(n), pa.int32()),
                "counts": pa.array([counts[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in range(n)], pa.binary()),
            })

    return docs.select("doc_id", "doc", "text").mapInArrow(
        summarise, "doc_id long, doc long, n long, one long, two long, bands array<long>, sketch binary, chunk int, counts binary"
    )


def rarity(found: DataFrame) -> np.ndarray:
    """Per bucket: its count over all documents, as 16ths of doublings (2 ** BUCKET_BITS numbers of 2 bytes)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(raw, dtype="<u8" if len(raw) == 8 * CHUNK else "<u4").astype(np.uint64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.astype("<u8").tobytes() for x in sums.values()], pa.binary()),
        })

    rows = found.filter("chunk IS NOT NULL").select("chunk", "counts")
    sums = rows.mapInArrow(add, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, dtype=np.uint16)
    for row in stored(sums, "bucket-counts").toLocalIterator():
        counts = np.frombuffer(row["counts"], dtype="<u8").astype(np.float64)
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.log2(counts + 1) * 16
    return out


# Comparing pairs


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) for distinct pairs of document keys, from their whole texts.

    `a` is the centre: its text travels once per portion of SALT_ROWS partners, the partners' once per
    pair, and a task holds one centre's set at a time.
    """
    pairs = stored(pairs, "pairs")
    degrees = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    salt = F.pmod(F.xxhash64("b"), F.lit(1) + F.floor(F.col("degree") / SALT_ROWS))
    oriented = stored(pairs.join(degrees, "a").select(F.col("a").alias("centre"), salt.alias("salt"), F.col("b").alias("doc")), "oriented")
    roles = oriented.select("doc", "centre", "salt", F.lit(1).alias("role")).unionByName(
        oriented.select(F.col("centre").alias("doc"), "centre", "salt", F.lit(0).alias("role")).distinct()
    )
    roles = stored(roles, "roles")
    removed(oriented)
    texts = docs.select("doc", "text").join(bounded(roles), "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, dtype=U64)
        for batch in batches:
            for part in batches_of(batch, "text"):
                out: list[tuple[int, int, int, int, int]] = []
                keys = zip(part.column("centre").to_pylist(), part.column("role").to_pylist(), part.column("doc").to_pylist(), strict=True)
                for (key, role, doc), tokens in zip(keys, sets_of(part.column("text")), strict=True):
                    if role == 0:
                        centre, own = key, tokens
                        continue
                    if key != centre or not len(own):
                        raise ValueError("a partner came without its centre")
                    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    out.append((key, doc, len(own), len(tokens), int((own[at] == tokens).sum())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "n_a", "n_b", "shared"])

    answers = stored(
        texts.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role", "doc")
        .select("centre", "role", "doc", "text")
        .mapInArrow(compare, "a long, b long, n_a long, n_b long, shared long"),
        "compared",
    )
    removed(pairs, roles)
    return answers


def linked():
    return 100 * F.col("shared") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("shared"))


# The index


def prefixes(texts: DataFrame, order: np.ndarray) -> DataFrame:
    """(token, n, pos, doc, label): the prefix of every set under the global order."""
    sent = texts.sparkSession.sparkContext.broadcast(order)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            for part in batches_of(batch, "text"):
                tokens, sizes, lengths = [], [], []
                for found in sets_of(part.column("text")):
                    n = len(found)
                    most = n - -(-PERCENT * n // 100) + 1 if n else 0
                    rare = np.argsort(order[(found >> U64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")[:most]
                    tokens.append(found[rare])
                    sizes.append(n)
                    lengths.append(len(rare))
                each = np.array(lengths)
                total = int(each.sum())
                if not total:
                    continue
                starts = np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), each)),
                        pa.array((np.arange(total) - starts).astype(np.int32)),
                        pa.array(np.repeat(np.asarray(part.column("doc")), each)), pa.array(np.repeat(np.asarray(part.column("label")), each)),
                    ],
                    names=["token", "n", "pos", "doc", "label"],
                )

    return texts.select("doc", "label", "text").mapInArrow(index, "token long, n int, pos int, doc long, label long")


def may_link(n_low, n_high, pos, m_low, m_high, pos_m) -> np.ndarray:
    """Whether sets of sizes n_low..n_high and m_low..m_high that share a token may link: by size, and, where
    an entry stands for one set (its position is not negative), by what can be shared before and after the token's
    positions."""
    n_low, n_high, m_low, m_high = (np.asarray(x, dtype=np.int64) for x in (n_low, n_high, m_low, m_high))
    pos, pos_m = np.asarray(pos, dtype=np.int64), np.asarray(pos_m, dtype=np.int64)
    sizes = (100 * m_high >= PERCENT * n_low) & (100 * n_high >= PERCENT * m_low)
    around = np.minimum(pos, pos_m) + np.minimum(n_high - pos, m_high - pos_m)
    one = (n_low == n_high) & (m_low == m_high) & (pos >= 0) & (pos_m >= 0)
    most = np.where(one, around, np.minimum(n_high, m_high))
    return sizes & ((100 + PERCENT) * most >= PERCENT * (n_low + m_low))


def list_pairs(
    token: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, pos: np.ndarray,
    sketches: np.ndarray | None = None, radius: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of entries of one list whose sets may link, of different components, and in how many bits
    their sets' sketches differ at least.

    Entries are sorted by list. Short lists are taken together, one distance after the other;
    in longer ones blocks are compared first and skipped as a whole, by size, component and the distance of their
    sketches; the more alike neighbours are, the more are skipped. `sketches` holds a row of 64-bit
    words per entry; the sketches of all sets that an entry stands for differ from it in `radius` bits at
    most.
    """
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    ends = np.concatenate([starts[1:], [len(token)]])
    lengths = ends - starts

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (label[i] != label[j]) & may_link(low[i], high[i], pos[i], low[j], high[j], pos[j])
        i, j = i[ok], j[ok]
        differ = np.zeros(len(i), dtype=np.int64)
        if sketches is not None and len(i):
            differ = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64) - radius[i] - radius[j]
            ok = (100 + PERCENT) * differ <= (100 - PERCENT) * (high[i].astype(np.int64) + high[j])
            i, j, differ = i[ok], j[ok], differ[ok]
        return i, j, differ

    last = np.repeat(ends, lengths)
    i = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= BLOCK), lengths))
    for k in range(1, BLOCK):
        i = i[i + k < last[i]]
        if not len(i):
            break
        yield kept(i, i + k)
    for begin, end in zip(starts[lengths > BLOCK], ends[lengths > BLOCK], strict=True):
        edges = np.arange(begin, end, BLOCK)
        b_low, b_high = np.minimum.reduceat(low[:end], edges), np.maximum.reduceat(high[:end], edges)
        first, final = np.minimum.reduceat(label[:end], edges), np.maximum.reduceat(label[:end], edges)
        if sketches is not None:
            centre = sketches[edges]
            own = np.bitwise_count(sketches[begin:end] ^ centre[np.arange(end - begin) // BLOCK]).sum(axis=1, dtype=np.int64)
            spread = np.maximum.reduceat(own + radius[begin:end], edges - begin)
        for x, at in enumerate(edges):
            others = np.arange(x, len(edges))
            open_ = (100 * b_high[x] >= PERCENT * b_low[others]) & (100 * b_high[others] >= PERCENT * b_low[x])
            open_ &= (first[x] != final[others]) | (final[x] != first[others])
            if sketches is not None:
                away = np.bitwise_count(centre[x] ^ centre[others]).sum(axis=1, dtype=np.int64) - spread[x] - spread[others]
                open_ &= (100 + PERCENT) * away <= (100 - PERCENT) * (b_high[x].astype(np.int64) + b_high[others])
            rows = np.arange(at, min(at + BLOCK, end))
            for y in others[open_]:
                columns = np.arange(edges[y], min(edges[y] + BLOCK, end))
                i, j = (m.ravel() for m in np.meshgrid(rows, columns, indexing="ij"))
                yield kept(i[i < j], j[i < j])


ENTRY = ("token", "label", "low", "high", "pos")


def whole_lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut between lists."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: np.asarray(batch.column(c)) for c in names}
        held = {c: np.concatenate([held[c], columns[c]]) for c in names} if held else columns
        token = held["token"]
        cut = int(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[-1])
        if cut:
            yield {c: x[:cut] for c, x in held.items()}
            held = {c: x[cut:] for c, x in held.items()}
    if held:
        yield held


def dealt(df: DataFrame, order: tuple[str, ...] = ("low", "high", "pos", "label")) -> DataFrame:
    """Entries by list, sorted as they are read."""
    return df.repartition("token").sortWithinPartitions("token", *order)


def least_tokens(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs of rows (a, b, token), each with its least token."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]


def read_lists(entries: DataFrame) -> DataFrame:
    """Rows (a, b, token): pairs of labels in lists of up to SHORT `entries` (token, label, low, high, pos,
    grouped) that may link; and, with null a, the entries of longer lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in whole_lists(batches, (*ENTRY, "grouped")):
            token = lists["token"]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(token)]]))
            long = np.repeat(lengths > SHORT, lengths)
            short = {c: x[~long] for c, x in lists.items()}
            for i, j, _ in list_pairs(*(short[c] for c in ENTRY)) if len(short["token"]) else ():
                if len(i):
                    rows = pairs_of(short, i, j)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x) for x in rows), *(pa.nulls(len(rows[0]), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))],
                        names=["a", "b", "token", "label", "low", "high", "pos", "grouped"],
                    )
            if long.any():
                n = int(long.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(token[long]), *(pa.array(lists[c][long]) for c in ("label", "low", "high", "pos", "grouped"))],
                    names=["a", "b", "token", "label", "low", "high", "pos", "grouped"],
                )

    schema = "a long, b long, token long, label long, low int, high int, pos int, grouped boolean"
    return stored(dealt(entries.select(*ENTRY, "grouped")).mapInArrow(read, schema), "lists")


def read_long(entries: DataFrame, closest: bool, members: bool = False, narrow: DataFrame | None = None) -> DataFrame:
    """(a, b, token) of labels in lists of `entries` (with sketch, radius and component) that may link and
    are of different components, with the least token that a task saw (0: no group takes part); with
    `closest`, only the one of least distance for each entry of a list.

    Without `closest`, a pair is told in the first list that both have among their EARLIEST, else in each, for the
    entries of a label are alike in all lists but for the token (and the position of a single set, where no link
    fails in any list); and (label, null, token) for every entry that meets one where a group takes part. With
    `members`, entries are members of components; then only pairs in which a group takes part are told. `narrow` is
    a table of the same (token, label) where `entries` are joined ones, which would be computed again.
    """
    earliest = () if closest else tuple(f"e{k}" for k in range(EARLIEST))
    words = tuple(f"s{k}" for k in range(SKETCH_BITS // 64))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), U64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*ENTRY, "grouped", "radius", "component", *earliest)), *(pa.array(raw[:, k]) for k in range(raw.shape[1]))],
                names=[*ENTRY, "grouped", "radius", "component", *earliest, *words],
            )

    def told(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["a", "b", "token"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for lists in whole_lists(sketched(batches), (*ENTRY, "grouped", "radius", "component", *earliest, *words)):
            sketches = np.stack([lists[w] for w in words], axis=1)
            grouped = lists["grouped"].astype(bool)
            least = np.full(len(grouped), np.iinfo(np.int64).max)
            partner = np.full(len(grouped), -1)
            met = np.zeros(len(grouped), dtype=bool)
            apart = (lists[c] for c in ("token", "component", "low", "high", "pos"))
            for i, j, differ in list_pairs(*apart, sketches, lists["radius"].astype(np.int64)):
                if closest:
                    for x, y in ((i, j), (j, i)):
                        order = np.lexsort((y, differ))[::-1]  # of equal rows the last one written stays: the closest
                        nearer = differ[order] < least[x[order]]
                        at, other = x[order][nearer], y[order][nearer]
                        least[at], partner[at] = differ[order][nearer], other
                    continue
                of_group = grouped[i] | grouped[j]
                met[i[of_group]] = met[j[of_group]] = True
                if members:
                    i, j = i[of_group], j[of_group]
                before, ahead = np.zeros(len(i), dtype=bool), np.ones(len(i), dtype=bool)
                for x in earliest:
                    mine = lists[x][i]
                    ahead &= mine != lists["token"][i]
                    before |= ahead & np.any([mine == lists[y][j] for y in earliest], axis=0)
                i, j = i[~before], j[~before]
                parts.append(np.stack(pairs_of(lists, i, j), axis=1))
                held += len(i)
                if held > 1 << 18:
                    parts = [least_tokens(parts)]
                    held = len(parts[0])
                    if held > 1 << 17:
                        yield told(parts[0])
                        parts, held = [], 0
            if closest:
                near = np.flatnonzero(partner >= 0)
                parts.append(np.stack(pairs_of(lists, near, partner[near]), axis=1))
                held += len(near)
                if held > 1 << 18:
                    yield told(least_tokens(parts))
                    parts, held = [], 0
            elif met.any() and not members:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists["label"][met]), pa.nulls(int(met.sum()), pa.int64()), pa.array(lists["token"][met])], names=["a", "b", "token"]
                )
        if held:
            yield told(least_tokens(parts))

    order = ("component", "low", "label") if members else ("low", "high", "pos", "label")
    if not closest:
        entries = entries.join(stored(earliest_lists(entries if narrow is None else narrow, earliest), "earliest"), "label")
    return dealt(entries.select(*ENTRY, "grouped", "sketch", "radius", "component", *earliest), order).mapInArrow(read, "a long, b long, token long")


def earliest_lists(entries: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(label, *names): the longest lists of every label, of equal ones the least token first. Entries of many lists
    have these in common sooner than any other; where there are fewer, the last one stands again."""
    lengths = entries.groupBy("token").agg(F.count("*").alias("length"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("length"), "token"))
    first = entries.select("label", "token").distinct().join(lengths, "token").withColumn("place", place).filter(F.col("place") <= len(names))
    own = first.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("own"))
    return own.select("label", *[F.element_at("own", F.least(F.lit(k + 1), F.size("own")))["token"].alias(x) for k, x in enumerate(names)])


def bits_apart(x: str, y: str):
    return F.aggregate(F.zip_with(words_of_sketch(x), words_of_sketch(y), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def centres(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, sketch, radius, least_n, n) of components (node, component): the sketch of the set that names one, the
    most bits in which a member's differs from it, and the sizes of the smallest and the largest member."""
    member = classes.select(F.col("doc").alias("node"), F.col("sketch").alias("own"), "n")
    centre = classes.select(F.col("doc").alias("component"), "sketch")
    rows = labels.join(member, "node").join(centre, "component").withColumn("differ", bits_apart("own", "sketch"))
    return rows.groupBy(F.col("component").alias("label")).agg(
        F.first("sketch").alias("sketch"), F.max("differ").cast("int").alias("radius"), F.min("n").alias("least_n"), F.max("n").alias("n")
    )


def near_shapes(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs (a, b) of labels of which some members may link, by the triangle inequality over sketches."""
    side = lambda x: shapes.select(F.col("label").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("sketch", "radius", "n")])
    differ = bits_apart("a_sketch", "b_sketch") - F.col("a_radius") - F.col("b_radius")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def words_of_sketch(column: str):
    return F.array(*[F.conv(F.hex(F.substring(column, 1 + 8 * k, 8)), 16, -10).cast("long") for k in range(SKETCH_BITS // 64)])


def merged(grouped: DataFrame) -> DataFrame:
    """The entries of components out of those of their members (token, label, doc, n, pos), without a position."""
    entries = grouped.groupBy("token", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return entries.select("token", "label", "low", "high", F.lit(-1).alias("pos"), F.lit(True).alias("grouped"))


def pairs_of(lists: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label, token, grouped = lists["label"], lists["token"], lists["grouped"].astype(bool)
    return np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), np.where(grouped[i] | grouped[j], token[i], 0)


# The whole join


def row_key():
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text")


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, n, component, component_id) for every row of `docs` (doc_id, text).

    `doc` is the row's key, `component` the key that names its component (null for empty sets).
    """
    docs = docs.select("doc_id", "text", row_key().alias("doc"))
    found = stored(summaries(docs), "summaries")
    rows = found.filter("chunk IS NULL")
    keyed = ["n", "one", "two"]
    classes = stored(
        rows.filter("n > 0").groupBy(*keyed).agg(F.min("doc").alias("doc"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    pivots = classes.select("doc", F.explode("bands").alias("band"))
    pivots = pivots.join(pivots.groupBy("band").agg(F.min("doc").alias("pivot"), F.count("*").alias("size")).filter("size > 1"), "band")
    near = compared(docs, pivots.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()).filter(linked())
    labels = stored(components(near), "labels")

    order = rarity(found)
    labelled = stored(
        classes.select("doc", "n").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
        .select("doc", "n", F.coalesce("component", "doc").alias("label"), F.col("component").isNotNull().alias("grouped")),
        "labelled",
    )
    texts = docs.select("doc", "text")
    single = prefixes(texts.join(bounded(labelled.filter("NOT grouped").select("doc", "label")), "doc"), order)
    grouped = stored(prefixes(texts.join(bounded(labelled.filter("grouped").select("doc", "label")), "doc"), order), "grouped-prefixes")
    plain = single.select("token", "label", F.col("n").alias("low"), F.col("n").alias("high"), "pos", F.lit(False).alias("grouped"))
    lists = read_lists(plain.unionByName(merged(grouped)))

    # Long lists, first the closest pairs, which join what pivots have not.
    shapes = stored(
        labelled.filter("NOT grouped").select("label").join(classes.withColumnRenamed("doc", "label"), "label").select("label", "sketch", F.lit(0).alias("radius"), F.col("n").alias("least_n"), "n")
        .unionByName(centres(labels, classes)), "shapes",
    )
    # The sizes are those of all members of a label, so that its entries are alike in all lists.
    shape = shapes.select("label", "sketch", "radius", F.col("least_n").cast("int").alias("low"), F.col("n").cast("int").alias("high"))
    narrow = lists.filter("a IS NULL").select("token", "label", "pos", "grouped")
    long = narrow.join(shape, "label")
    closest = read_long(long.filter("NOT grouped").withColumn("component", F.col("label")), closest=True)
    joined = stored(components(compared(docs, closest.select("a", "b").distinct()).filter(linked())), "joined")
    long = long.join(joined.withColumnRenamed("node", "label"), "label", "left").withColumn("component", F.coalesce("component", "label"))
    met = stored(lists.filter("a IS NOT NULL").select("a", "b", "token").unionByName(read_long(long, closest=False, narrow=narrow)), "met")
    meetings = stored(met.filter("b IS NOT NULL").groupBy("a", "b").agg(F.min("token").alias("token")), "meetings")
    # Of long lists every entry that met is told by itself.
    ends = lists.filter("a IS NOT NULL AND token <> 0").select("token", F.explode(F.array("a", "b")).alias("label"))
    sides = stored(ends.unionByName(met.filter("b IS NULL").select("token", F.col("a").alias("label"))).distinct(), "sides")
    removed(met, lists)

    alone = meetings.filter("token = 0").select("a", "b")
    of_groups = meetings.filter("token <> 0")
    of_groups = stored(of_groups.join(near_shapes(of_groups.select("a", "b"), shapes), ["a", "b"], "left_semi"), "group-meetings")
    behind = sets_behind(of_groups.select("token", F.explode(F.array("a", "b")).alias("label")).distinct(), grouped, labelled)
    behind = behind.join(classes.select("doc", "n", "sketch"), "doc")
    first = compared(docs, alone.unionByName(first_pairs(of_groups, behind)).distinct()).filter(linked())
    removed(meetings, shapes)
    known = labels.unionByName(joined).select(F.col("node").alias("a"), F.col("component").alias("b"))
    now = stored(components(known.unionByName(first.select("a", "b"))), "components")
    at = lambda x: now.select(F.col("node").alias(x), F.col("component").alias(f"{x}_now"))
    apart = of_groups.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("a_now", "a") != F.coalesce("b_now", "b"))
    apart = stored(apart.select(F.explode(F.array("a", "b")).alias("label")).distinct(), "apart")
    members = stored(sets_behind(sides.join(apart, "label", "left_semi").select("token", "label"), grouped, labelled), "members")
    more = compared(docs, member_pairs(docs, members, classes, now, near)).filter(linked())
    removed(apart, grouped, of_groups, sides, members)
    final = components(now.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))

    by_class = (
        classes.select(*keyed, "doc", "least").join(final.withColumnRenamed("node", "doc"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
    )
    ids = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(by_class.join(ids, "component").select(*keyed, "component", "component_id"), "class-components")
    empty = F.when(F.col("n") == 0, F.col("doc_id"))
    return rows.join(named, keyed, "left").select("doc_id", "doc", "n", "component", F.coalesce("component_id", empty).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text)."""
    return classified(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay when of every component only one does: that of the smallest id (null
    last), then of the smallest key. Rows of empty sets stay, as they are linked with nothing."""
    found = stored(classified(docs), "classified")
    stays = found.filter("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")).alias("first")
    ).select("component", F.col("first.doc").alias("first"))
    gone = stored(found.join(stays, "component").filter("doc <> first").select("doc").distinct(), "gone")
    repeated = stored(
        found.filter("component IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc")
        .join(gone, "doc", "left_anti"), "repeated",
    )
    key = free_name(docs, "key")
    gone, repeated = (x.withColumnRenamed("doc", key) for x in (gone, repeated))
    left = docs.withColumn(key, row_key()).join(bounded(gone), key, "left_anti")
    alone = left.join(bounded(repeated), key, "left_anti")
    if not repeated.limit(1).count():
        return alone.select(*docs.columns)
    once = left.join(bounded(repeated), key, "left_semi").dropDuplicates([key])
    return alone.unionByName(once).select(*docs.columns)


def sets_behind(sides: DataFrame, grouped: DataFrame, labelled: DataFrame) -> DataFrame:
    """(token, label, doc, grouped): the sets that stand behind each of the distinct `sides` (token, label) of meetings."""
    members = grouped.join(sides, ["token", "label"], "left_semi").select("token", "label", "doc", F.lit(True).alias("grouped"))
    own = sides.join(labelled.filter("NOT grouped"), "label").select("token", "label", "doc", "grouped")
    return members.unionByName(own).distinct()


def first_pairs(meetings: DataFrame, behind: DataFrame) -> DataFrame:
    """(a, b): for every two labels of `meetings` (a row per pair), a pair of one set per side behind the meeting.

    Where it links, the two components are one and their other pairs need no comparison.
    """
    one = behind.groupBy("token", "label").agg(F.min_by(F.struct("doc", "n", "sketch"), "doc").alias("x")).select("token", "label", "x.*")
    one = stored(one, "first-sides")
    side = lambda x: one.select("token", F.col("label").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("doc", "n", "sketch")])
    pairs = (
        meetings.select("token", "a", "b").join(side("a"), ["token", "a"]).join(side("b"), ["token", "b"])
        .filter((100 * F.col("a_n") >= PERCENT * F.col("b_n")) & (100 * F.col("b_n") >= PERCENT * F.col("a_n")))
        .filter((100 + PERCENT) * bits_apart("a_sketch", "b_sketch") <= (100 - PERCENT) * (F.col("a_n") + F.col("b_n")))
    )
    return pairs.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))


def member_pairs(docs: DataFrame, behind: DataFrame, classes: DataFrame, now: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) of documents `behind` meetings in which a group takes part, of different components `now`, where the
    answer is open.

    Sizes and sketches settle most. Then a member's answer follows from its pivot's: with `lost` shingles
    of the member outside the pivot, it shares at most what the pivot shares plus `lost`.
    """
    entries = behind.join(classes.select("doc", "n", "sketch"), "doc").join(now.withColumnRenamed("node", "doc"), "doc", "left").select(
        "token", F.col("doc").alias("label"), F.col("n").alias("low"), F.col("n").alias("high"), F.lit(0).alias("pos"), "grouped", "sketch",
        F.lit(0).alias("radius"), F.coalesce("component", "doc").alias("component"),
    )
    narrow = behind.select("token", F.col("doc").alias("label"))
    met = read_long(entries, closest=False, members=True, narrow=narrow).select(F.col("a").alias("a_doc"), F.col("b").alias("b_doc")).distinct()
    size = lambda x: classes.select(F.col("doc").alias(f"{x}_doc"), F.col("n").alias(f"{x}_n"))
    open_ = stored(met.join(size("a"), "a_doc").join(size("b"), "b_doc"), "open-pairs")
    larger = F.col("a") < F.col("b")
    pivot = near.groupBy(F.greatest("a", "b").alias("doc")).agg(
        F.max_by(F.struct(F.least("a", "b").alias("pivot"), F.when(larger, F.col("n_b")).otherwise(F.col("n_a")).alias("size"), "shared"), "shared").alias("p")
    ).select("doc", F.col("p.pivot").alias("pivot"), (F.col("p.size") - F.col("p.shared")).alias("lost"))
    pivot = stored(pivot, "pivots")
    on = lambda x: pivot.select(F.col("doc").alias(f"{x}_doc"), F.col("pivot").alias(f"{x}_pivot"), F.col("lost").alias(f"{x}_lost"))
    open_ = stored(
        open_.join(on("a"), "a_doc", "left").join(on("b"), "b_doc", "left")
        .select("a_doc", "b_doc", "a_n", "b_n", F.coalesce("a_pivot", "a_doc").alias("p"), F.coalesce("b_pivot", "b_doc").alias("q"),
                (F.coalesce("a_lost", F.lit(0)) + F.coalesce("b_lost", F.lit(0))).alias("lost"))
        .withColumns({"x": F.least("p", "q"), "y": F.greatest("p", "q")}),
        "open-with-pivots",
    )
    answers = compared(docs, open_.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().filter("a <> b"))
    answers = answers.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "shared")
    left = open_.join(answers, ["x", "y"], "left").filter(
        F.col("shared").isNull() | ((100 + PERCENT) * (F.col("shared") + F.col("lost")) >= PERCENT * (F.col("a_n") + F.col("b_n")))
    )
    return left.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).unionByName(
        answers.select(F.col("x").alias("a"), F.col("y").alias("b"))
    ).distinct()
