"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Texts are dealt by ranges of the sort key, so file after file is ascending. Each task encodes its texts
and streams two files into the shared folder: `part-N.bin` (ids, little-endian uint16 or uint32) and
`part-N.idx` (int64: document count, document offsets in ids with the end, document ids, 1 where the id
is null). A manifest holds a row per file; where a file's first id stands among all ids is a prefix sum
over it. Local files are read by memory map, others in ranges.

A task writes under a name of its own attempt and renames at its end, so a repeated or speculative task
leaves one whole file with the same content: rows of a range are sorted by key and text.

Defined results: null or empty text -> the end id alone; null document id sorts first and comes back as
null; equal ids stand together, by text; repeated rows are repeated documents; no rows -> no files and an
empty manifest. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.llm.storage import shared_folder
from shelfscope.llm.text import batches_of

MANIFEST = "part int, docs long, tokens long, width int"
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


#: Bytes of text that are encoded at a time: the fewer, the oftener common words are looked up.
TEXT_AT_ONCE = 4 << 20
#: ASCII letters, and punctuation but the apostrophe (which may go with letters) behind them.
RUNS = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
#: What `cuts_letters` knows: all of these leave ASCII as it is, but for lower case.
LOWERING = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
CUTTING = (
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)


def cuts_letters(tokenizer: dict) -> bool:
    """Whether a tokenizer, given as its JSON, lowers texts and sends each run of letters and each of punctuation to its
    model as it is; no where its steps are any others than the known ones."""
    steps = lambda x, inner: tuple((tokenizer.get(x) or {}).get(inner, ()))
    marked = all(x["content"].startswith("<|") for x in tokenizer.get("added_tokens", ()))
    known = steps("normalizer", "normalizers") == LOWERING and steps("pre_tokenizer", "pretokenizers") == CUTTING
    return marked and known and not tokenizer["model"].get("dropout")


class WordEncoder:
    """Encodes whole texts by words: a word is sent to the tokenizer once, then remembered.

    For tokenizers that drop white space and never join across it (`by_words=False` is for all others). Texts
    are cut at ASCII white space only, which is a part of what the tokenizer cuts at. Arrow cuts a batch and numbers its distinct
    words; only those become Python strings, and their ids are put together by numpy. New words go to the
    tokenizer in one text, apart by a control character that is a token of its own. Where the tokenizer only lowers and
    cuts between runs of letters (`cuts_letters`), new words of ASCII letters and a tail of punctuation go run by run to
    its model, which spares them what is before the model, most of the work.
    """

    APART = "\x01"
    #: Words and ids remembered; beyond either, all are forgotten before the next batch.
    REMEMBERED = 800_000
    REMEMBERED_IDS = 1 << 23
    LONGEST = 64
    #: New words in one text; the tokenizer takes more time a word for longer texts.
    AT_ONCE = 100

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_runs = cuts_letters(json.loads(self.tokenizer.to_str()))
        self.dtype = dtype
        self.apart = self.ids(self.APART)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {"": []}
        self.flat = np.zeros(0, dtype=self.dtype)
        self.ends = np.zeros(1, dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def run_ids(self, head: str, tail: str) -> list[int]:
        """The ids of letters and of the punctuation behind them."""
        if tail not in self.tails:
            self.tails[tail] = self.ids(tail)
        return [x.id for x in self.model.tokenize(head.lower())] + self.tails[tail]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new words behind those known, those found run by run first."""
        flat, sizes = [self.flat], []
        runs = [x for x in map(RUNS.fullmatch, words) if x and len(x[0]) <= self.LONGEST and "<|" not in x[0]] if self.by_runs else []
        first = [x[0] for x in runs]
        if runs:
            found = [self.run_ids(x[1], x[2]) for x in runs]
            flat.append(np.fromiter(chain.from_iterable(found), self.dtype))
            sizes.append(list(map(len, found)))
            done = set(first)
            words = [w for w in words if w not in done]
        plain = len(self.apart) == 1
        short = [w for w in words if plain and 0 < len(w) <= self.LONGEST and "\x01" not in w and "<|" not in w]
        for k in range(0, len(short), self.AT_ONCE):
            some = short[k : k + self.AT_ONCE]
            ids = np.array(self.ids(f" {self.APART} ".join(some)), dtype=self.dtype)
            marks = ids == self.apart[0]
            cuts = np.flatnonzero(marks)
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer joined words")
            flat.append(ids[~marks])
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        rest = [w for w in words if w not in set(short)] if len(short) < len(words) else []
        for word in rest:
            flat.append(np.array(self.ids(word) if word else [], dtype=self.dtype))
            sizes.append([len(flat[-1])])
        own = [*first, *short, *rest]
        self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
        self.flat = np.concatenate(flat)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        told = cut.flatten().dictionary_encode()
        words = told.dictionary.to_pylist()
        if len(self.known) > self.REMEMBERED or len(self.flat) > self.REMEMBERED_IDS:
            self.forget()
        slots = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            self.learn(new)
            slots[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        begin, size = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        at = told.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(begin[at] - before[:-1], sizes) + np.arange(before[-1])]
        offsets = cut.offsets.to_numpy()
        return ids, np.diff(before[offsets - offsets[0]])


class TextEncoder:
    """Encodes whole texts as they are."""

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        sizes = np.array([len(x.ids) for x in found], dtype=np.int64)
        return np.concatenate([np.zeros(0, self.dtype), *[np.array(x.ids, dtype=self.dtype) for x in found]]), sizes


ENCODERS: dict[tuple, WordEncoder | TextEncoder] = {}


def encoder(kind: type, path: str, dtype: str) -> WordEncoder | TextEncoder:
    """One per Python worker, kept between tasks."""
    key = (kind, path, dtype)
    if key not in ENCODERS:
        ENCODERS[key] = kind(path, dtype)
    return ENCODERS[key]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def normal(folder: str) -> str:
    """file:/x as file:///x, which every reader takes."""
    return f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, vocabulary: int = 1 << 16,
    by_words: bool = True, order: list[Column] | None = None,
) -> str:
    """Encode `text` of every row of `docs`, in ascending order of `doc_id`; returns the folder.

    `tokenizer` is a path that every executor has. Ids are uint16 where `vocabulary` (a bound above all
    ids) allows it. How many files come out follows Spark's shuffle settings (one per partition that
    adaptive execution leaves).
    """
    spark = docs.sparkSession
    folder = normal(folder or shared_folder(spark, "tokens"))
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    kind = WordEncoder if by_words else TextEncoder
    keys = order or [F.col("doc_id"), F.xxhash64("text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = file_system(folder)
        own = f"{root}/part-{context.partitionId():06d}"
        attempt = f"{own}.{context.taskAttemptId()}"
        width = np.dtype(dtype).itemsize
        lengths: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        stream = None
        for batch in batches:
            for part in batches_of(batch, "text", TEXT_AT_ONCE):
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{attempt}.bin")
                ids, sizes = encoder(kind, tokenizer, dtype).encode(part.column("text"))
                stream.write(np.insert(ids, np.cumsum(sizes), end_id).tobytes())
                lengths.append(sizes + 1)
                doc_ids += part.column("doc_id").to_pylist()
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        with fs.open_output_stream(f"{attempt}.idx") as index:
            index.write(struct.pack("<q", len(doc_ids)))
            index.write(offsets.tobytes())
            index.write(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes())
            index.write(np.array([x is None for x in doc_ids], dtype="<i8").tobytes())
        for suffix in ("bin", "idx"):
            fs.move(f"{attempt}.{suffix}", f"{own}.{suffix}")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([context.partitionId()], pa.int32()), "docs": pa.array([len(doc_ids)], pa.int64()),
            "tokens": pa.array([int(offsets[-1])], pa.int64()), "width": pa.array([width], pa.int32()),
        })

    (
        docs.select("doc_id", "text")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(write, MANIFEST)
        .write.parquet(f"{folder}/manifest")
    )
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with the place of their first id among all ids (`base`)."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    )


def mapped(fs: pafs.FileSystem, path: str, dtype: str, begin: int = 0, count: int = -1) -> np.ndarray:
    """Numbers of a file: by memory map where it is local, else the wanted range."""
    size = np.dtype(dtype).itemsize
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, dtype=dtype, mode="r")
        return whole[begin:] if count < 0 else whole[begin : begin + count]
    with fs.open_input_file(path) as file:
        count = file.size() // size - begin if count < 0 else count
        return np.frombuffer(file.read_at(count * size, begin * size), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, ids_per_batch: int = 1 << 20) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files), n_tokens, ids as uint32 bytes."""
    folder = normal(folder)
    files = manifest(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path, dtype = f"{root}/part-{row['part']:06d}", f"<u{row['width']}"
                index = mapped(fs, f"{path}.idx", "<i8")
                n = int(index[0])
                offsets, doc_ids, none = index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]
                done = 0
                while done < n:
                    stop = max(done + 1, int(np.searchsorted(offsets, offsets[done] + ids_per_batch, side="right")) - 1)
                    first, last = int(offsets[done]), int(offsets[stop])
                    raw = mapped(fs, f"{path}.bin", dtype, first, last - first).astype("<u4").tobytes()
                    cuts = ((offsets[done : stop + 1] - first) * 4).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[done:stop], pa.int64(), mask=none[done:stop] == 1),
                        "start": pa.array(offsets[done:stop] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[done : stop + 1]), pa.int64()),
                        "ids": pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    })
                    done = stop

    n_files = max(1, spark.read.parquet(f"{folder}/manifest").count())
    return files.repartition(n_files, "part").mapInArrow(read, DOCUMENT)
