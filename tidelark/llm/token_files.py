"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

Documents are dealt out by ranges of ids and sorted, so file ``part`` k holds
smaller ids than file k + 1.  Each row is one document:

    doc_id bigint, part int, pos bigint, n int, ids array<int>

``pos`` counts the ids before the document within its part, ``n`` its own.  ORC encodes the
integers by run length in stripes, keeps minima and maxima of ``doc_id`` by
stripe and row group, and a Bloom filter on it, so that a lookup reads few
stripes; a scan reads stripes in parallel, as Spark splits the files.

Defined results: a null text counts as empty and still gets the end id.  Null
ids sort first.  Rows with equal ids stand in order of their texts' hashes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, quoted, scratch, small_batches

SCHEMA = "doc_id bigint, part int, pos bigint, n int, ids array<int>"
#: Characters whose lower case and white space are the same for Python and for the tokenizer's normalizer.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞₠-₿]*")


class _Numbers(dict):
    """Numbers strings as they are first asked for; ``new`` holds those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Store:
    """Runs of ids by number; arrays double as they grow."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.used = self.runs = 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        return array if used + more <= len(array) else np.concatenate((array[:used], np.zeros(max(len(array), more), array.dtype)))

    def add(self, ids: np.ndarray, count: np.ndarray) -> None:
        self.ids = self._room(self.ids, self.used, len(ids))
        self.at, self.count = self._room(self.at, self.runs, len(count)), self._room(self.count, self.runs, len(count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.runs : self.runs + len(count)] = self.used + np.cumsum(count) - count
        self.count[self.runs : self.runs + len(count)] = count
        self.used += len(ids)
        self.runs += len(count)

    def get(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[k]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.at[k] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


class WordIds:
    """The tokenizers library over distinct words.

    Texts are cut at white space into chunks and new chunks by the
    vocabulary's own pattern into words; the library encodes each word that the
    worker has not met before, many to a line, and the marks of words' ends in
    the vocabulary tell their ids apart.  Only for vocabularies whose
    pre-tokenizer never joins characters across white space and whose
    normalizer works character by character on PLAIN text (NFC, white space,
    lower case); any other text, and one that holds a special token, goes
    through the library whole.
    """

    def __init__(self, path: str, memory: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
        if self.by_word:
            self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.chunks, self.words = _Numbers(), _Numbers()
        self.of_chunk, self.of_word = _Store(), _Store()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self) -> None:
        chunks, self.chunks.new = self.chunks.new, []
        alone = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))  # a chunk of letters is a word
        number = self.words.__getitem__
        first = np.fromiter((number(c) if a else -1 for c, a in zip(chunks, alone, strict=True)), np.int64, len(chunks))
        parts = [self.pattern.findall(c) for c, a in zip(chunks, alone, strict=True) if not a]
        size = np.ones(len(chunks), np.int64)
        size[~alone] = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(size)
        k = np.empty(int(ends[-1]), np.int64)
        k[(ends - size)[alone]] = first[alone]
        k[np.repeat(~alone, size)] = np.fromiter((number(w) for p in parts for w in p), np.int64)
        words, self.words.new = self.words.new, []
        lines = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]
        for a in range(0, len(lines), 256):
            ids = [np.asarray(got.ids, np.int32) for got in self.library.encode_batch_fast(lines[a : a + 256], add_special_tokens=False)]
            ids = np.concatenate(ids)
            self.of_word.add(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        ids, n = self.of_word.get(k)
        total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends))]
        self.of_chunk.add(ids, np.diff(total))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > self.memory:
            self.forget()
        number, runs = self.chunks.__getitem__, []
        for t in texts:
            if self.by_word and PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                chunks = (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split()
                runs.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
            else:
                runs.append(None)
        if self.chunks.new:
            self.learn()
        return [self.whole(t) if k is None else self.of_chunk.get(k)[0] for t, k in zip(texts, runs, strict=True)]


@cache
def word_ids(path: str) -> WordIds:
    """One tokenizer a process, with what it has learnt."""
    return WordIds(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, stripe_mb: int = 16, row_group: int = 1000) -> None:
    """Encodes every text and writes the files in ascending order of ids.

    The rows are shuffled once, as texts (smaller than their ids), and encoded
    where they are written.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)

    def encode(batches):
        at = 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids = word_ids(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [np.append(x, np.int32(end_id)) for x in ids.encode(texts)]
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            ends = np.cumsum(n)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "part", "pos", "n", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    dealt = rows.repartitionByRange(files or partitions(spark), F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    out = ordered.mapInArrow(encode, SCHEMA)
    (
        out.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_group))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the stripes' statistics and Bloom filters."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(*ids))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone.

    A first pass reads only the small columns: the end of each part, whose
    running sum (a row a file) gives the parts' starts.
    """
    rows = read_token_files(spark, path)
    ends = rows.groupBy("part").agg(F.max(F.col("pos") + F.col("n")).alias("__n"))
    starts = ends.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__start"))
    small_batches(spark, 500)

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).tobytes())
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("pos"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    digests = rows.drop("n").mapInArrow(digest, "doc_id bigint, part int, pos bigint, n_tokens bigint, ids_crc32 bigint")
    # a row for each file: its number is known before the job
    return digests.join(F.broadcast(starts), "part").select("doc_id", (F.col("__start") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared scratch folder, unless told where) and returns ``document_index`` of them."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-ids")
    write_token_files(docs, path, tokenizer, **options)
    return document_index(spark, path)
