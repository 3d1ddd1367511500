"""BPE encoding and decoding by batched numpy merge rounds.

A text is cut into pieces at which no merge can reach across (single spaces
between words, which the pre-tokenizer always splits before).  The distinct
pieces that a worker has not met yet are encoded together: the symbols of all
their words stand in one flat array; a round looks up every adjacent pair by
binary search in the sorted pair keys, finds the lowest rank of each word and
merges its occurrences from the left; words without a pair left drop out.  Ids
of pieces are remembered, up to a bound, so common words cost a lookup.

Defined results: a null text counts as empty and has no ids.  The strings of
special tokens in a text become their ids, as with the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, small_batches

#: The byte-level pre-tokenizer's pattern: fixed, as the vocabulary was made with it.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space on both sides of a space, or at its end: pieces cut at spaces would split a run.
AWKWARD = re.compile(r"\s (?:\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by rule: printable bytes stand for themselves, the rest follow from 256."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


class NumpyBPE:
    """A byte-level BPE vocabulary of the tokenizers library's JSON format."""

    def __init__(self, path: str, memory: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * n
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.size = n
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.fromiter(map(len, tokens), np.int64, n)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        made = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))
        key = left * n + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.by_rank = made
        self.splitter = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at: list[int] = []
        self.count: list[int] = []

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        done_ids, done_word, done_place = [], [], []
        place = np.arange(len(symbols))
        none = len(self.by_rank)
        while len(symbols):
            near = word[1:] == word[:-1]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(near & (self.keys[at] == key), self.ranks[at], none)
            first = np.flatnonzero(np.concatenate(([True], ~near)))
            lowest = np.minimum.reduceat(np.append(rank, none), first)
            sizes = np.diff(np.append(first, len(symbols)))
            live = np.repeat(lowest < none, sizes)
            hit = np.append((rank == np.repeat(lowest, sizes)[:-1]) & (rank < none), False)
            if hit[1:][hit[:-1]].any():  # overlapping occurrences: every second one of a run, from the left
                edge = np.flatnonzero(np.concatenate(([hit[0]], hit[1:] & ~hit[:-1])))
                since = np.arange(len(hit)) - np.repeat(edge, np.diff(np.append(edge, len(hit)))) if edge[0] == 0 else np.arange(len(hit)) - np.concatenate((np.zeros(edge[0], np.int64), np.repeat(edge, np.diff(np.append(edge, len(hit))))))
                hit &= since % 2 == 0
            if not live.all():
                done_ids.append(symbols[~live])
                done_word.append(word[~live])
                done_place.append(place[~live])
            symbols = symbols.copy()
            symbols[hit] = self.by_rank[np.append(rank, none)[hit]]
            keep = live & ~np.concatenate(([False], hit[:-1]))
            symbols, word, place = symbols[keep], word[keep], place[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner, where = np.concatenate(done_ids), np.concatenate(done_word), np.concatenate(done_place)
        return ids[np.argsort(where, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def learn(self, pieces: list[str]) -> None:
        words, of = [], []
        for i, p in enumerate(pieces):
            found = PATTERN.findall(p)
            words += found
            of += [i] * len(found)
        ids, n = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        total = np.bincount(np.asarray(of, np.int64), weights=n, minlength=len(pieces)).astype(np.int64)
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store[: self.used], np.zeros(max(len(self.store), len(ids)), np.int32)))
        self.store[self.used : self.used + len(ids)] = ids
        at = self.used + np.concatenate(([0], np.cumsum(total)))[:-1]
        start = len(self.at)
        self.known.update(zip(pieces, range(start, start + len(pieces)), strict=True))
        self.at += at.tolist()
        self.count += total.tolist()
        self.used += len(ids)

    def _pieces(self, text: str) -> list[str]:
        if AWKWARD.search(text):
            return PATTERN.findall(text)
        head, _, rest = text.partition(" ")
        out = [head] if head else []
        if _:
            out += (" " + rest.replace(" ", "\0 ")).split("\0") if "\0" not in rest else [" " + p for p in rest.split(" ")]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        parts: list[list[str]] = []
        owner: list[int] = []  # of each run of parts
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.splitter and self.splitter.search(text):
                for j, x in enumerate(self.splitter.split(text)):
                    if j % 2:
                        parts.append([x])
                        owner.append(-1 - i)
                    elif x:
                        parts.append(self._pieces(x))
                        owner.append(i)
            else:
                parts.append(self._pieces(text))
                owner.append(i)
        if len(self.known) > self.memory:
            self.forget()
        new = dict.fromkeys(p for run, o in zip(parts, owner, strict=True) if o >= 0 for p in run if p not in self.known)
        if new:
            self.learn(list(new))
        at, count = np.asarray(self.at, np.int64), np.asarray(self.count, np.int64)
        out, sizes = [], np.zeros(len(texts), np.int64)
        get = self.known.__getitem__
        for run, o in zip(parts, owner, strict=True):
            if o < 0:
                out.append(np.array([self.special[run[0]]], np.int32))
                sizes[-1 - o] += 1
                continue
            k = np.fromiter(map(get, run), np.int64, len(run))
            n = count[k]
            total = int(n.sum())
            ends = np.cumsum(n)
            out.append(self.store[np.repeat(at[k] - ends + n, n) + np.arange(total)])
            sizes[o] += total
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        n = self.token_len[ids]
        ends = np.cumsum(n)
        return self.token_bytes[np.repeat(self.token_at[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


@cache
def vocabulary(path: str) -> NumpyBPE:
    """One vocabulary a process, with what it has learnt."""
    return NumpyBPE(path)


def _runs(texts: list, size: int = 1 << 21):
    """Ranges of texts of about ``size`` characters."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n > size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_text(docs: DataFrame, text: Column, tokenizer: str) -> Column:
    """``array<int>`` of the ids of a text column."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(col: pa.Array) -> pa.Array:
        bpe, texts = vocabulary(tokenizer), col.to_pylist()
        ids, sizes = zip(*(bpe.encode(texts[a:b]) for a, b in _runs(texts)), strict=True) if texts else ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)), pa.array(np.concatenate(ids)))

    return encode(text)


def decode_ids(docs: DataFrame, ids: Column, tokenizer: str) -> Column:
    """The text of a column of ids; bytes that aren't UTF-8 become U+FFFD."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def decode(col: pa.Array) -> pa.Array:
        bpe = vocabulary(tokenizer)
        return pa.array([None if x is None else bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in col.to_pylist()], pa.string())

    return decode(ids)


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them.

    Encoding and decoding happen in one pass, so the ids never leave the worker.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    def digests(col: pa.Array) -> pa.Array:
        bpe, texts = vocabulary(tokenizer), col.to_pylist()
        n, a, b = [], [], []
        for s, e in _runs(texts):
            ids, sizes = bpe.encode(texts[s:e])
            ends = np.cumsum(sizes)
            for x in np.split(ids, ends[:-1]):
                n.append(len(x))
                a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(x).decode("utf-8", "replace").encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("__text"))
    return rows.select("doc_id", digests("__text").alias("__d")).select("doc_id", "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")
