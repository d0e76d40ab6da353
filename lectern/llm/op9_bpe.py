"""BPE encoding and decoding in batched numpy merge rounds.

A vocabulary file of the tokenizers library (byte-level BPE with word ends) is read once on the driver. Texts
are split into pieces as that library splits them; the pieces not met before are merged together: the symbols
of all of them lie in one flat array, each round finds every neighbour pair's rank by binary search over the
sorted pair keys, and merges the lowest-ranked pair of each word at once. A bounded memo keeps what a worker
has already merged. A round looks at every symbol of its words, so words of more than LONG bytes (base64, genomes)
are merged apart: their first ranks come from the same binary search, and a heap then takes the lowest-ranked pair
and ranks only the two pairs that it changes, which is linearithmic in the word.

Defined results: a null or blank text has no ids and decodes to the empty string; the special strings of the
vocabulary become their own ids, as the library does; repeated rows each keep a row; whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectern.llm.textkit import row_chunks, small_batches

#: Pieces a worker remembers, and characters of text in one round of merging.
MEMO, CHUNK_CHARS, VOCABULARY_BYTES = 150_000, 1 << 20, 64 << 20
#: Bytes of a word from which a heap takes over; such words are not remembered.
LONG = 256
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        if os.path.getsize(path) > VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.tokens = {i: token for token, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: s for s, i in self.special.items()})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = pattern.replace(r"\s", r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
        self.size = max(self.tokens) + 1
        symbols, end = byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.long: dict[int, tuple[int, int]] | None = None
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.text = {i: t.encode("utf-8") for i, t in self.tokens.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "cut", "memo", "text")} | {"long": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, found by binary search over the sorted pair keys."""
        key = left * self.size + right
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        return np.where(self.keys[found] == key, self.order[found], _NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word, by a heap of its pairs' ranks and places."""
        if self.long is None:
            self.long = {int(key): (int(rank), int(self.merged[rank])) for key, rank in zip(self.keys, self.order, strict=True)}
        known, size = self.long, self.size
        flat = np.frombuffer(word, np.uint8)
        first = self.inner[flat]
        first[-1] = self.final[flat[-1]]
        rank = self.ranks(first[:-1], first[1:])
        some = np.flatnonzero(rank != _NONE)
        ids, n = first.tolist(), len(first)
        heap = list(zip(rank[some].tolist(), some.tolist(), strict=True))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            found, at = heapq.heappop(heap)
            ahead = after[at]
            if ids[at] < 0 or ahead >= n or (pair := known.get(ids[at] * size + ids[ahead])) is None or pair[0] != found:
                continue  # merged or changed since it was ranked
            ids[at], ids[ahead], after[at] = pair[1], -1, after[ahead]
            if after[at] < n:
                before[after[at]] = at
            for x in (before[at], at):
                if x >= 0 and after[x] < n and (pair := known.get(ids[x] * size + ids[after[x]])) is not None:
                    heapq.heappush(heap, (pair[0], x))
        return np.array([i for i in ids if i >= 0], np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one word after another, and the offsets of the words."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[flat[last]]
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), _NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            over = best == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit):  # of overlapping occurrences of one pair, every second from the left
                start = np.append(True, np.diff(hit) != 1)
                nth = np.arange(len(hit)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                hit = hit[nth % 2 == 0]
                ids[hit] = self.merged[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def pieces(self, text: str) -> list[str]:
        """A text's pieces in normal form, lower case; special strings stand for themselves."""
        if self.cut and "<" in text and len(parts := self.cut.split(text)) > 1:
            return [p for part in parts for p in ([part] if part in self.special else self.pieces(part))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would look at a sigma's context
        return self.split(text.lower())

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Merges the pieces that the memo lacks; returns those too long to be remembered."""
        new = [p for p in pieces if p not in self.memo]
        raw = {p: p.encode("utf-8", "surrogatepass") for p in new if p not in self.special}
        for p in new:
            if p in self.special:
                i = self.special[p]
                self.memo[p] = (np.uint32(i).tobytes(), self.text[i])
        if words := [p for p, w in raw.items() if len(w) <= LONG]:
            ids, offsets = self.merge([raw[p] for p in words])
            flat, names = ids.astype("<u4").tobytes(), list(map(self.text.__getitem__, ids.tolist()))
            for p, (a, b) in zip(words, pairwise(offsets.tolist()), strict=True):
                self.memo[p] = (flat[4 * a : 4 * b], b" ".join(names[a:b]))
        merged = ((p, self.merge_long(w)) for p, w in raw.items() if len(w) > LONG)
        return {p: (ids.astype("<u4").tobytes(), b" ".join(map(self.text.__getitem__, ids.tolist()))) for p, ids in merged}

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and their decoding in UTF-8."""
        split = [self.pieces(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        long = self.learn(new)
        self.memo.update(long)
        out = []
        for pieces in split:
            got = list(map(self.memo.__getitem__, pieces))
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
        for p in long:
            del self.memo[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by a space: the vocabulary names no decoder."""
        return b" ".join(map(self.text.__getitem__, ids)).decode("utf-8")


def _chunks(column: pa.Array) -> Iterator[list[str | None]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in row_chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), CHUNK_CHARS):
        yield column.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian u32)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe(path))
    out = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        out = out.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                got = model.encode_batch(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()),
                    pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([g[0] for g in got], pa.binary())] if ids else []), names=out.fieldNames())
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def vocabulary() -> str:
    """The place of the public word-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op9 over the whole documents table."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary(), ids=False)
