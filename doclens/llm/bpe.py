"""Byte-pair encoding by forced boundaries.

A pair of bytes that stands side by side inside no vocabulary token can never be
merged over, so every such pair in a text is a certain cut. Each pre-token is cut there, the
fragments are encoded independently (and remembered), and their ids concatenated; the result is the one that
encoding the whole pre-token gives.

Defined cases: null counts as empty and has no ids; a special token's string in a text
becomes its id; rows with equal or null ids are treated one by one; an empty table gives an empty
result; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import re
import sys
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import arrow_map, table, texts, trim

#: The usual pre-tokenization, the commonest case first; a contraction starts with no letter, digit or space, so the order among these is free.
WORDS = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable() -> dict[str, int]:
    """The vocabulary file's stand-in character of each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """A bounded memory of f's values; emptied when full, which costs time only."""

    def __init__(self, f, most: int):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.f(key)
        return value


class ForcedBoundaryBPE:
    """Byte-level BPE of a tokenizers JSON file. Encoded texts are little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, most: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = printable()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(byte[c] for c in t) for t in vocab if all(c in byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.of_byte = [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.token = {vocab[t]: b for t, b in raw.items()} | {i: t.encode() for t, i in self.special.items()}
        inside = np.zeros(65536, bool)
        for b in raw.values():
            x = np.frombuffer(b, np.uint8).astype(np.int32)
            inside[x[:-1] * 256 + x[1:]] = True
        #: For each pair of bytes, whether it is a certain cut.
        self.cut = bytes(~inside)
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(WORDS)
        self.fragment = Remembered(self._merge, most // 4)
        #: A library's merge loop for fragments that are valid UTF-8, if ids are in the order of merging.
        self.native = None
        if all(new == 256 + r for r, new in self.ranks.values()) and sorted(self.of_byte) == list(range(256)):
            with contextlib.suppress(ImportError):
                import tiktoken

                self.native = tiktoken.Encoding("fragment", pat_str=r"[\s\S]+", mergeable_ranks={b: vocab[t] for t, b in raw.items()}, special_tokens={}).encode_ordinary
        self.word = Remembered(self._word, most)

    def fragments(self, raw: bytes) -> list[bytes]:
        """The pieces between certain cuts."""
        cut = self.cut
        at = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if cut[a << 8 | b]]
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])] if at else [raw]

    def _word(self, word: str) -> bytes:
        pieces = self.fragments(word.encode())
        return self._merge(pieces[0]) if len(pieces) == 1 else b"".join(map(self.fragment.__getitem__, pieces))

    def _merge(self, raw: bytes) -> bytes:
        if self.native is not None:
            try:
                return array("I", self.native(raw.decode())).tobytes()
            except UnicodeDecodeError:
                pass
        return self._merge_own(raw)

    def _merge_own(self, raw: bytes) -> bytes:
        ids, ranks = [self.of_byte[b] for b in raw], self.ranks
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((ranks[p] for p in zip(ids, ids[1:]) if p in ranks), default=None)
            if best is None:
                break
            new, out, i, n = best[1], [], 0, len(ids)
            while i < n:
                if i + 1 < n and ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return np.array(ids, "<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same by a heap and links, in n log n, for long fragments."""
        import heapq

        n, ranks = len(ids), self.ranks
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = ranks[a, b][1], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in ranks:
                    heapq.heappush(heap, (ranks[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return np.array([t for t, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def forget(self) -> None:
        """Hands back what was remembered, at the end of a task: the worker goes on to others."""
        self.word.clear()
        self.fragment.clear()
        trim()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One per worker process."""
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row. No shuffle; `path` must be readable on the executors."""

    def run(batch):
        e = encoder(path)
        return {"id": batch.column(0), "ids": [np.frombuffer(e.encode(t), "<u4").astype(np.int32) for t in texts(batch, 1)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>", lambda: encoder(path).forget()).withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; null ids give an empty text."""

    def run(batch):
        e = encoder(path)
        return {"id": batch.column(0), "text": [e.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]}

    kind = ids.schema[id_col].dataType.simpleString()
    return arrow_map(ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Contract columns for each row of (doc_id, text)."""

    def run(batch):
        e = encoder(path)
        out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts(batch, 1):
            ids = e.encode(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: encoder(path).forget())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())


assert sys.byteorder == "little"
