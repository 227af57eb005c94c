"""Benchmark decontamination by greedy string tiling.

A document and a test item are compared if they share a seed: a run of `min_match` equal tokens.
Seeds are found by rolling (Karp-Rabin) hashes against a sorted table of the items'. Then the longest common run of unmarked tokens is found by such hashes, too, and
marked as a tile, again and again, until none of `min_match` tokens is left; each token is in one
tile at most, so moved passages count and repeated ones count once. A pair
is reported if tiles cover at least `threshold` of the item's tokens.

The test set is a stated query set. It is taken in blocks of at most `block_tokens` tokens,
each a bounded constant of one scan of the documents; a small test set is one block. What a block found or left is written
before the next is read, so driver and plan hold one at a time.

Defined cases: null and empty texts match nothing; an item shorter than `min_match` tokens (but not
empty) must occur whole; equal items are reported each; repeated documents are reported each; an empty
table on either side gives an empty result; other columns are ignored by `contaminated` and kept by `decontaminate`.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import arrow_map, mix, slices, table, written

#: ASCII letters in lower case, digits, and all bytes above ASCII stay; the rest separates tokens.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


#: Of the rolling hashes; odd, so that its powers are all different from 0.
BASE = 0x5851F42D4C957F2D


def tokens(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(1000003) + ids[i : i + n].astype(np.uint64)
    return mix(h)


class Runs:
    """A sequence's runs of unmarked tokens, hashed by Karp and Rabin's rule: a run's hash comes from two sums."""

    def __init__(self, ids: list[int], powers: np.ndarray):
        self.ids, self.n, self.powers = np.array(ids, np.int64), len(ids), powers
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.ids.astype(np.uint64)) * powers[: self.n], dtype=np.uint64)])
        self.done = bytearray(self.n)

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of `size` tokens that hold no marked one."""
        marks = np.concatenate([[0], np.cumsum(np.frombuffer(self.done, np.uint8), dtype=np.int64)])
        i = np.flatnonzero(marks[size:] == marks[:-size])
        return i, (self.sums[i + size] - self.sums[i]) * self.powers[len(self.powers) - 1 - i]

    def free(self, i: int, size: int) -> bool:
        return self.done.find(1, i, i + size) < 0

    def mark(self, i: int, size: int) -> None:
        self.done[i : i + size] = b"\1" * size


def tiles(pattern: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length), each token marked once, longest first, then earliest.

    Each round finds the longest common run of unmarked tokens by running Karp-Rabin for search lengths that close in on it, and marks its matches that don't overlap.
    """
    out: list[tuple[int, int, int]] = []
    top = min(len(pattern), len(text))
    if top < min_match:
        return out
    powers = np.cumprod(np.concatenate([[1], np.full(max(len(pattern), len(text)), BASE)]).astype(np.uint64), dtype=np.uint64)
    p, t = Runs(pattern, powers), Runs(text, powers)

    def meet(size: int) -> bool:
        return size <= top and bool(np.isin(p.at(size)[1], t.at(size)[1]).any())

    while top >= min_match and meet(min_match):
        low, high = min_match, min(2 * min_match, top + 1)  # low meets, high doesn't or is beyond
        while high <= top and meet(high):
            low, high = high, min(2 * high, top + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if meet(middle) else (low, middle)
        (i, hi), (j, hj) = p.at(low), t.at(low)
        order = np.argsort(hj, kind="stable")
        j, hj = j[order], hj[order]
        first, end = np.searchsorted(hj, hi, "left"), np.searchsorted(hj, hi, "right")
        tried: dict[int, int] = {}  # places of a hash before this one are marked
        found = False
        for a, k, stop in zip(i.tolist(), first.tolist(), end.tolist()):
            at = tried.get(k, k)
            while at < stop and p.free(a, low):
                b = int(j[at])
                if not t.free(b, low):
                    at += 1
                elif (p.ids[a : a + low] == t.ids[b : b + low]).all():
                    p.mark(a, low)
                    t.mark(b, low)
                    out.append((a, b, low))
                    found = True
                else:  # equal hashes by chance
                    at += 1
            tried[k] = at
        top = low if found else low - 1
    return out


class Block:
    """A bounded number of items and the table of their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, threshold: float):
        self.min_match, self.threshold = min_match, threshold
        self.words: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in items:
            self.items.append((item, [self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)]))
        self.tables = []  # a size of seeds, their sorted hashes, the items of each
        for size in sorted({min(min_match, len(x)) for _, x in self.items if x}):
            of = defaultdict(set)
            for k, (_, x) in enumerate(self.items):
                if min(min_match, len(x)) == size:
                    for h in rolling(np.array(x), size).tolist():
                        of[h].add(k)
            self.tables.append((size, np.array(sorted(of), np.uint64), dict(of)))

    def match(self, raw: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item, covered share, matched tokens, tiles) of the items that reach the threshold."""
        if not raw or not self.tables:
            return []
        words = tokens(raw)
        ids = np.fromiter(map(self.words.get, words, (0 for _ in words)), np.int32, len(words))
        found: dict[int, list[int]] = defaultdict(list)
        for size, seeds, of in self.tables:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            known = np.concatenate([[0], np.cumsum(ids != 0)])
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = rolling(ids, size)[at]
            k = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
            hit = seeds[k] == h
            for pos, x in zip(at[hit].tolist(), h[hit].tolist()):
                for item in of[x]:
                    found[item].append(pos)
        out = []
        for k in sorted(found):
            item, pattern = self.items[k]
            size = min(self.min_match, len(pattern))
            # Only seeds can begin tiles: the document is cut down to runs of seeds, kept apart by a token that matches nothing.
            text: list[int] = []
            end = 0
            for pos in found[k]:
                if pos >= end:
                    text.append(0)
                    end = pos
                text += ids[end : pos + size].tolist()
                end = pos + size
            got = tiles(pattern, text, size)
            matched = sum(n for *_, n in got)
            if matched >= self.threshold * len(pattern):
                out.append((item, matched / len(pattern), matched, len(got)))
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, min_match: int, threshold: float, block_tokens: int):
    """The test set, in blocks."""
    items, size = [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        if not (n := len(tokens(text))):
            continue
        if items and size + n > block_tokens:
            yield Block(items, min_match, threshold)
            items, size = [], 0
        items.append((item, text))
        size += n
    if items:
        yield Block(items, min_match, threshold)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, threshold: float = 0.6, block_tokens: int = 2_000_000
) -> DataFrame:
    """(id, item id, coverage, matched, tiles) for each pair that reaches the threshold. No shuffle."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, coverage double, matched long, tiles long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts, last = [], None
    for block in blocks(benchmark, item_col, item_text_col, min_match, threshold, block_tokens):

        def run(batch, block=block):
            got = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in block.match(t)]
            return {c: [g[k] for g in got] for k, c in enumerate(("id", "item", "coverage", "matched", "tiles"))}

        if last is not None:
            parts.append(written(last, "contaminated"))  # and with it goes its block
        last = arrow_map(rows, run, schema)
    parts.append(docs.sparkSession.createDataFrame([], schema) if last is None else last)
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, threshold: float = 0.6, block_tokens: int = 2_000_000) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    at, kept, schema = docs.schema.names.index(text_col), None, docs.schema
    for block in blocks(benchmark, item_col, item_text_col, min_match, threshold, block_tokens):

        def run(batches, block=block):
            for batch in slices(batches):
                raw = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not block.match(t) for t in raw], pa.bool_()))

        docs = (docs if kept is None else written(kept, "decontaminated")).mapInArrow(run, schema)
        kept = docs
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row for each pair."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
