"""A smoothed trigram model of the corpus, scored on every text of it.

A token of a text is one of its words (lower-cased in ASCII, parted by ASCII white space) or the end. Each trigram of a text
goes to the shard of the word in its middle. A shard thus holds all trigrams of its middle words; it builds an Elias-Fano trie from
those of training texts and looks up all of them. Probabilities, by absolute discounting (D):

* trigram seen: (c3 - D)/c(context) + b3 * p2; context seen only: b3 * (what the bigram gives)
* bigram seen: p2 = (c2 - D)/c(middle); not: b2 * p1
* p1 = (c + 1)/(N + V + 1), which is known in the shard of the word itself; it sees, too, whether the bigram was
  seen, and adds it, so no second look-up is needed.

There is one model, whatever the number of partitions: probabilities lie on one fixed grid, and sums are sums of integers.

What is sent. A task gathers a chunk of tokens, counts its distinct trigrams and sends each of them once, with the numbers of the texts
that hold it. The `top` most frequent words (a bounded list, with their counts) have short codes; other words' hashes stand in a
dictionary of the blob. A chunk is bounded, so a trigram, however common, is one entry of a chunk.

Words of more than `split` training tokens are split by a hash class of the word before them; only listed words can be. Contexts (left, middle) are
whole in a class. Bigrams of split words are counted beforehand over all classes, by (middle, right), and sent to the shards that hold the pair.
Splitting is a matter of where things lie: scores are those of an unsplit model.

Defined cases: null counts as empty, a text of the end alone; without training texts N = V = 0 and every
token has probability 1; rows are scored one by one, so repeated ids and texts keep their rows; a null id is not held out; an empty table gives
an empty result; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import GOLD, crc_mod, mix, packed, released, runs_of, table, trim, unpacked, written
from doclens.llm.elias_fano import STEP, Trie

#: Hashes of the end, of what stands before a text and of what stands after it. A word has at least one byte, so none hashes these strings but by chance.
END, BEFORE, AFTER = (xxhash.xxh64_intdigest(b"\0" + x) for x in (b"end", b"before", b"after"))
#: Tokens and distinct words that a task gathers before it sends them, tokens of a shard (about) and of a word that isn't split, and words of the list of codes.
CHUNK, WORDS, SHARD, SPLIT, TOP = 3_000_000, 1_500_000, 1_000_000, 750_000, 1 << 18
#: Base probabilities are summed as integers, in this part of log10, and in two halves, so that no text is too long.
UNIT, HALF = 2.0**-44, 24
#: Bytes of the texts that are parted into words at once; a longer text is parted alone.
ROOM = 1 << 21


def worded(batches: Iterator[pa.RecordBatch], column: int, room: int = ROOM) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(some rows, how many words each has, the words as numbers, the hashes of the distinct words that these name): lower-cased in ASCII, parted by ASCII white space."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at)))
            sizes, coded = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
            codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()
            if b"" in words:  # before or after white space at an end
                void = words.index(b"")
                sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[codes == void], minlength=len(sizes))
                codes = codes[codes != void]
                codes = codes - (codes > void)
                del words[void]
            yield batch.slice(at, to - at), sizes, codes, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            at = to


def unigrams(training: DataFrame) -> DataFrame:
    """(h, n): each token's hash and count, of texts in the only column. Counted within tasks first, of which each holds a bounded number of words."""

    def merged(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(h), return_inverse=True)
        return h, np.bincount(at, np.concatenate(n), len(h)).astype(np.int64)

    def run(batches):
        h, n, size = [], [], 0
        for _, sizes, codes, words in worded(batches, 0):
            h.append(np.append(words, np.uint64(END)))
            n.append(np.append(np.bincount(codes, minlength=len(words)), len(sizes)))
            size += len(words) + 1
            if size >= WORDS:
                one, count = merged(h, n)
                h, n, size = [one], [count], len(one)
                if size >= WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int64)), pa.array(count)], ["h", "n"])
                    h, n, size = [], [], 0
        if h:
            one, count = merged(h, n)
            yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int64)), pa.array(count)], ["h", "n"])

    return training.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 0")


class Known:
    """The list of codes: what stands before, the end, what stands after, then the most frequent words; their training counts; classes of split words (0: whole)."""

    def __init__(self, h: np.ndarray, n: np.ndarray, split: int):
        self.h, self.n = h, n
        self.classes = np.where(n > split, -(-n // split) + 1, 0)
        self.order = np.argsort(h)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Of hashes; -1 of those not listed."""
        at = self.order[np.minimum(np.searchsorted(self.h, h, sorter=self.order), len(self.h) - 1)]
        return np.where(self.h[at] == h, at, -1)

    def pack(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, the dictionary that they need beside the list, as gaps): of hashes."""
        codes = self.codes(h)
        rare, back = np.unique(h[codes < 0], return_inverse=True)
        codes[codes < 0] = len(self.h) + back
        return codes.astype(np.uint32), np.diff(rare, prepend=np.uint64(0))

    def hashes(self, gaps: np.ndarray) -> np.ndarray:
        """Of all codes."""
        return np.concatenate([self.h, np.cumsum(gaps, dtype=np.uint64)])


class Chunk:
    """Tokens of texts, as numbers of the task's own."""

    def __init__(self, most: int):
        self.most, self.words, self.held, self.sizes, self.docs, self.size, self.named = most, [], [], [], [], 0, 0

    def add(self, sizes: np.ndarray, codes: np.ndarray, words: np.ndarray) -> None:
        """Texts as `worded` gives them."""
        sizes = sizes + 3
        x, end = np.full(int(sizes.sum()), -1, np.int32), np.cumsum(sizes)
        x[end - sizes], x[end - 2], x[end - 1] = 0, 1, 2
        x[x < 0] = codes + np.int32(self.named + 3)
        self.words.append(words)
        self.held.append(x)
        self.sizes.append(sizes)
        self.size, self.named = self.size + len(x), self.named + len(words)

    def full(self, sizes: np.ndarray) -> bool:
        """Whether texts of so many words go beyond it."""
        return bool(self.held) and (self.size + int(sizes.sum()) + 3 * len(sizes) > self.most or self.named >= WORDS)

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the distinct tokens, the tokens as numbers of these); what was added goes."""
        h, back = np.unique(np.concatenate(self.words), return_inverse=True)
        of = np.concatenate([np.arange(3), back + 3]).astype(np.int32)
        ids = of[np.concatenate(self.held)]
        self.words.clear()
        self.held.clear()
        return np.concatenate([np.array([BEFORE, END, AFTER], np.uint64), h]), ids


def slots(h: np.ndarray, code: np.ndarray, known: Known, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of each word, its first slot, the shard of each slot): a whole word has one slot, a split one a slot for each class."""
    classes = np.zeros(len(h), np.int64)
    listed = code < len(known.h)
    classes[listed] = known.classes[code[listed]]
    wide = np.maximum(classes, 1)
    first = np.cumsum(wide) - wide
    word = np.repeat(np.arange(len(h)), wide)
    number = (np.arange(len(word)) - first[word]).astype(np.uint64)
    shard = (mix(h[word] + GOLD * number) % np.uint64(shards)).astype(np.int64)
    return classes, first, shard


def gaps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of values that ascend within runs; the first of a run stands itself."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out.astype(np.uint32)


def ungapped(g: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(g, dtype=np.int64)
    first = np.cumsum(runs, dtype=np.int64) - runs
    return total - np.repeat(total[first] - g[first], runs)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> HALF, x & (1 << HALF) - 1


SENT = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("trigrams", pa.binary()), ("docs", pa.binary()), ("header", pa.binary())])


def _send(shards: int, known: Known, room: float, chunk: int):
    """Map side: (shard, chunk, trigrams, docs, header). Base probabilities of listed words are summed here."""
    listed = np.rint((np.log10(known.n + 1.0) - room) / -UNIT).astype(np.int64)

    def flush(number: int, c: Chunk) -> Iterator[pa.RecordBatch]:
        (h, ids), sizes = c.told(), np.concatenate(c.sizes)
        code, rare = known.codes(h), np.zeros(0, np.uint64)
        new = np.flatnonzero(code < 0)
        new = new[np.argsort(h[new])]
        code[new], rare = len(known.h) + np.arange(len(new)), h[new]
        # What the list tells of each text.
        start = np.cumsum(sizes) - sizes
        base, seen = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        here = code < len(known.h)
        base[here], seen[here] = listed[code[here]], known.n[code[here]] > 0
        base[[0, 2]] = seen[[0, 2]] = 0
        ids_, held_out, n_tokens = zip(*c.docs)
        valid, train = np.array([i is not None for i in ids_], bool), ~np.array(held_out, bool)
        header = packed(np.array([i or 0 for i in ids_], np.int64), valid, ~train, np.array(n_tokens, np.int64), *(np.add.reduceat(x[ids], start) for x in (*halves(base), seen)))
        # Trigrams within a text, by the shard and the code of their middle.
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        ok = np.flatnonzero(doc[2:] == doc[:-2])
        classes, first, shard = slots(h, code, known, shards)
        left, middle = ids[ok], ids[ok + 1]
        slot = first[middle]
        split = np.flatnonzero(classes[middle])
        slot[split] += (mix(h[left[split]]) % classes[middle[split]].astype(np.uint64)).astype(np.int64)
        own = np.repeat(code, np.maximum(classes, 1))
        places, place = np.unique(shard << 32 | own, return_inverse=True)
        bits = max(len(places), len(known.h) + len(new)).bit_length()
        pairs = None
        if 3 * bits > 63:  # a text of very many words
            bits = 31
            pairs, pair = np.unique(place[slot] << bits | code[left], return_inverse=True)
            key = pair << bits | code[ids[ok + 2]]
        else:
            key = (place[slot] << bits | code[left]) << bits | code[ids[ok + 2]]
        doc = doc[ok]
        del ids, ok, left, middle, slot, split
        order = np.argsort(key)  # the order of texts within a trigram says nothing
        key, doc = key[order], doc[order]
        del order
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(at, len(key))).astype(np.uint32)
        t = np.add.reduceat(train[doc].astype(np.uint32), at)
        key = key[at]
        right, pair = key & (1 << bits) - 1, key >> bits
        if pairs is not None:
            pair = pairs[pair]
        left, of = pair & (1 << bits) - 1, places[pair >> bits]
        middle, to = of & (1 << 32) - 1, of >> 32
        del key, of, pair
        rows = [(number % shards, number, None, None, header)]
        k = len(known.h)
        for a, b in runs_of(to):
            x = np.stack([middle[a:b], left[a:b], right[a:b]])
            beyond = x >= k
            names, back = np.unique(x[beyond], return_inverse=True)
            x[beyond] = k + back
            m, lo, r = x
            edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            e = at[b] if b < len(at) else len(doc)
            value = packed(
                np.diff(m[edge], prepend=0).astype(np.uint32), np.diff(np.append(edge, b - a)).astype(np.uint32), gaps(lo, edge), r.astype(np.uint32), n[a:b], t[a:b], np.diff(rare[names - k], prepend=np.uint64(0))
            )
            rows.append((int(to[a]), number, value, packed(doc[at[a] : e]), None))
        for k in range(0, len(rows), 16):
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows[k : k + 16]] for i, f in enumerate(SENT)}, SENT)

    def run(batches):
        from pyspark import TaskContext

        number, c = TaskContext.get().partitionId() << 24, Chunk(chunk)
        for batch, sizes, codes, words in worded(batches, 2, min(ROOM, 2 * chunk)):
            if c.full(sizes):
                yield from flush(number, c)
                number, c = number + 1, Chunk(chunk)
                trim()
            c.add(sizes, codes, words)
            c.docs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (sizes + 1).tolist())
        if c.held:
            yield from flush(number, c)
        del c
        trim()

    return run


def _send_pairs(shards: int, known: Known, chunk: int):
    """Map side: (shard, pairs), bigrams after split words, each with the shards that hold it and its training count."""

    split = known.h[known.classes > 0]
    split = split[split != np.uint64(END)]  # no word follows the end
    wide, first, shard = slots(split, known.codes(split), known, shards)

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        middle, left, right, trained = (np.concatenate(x) for x in zip(*parts))
        target = shard[first[middle] + (mix(left) % wide[middle].astype(np.uint64)).astype(np.int64)]
        h, right = np.unique(right, return_inverse=True)
        words, to_word = np.unique(middle, return_inverse=True)
        keys, to_key = np.unique((to_word * shards + target) * len(h) + right, return_inverse=True)
        count = np.bincount(to_key, trained, len(keys)).astype(np.uint32)
        right = h[keys % len(h)]
        middle, target = split[words[keys // len(h) // shards]], (keys // len(h) % shards).astype(np.uint32)
        to = (mix(middle ^ mix(right)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows = []
        for a, b in runs_of(to[order]):
            o = order[a:b]
            m, r = known.codes(middle[o]).astype(np.uint32), known.pack(right[o])
            rows.append((int(to[o[0]]), packed(m, target[o], *r, count[o])))
        return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int32()), "pairs": pa.array([r[1] for r in rows], pa.binary())})

    def run(batches):
        parts, held = [], 0
        for batch, sizes, codes, words in worded(batches, 1, min(ROOM, 2 * chunk)):
            order = np.argsort(words)
            place = np.searchsorted(words, split, sorter=order)
            own = np.full(len(words), -1)
            here = np.flatnonzero(place < len(words))
            here = here[words[order[place[here]]] == split[here]]
            own[order[place[here]]] = here
            middle = own[codes]
            at = np.flatnonzero(middle >= 0)
            if not len(at):
                continue
            end = np.cumsum(sizes)
            begins, ends = np.zeros(len(codes) + 1, bool), np.zeros(len(codes) + 1, bool)
            begins[end - sizes], ends[end[sizes > 0] - 1] = True, True
            left, right = words[codes[at - 1]], words[codes[np.minimum(at + 1, len(codes) - 1)]]
            left[begins[at]], right[ends[at]] = np.uint64(BEFORE), np.uint64(END)
            train = np.array([not out for out in batch.column(0).to_pylist()], bool)
            parts.append((middle[at], left, right, np.repeat(train, sizes)[at]))
            held += len(at)
            if held >= chunk:
                yield flush(parts)
                parts, held = [], 0
                trim()
        if parts:
            yield flush(parts)
        del parts
        trim()

    return run


MERGED = pa.schema([("shard", pa.int32()), ("pairs", pa.binary()), ("code", pa.int64()), ("types", pa.int64())])


def _merge_pairs(known: Known):
    """Reduce side: whole counts of bigrams, for the shards that hold them, and how many distinct tokens follow each middle (code, types)."""

    def run(t: pa.Table) -> pa.Table:
        got = [unpacked(x) for x in t["pairs"].to_pylist()]
        middle, target, count = (np.concatenate([x[i] for x in got]) for i in (0, 1, 4))
        right = np.concatenate([known.hashes(x[3])[x[2]] for x in got])
        order = np.lexsort((target, right, middle))
        middle, target, right, count = middle[order], target[order], right[order], count[order].astype(np.int64)
        new = np.concatenate([[True], (middle[1:] != middle[:-1]) | (right[1:] != right[:-1])])
        first = np.flatnonzero(new)
        whole = np.add.reduceat(count, first)
        codes, to_code = np.unique(middle[first], return_inverse=True)
        types = np.bincount(to_code, whole > 0).astype(np.int64)
        c2 = whole[np.cumsum(new) - 1]
        asked = np.flatnonzero((new | np.concatenate([[True], target[1:] != target[:-1]])) & (c2 > 0))
        asked = asked[np.argsort(target[asked], kind="stable")]
        rows = []
        for a, b in runs_of(target[asked]):
            o = asked[a:b]
            rows.append((int(target[o[0]]), packed(middle[o], *known.pack(right[o]), c2[o]), None, None))
        rows += [(None, None, *x) for x in zip(codes.tolist(), types.tolist())]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(MERGED)], schema=MERGED)

    return run


PART = pa.schema([("chunk", pa.int64()), ("sums", pa.binary()), ("header", pa.binary())])


def _shard(known: Known, types: dict[int, int], room: float, discount: float):
    """Reduce side: a trie of the shard's training trigrams, looked up for all of them; sums per chunk and text. types: distinct tokens that follow, of split words by code."""
    steps = lambda c: np.rint((np.log10(c + 1.0) - room) / -STEP).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        rows = [(c, None, x) for c, x in zip(t["chunk"].to_pylist(), t["header"].to_pylist()) if x is not None]
        got = [(c, d, unpacked(x)) for c, x, d in zip(t["chunk"].to_pylist(), t["trigrams"].to_pylist(), t["docs"].to_pylist()) if x is not None]
        if got:
            # Words are numbered by the list, and beyond it by the shard's own dictionary.
            k, of, docs = len(known.h), [c for c, *_ in got], [d for _, d, _ in got]
            own = [np.cumsum(x[6], dtype=np.uint64) for *_, x in got]
            rare, number = np.unique(np.concatenate(own), return_inverse=True)
            begin = np.cumsum([0, *map(len, own)])

            def numbered(codes: np.ndarray, number: np.ndarray) -> np.ndarray:
                codes = codes.astype(np.int64)
                beyond = np.flatnonzero(codes >= k)
                codes[beyond] = k + number[codes[beyond] - k]
                return codes.astype(np.int32) if k + len(rare) < 1 << 31 else codes

            parts = []
            for i, (*_, (m, runs, left, right, n, train, _)) in enumerate(got):
                here = number[begin[i] : begin[i + 1]]
                parts.append((numbered(np.cumsum(m), here), runs, numbered(ungapped(left, runs.astype(np.int64)), here), numbered(right, here), train, n))
            del got, own
            m, runs, li, ri, train = (np.concatenate([p[i] for p in parts]) for i in range(5))
            times = [p[5] for p in parts]
            cuts = np.cumsum([0, *map(len, times)])
            del parts
            ms, mi = np.unique(m, return_inverse=True)
            mi = np.repeat(mi, runs)
            del m, runs
            nl = nr = k + len(rare)
            if len(ms) * nl * nr < 1 << 62:
                key = (mi * nl + li) * nr + ri
            else:
                key = np.unique(mi * nl + li, return_inverse=True)[1] * nr + ri
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            at = order[first]
            inverse = np.empty(len(key), np.int64)
            inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            c = np.add.reduceat(train[order].astype(np.int64), first)
            del key, order, train
            mi, li, ri = mi[at], li[at], ri[at]
            ended, begins = ri == 2, li == 0  # nothing after the end, or before the first word
            seen = np.flatnonzero(c > 0)
            listed, whole = ms < k, None
            code = np.where(listed, ms, 0)
            parted = np.flatnonzero(listed & (known.classes[code] > 0))
            if len(parted):
                pairs = [unpacked(x) for x in t["pairs"].to_pylist() if x is not None]
                held = [(m, numbered(r, np.searchsorted(rare, np.cumsum(g, dtype=np.uint64))), c2) for m, r, g, c2 in pairs]
                name, r, c2 = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                pair = np.searchsorted(ms, name) * nr + r
                by = np.argsort(pair)
                whole = (parted, known.n[code[parted]], np.array([types.get(x, 0) for x in code[parted].tolist()], np.int64), pair[by], c2[by])
            trie = Trie.mapped(Trie.build(mi[seen], li[seen], ri[seen], c[seen], ended[seen], (len(ms), nl, nr), discount, whole))
            found, alone, count = trie.score(mi, li, ri, begins, ended)
            found += np.where(alone, steps(count), 0)
            # Listed words' base probabilities were summed where their texts are.
            new = ~listed[mi]
            base = np.where(new, np.rint((np.log10(count + 1.0) - room) / -UNIT), 0).astype(np.int64)
            known_ = new & (count > 0)
            for c_, d, n, a, b in zip(of, docs, times, cuts[:-1].tolist(), cuts[1:].tolist()):
                which = np.repeat(inverse[a:b], n)
                doc = unpacked(d)[0]
                total = np.bincount(doc, found[which])
                held = np.flatnonzero(np.bincount(doc))
                some = np.flatnonzero(new[which])
                doc, which = doc[some], which[some]
                few = np.flatnonzero(np.bincount(doc)) if len(doc) else np.zeros(0, np.int64)
                sums = (np.bincount(doc, x[which])[few].astype(np.int64) if len(doc) else few for x in (*halves(base), known_))
                value = packed(np.diff(held, prepend=0).astype(np.uint32), total[held].astype(np.int64), np.diff(few, prepend=0).astype(np.uint32), *sums)
                rows.append((c_, value, None))
        trim()
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PART)], schema=PART)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_up(total: int):
    def run(t: pa.Table) -> pa.Table:
        ids, valid, held_out, n_tokens, high, low, seen = unpacked(next(x for x in t["header"].to_pylist() if x is not None))
        score = np.zeros(len(ids), np.int64)
        for x in t["sums"].to_pylist():
            if x is not None:
                docs, s, few, *sums = unpacked(x)
                score[np.cumsum(docs)] += s
                few = np.cumsum(few)
                for held, more in zip((high, low, seen), sums):
                    held[few] += more
        columns = {"doc_id": pa.array(ids, mask=~valid), "held_out": pa.array(held_out), "n_tokens": n_tokens, "n_known": seen, "train_tokens": np.full(len(ids), total)}
        base = high.astype(float) * (1 << HALF) + low
        return pa.table(columns | {"base_score": 0.0 - base * UNIT, "score": 0.0 - score * STEP})

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75, top: int = TOP, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """Scores of all rows by the model of those that aren't held out. top, split and chunk say what is sent where; they don't move a score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    words = written(unigrams(rows.filter(~F.col("held_out")).select("text")), "unigrams")
    end = F.col("h") == int(np.uint64(END).astype(np.int64))
    total, distinct, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0))).first()
    listed = words.filter(~end).orderBy(F.desc("n"), "h").limit(top).toArrow()
    h = np.concatenate([np.array([BEFORE, END, AFTER], np.uint64), listed["h"].to_numpy().astype(np.uint64)])
    released(words)
    known = Known(h, np.concatenate([[0, ends, 0], listed["n"].to_numpy()]).astype(np.int64), split)
    room = float(np.log10(total + distinct + 1)) if total else 0.0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    sent = rows.mapInArrow(_send(shards, known, room, chunk), "shard int, chunk long, trigrams binary, docs binary, header binary").withColumn("pairs", F.lit(None).cast("binary"))
    types: dict[int, int] = {}
    if known.classes.any():
        merged = rows.select("held_out", "text").mapInArrow(_send_pairs(shards, known, chunk), "shard int, pairs binary").groupBy("shard")
        merged = written(merged.applyInArrow(_merge_pairs(known), "shard int, pairs binary, code long, types long"), "pairs")
        types = {r["code"]: r["types"] for r in merged.filter("shard is null").groupBy("code").agg(F.sum("types").alias("types")).collect()}  # listed words only
        sent = sent.unionByName(merged.filter("shard is not null").select("shard", "pairs"), allowMissingColumns=True)
    parts = sent.groupBy("shard").applyInArrow(_shard(known, types, room, discount), "chunk long, sums binary, header binary")
    return parts.groupBy("chunk").applyInArrow(_sum_up(total), SCORES)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
