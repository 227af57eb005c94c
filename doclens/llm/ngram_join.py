"""N-gram Jaccard self-join by PartEnum signatures, and its groups.

A document's set is the distinct shingles of `size` words (lower-cased in ASCII, parted by ASCII white space); a shorter
text is one shingle, a text without words has an empty set and no links. Two documents link if
the Jaccard similarity of their sets is at least num/den.

1. Equal sets are one node. Sizes fall into bands whose ends differ by num/den, so linked sets stand in one band or in neighbours. In a band, linked
   sets differ in at most k shingles. The hashed domain is parted in n1 pieces of n2 parts each; signatures are all subsets of n2 - k2 parts of each piece. As (k2 + 1) * (n1 - slack) > k,
   at least slack + 1 pieces hold at most k2 differences, so linked sets share a signature in each of these. (n2, k2) is (3, 1).
2. Up to `DIRECT` sets that share a signature make direct pairs. Where there is slack, half of the signatures that linked sets share at the least are asked for, as few may be an accident. A larger bucket
   counts as lost for its sets, and so does one with more than `LOCAL` sets of a block of input, of which only one is sent. A set that lost no more than the slack spares is found by direct pairs all the same. Sets that lost more ("poor") hold what
   many sets hold: near copies in large groups, or passages that many texts share.
3. Poor sets are told apart by what is rare in them. Linked sets share one of the first |s| - t|s| + 1 elements of each in any common order (t the similarity); the order here is by how often an element's residue
   occurs in the corpus (2**20 counters, summed in the first pass), so shared passages come last. Poor sets that share one of these elements make direct pairs, or, in a large bucket, are joined to one of them, its hub: rows are in proportion to a bucket's size.
4. Parity bitmaps refute direct pairs that can't link. What stands, with the pairs of hubs, connects sets to families; linked sets are always in one. A family of at most `FAMILY` nodes and `ELEMENTS` shingles is settled within one task, exactly: bitmaps bound
   two sets' difference from below, and what they leave is compared in full unless it is connected already.
   A larger family is dealt into blocks of half that size, by bands of sizes and a hash (`by_blocks`). Each block is settled as a small family; its candidate pairs link blocks' components. What then isn't in the family's largest
   component is compared, in blocks of its own, with all blocks in whose band or beside it linked sets stand. All pairs of the family are thus compared or connected, and what is shuffled is a family's sets times the blocks of its outliers.
5. Groups are the connected components of the links.

Defined cases: null and empty texts have an empty set and stand alone; a row without an id takes no part (null component);
rows of equal id are taken one by one and share the id; an empty table gives an empty result; other columns are ignored by
`groups` and kept by `one_of_each`, whatever their names. Ids are integers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from doclens.llm.common import WordHashes, arrow_map, mix, octets, packed, released, runs_of, shingle_hashes, slices, table, trim, unpacked, written
from doclens.llm.components import components

#: Signatures that a task gathers before it sends them, and documents of which sets are sent by broadcast at most.
CHUNK, SMALL = 1_000_000, 2_000_000
#: Nodes and shingles of a family that one task settles at most; larger ones are settled in blocks.
FAMILY, ELEMENTS = 16_384, 16_000_000
#: Sets of one signature up to which all pairs are made, a bounded number for each set; and sets of a block beyond which only their hub is sent on.
DIRECT, LOCAL = 24, 64
#: Bits of an element that tell its residue, and tasks that sum up residues' counts.
RESIDUE, MERGED = 20, 32
#: A name that no table's column has.
SPARE = "__ngram_join__"
_words = WordHashes()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(shingle_hashes(_words.of(text.lower().split()), size))


def node_of(s: np.ndarray) -> int:
    """A set's name: a hash of its elements, as a signed integer."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


class Bands:
    """Size bands, and for each the pieces that its signatures take."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends = num, den, [0]
        self.n2, self.k2 = 3, 1
        self.subsets = list(itertools.combinations(range(self.n2), self.n2 - self.k2))

    def band(self, n: int) -> int:
        while self.ends[-1] < n:
            low = self.ends[-1] + 1
            self.ends.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self.ends, n))

    def pieces(self, band: int) -> tuple[int, int]:
        """(n1, slack): some slack + 1 of the n1 pieces hold at most k2 differences. (0, 0) if linked sets are equal. Large sets have much slack, as their signatures, of few elements each, are shared by accident."""
        while band >= len(self.ends):
            self.band(self.ends[-1] + 1)
        k = (self.den - self.num) * 2 * self.ends[band] // (self.den + self.num)
        if not k:
            return 0, 0
        least = k // (self.k2 + 1) + 1
        slack = next((x for bound, x in ((8, 0), (24, 2), (100, 6), (300, 12)) if least < bound), 24)
        return least + slack, slack

    @staticmethod
    def asked(slack: int) -> tuple[int, int]:
        """(shared signatures that are asked for, buckets that a set may lose beside): of those that linked sets share at least.

        A difference in a piece costs two of its three signatures, a second one the third. So k differences, of which n1 - slack pieces would take two each and more, leave 2 * slack + 1 at least: one in each piece that isn't
        emptied. Each set may leave out one of them (see `signatures`).
        """
        least = max(1, 2 * slack - 1)
        return (least + 1) // 2, least // 2


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, int, int]:
    """Of a sorted set, for its own band and the next; how many signatures a linked set is asked to share; and how many buckets may be lost beside.

    A pair of empty parts says nothing; where one piece has such a pair, it is left out, as a lost one.
    """
    out, b, need, spare = [], bands.band(len(s)), 255, 255
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
    for band in (b, b + 1):
        n1, slack = bands.pieces(band)
        if not n1:
            continue
        parts = bands.n2 * n1
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # in order, as s is sorted
        counts = np.bincount(at.astype(np.int64), minlength=parts)
        ends = np.cumsum(counts)
        part = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).reshape(n1, bands.n2)
        full = counts.reshape(n1, bands.n2) > 0
        name = (np.arange(n1, dtype=np.uint64) + (np.uint64(band) << np.uint64(32))) * np.uint64(64)
        # A subset's parts are told apart by their place: each is multiplied by an odd number of its own.
        weighed = part * (np.arange(bands.n2, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        sig = np.stack([mix(mix(name + np.uint64(x)) + weighed[:, sub].sum(1, dtype=np.uint64)) for x, sub in enumerate(map(list, bands.subsets))], 1)
        void = np.stack([~full[:, sub].any(1) for sub in map(list, bands.subsets)], 1)
        lost = int(void.any(1).sum())
        drop = bool(slack) and lost == 1
        out.append(sig[~void] if drop else sig.ravel())
        need, spare = (min(x, y) for x, y in zip((need, spare), bands.asked(slack)))
    return (np.concatenate(out), need, spare) if out else (np.zeros(0, np.uint64), 1, 0)


def buckets(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, nodes, where each key begins, how many nodes it has): sorted and distinct."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, nodes, first, np.diff(np.append(first, len(keys)))


def distinct_pairs(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), each once, and how often each stood there."""
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if not len(both):
        return both, np.zeros(0, np.int64)
    names, at = np.unique(both, return_inverse=True)
    code, times = np.unique(at.reshape(-1, 2) @ np.array([len(names), 1]), return_counts=True)
    return np.stack([names[code // len(names)], names[code % len(names)]], 1), times


def stars(nodes: np.ndarray, first: np.ndarray, size: np.ndarray, big: np.ndarray) -> np.ndarray:
    """(node, least node) in each of the buckets that are `big`."""
    rest = np.repeat(first[big], size[big] - 1)
    at = np.flatnonzero(np.repeat(big, size))
    return np.stack([nodes[np.setdiff1d(at, first[big], assume_unique=True)], nodes[rest]], 1)


def direct(nodes: np.ndarray, first: np.ndarray, size: np.ndarray, upto: int) -> list[np.ndarray]:
    """All pairs of each bucket of two to `upto` nodes."""
    out = []
    for n in range(2, upto + 1):
        if len(begin := first[size == n]):
            block = nodes[begin[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            out.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], 1))
    return out


def prefix(s: np.ndarray, weights: np.ndarray, num: int, den: int) -> np.ndarray:
    """The elements of which linked sets share one: the rarest, by their residues' weights, then by themselves."""
    order = np.lexsort((s, weights[(s >> np.uint64(64 - RESIDUE)).astype(np.int64)]))
    return s[order[: len(s) - -(-num * len(s) // den) + 1]]


def size_class(n: int) -> int:
    """Sizes in steps of 2 %."""
    return int(math.log(max(n, 1)) / math.log(1.02))


def _blocks(size: int, num: int, den: int, shards: int, weights: np.ndarray | None = None):
    """Map side: (shard, sigs, members, pairs, weights), blobs of a chunk of documents (doc_id, text), and the task's counts of residues.

    With weights: of documents (doc_id, text, node), the keys are prefixes instead of signatures, and only sigs and pairs are sent.
    """
    names = ("shard", "sigs", "members", "pairs", "weights")
    schema = pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in names[1:])])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema)

    def flush(ids, sizes, nodes, sigs, traits) -> Iterator[pa.RecordBatch]:
        shown = np.array(nodes, np.int64)
        owner = np.repeat(shown, [len(x) for x in sigs])
        keys, owner, first, count = buckets(np.concatenate(sigs), owner)
        pairs = distinct_pairs([stars(owner, first, count, count > LOCAL)])[0]
        trait = dict(zip(nodes, traits))
        hub = np.repeat(count > LOCAL, count)  # their keys' other nodes aren't sent
        sent = ~hub
        sent[first] = True
        keys, owner, hub = keys[sent], owner[sent], hub[sent]
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # within a shard, of a bounded number of signatures; what falls together is told apart later
        shard = (((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int32)
        order = np.lexsort((low, owner, shard))
        low, shard, owner, hub = low[order], shard[order], owner[order], hub[order]
        rows: list[tuple] = []
        for a, b in runs_of(shard):
            o = owner[a:b]
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            value = packed(o[first], np.array([trait[x] for x in o[first].tolist()], np.uint16), np.diff(np.append(first, b - a)).astype(np.uint32), low[a:b], hub[a:b])
            rows.append((int(shard[a]), value, None, None, None))
        known = np.array([i is not None for i in ids], bool)
        numbers = np.array([i or 0 for i in ids], np.int64)
        members = packed(numbers, known, np.array(sizes, np.int64), shown) if weights is None else None
        rows.append((abs(hash(nodes[0])) % shards, None, members, packed(pairs[:, 0].copy(), pairs[:, 1].copy()), None))
        yield batch_of(rows)

    def run(batches):
        from pyspark import TaskContext

        bands, held, n = Bands(num, den), ([], [], [], [], []), 0
        counts = np.zeros(1 << RESIDUE, np.int64)
        for batch in slices(batches):
            wanted = batch.column(2).to_pylist() if weights is not None else itertools.repeat(None)
            for i, t, node in zip(batch.column(0).to_pylist(), octets(batch, 1), wanted):
                s = shingle_set(t, size)
                name, sig, trait = node_of(s), np.zeros(0, np.uint64), 0
                if weights is not None:
                    if name != node:
                        continue
                    sig, trait = mix(prefix(s, weights, num, den)), size_class(len(s))
                elif len(s) and i is not None:
                    sig, need, spare = signatures(s, bands)
                    trait = need << 8 | spare
                    np.add.at(counts, (s >> np.uint64(64 - RESIDUE)).astype(np.int64), 1)
                for x, y in zip(held, (i, len(s), name, sig, trait)):
                    x.append(y)
                n += len(sig) + 1
                if n >= CHUNK:
                    yield from flush(*held)
                    held, n = ([], [], [], [], []), 0
                    trim()
        if held[0]:
            yield from flush(*held)
        if weights is None and counts.any():
            yield batch_of([(TaskContext.get().partitionId() % min(shards, MERGED), None, None, None, packed(counts.astype(np.uint32)))])
        del held, counts
        _words.clear()
        trim()

    return run


#: Rows of the reduce side: sums of residues' counts (counts), members (doc_id, n, u), direct pairs (u, c, times that they share a signature, how often they must), sets of large buckets
#: (u, c the bucket, what u spares, 1 if u stands for others) and pairs with a hub (u, c).
MEMBER, PAIR, LARGE, STAR, COUNTS = range(5)
OUT = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "u", "c", "x", "y")), ("counts", pa.binary())])
OUT_DDL = "kind int, doc_id long, n long, u long, c long, x long, y long, counts binary"


def residues(blobs: list[bytes | None]) -> np.ndarray | None:
    """Sums of packed counts."""
    total = None
    for x in blobs:
        if x is not None:
            total = unpacked(x)[0].astype(np.int64) + (0 if total is None else total)
    return total


def _buckets(num: int, den: int, rare: bool = False):
    """Reduce side: rows of OUT. rare: traits are classes of sizes, of which pairs too far apart can't link."""
    apart = size_class(-(-den * 10**6 // num)) - size_class(10**6) + 2
    return lambda t: _meet(t, apart if rare else None)


def _meet(t: pa.Table, apart: int | None) -> pa.Table:
    keys, nodes, sent, traits, out, hubs = [], [], [], [], [], []

    def add(kind: int, **columns) -> None:
        n = len(columns["u"])
        out.append(pa.table([pa.array(np.full(n, kind, np.int32)), *(columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(np.ascontiguousarray(columns[f.name]), f.type) if f.name in columns else pa.nulls(n, f.type) for f in list(OUT)[1:])], schema=OUT))

    if (total := residues(t["weights"].to_pylist())) is not None:
        out.append(pa.table([pa.array([COUNTS], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(6)), pa.array([packed(total)], pa.binary())], schema=OUT))
    for sigs, members, pairs in zip(t["sigs"].to_pylist(), t["members"].to_pylist(), t["pairs"].to_pylist()):
        if sigs is not None:
            owner, trait, runs, low, hub = unpacked(sigs)
            sent.append(hub)
            keys.append(low.astype(np.uint64))
            nodes.append(np.repeat(owner, runs))
            traits.append((owner, trait))
        if members is not None:
            ids, known, sizes, own = unpacked(members)
            add(MEMBER, doc_id=pa.array(ids, mask=~known), n=sizes, u=own)
        if pairs is not None:
            hubs.append(np.stack(unpacked(pairs), 1))
    stars_ = distinct_pairs(hubs)[0]
    add(STAR, u=stars_[:, 0], c=stars_[:, 1])
    if keys:
        all_, own_, hub = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sent)
        names, own, first, size = buckets(all_, own_)
        who, at = np.unique(np.concatenate([o for o, _ in traits]), return_index=True)
        trait = np.concatenate([x for _, x in traits])[at].astype(np.int64)
        of = lambda x: trait[np.searchsorted(who, x)]
        # A hub that stands for others of its block makes its bucket a large one.
        big = (size > DIRECT) | np.isin(names[first], all_[hub])
        pairs, times = distinct_pairs(direct(own, first, np.where(big, 0, size), DIRECT))
        a, b = of(pairs[:, 0]), of(pairs[:, 1])
        if apart is not None:
            near = np.abs(a - b) <= apart
            pairs, times, a, b = pairs[near], times[near], a[near], b[near]
        add(PAIR, u=pairs[:, 0], c=pairs[:, 1], x=times, y=np.minimum(a, b) >> 8)
        rows = np.flatnonzero(np.repeat(big, size))
        # Buckets of all shards keep apart by their whole key.
        forced = np.isin(mix(names[rows]) ^ mix(own[rows].astype(np.uint64)), mix(all_[hub]) ^ mix(own_[hub].astype(np.uint64)))
        del all_, own_
        trim()
        add(LARGE, u=own[rows], c=(names[rows] | np.uint64(int(t["shard"][0].as_py()) << 40)).astype(np.int64), x=of(own[rows]) & 255, y=forced.astype(np.int64))
    return pa.concat_tables(out)


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """A parity bit for each residue: two sets differ in at least as many elements as their bitmaps in bits."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def width(n: int) -> int:
    """Bits for a set of n elements."""
    return 1 << max(8, min(18, int(n).bit_length()))


def folded(m: bytes, bits: int) -> np.ndarray:
    """A bitmap at a smaller width."""
    x = np.frombuffer(m, np.uint8)
    while len(x) * 8 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _standing(num: int, den: int):
    """(u, c, sizes, bitmaps) to the pairs that bitmaps don't refute."""

    def run(batch):
        u, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        kept = []
        for i, (n, m, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))):
            bits = 8 * min(len(a), len(b))
            apart = int(np.bitwise_count(folded(a, bits) ^ folded(b, bits)).sum(dtype=np.int64))
            if apart * (den + num) <= (den - num) * (n + m):
                kept.append(i)
        return {"a": [u[i] for i in kept], "b": [c[i] for i in kept]}

    return run


def bitmaps(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Of one width, by the difference that linked sets have at most."""
    most = (den - num) * 2 * max(map(len, sets)) // (den + num)
    bits = 1 << max(8, min(16, int(8 * most).bit_length()))
    return np.stack([np.frombuffer(bitmap(x, bits), np.uint64) for x in sets])


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def settled(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """The least node that each reaches by links, among the sets given."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    nodes, sets = np.array(nodes)[order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    maps = bitmaps(sets, num, den)
    label = np.arange(len(sets))
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, np.searchsorted(size, int(size[i]) * den // num, "right"))
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        for k in j[apart * (den + num) <= (den - num) * (size[i] + size[j])].tolist():
            if label[k] != label[i] and links(sets[i], sets[k], num, den):
                label[label == label[k]] = label[i]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    out = np.empty(len(sets), np.int64)
    out[order] = least[label]
    return out.tolist()


def across(left: list[tuple], right: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect all linked sets, one of the left and one of the right, of rows (node, set, label, block, outlier). Rows of one label are connected; those of one block are told already; pairs of outliers meet where the right one is greater."""
    left.sort(key=lambda x: len(x[1]))
    both, out = left + right, []
    node, label, block = (np.array([x[i] for x in both], np.int64) for i in (0, 2, 3))
    sets, outlier = [x[1] for x in both], np.array([x[4] for x in left], bool)
    size = np.array([len(x) for x in sets])
    maps, n = bitmaps(sets, num, den), len(left)
    for i in range(n, len(both)):
        j = np.arange(np.searchsorted(size[:n], -(-int(size[i]) * num // den)), np.searchsorted(size[:n], int(size[i]) * den // num, "right"))
        j = j[(label[j] != label[i]) & (block[j] != block[i]) & ~(outlier[j] & (node[j] > node[i]))]
        for at in range(0, len(j), 1024):  # few bitmaps at once
            k = j[at : at + 1024]
            k = k[label[k] != label[i]]
            apart = np.bitwise_count(maps[k] ^ maps[i]).sum(1, dtype=np.int64)
            for k in k[apart * (den + num) <= (den - num) * (size[i] + size[k])].tolist():
                if label[k] != label[i] and links(sets[i], sets[k], num, den):
                    out.append((int(node[i]), int(node[k])))
                    label[label == label[k]] = label[i]
    return out


def _families(num: int, den: int):
    """(family, node, set) in order of families, to (node, root)."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        now = None

        def done():
            names = list(held)
            return pa.RecordBatch.from_pydict({"node": names, "root": settled(names, list(held.values()), num, den)}, pa.schema([("node", pa.int64()), ("root", pa.int64())]))

        for batch in batches:
            for family, node, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if family != now and held:
                    yield done()
                    held.clear()
                now = family
                held[node] = np.frombuffer(raw, np.uint64)
        if held:
            yield done()

    return run


def _linked(num: int, den: int):
    """(a, b, their sets) to the pairs that link."""

    def run(batch):
        held = [(a, b) for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))) if links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)]
        return {"a": [a for a, _ in held], "b": [b for _, b in held]}

    return run


def _across(num: int, den: int):
    """(task, node, set, label, block, outlier, right) in order of tasks, to links (a, b)."""

    def run(batches):
        held, now = ([], []), None

        def done():
            found = across(*held, num, den) if all(held) else []
            return pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in batches:
            for task, node, raw, label, block, outlier, right in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if task != now and any(held):
                    yield done()
                    held = ([], [])
                now = task
                held[right].append((node, np.frombuffer(raw, np.uint64), label, block, outlier))
        if any(held):
            yield done()
        del held
        trim()

    return run


def by_blocks(nodes: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(node, root) of the nodes (node, family, n) of large families, from their candidate pairs (a, b) and (node, set): step 4. most: nodes of a block and of the outliers that meet it, together and about."""
    # Of linked sets, sizes differ by den/num at most, so their bands by one.
    nodes = nodes.withColumn("band", F.floor(F.log("n") / math.log(1.01 * den / num)))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        """Numbers of blocks within family and band: few rows say how many there are."""
        count = F.greatest(F.count("*") / max(most // 2, 1), F.sum("n") / (ELEMENTS // 2))
        wide = rows.groupBy("family", "band").agg(F.ceil(count).alias("wide"))
        return rows.join(F.broadcast(wide), ["family", "band"]).withColumn(name, F.expr("pmod(xxhash64(node), wide)")).drop("wide")

    placed = written(dealt(nodes, "slot").withColumn("block", F.xxhash64("family", "band", "slot")), "placed")
    first = placed.join(sets, "node").select("block", "node", "set").repartition("block").sortWithinPartitions("block").mapInArrow(_families(num, den), "node long, root long")
    first = written(first, "blocks")
    a, b = first.toDF("a", "x"), first.toDF("b", "y")
    beyond = pairs.join(a, "a").join(b, "b").filter("x <> y").select("a", "b").distinct()
    x, y = sets.toDF("a", "left"), sets.toDF("b", "right")
    met = arrow_map(beyond.join(x, "a").join(y, "b").select("a", "b", "left", "right"), _linked(num, den), "a long, b long")
    labels = written(components(first.toDF("a", "b").unionByName(met)), "labels").withColumnRenamed("root", "label")
    told = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = told.groupBy("family", "label").agg(F.count("*").alias("rows")).groupBy("family").agg(F.max_by("label", F.struct("rows", "label")).alias("main"))
    told = written(told.join(F.broadcast(main), "family").withColumn("outlier", F.col("label") != F.col("main")).drop("main"), "told")
    outliers = written(dealt(told.filter("outlier"), "own"), "outliers")
    spots = told.select("family", "band", "slot").distinct()
    tasks = outliers.select("family", F.col("band").alias("beside"), "own").distinct().join(spots, "family").filter("abs(beside - band) <= 1")
    tasks = written(tasks.withColumn("task", F.xxhash64("family", "beside", "own", "band", "slot")), "tasks")
    row = ["task", "node", "label", "block", "outlier"]
    left = told.join(tasks, ["family", "band", "slot"]).select(*row, F.lit(0).alias("right"))
    right = outliers.withColumnRenamed("band", "beside").drop("slot").join(tasks.drop("band"), ["family", "beside", "own"]).select(*row, F.lit(1).alias("right"))
    rows = left.unionByName(right).join(sets, "node").select("task", "node", "set", "label", "block", "outlier", "right")
    found = rows.repartition("task").sortWithinPartitions("task").mapInArrow(_across(num, den), "a long, b long")
    roots = components(told.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))
    released(placed, first, labels, told, outliers, tasks)
    return roots


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(members (doc_id, n_shingles, node), (node, root) of the nodes that have candidates)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    blobs = "shard int, sigs binary, members binary, pairs binary, weights binary"
    sent = rows.mapInArrow(_blocks(size, num, den, shards), blobs)
    both = written(sent.groupBy("shard").applyInArrow(_buckets(num, den), OUT_DDL), "join")
    members = both.filter(F.col("kind") == MEMBER).select("doc_id", F.col("n").alias("n_shingles"), F.col("u").alias("node"))
    direct_ = both.filter(F.col("kind") == PAIR).groupBy("u", "c").agg(F.sum("x").alias("times"), F.min("y").alias("need")).filter("times >= need").select("u", "c")
    lost = both.filter(F.col("kind") == LARGE).groupBy("u").agg(F.count("*").alias("lost"), F.min("x").alias("spare"), F.max("y").alias("forced")).filter("lost > spare or forced = 1").select("u")
    behind = both.filter(F.col("kind") == STAR).select(F.explode(F.array("u", "c")).alias("u"))
    poor = lost.unionByName(behind).distinct().withColumnRenamed("u", "node")

    # One document of each node tells its set.
    named = members.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """(doc_id, text, node) of one document of each node; its text may have another set where ids are repeated."""
        chosen = written(named.join(nodes, "node", "left_semi").select("doc_id", "node"), name)
        few = chosen.count() <= SMALL  # 16 bytes each; beyond it the join shuffles
        return rows.join(F.broadcast(chosen) if few else chosen, "doc_id").select("doc_id", "text", "node")

    def once(df: DataFrame) -> DataFrame:
        """A row for each node, where repeated rows gave more."""
        if df.groupBy("node").count().filter("count > 1").isEmpty():
            return df
        return df.groupBy("node").agg(*(F.first(c).alias(c) for c in df.columns if c != "node"))

    # Poor sets, by what is rare in them.
    weights = residues([r["counts"] for r in both.filter(F.col("kind") == COUNTS).select("counts").collect()])  # MERGED rows of 2**RESIDUE counters at most
    weights = np.zeros(1 << RESIDUE, np.uint32) if weights is None else np.minimum(weights, 2**32 - 1).astype(np.uint32)
    rare = texts_of(poor, "poor").mapInArrow(_blocks(size, num, den, shards, weights), blobs)
    rare = written(rare.groupBy("shard").applyInArrow(_buckets(num, den, True), OUT_DDL), "rare")
    large = rare.filter(F.col("kind") == LARGE).select("u", F.col("c").alias("bucket"))
    hubs = large.groupBy("bucket").agg(F.min("u").alias("c"))
    behind = rare.filter(F.col("kind") == STAR).select("u", "c")
    stars_ = large.join(hubs, "bucket").select("u", "c").unionByName(behind).filter("u <> c").distinct()
    pairs = direct_.unionByName(rare.filter(F.col("kind") == PAIR).select("u", "c")).withColumn("star", F.lit(False)).unionByName(stars_.withColumn("star", F.lit(True)))
    pairs = written(pairs.groupBy("u", "c").agg(F.bool_or("star").alias("star")), "candidates")

    def to_map(batch):
        got = [(n, s) for t, n in zip(octets(batch, 1), batch.column(2).to_pylist()) if node_of(s := shingle_set(t, size)) == n]
        return {"node": [n for n, _ in got], "n": [len(s) for _, s in got], "map": [bitmap(s, width(len(s))) for _, s in got]}

    def to_set(batch):
        got = [(n, s) for t, n in zip(octets(batch, 1), batch.column(2).to_pylist()) if node_of(s := shingle_set(t, size)) == n]
        return {"node": [n for n, _ in got], "set": [s.tobytes() for _, s in got]}

    ends = pairs.select(F.explode(F.array("u", "c")).alias("node")).distinct()
    maps = once(written(arrow_map(texts_of(ends, "ends"), to_map, "node long, n long, map binary"), "maps"))
    u, c = maps.toDF("u", "un", "um"), maps.toDF("c", "cn", "cm")
    standing = arrow_map(pairs.filter("not star").join(u, "u").join(c, "c").select("u", "c", "un", "cn", "um", "cm"), _standing(num, den), "a long, b long")
    edges = written(standing.unionByName(pairs.filter("star").select(F.col("u").alias("a"), F.col("c").alias("b"))), "pairs")
    families = components(edges).withColumnRenamed("root", "family")

    held = families.join(maps.select("node", "n"), "node")
    large = held.groupBy("family").agg(F.count("*").alias("nodes"), F.sum("n").alias("elements")).filter((F.col("nodes") > family) | (F.col("elements") > ELEMENTS)).select("family", F.lit(True).alias("large"))
    families = written(families.join(large, "family", "left").select("node", "family", F.coalesce("large", F.lit(False)).alias("large")), "families")
    sets = once(written(arrow_map(texts_of(families.select("node"), "held"), to_set, "node long, set binary"), "sets"))
    small = families.filter("not large").join(sets, "node").select("family", "node", "set")
    roots = small.repartition("family").sortWithinPartitions("family").mapInArrow(_families(num, den), "node long, root long")
    large = families.filter("large").select("node", "family")
    scratch = (rare, pairs, maps, edges, families, sets)
    if large.isEmpty():
        roots = written(roots, "roots")
        released(*scratch)
        return members, roots
    large = written(large.join(maps.select("node", "n"), "node"), "large")
    own = large.select("node")
    rest = edges.join(own.withColumnRenamed("node", "a"), "a", "left_semi")  # a pair lies in one family
    roots = written(roots.unionByName(by_blocks(large, rest, sets.join(own, "node", "left_semi"), num, den, family)), "roots")
    released(*scratch, large)
    return members, roots


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5, family: int = FAMILY) -> DataFrame:
    """(id, n_shingles, component_id) for each row; the component's name is its least id."""
    members, roots = linked(docs, id_col, text_col, size, num, den, family)
    rooted = members.join(small_side(roots), "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    # Rows of a group of one name it themselves, so a large group's rows needn't meet.
    least = rooted.filter(~alone).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").select("root", "component_id")
    named = rooted.join(small_side(written(least, "least")), "root", "left")
    return named.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def small_side(table: DataFrame) -> DataFrame:
    """The table, to be sent to the other side of a join if it has few rows (of some 16 bytes each)."""
    return F.broadcast(table) if table.count() <= SMALL else table


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group, with all its columns: of the least id, and of several with that id one whose set has the least name.

    Rows without an id or without words are in no group and stay. Rows are told apart by id and set, so what shares an id with a copy stays if it is none itself.
    """
    members, roots = linked(docs, id_col, text_col, size, num, den)
    rows = members.filter("doc_id is not null and n_shingles > 0").join(small_side(roots), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("kept"), F.count("*").alias("rows")).filter("rows > 1").select("root", "kept")
    least = written(least, "least")
    found = written(rows.join(small_side(least), "root").select("doc_id", "node", "kept"), "groups")
    repeated = written(members.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    spare = found.filter("doc_id <> kept.doc_id").select("doc_id").distinct()
    few = spare.count() <= SMALL  # 16 bytes each; beyond it the join shuffles
    own = F.col(id_col).cast("long")
    if repeated.isEmpty():
        drop = spare.withColumnRenamed("doc_id", SPARE)
        return docs.join(F.broadcast(drop) if few else drop, own == F.col(SPARE), "left_anti")
    once = spare.join(repeated, "doc_id", "left_anti")
    drop = once.unionByName(repeated).withColumnRenamed("doc_id", SPARE)
    kept = docs.join(drop, own == F.col(SPARE), "left_anti")

    # Rows of repeated ids: their sets are named anew, and of each group's rows one is taken.
    again = docs.join(repeated.withColumnRenamed("doc_id", SPARE), own == F.col(SPARE), "left_semi")
    at, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField(SPARE, LongType())])

    def name(batches):
        for batch in slices(batches):
            sets = (shingle_set(t, size) for t in octets(batch, at))
            yield batch.append_column(SPARE, pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()))

    named = again.mapInArrow(name, schema)
    singles = rows.join(repeated, "doc_id", "left_semi").join(least, "root", "left_anti").select("doc_id", "node")
    to_keep = found.filter("doc_id = kept.doc_id and node = kept.node").select("doc_id", "node").unionByName(singles).distinct().toDF(f"{SPARE}d", f"{SPARE}n")
    one = named.join(to_keep, (own == F.col(f"{SPARE}d")) & (F.col(SPARE) == F.col(f"{SPARE}n"))).dropDuplicates([f"{SPARE}d", f"{SPARE}n"])
    return kept.unionByName(named.filter(F.col(SPARE).isNull()).select(docs.columns)).unionByName(one.select(docs.columns))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: sets of four words, similarity 85 in 100."""
    return groups(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
