"""Operators over tables: brute force on small fixtures, and nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from doclens.llm import bpe, chat, components, decontaminate, fingerprint, html, langid, ngram_join, ngram_lm, pii



def brute_tiles(p, t, least):
    """Greedy string tiling by definition: the longest unmarked common run, first in the pattern, then in the text."""
    dp, dt, out = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not dp[i + k] and not dt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out += k
        dp[i : i + k] = dt[j : j + k] = [True] * k


ODD = [
    (1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, None, "en"), (None, "no id at all here", None), (None, None, None), (3, "", "en"),
    (4, "word " * 30000, "en"), (5, "x", None), (6, "\x1c  \t\n", "en"), (7, "A b C d e f", "en"), (8, "123 456", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "s", len(t or ""), "clash", 7, "clash") for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score int, held_out string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# N-gram join


def brute_groups(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows) if d is not None)


def near_copies(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 120]))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("family", "size", "num", "den"), [(ngram_join.FAMILY, 4, 85, 100), (2, 4, 85, 100), (ngram_join.FAMILY, 5, 4, 5)])
def test_groups_against_brute_force(spark, family, size, num, den):
    rows = near_copies(family + num)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(df, size=size, num=num, den=den, family=family).collect())
    assert got == brute_groups(rows, size, num, den)


def test_large_families_are_settled_on_little_disk(spark, monkeypatch):
    """No table of the join is much larger than the sets, and no link is lost, where a family of many outliers goes beyond a block."""
    import pathlib

    rng, rows, made, write = random.Random(0), [], {}, ngram_join.written
    for i in range(90):
        w = [f"w{k}" for k in range(150 if i % 3 else 130)]
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))

    def measured(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + sum(f.stat().st_size for f in pathlib.Path(out.written_path.removeprefix("file:")).glob("*.parquet"))
        return out

    monkeypatch.setattr(ngram_join, "written", measured)
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=5, num=4, den=5, family=8)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows, 5, 4, 5)
    assert max(made.values()) <= 2 * made["sets"]


def test_linked_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(5)
    for num, den, n in ((num, den, n) for num, den in ((85, 100), (4, 5)) for n in (7, 13, 50, 200, 1000)):
        bands = ngram_join.Bands(num, den)
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            d = int(rng.integers(0, n * (den - num) // (den + num) + 1))
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**64, d, dtype=np.uint64)]))
            if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) and d:
                (x, need, _), (y, other, _) = ngram_join.signatures(a, bands), ngram_join.signatures(b, bands)
                assert len(np.intersect1d(x, y)) >= min(need, other)


def test_shared_signatures_at_the_least():
    """Over every way to spread differences over pieces: emptied pieces (two differences or more) share none, pieces with one share one, others three."""
    for k in range(1, 120):
        for slack in (0, 2, 6, 12, 24):
            n1 = k // 2 + 1 + slack
            least = min(3 * (n1 - a - b) + b for a in range(n1 + 1) for b in range(n1 - a + 1) if 2 * a + b <= k)
            need, spare = ngram_join.Bands.asked(slack)
            assert least >= 1 and need + spare <= max(1, least - 2)


def test_buckets_direct_and_stars():
    import numpy as np

    _, nodes, first, size = ngram_join.buckets(np.array([5, 5, 5, 7, 7, 9, 5], np.uint64), np.array([3, 1, 2, 4, 4, 6, 1]))
    assert ngram_join.distinct_pairs(ngram_join.direct(nodes, first, size, 16))[0].tolist() == [[1, 2], [1, 3], [2, 3]]
    assert ngram_join.distinct_pairs([ngram_join.stars(nodes, first, size, size > 2)])[0].tolist() == [[2, 1], [3, 1]]


def test_large_families_over_several_blocks(spark, monkeypatch):
    """Linked sets of two blocks whose only shared signatures are those of one large bucket, as links of a large family."""
    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 120)
    base, one, two = [f"w{i}" for i in range(20)], [], []
    part = lambda w: (int(ngram_join.shingle_set(" ".join(w).encode(), 4)[0]) >> 32) * 9 >> 32
    sig = lambda t: set(ngram_join.signatures(ngram_join.shingle_set(t.encode(), 4), ngram_join.Bands(85, 100))[0].tolist())
    names = (f"x{i}" for i in range(10**6))
    for _ in range(24):
        own = base
        for _ in range(6):  # what only u and v hold stands in the first of three pieces, where they differ in two parts
            own = [next(x for x in names if part([x, *own[:3]]) < 3), *own]
        one.append(" ".join([*own, next(x for x in names if part([*own[-3:], x]) == 0)]))
        two.append(" ".join([*own, next(x for x in names if part([*own[-3:], x]) == 1)]))
    common = sig(one[0]) & sig(one[1])
    assert all(common and sig(u) & sig(v) == common for u, v in zip(one, two))
    rows = list(enumerate([*one, *two]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(df, size=4, num=85, den=100, family=2).collect())
    assert got == brute_groups(rows, 4, 85, 100)


def test_groups_of_odd_rows(odd, none):
    got = ngram_join.groups(odd, size=4, num=85, den=100)
    rows = [(i, t) for i, t, _ in ODD]
    known = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None)
    assert known == brute_groups(rows, 4, 85, 100)
    assert [r.component_id for r in got.collect() if r.doc_id is None] == [None, None]
    assert ngram_join.groups(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8]


def test_one_of_each_row_by_row(spark):
    """Rows are dropped for what they are, not for an id that they share."""
    copy, other, third = "a b c d e f g h i j", "one two three four five six seven", "red green blue cyan pink grey gold lime teal navy plum rust"
    rows = [(3, copy), (5, copy), (5, other), (5, other), (7, f"{copy} k"), (7, third), (None, copy), (9, ""), (9, None), (4, other), (2, third), (2, third), (2, f"{third} tan")]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id int, node string")
    got = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(df).collect())
    assert got[:3] == [(0, copy), (2, got[1][1]), (3, copy)] and got[1][1] in (third, f"{third} tan") and got[3:] == [(4, other), (9, ""), (9, "")]
    unique = spark.createDataFrame([(1, copy), (2, copy), (3, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each(unique).collect()) == [1, 3]


# Language model


def test_scores_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("a b c d e f g h the The x1 é".split(), k=rng.randint(0, 30))) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()}
    tok = {i: (t or "").lower().encode().split() + [None] for i, t in rows}
    train = [i for i in tok if zlib.crc32(str(i).encode()) % 7 != 2]
    c, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        w = tok[i]
        c.update(w)
        c2.update(zip(w, w[1:]))
        c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)
    t2, y2, t3, y3 = (collections.Counter() for _ in range(4))
    for (a, _), k in c2.items():
        t2[a] += k
        y2[a] += 1
    for (a, b, _), k in c3.items():
        t3[a, b] += k
        y3[a, b] += 1

    def p(left, m, r, d=0.75):
        p1 = (c[r] + 1) / (n + v + 1)
        if m == "B":
            return p1
        p2 = (c2[m, r] - d) / t2[m] if c2[m, r] else (d * y2[m] / t2[m] if t2[m] else 1) * p1
        if left == "B" or not t3[left, m]:
            return p2
        b3 = d * y3[left, m] / t3[left, m]
        return (c3[left, m, r] - d) / t3[left, m] + b3 * p2 if c3[left, m, r] else b3 * p2

    for i, w in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-12)
        want = sum(math.log10(p(*x)) for x in zip(["B", "B", *w], ["B", *w], w))
        assert abs(r.score - want) < 0.02 * len(w)  # 8-bit probabilities


def test_split_words_keep_counts(spark):
    """Many tokens of one word: it is split by the word before, and its count is still the whole one."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 400} the" for k in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_lm.score(df, F.lit(False)).collect()
    c = collections.Counter(w for _, t in rows for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for r in got:
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*text[r.doc_id].split(), None]), rel_tol=1e-12)
        assert r.base_score < r.score < 0


def test_split_words_score_as_unsplit_ones(spark):
    """Bigrams and contexts of hot words are whole, whatever the number of shards."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(300)} the of r{int(rng.expovariate(0.05))}" for _ in range(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, shards = {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):  # with one shard no word is more than half of the tokens, so none is split
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got[n] = {r.doc_id: r for r in ngram_lm.score(df, F.col("doc_id") % 5 == 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shards)
    for i, t in rows:
        a = got[1][i]
        for n in (4, 16):
            b = got[n][i]
            assert (a.n_known, a.n_tokens, round(a.base_score, 9)) == (b.n_known, b.n_tokens, round(b.base_score, 9))
            assert abs(a.score - b.score) < 0.01 * a.n_tokens, (n, i, a.score, b.score)  # 8-bit probabilities


def test_scores_do_not_depend_on_what_lies_where(spark):
    """One model: the same scores, to the last bit, for any number of partitions, list of codes, chunk and bar for splitting."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(300)} the of r{int(rng.expovariate(0.05))}" for _ in range(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ask = lambda **k: {r.doc_id: tuple(r) for r in ngram_lm.score(df, F.col("doc_id") % 5 == 2, **k).collect()}
    want, shards = ask(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, top, split in ((2, 1, 40), (8, 50, 40), (64, 10**6, 300)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert ask(top=top, split=split) == want, n
        assert ask(split=100, chunk=700) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shards)



def test_trie_round_trip(tmp_path):
    import numpy as np

    from doclens.llm.elias_fano import EliasFano, Trie

    rng = np.random.default_rng(6)
    for universe in (10, 1000, 10**9):
        x = np.sort(rng.integers(0, universe, 500))
        ef = EliasFano(*EliasFano.encode(x, universe))
        assert (ef[np.arange(500)] == x).all()
        u = np.unique(x)
        ef, ask = EliasFano(*EliasFano.encode(u, universe)), rng.integers(0, universe, 2000)
        assert (ef.find(ask) == np.where(np.isin(ask, u), np.searchsorted(u, ask), -1)).all() and (ef.find(u) == np.arange(len(u))).all()
    m, left, r = np.unravel_index(np.unique(rng.integers(0, 8000, 900)), (20, 20, 20))
    data = Trie.build(m, left, r, rng.integers(1, 9, len(m)), np.zeros(len(m), bool), (20, 20, 20))
    (tmp_path / "trie").write_bytes(data)
    a, b = Trie.open(str(tmp_path / "trie")), Trie.mapped(data)
    no = np.zeros(len(m), bool)
    assert all((x == y).all() for x, y in zip(a.score(m, left, r, no, no), b.score(m, left, r, no, no)))


def test_scores_of_odd_rows(odd, none):
    got = ngram_lm.score(odd, F.lit(True)).collect()
    assert len(got) == len(ODD) and {(r.train_tokens, r.base_score) for r in got} == {(0, 0.0)}
    got = ngram_lm.score(odd, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").encode().split()) + 1 for _, t, _ in ODD)
    assert ngram_lm.score(none, F.lit(False)).count() == 0


# Chat


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")


def test_events_are_folded(spark):
    rows = [
        (1, 1, "open", 0, "user", "Hi"), (1, 2, "delta", 0, None, " you"), (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "dra"), (1, 5, "delta", 1, None, "ft"),
        (1, 6, "open", 2, "user", "why?"), (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "fi"), (1, 9, "delta", 1, None, "nal"), (1, 10, "edit", 0, None, "Hey"), (1, 11, "open", 2, "user", "ok"),
        (2, 1, "delta", 0, None, "lost"), (2, 2, "other", 0, "user", "x"), (2, None, "open", 0, "user", "x"), (3, 5, "open", 0, "user", None),
    ]
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.fold(log(spark, rows)).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "Hey"), (1, 1, "assistant", "final"), (1, 2, "user", "ok"), (3, 0, "user", "")]


def test_formatting_is_reversible(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn:user>\nx</turn>\n", "\\c\\o\\b\\", "", "</tu</turn>rn>", "a>\nb", "<turn:", "é😀"]
    messages = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "r>\n<turn:x"))]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    out = chat.render(df).select("formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [(t.role, t.text) for t in out.turns] == [(r, t) for _, _, r, t in messages]
    masked = [out.formatted[s.start - 1 : s.start - 1 + s.length] for s in out.loss_spans]
    assert [m.replace("\\c", "</turn>").replace("\\o", "<turn:").replace("\\b", "\\") for m in masked] == [t for _, _, r, t in messages if r == "assistant"]


def test_conversations_against_brute_force(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op3_chat(spark, sf_dir).collect()}
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.role, r.text or ""))
    rows[-7] = [(x, "\\### Assistant: </turn> ok") for x in ("user", "assistant")]
    assert got.keys() == rows.keys()
    for c, turns in rows.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.event_log(df)))
    assert {r.conv_id: r.formatted.count("</turn>") for r in out.collect()} == {1: 3, None: 1}
    assert chat.render(chat.fold(chat.event_log(df.limit(0)))).count() == 0


def test_regeneration_before_the_opening_is_ignored(spark):
    rows = [(1, 0, "open", 1, "user", "kept"), (1, 1, "regenerate", 0, None, None), (1, 5, "open", 0, "user", "first"), (1, 6, "open", 2, "assistant", "gone"), (1, 7, "regenerate", 0, None, None), (1, 8, "open", None, "user", "null"), (1, 9, "regenerate", None, None, None)]
    got = {(r.turn, r.text) for r in chat.fold(log(spark, rows)).collect()}
    assert got == {(0, ""), (None, "")}
    got = {(r.turn, r.text) for r in chat.fold(log(spark, rows[:3])).collect()}
    assert got == {(0, "first"), (1, "kept")}


def test_long_conversation_and_clashing_columns(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("says </turn> "), F.col("id")).alias("text"))
    odd = df.select("*", *(F.lit("clash").alias(c) for c in ("piece", "span", "loss", "m", "log", "since", "formatted")))
    out = chat.render(chat.fold(chat.event_log(odd))).select("formatted", "loss_spans", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("said"), chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [t.text for t in out.turns] == [f"says </turn> {i}" for i in range(n)] and out.said == [f"says </turn> {i}" for i in range(1, n, 2)]
    s = out.loss_spans[-1]
    assert out.formatted[s.start - 1 : s.start - 1 + s.length] == f"says \\c {n - 1}" and s.turn == n


# Fingerprints


def test_fingerprints(spark):
    rng = random.Random(7)
    rows = [(i * 3, " ".join(rng.choices([f"v{k}" for k in range(400)], k=rng.choice([0, 2, 4, 30, 200])))) for i in range(40)]
    df = spark.createDataFrame([*rows, (200, None), (0, rows[0][1])], "doc_id long, text string")
    rows = sorted([*rows, (200, ""), (0, rows[0][1])], key=lambda r: (-r[0], r[1]))
    got = fingerprint.with_next(df, "doc_id", "text").collect()
    assert sorted((r.id, r.text, r.next_text) for r in got) == sorted((d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows))
    same = collections.defaultdict(set)
    for r in got:
        same[r.text].add(tuple(r.sketch))
        w = r.text.split()
        assert len(r.sketch) == min(fingerprint.K, len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) or bool(w))
    assert all(len(x) == 1 for x in same.values())


def test_sketches_estimate(spark):
    a, b = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(1000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:1500] + b), " ".join(a[:1500]), "", " ".join(a[1496:]))], "x string, y string, part string, nil string, rest string")
    s = df.select(*(fingerprint.sketch(F.col(c)).alias(c) for c in df.columns))
    r = s.select(
        fingerprint.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprint.containment(F.col("part"), F.col("x")).alias("c"), fingerprint.distinct_shingles(F.col("x")).alias("n"),
        fingerprint.resemblance(F.col("nil"), F.col("nil")).alias("e"), fingerprint.resemblance(F.col("nil"), F.col("x")).alias("o"), (fingerprint.merge(F.col("part"), F.col("rest")) == F.col("x")).alias("m"),
    ).first()
    assert abs(r.j - 0.375) < 0.15 and r.c > 0.8 and abs(r.n - 2996) < 900 and r.e == 1 and r.o == 0 and r.m


def test_fingerprints_of_odd_rows(odd, none):
    assert fingerprint.with_next(odd, "doc_id", "text").count() == len(ODD)
    assert fingerprint.with_next(none, "doc_id", "text").count() == 0
    assert fingerprint.with_next(odd.filter("doc_id is null"), "doc_id", "text").count() == 2


def brute_sketch(text):
    """The k least hashes of five-word shingles: words by xxh64, shingles by chaining."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = [xxhash.xxh64_intdigest(x, 42) for x in re.findall("[^ \\t-\\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out = set()
    for run in [w[i : i + 5] for i in range(len(w) - 4)]:
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(signed(h))
    if 0 < len(w) < 5:
        h = 0
        for x in w:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        out.add(signed(h))
    return sorted(out)[: fingerprint.K]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    both = sorted({*a, *b})[: fingerprint.K]
    return sum(x in a and x in b for x in both) / max(1, len(both))


def test_fingerprint_query_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choices([f"V{k}" for k in range(90)], k=rng.choice([0, 1, 4, 5, 30, 250])))) for i in rng.sample(range(500), 60)]
    rows += [(600, None), (601, rows[0][1]), (602, "\u00e9\u00e9 \u65e5\u672c A b"), (603, "one two three four five six seven eight nine ten eleven twelve"), (604, "one two three four five six seven eight nine ten eleven zwoelf")]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, sketch string, key int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        a, b, c = map(brute_sketch, (t, edited, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == ",".join(map(str, a)) and r.edited_fingerprint == ",".join(map(str, b))
        assert math.isclose(r.near_edited, brute_likeness(a, b)) and math.isclose(r.near_next, brute_likeness(a, c))
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert fingerprint.op7_fingerprint(spark, empty).count() == 0


# Components


def test_components(spark):
    edges = [(1, 2), (2, 1), (2, 3), (5, 4), (7, 7), (None, 1), (9, None), (None, None), (10, 11), (10, 11), (12, 11), *((100 + i, 101 + i) for i in range(40))]
    df = spark.createDataFrame([(*e, "clash") for e in edges], "a long, b long, node string")
    got = {(r.node, r.root) for r in components.components(df).collect()}
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (10, 10), (11, 10), (12, 10), *((100 + i, 100) for i in range(41))}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


# Decontamination over tables


def test_contaminated_against_all_pairs(spark):
    """Seeds, blocks and the threshold lose no pair: each is compared by tiling by definition, over whole texts."""
    rng = random.Random(18)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 2, 5, 9, 14])))) for i in range(12)]
    docs = []
    for i in range(40):
        w = rng.choices(vocab, k=rng.randint(0, 25))
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(12)][1].split()
            cut, at = rng.randint(0, len(part)), rng.randint(0, len(w))
            w = w[:at] + part[cut:] + rng.choices(vocab, k=rng.randint(0, 1)) + part[:cut] + w[at:]
        docs.append((i, " ".join(w)))
    want = {}
    for d, t in docs:
        for i, item in items:
            p = item.split()
            if p and (n := brute_tiles(p, t.split(), min(5, len(p)))) >= 0.6 * len(p):
                want[d, i] = n
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for tokens in (2_000_000, 20):
        got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(df, bench, block_tokens=tokens).collect()}
        assert got == want
        left = {r.doc_id for r in decontaminate.decontaminate(df, bench, block_tokens=tokens).collect()}
        assert left == {d for d, _ in docs} - {d for d, _ in want}


# The others on odd rows


def test_row_by_row_operators_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (1, "a b c d e f")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(odd, bench).collect()) == [1, 1, 1, 1, 7, 7]
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == decontaminate.contaminated(none, bench).count() == 0
    kept = decontaminate.decontaminate(odd, bench, block_tokens=6)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    model = langid.fit(odd)
    assert langid.predict(odd, model).filter("lang_pred = 'und'").count() == 5
    assert langid.predict(odd, langid.fit(none)).select("lang_pred").distinct().first()[0] == "und"
    assert langid.keep_identified(none, model).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD) and pii.find_pii(none).count() == 0
    ids = bpe.encode(odd, bpe.default_path())
    assert [r.text for r in bpe.decode(ids, bpe.default_path()).collect()] == [t or "" for _, t, _ in ODD]
    assert bpe.encode(none, bpe.default_path()).count() == 0


def test_pages_on_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, "v", "", "t"), (3, "w", "<p>" + "word " * 50_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.text[:6], r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "word w", 249_999)]
    assert html.extract(df, keep=("page_id", "text")).columns == ["page_id", "text", "n_chars"]
    assert html.extract(df.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    """Nulls, repeated ids, empty and long texts, extra columns and an empty table."""
    import corpus_pipeline as p

    bench = spark.createDataFrame([(1, "some passage of the benchmark that nobody should have seen"), (2, None)], "item_id long, text string")
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = p.run(spark, str(tmp_path / "odd")).collect()
    # Without letters: 2, 3, 6, 8 and a null; of the three near copies of one text the row of the least id stays.
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 4, 5] and all(r.round_trip for r in out)
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    step = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, step, sf_dir)
        assert after.columns == docs.columns, name
        before, step = step, spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < step.count() <= before.count()
    out = p.STAGES[-1][1](spark, step, sf_dir).collect()
    assert len(out) == step.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    texts = [b" ".join(decontaminate.tokens(r.text)) for r in step.collect()]
    assert not any(b" ".join(b) in t for b in bench for t in texts)
    assert not any(x[0] in pii.BASE for r in step.collect() for x in pii.found(r.text))
