"""Operators that work row by row, against brute force, libraries or round trips."""

import math
import random
import re

import numpy as np
import pytest

from doclens.llm import bpe, decontaminate, html, langid, pii


# PII

BRUTE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    for kind, p in BRUTE.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            yield kind, *m.span()


def test_pii_base_spans():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "@", "me@a-b.c.d", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", " ", ".", "-", "é", "日", "0" * 14, "a@b.c@d.e"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [x[:3] for x in pii.found(text) if x[0] in pii.BASE] == list(brute_pii(text)), text


def test_pii_added_kinds_and_context():
    kinds = lambda t: [x[0] for x in pii.found(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01.") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert pii.found("mail a@b.cd")[0][3] > pii.found("xxxx a@b.cd")[0][3]
    assert pii.redacted("write a@b.cd or +49 30 1234567!") == "write <EMAIL> or <PHONE>!"


def test_ibans_before_other_capitals():
    ibans = lambda t: [t[a:b] for k, a, b, _ in pii.found(t) if k == "iban"]
    spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    for t in (f"{spaced} BIC COBADEFF", f"{spaced} 12", f"AB12 CDEF 3456 7890 {spaced}"):
        assert ibans(t) == [spaced], t
    for t in (f"{plain} EUR", f"{plain} I said", f"{plain} Is it", f"pay {plain}", f"{plain}é"):
        assert ibans(t) == [plain], t
    assert ibans(f"{spaced} {plain} NO9386011117947 X") == [spaced, plain, "NO9386011117947"]
    assert ibans(f"{plain}0") == ibans(f"X{plain}") == ibans(f"{plain}x") == []
    # A country without a known length.
    unknown = next(x for k in range(100) if pii.mod97(x := f"ZZ{k:02} 1234 5678 9012 345"))
    assert ibans(f"{unknown} BIC AB") == [unknown]
    assert pii.redacted(f"{plain} EUR") == "<IBAN> EUR"


def test_pii_long_runs():
    """Within seconds, and without a crash."""
    assert pii.found("1.2.3." + "0" * 5000 + "1")[0][:3] == ("ip", 0, 5007)
    assert pii.found("1.2.3." + "9" * 5000) == []
    for text in ("5" * 10**6 + ".", "1." * 10**6, "+1(" * 300_000, "@a" * 500_000, "a@" * 500_000, "0 " * 500_000, "ab12" * 250_000, "f" * 10**6):
        pii.redacted(text)


def test_pii_ip_runs_of_digits():
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice("01259....x") for _ in range(rng.randint(0, 24)))
        assert [x[:3] for x in pii.found(text) if x[0] in pii.BASE] == list(brute_pii(text)), text


def test_pii_secrets_need_context():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    spans = lambda t: [t[a:b] for k, a, b, _ in pii.found(t) if k == "secret"]
    assert spans(f'token = "{key}" and') == [key] and spans(f"{key} is the api key") == [key]
    assert spans(f"commit {key} was reverted") == [] and spans(f"token {key}0_x") == []
    assert pii.redacted(f"my password {key}") == "my password <SECRET>"
    # Words against a span cut the score, on either side; base spans stay.
    iban = "DE89370400440532013000"
    assert [k for k, *_ in pii.found(f"serial {iban}")] == [] == pii.found(f"{iban} is a sample") and [k for k, *_ in pii.found(f"serial a@b.cd, account {iban}")] == ["email", "iban"]


def test_redaction_of_overlapping_spans():
    assert pii.redacted("+4111 1111 1111 1111 x") == "<PHONE> x" or pii.redacted("+4111 1111 1111 1111 x") == "+<CARD> x"
    assert pii.redacted("a@1.2.3.4 b") == "<EMAIL> b"


# BPE


def test_bpe_like_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path())
    rng = random.Random(2)
    alphabet = "aábcdefghijklmnopqrstuvwxyzéßABC '\"!?.,\n\t 0123456789日本😀"
    texts = ["", " ", "<|endoftext|>", "ab" * 3000, "a" * 5000, "don't we'll I'd", " x y"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(400)]
    for x, enc in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        ids = e.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == enc.ids, x
        assert e.decode(ids) == t.decode(enc.ids, skip_special_tokens=False) == x


def test_certain_cuts_and_own_merges():
    e = bpe.encoder(bpe.default_path())
    for token in list(e.token.values())[:5000]:
        if token.decode("utf-8", "replace").encode() == token and token != b"<|endoftext|>":
            assert e.fragments(token) == [token]
    for w in ("hello", "thhetion", "éauouè", "x" * 70, "naïveté" * 15):
        assert e._merge_own(w.encode()) == e._merge(w.encode())
        assert b"".join(e.fragments(w.encode())) == w.encode()


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b  c<br>d", "a\n\nb c d"),
        ("<body><nav><a href=x>menu menu menu</a></nav><article><h1>T</h1><p>One.</p></article><footer>f</footer></body>", "T\n\nOne."),
        ('<body><div class="cookie-notice">We use cookies on this site, many of them</div><div id=main><p>Text &eacute; here</p><ul><li>x<li>y</ul></div><div id="comments"><p>A very long reader comment that goes on and on.</p></div></body>', "Text é here\n\nx\n\ny"),
        ("<body><script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><form>f<input></form></body>", "yes"),
        ("<article><p>a <b>b <i>c</b> d</p><aside>side</aside><p>e</p></article>", "a b c d\n\ne"),
    ],
)
def test_html_cases(page, text):
    assert html.main_text(page) == text


SENTENCES = [f"Paragraph {i} of the text tells at some length what there is to be told of its subject." for i in range(6)]


def test_html_density_selects():
    body = "".join(f"<p>{s}</p>" for s in SENTENCES)
    text = "\n\n".join(SENTENCES)
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>page {i}</a></li>" for i in range(20)) + "</ul></div>"
    # A small teaser in an <article> doesn't displace the text in a <div>, and a list of links without a name is noise.
    assert html.main_text(f"<body>{links}<div>{body}</div><article><p><a href=x>More</a></p></article>{links}</body>") == text
    # Each of several blocks that reach the threshold is kept.
    for tag in ("article", "div"):
        assert html.main_text(f"<body>{links}<div><{tag}>{body}</{tag}>{links}<{tag}>{body}</{tag}></div></body>") == f"{text}\n\n{text}"


def test_html_names_that_are_no_noise():
    text, body = "\n\n".join(SENTENCES), "".join(f"<p>{s}</p>" for s in SENTENCES)
    for attributes in ('style="overflow:hidden"', 'title="the hidden city"', 'class="entry-content has-sidebar"', 'class="post with-comments"', 'class="side-by-side"', 'class="comment search"', 'aria-label="Search and comments"'):
        for inner in (body, f"<article>{body}</article>"):
            assert html.main_text(f"<body><nav>menu</nav><div {attributes}>{inner}</div><footer>f</footer></body>") == text, attributes
    assert html.main_text(f"<body><form action=x>{body}<input></form></body>") == text
    assert html.main_text(f"<body><header>site</header><article><header><h1>Title</h1></header>{body}</article></body>") == f"Title\n\n{text}"
    # Half of the text in a part with such a mark, so that only the name tells.
    for attributes, kept in (('style="overflow:hidden"', True), ('title="the hidden city"', True), ('class="no-sidebar"', True), ('class="side-by-side"', True), ("hidden", False), ('style="color:red; display: none"', False), ('class="main-sidebar"', False), ('class="ad-box"', False), ("id=comments", False)):
        part = f"<div {attributes}><p>{SENTENCES[0]}</p></div>"
        assert (SENTENCES[0] in html.main_text(f"<body><article>{''.join(f'<p>{s}</p>' for s in SENTENCES[1:])}{part}</article></body>")) == kept, attributes


def brute_density(node, page):
    """(density, sum of the children's densities) by the definition, from counts taken anew at each node."""
    inner = lambda n: [k for k in n.kids if not isinstance(k, str)]
    below = lambda n: [x for k in inner(n) for x in (k, *below(k))]
    chars = lambda n: sum(len(k.strip()) for x in (n, *below(n)) for k in x.kids if isinstance(k, str))
    link_tops = lambda n: [n] if n.tag == "a" else [x for k in inner(n) for x in link_tops(k)]

    def density(n):
        c, t = chars(n), len(below(n))
        lc, lt = sum(map(chars, link_tops(n))), sum(1 + len(below(x)) for x in link_tops(n))
        if not c:
            return 0.0
        body = chars(page)
        share = sum(map(chars, link_tops(page))) / body
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        x = c / max(lc, 1) * max(t, 1) / max(lt, 1)
        return c / max(t, 1) * (math.log(x, base) if x > 1 and base > 1 else 0.0)

    return density(node), sum(density(k) for k in inner(node) if not k.noise)


def test_html_densities_against_brute_force():
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["", "word ", "some words in a row, ", "A whole sentence of text that stands here. "])
        tag = rng.choice(["div", "p", "a", "span", "ul", "section", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        root = html.parse(f"<body>{tree(5)}{tree(5)}{tree(4)}</body>")
        nodes = html.measure(root)
        page = next(n for n in nodes if n.tag == "body")
        for n in nodes:
            want = brute_density(n, page)
            assert math.isclose(n.density, want[0], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(n.total, want[1], rel_tol=1e-9, abs_tol=1e-12)


def test_html_density_decides_without_names():
    """Pages of which no element or name tells what is text: on all of them the density changes the result."""
    rng, changed = random.Random(9), 0
    sentence = lambda: " ".join(rng.choice(["the", "river", "slowly", "turns", "old", "mill", "near", "town"]) for _ in range(rng.randint(14, 40))).capitalize() + "."
    links = lambda n: "<div><ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(n)) + "</ul></div>"
    for _ in range(40):
        paragraphs = [sentence() for _ in range(rng.randint(4, 9))]
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        page = f"<body><div>{links(rng.randint(5, 30))}<div>{body}</div>{links(rng.randint(5, 30))}</div><table><tr><td><a href=/>Home</a></td><td><a href=/x>Login</a></td></tr></table></body>"
        assert html.main_text(page) == "\n\n".join(paragraphs)
        changed += "\n\n".join(html.blocks(html.parse(page))) != html.main_text(page)
    assert changed == 40


def test_html_keeps_what_belongs_to_the_text():
    text, body = "\n\n".join(SENTENCES), "".join(f"<p>{s}</p>" for s in SENTENCES)
    page = "<body><nav>menu</nav><article><header><h1>Title</h1></header>{}</article><footer>f</footer></body>"
    full = lambda part: html.main_text(page.format(body + part))
    assert full(f'<div class="related-work"><p>{SENTENCES[0]}</p></div>') == f"Title\n\n{text}\n\n{SENTENCES[0]}"
    assert full(f'<p class="search-results">{SENTENCES[0]}</p>').endswith(f"{SENTENCES[-1]}\n\n{SENTENCES[0]}")
    assert full('<div class="related-posts"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div>') == f"Title\n\n{text}"
    assert full("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>so</object></p>").endswith("Let x=1 be so")
    assert full(f'<article class="comment"><p>{SENTENCES[0]}</p></article>') == f"Title\n\n{text}"
    one, two = "".join(f"<p>{s}</p>" for s in SENTENCES[:3]), "".join(f"<p>{s}</p>" for s in SENTENCES[3:])
    for tag in ("article", "div"):
        assert html.main_text(f"<body><nav>menu</nav><main><{tag}>{one}</{tag}><{tag}>{two}</{tag}></main><footer>f</footer></body>") == text


def test_html_odd_markup():
    assert html.main_text("<article><p>1 < 2 and 3 > 2</p><p>a <</p></article>") == "1 < 2 and 3 > 2\n\na <"
    assert html.main_text('<article><p title="x > y">A</p><p title="never ends>B</p><p>C</p></article>') == "A\n\nB\n\nC"
    assert html.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert html.main_text("<head><title>t</title><p>text</p>") == "text"


@pytest.mark.parametrize("piece", ["<a ", "<", "<!", "<a \">\"", "<a '\">", "</b>", "<b>", "<p><span>", "<div></p>", "<td>", "&amp", "<!--", "<b><div></i>"])
def test_html_of_a_megabyte(piece):
    """Within seconds, whatever isn't closed."""
    n = 10**6 // len(piece)
    html.main_text(piece * n)
    html.main_text("<p>" + piece * n + ">")


# Language ID


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 7, 12):
        c = langid.codewords(n)
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * 99
        assert c.shape[0] == n and d.min() >= 1
        assert (np.abs(c.sum(0)) < n).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    rows = docs.filter("doc_id % 4 = 2").collect()
    right = sum(model.decide(r.text, 0)[0] == r.lang for r in rows)
    assert right >= 0.97 * len(rows)
    assert model.decide(None, 0.1) == ("und", 0.0, False, 0.0)
    assert model.decide("123 !?", 0.1)[0] == "und"


def test_numerals_are_no_letters():
    model = langid.Model(["xx"], langid.codewords(1), np.zeros((langid.BUCKETS, 1), np.float32), np.ones(1, np.float32))
    for text in (None, "", "12 %", "\u00bd \u00b2 \u2167", "\u0663"):
        assert model.decide(text, 0.1)[0] == "und", text
    assert model.decide("\u00bd a", 0.1)[0] == "xx" and model.decide("\u65e5", 0.1)[0] == "xx"


def test_nearest_codeword_by_definition():
    """The language whose codeword has the least weighted logistic loss over the bits, searched one by one; close seconds are ambiguous."""
    rng = np.random.default_rng(19)
    for n in (2, 3, 5, 8):
        codes = langid.codewords(n)
        weights = rng.normal(size=(langid.BUCKETS, codes.shape[1])).astype(np.float32)
        trust = rng.random(codes.shape[1]).astype(np.float32)
        model = langid.Model([f"l{i}" for i in range(n)], codes, weights, trust)
        for text in ("some text", "a", "\u00e9\u00e8 longer text of many words " * 9):
            margin = langid.features(text) @ weights
            loss = [sum(float(t) * math.log1p(math.exp(-4 * float(c) * float(m))) for c, m, t in zip(word, margin, trust)) for word in codes]
            best = min(range(n), key=loss.__getitem__)
            lang, score, _, gap = model.decide(text, 0.02)
            assert lang == f"l{best}" and math.isclose(gap, sorted(loss)[1] - min(loss), rel_tol=1e-3, abs_tol=1e-4) and 0 <= score <= 1
            assert model.decide(text, gap * 1.01)[2] and not model.decide(text, gap * 0.99)[2]


# Decontamination


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


def test_tiling_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        p, t = [rng.randint(1, 4) for _ in range(rng.randint(0, 14))], [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        assert sum(n for *_, n in decontaminate.tiles(p, t, 3)) == brute_tiles(p, t, 3)


def test_reordered_passages_and_short_items():
    item = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions"
    words = item.split()
    b = decontaminate.Block([(1, item), (2, "one two"), (3, "")], 5, 0.6)
    assert [m[0] for m in b.match(f"xx {' '.join(words[7:])} yy {' '.join(words[:7])} zz".encode())] == [1]
    assert [m[0] for m in b.match(b"so One, TWO!")] == [2]
    assert b.match(" ".join(words[:6]).encode()) == [] and b.match(None) == [] and b.match(b"") == []


def test_words_are_numbered_a_batch_at_a_time():
    """As Python parts and lower-cases them: odd white space, ends, nulls, long texts and batches in parts; each distinct word is hashed once in a part."""
    import pyarrow as pa
    import xxhash

    from doclens.llm import ngram_lm

    texts = ["  A b\tA\x0b\n", None, "", " \n ", "É\x1cx\u00a0y É", "x " * 5000, "a", "b\r\x0cB  end"]
    for batch in (pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": ["cut off", *texts]}).slice(1)):
        for room in (1, 40, 1 << 21):
            got = []
            for part, sizes, codes, words in ngram_lm.worded(iter([batch]), 0, room):
                assert len(sizes) == part.num_rows and sizes.sum() == len(codes) and len(set(words.tolist())) == len(words)
                got += [words[codes[e - n : e]].tolist() for e, n in zip(sizes.cumsum(), sizes)]
            assert got == [[xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()] for t in texts]


def test_pairs_of_split_words_alone_are_counted(monkeypatch):
    """The pass before the model's reads other words only as neighbours, and its counts are those of the texts."""
    import collections

    import numpy as np
    import pyarrow as pa
    import xxhash

    from doclens.llm import ngram_lm
    from doclens.llm.common import unpacked

    name = xxhash.xxh64_intdigest
    held = [name(w) for w in (b"hot", b"cold")]
    known = ngram_lm.Known(np.array([ngram_lm.BEFORE, ngram_lm.END, ngram_lm.AFTER, *held], np.uint64), np.array([0, 4, 0, 9, 2]), 3)
    monkeypatch.setattr(ngram_lm, "Chunk", None)  # no other word is numbered
    rows = [(False, "hot a"), (False, ""), (True, "hot a hot b"), (False, "cold Hot"), (False, "b hot a"), (False, "cold")]
    batch = pa.RecordBatch.from_pydict({"held_out": [x for x, _ in rows], "text": [t for _, t in rows]})
    got = collections.Counter()
    for out in ngram_lm._send_pairs(4, known, 100)(iter([batch])):
        for value in out["pairs"].to_pylist():
            middle, _, code, gaps, count = unpacked(value)
            for m, r, c in zip(known.h[middle].tolist(), known.hashes(gaps)[code].tolist(), count.tolist()):
                got[m, r] += c
    assert got == {(held[0], name(b"a")): 2, (held[0], name(b"b")): 0, (held[0], ngram_lm.END): 1}
