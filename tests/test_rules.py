"""Rules at their edges: white space of any kind, exact patterns, shares at the bar, and operators that take another way to the same rows."""

import random
import unicodedata

from pyspark.sql import functions as F

from doclens.functions import text as T
from doclens.operators import geometry as G
from doclens.operators import layout as L
from doclens.operators import matching as M
from doclens.operators import reconcile as R
from doclens.operators import vocabulary as V
from doclens.plans import audit
from doclens.sources import files as S


def test_ends_are_stripped_of_all_white_space(spark):
    odd = ["\n a \t", "a", "", " \r\n\x1c", "\u00a0a b\u2003", "a\n"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x string").select(T.stripped("x")).collect()]
    assert got == [x.strip() for x in odd]


def test_normalized_like_the_library(spark):
    rng = random.Random(1)
    chars = [*map(chr, range(1, 0x180)), "\u0300", "\u0301", "\u0327", "\u2019", "\u2014", "\u2026", "\ufb01", "\uff21", "\u1100", "\u1161", "\u00e9", "e"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 6))) for _ in range(3000)] + chars
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", T.normalized(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: unicodedata.normalize("NFKC", x) for i, x in enumerate(texts)}


def test_shares_at_the_bar(spark):
    """55 of 100 cells and 99 of 180 are enough."""
    for shared, size in ((55, 100), (99, 180)):
        rows = [(1, "source", 0, 0, k, False, f"cell number {k}") for k in range(size)] + [(1, "result", 0, 0, k, False, f"cell number {k}" if k < shared else f"other text {k}") for k in range(size)]
        cells = spark.createDataFrame(rows, "doc_id long, side string, table_no int, row_no int, cell_no int, has_drawing boolean, text string")
        assert M.missing_tables(cells).count() == 0
        fewer = cells.withColumn("text", F.when((F.col("side") == "result") & (F.col("cell_no") == 0), "changed text").otherwise(F.col("text")))
        assert M.missing_tables(fewer).count() == 1


def test_words_are_compared_by_folded_case():
    assert M.word_cover("Stra\u00dfe", "STRASSE") == 1.0


def test_keys_over_several_lines(spark):
    text = "\\cite{a,\n  b\t}\\ref{x,\n\ty}\\documentclass[\n a4paper]{article}\\geometry{\n left=2cm,\n right=3cm\n}"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.key for r in S.citation_keys(d).collect()} == {"a", "b"} and {r.key for r in S.cross_reference_keys(d).collect()} == {"x", "y"}
    r = S.page_layout(d).first()
    assert [round(x, 3) for x in (r.width, r.height, r.left, r.right, r.top, r.bottom)] == [8.268, 11.693, 0.787, 1.181, 1.0, 1.0]


def test_titles_of_entries():
    text = '@article{k1, booktitle={No}, title = {A {B} c},}\n  @Book(k2, TITLE="say \\"x\\" y"\n)\n@misc{k3, title={a{b{c}}}}\n@misc{k4,\nnote={x @x{y, title={in}}\n}\n@misc{ , title={z}}'
    assert S.bib_records(text) == [("k1", "A {B} c"), ("k2", 'say \\"x\\" y'), ("k4", "in")]
    assert S.bib_records("") == [] and S.bib_records("title={x}") == []


def test_page_words_and_messages(spark):
    pages = spark.createDataFrame([(1, 0, "one two\n\t1\r\n three")], "doc_id long, page_no int, text string")
    assert audit.page_words(pages).first().words == ["one", "two", "three"]
    m = spark.createDataFrame([(1, 0, "x\n"), (1, 1, "\tx"), (1, 2, "\n"), (1, 3, "y")], "run_id long, seq int, message string")
    assert [(r.seq, r.message) for r in R.unique_messages(m).orderBy("seq").collect()] == [(0, "x"), (1, "y")]
    e = spark.createDataFrame([(1, 0, "paragraph", "\t7\n", False, False, True), (1, 1, "paragraph", "\n", False, False, False)], "doc_id long, ord int, kind string, text string, has_drawing boolean, has_break boolean, is_section_end boolean")
    assert [r.ord for r in L.page_number_paragraphs(e).collect()] == [0]


def test_islands_in_ranges(spark):
    """Scanning ranges apart and carrying on gives the islands of one scan."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(x := rng.randrange(4000)), float(x + rng.choice([0, 3, 30, 700]))) for _ in range(500)]
    d = spark.createDataFrame(sorted(set(rows), key=repr), "k string, lo double, hi double")
    for inclusive in (False, True):
        want = sorted(G.islands(d, ("k",), "lo", "hi", 5, inclusive).collect(), key=repr)
        for bucket in (1.0, 50.0, 10_000.0):
            assert sorted(G.islands(d, ("k",), "lo", "hi", 5, inclusive, bucket).select("k", "lo", "hi", "island").collect(), key=repr) == [tuple(r) for r in want]


def test_neighbours_three_ways(spark):
    d = spark.createDataFrame([(1, "ab cd ab cd\nef\n\ngh ij"), (2, "ab cd"), (3, None), (4, "")], "doc_id long, text string")
    lines = V.lines(d)
    sorted_way = {tuple(r) for r in V.adjacent_pairs(V.word_rows(lines, "doc_id", "line_no"), ("doc_id", "line_no")).collect()}
    assert {tuple(r) for r in V.neighbours(V.line_words(lines, "doc_id"), "doc_id").collect()} == sorted_way
    assert {(r.doc_id, *p.split("\0")) for r in V.document_neighbours(d).collect() for p in r.pairs} == sorted_way == {(1, "ab", "cd"), (1, "cd", "ab"), (1, "gh", "ij"), (2, "ab", "cd")}


def test_missing_runs_of_contained_and_lost_pages(spark):
    words = [f"w{i}" for i in range(20)]
    pages = spark.createDataFrame([(1, 0, words[3:12]), (1, 1, words[::-1]), (2, 0, words), (3, 0, words[:7])], "doc_id long, page_no int, words array<string>")
    results = spark.createDataFrame([(1, words), (2, None)], "doc_id long, words array<string>")
    got = sorted((r.doc_id, r.page_no, r.start, r.n) for r in M.missing_runs(pages, results).collect())
    assert got == [(1, 1, 1, 19), (2, 0, 0, 20), (3, 0, 0, 7)]


def test_labels_at_the_beginning(spark):
    rows = [("Table 1. x", "Table 1.", True), ("Table 1.", "Table 1.", True), ("Table 1.x", "Table 1.", False), ("\n figure 3. y", "Figure 2.", True), ("Figure y", "Figure 2.", False)]
    got = spark.createDataFrame(rows, "t string, l string, want boolean").select(T.begins_with_label(F.col("t"), F.col("l")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
