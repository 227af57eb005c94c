"""Small inline tables, for operators that the driver's tables give no input. Each is usable in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Fixture = tuple[str, list[tuple]]

FIXTURES: dict[str, Fixture] = {
    "tex": ("doc_id bigint, text string", [(1, "a\\%b%c\nd"), (2, "a\\\\%b"), (3, "100\\% sure % not\n% all\nend"), (4, "plain"), (5, "")]),
    "lengths": ("id bigint, value string", [(1, "2.54cm"), (2, "72"), (3, "1in"), (4, "25.4 mm"), (5, "72.27bp"), (6, "x"), (7, "3 furlong"), (8, "0.5\\textwidth"), (9, "\\linewidth"), (10, "36pt"), (11, "-0.5 \\linewidth"), (12, "\\hsize"), (13, ".\\textwidth"), (14, "\n .5\\columnwidth\t"), (15, "+1in"), (16, "2.in"), (17, "\n-2cm\n"), (18, "3 INCH"), (19, ".5in")]),
    "fonts": ("id bigint, name string", [(1, "ABCDEF+CMR10"), (2, "XYZ+CMTT8"), (3, "Helvetica"), (4, "AA+t1xtt"), (5, "AA+t1xr"), (6, "Q+CMMI10"), (7, "NimbusMonL"), (8, "STIX"), (9, "AA+t1x-tt"), (10, "T1Xabtt"), (11, "Euler+Arial")]),
    "labels": ("id bigint, n bigint", [(i, n) for i, n in enumerate((1, 2, 26, 27, 52, 53, 702, 703, 18278))]),
    "lines": (
        "id bigint, text string",
        [(1, "Table 3: Results"), (2, "figure 12. A map"), (3, "Fig 2 shows"), (4, "(a) left"), (5, "(B) right"), (6, "2.1 Methods"), (7, "A Appendix"), (8, "I Other"), (9, "plain text"), (10, "was done.Then we"), (11, "x" * 95), (12, "12"), (13, "Table. 3: no"), (14, "1. Intro"), (15, "A.1 Lemma"), (16, " 2 Leading"), (17, "3 \u00dcberblick"), (18, "zu\u00e9a.Bc"), (19, "Fig. 4: x"), (20, "\n Figure 5: y")],
    ),
    "spans": (
        "doc_id bigint, page_no int, block_no int, span_no int, x0 double, y0 double, x1 double, y1 double, font string, text string",
        [
            (1, 0, 0, 0, 72.0, 80.0, 500.0, 92.0, "T+CMR10", "A line of body text that fills the page"), (1, 0, 1, 0, 150.0, 100.0, 300.0, 112.0, "T+CMMI10", "E = mc"), (1, 0, 1, 1, 150.0, 100.0, 310.0, 112.0, "T+CMR7", "2"),
            (1, 0, 2, 0, 160.0, 120.0, 320.0, 130.0, "T+CMR10", "where c is fast"), (1, 0, 3, 0, 72.0, 400.0, 505.0, 412.0, "T+CMR10", "Another line of body text on this page"), (1, 0, 4, 0, 72.0, 500.0, 300.0, 510.0, "T+CMR10", "Table 1: words"),
            (1, 0, 5, 0, 80.0, 530.0, 200.0, 540.0, "T+CMR10", "cell one"), (1, 0, 5, 1, 210.0, 530.0, 290.0, 540.0, "T+CMR10", "cell two"), (1, 1, 0, 0, 72.0, 80.0, 200.0, 92.0, "T+CMR10", "short"), (1, 1, 1, 0, 90.0, 200.0, 99.0, 210.0, "T+CMR10", " "),
        ],
    ),
    "pages": ("doc_id bigint, page_no int, x0 double, y0 double, x1 double, y1 double", [(1, 0, 0.0, 0.0, 612.0, 792.0), (1, 1, 0.0, 0.0, 612.0, 792.0)]),
    "drawings": (
        "doc_id bigint, page_no int, x0 double, y0 double, x1 double, y1 double",
        [(1, 0, 72.0, 520.0, 300.0, 521.0), (1, 0, 72.0, 545.0, 300.0, 546.0), (1, 0, 72.0, 600.0, 90.0, 601.0), (1, 0, 72.0, 610.0, 300.0, 640.0), (1, 1, 72.0, 100.0, 500.0, 101.0)],
    ),
    "runs": (
        "doc_id bigint, container_no int, run_no int, text string, vert_align string",
        [(1, 0, 0, "alpha", None), (1, 0, 1, "Q", None), (1, 0, 2, "beta", None), (1, 1, 0, "in", None), (1, 1, 1, "put", None), (1, 2, 0, "low-", None), (1, 2, 1, "cost", None), (1, 3, 0, "word", None), (1, 3, 1, "a", "superscript"), (1, 4, 0, "Table", None), (1, 4, 1, "7", None), (1, 5, 0, "Widget", None), (1, 5, 1, "7", None), (1, 6, 0, "end.", None), (1, 6, 1, "Next", None), (1, 7, 0, "see", None), (1, 7, 1, "(here)", None), (1, 8, 0, "the", None), (1, 8, 1, "cat", None), (1, 9, 0, "done ", None), (1, 9, 1, "it", None), (1, 10, 0, "a,", None), (1, 10, 1, "5", None), (1, 11, 0, "1,", None), (1, 11, 1, "000", None)],
    ),
    "source_words": (
        "doc_id bigint, page_no int, block_no int, line_no int, pos int, text string",
        [(1, 0, 0, 0, 0, "alpha"), (1, 0, 0, 0, 1, "Q"), (1, 0, 0, 0, 2, "beta"), (1, 0, 1, 0, 0, "in"), (1, 0, 1, 0, 1, "put"), (1, 0, 1, 1, 0, "input"), (1, 0, 2, 0, 0, "next"), (1, 0, 3, 0, 0, "line")],
    ),
    "headings": (
        "doc_id bigint, ord int, level int, starred boolean, title string, label string",
        [(1, 1, 1, False, "Data", "sec:data"), (1, 2, 2, False, "Sources", None), (1, 3, 2, False, "Limits", "sec:limits"), (1, 4, 1, False, "Proofs", None), (1, 5, 2, False, "Lemma", "sec:lemma"), (1, 6, 3, False, "Case", None), (2, 1, 1, True, "Thanks", "sec:thanks"), (2, 2, 1, False, "More", None), (2, 3, 3, False, "Deep", None)],
    ),
    "captions": (
        "doc_id bigint, kind string, float_no int, pos int, starred boolean, caption string, label string",
        [(1, "table", 0, 10, False, "Results of the test", "tab:res"), (1, "table", 1, 60, True, "Notes", "tab:notes"), (1, "table", 2, 90, False, "Costs", "tab:cost"), (1, "figure", 0, 30, False, "A map", "fig:map"), (1, "panel", 0, 31, False, "left", "fig:left"), (1, "panel", 0, 35, False, "right", "fig:right"), (1, "figure", 1, 70, False, "A plan", "fig:plan"), (1, "panel", 1, 72, False, "top", "fig:top"), (1, "panel", 1, 75, False, "base", "fig:base")],
    ),
    "elements": (
        "doc_id bigint, page_no int, ord int, kind string, text string, has_drawing boolean, has_break boolean, is_section_end boolean",
        [(1, 0, 0, "paragraph", "Table 1: words", False, False, False), (1, 0, 1, "paragraph", "a note", False, False, False), (1, 0, 2, "table", "cell one cell two", False, False, False), (1, 0, 3, "paragraph", "", False, False, False), (1, 0, 4, "paragraph", "1", False, False, True), (1, 1, 5, "paragraph", "Figure 1: a map", False, False, False), (1, 1, 6, "paragraph", "", True, False, False), (1, 1, 7, "paragraph", "(a) left", False, False, False), (1, 1, 8, "table", "x y", True, False, False), (1, 1, 9, "paragraph", "", False, False, False), (1, 1, 10, "paragraph", "Long " * 20, False, False, False), (1, 1, 11, "paragraph", "2", False, False, False)],
    ),
    "cells": (
        "doc_id bigint, side string, table_no int, row_no int, cell_no int, has_drawing boolean, text string",
        [(1, "source", 0, 0, 0, False, "alpha beta"), (1, "source", 0, 0, 1, False, "gamma ray"), (1, "source", 0, 1, 0, False, "delta wing"), (1, "source", 0, 1, 1, False, "epsilon"), (1, "source", 1, 0, 0, False, "lonely cell"), (1, "result", 0, 0, 0, False, "Alpha  Beta"), (1, "result", 0, 0, 1, False, "gamma-ray"), (1, "result", 0, 1, 0, False, "delta wing"), (1, "result", 0, 1, 1, False, "zeta"), (1, "result", 1, 0, 0, True, "lonely cell")],
    ),
    "cited": ("doc_id bigint, key string", [(1, "k1"), (1, "k2"), (1, "k2"), (2, "k3"), (2, "k4")]),
    "entries": ("doc_id bigint, file_no int, key string, title string", [(1, 0, "k1", "A Study of Rivers"), (2, 0, "k3", "Short"), (2, 0, "k4", "On the Theory of Nets"), (2, 1, "k4", "On the Theory of Large Nets")]),
    "bibliography": ("doc_id bigint, ord int, text string", [(1, 0, "Smith. A study of rivers. 1999."), (2, 0, "Jones. Another work. 2001.")]),
    "references": ("doc_id bigint, key string", [(1, "tab:res"), (1, "fig:left"), (1, "sec:none"), (2, "sec:thanks"), (2, " sec:gone ")]),
    "links": (
        "doc_id bigint, ord int, anchor string, text string",
        [(1, 0, "tab:res", "1"), (1, 1, "fig:left", "[fig:left]"), (1, 2, "fig:map", "2"), (1, 3, "tab:res", "9"), (1, 4, "sec:data", "A"), (1, 5, "other", "see")],
    ),
    "spacing": ("id bigint, twips int", [(1, 100), (2, 400), (3, 401), (4, None)]),
    "widths": ("id bigint, total double, widths array<double>", [(1, 10.0, [3.0, None, 2.0]), (2, 6.0, [4.0, 8.0]), (3, 6.0, [None, None]), (4, None, [1.0]), (5, 6.0, [1.0, 2.0]), (6, 6.0, [4.0, None, 4.0]), (7, 6.0, [0.0])]),
    "panels": ("doc_id bigint, fig_no int, panel_no int, start int, stop int, ratio double", [(1, 0, 0, 30, 33, 0.5), (1, 0, 1, 34, 38, 0.8), (1, 1, 0, 71, 73, 0.45)]),
    "images": ("doc_id bigint, pos int, full_width boolean, path string", [(1, 31, True, "a.png"), (1, 36, True, "b"), (1, 50, True, "c.pdf"), (1, 72, True, "\\dir/d")]),
    "files": ("doc_id bigint, path string", [(1, "a.png"), (1, "b.jpeg"), (1, "refs.bib"), (2, "main.bbl"), (2, "main.tex")]),
    "log": (
        "doc_id bigint, path string, temporary string, log string",
        [(1, None, None, '[{"verbosity":"WARNING","pretty":"","message":"lost image"},{"verbosity":"INFO","message":"fine"},{"verbosity":"error","type":"Bad"}]'), (2, "a.tex", "t.tex", "not json"), (3, None, None, None), (4, "in/a.tex", "/t/x.tex", '[{"verbosity":"ERROR","pretty":"P","message":"m"},{"verbosity":"WARNING"},{"verbosity":"warning","message":"no /t/x.tex"}]'), (5, None, "/t/y.tex", '[{"verbosity":"ERROR","message":"in /t/y.tex"}]')],
    ),
    "messages": ("run_id bigint, seq int, message string", [(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (1, 3, " "), (2, 0, "z")]),
    "table_captions": ("doc_id bigint, number int, ord int", [(1, 1, 4), (1, 3, 9), (1, 5, 20)]),
    "sources": (
        "doc_id bigint, text string",
        [
            (1, "\\documentclass[\n a4paper,\n 11pt]{article}\n\\usepackage[margin=2cm]{geometry}\n\\geometry{\n left=1in,\n\ttop=10mm\n}\n\\bibliography{refs,\n extra\n}\n\\cite{k1} \\citep[see]{k2,\n k3} \\ref{tab:res} \\cref{a,\n\tb}\\includegraphics[width=1in]{a}"),
            (2, "\\documentclass{article}\n% \\cite{hidden}\n\\addbibresource{main.bib}\n\\autoref{fig:map}"),
            (3, ""),
        ],
    ),
    "bib": ("file_no bigint, text string", [(0, "@article{k1,\n title = {A {Study} of Rivers},\n year=1999}\n@book{k2, title=\"On Nets\"}\n@misc{k3, note={x}}")]),
    "paper": (
        "doc_id bigint, text string",
        [
            (1, "\\begin{document}\\begin{table}\\caption{Costs}\\label{tab:cost}\\begin{tabularx}{\\textwidth}{l>{\\centering}X*{2}{p{2cm}}}a&b&c&d\\end{tabularx}\\end{table}\\end{document}"),
            (2, "\\section{Start}\\label{s}\\label{s2}\n\\begin{figure}\\begin{subfigure}[b]{0.7\\textwidth}\\includegraphics[width=\\linewidth]{p.png}\\caption{left}\\end{subfigure}\\begin{subfigure}{3cm}\\includegraphics{q}\\end{subfigure}\\caption{Plan}\\end{figure}\\appendix\\section*{Thanks}\\subsection{More}"),
            (3, "% \\begin{table}\n\\begin{table*}\\begin{minipage}{4cm}\\begin{tabularx}{4cm}{XX}a&b\\end{tabularx}note\\end{minipage}\\end{table*}"),
            (4, "\\begin{tabular}{ll}a\n& b \\\\\nc & \\makecell{d}\\end{tabular}\\includegraphics[ % x\n width=1in]{z}"),
            (5, ""),
        ],
    ),
    "covers": ("id bigint, kind string, text string, target string", [(1, "table", "northstation", "north station NS01"), (2, "paragraph", "alpha beta gamma", "alpha gamma delta"), (3, "paragraph", "ification", "verification score"), (4, "table", "abc", "abc"), (5, "paragraph", "Stra\u00dfe am See", "am See"), (6, "paragraph", "12 34 56 78", "12345678"), (7, "table", "abcdefgh", ""), (8, "table", "a b c d e f g h", "hgfedcba" * 9)]),
    "assign_elements": (
        "doc_id bigint, page_no int, ord int, kind string, text string",
        [(1, 0, 0, "paragraph", "alpha beta gamma delta"), (1, 0, 1, "paragraph", "ab"), (1, 0, 2, "paragraph", "epsilon zeta eta theta"), (1, 0, 3, "paragraph", "ification"), (1, 0, 4, "table", "north station NS01"), (1, 0, 5, "paragraph", "Table 1: north station NS01"), (1, 1, 0, "paragraph", "alpha beta")],
    ),
    "assign_regions": ("doc_id bigint, page_no int, region_no int, text string", [(1, 0, 0, "alpha beta gamma delta epsilon zeta eta theta"), (1, 0, 1, "north station NS01"), (1, 0, 2, "verification score"), (1, 1, 0, "something else")]),
    "order_records": ("doc_id bigint, record_no int, text string", [(1, 0, "a map of the river"), (1, 1, "costs by year"), (2, 0, "one")]),
    "order_paragraphs": ("doc_id bigint, ord int, text string", [(1, 3, "Figure: a map of the rivers"), (1, 5, "unrelated matter"), (1, 8, "the costs by year"), (2, 1, "anything")]),
    "parts": (
        "path string, ord int, kind string, text string",
        [("a", 0, "p", ""), ("a", 1, "text", "First wo"), ("a", 2, "text", "rds here"), ("a", 3, "math", "x plus yy"), ("a", 4, "drawing", ""), ("a", 5, "image", "a \ufb01ne image"), ("a", 6, "tbl", ""), ("a", 7, "inner", ""), ("a", 8, "text", "cell"), ("b", 0, "p", ""), ("b", 1, "text", "It's well-known")],
    ),
    "raw": ("path string, hex string", [("ok", "6f6b20c3a9"), ("bad", "6f6bff20656e64"), ("cut", "61e282"), ("empty", "")]),
    "figure_panels": ("doc_id bigint, fig_no int, ratio double", [(1, 0, 0.8), (1, 0, 0.7), (1, 1, 0.9), (1, 2, 0.8), (1, 2, None), (1, 3, 0.9), (1, 3, 0.9), (2, 0, 1.0), (2, 0, 1.0)]),
    "figure_tables": ("doc_id bigint, ord int, rows int, cells int", [(1, 4, 1, 2), (1, 9, 1, 1), (1, 12, 1, 2), (1, 20, 2, 2), (2, 1, 1, 3)]),
    "shapes": ("doc_id bigint, image_no int, width bigint, height bigint", [(1, 0, 1000, 500), (1, 1, 800, 801), (1, 2, 10, 10), (1, 3, 7, 7), (2, 0, 5, 5)]),
    "labelled": ("id bigint, text string, label string", [(1, "Table 1. Costs", "Table 1."), (2, "  Table 1.", "Table 1."), (3, "Table 1.5 x", "Table 1."), (4, "figure 9. other", "Figure 2."), (5, "A plan", "Figure 2."), (6, "(a) left", "(a)")]),
    "fonts_xml": ("doc_id bigint, member string, text string", [(1, "word/document.xml", '<w:rFonts w:ascii="CMR10" w:hAnsi="CMTT8"/><w:rFonts w:cs="Arial"/>'), (1, "word/styles.xml", '<w:rFonts w:ascii="CMR10" w:eastAsia="CMR10"/>'), (1, "docProps/app.xml", '<x w:ascii="CMR10"/>')]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = FIXTURES[name]
    return spark.createDataFrame(rows, ddl)


def _literal(x: object, kind: str) -> str:
    if x is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(_literal(y, "DOUBLE") for y in x) + "]"
    return f"CAST({str(x).lower() if isinstance(x, bool) else repr(x)} AS {kind})"


def values(name: str, alias: str | None = None) -> str:
    """The same rows as a FROM item of DuckDB SQL."""
    ddl, rows = FIXTURES[name]
    cols = [c.split() for c in ddl.split(", ")]
    kinds = ["DOUBLE[]" if k.startswith("array") else {"string": "VARCHAR"}.get(k, k.upper()) for _, k in cols]
    body = ", ".join("(" + ", ".join(_literal(x, k) for x, k in zip(r, kinds)) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias or name}({', '.join(c for c, _ in cols)})"
