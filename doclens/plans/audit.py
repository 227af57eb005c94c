"""Audits of a result against its source, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import tex
from doclens.functions import text as T
from doclens.operators import matching, reconcile
from doclens.sources import files


def page_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, words) of pages (doc_id, page_no, text): lines that are the page's own number are left out."""
    own = (F.col("page_no") + 1).cast("string")
    lines = F.filter(F.split("text", "\n"), lambda x: T.stripped(x) != own)
    return pages.select("doc_id", "page_no", T.words(T.normalized(F.array_join(lines, "\n"))).alias("words"))


def lost_passages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Runs of six words of a page at least that the whole result (doc_id, text) lacks in order."""
    return matching.missing_runs(page_words(pages), results.select("doc_id", T.words(T.normalized(F.col("text"))).alias("words")))


def source_records(sources: DataFrame, which: str) -> DataFrame:
    """tables: (doc_id, ord, number, prefix, caption); figures the same; panels: (doc_id, ord, prefix, caption)."""
    if which == "tables":
        f = lambda t: [(r["number"], None if r["starred"] else f"Table {r['number']}.", r["caption"]) for r in tex.table_records(t)]
    elif which == "figures":
        f = lambda t: [(r["number"], r["prefix"], r["caption"]) for r in tex.figure_records(t)]
    else:
        f = lambda t: [(None, p["prefix"], p["caption"]) for r in tex.figure_records(t) for p in tex.panel_captions(r["float"])]
    return tex.table_of(sources, f, "number int, prefix string, caption string")


#: Findings in the order of a report.
ORDER = (
    "fewer tables", "table caption not found", "table caption incomplete", "caption twice in a paragraph", "fewer images", "figure caption not found", "figure caption incomplete", "panel not found",
    "reference to an undefined label", "citation without an entry", "fewer bibliography paragraphs", "title not in the bibliography", "link missing", "link different",
)


def listed(findings: DataFrame) -> DataFrame:
    """(doc_id, ord, finding, detail): a document's findings as a report lists them: by kind, keys in order of their code points; missing and different links together."""
    kind = F.array_position(F.array(*map(F.lit, ORDER)), F.regexp_replace("finding", "^link different$", "link missing"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy(kind, "detail", "finding"))
    return findings.select("doc_id", ord_.alias("ord"), "finding", "detail")


def audit(sources: DataFrame, elements: DataFrame, entries: DataFrame, shown: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, finding, detail): all findings of a converted document.

    sources: (doc_id, text); elements of the result: (doc_id, ord, kind, text, style, has_drawing); entries: (doc_id, file_no, key,
    title); shown links: (doc_id, ord, anchor, text); expected numbers: (doc_id, key, number).
    """
    paragraphs = elements.filter("kind = 'paragraph'")
    tables, figures, panels = (source_records(sources, k) for k in ("tables", "figures", "panels"))
    bibliography = paragraphs.filter("style = 'Bibliography'")
    cited = files.citation_keys(sources)
    labels = tex.table_of(sources, lambda t: [(k,) for _, k in tex.labels(tex.without_comments(t))], "key string")
    tabulars = tex.table_of(sources, lambda t: tex.environments(t, tex.TABULARS), "start int, stop int")
    pictures = tex.table_of(sources, lambda t: [(p,) for *_, p in tex.images(t)], "path string")
    numbered, drawn = tables.filter("prefix is not null"), elements.filter("has_drawing")

    def named(df: DataFrame, finding: str, detail: str) -> DataFrame:
        return df.select("doc_id", F.lit(finding).alias("finding"), F.col(detail).cast("string").alias("detail"))

    def counted(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.concat(F.lit("fewer "), F.col("what")).alias("finding"), F.format_string("%d of %d", "found", "expected").alias("detail"))

    parts = [
        counted(reconcile.fewer(tabulars, elements.filter("kind = 'table'"), "tables")),
        named(reconcile.without_prefix(numbered, paragraphs), "table caption not found", "prefix"),
        named(reconcile.incomplete_captions(tables, paragraphs), "table caption incomplete", "caption"),
        named(reconcile.doubled_captions(tables, paragraphs), "caption twice in a paragraph", "caption"),
        counted(reconcile.fewer(pictures, drawn, "images")),
        named(reconcile.without_prefix(figures, paragraphs), "figure caption not found", "prefix"),
        named(reconcile.incomplete_captions(figures, paragraphs), "figure caption incomplete", "caption"),
        named(reconcile.missing_panels(panels, paragraphs), "panel not found", "caption"),
        named(reconcile.undefined(files.cross_reference_keys(sources), labels), "reference to an undefined label", "key"),
        named(reconcile.undefined(cited, entries), "citation without an entry", "key"),
        counted(reconcile.fewer(cited, bibliography, "bibliography paragraphs")),
        named(reconcile.absent_titles(cited, entries, bibliography), "title not in the bibliography", "title"),
        reconcile.links(expected, shown).select("doc_id", F.concat(F.lit("link "), F.col("finding")).alias("finding"), F.col("key").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
