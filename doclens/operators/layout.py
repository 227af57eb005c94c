"""Decisions about paragraphs of a result: what is dropped, justified, held together, clamped and scaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T


def justification(text: Column, justified: Column, has_break: Column, least: int = 90) -> Column:
    """relax, justify or keep: short paragraphs and those with a break are set left, others justified."""
    short = (F.char_length(text) < least) | has_break
    return F.when(short & justified & (T.stripped(text) != ""), "relax").when(~short & ~justified, "justify").otherwise("keep")


def droppable_blanks(elements: DataFrame) -> DataFrame:
    """(doc_id, ord): paragraphs without text, drawing and break between two elements. The original neighbours decide, as removals never change them."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    e = elements.select("*", F.lag("kind").over(w).alias("before"), F.lead("kind").over(w).alias("after"))
    solid = lambda c: F.coalesce(F.col(c).isin("paragraph", "table"), F.lit(False))
    return e.filter((F.col("kind") == "paragraph") & (T.stripped(F.col("text")) == "") & ~F.col("has_drawing") & ~F.col("has_break") & ~F.col("is_section_end") & solid("before") & solid("after")).select("doc_id", "ord")


def page_number_paragraphs(elements: DataFrame) -> DataFrame:
    """(doc_id, ord): paragraphs of one to four digits that end a section, looking past blank paragraphs without a section mark."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    blank = (F.col("kind") == "paragraph") & (T.stripped(F.col("text")) == "") & ~F.col("has_drawing")
    passed = blank & ~F.col("is_section_end")
    nxt = F.first(F.when(~passed, F.struct(F.col("kind").alias("kind"), (blank & F.col("is_section_end")).alias("blank_end"))), ignorenulls=True).over(w)
    e = elements.withColumn("nxt", nxt)
    ends = F.col("is_section_end") | F.col("nxt").isNull() | (F.col("nxt.kind") == "section") | F.col("nxt.blank_end")
    return e.filter((F.col("kind") == "paragraph") & T.stripped(F.col("text")).rlike(r"^\d{1,4}$") & ends).select("doc_id", "ord")


def kept_breaks(sections: DataFrame, keep: DataFrame) -> DataFrame:
    """sections (doc_id, page_no) with `kept`: whether the page's number is among those to keep."""
    k = keep.select("doc_id", "page_no", F.lit(True).alias("k")).distinct()
    return sections.join(k, ["doc_id", "page_no"], "left").withColumn("kept", F.coalesce("k", F.lit(False))).drop("k")


def figure_flags(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, hold, keep_next): pictures, panel captions and captions hold together; the first two keep with what follows."""
    picture, panel, caption = F.col("has_drawing") & (F.col("kind") == "paragraph"), T.is_panel_caption(F.col("text")), T.is_caption(F.col("text"))
    return elements.filter("kind = 'paragraph'").select("doc_id", "ord", (picture | panel | caption).alias("hold"), (picture | panel).alias("keep_next")).filter("hold")


def summary(elements: DataFrame) -> DataFrame:
    """One row per document of named counts."""
    e = elements
    numbers = page_number_paragraphs(e).groupBy("doc_id").agg(F.count("*").alias("page_numbers"))
    blanks = droppable_blanks(e).groupBy("doc_id").agg(F.count("*").alias("blanks"))
    held = figure_flags(e).groupBy("doc_id").agg(F.count("*").alias("held"))
    base = e.groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("has_drawing")).alias("drawings"))
    out = base.join(numbers, "doc_id", "left").join(blanks, "doc_id", "left").join(held, "doc_id", "left")
    return out.fillna(0)


def counters(**rows: DataFrame) -> DataFrame:
    """(doc_id, one count for each name): how many rows of each table a document has, zero where it has none."""
    tagged = [df.select("doc_id", F.lit(name).alias("what")) for name, df in rows.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("doc_id").agg(*(F.count_if(F.col("what") == name).alias(name) for name in rows))


def cell_widths(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cell_no, twips): a cell's width is the sum of the columns that it spans.

    grid: (doc_id, table_no, widths array<double> in inches); cells: (doc_id, table_no, row_no, cell_no, grid_span).
    """
    at = F.sum("grid_span").over(Window.partitionBy("doc_id", "table_no", "row_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("grid_span")
    w = F.aggregate(F.slice("widths", F.col("at") + 1, F.col("grid_span")), F.lit(0), lambda a, x: a + T.twips(x))
    return cells.withColumn("at", at.cast("int")).join(grid, ["doc_id", "table_no"]).select("doc_id", "table_no", "row_no", "cell_no", w.alias("twips"))


def scaled_grid(widths: Column, available: Column) -> Column:
    """Twips scaled down to the available width; the last column takes what rounding leaves."""
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w)
    head = F.transform(F.slice(widths, 1, F.size(widths) - 1), lambda w: F.greatest(F.bround(w * available / total).cast("int"), F.lit(1)))
    last = available - F.aggregate(head, F.lit(0), lambda a, w: a + w)
    return F.when((total <= available) | (F.size(widths) == 0), widths).otherwise(F.concat(head, F.array(F.greatest(last.cast("int"), F.lit(1)))))


def cell_padding(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


def page_groups(elements: DataFrame, pages: int) -> DataFrame:
    """elements with page_no: the next page begins after a paragraph that is the expected page number; what is left joins the last page.

    The expected number advances only on a hit, so paragraphs that repeat a number say nothing; a fold over the document's few number paragraphs finds the hits.
    """
    number = F.when((F.col("kind") == "paragraph") & T.stripped(F.col("text")).rlike(r"^\d{1,9}$"), F.struct(F.col("ord").alias("ord"), T.stripped(F.col("text")).cast("int").alias("n")))
    start = F.struct(F.lit(1).alias("want"), F.expr("cast(array() as array<int>)").alias("ends"))
    step = lambda a, x: F.when((x["n"] == a["want"]) & (a["want"] <= pages), F.struct((a["want"] + 1).alias("want"), F.concat(a["ends"], F.array(x["ord"])).alias("ends"))).otherwise(a)
    hits = elements.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(number)), start, step, lambda a: a["ends"]).alias("ends"))
    page = F.least(F.size(F.filter("ends", lambda e: e < F.col("ord"))), F.lit(pages - 1))
    return elements.drop("page_no").join(hits, "doc_id").withColumn("page_no", page).drop("ends")
