"""Numbers of captions, panels and headings, what labels stand for, and how captions keep with what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T


def running(flag: Column, keys: tuple[str, ...], *order: str) -> Column:
    """How often the flag held up to here."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def caption_numbers(captions: DataFrame) -> DataFrame:
    """captions: (doc_id, kind, float_no, pos, starred, caption, label) with number and prefix.

    Tables and figures are numbered on through the document, panels lettered within their figure; starred captions have neither.
    """
    flat = captions.filter("kind <> 'panel'").withColumn("number", F.when(~F.col("starred"), running(~F.col("starred"), ("doc_id", "kind"), "pos")))
    flat = flat.withColumn("prefix", F.concat(F.initcap("kind"), F.lit(" "), F.col("number"), F.lit(".")))
    inner = captions.filter("kind = 'panel'").withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "float_no").orderBy("pos")).cast("bigint"))
    inner = inner.withColumn("prefix", F.concat(F.lit("("), F.char(F.lit(96) + F.col("number")), F.lit(")")))
    return flat.unionByName(inner)


def heading_prefixes(headings: DataFrame) -> DataFrame:
    """headings after the appendix switch: (doc_id, ord, level, starred, title, label) with prefix.

    An unstarred level 1 advances the letter; level k counts within its parents; starred headings and those before any letter have none.
    """
    counts = ~F.col("starred")
    a = headings.withColumn("n1", running(counts & (F.col("level") == 1), ("doc_id",), "ord"))
    b = a.withColumn("n2", running(counts & (F.col("level") == 2), ("doc_id", "n1"), "ord"))
    c = b.withColumn("n3", running(counts & (F.col("level") == 3), ("doc_id", "n1", "n2"), "ord"))
    letter = T.appendix_letter(F.col("n1"))
    prefix = (
        F.when(~counts | (F.col("n1") == 0), None)
        .when(F.col("level") == 1, F.concat(F.lit("Appendix "), letter))
        .when(F.col("level") == 2, F.concat_ws(".", letter, F.col("n2").cast("string")))
        .otherwise(F.concat_ws(".", letter, F.col("n2").cast("string"), F.col("n3").cast("string")))
    )
    return c.select(*headings.columns, prefix.alias("prefix"))


def heading_labels(prefixed: DataFrame) -> DataFrame:
    """(doc_id, key, number)."""
    return prefixed.filter("label is not null and prefix is not null").select("doc_id", F.col("label").alias("key"), F.regexp_replace("prefix", "^Appendix ", "").alias("number"))


def label_aliases(labels: DataFrame) -> DataFrame:
    """(doc_id, key, first): later labels of a heading and the first, from (doc_id, ord, labels array)."""
    each = labels.select("doc_id", F.element_at("labels", 1).alias("first"), F.posexplode("labels").alias("k", "key"))
    return each.filter("k > 0").select("doc_id", "key", "first")


def figure_labels(captions: DataFrame, panels: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, number): a label's panel ("1a") or else its figure ("1").

    captions: numbered figures (doc_id, float_no, number); panels: (doc_id, fig_no, panel_no, start, stop); labels: (doc_id, float_no, pos, key).
    """
    lettered = panels.withColumn("letter", F.char(F.lit(96) + F.row_number().over(Window.partitionBy("doc_id", "fig_no").orderBy("start"))))
    inside = (F.col("l.doc_id") == F.col("p.doc_id")) & (F.col("l.float_no") == F.col("p.fig_no")) & F.col("pos").between(F.col("start"), F.col("stop"))
    placed = labels.alias("l").join(lettered.alias("p"), inside, "left").groupBy("l.doc_id", "l.float_no", "l.pos", "key").agg(F.max_by("letter", "start").alias("letter"))
    numbers = captions.filter("kind = 'figure' and number is not null").select("doc_id", "float_no", "number")
    return placed.join(numbers, ["doc_id", "float_no"]).select("doc_id", "key", F.concat(F.col("number").cast("string"), F.coalesce("letter", F.lit(""))).alias("number"))


def table_labels(numbered: DataFrame) -> DataFrame:
    """(doc_id, key, number): labels of unstarred table floats; the last record of a key tells."""
    return numbered.filter("kind = 'table' and number is not null and label is not null").groupBy("doc_id", F.col("label").alias("key")).agg(F.max_by(F.col("number").cast("string"), "pos").alias("number"))


def overlaid(tables: DataFrame, figures: DataFrame, appendix: DataFrame, aliases: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, number): tables over figures over appendix; an alias that has none takes its first label's, or the text that is shown there."""
    ranked = (
        appendix.select("doc_id", "key", "number", F.lit(1).alias("p"))
        .unionByName(figures.select("doc_id", "key", "number", F.lit(2).alias("p")))
        .unionByName(tables.select("doc_id", "key", "number", F.lit(3).alias("p")))
    )
    best = ranked.groupBy("doc_id", "key").agg(F.max_by("number", "p").alias("number"))
    if aliases is None:
        return best
    gaps = aliases.join(best, ["doc_id", "key"], "left_anti").join(best.select("doc_id", F.col("key").alias("first"), "number"), ["doc_id", "first"], "left")
    if shown is not None:
        gaps = gaps.join(shown.select("doc_id", F.col("key").alias("first"), "text"), ["doc_id", "first"], "left").withColumn("number", F.coalesce("number", "text"))
    return best.unionByName(gaps.filter("number is not null").select("doc_id", "key", "number"))


def keep_with_next(elements: DataFrame) -> DataFrame:
    """(doc_id, ord): a table caption and each paragraph up to the next table or caption."""
    table_caption = (F.col("kind") == "paragraph") & F.col("text").rlike(r"(?i)^\s*table\s+\d+\s*[.:]")
    e = elements.withColumn("starts", table_caption).withColumn("run", running(F.col("starts"), ("doc_id",), "ord")).withColumn("is_table", F.col("kind") == "table")
    e = e.withColumn("tables", running(F.col("is_table"), ("doc_id", "run"), "ord"))
    return e.filter("run > 0 and tables = 0 and kind = 'paragraph'").select("doc_id", "ord")


def tables_after_captions(elements: DataFrame) -> DataFrame:
    """(doc_id, caption_no, k, ord): the tables without drawings between a table caption and the next, counted."""
    table_caption = (F.col("kind") == "paragraph") & F.col("text").rlike(r"(?i)^\s*table\s+\d+\s*[.:]")
    e = elements.withColumn("caption_no", running(table_caption, ("doc_id",), "ord")).filter("caption_no > 0 and kind = 'table' and not has_drawing")
    return e.select("doc_id", "caption_no", F.row_number().over(Window.partitionBy("doc_id", "caption_no").orderBy("ord")).alias("k"), "ord")


def zipped(a: DataFrame, a_order: str, b: DataFrame, b_order: str) -> DataFrame:
    """The n-th row of a document's a with the n-th of its b: (doc_id, k, a_order, b_order), to the shorter's end."""
    rank = lambda o: F.row_number().over(Window.partitionBy("doc_id").orderBy(o)).alias("k")
    x = a.select("doc_id", F.col(a_order).alias("left"), F.row_number().over(Window.partitionBy("doc_id").orderBy(a_order)).alias("k"))
    y = b.select("doc_id", F.col(b_order).alias("right"), rank(b_order))
    return x.join(y, ["doc_id", "k"])


def stacked_figures(panels: DataFrame, tables: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, fig_no, ord): figures whose panels are set one above the other: the n-th figure with panels stands in the n-th figure table, which has one row and a filled cell
    for each of its panels, two at least, all of known width and `least` of a line wide.

    panels: (doc_id, fig_no, ratio); tables: (doc_id, ord, rows, cells), cells with content.
    """
    figures = panels.groupBy("doc_id", "fig_no").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("ratio") >= least, F.lit(False))).alias("wide"))
    both = zipped(figures, "fig_no", tables, "ord").select("doc_id", F.col("left").alias("fig_no"), F.col("right").alias("ord"))
    told = both.join(figures, ["doc_id", "fig_no"]).join(tables.select("doc_id", "ord", "rows", "cells"), ["doc_id", "ord"])
    return told.filter("n >= 2 and wide and rows = 1 and cells = n").select("doc_id", "fig_no", "ord")


def resized_images(widths: DataFrame, source_images: DataFrame, shapes: DataFrame, text_width: Column) -> DataFrame:
    """(doc_id, image_no, width, height): new sizes of images, aspect kept, of documents that have as many shapes as their source has images.

    widths: (doc_id, image_no, ratio); source_images: (doc_id, ...), one row each; shapes: (doc_id, image_no, width, height).
    """
    count = lambda d, n: d.groupBy("doc_id").agg(F.count("*").alias(n))
    equal = count(source_images, "a").join(count(shapes, "b"), "doc_id").filter("a = b").select("doc_id")
    new = F.round(F.col("ratio") * text_width)
    both = shapes.join(widths, ["doc_id", "image_no"]).join(equal, "doc_id", "left_semi")
    return both.select("doc_id", "image_no", new.cast("long").alias("width"), F.bround(F.col("height") * new / F.col("width")).cast("long").alias("height"))


def insertion_points(missing: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, number, ord): the first caption of a greater number, null at the end. missing: (doc_id, number); captions: (doc_id, number, ord)."""
    c = captions.select("doc_id", F.col("number").alias("other"), "ord")
    return missing.join(c, (missing["doc_id"] == c["doc_id"]) & (F.col("other") > F.col("number")), "left").groupBy(missing["doc_id"], "number").agg(F.min("ord").alias("ord"))


def image_widths(images: DataFrame, panels: DataFrame) -> DataFrame:
    """(doc_id, image_no, ratio): images of full line width in a panel of half a line at least; the innermost panel tells."""
    numbered = images.withColumn("image_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    wide = panels.filter("ratio >= 0.5").select(F.col("doc_id").alias("d"), "start", "stop", "ratio")
    return numbered.filter("full_width").join(wide, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("pos")) & (F.col("pos") < F.col("stop"))).groupBy("doc_id", "image_no").agg(F.max_by("ratio", "start").alias("ratio"))
