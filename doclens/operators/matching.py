"""Similarity joins between elements and regions, alignments, and matches that keep order."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T

# Fixed values of the similarity rules.
ANCHOR, COVER, TABLE_COVER, INTERIOR, TABLE_INTERIOR, SHORT_TARGET = 6, 0.75, 0.5, 0.6, 0.5, 60
RUN, ROW_SHARE, CELL_COVER, CAPTION_RATIO, TABLE_SOURCE, TABLE_RESULT, CELL = 6, (2, 3), 0.9, 0.45, 0.35, 0.55, 4
INNER = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def matched(a, b, junk: bool = False) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=junk).get_matching_blocks())


def cover(key: str, target: str) -> float:
    """How much of the shorter of two texts without spaces the other holds, in order; for short targets also their shared characters over the longer."""
    if len(key) < ANCHOR or not target:
        return 0.0
    if key in target:
        return 1.0
    best = matched(key, target) / min(len(key), len(target))
    if len(target) <= SHORT_TARGET:
        best = max(best, sum((Counter(key) & Counter(target)).values()) / max(len(key), len(target)))
    return best


def word_cover(text: str, target: str) -> float:
    """The same by whole words; by characters if one side has none."""
    a, b = ([w.casefold() for w in INNER.findall(x)] for x in (text, target))
    if not a or not b:
        return cover("".join(text.split()), "".join(target.split()))
    return matched(a, b) / min(len(a), len(b))


def _element_cover(kind: pd.Series, text: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([cover("".join((t or "").split()), "".join((g or "").split())) if k == "table" else word_cover(t or "", g or "") for k, t, g in zip(kind, text, target)], dtype=float)


def element_cover(kind: Column | str, text: Column | str, target: Column | str) -> Column:
    """Paragraphs are compared by words, tables by characters."""
    return F.pandas_udf(_element_cover, "double")(kind, text, target)


def bag_bound(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, shared, shorter, longer): characters that two texts `a` and `b` share as bags. shared / shorter bounds any alignment from above."""
    chars = lambda c: F.explode(F.filter(F.split(c, ""), lambda x: x != "")).alias("ch")
    na = pairs.select(*keys, chars("a")).groupBy(*keys, "ch").agg(F.count("*").alias("na"))
    nb = pairs.select(*keys, chars("b")).groupBy(*keys, "ch").agg(F.count("*").alias("nb"))
    shared = na.join(nb, [*keys, "ch"]).groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("shared"))
    sizes = pairs.select(*keys, F.least(F.char_length("a"), F.char_length("b")).alias("shorter"), F.greatest(F.char_length("a"), F.char_length("b")).alias("longer"))
    return sizes.join(shared, [*keys], "left").fillna(0, ["shared"])


def assign(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_no, ord, how): elements that belong to a region of their page.

    Each element but captions belongs to the region that it covers best, strictly above a bar; the earlier of equals. Then
    unowned elements between a region's first and last join it if they are short or cover it to a lower bar.
    elements: (doc_id, page_no, ord, kind, text); regions: (doc_id, page_no, region_no, text).
    """
    page = ["doc_id", "page_no"]
    e = elements.filter(~T.is_caption(F.col("text")))
    r = regions.select(*page, "region_no", F.col("text").alias("target"))
    # The alignments are costly: both readers below take them from this one exchange, which also serves their windows and joins.
    scored = e.join(r, page).withColumn("score", element_cover("kind", "text", "target")).repartition(*page)
    bar = F.when(F.col("kind") == "table", TABLE_COVER).otherwise(COVER)
    rank = Window.partitionBy(*page, "ord").orderBy(F.desc("score"), "region_no")
    owned = scored.filter(F.col("score") > bar).withColumn("rank", F.row_number().over(rank)).filter("rank = 1").select(*page, "region_no", "ord", F.lit("owned").alias("how"))
    spans = owned.groupBy(*page, "region_no").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    free = scored.join(owned.select(*page, "ord"), [*page, "ord"], "left_anti").join(spans, [*page, "region_no"]).filter("ord > first and ord < last")
    low = F.when(F.col("kind") == "table", TABLE_INTERIOR).otherwise(INTERIOR)
    inner = free.filter((F.char_length(T.no_space(F.coalesce("text", F.lit("")))) < ANCHOR) | (F.col("score") >= low))
    return owned.unionByName(inner.select(*page, "region_no", "ord", F.lit("inside").alias("how")))


def replacements(assigned: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_no, first, n, turn): what replaces each region, the place of its first element and how many there are; later places are replaced first, regions without any (first null) as if at place 0.

    assigned: as `assign` gives it; regions: (doc_id, page_no, region_no).
    """
    key = ["doc_id", "page_no", "region_no"]
    own = assigned.groupBy(*key).agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.desc(F.coalesce("first", F.lit(0))), "region_no"))
    return regions.select(*key).join(own, key, "left").select(*key, "first", F.coalesce("n", F.lit(0)).alias("n"), turn.alias("turn"))


def replaced(replacements: DataFrame) -> DataFrame:
    """(doc_id, replaced, missed): regions with and without an element."""
    return replacements.groupBy("doc_id").agg(F.count_if(F.col("n") > 0).alias("replaced"), F.count_if(F.col("n") == 0).alias("missed"))


def missing_runs(pages: DataFrame, results: DataFrame, least: int = RUN) -> DataFrame:
    """(doc_id, page_no, start, n, words): runs of a page's words that the alignment with the result's words leaves out.

    pages: (doc_id, page_no, words array), short pages are passed over; results: (doc_id, words array). Pages that stand in the result as they are
    need no alignment. A document is one group: its result is sent and indexed once, however many pages it has.
    """

    def run(key, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out, m = [], SequenceMatcher(None, autojunk=False)
        m.set_seq2([w for x in r["words"] if x is not None for w in x])
        for page, words in zip(p["page_no"], p["words"]):
            a = list(words)
            m.set_seq1(a)
            out += [(*key, page, i, j - i, " ".join(a[i:j])) for tag, i, j, *_ in m.get_opcodes() if tag in ("delete", "replace") and j - i >= least]
        return pd.DataFrame(out, columns=["doc_id", "page_no", "start", "n", "words"])

    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    long = pages.filter(F.size("words") >= least).select("doc_id", "page_no", "words")
    whole = results.select(F.col("doc_id").alias("d"), F.col("words").alias("there"))
    open_ = long.join(whole, (F.col("doc_id") == F.col("d")) & F.contains(line("there"), line("words")), "left_anti")
    there = results.select("doc_id", "words").join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    return open_.groupBy("doc_id").cogroup(there.groupBy("doc_id")).applyInPandas(run, "doc_id long, page_no int, start int, n int, words string")


def missing_grams(pages: DataFrame, results: DataFrame, n: int = RUN) -> DataFrame:
    """(doc_id, page_no, gram): runs of n words of a page that stand nowhere in the result, in any order of passages. Not the same as missing_runs."""
    grams = lambda w: F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).alias("gram")
    own = pages.filter(F.size("words") >= n).select("doc_id", "page_no", grams(F.col("words"))).distinct()
    there = results.filter(F.size("words") >= n).select("doc_id", grams(F.col("words"))).distinct()
    return own.join(there, ["doc_id", "gram"], "left_anti").select("doc_id", "page_no", "gram")


def cropped_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, drop): rows of which two thirds of the telling cells stand in the cropped target.

    rows: (doc_id, table_no, row_no, cell_no, text, target).
    """
    key, number = T.no_space(F.coalesce("text", F.lit(""))), F.col("key").rlike(r"^[\d.,%+-]+$")
    near = F.pandas_udf(lambda k, t: pd.Series([cover(a, b) for a, b in zip(k, t)], dtype=float), "double")
    cells = rows.select("doc_id", "table_no", "row_no", key.alias("key"), T.no_space(F.coalesce("target", F.lit(""))).alias("goal"))
    cells = cells.withColumn("telling", (F.char_length("key") >= 3) | ((F.char_length("key") >= 2) & number))
    # The alignment is asked only where the cell isn't simply contained.
    cells = cells.withColumn("hit", F.col("telling") & (F.contains(F.col("goal"), F.col("key")) | (near("key", "goal") >= CELL_COVER)))
    out = cells.groupBy("doc_id", "table_no", "row_no").agg(F.count_if("telling").alias("n"), F.count_if("hit").alias("m"))
    return out.select("doc_id", "table_no", "row_no", ((F.col("n") > 0) & (ROW_SHARE[1] * F.col("m") >= ROW_SHARE[0] * F.col("n"))).alias("drop"))


def table_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, side, table_no, dimensions, has_drawing, keys): normalized texts of four characters at least, as a set."""
    key = T.ascii_key(F.coalesce("text", F.lit("")))
    return cells.groupBy("doc_id", "side", "table_no").agg(
        (F.max("row_no") + 1).alias("rows"), (F.max("cell_no") + 1).alias("columns"), F.bool_or("has_drawing").alias("has_drawing"), F.collect_set(F.when(F.char_length(key) >= CELL, key)).alias("keys")
    )


def missing_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no): source tables that no result table matches in dimensions and shared cells. One result may stand for many."""
    t = table_cells(cells)
    s = t.filter("side = 'source'").alias("s")
    r = t.filter("side = 'result' and not has_drawing").alias("r")
    shared = F.size(F.array_intersect("s.keys", "r.keys"))
    same = (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.rows") == F.col("r.rows")) & (F.col("s.columns") == F.col("r.columns"))
    enough = (shared / F.size("s.keys") >= TABLE_SOURCE) & (shared / F.size("r.keys") >= TABLE_RESULT) & (shared > 0)
    return s.join(r, same & enough, "left_anti").select("doc_id", "table_no")


def largest_table(cells: DataFrame) -> DataFrame:
    """(doc_id, side, table_no, area): most rows times columns, the earliest of equals."""
    t = table_cells(cells).withColumn("area", F.col("rows") * F.col("columns"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy(F.desc("area"), "table_no"))).filter("k = 1").select("doc_id", "side", "table_no", "area")


def match_in_order(records: DataFrame, paragraphs: DataFrame, by_level: bool = False) -> DataFrame:
    """(doc_id, record_no, ord, ratio): each record's best paragraph after the last one taken.

    Records and paragraphs of equal number are paired as they stand (not by level). Records without words are
    passed over; a best ratio below 0.45 takes nothing and leaves the place.
    records: (doc_id, record_no, text[, level]); paragraphs: (doc_id, ord, text[, level]). State runs through a document, which is one group.
    """

    def run(key, r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        r, p = r.sort_values("record_no"), p.sort_values("ord")
        if not by_level and len(r) == len(p):
            out = [(*key, int(a), int(b), None) for a, b in zip(r["record_no"], p["ord"])]
        else:
            rows = list(p.itertuples())
            for x in r.itertuples():
                if not x.text:
                    continue
                options = [(i, SequenceMatcher(None, x.text, y.text).ratio()) for i, y in enumerate(rows) if i >= at and (not by_level or y.level == x.level)]
                if not options:
                    if by_level:
                        continue
                    break
                i, ratio = max(options, key=lambda o: o[1])
                if ratio >= CAPTION_RATIO:
                    out.append((*key, int(x.record_no), int(rows[i].ord), ratio))
                    at = i + 1
        return pd.DataFrame(out, columns=["doc_id", "record_no", "ord", "ratio"])

    level = ["level"] if by_level else []
    keyed = lambda d, n: d.select("doc_id", n, T.ascii_key(F.coalesce("text", F.lit(""))).alias("text"), *level)
    return keyed(records, "record_no").groupBy("doc_id").cogroup(keyed(paragraphs, "ord").groupBy("doc_id")).applyInPandas(run, "doc_id long, record_no int, ord int, ratio double")


def first_unused(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(doc_id, record_no, table_no): each width list takes the first nested table of as many columns that none took before.

    Equal column counts are taken in order, so the n-th list of a count gets the n-th table of it: a join by rank, no state.
    """
    w = lambda o: F.row_number().over(Window.partitionBy("doc_id", "columns").orderBy(o))
    return wanted.withColumn("k", w("record_no")).join(offered.withColumn("k", w("table_no")), ["doc_id", "columns", "k"]).select("doc_id", "record_no", "table_no")
