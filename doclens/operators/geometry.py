"""Positioned blocks: text frames, rules, table and equation regions. Rectangles are four columns x0, y0, x1, y1; a page is the unit of work."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T

PAGE = ("doc_id", "page_no")
RECT = ("x0", "y0", "x1", "y1")
# Fixed values of the layout rules, in points or shares.
RULE_HEIGHT, RULE_WIDTH, SAME_WIDTH, CELL_SLACK, LEAST_HEIGHT = 2.5, 40, 0.9, 2, 6
MATH_SHARE, INDENT, RIGHT_INSET, GAP, WIDE, INSET = 0.25, 24, 2, 12, 0.5, 72


def hull() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def blocks(spans: DataFrame) -> DataFrame:
    """(page, block_no, rect, text, math_share): text blocks and the share of their characters that stand in math fonts."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")
    math = F.sum(F.when(T.is_math_font(T.base_font(F.col("font"))), F.char_length("text")).otherwise(0))
    out = spans.groupBy(*PAGE, "block_no").agg(*hull(), ordered.alias("text"), math.alias("math"))
    return out.select(*PAGE, "block_no", *RECT, "text", F.coalesce(F.col("math") / F.nullif(F.char_length(T.stripped(F.col("text"))), F.lit(0)), F.lit(0.0)).alias("math_share"))


def rules(drawings: DataFrame) -> DataFrame:
    """Flat, long drawings."""
    return drawings.filter((F.col("y1") - F.col("y0") <= RULE_HEIGHT) & (F.col("x1") - F.col("x0") >= RULE_WIDTH))


def text_frame(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, frame_left, frame_right): over blocks wider than half the page; else an inset of the page."""
    size = pages.select(*PAGE, F.col("x0").alias("px0"), F.col("x1").alias("px1"))
    wide = F.col("x1") - F.col("x0") > WIDE * (F.col("px1") - F.col("px0"))
    return (
        size.join(blocks, [*PAGE], "left")
        .groupBy(*PAGE, "px0", "px1")
        .agg(F.min(F.when(wide, F.col("x0"))).alias("l"), F.max(F.when(wide, F.col("x1"))).alias("r"))
        .select(*PAGE, F.coalesce("l", F.col("px0") + INSET).alias("frame_left"), F.coalesce("r", F.col("px1") - INSET).alias("frame_right"))
    )


def caption_between(gaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """gaps (page, gap_no, top, bottom) that hold a caption block wholly: a range semi join within the page."""
    c = blocks.filter(T.is_caption(F.col("text"))).select(*PAGE, F.col("y0").alias("cy0"), F.col("y1").alias("cy1"))
    return gaps.join(c, [gaps[k] == c[k] for k in PAGE] + [F.col("cy0") >= F.col("top"), F.col("cy1") <= F.col("bottom")], "left_semi")


def same_width(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two x-ranges overlap by 90 % of the narrower at least."""
    over = F.least(a1, b1) - F.greatest(a0, b0)
    return (over > 0) & (over >= SAME_WIDTH * F.least(a1 - a0, b1 - b0))


def rule_groups(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, group_no, rect): hulls of rules that belong to one table.

    A rule opens a new group if a caption stands between it and the last rule of the group, or if its width doesn't fit the
    widest of the group so far. The latter is state since the group's start, so a page is scanned in order.
    """

    def scan(key, r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["is_caption"]]
        rows: list[list] = []
        for x in r.sort_values(["y0", "x0", "x1", "y1"]).itertuples():
            if rows:
                g = rows[-1]
                over = min(g[4][1], x.x1) - max(g[4][0], x.x0)
                fits = over > 0 and over >= SAME_WIDTH * min(g[4][1] - g[4][0], x.x1 - x.x0)
                if fits and not ((b["y0"] >= g[5]) & (b["y1"] <= x.y0)).any():
                    g[:4] = min(g[0], x.x0), min(g[1], x.y0), max(g[2], x.x1), max(g[3], x.y1)
                    g[4], g[5] = max(g[4], (x.x0, x.x1), key=lambda w: w[1] - w[0]), x.y1
                    continue
            rows.append([x.x0, x.y0, x.x1, x.y1, (x.x0, x.x1), x.y1])
        return pd.DataFrame([(*key, i, *g[:4]) for i, g in enumerate(rows)], columns=[*PAGE, "group_no", *RECT])

    flagged = blocks.select(*PAGE, "y0", "y1", T.is_caption(F.col("text")).alias("is_caption"))
    schema = "doc_id long, page_no int, group_no int, x0 double, y0 double, x1 double, y1 double"
    return rules.groupBy(*PAGE).cogroup(flagged.groupBy(*PAGE)).applyInPandas(scan, schema)


def tables(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, group_no, rect): a group's hull with the blocks between its rules (by y alone); without blocks, or lower than 6, it is none."""
    b = blocks.filter(T.stripped(F.col("text")) != "").select(*PAGE, *(F.col(c).alias(f"b{c}") for c in RECT))
    inside = (F.col("by0") >= F.col("y0") - CELL_SLACK) & (F.col("by1") <= F.col("y1") + CELL_SLACK)
    return (
        groups.join(b, [*PAGE])
        .filter(inside)
        .groupBy(*PAGE, "group_no")
        .agg(*(F.least(F.min(c), F.min(f"b{c}")).alias(c) for c in ("x0", "y0")), *(F.greatest(F.max(c), F.max(f"b{c}")).alias(c) for c in ("x1", "y1")))
        .filter(F.col("y1") - F.col("y0") >= LEAST_HEIGHT)
        .select(*PAGE, "group_no", *RECT)
    )


def set_apart(blocks: DataFrame, frame: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks indented from the frame that cut no table region."""
    t = tables.select(*(F.col(c).alias(f"t{c}") for c in (*PAGE, *RECT)))
    own = blocks.join(frame, [*PAGE]).filter((F.col("x0") >= F.col("frame_left") + INDENT) & (F.col("x1") <= F.col("frame_right") - RIGHT_INSET)).drop("frame_left", "frame_right")
    cuts = (F.col("tx0") < F.col("x1")) & (F.col("x0") < F.col("tx1")) & (F.col("ty0") < F.col("y1")) & (F.col("y0") < F.col("ty1"))
    return own.join(t, (F.col("doc_id") == F.col("tdoc_id")) & (F.col("page_no") == F.col("tpage_no")) & cuts, "left_anti")


def islands(rows: DataFrame, keys: tuple[str, ...], low: str, high: str, gap: float, inclusive: bool, bucket: float | None = None) -> DataFrame:
    """The rows with `island`, counted within a key: a new one begins where the gap to all before is too wide.

    bucket: the width of ranges of `low` that are scanned apart, so that no key is one task's; what reaches over from earlier ranges and
    the number of islands that began there are carried on in a scan over the ranges.
    """
    if bucket is None:
        rows, part = rows.withColumn("_bucket", F.lit(0)), (*keys,)
    else:
        rows, part = rows.withColumn("_bucket", F.floor(F.col(low) / bucket)), (*keys, "_bucket")
    w = Window.partitionBy(*part).orderBy(low, high)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max(high).over(before))

    def carried(df: DataFrame, total: Column, name: str, scan: Callable[[str], Column]) -> DataFrame:
        if bucket is None:
            return df.withColumn(name, F.lit(None))
        own = [f"_key{i}" for i, _ in enumerate(part)]
        sums = df.groupBy(*part).agg(total.alias("_t")).select(*(F.col(k).alias(n) for k, n in zip(part, own)), scan("_t").over(earlier).alias(name))
        return df.join(sums, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(part, own)]).drop(*own)

    rows = carried(rows, F.max(high), "_from", F.max)
    reach = F.greatest("_reach", F.col("_from").cast("double")) + gap
    new = F.when(F.col(low) <= reach, 0).otherwise(1) if inclusive else F.when(F.col(low) < reach, 0).otherwise(1)
    rows = carried(rows.withColumn("_new", new), F.sum("_new"), "_begun", F.sum)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col("_begun").cast("long"), F.lit(0))
    return rows.withColumn("island", island).drop("_bucket", "_reach", "_from", "_new", "_begun")


def equations(candidates: DataFrame) -> DataFrame:
    """(page, rect): set-apart blocks around seeds (a quarter of math).

    Growing seeds until nothing is near makes islands by a strict gap that hold a seed; these are then merged by an inclusive gap, and low ones dropped.
    """
    grown = islands(candidates, PAGE, "y0", "y1", GAP, False)
    hulls = grown.groupBy(*PAGE, "island").agg(*hull(), F.bool_or(F.col("math_share") >= MATH_SHARE).alias("seeded")).filter("seeded").drop("island")
    merged = islands(hulls, PAGE, "y0", "y1", GAP, True)
    return merged.groupBy(*PAGE, "island").agg(*hull()).filter(F.col("y1") - F.col("y0") >= LEAST_HEIGHT).select(*PAGE, *RECT)


def regions(tables: DataFrame, equations: DataFrame) -> DataFrame:
    """(page, region_no, kind, rect): both kinds, from the top of the page."""
    both = tables.select(*PAGE, F.lit("table").alias("kind"), *RECT).unionByName(equations.select(*PAGE, F.lit("equation").alias("kind"), *RECT))
    return both.withColumn("region_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "kind", "x0")) - 1)


def find_regions(spans: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """All steps: from spans, drawings and page sizes to regions."""
    b = blocks(spans)
    t = tables(rule_groups(rules(drawings), b), b)
    return regions(t, equations(set_apart(b, text_frame(b, pages), t)))


def deliberate_breaks(page_boxes: DataFrame, openings: DataFrame, slack: float = 90) -> DataFrame:
    """(doc_id, page_no): pages whose break is kept: those that end more than `slack` above the document's lowest end, and those before a page that opens with a heading.

    page_boxes: (doc_id, page_no, y1), null for an empty page; openings: (doc_id, page_no, opening).
    """
    bottoms = page_boxes.groupBy(*PAGE).agg(F.coalesce(F.max("y1"), F.lit(0.0)).alias("bottom"))
    deepest = bottoms.groupBy("doc_id").agg(F.max("bottom").alias("deepest"))  # merged before it is sent, however many pages a document has
    short = bottoms.join(deepest, "doc_id").filter(F.col("bottom") < F.col("deepest") - slack).select(*PAGE)
    before = openings.filter((F.col("page_no") > 0) & T.is_heading(F.col("opening"))).select("doc_id", (F.col("page_no") - 1).alias("page_no"))
    return short.unionByName(before).distinct()
