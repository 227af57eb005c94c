"""What a result lacks of its source, or shows differently: anti joins, lookups and count comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T


def undefined(used: DataFrame, defined: DataFrame) -> DataFrame:
    """(doc_id, key): distinct keys that are used but not defined, as sets within a document."""
    return used.select("doc_id", "key").distinct().join(defined.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def latest_titles(entries: DataFrame) -> DataFrame:
    """(doc_id, key, title): of a key's entries that of the last file."""
    return entries.groupBy("doc_id", "key").agg(F.max_by("title", "file_no").alias("title"))


def absent_titles(cited: DataFrame, entries: DataFrame, bibliography: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, key, title): cited entries whose normalized title stands in no paragraph of the result's bibliography."""
    known = cited.select("doc_id", "key").distinct().join(latest_titles(entries), ["doc_id", "key"]).withColumn("norm", T.ascii_key(F.col("title"))).filter(F.char_length("norm") >= least)
    shown = bibliography.select(F.col("doc_id").alias("d"), T.ascii_key(F.col("text")).alias("para"))
    return known.join(shown, (F.col("doc_id") == F.col("d")) & F.contains(F.col("para"), F.col("norm")), "left_anti").select("doc_id", "key", "title")


def links(expected: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_id, key, number, text, finding): expected numbers that no link shows, or shows differently; of a key's links the last tells."""
    last = shown.groupBy("doc_id", F.col("anchor").alias("key")).agg(F.max_by("text", "ord").alias("text"))
    both = expected.join(last, ["doc_id", "key"], "left")
    finding = F.when(F.col("text").isNull(), "missing").when(F.col("text") != F.col("number"), "different")
    return both.select("doc_id", "key", "number", "text", finding.alias("finding")).filter("finding is not null")


def restored_links(numbers: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_id, ord, anchor, text, new_text): links with the number of their anchor; without one the text stays, and bracketed stand-ins tell nothing."""
    n = numbers.withColumnRenamed("key", "anchor")
    return shown.join(n, ["doc_id", "anchor"], "left").select("doc_id", "ord", "anchor", "text", F.coalesce("number", "text").alias("new_text"))


def first_shown(shown: DataFrame) -> DataFrame:
    """(doc_id, key, text): the first link text of each anchor that isn't bracketed."""
    plain = shown.filter(~F.col("text").rlike(r"^\s*\[.*\]\s*$"))
    return plain.groupBy("doc_id", F.col("anchor").alias("key")).agg(F.min_by("text", "ord").alias("text"))


def fewer(source: DataFrame, result: DataFrame, what: str) -> DataFrame:
    """(doc_id, what, expected, found): documents whose result has fewer rows than their source."""
    a = source.groupBy("doc_id").agg(F.count("*").alias("expected"))
    b = result.groupBy("doc_id").agg(F.count("*").alias("found"))
    return a.join(b, "doc_id", "left").select("doc_id", F.lit(what).alias("what"), "expected", F.coalesce("found", F.lit(0)).alias("found")).filter("found < expected")


def without_prefix(records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """records (doc_id, prefix, ...) of which no paragraph of the result starts with the prefix."""
    p = paragraphs.select(F.col("doc_id").alias("d"), F.col("text").alias("para"))
    return records.join(p, (F.col("doc_id") == F.col("d")) & F.startswith(T.stripped("para"), F.col("prefix")), "left_anti")


def incomplete_captions(records: DataFrame, paragraphs: DataFrame, chars: int = 7) -> DataFrame:
    """records (doc_id, prefix, caption) whose caption's first normalized characters stand in no paragraph."""
    r = records.withColumn("begin", F.substring(T.ascii_key(T.plain_caption(F.col("caption"))), 1, chars))
    p = paragraphs.select(F.col("doc_id").alias("d"), T.ascii_key(F.col("text")).alias("para"))
    return r.filter("begin <> ''").join(p, (F.col("doc_id") == F.col("d")) & F.contains(F.col("para"), F.col("begin")), "left_anti").select(records.columns)


def doubled_captions(records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, caption): paragraphs that hold a caption more than once."""
    r = records.select(F.col("doc_id").alias("d"), "caption", T.ascii_key(T.plain_caption(F.col("caption"))).alias("norm")).filter("norm <> ''")
    p = paragraphs.withColumn("para", T.ascii_key(F.col("text")))
    times = (F.char_length("para") - F.char_length(F.replace("para", F.col("norm"), F.lit("")))) / F.char_length("norm")
    return p.join(r, (F.col("doc_id") == F.col("d")) & F.contains(F.col("para"), F.col("norm"))).filter(times > 1).select("doc_id", "ord", "caption")


def missing_panels(panels: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """panels (doc_id, prefix, caption) of which no single paragraph has both the label and the caption."""
    p = paragraphs.select(F.col("doc_id").alias("d"), F.col("text").alias("raw"), T.ascii_key(F.col("text")).alias("para"))
    both = F.contains(F.col("raw"), F.col("prefix")) & F.contains(F.col("para"), T.ascii_key(T.plain_caption(F.col("caption"))))
    return panels.join(p, (F.col("doc_id") == F.col("d")) & both, "left_anti")


def unique_messages(messages: DataFrame) -> DataFrame:
    """(run_id, seq, message): first occurrences of messages that aren't blank, without white space at their ends, in order."""
    first = messages.withColumn("message", T.stripped("message")).filter("message <> ''").groupBy("run_id", "message").agg(F.min("seq").alias("first"))
    return first.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("first")) - 1).alias("seq"), "message")


def report(findings: DataFrame, limit: int = 40) -> DataFrame:
    """(doc_id, ord, words): a document's first findings, shortened, and how many more there are."""
    w = Window.partitionBy("doc_id")
    ranked = findings.select("doc_id", "words", F.row_number().over(w.orderBy("page_no", "start")).alias("ord"), F.count("*").over(w).alias("total"))
    own = ranked.filter(F.col("ord") <= limit).select("doc_id", "ord", T.shortened(F.col("words")).alias("words"))
    more = ranked.filter((F.col("ord") == limit) & (F.col("total") > limit)).select("doc_id", (F.col("ord") + 1).alias("ord"), F.format_string("and %d more", F.col("total") - limit).alias("words"))
    return own.unionByName(more)


def status(*findings: DataFrame) -> DataFrame:
    """(status): 1 if any table has a row."""
    ones = reduce(DataFrame.unionByName, [f.select(F.lit(1).alias("status")).limit(1) for f in findings])
    return ones.agg(F.coalesce(F.max("status"), F.lit(0)).alias("status"))
