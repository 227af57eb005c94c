"""Words, vocabularies, neighbouring words, and where a space is missing between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, text): a document's lines; null has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))


def word_rows(rows: DataFrame, *keys: str, pattern: str = T.WORD2) -> DataFrame:
    """(keys, pos, word): words in order, lower-cased."""
    return rows.select(*keys, F.posexplode(T.words(F.col("text"), pattern)).alias("pos", "word"))


def line_words(rows: DataFrame, *keys: str, pattern: str = T.WORD2, normalize: bool = False) -> DataFrame:
    """(keys, words): each line's words in order, lower-cased, in one row; lines without words have none. normalize: after Unicode compatibility composition."""
    text = T.normalized(F.col("text")) if normalize else F.col("text")
    return rows.select(*keys, T.words(text, pattern).alias("words")).filter(F.size("words") > 0)


def neighbours(lines: DataFrame, *scope: str) -> DataFrame:
    """(scope, l, r): distinct words that follow each other within a line (words array). Neighbours stand in one row, so nothing is sorted."""
    both = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("l"), F.get("words", i).alias("r")))
    return lines.filter(F.size("words") > 1).select(*scope, F.explode(both).alias("p")).select(*scope, "p.l", "p.r").distinct()


def document_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = T.WORD2) -> DataFrame:
    """(doc_id, pairs): distinct neighbours within a line of each document, as two words with a null character between. A document is one row, so nothing is sent."""
    line = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws("\0", F.get(w, i - 1), F.get(w, i)))).otherwise(F.expr("cast(array() as array<string>)"))
    # Words of a line are bound once, or each look-up would split them again.
    lines = F.transform(F.split(text_col, "\n"), lambda x: T.words(x, pattern))
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.array_distinct(F.flatten(F.transform(lines, line))).alias("pairs"))


def counts(words: DataFrame, *scope: str) -> DataFrame:
    return words.groupBy(*scope, "word").agg(F.count("*").alias("n"))


def vocabulary(words: DataFrame, *scope: str, least: int = 2, extra: DataFrame | None = None) -> DataFrame:
    """(scope, word): words that occur `least` times, with the label and the common words and those of `extra`."""
    own = counts(words, *scope).filter(F.col("n") >= least).select(*scope, "word")
    constants = F.explode(F.array(*map(F.lit, (*T.LABEL_WORDS, *T.COMMON_WORDS)))).alias("word")
    fixed = (words.select(*scope).distinct() if scope else words.sparkSession.range(1)).select(*scope, constants)
    out = own.unionByName(fixed)
    return (out if extra is None else out.unionByName(extra.select(*scope, "word"))).distinct()


def adjacent_pairs(words: DataFrame, line: tuple[str, ...], scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(scope, l, r): distinct words that follow each other within a line."""
    w = Window.partitionBy(*line).orderBy("pos")
    return words.select(*scope, F.col("word").alias("l"), F.lead("word").over(w).alias("r")).filter("r is not null").distinct()


def boundary_evidence(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l, r): neighbours that are never written as one word."""
    return pairs.select("l", "r").distinct().join(words.select("word").distinct(), F.concat("l", "r") == F.col("word"), "left_anti")


def glued_literal(words: DataFrame) -> DataFrame:
    """Words of more than 24 letters that the same text's vocabulary lacks: none, as the vocabulary is built from the text itself."""
    long = words.filter((F.char_length("word") > 24) & F.col("word").rlike(r"^\p{L}+$"))
    return long.join(words.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_anti").select("doc_id", "word")


def glued_against_source(words: DataFrame, source: DataFrame, least: int = 25) -> DataFrame:
    """(doc_id, word): words of at least `least` letters that the source doesn't have."""
    long = words.filter((F.char_length("word") >= least) & F.col("word").rlike(r"^\p{L}+$"))
    return long.join(source.select("word").distinct(), "word", "left_anti").select("doc_id", "word").distinct()


def joint_parts(before: Column, after: Column) -> dict[str, Column]:
    """The words that end the left run and begin the right one."""
    return {"trail": F.regexp_extract(before, rf"({T.WORD1})$", 1), "head": F.regexp_extract(after, rf"^({T.WORD1})", 1)}


def needs_space(before: Column, after: Column, shifted: Column, known: dict[str, Column]) -> Column:
    """Whether a space is missing between two runs; the first rule that applies decides.

    known: trail, head, joined (in the vocabulary), pair (neighbours in the source), source_joined (one word there).
    """
    parts = joint_parts(before, after)
    trail, head = parts["trail"], parts["head"]
    end, start = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    inner = F.right(F.left(before, F.char_length(before) - 1), F.lit(1))
    return (
        F.when((before == "") | (after == ""), False)
        .when(end.rlike(r"(?U)\s") | start.rlike(r"(?U)\s"), False)
        .when((end == "-") | (start == "-"), False)
        .when(shifted, False)
        .when(start == "(", end.rlike(r"[\p{L}\p{N}.,;:)]"))
        .when(start.rlike(r"\p{Nd}"), F.when(end.isin(",", ";", ":"), ~inner.rlike(r"\p{Nd}")).otherwise(F.lower(trail).isin(*T.LABEL_WORDS)))
        .when(~start.rlike(r"\p{L}"), False)
        .when(end.isin(".", ",", ";", ":", ")"), start.rlike(r"\p{Lu}") | (end != "."))
        .when(~end.rlike(r"\p{L}") | (trail == ""), False)
        .when(known["pair"] & ~known["source_joined"], True)
        .when(head == "", known["trail"])
        .when(known["joined"], False)
        .otherwise(known["trail"] | known["head"])
    )


def restore_spaces(runs: DataFrame, vocab: DataFrame, source_words: DataFrame, source_pairs: DataFrame) -> DataFrame:
    """(doc_id, container_no, run_no, before, after, space): neighbouring runs of a container, and whether a space is put between.

    vocab and source_words: (doc_id, word); source_pairs: (doc_id, l, r). All questions of membership are answered by one join.
    """
    w = Window.partitionBy("doc_id", "container_no").orderBy("run_no")
    joints = runs.select(
        "doc_id", "container_no", "run_no", F.col("text").alias("before"), F.lead("text").over(w).alias("after"), F.lead("vert_align").over(w).alias("align")
    ).filter("after is not null")
    parts = joint_parts(F.col("before"), F.col("after"))
    keyed = joints.select("*", F.lower(parts["trail"]).alias("trail"), F.lower(parts["head"]).alias("head"))
    ask = lambda kind, key, name: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(name).alias("name"))
    trail, head = F.col("trail"), F.col("head")
    joined, pair = F.concat(trail, head), F.concat_ws("\0", trail, head)
    asked = keyed.select(
        *keyed.columns,
        F.explode(F.array(ask("vocab", trail, "trail"), ask("vocab", head, "head"), ask("vocab", joined, "joined"), ask("source", joined, "source_joined"), ask("pair", pair, "pair"))).alias("q"),
    ).select(*keyed.columns, "q.kind", "q.key", "q.name")
    known = (
        vocab.select("doc_id", F.lit("vocab").alias("kind"), F.col("word").alias("key"))
        .unionByName(source_words.select("doc_id", F.lit("source").alias("kind"), F.col("word").alias("key")))
        .unionByName(source_pairs.select("doc_id", F.lit("pair").alias("kind"), F.concat_ws("\0", "l", "r").alias("key")))
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    told = asked.join(known, ["doc_id", "kind", "key"], "left")
    names = ("trail", "head", "joined", "pair", "source_joined")
    told = told.groupBy("doc_id", "container_no", "run_no", "before", "after", "align").agg(*(F.coalesce(F.bool_or((F.col("name") == n) & F.col("hit")), F.lit(False)).alias(f"known_{n}") for n in names))
    space = needs_space(F.col("before"), F.col("after"), T.is_shifted(F.col("align")), {n: F.col(f"known_{n}") for n in names})
    return told.select("doc_id", "container_no", "run_no", "before", "after", F.coalesce(space, F.lit(False)).alias("space"))
