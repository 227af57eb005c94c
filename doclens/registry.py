"""Queries by name, and the SQL that states the result of each that SQL can express.

apply operators for which these tables hold no input.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.fixtures import fixture, values
from doclens.functions import tex
from doclens.functions import text as T
from doclens.operators import geometry as G
from doclens.operators import layout as L
from doclens.operators import matching as M
from doclens.operators import numbering as N
from doclens.operators import reconcile as R
from doclens.operators import vocabulary as V
from doclens.plans import audit
from doclens.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def word_table(spark: SparkSession, sf: str) -> DataFrame:
    return V.word_rows(V.lines(documents(spark, sf)), "doc_id", "line_no")


#: Seconds since 1970 of a timestamp without a zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000.0D"

#: Ranges of time in which a user's events are scanned apart.
DAY = 86400.0

# Parts of the SQL side.
Q2 = r"\p{L}(?:\p{L}|[''-])+"
LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
WORDS = f"{LINES}, ws AS (SELECT doc_id, line_no, [lower(x) FOR x IN regexp_extract_all(text, '{Q2}')] AS w FROM lines), words AS (SELECT doc_id, line_no, unnest(range(len(w))) AS pos, unnest(w) AS word FROM ws)"
PAIRS = "pairs AS (SELECT DISTINCT doc_id, l, r FROM (SELECT doc_id, word AS l, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS r FROM words) WHERE r IS NOT NULL)"
CONSTANTS = ", ".join(f"('{w}')" for w in (*T.LABEL_WORDS, *T.COMMON_WORDS))
CAPTION_SQL = r"(?i)^\s*((Table|Figure|Fig\.?)\s*\d+\s*[:.]|\([a-z]\)\s)"
STRIP = r"'^\s+|\s+$', '', 'g'"


def blocks_sql(pairs: str) -> str:
    """CTEs (after WITH RECURSIVE) that align lists a and b of `pairs` (id, a, b): block (id, i, j, n) are the longest common runs, each found between those found before."""
    return f"""pair AS ({pairs}), ea AS (SELECT id, unnest(range(len(a))) AS i, unnest(a) AS x FROM pair), eb AS (SELECT id, unnest(range(len(b))) AS j, unnest(b) AS x FROM pair),
    same AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS g FROM ea JOIN eb USING (id, x)), diagonal AS (SELECT id, min(i) AS i0, min(j) AS j0, count(*) AS n0 FROM same GROUP BY id, j - i, g),
    tree AS (
        SELECT p.id, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi, max([n0, -i0, -j0]) AS best FROM pair p JOIN diagonal d ON d.id = p.id GROUP BY ALL
        UNION ALL
        SELECT c.id, c.alo, c.ahi, c.blo, c.bhi, max([least(n0, ahi - i0, bhi - j0) - greatest(0, alo - i0, blo - j0), -(i0 + greatest(0, alo - i0, blo - j0)), -(j0 + greatest(0, alo - i0, blo - j0))]) AS best
        FROM (SELECT id, CASE WHEN side = 0 THEN alo ELSE best[1] - best[2] END AS alo, CASE WHEN side = 0 THEN -best[2] ELSE ahi END AS ahi, CASE WHEN side = 0 THEN blo ELSE best[1] - best[3] END AS blo, CASE WHEN side = 0 THEN -best[3] ELSE bhi END AS bhi FROM tree, (VALUES (0), (1)) AS s(side)) c
        JOIN diagonal d ON d.id = c.id AND least(n0, ahi - i0, bhi - j0) > greatest(0, alo - i0, blo - j0) GROUP BY ALL
    ), block AS (SELECT id, -best[2] AS i, -best[3] AS j, best[1] AS n FROM tree)"""




# Words, vocabularies, neighbours.


@query(f"WITH {WORDS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM words GROUP BY ALL")
def t1_words(spark, sf):
    lines = V.line_words(V.lines(documents(spark, sf)), "doc_id", "line_no", normalize=True)
    return lines.select("doc_id", "line_no", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


@query(f"WITH {WORDS}, {PAIRS} SELECT DISTINCT l, r FROM pairs WHERE NOT EXISTS (SELECT 1 FROM words WHERE word = l || r)")
def f13_boundary_evidence(spark, sf):
    lines = V.line_words(V.lines(documents(spark, sf)))
    return V.boundary_evidence(lines.select(F.explode("words").alias("word")), V.neighbours(lines))


FLAGSHIP = f13_boundary_evidence


@query(f"WITH {WORDS}, {PAIRS} SELECT doc_id, count(*) AS n_pairs FROM pairs GROUP BY doc_id")
def s4_word_pairs(spark, sf):
    return V.document_neighbours(documents(spark, sf)).filter(F.size("pairs") > 0).select("doc_id", F.size("pairs").cast("long").alias("n_pairs"))


@query(f"WITH {WORDS} SELECT word FROM words GROUP BY word HAVING count(*) >= 2 UNION SELECT * FROM (VALUES {CONSTANTS})")
def a1_vocabulary(spark, sf):
    return V.vocabulary(word_table(spark, sf))


@query(f"WITH {WORDS} SELECT doc_id, word FROM words GROUP BY ALL HAVING count(*) >= 2 UNION SELECT * FROM (SELECT DISTINCT doc_id FROM words) CROSS JOIN (VALUES {CONSTANTS}) AS c(word)")
def e1_document_vocabulary(spark, sf):
    return V.vocabulary(word_table(spark, sf), "doc_id")


@query(f"WITH {WORDS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM words GROUP BY ALL HAVING count(*) >= 6")
def f2_long_lines(spark, sf):
    return V.line_words(V.lines(documents(spark, sf)), "doc_id", "line_no").filter(F.size("words") >= 6).select("doc_id", "line_no")


@query(f"WITH {WORDS} SELECT DISTINCT doc_id, word FROM words WHERE length(word) >= 12 AND regexp_matches(word, '^\\p{{L}}+$') AND word NOT IN (SELECT lower(unnest(regexp_extract_all(text, '{Q2}'))) FROM benchmark)")
def f4_glued_against_source(spark, sf):
    source = V.word_rows(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    return V.glued_against_source(word_table(spark, sf), source, 12)


@query(f"WITH {WORDS} SELECT count(*) AS n FROM words a WHERE length(word) > 24 AND word NOT IN (SELECT word FROM words b WHERE b.doc_id = a.doc_id)")
def f4_glued_literal(spark, sf):
    return V.glued_literal(word_table(spark, sf)).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(10), ''), '[a-z]{2}\.[A-Z][a-z]')) AS stop FROM documents")
def f5_stops(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(T.stops_without_space(F.replace("text", F.lit("\n"), F.lit("")))).alias("stop"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '\s+', '', 'g')) AS k, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS a FROM documents")
def p6_p7_keys(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.no_space(F.lower("text"))).alias("k"), F.md5(T.ascii_key(F.col("text"))).alias("a"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(^|[^\\])((?:\\\\)*)%[^' || chr(10) || ']*', '\1\2 ', 'g')) AS h FROM documents")
def p1_comments(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.strip_tex_comments(F.col("text"))).alias("h"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN length(text) >= 90 THEN 'justify' ELSE 'keep' END AS decision, CASE WHEN length(text) < 90 THEN text ELSE substring(text, 1, 87) || '...' END AS shown FROM lines")
def f15_o7_lines(spark, sf):
    decision = L.justification(F.col("text"), F.lit(False), F.lit(False))
    return V.lines(documents(spark, sf)).select("doc_id", "line_no", decision.alias("decision"), T.shortened(F.col("text")).alias("shown"))


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT 40")
def o5_report_limit(spark, sf):
    return V.counts(word_table(spark, sf)).orderBy(F.desc("n"), "word").limit(40)


@query(
    f"WITH {LINES}, grams AS (SELECT item_id, array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '{Q2}')] AS w FROM benchmark) WHERE len(w) >= 6)),"
    f" there AS (SELECT DISTINCT array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT [lower(x) FOR x IN regexp_extract_all(text, '{Q2}')] AS w FROM documents) WHERE len(w) >= 6))"
    " SELECT DISTINCT item_id AS doc_id, CAST(0 AS INTEGER) AS page_no, gram FROM grams WHERE gram NOT IN (SELECT gram FROM there)"
)
def j1_missing_grams(spark, sf):
    pages = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_no"), T.words(F.col("text")).alias("words"))
    n = 6
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))).alias("gram")
    there = documents(spark, sf).select(T.words(F.col("text")).alias("words")).filter(F.size("words") >= n).select(grams).distinct()
    return pages.filter(F.size("words") >= n).select("doc_id", "page_no", grams).distinct().join(there, "gram", "left_anti").select("doc_id", "page_no", "gram")


#: Words of items and documents, and for each item the document that shares most runs of six words with it, the least of equals.
NEAREST = f"""iw AS (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '{Q2}')] AS w FROM benchmark), dw AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '{Q2}')] AS w FROM documents WHERE text IS NOT NULL),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM iw WHERE len(w) >= 6)),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM dw WHERE len(w) >= 6)),
    shared AS (SELECT item_id, doc_id, count(*) AS n FROM ig JOIN dg USING (gram) GROUP BY ALL), nearest AS (SELECT item_id, arg_max(doc_id, [n, -doc_id]) AS doc_id FROM shared GROUP BY item_id)"""


def nearest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items as (item_id, words), and the words of the document that is nearest to each, (item_id, words): all documents are searched."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text", T.words(T.normalized(F.col("text"))).alias("words"))
    docs = documents(spark, sf).select("doc_id", "text", T.words(T.normalized(F.col("text"))).alias("words"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 5), lambda i: F.array_join(F.slice(c, i, 6), " ")))).alias("gram")
    ig = items.filter(F.size("words") >= 6).select("item_id", grams(F.col("words")))
    dg = docs.filter(F.size("words") >= 6).select("doc_id", grams(F.col("words")))
    # The side of items is small: documents' grams are looked up in it where they are, and only hits are counted.
    best = dg.join(ig, "gram").groupBy("item_id", "doc_id").count().groupBy("item_id").agg(F.max_by("doc_id", F.struct("count", -F.col("doc_id"))).alias("doc_id"))
    return items, docs.join(best, "doc_id").select("item_id", "text", "words")


@query(
    f"WITH RECURSIVE {NEAREST}, {blocks_sql('SELECT item_id AS id, iw.w AS a, dw.w AS b FROM iw JOIN nearest USING (item_id) JOIN dw USING (doc_id)')},"
    " covered AS (SELECT id, unnest(range(i, i + n)) AS i FROM block), gone AS (SELECT item_id, i, w[i + 1] AS word FROM (SELECT item_id, w, unnest(range(len(w))) AS i FROM iw WHERE len(w) >= 6) x WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.id = item_id AND c.i = x.i)),"
    " runs AS (SELECT item_id, i, word, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS g FROM gone)"
    " SELECT item_id AS doc_id, CAST(0 AS INTEGER) AS page_no, CAST(min(i) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM runs GROUP BY item_id, g HAVING count(*) >= 6"
)
def j1_missing_runs(spark, sf):
    """Each benchmark item as a page, against the document that is nearest to it."""
    items, docs = nearest(spark, sf)
    pages = items.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_no"), "words")
    return M.missing_runs(pages, docs.select(F.col("item_id").alias("doc_id"), "words"))


@query(
    f"WITH {NEAREST}, p AS (SELECT item_id, b.text AS a, d.text AS t FROM benchmark b JOIN nearest USING (item_id) JOIN documents d USING (doc_id)), ca AS (SELECT item_id, unnest(string_split(a, '')) AS ch FROM p), cb AS (SELECT item_id, unnest(string_split(t, '')) AS ch FROM p),"
    " na AS (SELECT item_id, ch, count(*) AS n FROM ca GROUP BY ALL), nb AS (SELECT item_id, ch, count(*) AS n FROM cb GROUP BY ALL)"
    " SELECT p.item_id, CAST(least(length(a), length(t)) AS INTEGER) AS shorter, CAST(greatest(length(a), length(t)) AS INTEGER) AS longer, CAST((SELECT coalesce(sum(least(na.n, nb.n)), 0) FROM na JOIN nb USING (item_id, ch) WHERE item_id = p.item_id) AS BIGINT) AS shared FROM p"
)
def a8_bag_overlap(spark, sf):
    """Characters that each benchmark item shares with the document that is nearest to it."""
    items, docs = nearest(spark, sf)
    return M.bag_bound(items.select("item_id", F.col("text").alias("a")).join(docs.select("item_id", F.col("text").alias("b")), "item_id"), ("item_id",))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j14_unlabelled(spark, sf):
    ids = lambda n: spark.read.parquet(f"{sf}/{n}.parquet").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return R.undefined(ids("documents"), ids("labels")).select("doc_id")


@query(
    "WITH iv AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS y0, epoch_us(ts) / 1000000.0::DOUBLE + value AS y1, event_type = 'purchase' AS seed FROM events),"
    " a AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY user_id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 THEN 0 ELSE 1 END AS n FROM iv),"
    " b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM a),"
    " h AS (SELECT user_id, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM b GROUP BY user_id, island HAVING bool_or(seed))"
    " SELECT user_id, count(*) AS islands, CAST(sum(n) AS BIGINT) AS members FROM h GROUP BY user_id"
)
def w2_seeded_islands(spark, sf):
    """Events as intervals of a user: those near a purchase, by strict gaps."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.expr(MICROS).alias("y0"), (F.expr(MICROS) + F.col("value")).alias("y1"), (F.col("event_type") == "purchase").alias("seed"))
    i = G.islands(e, ("user_id",), "y0", "y1", 12, False, DAY)
    h = i.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed")).filter("seed")
    return h.groupBy("user_id").agg(F.count("*").alias("islands"), F.sum("n").alias("members"))


@query(
    "WITH iv AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS y0, epoch_us(ts) / 1000000.0::DOUBLE + value AS y1 FROM events),"
    " a AS (SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY user_id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 THEN 0 ELSE 1 END AS n FROM iv),"
    " b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM a)"
    " SELECT user_id, CAST(island AS BIGINT) AS island, min(y0) AS y0, max(y1) AS y1 FROM b GROUP BY user_id, island HAVING max(y1) - min(y0) >= 6"
)
def w3_merged_intervals(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.expr(MICROS).alias("y0"), (F.expr(MICROS) + F.col("value")).alias("y1"))
    return G.islands(e, ("user_id",), "y0", "y1", 12, True, DAY).groupBy("user_id", "island").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).filter("y1 - y0 >= 6")


@query("SELECT source AS doc_id, page_no FROM (SELECT source, CAST(doc_id AS INTEGER) AS page_no, n_chars, max(n_chars) OVER (PARTITION BY source) AS m FROM documents) WHERE n_chars < m - 90")
def a5_short_pages(spark, sf):
    """Documents as pages of their source, by length."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"), F.col("n_chars").cast("double").alias("y1"), F.lit("").alias("opening"))
    return G.deliberate_breaks(d.select("doc_id", "page_no", "y1"), d.select("doc_id", "page_no", "opening"))


@query("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS has_next, coalesce(regexp_matches(text, '[-]$') OR regexp_matches(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '^[-]'), false) AS hyphen FROM conversations")
def w5_joints(spark, sf):
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf}/conversations.parquet")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", nxt.isNotNull().alias("has_next"), F.coalesce(F.col("text").rlike("[-]$") | nxt.rlike("^[-]"), F.lit(False)).alias("hyphen"))


@query(
    rf"""WITH {WORDS}, vocab AS (SELECT word FROM words GROUP BY word HAVING count(*) >= 2 UNION SELECT * FROM (VALUES {CONSTANTS})), source AS (SELECT DISTINCT word FROM words), {PAIRS}, near AS (SELECT DISTINCT l, r FROM pairs),
    joint AS (SELECT conv_id, turn, text AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
    part AS (SELECT conv_id, turn, before, after, right(before, 1) AS e, left(after, 1) AS s, right(left(before, length(before) - 1), 1) AS inside, lower(regexp_extract(before, '(\p{{L}}(?:\p{{L}}|[''-])*)$', 1)) AS trail, lower(regexp_extract(after, '^(\p{{L}}(?:\p{{L}}|[''-])*)', 1)) AS head FROM joint WHERE after IS NOT NULL),
    told AS (SELECT *, trail IN (SELECT word FROM vocab) AS k_trail, head IN (SELECT word FROM vocab) AS k_head, trail || head IN (SELECT word FROM vocab) AS k_joined, trail || head IN (SELECT word FROM source) AS k_source, (trail, head) IN (SELECT (l, r) FROM near) AS k_pair FROM part)
    SELECT conv_id, turn, coalesce(CASE WHEN before = '' OR after = '' OR regexp_matches(e, '\s') OR regexp_matches(s, '\s') OR e = '-' OR s = '-' THEN false WHEN s = '(' THEN regexp_matches(e, '[\p{{L}}\p{{N}}.,;:)]')
        WHEN regexp_matches(s, '\p{{Nd}}') THEN CASE WHEN e IN (',', ';', ':') THEN NOT regexp_matches(inside, '\p{{Nd}}') ELSE trail IN ({", ".join(f"'{w}'" for w in T.LABEL_WORDS)}) END
        WHEN NOT regexp_matches(s, '\p{{L}}') THEN false WHEN e IN ('.', ',', ';', ':', ')') THEN regexp_matches(s, '\p{{Lu}}') OR e <> '.' WHEN NOT regexp_matches(e, '\p{{L}}') OR trail = '' THEN false
        WHEN k_pair AND NOT k_source THEN true WHEN head = '' THEN k_trail WHEN k_joined THEN false ELSE k_trail OR k_head END, false) AS space FROM told""".replace("\\\\", "\\")
)
def w5_f13_conversation_spaces(spark, sf):
    """Turns of a conversation as runs of a paragraph; the words and neighbours of all documents tell where a space is missing between two."""
    runs = spark.read.parquet(f"{sf}/conversations.parquet").select(F.lit(0).alias("doc_id"), F.col("conv_id").alias("container_no"), F.col("turn").alias("run_no"), "text", F.lit(None).cast("string").alias("vert_align"))
    lines = V.line_words(V.lines(documents(spark, sf)))
    words = lines.select(F.lit(0).alias("doc_id"), F.explode("words").alias("word"))
    pairs = V.neighbours(lines).select(F.lit(0).alias("doc_id"), "l", "r")
    out = V.restore_spaces(runs, V.vocabulary(words, "doc_id"), words.distinct(), pairs)
    return out.select(F.col("container_no").alias("conv_id"), F.col("run_no").alias("turn"), "space")


@query(r"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def s16_tag_counts(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    r"""WITH RECURSIVE tag AS (SELECT page_id, html, regexp_extract_all(html, '<(/?)([a-z0-9]+)[^>]*>', 2) AS names, regexp_extract_all(html, '<(/?)([a-z0-9]+)[^>]*>', 1) AS ends, list_transform(list_zip(regexp_extract_all(html, '<(/?)([a-z0-9]+)[^>]*>', 1), regexp_extract_all(html, '<(/?)([a-z0-9]+)[^>]*>', 2)), lambda x: CASE WHEN x[1] = '/' THEN 6 ELSE 8 END + length(x[2])) AS sizes,
        [length(x) FOR x IN regexp_split_to_array(html, '</?[a-z0-9]+[^>]*>')] AS between FROM pages),
    placed AS (SELECT *, len(names) AS n FROM tag),
    walk AS (
        SELECT page_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS at, CAST([] AS STRUCT(name VARCHAR, start BIGINT)[]) AS stack, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS stop FROM placed
        UNION ALL
        SELECT page_id, k, stop, CASE WHEN NOT closes THEN list_append(stack, {'name': name, 'start': CASE WHEN name IN ('article', 'ul', 'p') AND NOT list_bool_or(list_append([x.start IS NOT NULL FOR x IN stack], false)) THEN begin END})
            WHEN hit > 0 THEN stack[:hit - 1] ELSE stack END, CASE WHEN closes AND hit > 0 THEN stack[hit].start END, stop
        FROM (SELECT w.page_id, w.k + 1 AS k, w.stack, p.names[w.k + 1] AS name, p.ends[w.k + 1] = '/' AS closes, w.at + p.between[w.k + 1] AS begin, w.at + p.between[w.k + 1] + p.sizes[w.k + 1] AS stop,
            CASE WHEN list_contains([x.name FOR x IN w.stack], p.names[w.k + 1]) THEN len(w.stack) + 1 - list_position(list_reverse([x.name FOR x IN w.stack]), p.names[w.k + 1]) ELSE 0 END AS hit
            FROM walk w JOIN placed p ON p.page_id = w.page_id AND w.k < p.n)
    )
    SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM walk WHERE start IS NOT NULL"""
)
def t3_environments(spark, sf):
    """Tags of pages as environments: outermost articles and lists, misnested tags tolerated."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace(F.replace("html", F.lit("%"), F.lit(" ")), r"<([a-z0-9]+)[^>]*>", r"\\begin{$1}"), r"</([a-z0-9]+)>", r"\\end{$1}").alias("text"))
    return tex.table_of(p, lambda t: tex.environments(t, {"article", "ul", "p"}), "start int, stop int")


# Scalars over fixtures.


LENGTH_SQL = r"(?i)^\s*(-?\d+(?:\.\d+)?)\s*(in|inch|cm|mm|pt|bp)?\s*$"
RELATIVE_SQL = r"^(-?(?:\d+(?:\.\d*)?|\.\d+))\s*\\(?:linewidth|textwidth|columnwidth)$"
INCHES_SQL = f"try_cast(nullif(regexp_extract(value, '{LENGTH_SQL}', 1), '') AS DOUBLE) * CASE lower(regexp_extract(value, '{LENGTH_SQL}', 2)) WHEN 'in' THEN 1.0::DOUBLE WHEN 'inch' THEN 1.0::DOUBLE WHEN 'cm' THEN 1 / 2.54::DOUBLE WHEN 'mm' THEN 1 / 25.4::DOUBLE WHEN 'bp' THEN 1 / 72.27::DOUBLE ELSE 1.0::DOUBLE / 72 END"


@query(f"SELECT id, {INCHES_SQL} AS inches FROM {values('lengths')}")
def p3_lengths(spark, sf):
    return fixture(spark, "lengths").select("id", T.inches(F.col("value")).alias("inches"))


@query(
    f"SELECT id, round(CASE WHEN regexp_matches(value, '{RELATIVE_SQL}') THEN CAST(regexp_extract(value, '{RELATIVE_SQL}', 1) AS DOUBLE) * 6.5 WHEN value IN ('\\linewidth', '\\textwidth', '\\columnwidth') THEN 6.5 ELSE {INCHES_SQL} END, 9) AS inches FROM (SELECT id, regexp_replace(value, {STRIP}) AS value FROM {values('lengths')})"
)
def p4_relative_widths(spark, sf):
    return fixture(spark, "lengths").select("id", F.round(T.width_inches(F.col("value"), F.lit(6.5)), 9).alias("inches"))


@query(
    "WITH x AS (SELECT id, total, widths, coalesce(list_sum([w FOR w IN widths IF w IS NOT NULL]), 0.0) AS fixed, len([1 FOR w IN widths IF w IS NULL]) AS flexible FROM " + values("widths") + ")"
    " SELECT id, CASE WHEN total IS NULL OR flexible = len(widths) OR (fixed > total OR flexible = 0) AND fixed = 0 THEN NULL"
    " ELSE [CASE WHEN w IS NULL THEN greatest(total - fixed, 0.0) / flexible WHEN fixed > total OR flexible = 0 THEN w * (total / fixed) ELSE w END FOR w IN widths] END AS widths FROM x"
)
def p5_column_widths(spark, sf):
    return fixture(spark, "widths").select("id", T.column_widths(F.col("total"), F.col("widths")).alias("widths"))


@query(f"SELECT id, string_split(name, '+')[-1] AS base, CASE WHEN regexp_matches(name, '(?i)(t1x[a-z]*tt|cmtt|lmmono|courier|mono)') THEN 'mono' WHEN regexp_matches(name, '(?i)termes|newtx|nimbus|times|cm(?:r|ss|mi|sy|ex)|lmroman|txsy|txmi|txex|txsym|stix') OR (regexp_matches(name, '(?i)t1x') AND NOT regexp_matches(name, '(?i)t1x.*tt')) THEN 'serif' END AS class, regexp_matches(name, '(?i)newtx|txsy|txmi|txex|txsym|cm(?:mi|sy|ex)|mathjax|math[a-z]|stix|euler|msam|msbm|rsfs|wasy') AS math FROM {values('fonts')}")
def p9_p10_fonts(spark, sf):
    n = F.col("name")
    return fixture(spark, "fonts").select("id", T.base_font(n).alias("base"), T.font_class(n).alias("class"), T.is_math_font(n).alias("math"))


@query(f"WITH RECURSIVE r AS (SELECT id, n, '' AS s FROM {values('labels')} UNION ALL SELECT id, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || s FROM r WHERE n > 0) SELECT id, s AS letter FROM r WHERE n = 0")
def p15_letters(spark, sf):
    return fixture(spark, "labels").select("id", T.appendix_letter(F.col("n")).alias("letter"))


@query(
    rf"SELECT id, regexp_matches(text, '{CAPTION_SQL}') AS caption, regexp_matches(text, '^\s*\([a-z]\)\s') AS panel, regexp_matches(text, '^(\d+(\.\d+)*|[A-H])\s+[A-Z]') AS heading, len(regexp_extract_all(text, '[a-z]{{2}}\.[A-Z][a-z]')) AS stops, CASE WHEN length(text) < 90 THEN text ELSE substring(text, 1, 87) || '...' END AS shown FROM {values('lines')}"
)
def f6_f7_f8_predicates(spark, sf):
    t = F.col("text")
    return fixture(spark, "lines").select("id", T.is_caption(t).alias("caption"), T.is_panel_caption(t).alias("panel"), T.is_heading(t).alias("heading"), F.size(T.stops_without_space(t)).cast("long").alias("stops"), T.shortened(t).alias("shown"))


@query(f"SELECT id, CASE WHEN twips > 400 THEN 240 ELSE twips END AS twips FROM {values('spacing')}")
def f18_spacing(spark, sf):
    return fixture(spark, "spacing").select("id", T.clamped_spacing(F.col("twips")).alias("twips"))


@query("SELECT k, CAST(round_even(100.0 * k / 14, 0) AS INTEGER) AS percent FROM (SELECT unnest(range(15)) AS k)")
def w11_progress(spark, sf):
    return spark.range(15).select(F.col("id").alias("k"), T.progress(F.col("id")).alias("percent"))


@query(r"SELECT doc_id, regexp_replace(text, '(^|[^\\])((?:\\\\)*)%[^' || chr(10) || ']*', '\1\2 ', 'g') AS bare FROM " + values("tex"))
def p1_comment_parity(spark, sf):
    return fixture(spark, "tex").select("doc_id", T.strip_tex_comments(F.col("text")).alias("bare"))


@query(r"SELECT doc_id, regexp_matches(regexp_extract(substring(text, 1, 5), '[^\n]*$'), '(^|[^\\])(\\\\)*%') AS hidden FROM " + values("tex"))
def p2_comment_offsets(spark, sf):
    return fixture(spark, "tex").select("doc_id", T.in_comment(F.col("text"), F.lit(5)).alias("hidden"))


@query(f"SELECT path, regexp_replace(path, '\\.[^./\\\\]*$', '') || '.docx' AS target FROM {values('files')}")
def p14_output_names(spark, sf):
    return fixture(spark, "files").select("path", T.output_name(F.col("path")).alias("target"))


# Geometry over fixtures.

BLOCKS_SQL = (
    f"s AS (SELECT * FROM {values('spans')}), blocks AS (SELECT doc_id, page_no, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, '' ORDER BY span_no) AS text,"
    " coalesce(sum(CASE WHEN regexp_matches(font, '(?i)cm(?:mi|sy|ex)') THEN length(text) ELSE 0 END)::DOUBLE / nullif(length(trim(string_agg(text, '' ORDER BY span_no))), 0), 0.0) AS math_share FROM s GROUP BY ALL)"
)


@query(f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def s2_a2_blocks(spark, sf):
    return G.blocks(fixture(spark, "spans"))


@query(f"SELECT * FROM {values('drawings')} WHERE y1 - y0 <= 2.5 AND x1 - x0 >= 40")
def s3_rules(spark, sf):
    return G.rules(fixture(spark, "drawings"))


@query(f"WITH {BLOCKS_SQL} SELECT p.doc_id, p.page_no, coalesce(min(b.x0) FILTER (WHERE b.x1 - b.x0 > 0.5 * (p.x1 - p.x0)), p.x0 + 72) AS frame_left, coalesce(max(b.x1) FILTER (WHERE b.x1 - b.x0 > 0.5 * (p.x1 - p.x0)), p.x1 - 72) AS frame_right FROM {values('pages', 'p')} LEFT JOIN blocks b USING (doc_id, page_no) GROUP BY p.doc_id, p.page_no, p.x0, p.x1")
def a3_text_frame(spark, sf):
    return G.text_frame(G.blocks(fixture(spark, "spans")), fixture(spark, "pages"))


@query(f"WITH {BLOCKS_SQL}, gaps AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 450.0, 520.0), (1, 0, 1, 505.0, 520.0), (1, 1, 0, 0.0, 700.0)) AS g(doc_id, page_no, gap_no, top, bottom)) SELECT g.doc_id, g.page_no, g.gap_no FROM gaps g WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = g.doc_id AND b.page_no = g.page_no AND regexp_matches(b.text, '{CAPTION_SQL}') AND b.y0 >= g.top AND b.y1 <= g.bottom)")
def f9_caption_between(spark, sf):
    gaps = spark.createDataFrame([(1, 0, 0, 450.0, 520.0), (1, 0, 1, 505.0, 520.0), (1, 1, 0, 0.0, 700.0)], "doc_id long, page_no int, gap_no int, top double, bottom double")
    return G.caption_between(gaps, G.blocks(fixture(spark, "spans"))).select("doc_id", "page_no", "gap_no")


@query(f"SELECT a.doc_id, a.page_no, a.y0 AS a, b.y0 AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.9 * least(a.x1 - a.x0, b.x1 - b.x0) AS same FROM {values('drawings', 'a')} JOIN {values('drawings', 'b')} USING (doc_id, page_no) WHERE a.y0 < b.y0")
def f10_same_width(spark, sf):
    d = fixture(spark, "drawings")
    a, b = d.alias("a"), d.alias("b")
    same = G.same_width(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1"))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.y0") < F.col("b.y0"))).select("a.doc_id", "a.page_no", F.col("a.y0").alias("a"), F.col("b.y0").alias("b"), same.alias("same"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'equation', CAST(150.0 AS DOUBLE), CAST(100.0 AS DOUBLE), CAST(320.0 AS DOUBLE), CAST(130.0 AS DOUBLE)), (1, 0, 1, 'table', 72.0, 520.0, 300.0, 546.0)) AS t(doc_id, page_no, region_no, kind, x0, y0, x1, y1)")
def w1_j7_regions(spark, sf):
    return G.find_regions(fixture(spark, "spans"), fixture(spark, "drawings"), fixture(spark, "pages"))


@query(f"WITH {BLOCKS_SQL}, f AS (SELECT 1 AS doc_id, 0 AS page_no, 72.0 AS l, 505.0 AS r) SELECT doc_id, page_no, block_no FROM blocks JOIN f USING (doc_id, page_no) WHERE x0 >= l + 24 AND x1 <= r - 2 AND NOT (72.0 < x1 AND x0 < 300.0 AND 520.0 < y1 AND y0 < 546.0)")
def f11_set_apart(spark, sf):
    b = G.blocks(fixture(spark, "spans"))
    t = G.tables(G.rule_groups(G.rules(fixture(spark, "drawings")), b), b)
    return G.set_apart(b, G.text_frame(b, fixture(spark, "pages")), t).filter("page_no = 0").select("doc_id", "page_no", "block_no")


# Numbering over fixtures.


@query(
    f"WITH c AS (SELECT * FROM {values('captions')}), a AS (SELECT *, sum(CASE WHEN starred THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS n FROM c WHERE kind <> 'panel'), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, float_no ORDER BY pos) AS n FROM c WHERE kind = 'panel')"
    " SELECT doc_id, kind, float_no, pos, starred, caption, label, CASE WHEN NOT starred THEN CAST(n AS BIGINT) END AS number, CASE WHEN NOT starred THEN upper(kind[1]) || kind[2:] || ' ' || n || '.' END AS prefix FROM a UNION ALL SELECT doc_id, kind, float_no, pos, starred, caption, label, n, '(' || chr(CAST(96 + n AS INTEGER)) || ')' FROM b"
)
def t7_t8_t9_caption_numbers(spark, sf):
    return N.caption_numbers(fixture(spark, "captions"))


HEADINGS_SQL = f"""h1 AS (SELECT *, sum(CASE WHEN level = 1 AND NOT starred THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS n1 FROM {values('headings')}), h2 AS (SELECT *, sum(CASE WHEN level = 2 AND NOT starred THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1 ORDER BY ord) AS n2 FROM h1),
    h3 AS (SELECT *, sum(CASE WHEN level = 3 AND NOT starred THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1, n2 ORDER BY ord) AS n3 FROM h2),
    prefixed AS (SELECT doc_id, ord, label, CASE WHEN starred OR n1 = 0 THEN NULL WHEN level = 1 THEN 'Appendix ' || chr(CAST(64 + n1 AS INTEGER)) WHEN level = 2 THEN chr(CAST(64 + n1 AS INTEGER)) || '.' || n2 ELSE chr(CAST(64 + n1 AS INTEGER)) || '.' || n2 || '.' || n3 END AS prefix FROM h3)"""
NUMBERS_SQL = f"""{HEADINGS_SQL}, c AS (SELECT *, sum(CASE WHEN starred THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS n FROM {values('captions')} WHERE kind <> 'panel'),
    p AS (SELECT *, chr(CAST(96 + row_number() OVER (PARTITION BY doc_id, fig_no ORDER BY start) AS INTEGER)) AS letter FROM {values('panels')}),
    own AS (SELECT doc_id, float_no, pos, label AS key FROM {values('captions')} WHERE kind <> 'table'),
    inside AS (SELECT l.doc_id, l.float_no, l.key, arg_max(letter, start) AS letter FROM own l LEFT JOIN p ON p.doc_id = l.doc_id AND p.fig_no = l.float_no AND l.pos BETWEEN p.start AND p.stop GROUP BY l.doc_id, l.float_no, l.pos, l.key),
    in_figures AS (SELECT i.doc_id, i.key, c.n || coalesce(letter, '') AS number FROM inside i JOIN c ON c.doc_id = i.doc_id AND c.float_no = i.float_no AND c.kind = 'figure' AND NOT c.starred),
    in_tables AS (SELECT doc_id, label AS key, CAST(arg_max(n, pos) AS VARCHAR) AS number FROM c WHERE kind = 'table' AND NOT starred AND label IS NOT NULL GROUP BY ALL),
    in_appendix AS (SELECT doc_id, label AS key, replace(prefix, 'Appendix ', '') AS number FROM prefixed WHERE label IS NOT NULL AND prefix IS NOT NULL),
    numbers AS (SELECT doc_id, key, arg_max(number, p) AS number FROM (SELECT *, 1 AS p FROM in_appendix UNION ALL SELECT *, 2 FROM in_figures UNION ALL SELECT *, 3 FROM in_tables) GROUP BY ALL)"""


@query(f"WITH {HEADINGS_SQL} SELECT doc_id, ord, prefix FROM prefixed")
def w6_heading_prefixes(spark, sf):
    return N.heading_prefixes(fixture(spark, "headings")).select("doc_id", "ord", "prefix")


@query(f"WITH {NUMBERS_SQL} SELECT * FROM in_appendix")
def t12_heading_labels(spark, sf):
    return N.heading_labels(N.heading_prefixes(fixture(spark, "headings")))


@query("SELECT doc_id, key, first FROM (SELECT doc_id, labels[1] AS first, unnest(labels[2:]) AS key FROM (VALUES (CAST(1 AS BIGINT), 0, ['a', 'b', 'c']), (1, 1, ['x']), (2, 0, [])) AS t(doc_id, ord, labels))")
def t19_label_aliases(spark, sf):
    return N.label_aliases(spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["x"]), (2, 0, [])], "doc_id long, ord int, labels array<string>"))


def _numbers(spark):
    c = N.caption_numbers(fixture(spark, "captions"))
    labels = fixture(spark, "captions").filter("kind <> 'table'").select("doc_id", "float_no", "pos", F.col("label").alias("key"))
    figures = N.figure_labels(c, fixture(spark, "panels"), labels)
    appendix = N.heading_labels(N.heading_prefixes(fixture(spark, "headings")))
    return N.table_labels(c), figures, appendix


@query(f"WITH {NUMBERS_SQL} SELECT * FROM in_figures")
def j8_figure_labels(spark, sf):
    return _numbers(spark)[1]


@query(f"WITH {NUMBERS_SQL} SELECT * FROM in_tables")
def j12_table_labels(spark, sf):
    return _numbers(spark)[0]


@query(f"WITH {NUMBERS_SQL} SELECT l.doc_id, l.ord, coalesce(n.number, l.text) AS new_text FROM {values('links', 'l')} LEFT JOIN numbers n ON n.doc_id = l.doc_id AND n.key = l.anchor")
def j11_restored_links(spark, sf):
    return R.restored_links(N.overlaid(*_numbers(spark)), fixture(spark, "links")).select("doc_id", "ord", "new_text")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'k', '5'), (1, 'alias', '5'), (1, 'lost', 'seen')) AS t(doc_id, key, number)")
def e7_label_overlay(spark, sf):
    one = lambda n: spark.createDataFrame([(1, "k", n)], "doc_id long, key string, number string")
    aliases = spark.createDataFrame([(1, "alias", "k"), (1, "lost", "gone")], "doc_id long, key string, first string")
    shown = spark.createDataFrame([(1, "gone", "seen")], "doc_id long, key string, text string")
    return N.overlaid(one("5"), one("2"), one("A"), aliases, shown)


@query(f"WITH a AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND regexp_matches(text, '(?i)^\\s*table\\s+\\d+\\s*[.:]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM {values('elements')}), b AS (SELECT *, sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY ord) AS tables FROM a) SELECT doc_id, ord FROM b WHERE run > 0 AND tables = 0 AND kind = 'paragraph'")
def w8_keep_with_next(spark, sf):
    return N.keep_with_next(fixture(spark, "elements"))


@query(f"WITH a AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND regexp_matches(text, '(?i)^\\s*table\\s+\\d+\\s*[.:]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM {values('elements')}) SELECT doc_id, CAST(run AS BIGINT) AS caption_no, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS INTEGER) AS k, ord FROM a WHERE run > 0 AND kind = 'table' AND NOT has_drawing")
def j18_tables_after_captions(spark, sf):
    return N.tables_after_captions(fixture(spark, "elements"))


@query(f"WITH a AS (SELECT doc_id, pos AS l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM {values('captions')} WHERE kind = 'figure'), b AS (SELECT doc_id, ord AS r, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM {values('elements')} WHERE kind = 'table') SELECT doc_id, CAST(k AS INTEGER) AS k, l AS \"left\", r AS \"right\" FROM a JOIN b USING (doc_id, k)")
def j19_zipped(spark, sf):
    return N.zipped(fixture(spark, "captions").filter("kind = 'figure'"), "pos", fixture(spark, "elements").filter("kind = 'table'"), "ord")


@query(f"SELECT m.doc_id, m.number, min(c.ord) AS ord FROM (VALUES (CAST(1 AS BIGINT), 2), (1, 4), (1, 6)) AS m(doc_id, number) LEFT JOIN {values('table_captions', 'c')} ON c.doc_id = m.doc_id AND c.number > m.number GROUP BY ALL")
def j21_insertion_points(spark, sf):
    return N.insertion_points(spark.createDataFrame([(1, 2), (1, 4), (1, 6)], "doc_id long, number int"), fixture(spark, "table_captions"))


@query(f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS image_no FROM {values('images')}) SELECT i.doc_id, CAST(image_no AS INTEGER) AS image_no, arg_max(ratio, start) AS ratio FROM i JOIN {values('panels', 'p')} ON p.doc_id = i.doc_id AND p.start < i.pos AND i.pos < p.stop WHERE full_width AND ratio >= 0.5 GROUP BY i.doc_id, image_no")
def t6_image_widths(spark, sf):
    return N.image_widths(fixture(spark, "images"), fixture(spark, "panels"))


# Runs and layout over fixtures.


def _source(spark):
    w = fixture(spark, "source_words").withColumn("word", F.lower("text"))
    return w.select("doc_id", "word").distinct(), V.adjacent_pairs(w, ("doc_id", "page_no", "block_no", "line_no"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), CAST(0 AS INTEGER), true), (1, 0, 1, true), (1, 1, 0, false), (1, 2, 0, false), (1, 3, 0, false), (1, 4, 0, true), (1, 5, 0, false), (1, 6, 0, true), (1, 7, 0, true), (1, 8, 0, true), (1, 9, 0, false), (1, 10, 0, true), (1, 11, 0, false)) AS t(doc_id, container_no, run_no, space)")
def w5_f13_restored_spaces(spark, sf):
    words, pairs = _source(spark)
    vocab = spark.createDataFrame([(1, w) for w in ("the",)], "doc_id long, word string")
    return V.restore_spaces(fixture(spark, "runs"), vocab, words, pairs).select("doc_id", "container_no", "run_no", "space")


@query(f"WITH e AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after FROM {values('elements')} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord FROM e WHERE kind = 'paragraph' AND regexp_replace(text, {STRIP}) = '' AND NOT has_drawing AND NOT has_break AND NOT is_section_end AND before IN ('paragraph', 'table') AND after IN ('paragraph', 'table')")
def f16_blanks(spark, sf):
    return L.droppable_blanks(fixture(spark, "elements"))


@query(f"""WITH e AS (SELECT *, regexp_replace(text, {STRIP}) AS t FROM {values('elements')}), b AS (SELECT *, kind = 'paragraph' AND t = '' AND NOT has_drawing AS blank FROM e)
    SELECT doc_id, ord FROM b WHERE kind = 'paragraph' AND regexp_full_match(t, '[0-9]{{1,4}}') AND (is_section_end OR coalesce((SELECT n.kind = 'section' OR n.blank AND n.is_section_end FROM b n WHERE n.doc_id = b.doc_id AND n.ord > b.ord AND NOT (n.blank AND NOT n.is_section_end) ORDER BY n.ord LIMIT 1), true))""")
def f17_page_numbers(spark, sf):
    return L.page_number_paragraphs(fixture(spark, "elements"))


@query(f"SELECT doc_id, ord, true AS hold, has_drawing OR regexp_matches(text, '^\\s*\\([a-z]\\)\\s') AS keep_next FROM {values('elements')} WHERE kind = 'paragraph' AND (has_drawing OR regexp_matches(text, '{CAPTION_SQL}'))")
def w9_figure_flags(spark, sf):
    return L.figure_flags(fixture(spark, "elements"))


@query(f"SELECT DISTINCT doc_id, page_no, page_no = 1 AS kept FROM {values('elements')}")
def j22_kept_breaks(spark, sf):
    return L.kept_breaks(fixture(spark, "elements").select("doc_id", "page_no").distinct(), spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, page_no int"))


@query(f"SELECT doc_id, count(*) AS elements, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE has_drawing) AS drawings, (SELECT count(*) FROM ({SQL['f17_page_numbers']})) AS page_numbers, (SELECT count(*) FROM ({SQL['f16_blanks']})) AS blanks, (SELECT count(*) FROM ({SQL['w9_figure_flags']})) AS held FROM {values('elements')} GROUP BY doc_id")
def a6_summary(spark, sf):
    return L.summary(fixture(spark, "elements"))


@query("SELECT ord, CASE WHEN ord <= 4 THEN 0 ELSE 1 END AS page_no FROM (SELECT unnest(range(12))::INTEGER AS ord)")
def t20_page_groups(spark, sf):
    return L.page_groups(fixture(spark, "elements"), 2).select("ord", "page_no")


@query("WITH cells AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 3)) AS c(row_no, cell_no, span)), placed AS (SELECT *, sum(span) OVER (PARTITION BY row_no ORDER BY cell_no) - span AS place FROM cells) SELECT row_no, cell_no, CAST((SELECT sum(greatest(round(w * 1440), 1)) FROM (SELECT unnest([1.0, 2.0, 0.5]) AS w, unnest(range(3)) AS i) WHERE i >= place AND i < place + span) AS INTEGER) AS twips FROM placed")
def k6_cell_widths(spark, sf):
    grid = spark.createDataFrame([(1, 0, [1.0, 2.0, 0.5])], "doc_id long, table_no int, widths array<double>")
    cells = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 0, 1, 2), (1, 0, 1, 0, 3)], "doc_id long, table_no int, row_no int, cell_no int, grid_span int")
    return L.cell_widths(grid, cells).select("row_no", "cell_no", "twips")


@query("WITH g AS (SELECT * FROM (VALUES ([1000, 600, 400], 1000), ([100, 100], 500)) AS t(w, a)), h AS (SELECT *, [greatest(round_even(x * a / list_sum(w), 0), 1) FOR x IN w[:-2]] AS head FROM g) SELECT CASE WHEN list_sum(w) <= a THEN w ELSE list_append(head, greatest(a - list_sum(head), 1))::INTEGER[] END AS widths FROM h")
def k8_scaled_grid(spark, sf):
    d = spark.createDataFrame([([1000, 600, 400], 1000), ([100, 100], 500)], "w array<int>, a int")
    return d.select(L.scaled_grid(F.col("w"), F.col("a")).alias("widths"))


@query("SELECT CAST(coalesce(l, 0) + coalesce(r, 0) AS INTEGER) AS p FROM (VALUES (5, 7), (NULL, 5)) AS t(l, r)")
def p22_padding(spark, sf):
    return spark.createDataFrame([(5, 7), (None, 5)], "l int, r int").select(L.cell_padding(F.col("l"), F.col("r")).alias("p"))


# Matching over fixtures.


@query(
    f"""WITH c AS (SELECT *, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS key FROM {values('cells')}), t AS (SELECT doc_id, side, table_no, max(row_no) AS r, max(cell_no) AS c, bool_or(has_drawing) AS drawn, list_distinct(list(key) FILTER (WHERE length(key) >= 4)) AS keys FROM c GROUP BY ALL)
    SELECT doc_id, table_no FROM t s WHERE side = 'source' AND NOT EXISTS (SELECT 1 FROM t x WHERE x.side = 'result' AND x.doc_id = s.doc_id AND NOT x.drawn AND x.r = s.r AND x.c = s.c AND len(list_intersect(s.keys, x.keys)) / len(s.keys) >= 0.35 AND len(list_intersect(s.keys, x.keys)) / len(x.keys) >= 0.55)"""
)
def j13_f19_missing_tables(spark, sf):
    return M.missing_tables(fixture(spark, "cells"))


@query(f"WITH d AS (SELECT doc_id, side, table_no, (max(row_no) + 1) * (max(cell_no) + 1) AS area FROM {values('cells')} GROUP BY ALL) SELECT doc_id, side, table_no, area FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, side ORDER BY area DESC, table_no) = 1")
def a10_largest_table(spark, sf):
    return M.largest_table(fixture(spark, "cells"))


@query(f"SELECT doc_id, side, table_no, list_sort(list_distinct(list(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')))) AS keys FROM {values('cells')} GROUP BY ALL")
def t21_table_cells(spark, sf):
    return M.table_cells(fixture(spark, "cells")).select("doc_id", "side", "table_no", F.sort_array("keys").alias("keys"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), CAST(0 AS INTEGER), true), (1, 0, 1, false)) AS t(doc_id, table_no, row_no, \"drop\")")
def f20_cropped_rows(spark, sf):
    rows = [(1, 0, 0, 0, "north station", "north station NS01"), (1, 0, 0, 1, "NS01", "north station NS01"), (1, 0, 1, 0, "C", "north station NS01"), (1, 0, 1, 1, "Later heading", "north station NS01")]
    return M.cropped_rows(spark.createDataFrame(rows, "doc_id long, table_no int, row_no int, cell_no int, text string, target string"))


def scores_sql(pairs: str) -> str:
    """CTEs (after WITH RECURSIVE) that score how well texts and targets of `pairs` (id, kind, text, target) cover each other: cover (id, score)."""
    inner = r"\p{L}+(?:[''-]\p{L}+)*"
    words = f"SELECT id, kind, regexp_replace(text, '\\s+', '', 'g') AS ka, regexp_replace(target, '\\s+', '', 'g') AS kb, [replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(text, '{inner}')] AS wa, [replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(target, '{inner}')] AS wb FROM ({pairs})"
    return f"""word AS (SELECT *, kind <> 'table' AND len(wa) > 0 AND len(wb) > 0 AS by_word FROM ({words})),
    {blocks_sql("SELECT id, CASE WHEN by_word THEN wa ELSE string_split(ka, '') END AS a, CASE WHEN by_word THEN wb ELSE string_split(kb, '') END AS b FROM word")},
    total AS (SELECT id, CAST(sum(n) AS DOUBLE) AS total FROM block GROUP BY id), ca AS (SELECT id, x, count(*) AS n FROM ea GROUP BY ALL), cb AS (SELECT id, x, count(*) AS n FROM eb GROUP BY ALL), bag AS (SELECT id, CAST(sum(least(ca.n, cb.n)) AS DOUBLE) AS bag FROM ca JOIN cb USING (id, x) GROUP BY id),
    cover AS (
        SELECT id, CASE WHEN by_word THEN coalesce(total, 0) / least(len(wa), len(wb)) WHEN length(ka) < 6 OR kb = '' THEN 0.0 WHEN contains(kb, ka) THEN 1.0
            ELSE greatest(coalesce(total, 0) / least(length(ka), length(kb)), CASE WHEN length(kb) <= 60 THEN coalesce(bag, 0) / greatest(length(ka), length(kb)) ELSE 0.0 END) END AS score FROM word LEFT JOIN total USING (id) LEFT JOIN bag USING (id)
    )"""


ASSIGNED_SQL = f"""duo AS (SELECT row_number() OVER () AS id, e.*, r.region_no, r.text AS target FROM {values('assign_elements', 'e')} JOIN {values('assign_regions', 'r')} USING (doc_id, page_no) WHERE NOT regexp_matches(e.text, '{CAPTION_SQL}')), {scores_sql('SELECT * FROM duo')},
    scored AS (SELECT * FROM duo JOIN cover USING (id)), owned AS (SELECT * FROM scored WHERE score > CASE WHEN kind = 'table' THEN 0.5 ELSE 0.75 END QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, ord ORDER BY score DESC, region_no) = 1),
    span AS (SELECT doc_id, page_no, region_no, min(ord) AS lo, max(ord) AS hi FROM owned GROUP BY ALL),
    assigned AS (SELECT doc_id, page_no, region_no, ord, 'owned' AS how FROM owned UNION ALL SELECT s.doc_id, s.page_no, s.region_no, s.ord, 'inside' FROM scored s JOIN span USING (doc_id, page_no, region_no)
        WHERE s.ord > lo AND s.ord < hi AND (s.doc_id, s.page_no, s.ord) NOT IN (SELECT (doc_id, page_no, ord) FROM owned) AND (length(regexp_replace(s.text, '\\s+', '', 'g')) < 6 OR score >= CASE WHEN kind = 'table' THEN 0.5 ELSE 0.6 END))"""
REPLACED_SQL = f"{ASSIGNED_SQL}, own AS (SELECT doc_id, page_no, region_no, min(ord) AS first, count(*) AS n FROM assigned GROUP BY ALL), turns AS (SELECT r.doc_id, r.page_no, r.region_no, first, coalesce(n, 0) AS n, CAST(row_number() OVER (PARTITION BY r.doc_id, r.page_no ORDER BY coalesce(first, 0) DESC, r.region_no) AS INTEGER) AS turn FROM {values('assign_regions', 'r')} LEFT JOIN own USING (doc_id, page_no, region_no))"


@query(f"WITH RECURSIVE {ASSIGNED_SQL} SELECT * FROM assigned")
def j5_j6_assigned(spark, sf):
    return M.assign(fixture(spark, "assign_elements"), fixture(spark, "assign_regions"))


@query(f"WITH RECURSIVE {REPLACED_SQL} SELECT * FROM turns")
def o3_replacement_order(spark, sf):
    return M.replacements(j5_j6_assigned(spark, sf), fixture(spark, "assign_regions"))


@query(f"WITH RECURSIVE {REPLACED_SQL} SELECT doc_id, count(*) FILTER (WHERE n > 0) AS replaced, count(*) FILTER (WHERE n = 0) AS missed FROM turns GROUP BY doc_id")
def a7_replaced_regions(spark, sf):
    return M.replaced(o3_replacement_order(spark, sf))


ORDER_SQL = f"""r AS (SELECT doc_id, record_no, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS rt, row_number() OVER (PARTITION BY doc_id ORDER BY record_no) AS k, count(*) OVER (PARTITION BY doc_id) AS nr FROM {values('order_records')}),
    p AS (SELECT doc_id, ord, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS pt, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, count(*) OVER (PARTITION BY doc_id) AS np FROM {values('order_paragraphs')}),
    duo AS (SELECT row_number() OVER () AS id, * FROM r JOIN p USING (doc_id)), {blocks_sql("SELECT id, string_split(rt, '') AS a, string_split(pt, '') AS b FROM duo WHERE nr <> np AND rt <> ''")},
    ratio AS (SELECT b.doc_id, record_no, k, place, ord, 2.0 * coalesce(sum(n), 0) / any_value(length(rt) + length(pt)) AS ratio FROM duo b LEFT JOIN block USING (id) WHERE nr <> np AND rt <> '' GROUP BY ALL),
    walk AS (
        SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS taken, CAST(NULL AS INTEGER) AS record_no, CAST(NULL AS INTEGER) AS ord, CAST(NULL AS DOUBLE) AS ratio FROM ratio
        UNION ALL
        SELECT doc_id, k, CASE WHEN best[1] >= 0.45 THEN CAST(-best[2] AS BIGINT) ELSE taken END, record_no, CASE WHEN best[1] >= 0.45 THEN ords[CAST(-best[2] AS BIGINT)] END, CASE WHEN best[1] >= 0.45 THEN best[1] END
        FROM (SELECT w.doc_id, x.k, w.taken, x.record_no, max([x.ratio, -x.place]) AS best, map_from_entries(list((x.place, x.ord))) AS ords FROM walk w JOIN ratio x ON x.doc_id = w.doc_id AND x.k = w.k + 1 AND x.place > w.taken GROUP BY ALL)
    )"""


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT doc_id, record_no, ord, ratio FROM walk WHERE ord IS NOT NULL UNION ALL SELECT doc_id, record_no, ord, NULL FROM duo WHERE nr = np AND k = place")
def j9_captions_in_order(spark, sf):
    return M.match_in_order(fixture(spark, "order_records"), fixture(spark, "order_paragraphs"))


@query(
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, columns ORDER BY record_no) AS k FROM (VALUES (CAST(1 AS BIGINT), 0, 2), (1, 1, 2), (1, 2, 3)) AS t(doc_id, record_no, columns)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, columns ORDER BY table_no) AS k FROM (VALUES (CAST(1 AS BIGINT), 0, 3), (1, 1, 5), (1, 2, 2), (1, 3, 2), (1, 4, 2)) AS t(doc_id, table_no, columns))"
    " SELECT doc_id, record_no, table_no FROM w JOIN o USING (doc_id, columns, k)"
)
def j20_first_unused(spark, sf):
    w = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 3)], "doc_id long, record_no int, columns int")
    t = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (1, 2, 2), (1, 3, 2), (1, 4, 2)], "doc_id long, table_no int, columns int")
    return M.first_unused(w, t)


# Reconciliation over fixtures.


@query(f"SELECT DISTINCT doc_id, key FROM {values('cited')} EXCEPT SELECT doc_id, key FROM {values('entries')}")
def j15_undefined_citations(spark, sf):
    return R.undefined(fixture(spark, "cited"), fixture(spark, "entries"))


@query(f"SELECT DISTINCT doc_id, key FROM {values('references', 'r')} EXCEPT SELECT doc_id, label FROM {values('captions')} EXCEPT SELECT doc_id, label FROM {values('headings')}")
def u9_undefined_references(spark, sf):
    labels = fixture(spark, "captions").select("doc_id", F.col("label").alias("key")).unionByName(fixture(spark, "headings").select("doc_id", F.col("label").alias("key")))
    return R.undefined(fixture(spark, "references"), labels)


@query(f"""WITH t AS (SELECT doc_id, key, arg_max(title, file_no) AS title FROM {values('entries')} GROUP BY ALL), n AS (SELECT *, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS norm FROM t WHERE (doc_id, key) IN (SELECT (doc_id, key) FROM {values('cited')}))
    SELECT doc_id, key, title FROM n WHERE length(norm) >= 8 AND NOT EXISTS (SELECT 1 FROM {values('bibliography', 'b')} WHERE b.doc_id = n.doc_id AND contains(array_to_string(regexp_extract_all(lower(b.text), '[a-z0-9]+'), ' '), norm))""")
def j16_absent_titles(spark, sf):
    return R.absent_titles(fixture(spark, "cited"), fixture(spark, "entries"), fixture(spark, "bibliography"))


@query(f"WITH {NUMBERS_SQL}, last AS (SELECT doc_id, anchor AS key, arg_max(text, ord) AS text FROM {values('links')} GROUP BY ALL) SELECT doc_id, key, text, CASE WHEN text IS NULL THEN 'missing' ELSE 'different' END AS finding FROM numbers LEFT JOIN last USING (doc_id, key) WHERE text IS NULL OR text <> number")
def j17_links(spark, sf):
    return R.links(N.overlaid(*_numbers(spark)), fixture(spark, "links")).select("doc_id", "key", "text", "finding")


@query(f"SELECT doc_id, anchor AS key, arg_min(text, ord) AS text FROM {values('links')} WHERE NOT regexp_matches(text, '^\\s*\\[.*\\]\\s*$') GROUP BY ALL")
def e7_first_shown(spark, sf):
    return R.first_shown(fixture(spark, "links"))


@query(f"SELECT a.doc_id, 'bibliography' AS what, a.n AS expected, coalesce(b.n, 0) AS found FROM (SELECT doc_id, count(DISTINCT key) AS n FROM {values('cited')} GROUP BY doc_id) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM {values('bibliography')} GROUP BY doc_id) b USING (doc_id) WHERE coalesce(b.n, 0) < a.n")
def u11_a9_fewer(spark, sf):
    return R.fewer(fixture(spark, "cited").distinct(), fixture(spark, "bibliography"), "bibliography")


@query(f"SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(seq)) - 1 AS INTEGER) AS seq, message FROM (SELECT run_id, seq, regexp_replace(message, {STRIP}) AS message FROM {values('messages')}) WHERE message <> '' GROUP BY run_id, message")
def a11_unique_messages(spark, sf):
    return R.unique_messages(fixture(spark, "messages"))


@query("SELECT CAST(1 AS INTEGER) AS status")
def a12_status(spark, sf):
    return R.status(fixture(spark, "messages").filter("false"), fixture(spark, "messages"))


def _records(spark, kind):
    return N.caption_numbers(fixture(spark, "captions")).filter(F.col("kind") == kind).select("doc_id", "prefix", "caption")


def _paragraphs(spark):
    return spark.createDataFrame([(1, 0, "Table 1. Results of the test"), (1, 1, "Figure 1. A map. A map"), (1, 2, "(a) left"), (1, 3, "(b) other")], "doc_id long, ord int, text string")


NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')".format
PARAGRAPHS_SQL = f"para AS (SELECT *, {NORM('text')} AS norm FROM (VALUES (CAST(1 AS BIGINT), 0, 'Table 1. Results of the test'), (1, 1, 'Figure 1. A map. A map'), (1, 2, '(a) left'), (1, 3, '(b) other')) AS p(doc_id, ord, text)), r AS (SELECT doc_id, kind, prefix, caption, {NORM('caption')} AS norm FROM ({SQL['t7_t8_t9_caption_numbers']}))"


@query(f"WITH {PARAGRAPHS_SQL} SELECT doc_id, prefix, caption FROM r WHERE kind <> 'panel' AND prefix IS NOT NULL AND NOT EXISTS (SELECT 1 FROM para p WHERE p.doc_id = r.doc_id AND starts_with(p.text, r.prefix))")
def u2_u6_captions_not_found(spark, sf):
    p = _paragraphs(spark)
    return R.without_prefix(_records(spark, "table").filter("prefix is not null"), p).unionByName(R.without_prefix(_records(spark, "figure"), p))


@query(f"WITH {PARAGRAPHS_SQL} SELECT doc_id, caption FROM r WHERE kind <> 'panel' AND NOT EXISTS (SELECT 1 FROM para p WHERE p.doc_id = r.doc_id AND contains(p.norm, r.norm[:7]))")
def u3_u7_incomplete_captions(spark, sf):
    p = _paragraphs(spark)
    return R.incomplete_captions(_records(spark, "table"), p).unionByName(R.incomplete_captions(_records(spark, "figure"), p)).select("doc_id", "caption")


@query(f"WITH {PARAGRAPHS_SQL} SELECT p.doc_id, p.ord, r.caption FROM para p JOIN r ON r.doc_id = p.doc_id AND r.kind = 'figure' AND (length(p.norm) - length(replace(p.norm, r.norm, ''))) / length(r.norm) > 1")
def u4_doubled_captions(spark, sf):
    return R.doubled_captions(_records(spark, "figure"), _paragraphs(spark))


@query(f"WITH {PARAGRAPHS_SQL} SELECT doc_id, prefix, caption FROM r WHERE kind = 'panel' AND NOT EXISTS (SELECT 1 FROM para p WHERE p.doc_id = r.doc_id AND contains(p.text, r.prefix) AND contains(p.norm, r.norm))")
def u8_missing_panels(spark, sf):
    return R.missing_panels(_records(spark, "panel"), _paragraphs(spark))


# Sources over fixtures.


BARE = r"regexp_replace(text, '(^|[^\\])((?:\\\\)*)%[^\n]*', '\1\2 ', 'g')"


def keys_sql(command: str) -> str:
    """(doc_id, ord, key): parts of the comma lists in a command's braces, outside comments, without white space at their ends."""
    lists = rf"regexp_extract_all({BARE}, '{command}\s*\{{([^}}]+)\}}', 1)"
    return f"SELECT doc_id, unnest(range(len(k))) AS ord, unnest(k) AS key FROM (SELECT doc_id, [x FOR x IN [regexp_replace(y, {STRIP}) FOR y IN string_split(array_to_string({lists}, ','), ',')] IF x <> ''] AS k FROM {values('sources')})"


CITED_SQL = keys_sql(r"\\[a-zA-Z]*cite[a-zA-Z]*\*?(?:\s*\[[^\]]*\])*")
REFERENCED_SQL = keys_sql(r"\\(?:ref|eqref|autoref|pageref|cref|Cref)\*?(?:\s*\[[^\]]*\])*")
DECLARED_SQL = f"SELECT doc_id, CAST(min(ord) AS INTEGER) AS ord, path FROM (SELECT doc_id, ord, CASE WHEN regexp_matches(key, '[^/]\\.[^./]*$') THEN key ELSE key || '.bib' END AS path FROM ({keys_sql(r'\\(?:bibliography|addbibresource)')})) GROUP BY doc_id, path"


@query(f"SELECT DISTINCT doc_id, key FROM ({CITED_SQL})")
def t17_citation_keys(spark, sf):
    return S.citation_keys(fixture(spark, "sources"))


@query(f"SELECT DISTINCT doc_id, key FROM ({REFERENCED_SQL})")
def t18_cross_reference_keys(spark, sf):
    return S.cross_reference_keys(fixture(spark, "sources"))


@query(DECLARED_SQL)
def s9_declared_bibliographies(spark, sf):
    return S.declared_bibliographies(fixture(spark, "sources"))


@query(f"SELECT d.doc_id, d.ord, d.path FROM ({DECLARED_SQL}) d JOIN {values('files', 'f')} ON f.doc_id = d.doc_id AND f.path = d.path")
def s8_bibliography_files(spark, sf):
    return S.bibliography_files(fixture(spark, "sources"), fixture(spark, "files"))


@query(f"""WITH i AS (SELECT doc_id, path, CASE WHEN regexp_matches(path, '[^/]\\.[^./]*$') THEN [path] ELSE [path || e FOR e IN ['.pdf', '.png', '.jpg', '.jpeg', '.svg', '.eps', '.tif', '.tiff']] END AS tries FROM {values('images')} WHERE NOT contains(path, '\\'))
    SELECT doc_id, 'image' AS kind, path FROM i WHERE NOT EXISTS (SELECT 1 FROM {values('files', 'f')} WHERE f.doc_id = i.doc_id AND list_contains(tries, f.path)) UNION ALL SELECT doc_id, 'bibliography', path FROM ({DECLARED_SQL}) d WHERE NOT EXISTS (SELECT 1 FROM {values('files', 'f')} WHERE f.doc_id = d.doc_id AND f.path = d.path)""")
def f21_missing_resources(spark, sf):
    return S.missing_resources(fixture(spark, "images"), fixture(spark, "sources"), fixture(spark, "files"))


@query(f"SELECT f.doc_id, f.path FROM {values('files', 'f')} JOIN (VALUES (CAST(2 AS BIGINT), 'main.pdf'), (1, 'other.pdf')) AS s(doc_id, path) ON s.doc_id = f.doc_id AND regexp_matches(f.path, '\\.(tex|bbl)$') AND regexp_replace(f.path, '\\.[^./]*$', '') = regexp_replace(s.path, '\\.[^./]*$', '')")
def s6_sidecars(spark, sf):
    return S.sidecars(spark.createDataFrame([(2, "main.pdf"), (1, "other.pdf")], "doc_id long, path string"), fixture(spark, "files"))


@query(
    f"SELECT DISTINCT doc_id, unnest([lower(x) FOR x IN regexp_extract_all(regexp_replace(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1 ', 'g'), '\\\\[a-zA-Z@]+', ' ', 'g'), '{Q2}')]) AS word FROM (VALUES (CAST(1 AS BIGINT), concat('\\section sure % hidden', chr(10), '\\x')), (4, 'Plain a')) AS t(doc_id, text)"
)
def s5_sidecar_words(spark, sf):
    rows = [(1, "\\section sure % hidden\n\\x"), (4, "Plain a")]
    return S.sidecar_words(spark.createDataFrame(rows, "doc_id long, text string"))


@query(
    r"WITH e AS (SELECT file_no, unnest(regexp_split_to_array(text, '(?:^|\n)@\w+\s*\{')) AS e FROM " + values("bib") + r"), t AS (SELECT file_no, regexp_extract(e, '^\s*([^,\s]+)', 1) AS key, regexp_extract(e, '\btitle\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\")', 1) AS title FROM e) SELECT file_no, key, title[2:-2] AS title FROM t WHERE title <> ''"
)
def s11_bib_titles(spark, sf):
    return S.bib_titles(fixture(spark, "bib"))


@query(
    f"WITH items AS (SELECT doc_id, path, temporary, unnest(range(CAST(json_array_length(log) AS BIGINT))) AS seq, unnest(json_extract(log, '$[*]')) AS i FROM {values('log')} WHERE json_valid(log)),"
    " told AS (SELECT *, coalesce(nullif(i->>'pretty', ''), nullif(i->>'message', ''), nullif(i->>'type', ''), 'Pandoc warning') AS m FROM items WHERE upper(i->>'verbosity') IN ('WARNING', 'ERROR'))"
    " SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN temporary <> '' THEN replace(m, temporary, coalesce(nullif(path, ''), temporary)) ELSE m END AS message FROM told"
)
def s12_log_messages(spark, sf):
    return S.log_messages(fixture(spark, "log"))


@query("SELECT doc_id, round(w, 6) AS width, round(h, 6) AS height, round(l, 6) AS \"left\", round(r, 6) AS \"right\", round(t, 6) AS top, round(b, 6) AS bottom FROM (VALUES (CAST(1 AS BIGINT), CAST(210 / 25.4 AS DOUBLE), CAST(297 / 25.4 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(2 / 2.54 AS DOUBLE), CAST(10 / 25.4 AS DOUBLE), CAST(2 / 2.54 AS DOUBLE)), (2, 8.5, 11.0, 1.0, 1.0, 1.0, 1.0), (3, 8.5, 11.0, 1.0, 1.0, 1.0, 1.0)) AS t(doc_id, w, h, l, r, t, b)")
def s13_page_layout(spark, sf):
    out = S.page_layout(fixture(spark, "sources"))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, 'w:(?:ascii|hAnsi|cs|eastAsia)="([^"]*)"', 1)) AS name FROM {values('fonts_xml')} WHERE regexp_matches(member, '^word/[^/]*\\.xml$')),
    c AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)(t1x[a-z]*tt|cmtt|lmmono|courier|mono)') THEN 'mono' WHEN regexp_matches(name, '(?i)(termes|newtx|nimbus|times|cm(r|ss|mi|sy|ex)|lmroman|txsy|txmi|txex|txsym|stix)') THEN 'serif' END AS class FROM n) SELECT doc_id, name, class, count(*) AS n FROM c WHERE class IS NOT NULL GROUP BY ALL""")
def f23_a13_font_counts(spark, sf):
    return S.font_counts(fixture(spark, "fonts_xml"))


# LaTeX over a fixture of sources.

PAPER = values("paper")


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Sources without comments; regular expressions suffice for what the fixture nests.
BARE_PAPER = f"bare AS (SELECT doc_id, {BARE} AS t FROM {PAPER})"
#: (doc_id, i, ratio): panels in order, the multiple of a line that their width is.
PANELS_SQL = BARE_PAPER + r""", w AS (SELECT doc_id, regexp_extract_all(t, '\\begin\{subfigure\}(?:\[[^\]]*\])?\{([^}]*)\}', 1) AS w FROM bare), one AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM w),
    panel AS (SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN regexp_matches(x, '^\s*([0-9.]+)?\s*\\(textwidth|linewidth|columnwidth)\s*$') THEN coalesce(try_cast(nullif(regexp_extract(x, '^\s*([0-9.]*)', 1), '') AS DOUBLE), 1.0) END AS ratio FROM one)"""


@query(f"WITH {BARE_PAPER} " + r"SELECT doc_id, unnest(regexp_extract_all(t, '\\caption\*?(?:\[[^\]]*\])?\{([^{}]*)\}', 1)) AS body FROM bare")
def t2_groups(spark, sf):
    """The group behind each caption."""
    return tex.table_of(fixture(spark, "paper"), lambda t: [(tex.group(t, m.end())[0],) for m in tex.commands(t, "caption")], "body string").select("doc_id", "body")


@query(f"SELECT doc_id, CAST(strpos(text, b) - 1 AS INTEGER) AS start, CAST(strpos(text, e) + length(e) - 1 AS INTEGER) AS stop FROM {PAPER} JOIN (VALUES (1, '\\begin{{table}}', '\\end{{table}}'), (3, '\\begin{{table*}}', '\\end{{table*}}')) AS w(d, b, e) ON d = doc_id")
def t4_table_floats(spark, sf):
    return tex.table_of(fixture(spark, "paper"), lambda t: tex.environments(t, tex.TABLES), "start int, stop int").select("doc_id", "start", "stop")


@query(f"WITH {PANELS_SQL} SELECT doc_id, ratio FROM panel WHERE ratio >= 0.5")
def t5_wide_panels(spark, sf):
    return tex.table_of(fixture(spark, "paper"), tex.wide_panels, "start int, stop int, ratio double").select("doc_id", "ratio")


@query("SELECT CAST(2 AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS image, CAST(0.7 AS DOUBLE) AS ratio")
def t6_wide_images(spark, sf):
    return tex.table_of(fixture(spark, "paper"), tex.wide_images, "image int, ratio double").select("doc_id", "image", "ratio")


@query("SELECT CAST(1 AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS number, 'Costs' AS caption")
def t7_w7_table_records(spark, sf):
    return audit.source_records(fixture(spark, "paper"), "tables").select("doc_id", "number", "caption")


@query("SELECT CAST(2 AS BIGINT) AS doc_id, 'Figure 1.' AS prefix, 'Plan' AS caption UNION ALL SELECT 2, '(a)', 'left'")
def t8_t9_figure_records(spark, sf):
    f, p = (audit.source_records(fixture(spark, "paper"), k).select("doc_id", "prefix", "caption") for k in ("figures", "panels"))
    return f.unionByName(p)


@query(f"WITH {PANELS_SQL} SELECT doc_id, i AS ord, ratio FROM panel")
def t10_panel_ratios(spark, sf):
    return tex.table_of(fixture(spark, "paper"), tex.panels, "start int, stop int, ratio double").select("doc_id", "ord", "ratio")


@query(
    f"WITH {BARE_PAPER}" + r""", h AS (SELECT doc_id, regexp_extract_all(t, '\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\{[^{}]*\}(?:\s*\\label\{[^}]*\})*') AS h FROM bare), one AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS x FROM h)
    SELECT doc_id, CAST(i AS INTEGER) AS ord, CASE regexp_extract(x, '^\\([a-z]+)', 1) WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 WHEN 'subsubsection' THEN 3 END AS level, regexp_matches(x, '^\\[a-z]+\*') AS starred, regexp_extract(x, '\{([^{}]*)\}', 1) AS title, array_to_string(regexp_extract_all(x, '\\label\{([^}]*)\}', 1), ',') AS labels FROM one"""
)
def t11_headings(spark, sf):
    f = lambda t: [(h["level"], h["starred"], h["title"], ",".join(h["labels"])) for h in tex.headings(t)]
    return tex.table_of(fixture(spark, "paper"), f, "level int, starred boolean, title string, labels string")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), '\\textwidth', 'l>{\\centering}X*{2}{p{2cm}}'), (3, '4cm', 'XX'), (4, NULL, 'll')) AS t(doc_id, total, spec)")
def t13_column_specs(spark, sf):
    return tex.table_of(fixture(spark, "paper"), tex.column_specs, "total string, spec string").select("doc_id", "total", "spec")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), '-,-,2cm,2cm', 'lcll'), (3, '-,-', 'll'), (4, '-,-', 'll')) AS t(doc_id, widths, letters)")
def t14_t15_columns(spark, sf):
    f = lambda t: [(",".join(w or "-" for w in tex.widths(s)), tex.alignment(s)) for _, s in tex.column_specs(t)]
    return tex.table_of(fixture(spark, "paper"), f, "widths string, letters string").select("doc_id", "widths", "letters")


@query("SELECT CAST(1 AS BIGINT) AS doc_id, concat(chr(10), '\\begin{document}', chr(10), '\\textbf{Table 1.} Costs', chr(10), chr(10), '\\begin{tabular}{lcll}a&b&c&d\\end{tabular}', chr(10), '\\end{document}', chr(10)) AS source")
def t16_standalone_tables(spark, sf):
    return tex.table_of(fixture(spark, "paper"), lambda t: [(s,) for s in tex.standalone_tables(t)], "source string").select("doc_id", "source")


@query(f"WITH {BARE_PAPER} " + r", p AS (SELECT doc_id, regexp_extract_all(t, '\\includegraphics\*?\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}', 1) AS p FROM bare) SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS ord, unnest(p) AS path FROM p")
def s10_images(spark, sf):
    return tex.table_of(fixture(spark, "paper"), lambda t: [(p,) for *_, p in tex.images(t)], "path string")


@query(f"SELECT doc_id, CASE doc_id WHEN 1 THEN replace(replace(text, '\\caption{{Costs}}', ''), '\\begin{{table}}', concat(chr(10), chr(10), '\\textbf{{Table 1.}} Costs', chr(10), chr(10), '\\begin{{table}}')) ELSE text END AS text FROM {PAPER}")
def p16_lifted_captions(spark, sf):
    return fixture(spark, "paper").select("doc_id", tex.rewritten(F.col("text"), tex.lifted_captions).alias("text"))


@query(
    f"SELECT doc_id, CASE doc_id WHEN 1 THEN replace(replace(text, '\\begin{{tabularx}}{{\\textwidth}}{{l>{{\\centering}}X*{{2}}{{p{{2cm}}}}}}', '\\begin{{tabular}}{{lcll}}'), '\\end{{tabularx}}', '\\end{{tabular}}')"
    f" WHEN 3 THEN replace(replace(text, '\\begin{{tabularx}}{{4cm}}{{XX}}', '\\begin{{tabular}}{{ll}}'), '\\end{{tabularx}}', '\\end{{tabular}}')"
    f" WHEN 4 THEN replace(replace(text, concat('a', chr(10), '& b'), 'a & b'), '\\makecell{{d}}', '\\begin{{tabular}}{{c}}d\\end{{tabular}}') ELSE text END AS text FROM {PAPER}"
)
def p17_plain_tables(spark, sf):
    return fixture(spark, "paper").select("doc_id", tex.rewritten(F.col("text"), tex.plain_tables).alias("text"))


@query(f"SELECT doc_id, CASE doc_id WHEN 3 THEN replace(replace(replace(replace(text, '\\begin{{tabularx}}{{4cm}}{{XX}}', '\\begin{{tabular}}{{ll}}'), '\\end{{tabularx}}', '\\end{{tabular}}'), '\\begin{{minipage}}{{4cm}}', ''), '\\end{{minipage}}', '') ELSE text END AS text FROM {PAPER}")
def p18_unboxed_tables(spark, sf):
    return fixture(spark, "paper").select("doc_id", tex.rewritten(F.col("text"), tex.unboxed_tables).alias("text"))


@query(f"SELECT doc_id, CASE doc_id WHEN 4 THEN replace(text, concat('a', chr(10), '& b'), 'a & b') ELSE text END AS text FROM {PAPER}")
def p19_joined_rows(spark, sf):
    return fixture(spark, "paper").select("doc_id", tex.rewritten(F.col("text"), tex.joined_rows).alias("text"))


@query(f"SELECT doc_id, CASE doc_id WHEN 4 THEN replace(text, concat('[ % x', chr(10), ' width=1in]'), '[width=1in]') ELSE text END AS text FROM {PAPER}")
def p21_image_options(spark, sf):
    return fixture(spark, "paper").select("doc_id", tex.rewritten(F.col("text"), tex.flat_image_options).alias("text"))


# Small projections, orders and sets.


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Costs of x by year'), (2, 'plain')) AS t(id, text)")
def p8_plain_captions(spark, sf):
    rows = [(1, "Costs \\emph{of $x$}  by~year"), (2, "plain")]
    return spark.createDataFrame(rows, "id long, text string").select("id", T.plain_caption(F.col("text")).alias("text"))


@query(f"SELECT doc_id, container_no, string_agg(text, '' ORDER BY run_no) AS text, trim(string_agg(text, '' ORDER BY run_no)) AS trimmed FROM {values('runs')} GROUP BY ALL")
def p11_p12_element_texts(spark, sf):
    parts = F.collect_list(F.struct(F.col("run_no").alias("ord"), "text"))
    return fixture(spark, "runs").groupBy("doc_id", "container_no").agg(parts.alias("p")).select("doc_id", "container_no", T.joined(F.col("p")).alias("text"), T.joined(F.col("p"), True).alias("trimmed"))


@query("SELECT array_to_string([x FOR x IN [CASE WHEN p > 0 THEN p || ' pages' END, CASE WHEN r > 0 THEN r || ' regions replaced' END, CASE WHEN s > 0 THEN s || ' spaces restored' END] IF x IS NOT NULL], ', ') AS message FROM (VALUES (3, 0, 2), (0, 0, 0)) AS t(p, r, s)")
def p13_messages(spark, sf):
    d = spark.createDataFrame([(3, 0, 2), (0, 0, 0)], "p int, r int, s int")
    return d.select(T.summary_message(F.col("p"), F.col("r"), F.col("s")).alias("message"))


@query(f"SELECT doc_id, container_no, run_no, coalesce(vert_align IN ('superscript', 'subscript'), false) AS shifted FROM {values('runs')}")
def f14_shifted(spark, sf):
    return fixture(spark, "runs").select("doc_id", "container_no", "run_no", T.is_shifted(F.col("vert_align")).alias("shifted"))


@query(f"SELECT page_no, line FROM (VALUES (0, 'one'), (0, ' 1 '), (0, '2'), (1, '1'), (1, '2')) AS t(page_no, line) WHERE regexp_replace(line, {STRIP}) <> CAST(page_no + 1 AS VARCHAR)")
def f1_own_numbers(spark, sf):
    d = spark.createDataFrame([(0, "one"), (0, " 1 "), (0, "2"), (1, "1"), (1, "2")], "page_no int, line string")
    return d.filter(~T.own_number(F.col("line"), F.col("page_no")))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_no, block_no FROM blocks WHERE math_share >= 0.25")
def f12_seeds(spark, sf):
    return G.blocks(fixture(spark, "spans")).filter(F.col("math_share") >= G.MATH_SHARE).select("doc_id", "page_no", "block_no")


@query(f"SELECT path, lower(regexp_extract(path, '(\\.[^./\\\\]*)$', 1)) IN ('.tex', '.pdf') AS ok FROM {values('files')}")
def f22_accepted_files(spark, sf):
    return fixture(spark, "files").select("path", T.accepts(F.col("path"), ".tex", ".pdf").alias("ok"))


@query(f"WITH RECURSIVE {scores_sql('SELECT * FROM ' + values('covers'))} SELECT id, round(score, 6) AS score FROM cover")
def j2_j3_j4_covers(spark, sf):
    return fixture(spark, "covers").select("id", F.round(M.element_cover("kind", "text", "target"), 6).alias("score"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), CAST(2 AS INTEGER)), (1, 2, 5)) AS t(doc_id, record_no, ord)")
def j10_headings_in_order(spark, sf):
    r = spark.createDataFrame([(1, 0, "Methods", 1), (1, 1, "Deep matter", 3), (1, 2, "Sources", 2)], "doc_id long, record_no int, text string, level int")
    p = spark.createDataFrame([(1, 1, "Methods", 2), (1, 2, "Methods", 1), (1, 3, "Zzz", 1), (1, 5, "Source", 2)], "doc_id long, ord int, text string, level int")
    return M.match_in_order(r, p, by_level=True).select("doc_id", "record_no", "ord")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def e3_labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").intersect(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"))


@query("SELECT source, lang FROM documents INTERSECT ALL SELECT source, lang FROM documents JOIN labels USING (doc_id)")
def e4_bag_intersection(spark, sf):
    """Sources and languages of documents and of labelled documents, as bags."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang")
    labelled = d.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id")
    return d.select("source", "lang").intersectAll(labelled.select("source", "lang"))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages UNION ALL SELECT item_id, 'item' FROM benchmark")
def e5_e6_concatenation(spark, sf):
    one = lambda t, c, k: spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(c).alias("id"), F.lit(k).alias("kind"))
    return one("documents", "doc_id", "document").unionByName(one("pages", "page_id", "page")).unionByName(one("benchmark", "item_id", "item"))


@query("SELECT source, arg_min(doc_id, (-n_chars, doc_id)) AS longest, min(doc_id) AS first_doc FROM documents GROUP BY source")
def o8_o9_first_and_longest(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("longest"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT doc_id, page_no, y0, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0) AS k FROM {values('drawings')}")
def o1_top_order(spark, sf):
    from pyspark.sql import Window

    return fixture(spark, "drawings").select("doc_id", "page_no", "y0", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("y0")).cast("long").alias("k"))


@query(
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, start) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 'a'), (1, 0, 4, 'b'), (1, 1, 0, 'c'), (2, 0, 0, 'z')) AS t(doc_id, page_no, start, words))"
    " SELECT doc_id, words, CAST(k AS INTEGER) AS ord FROM f WHERE k <= 2 UNION ALL SELECT doc_id, 'and ' || (total - 2) || ' more', 3 FROM f WHERE k = 2 AND total > 2"
)
def o5_o6_report(spark, sf):
    f = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 4, "b"), (1, 1, 0, "c"), (2, 0, 0, "z")], "doc_id long, page_no int, start int, words string")
    return R.report(f, 2).select("doc_id", "words", "ord")


@query("WITH b AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 700.0), (1, 1, 690.0), (1, 2, 500.0)) AS t(doc_id, page_no, y1)), o AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, '1 First'), (1, 1, '2.1 Next Part'), (1, 2, 'text')) AS t(doc_id, page_no, opening)) SELECT doc_id, page_no FROM b WHERE y1 < (SELECT max(y1) FROM b x WHERE x.doc_id = b.doc_id) - 90 UNION SELECT doc_id, page_no - 1 FROM o WHERE page_no > 0 AND regexp_matches(opening, '^(\\d+(\\.\\d+)*|[A-H])\\s+[A-Z]')")
def w10_heading_breaks(spark, sf):
    boxes = spark.createDataFrame([(1, 0, 700.0), (1, 1, 690.0), (1, 2, 500.0), (1, 3, None)][:3], "doc_id long, page_no int, y1 double")
    openings = spark.createDataFrame([(1, 0, "1 First"), (1, 1, "2.1 Next Part"), (1, 2, "text")], "doc_id long, page_no int, opening string")
    return G.deliberate_breaks(boxes, openings)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'fewer tables', '0 of 1'), (1, 'table caption not found', 'Table 1.'), (1, 'table caption incomplete', 'Costs'), (2, 'fewer images', '0 of 2'), (2, 'figure caption incomplete', 'Plan'), (2, 'panel not found', 'left'), (3, 'fewer tables', '0 of 1'), (4, 'fewer tables', '0 of 1'), (4, 'fewer images', '0 of 1'), (1, 'link missing', 'tab:cost'), (2, 'link different', 's')) AS t(doc_id, finding, detail)")
def u1_u5_u13_u14_audit(spark, sf):
    e = spark.createDataFrame([(2, 0, "paragraph", "Figure 1. Another", "", False)], "doc_id long, ord int, kind string, text string, style string, has_drawing boolean")
    shown = spark.createDataFrame([(2, 0, "s", "2")], "doc_id long, ord int, anchor string, text string")
    expected = spark.createDataFrame([(1, "tab:cost", "1"), (2, "s", "1")], "doc_id long, key string, number string")
    return audit.audit(fixture(spark, "paper"), e, fixture(spark, "entries"), shown, expected)


@query("SELECT doc_id, finding, detail FROM (VALUES (CAST(1 AS BIGINT), 'citation without an entry', 'k2'), (1, 'citation without an entry', 'k3'), (1, 'fewer bibliography paragraphs', '0 of 3'), (1, 'title not in the bibliography', 'A Study of Rivers'), (1, 'fewer images', '0 of 1'), (1, 'reference to an undefined label', 'tab:res'), (1, 'reference to an undefined label', 'a'), (1, 'reference to an undefined label', 'b'), (2, 'reference to an undefined label', 'fig:map')) AS t(doc_id, finding, detail)")
def u10_u12_audit(spark, sf):
    e = spark.createDataFrame([], "doc_id long, ord int, kind string, text string, style string, has_drawing boolean")
    return audit.audit(fixture(spark, "sources"), e, fixture(spark, "entries"), fixture(spark, "links").limit(0), spark.createDataFrame([], "doc_id long, key string, number string"))


# Readers, decisions and reports over fixtures.

RESULT_XML = {
    "a": '<w:p><w:r><w:t>First wo</w:t></w:r><w:r><w:t>rds here</w:t></w:r><m:oMath><m:r><m:t>x plus yy</m:t></m:r></m:oMath><w:r><w:drawing><d:docPr descr="a \ufb01ne image"/></w:drawing></w:r></w:p><w:tbl><w:tr><w:tc><w:tbl><w:tr><w:tc><w:t>cell</w:t></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>',
    "b": "<w:p><w:r><w:t>It's well-known</w:t></w:r></w:p>",
}


def result_files(spark: SparkSession) -> DataFrame:
    """(path, content): the zipped result documents of which `parts` are the parts, and one that isn't readable."""
    rows = [("c", bytearray(b"no zip"))]
    spaces = " ".join(f'xmlns:{k}="{v.strip("{}")}"' for k, v in (("w", S.WORD_XML), ("m", S.MATH_XML), ("d", S.DRAWING_XML)))
    for path, xml in RESULT_XML.items():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {spaces}><w:body>{xml}</w:body></w:document>")
        rows.append((path, bytearray(out.getvalue())))
    return spark.createDataFrame(rows, "path string, content binary")


@query(f"SELECT * FROM {values('parts')}")
def s1_result_parts(spark, sf):
    return S.result_parts(result_files(spark))


@query(f"SELECT path, [lower(x) FOR x IN regexp_extract_all(replace(string_agg(text, ' ' ORDER BY ord), 'ﬁ', 'fi'), '{Q2}')] AS words FROM {values('parts')} GROUP BY path")
def s1_result_words(spark, sf):
    return S.result_words(S.result_parts(result_files(spark)))


@query(f"SELECT path, count(*) FILTER (WHERE kind = 'drawing') AS drawings, count(*) FILTER (WHERE kind = 'tbl') AS tables FROM {values('parts')} GROUP BY path")
def s16_c3_result_counts(spark, sf):
    return S.result_counts(S.result_parts(result_files(spark)))


@query("SELECT * FROM (VALUES ('ok', 'ok é'), ('bad', concat('ok', chr(65533), ' end')), ('cut', concat('a', chr(65533))), ('empty', '')) AS t(path, text)")
def s7_decoded_sources(spark, sf):
    return S.decoded(fixture(spark, "raw").select("path", F.unhex("hex").alias("content")))


KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in audit.ORDER) + "]"


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position({KINDS_SQL}, replace(finding, 'link different', 'link missing')), detail, finding) AS INTEGER) AS ord, finding, detail FROM ({SQL['u1_u5_u13_u14_audit']})")
def o4_listed_audit(spark, sf):
    return audit.listed(u1_u5_u13_u14_audit(spark, sf))


@query(
    f"SELECT id, starts_with(rest, label) AND (substring(rest, length(label) + 1, 1) = '' OR regexp_matches(substring(rest, length(label) + 1, 1), '\\s')) OR starts_with(label, 'Figure ') AND regexp_matches(rest, '(?i)^Figure\\s+\\d+\\.') AS there FROM (SELECT id, label, regexp_replace(text, '^\\s+', '') AS rest FROM {values('labelled')})"
)
def k13_labels_there(spark, sf):
    return fixture(spark, "labelled").select("id", T.begins_with_label(F.col("text"), F.col("label")).alias("there"))


@query(
    f"WITH f AS (SELECT doc_id, fig_no, count(*) AS n, bool_and(coalesce(ratio >= 0.7, false)) AS wide, row_number() OVER (PARTITION BY doc_id ORDER BY fig_no) AS k FROM {values('figure_panels')} GROUP BY doc_id, fig_no), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM {values('figure_tables')})"
    " SELECT doc_id, fig_no, ord FROM f JOIN t USING (doc_id, k) WHERE n >= 2 AND wide AND rows = 1 AND cells = n"
)
def k11_stacked_figures(spark, sf):
    return N.stacked_figures(fixture(spark, "figure_panels"), fixture(spark, "figure_tables"))


@query(
    f"SELECT s.doc_id, s.image_no, CAST(round(0.5 * 1300) AS BIGINT) AS width, CAST(round_even(s.height * round(0.5 * 1300) / s.width, 0) AS BIGINT) AS height FROM {values('shapes', 's')} WHERE s.image_no < 2 AND (SELECT count(*) FROM {values('shapes', 'x')} WHERE x.doc_id = s.doc_id) = (SELECT count(*) FROM {values('images', 'i')} WHERE i.doc_id = s.doc_id)"
)
def k12_resized_images(spark, sf):
    widths = spark.createDataFrame([(d, i, 0.5) for d in (1, 2) for i in (0, 1)], "doc_id long, image_no int, ratio double")
    return N.resized_images(widths, fixture(spark, "images"), fixture(spark, "shapes"), F.lit(1300))


@query(
    f"SELECT CAST(1 AS BIGINT) AS doc_id, (SELECT count(*) FROM ({SQL['f23_a13_font_counts']})) AS fonts, (SELECT count(*) FROM ({SQL['f17_page_numbers']})) AS page_numbers, (SELECT count(*) FROM ({SQL['j22_kept_breaks']}) WHERE NOT kept) AS breaks_dropped, (SELECT count(*) FROM ({SQL['j22_kept_breaks']}) WHERE kept) AS breaks_kept,"
    f" (SELECT count(*) FROM ({SQL['f16_blanks']})) AS blanks, (SELECT count(*) FROM ({SQL['w9_figure_flags']})) AS held, (SELECT count(*) FROM ({SQL['w5_f13_restored_spaces']}) WHERE space) AS spaces, (SELECT count(*) FROM {values('elements')} WHERE kind = 'paragraph' AND length(text) >= 90) AS justified,"
    f" (SELECT count(*) FROM (SELECT lower(text) AS word FROM {values('source_words')} GROUP BY 1 HAVING count(*) >= 2 UNION SELECT * FROM (VALUES {CONSTANTS}))) AS vocabulary"
)
def a6_counters(spark, sf):
    """All nine counts of a document's conversion."""
    e, breaks = fixture(spark, "elements"), j22_kept_breaks(spark, sf)
    words = fixture(spark, "source_words").select("doc_id", F.lower("text").alias("word"))
    return L.counters(
        fonts=f23_a13_font_counts(spark, sf), page_numbers=L.page_number_paragraphs(e), breaks_dropped=breaks.filter("not kept"), breaks_kept=breaks.filter("kept"), blanks=L.droppable_blanks(e), held=L.figure_flags(e),
        spaces=w5_f13_restored_spaces(spark, sf).filter("space"), justified=e.filter("kind = 'paragraph'").filter(L.justification(F.col("text"), F.lit(False), F.col("has_break")) == "justify"), vocabulary=V.vocabulary(words, "doc_id"),
    )


@query(SQL["p17_plain_tables"])
def p20_subfigure_tables(spark, sf):
    """Tables of subfigures are rewritten by the rule of all tables."""
    return p17_plain_tables(spark, sf)


PARAGRAPH_STATES = [(i, text, justified, has_break) for i, (text, justified, has_break) in enumerate((t, j, b) for t in ("short", "long " * 20, " \n ", "x" * 89, "x" * 90) for j in (False, True) for b in (False, True))]


@query(
    "SELECT id, CASE WHEN (length(text) < 90 OR has_break) AND justified AND trim(text, ' ' || chr(10)) <> '' THEN 'relax' WHEN length(text) >= 90 AND NOT has_break AND NOT justified THEN 'justify' ELSE 'keep' END AS decision FROM (VALUES "
    + ", ".join(f"({i}, '{t}', {j}, {b})" for i, t, j, b in PARAGRAPH_STATES)
    + ") AS t(id, text, justified, has_break)"
)
def f15_decisions(spark, sf):
    d = spark.createDataFrame(PARAGRAPH_STATES, "id int, text string, justified boolean, has_break boolean")
    return d.select("id", L.justification(F.col("text"), F.col("justified"), F.col("has_break")).alias("decision"))
