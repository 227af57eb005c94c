"""Event-sourced chat formatting, in DataFrame functions only.

A log holds events of conversations, ordered by a sequence number:

* `open`: the turn begins (anew) with the event's role and text;
* `delta`: the text is appended to the turn;
* `edit`: the text replaces the turn's text so far; later deltas are appended to it;
* `regenerate`: the turn's text is emptied, to be streamed again, and all later turns opened before it are dropped.

Events are folded first by turn, then by conversation, so that only finished messages meet in one row. The template is

    <turn:ROLE>\\nTEXT</turn>\\n

and control strings within texts are escaped: a backslash becomes \\b, "<turn:" \\o, "</turn>" \\c (and ">" in roles \\g), so
none stands in an escaped text, and decoding in reverse order gives the text back.

Defined cases: null texts and roles count as empty; an event of unknown kind or null sequence is ignored, as
is a delta, edit or regeneration of a turn that was not opened before it; events of equal sequence are taken in order of kind (open, edit, regenerate, delta) and
text; a null conversation is one conversation of its own; null turns sort first; a conversation without turns has no
row; an empty table gives an empty result; other columns are ignored, whatever their names. The result of a conversation
is one string by its nature: it is the only thing that is gathered, from messages that were folded before. Folding, rendering and reading back take time in proportion to a conversation's length, but for sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import table

OPEN, CLOSE = "<turn:", "</turn>\n"
KINDS = ("open", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\b"), ("<turn:", "\\o"), ("</turn>", "\\c")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\c", "</turn>"), ("\\o", "<turn:"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def fold(events: DataFrame) -> DataFrame:
    """events: (conv_id, seq, kind, turn, role, text). One row per surviving turn: (conv_id, turn, role, text)."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    e = events.filter(F.col("kind").isin(*KINDS) & F.col("seq").isNotNull()).select(
        "conv_id", "turn", F.struct(F.col("seq"), kind.alias("k"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e")
    )
    opened = F.when(F.col("e.k") == 1, F.col("e"))
    turns = (
        e.groupBy("conv_id", "turn")
        .agg(F.sort_array(F.collect_list("e")).alias("log"), F.min(opened).alias("first"), F.max(opened).alias("open"))
        .filter("open is not null")
        .select(
            "conv_id",
            "turn",
            F.col("open.role").alias("role"),
            F.col("open.seq").alias("since"),
            F.array_max(F.transform(F.filter("log", lambda x: (x["k"] == 3) & (x > F.col("first"))), lambda x: x["seq"])).alias("cut"),
            # What counts begins with the last event that sets the text.
            F.filter("log", lambda x: x >= F.col("open")).alias("log"),
        )
        .withColumn("base", F.array_max(F.filter("log", lambda x: x["k"] <= 3)))
        .select(
            "conv_id",
            "turn",
            "role",
            "since",
            F.when(F.col("turn").isNotNull(), F.col("cut")).alias("cut"),
            F.array_join(F.transform(F.filter("log", lambda x: x >= F.col("base")), lambda x: F.when(x["k"] == 3, F.lit("")).otherwise(x["text"])), "").alias("text"),
        )
    )
    # A turn goes if an earlier one was regenerated after its opening.
    until = F.max("cut").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("until", until).filter("until is null or until <= since").select("conv_id", "turn", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """messages: (conv_id, turn, role, text). One row per conversation: (conv_id, formatted, loss_spans array<struct<start,length,turn,offset>>).

    A span's start counts code points from 1 in the whole; turn and offset tell the same place by its turn, so that it is found without a scan.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    m = messages.select(
        "conv_id", "turn", F.concat(head, body, F.lit(CLOSE)).alias("piece"), (F.col("role") == loss_role).alias("loss"), F.char_length(head).alias("before"), F.char_length(body).alias("inside")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "piece")
    at = F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct(
        (at + F.col("before") + 1).cast("long").alias("start"), F.col("inside").cast("long").alias("length"), F.row_number().over(order).alias("turn"), (F.col("before") + 1).cast("int").alias("offset")
    )
    m = m.withColumn("span", span).select("conv_id", F.struct(F.col("span.turn").alias("no"), "piece", F.when(F.col("loss"), F.col("span")).alias("span")).alias("m"))
    spans = F.transform(F.filter("all", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("all")).select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def masked(formatted: Column, loss_spans: Column) -> Column:
    """array<string>: what stands under the loss mask, unescaped."""
    return F.transform(F.array(F.split(formatted, CLOSE)), lambda pieces: F.transform(loss_spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"] - 1), s["offset"], s["length"].cast("int")))))[0]


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    at = lambda x: F.locate(">\n", x)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring(x, F.lit(len(OPEN) + 1), at(x) - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, at(x) + 2, F.char_length(x))).alias("text")
        ),
    )


def event_log(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as the log that streaming them leaves: an opening and two deltas each. Repeated turns stay apart."""
    m = messages.select(
        "conv_id",
        F.struct("turn", "role", "text").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).alias("one"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("one").alias("copies"))
    m = m.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("delta").alias("kind"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(3).alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")),
    )
    return m.select("conv_id", F.struct("turn", "copy").alias("turn"), "role", F.explode(parts).alias("p")).select(
        "conv_id", F.struct(F.col("turn.turn.turn").alias("turn"), F.col("turn.copy").alias("copy"), F.col("p.seq").alias("part")).alias("seq"), "p.kind", "turn", "role", "p.text"
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of each conversation, read back from the formatted output."""
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = render(fold(event_log(rows)))
    return (
        out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
