"""Token counts of documents in flat token files without an index.

A flat file is a run of ids of two or four bytes in which an end-of-document id closes each document, and nothing else. It is searched in fixed-size blocks of
bytes, wherever document borders fall. Each block is searched for separators with one vectorised comparison;
only their places go on. A prefix scan over the
blocks gives every block its offset and the start of the document that is open at
its beginning, and thereby the documents that cross borders.

Defined cases: an empty document counts 0 tokens; tokens after a file's last separator are a document that is
not closed (`closed` is false); a file without tokens has no rows; null data counts as an empty block;
of repeated blocks (same file and number) the longest counts, then the one whose separators come first; blocks without a file or a number take no part; an empty table gives an empty result; other columns
are ignored, whatever their names; ids that don't fit the width raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm import bpe
from doclens.llm.common import arrow_map, arrow_schema, shared_dir, slices, table, texts, written

#: Tokens in a block: small enough that a batch of rows fits in memory, large enough that the summaries are few; documents in a file that is written.
BLOCK, DOCUMENTS = 1 << 15, 8192


SUMMARY = "file string, block long, n long, seps binary, n_seps long, last long"


def searched(file: str, number: int, data: bytes | memoryview, eod: int, dtype: str) -> tuple:
    """A block's summary: its tokens, where separators stand in it, how many and the last."""
    ids = np.frombuffer(data, dtype, len(data) // np.dtype(dtype).itemsize)
    at = np.flatnonzero(ids == eod).astype(np.int32)
    return file, number, len(ids), at.tobytes(), len(at), int(at[-1]) if len(at) else None


def summaries_of_files(spark: SparkSession, path: str, eod: int, dtype: str = "<u4", block: int = BLOCK) -> DataFrame:
    """Summaries of the blocks of flat files. A file is one row of Spark's binary source, so files should be bounded; its blocks are cut where it is searched, without a copy."""
    step, schema = block * np.dtype(dtype).itemsize, arrow_schema(SUMMARY)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                rows = [searched(file, k, data[at : at + step], eod, dtype) for k, at in enumerate(range(0, len(data), step))]
                yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, SUMMARY)


def summaries_of_blocks(blocks: DataFrame, eod: int, dtype: str = "<u4") -> DataFrame:
    """Summaries of blocks that are rows: (file, block, data)."""

    def run(batch):
        rows = [searched(f, k, d or b"", eod, dtype) for f, k, d in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        return {c.split()[0]: [r[i] for r in rows] for i, c in enumerate(SUMMARY.split(", "))}

    return arrow_map(blocks.filter("file is not null and block is not null").select("file", "block", "data"), run, SUMMARY)


def write_files(docs: DataFrame, path: str, tokenizer: str, eod: int, text_col: str = "text", dtype: str = "<u4", documents: int = DOCUMENTS) -> None:
    """Flat files of ids in the folder `path`: each document's, closed by `eod`, with nothing between; `documents` of them in a file at most.

    Spark's text writer writes the bytes of a row and then a separator, here that of documents, so files go wherever Spark can write.
    """
    most = np.iinfo(dtype).max

    def run(batches):
        e = bpe.encoder(tokenizer)
        for batch in slices(batches):
            ids = [np.frombuffer(e.encode(t), "<u4") for t in texts(batch, 0)]
            if any(len(x) and int(x.max()) > most for x in ids):
                raise ValueError(f"ids don't fit into {dtype}")
            yield pa.RecordBatch.from_pydict({"value": [x.astype(dtype).tobytes() for x in ids]}, pa.schema([("value", pa.binary())]))
        e.forget()

    end = np.array([eod], dtype).tobytes().decode("latin-1")
    rows = docs.select(text_col).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", documents).text(path)


def count_documents(summaries: DataFrame) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed): every document's place and tokens, its separator not counted.

    Tokens stay where they are: a block's summary holds its number of tokens and four bytes for each separator. Summaries are written, as they are read twice.
    """
    s = written(summaries, "separators")
    # Of repeated blocks the first counts.
    order = Window.partitionBy("file", "group").orderBy("block", F.desc("n"), "seps")
    s = s.withColumn("group", F.floor(F.col("block") / 4096)).withColumn("again", F.lag("block").over(order) == F.col("block")).filter("not coalesce(again, false)").drop("again")
    # The scan, in two levels, so that a file of any length is never one task's: within groups of blocks, then over the groups' sums.
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = s.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("doc"))
    within = within.withColumn("end", F.col("at") + F.col("last")).withColumn("open", F.max("end").over(before))
    groups = within.groupBy("file", "group").agg(F.sum("n").alias("gn"), F.sum("n_seps").alias("gs"), F.max("end").alias("gl"), F.max("block").alias("top"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("gn").over(earlier), F.lit(0)).alias("at0"), F.coalesce(F.sum("gs").over(earlier), F.lit(0)).alias("doc0"), "gl", F.max("top").over(Window.partitionBy("file")).alias("final"))
    groups = groups.withColumn("open0", F.max(F.col("at0") + F.col("gl")).over(earlier))
    carry = within.join(groups, ["file", "group"]).select(
        "file",
        "seps",
        "n",
        (F.col("at0") + F.col("at")).alias("at"),
        (F.col("doc0") + F.col("doc")).alias("doc"),
        (F.coalesce(F.col("at0") + F.col("open"), F.col("open0"), F.lit(-1)) + 1).alias("begun"),
        (F.col("block") == F.col("final")).alias("final"),
    )

    def lengths(batch):
        out = {c: [] for c in ("file", "doc_no", "start", "n_tokens", "closed")}
        for file, seps, n, at, doc, begun, final in zip(*(batch.column(i).to_pylist() for i in range(7))):
            ends = np.frombuffer(seps, np.int32).astype(np.int64) + at
            starts = np.concatenate([[begun], ends[:-1] + 1]) if len(ends) else ends
            sizes, closed = (ends - starts).tolist(), [True] * len(ends)
            starts = starts.tolist()
            tail = int(ends[-1]) + 1 if len(ends) else begun
            if final and at + n > tail:
                starts, sizes, closed = [*starts, tail], [*sizes, at + n - tail], [*closed, False]
            out["file"] += [file] * len(sizes)
            out["doc_no"] += range(doc, doc + len(sizes))
            out["start"] += starts
            out["n_tokens"] += sizes
            out["closed"] += closed
        return out

    return arrow_map(carry, lengths, "file string, doc_no long, start long, n_tokens long, closed boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are encoded into flat files in the shared folder, which are then counted without any index."""
    tokenizer = bpe.default_path()
    eod = bpe.encoder(tokenizer).special["<|endoftext|>"]
    path = shared_dir(spark, "tokens")
    write_files(table(spark, sf_dir, "documents"), path, tokenizer, eod, dtype="<u2")
    return count_documents(summaries_of_files(spark, path, eod, "<u2"))
