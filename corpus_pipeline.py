"""A corpus pipeline of five stages, each one of the operators in doclens.llm.

Every stage takes what its predecessor kept, in the columns of documents:

1. language ID: documents whose text has no letter, or is between two languages, go;
2. n-gram Jaccard join: of each group of near copies (sets of five words, similarity 0.8) the row of the least id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. PII: personal data in the text is replaced by its kind, and n_chars set anew;
5. BPE: the text becomes token ids, and a decoded copy shows that none was lost.

Defined cases are those of the operators; extra columns stay up to the last stage, which returns doc_id, n_tokens, ids
and whether decoding gives the text back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import bpe, decontaminate, langid, ngram_join, pii
from doclens.llm.common import arrow_map, crc_mod, released, table, texts, written

#: No SQL: classifiers, tilings and merges aren't expressible in it.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = bpe.default_path()

    def run(batch):
        e = bpe.encoder(path)
        ids = [(t, e.encode(t)) for t in texts(batch, 1)]
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) // 4 for _, x in ids],
            "ids": [np.frombuffer(x, "<u4").astype(np.int32) for _, x in ids],
            "round_trip": [e.decode(x) == t for t, x in ids],
        }

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean", lambda: bpe.encoder(path).forget())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{k}")
        released(before)
    return docs
