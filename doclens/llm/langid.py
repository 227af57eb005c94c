"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a linear classifier over hashed byte n-grams
predicts it, and the codeword of least weighted loss is chosen. A small gap to the second
codeword marks the answer as ambiguous.

The classifiers are fitted on at most `per_language` labelled rows of each language
(a uniform sample by a hash of the id), the only bounded part; prediction
reads every row and whole texts.

Defined cases: a text that is null, empty or has no letter is `und` with score 0 and
not ambiguous; without any labelled row everything is `und`; with one language it is that one with score 1;
rows with equal or null ids are treated one by one; an empty table gives an
empty result; other columns are ignored by `predict` and kept by `keep_identified`.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import arrow_map, crc_mod, slices, table

#: Letters, and numerals that aren't digits.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


BUCKETS = 4096
ORDERS = (2, 3, 4)


def features(text: str) -> np.ndarray:
    """Hashed counts of byte n-grams of the lower-cased text, damped, of length 1."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    x = np.zeros(BUCKETS, np.float32)
    code = b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        if n in ORDERS:
            x += np.bincount(((code * np.uint32(2654435761)) >> np.uint32(20)), minlength=BUCKETS)
    x = np.sqrt(x)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits for up to 6 languages, else the widest-spaced of random codes."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        bits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(bits, np.float32).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n))))).astype(np.float32)
        m = m[:, np.abs(m.sum(0)) < n]
        d = (m.shape[1] - (m @ m.T)) / 2 + np.eye(n) * 1e9
        if d.min() > far:
            best, far = m, d.min()
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # weight of each bit's loss

    def decide(self, text: str | None, gap: float) -> tuple[str, float, bool, float]:
        """(language, score, ambiguous, gap between the two least losses)."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, False, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, 1.0
        margin = features(text) @ self.weights
        loss = np.logaddexp(0, -4 * self.codes * margin) @ self.trust
        order = np.argsort(loss, kind="stable")
        p = np.exp(-4 * (loss - loss[order[0]]))
        between = float(loss[order[1]] - loss[order[0]])
        return self.languages[order[0]], float(p[order[0]] / p.sum()), between < gap, between


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, ridge: float = 0.3) -> Model:
    """labelled: rows to learn from; null languages and texts without letters are left out. At most about 1.5 * per_language rows of each language, expected, reach the driver."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h"), F.col(id_col).alias("id")).filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.ones((0, 1), np.float32), np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32))
    share: Column = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_language / n))).otherwise(share)
    picked = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) <= share).collect()
    chosen: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["text"] or "")):
        if r["text"] and has_letter(r["text"]) and len(chosen.setdefault(r["lang"], [])) < per_language:
            chosen[r["lang"]].append(r["text"])
    languages = sorted(x for x in chosen if chosen[x])
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((BUCKETS, codes.shape[1]), np.float32), np.ones(codes.shape[1], np.float32))
    # Rows of a language weigh the same in sum, whatever their number.
    x = np.stack([features(t) for lang in languages for t in chosen[lang]]).astype(np.float64)
    y = np.concatenate([np.repeat(codes[i : i + 1], len(chosen[lang]), 0) for i, lang in enumerate(languages)]).astype(np.float64)
    w = np.concatenate([np.full(len(chosen[lang]), len(x) / len(languages) / len(chosen[lang])) for lang in languages])
    gram = x @ x.T
    alpha = np.linalg.solve(gram + np.diag(ridge / w), y)
    weights = (x.T @ alpha).astype(np.float32)
    right = ((x @ weights) * y).mean(0)
    return Model(languages, codes, weights, (np.maximum(right, 0.05) / np.maximum(right, 0.05).sum()).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", gap: float = 0.02) -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row, from the text alone. No shuffle; the model's size is fixed by its parameters."""

    def run(batch):
        got = [model.decide(t, gap) for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "ambiguous": [x[2] for x in got]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", gap: float = 0.005) -> DataFrame:
    """The rows whose text has a language: those without letters and those between two languages go. All columns stay."""
    at = docs.schema.names.index(text_col)

    def run(batches):
        for batch in slices(batches):
            got = (model.decide(t, gap) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and not unsure for lang, _, unsure, _ in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
