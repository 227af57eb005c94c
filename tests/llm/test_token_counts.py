import numpy as np
import pytest

from doclens.llm import bpe
from doclens.llm.token_counts import count_documents, summaries_of_blocks, summaries_of_files, write_files


def brute(ids, eod):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == eod:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_flat_files_against_brute_force(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for name in ("a", "b", "empty", "open"):
        ids = rng.choice([1, 2, 9], 200, p=[0.5, 0.4, 0.1]).astype("<u4") if name in "ab" else np.array([] if name == "empty" else [1] * 20, "<u4")
        (tmp_path / name).write_bytes(ids.tobytes())
        want[name] = brute(ids.tolist(), 9)
    got = {k: [] for k in want}
    for r in count_documents(summaries_of_files(spark, str(tmp_path), 9, block=block)).orderBy("file", "doc_no").collect():
        got[r.file.rpartition("/")[2]].append((r.start, r.n_tokens, r.closed))
        assert r.doc_no == len(got[r.file.rpartition("/")[2]]) - 1
    assert got == want


@pytest.mark.parametrize(("dtype", "documents"), [("<u2", 2), ("<u4", 100)])
def test_written_files(spark, tmp_path, dtype, documents):
    """Flat files hold the ids and nothing else, whatever bytes they are, and are counted without an index."""
    texts = ["one two three", None, "", "four\n\u00e9" * 50, "five", "\n\n\r\n"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, value string").coalesce(1)
    e, path = bpe.encoder(bpe.default_path()), str(tmp_path / "flat")
    write_files(docs, path, bpe.default_path(), 50256, dtype=dtype, documents=documents)
    ids = [np.frombuffer(e.encode(t or ""), "<u4") for t in texts]
    files = sorted(f for f in (tmp_path / "flat").iterdir() if f.name.startswith("part-"))
    assert np.concatenate([np.fromfile(f, dtype) for f in files]).tolist() == [x for i in ids for x in [*i.tolist(), 50256]]
    got = count_documents(summaries_of_files(spark, path, 50256, dtype, block=8)).orderBy("file", "doc_no").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in ids] and all(r.closed for r in got)


def test_odd_blocks(spark):
    data = lambda *x: np.array(x, "<u4").tobytes()
    rows = [("a", 0, data(1, 9, 1)), ("a", 0, data(1, 9, 1)), ("a", 0, data(1)), ("a", 1, None), ("a", 2, data(1, 9)), (None, 0, data(9)), ("b", None, data(9)), ("c", 0, None), ("c", 1, b"")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "file string, block long, data binary, seps string, n int")
    got = sorted((r.file, r.doc_no, r.start, r.n_tokens, r.closed) for r in count_documents(summaries_of_blocks(df, 9)).collect())
    assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 2, True)]


def test_no_blocks(spark):
    none = spark.createDataFrame([], "file string, block long, data binary")
    assert count_documents(summaries_of_blocks(none, 9)).count() == 0
