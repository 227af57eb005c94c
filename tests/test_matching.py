from doclens.operators import matching as M


def test_cover():
    assert M.cover("short", "shorter text") == 0.0
    assert M.cover("abcdef", "xxabcdefxx") == 1.0
    assert M.cover("abcdefgh", "") == 0.0
    assert 0.8 < M.cover("abcdefghij", "abcdefghiX") < 1


def test_word_fragment_matches_nothing():
    assert M.word_cover("ification", "verification score") == 0.0


def test_assignment(spark):
    from doclens import registry

    got = {(r.region_no, r.ord, r.how) for r in registry.QUERIES["j5_j6_assigned"](spark, "").collect()}
    assert got == {(0, 0, "owned"), (0, 1, "inside"), (0, 2, "owned"), (1, 4, "owned")}


def test_missing_runs(spark):
    words = [f"w{i}" for i in range(12)]
    pages = spark.createDataFrame([(1, 0, words), (2, 0, words), (3, 0, words[:5])], "doc_id long, page_no int, words array<string>")
    results = spark.createDataFrame([(1, words[:3] + words[9:]), (2, words[:3] + words[8:]), (3, [])], "doc_id long, words array<string>")
    assert [(r.doc_id, r.start, r.n) for r in M.missing_runs(pages, results).collect()] == [(1, 3, 6)]


def test_captions_in_order(spark):
    from doclens import registry

    got = {(r.doc_id, r.record_no, r.ord) for r in registry.QUERIES["j9_captions_in_order"](spark, "").collect()}
    assert got == {(1, 0, 3), (1, 1, 8), (2, 0, 1)}
