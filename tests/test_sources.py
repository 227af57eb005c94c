import zipfile

from pyspark.sql import functions as F

from doclens.plans import audit
from doclens.sources import files
from doclens.streaming import audit_stream


def test_result_documents(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    d = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
    xml = f'<w:document xmlns:w="{w}" xmlns:d="{d}"><w:body><w:p><w:r><w:t>First words</w:t></w:r></w:p><w:p><w:drawing><d:docPr descr="an image"/></w:drawing></w:p><w:tbl><w:p><w:t>last</w:t></w:p></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    parts = files.read_results(spark, f"{tmp_path}/*.docx")
    assert [r.words for r in files.result_words(parts).collect()] == [["first", "words", "an", "image", "last"]]
    assert [(r.drawings, r.tables) for r in files.result_counts(parts).collect()] == [(1, 1)]


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"ok \xff end")
    assert files.read_sources(spark, str(tmp_path / "a.tex")).first().text == "ok \ufffd end"


def test_full_audit(spark):
    text = "\\begin{table}\\caption{Costs}\\begin{tabular}{l}a\\end{tabular}\\label{t}\\end{table}\\begin{figure}\\includegraphics{p}\\caption{Plan}\\end{figure}\\cite{k1,k2}\\ref{t}\\ref{u}"
    sources = spark.createDataFrame([(1, text)], "doc_id long, text string")
    elements = spark.createDataFrame([(1, 0, "paragraph", "Table 1. Costs and costs", "", False), (1, 1, "paragraph", "Smith. 1999", "Bibliography", False)], "doc_id long, ord int, kind string, text string, style string, has_drawing boolean")
    entries = spark.createDataFrame([(1, 0, "k1", "A Long Enough Title")], "doc_id long, file_no int, key string, title string")
    shown = spark.createDataFrame([(1, 0, "t", "2")], "doc_id long, ord int, anchor string, text string")
    expected = spark.createDataFrame([(1, "t", "1")], "doc_id long, key string, number string")
    got = {(r.finding, r.detail) for r in audit.audit(sources, elements, entries, shown, expected).collect()}
    assert got == {
        ("fewer tables", "0 of 1"), ("caption twice in a paragraph", "Costs"), ("fewer images", "0 of 1"), ("figure caption not found", "Figure 1."), ("figure caption incomplete", "Plan"),
        ("reference to an undefined label", "u"), ("citation without an entry", "k2"), ("fewer bibliography paragraphs", "1 of 2"), ("title not in the bibliography", "A Long Enough Title"), ("link different", "t"),
    }


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "so done.Then all"), (2, "fine. Then")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        audit_stream.run_once(audit_stream.spacing_findings(audit_stream.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.doc_id, r.stop) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "ne.Th")]
    assert audit_stream.word_counts(docs).filter(F.col("word") == "then").first().n == 2


def test_pages_drop_their_number(spark):
    pages = spark.createDataFrame([(1, 0, "one two\n1\n2"), (1, 1, "2\nthree")], "doc_id long, page_no int, text string")
    assert [r.words for r in audit.page_words(pages).orderBy("page_no").collect()] == [["one", "two"], ["three"]]
