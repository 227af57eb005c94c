"""Readers: result documents, LaTeX sources, bibliographies, sidecars and converter logs, through Spark's file sources only."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import tex
from doclens.functions import text as T

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MATH_XML = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
DRAWING_XML = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
# Sizes in inches, declarations, commands and extensions that are recognised.
PAPERS = {"a4paper": (210 / 25.4, 297 / 25.4), "a5paper": (148 / 25.4, 210 / 25.4), "letterpaper": (8.5, 11.0), "legalpaper": (8.5, 14.0), "executivepaper": (184.15 / 25.4, 266.7 / 25.4)}
BIBLIOGRAPHY = r"\\(?:bibliography\b|addbibresource\b)\s*(?:\[[^\]]*\]\s*)?\{([^}]+)\}"
CITATION = r"\\[a-zA-Z]*cite[a-zA-Z]*\*?(?:\s*\[[^\]]*\])*\s*\{([^{}]+)\}"
CROSS_REFERENCE = r"\\(?:ref|eqref|autoref|pageref|cref|Cref)\*?(?:\s*\[[^\]]*\])*\s*\{([^{}]+)\}"
IMAGE_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".svg", ".eps", ".tif", ".tiff")
SIDES = ("left", "right", "top", "bottom")
UNTOLD = "Pandoc warning"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, bad bytes replaced."""
    return decoded(spark.read.format("binaryFile").load(path))


def document_parts(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a zipped result document in body order: text, math text and descriptions of images; drawings anywhere, tables of the body itself and those within them (inner)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    kinds = {f"{WORD_XML}t": "text", f"{MATH_XML}t": "math"}
    out, body = [], root.find(f"{WORD_XML}body")
    if body is None:
        return []
    outer = {id(x) for x in body if x.tag == f"{WORD_XML}tbl"}
    for x in body.iter():
        if x.tag in kinds and x.text:
            out.append((kinds[x.tag], x.text))
        elif x.tag == f"{DRAWING_XML}docPr" and x.get("descr"):
            out.append(("image", x.get("descr")))
        elif x.tag in (f"{WORD_XML}p", f"{WORD_XML}tbl", f"{WORD_XML}drawing"):
            out.append(("inner" if x.tag.endswith("tbl") and id(x) not in outer else x.tag.rpartition("}")[2], ""))
    return out


def decoded(contents: DataFrame) -> DataFrame:
    """(path, text): UTF-8 texts of (path, content), bad bytes replaced."""
    return contents.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Parts of the result documents that are read."""
    return result_parts(spark.read.format("binaryFile").load(path).select("path", "content"))


def result_parts(contents: DataFrame) -> DataFrame:
    """(path, ord, kind, text): parts of result documents (path, content); unreadable ones have none."""

    def run(batches):
        for b in batches:
            rows = [(p, i, k, t) for p, c in zip(b["path"], b["content"]) for i, (k, t) in enumerate(document_parts(c))]
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "text"])

    return contents.select("path", "content").mapInPandas(run, "path string, ord int, kind string, text string")


def result_words(parts: DataFrame) -> DataFrame:
    """(path, words): the words of each result in body order; each text node stands for itself."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), " ")
    return parts.groupBy("path").agg(joined.alias("text")).select("path", T.words(T.normalized(F.col("text"))).alias("words"))


def result_counts(parts: DataFrame) -> DataFrame:
    """(path, drawings, tables): drawings anywhere, tables that stand in no other."""
    return parts.groupBy("path").agg(F.count_if(F.col("kind") == "drawing").alias("drawings"), F.count_if(F.col("kind") == "tbl").alias("tables"))


def sidecar_words(texts: DataFrame) -> DataFrame:
    """(doc_id, word): words of LaTeX sidecars without comments and commands."""
    bare = F.regexp_replace(T.strip_sidecar_comments(F.col("text")), r"\\[a-zA-Z@]+", " ")
    return texts.select("doc_id", F.explode(T.words(bare)).alias("word")).distinct()


def sidecars(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path): files beside a source of the same stem with .tex or .bbl. sources: (doc_id, path); files: (doc_id, path)."""
    stem = F.regexp_replace("path", r"\.[^./\\]*$", "")
    wanted = sources.select("doc_id", F.explode(F.array(F.concat(stem, F.lit(".tex")), F.concat(stem, F.lit(".bbl")))).alias("path"))
    return wanted.join(files, ["doc_id", "path"], "left_semi")


def listed_keys(text: Column, pattern: str) -> Column:
    """Trimmed parts of comma lists in a command's braces, outside comments."""
    lists = F.regexp_extract_all(T.strip_tex_comments(text), F.lit(pattern), F.lit(1))
    return F.filter(F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), T.stripped))), lambda k: k != "")


def citation_keys(sources: DataFrame) -> DataFrame:
    return sources.select("doc_id", F.explode(listed_keys(F.col("text"), CITATION)).alias("key")).distinct()


def cross_reference_keys(sources: DataFrame) -> DataFrame:
    return sources.select("doc_id", F.explode(listed_keys(F.col("text"), CROSS_REFERENCE)).alias("key")).distinct()


def declared_bibliographies(sources: DataFrame) -> DataFrame:
    """(doc_id, ord, path): declared files, each once, in order, .bib by default."""
    each = sources.select("doc_id", F.posexplode(listed_keys(F.col("text"), BIBLIOGRAPHY)).alias("ord", "name"))
    path = F.when(F.col("name").rlike(r"[^/]\.[^./]*$"), F.col("name")).otherwise(F.concat("name", F.lit(".bib")))
    return each.groupBy("doc_id", path.alias("path")).agg(F.min("ord").alias("ord")).select("doc_id", "ord", "path")


def bibliography_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Those that exist."""
    return declared_bibliographies(sources).join(files, ["doc_id", "path"], "left_semi").select("doc_id", "ord", "path")


def missing_resources(images: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, kind, path): images of which no candidate file exists (those with a backslash aren't looked for), and bibliographies."""
    plain = images.filter(~F.contains("path", F.lit("\\"))).select("doc_id", F.col("path").alias("name"))
    tries = F.when(F.col("name").rlike(r"[^/]\.[^./]*$"), F.array("name")).otherwise(F.transform(F.array(*map(F.lit, IMAGE_EXTENSIONS)), lambda e: F.concat(F.col("name"), e)))
    found = plain.select("doc_id", "name", F.explode(tries).alias("path")).join(files, ["doc_id", "path"], "left_semi").select("doc_id", "name").distinct()
    lost = plain.join(found, ["doc_id", "name"], "left_anti").select("doc_id", F.lit("image").alias("kind"), F.col("name").alias("path"))
    books = declared_bibliographies(sources).join(files, ["doc_id", "path"], "left_anti").select("doc_id", F.lit("bibliography").alias("kind"), "path")
    return lost.unionByName(books)


HEAD = re.compile(r"@\w+\s*[({]")
KEY = re.compile(r"\s*([^,\s]+)\s*,")
TITLE = re.compile(r"\btitle\s*=\s*", re.I)


def delimited(text: str, at: int) -> str | None:
    """What a value holds that begins here: in quotes, in which a backslash protects, or in braces, which may nest once."""
    if text[at : at + 1] == '"':
        end = at + 1
        while end < len(text) and text[end] != '"':
            end += 2 if text[end] == "\\" else 1
        return text[at + 1 : end] if end < len(text) else None
    depth = 0
    for end in range(at, len(text)):
        depth += (text[end] == "{") - (text[end] == "}")
        if not 1 <= depth <= 2:
            return text[at + 1 : end] if depth == 0 and end > at else None
    return None


def bib_records(text: str) -> list[tuple[str, str]]:
    """(key, title) of the entries that have one, in order. The next entry begins with a line; what comes before the first may share its line."""
    begins = [m.start() for m in HEAD.finditer(text) if not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()]
    out = []
    for a, b in zip([0, *begins], [*begins, len(text)]):
        entry = text[a:b]
        key = next((k for m in HEAD.finditer(entry) if (k := KEY.match(entry, m.end()))), None)
        if key is not None:
            titles = (delimited(entry, m.end()) for m in TITLE.finditer(entry, key.end()))
            title = next((t for t in titles if t is not None), None)
            if title is not None:
                out.append((key[1], title))
    return out


def bib_titles(texts: DataFrame) -> DataFrame:
    """(file_no, key, title): of a key's entries in a file the last tells."""
    each = tex.table_of(texts, bib_records, "key string, title string", "file_no")
    return each.groupBy("file_no", "key").agg(F.max_by("title", "ord").alias("title"))


def log_messages(logs: DataFrame) -> DataFrame:
    """(doc_id, seq, message): warnings and errors of converter logs, each JSON; what can't be read has none.

    logs: (doc_id, log[, path, temporary]): where a temporary source is named, messages tell the path instead (the temporary one if that is null).
    """
    items = F.from_json("log", "array<struct<verbosity:string,pretty:string,message:string,type:string>>", {"mode": "PERMISSIVE"})
    there = {"path", "temporary"} <= set(logs.columns)
    own = [F.col(c) if there else F.lit(None).cast("string").alias(c) for c in ("path", "temporary")]
    e = logs.select("doc_id", *own, F.posexplode(items).alias("seq", "i")).filter(F.upper("i.verbosity").isin("WARNING", "ERROR"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    message = F.coalesce(blank("i.pretty"), blank("i.message"), blank("i.type"), F.lit(UNTOLD))
    shown = F.when(F.col("temporary") != "", F.replace(message, F.col("temporary"), F.coalesce(blank("path"), "temporary"))).otherwise(message)
    return e.select("doc_id", "seq", shown.alias("message"))


def layout_options(text: str) -> list[tuple[str, str]]:
    """(command, option) of the first class, the first list of packages with geometry, and of all calls of it, outside comments, in the order in which they count."""
    text, out = tex.without_comments(text), []
    for name in ("documentclass", "usepackage"):
        for m in tex.commands(text, name):
            options, at = tex.optional(text, m.end())
            argument, _ = tex.group(text, at)
            if argument and (name == "documentclass" or "geometry" in map(str.strip, argument.split(","))):
                out += [(name, x) for x in (options or "").split(",")]
                break
    for m in tex.commands(text, "geometry"):
        out += [("geometry", x) for x in (tex.group(text, m.end())[0] or "").split(",")]
    return out


def page_layout(sources: DataFrame) -> DataFrame:
    """(doc_id, width, height, left, right, top, bottom) in inches: paper of the class, then geometry options, later ones over earlier; letter and one inch by default."""
    rows = tex.table_of(sources, layout_options, "command string, option string")
    key, value = F.lower(T.stripped(F.split("option", "=", 2)[0])), T.stripped(F.get(F.split("option", "=", 2), F.lit(1)))
    rows = rows.select("doc_id", "ord", (F.col("command") == "documentclass").alias("of_class"), key.alias("key"), T.inches(value).alias("inches"), value.isNull().alias("bare"))
    covers = {"left": ("margin", "hmargin", "left"), "right": ("margin", "hmargin", "right"), "top": ("margin", "vmargin", "top"), "bottom": ("margin", "vmargin", "bottom")}
    last = [F.max_by("inches", F.when(~F.col("of_class") & F.col("key").isin(*c) & F.col("inches").isNotNull(), F.col("ord"))).alias(s) for s, c in covers.items()]
    paper = F.col("bare") & F.col("key").isin(*PAPERS)
    of_class, of_geometry = F.min_by("key", F.when(paper & F.col("of_class"), F.col("ord"))), F.max_by("key", F.when(paper & ~F.col("of_class"), F.col("ord")))
    told = rows.groupBy("doc_id").agg(F.coalesce(of_geometry, of_class).alias("paper"), *last)
    out = sources.select("doc_id").distinct().join(told, "doc_id", "left")
    size = lambda i: F.element_at(F.create_map(*(x for k, v in PAPERS.items() for x in (F.lit(k), F.lit(v[i])))), F.coalesce("paper", F.lit("letterpaper")))
    return out.select("doc_id", size(0).alias("width"), size(1).alias("height"), *(F.coalesce(s, F.lit(1.0)).alias(s) for s in SIDES))


def font_counts(members: DataFrame) -> DataFrame:
    """(doc_id, name, class, n): font names in the four attributes of word/*.xml members, with the class that replaces them."""
    names = F.regexp_extract_all("text", F.lit(r'w:(?:ascii|hAnsi|cs|eastAsia)="([^"]*)"'), F.lit(1))
    e = members.filter(F.col("member").rlike(r"^word/[^/]*\.xml$")).select("doc_id", F.explode(names).alias("name"))
    return e.withColumn("class", T.font_class(F.col("name"))).filter("class is not null").groupBy("doc_id", "name", "class").agg(F.count("*").alias("n"))
