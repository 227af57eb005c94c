"""Column expressions over text: tokens, keys, predicates, lengths and names. All stay in the JVM except `nfkc` and `casefold`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more characters, of one or more, with marks only between letters, and ASCII alphanumerics.
WORD2 = r"\p{L}(?:\p{L}|['-])+"
WORD1 = r"\p{L}(?:\p{L}|['-])*"
INNER = r"\p{L}+(?:['-]\p{L}+)*"
ASCII = r"[a-z0-9]+"

# Lists, families, sizes and units that results depend on.
LABEL_WORDS = ("figure", "table", "section", "appendix", "equation", "fig", "eq", "chapter", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COMMON_WORDS = ("et", "al", "the", "and", "for", "was", "are", "per", "via", "not", "but", "its", "our", "their", "with", "from", "that", "this")
SERIF = r"(?i)(termes|newtx|nimbus|times|cm(r|ss|mi|sy|ex)|lmroman|t1x(?!.*tt)|txsy|txmi|txex|txsym|stix)"
MONO = r"(?i)(t1x[a-z]*tt|cmtt|lmmono|courier|mono)"
MATH = r"(?i)(NewTX|txsy|txmi|txex|txsym|CM(MI|SY|EX)|MathJax|Math[A-Z]|STIX|Euler|msam|msbm|rsfs|wasy)"
INCHES = {"in": 1.0, "inch": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72, "bp": 1 / 72.27}
TEX_EXACT = {"pt": 1 / 72.27, "bp": 1 / 72}
CAPTION = r"(?iU)^\s*((Table|Figure|Fig\.?)\s*\d+\s*[:.]|\([a-z]\)\s)"
PANEL_CAPTION = r"(?U)^\s*\([a-z]\)\s"
HEADING = r"(?U)^(\d+(\.\d+)*|[A-H])\s+[A-Z]"
STOP = r"[a-z]{2}\.[A-Z][a-z]"
LENGTH = r"(?iU)^\s*(-?\d+(?:\.\d+)?)\s*(in|inch|cm|mm|pt|bp)?\s*$"
RELATIVE = r"^(-?(?:\d+(?:\.\d*)?|\.\d+))\s*\\(?:linewidth|textwidth|columnwidth)\z"
FULL_WIDTH = ("\\linewidth", "\\textwidth", "\\columnwidth")

#: White space at both ends of a text, of any kind, line breaks and control characters that part fields as well.
ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def stripped(text: Column | str) -> Column:
    """Without white space at both ends, of any kind; trim takes blanks only."""
    return F.regexp_replace(text, ENDS, "")


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility composition; null stays null."""
    return F.pandas_udf(_nfkc, "string")(text)


#: Characters that composition may change or join; all others (Latin letters, usual punctuation) stay, and none of them joins with another.
UNSTABLE = "[^\\x00-\\x9F\\xA1-\\xA7\\xA9\\xAB-\\xAE\\xB0\\xB1\\xB6\\xB7\\xBB\\xBF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2010\\u2012-\\u2016\\u2018-\\u201F\\u2020-\\u2022\\u20AC]"


def normalized(text: Column) -> Column:
    """The same as nfkc, but only texts that may change leave the JVM."""
    return F.coalesce(nfkc(F.when(text.rlike(UNSTABLE), text)), text)


def casefold(text: Column | str) -> Column:
    """Full case folding after composition, which differs from lower() for letters like sharp s."""
    return F.pandas_udf(_folded, "string")(text)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column, pattern: str = WORD2) -> Column:
    """Words in order, lower-cased."""
    return F.transform(matches(text, pattern), F.lower)


def strip_tex_comments(text: Column) -> Column:
    """A percent sign after an even run of backslashes, to the end of its line, becomes one space."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)%[^\n]*", "$1 ")


def strip_sidecar_comments(text: Column) -> Column:
    """The simpler rule of sidecar vocabularies: one backslash before the sign protects it."""
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", " ")


def in_comment(text: Column, offset: Column) -> Column:
    """Whether a 0-based offset stands in a comment of its line."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.regexp_extract(before, r"([^\n]*)$", 1).rlike(r"(?<!\\)(?:\\\\)*%")


def inches(value: Column, exact: bool = False) -> Column:
    """A length in inches: a number with a unit, points by default; null if it is none."""
    units = INCHES | (TEX_EXACT if exact else {})
    unit = F.lower(F.regexp_extract(value, LENGTH, 2))
    factor = F.when(unit == "", units["pt"])
    for name, x in units.items():
        factor = factor.when(unit == name, x)
    return F.when(value.rlike(LENGTH), F.regexp_extract(value, LENGTH, 1).cast("double") * factor)


def width_inches(expression: Column, reference: Column) -> Column:
    """A multiple of a reference width, or a length."""
    e = stripped(expression)
    k = F.regexp_extract(e, RELATIVE, 1)
    return F.when(e.rlike(RELATIVE), k.cast("double") * reference).when(e.isin(*FULL_WIDTH), reference).otherwise(inches(e))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def ascii_key(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens, one space between."""
    return F.array_join(matches(F.lower(text), ASCII), " ")


def plain_caption(caption: Column) -> Column:
    """A caption without commands and braces, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(caption, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " "), r"[{}$~]", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def base_font(name: Column) -> Column:
    return F.element_at(F.split(name, r"\+"), -1)


def font_class(name: Column) -> Column:
    """mono before serif, else null."""
    return F.when(name.rlike(MONO), "mono").when(name.rlike(SERIF), "serif")


def is_math_font(name: Column) -> Column:
    return name.rlike(MATH)


def appendix_letter(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA, and so on: bijective base 26, for any number that fits in an integer."""
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(65 + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("n"), F.lit("").alias("s")), step, lambda a: a["s"])


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def is_panel_caption(text: Column) -> Column:
    return text.rlike(PANEL_CAPTION)


def is_heading(text: Column) -> Column:
    return text.rlike(HEADING)


def stops_without_space(text: Column) -> Column:
    """Two lower-case letters, a full stop, a capital, a lower-case letter, all of ASCII."""
    return matches(text, STOP)


def shortened(passage: Column) -> Column:
    """Passages below 90 characters stand, others keep 87 and an ellipsis."""
    return F.when(F.char_length(passage) < 90, passage).otherwise(F.concat(F.substring(passage, 1, 87), F.lit("...")))


def begins_with_label(text: Column, label: Column) -> Column:
    """Whether a paragraph has its label already: the label and white space or nothing; any number will do for a figure."""
    rest = F.regexp_replace(text, r"(?U)^\s+", "")
    after = F.substring(rest, F.char_length(label) + 1, F.lit(1))
    own = F.startswith(rest, label) & ((after == "") | after.rlike(r"(?U)\s"))
    return own | (F.startswith(label, F.lit("Figure ")) & rest.rlike(r"(?iU)^Figure\s+\d+\."))


def is_shifted(vert_align: Column) -> Column:
    return F.coalesce(vert_align.isin("superscript", "subscript"), F.lit(False))


def clamped_spacing(twips: Column) -> Column:
    """Spacing above 400 becomes 240."""
    return F.when(twips > 400, 240).otherwise(twips)


def output_name(path: Column, ext: str = ".docx") -> Column:
    """The path with another extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(ext))


def progress(k: Column, stages: int = 14) -> Column:
    """Rounded percentage; halves go to the even neighbour."""
    return F.bround(100.0 * k / stages).cast("int")


def summary_message(pages: Column, regions: Column, spaces: Column) -> Column:
    """A sentence of the counts that aren't zero."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    return F.concat_ws(", ", part(pages, "pages"), part(regions, "regions replaced"), part(spaces, "spaces restored"))


def column_widths(total: Column, widths: Column) -> Column:
    """Widths of columns, from a total and array<double> in which null is flexible.

    Null if the total or all columns are unknown, or if nothing could be shared out. Fixed widths shrink to fit; flexible
    ones share the remainder, and without any, fixed ones are stretched.
    """
    fixed = F.aggregate(F.filter(widths, lambda w: w.isNotNull()), F.lit(0.0), lambda a, w: a + w)
    flexible = F.size(F.filter(widths, lambda w: w.isNull()))
    known = F.size(widths) - flexible
    scale = F.when((fixed > total) | (flexible == 0), total / F.nullif(fixed, F.lit(0.0))).otherwise(1.0)
    share = F.greatest(total - fixed, F.lit(0.0)) / flexible
    out = F.transform(widths, lambda w: F.when(w.isNull(), share).otherwise(w * scale))
    return F.when(total.isNotNull() & (known > 0) & scale.isNotNull(), out)


def twips(width: Column) -> Column:
    """Inches to 1/1440 inch, at least 1."""
    return F.greatest(F.bround(width * 1440).cast("int"), F.lit(1))


def joined(parts: Column, trimmed: bool = False) -> Column:
    """Text nodes of an element, array<struct<ord, text>>, in order; a paragraph's are trimmed as a whole."""
    text = F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")
    return stripped(text) if trimmed else text


def accepts(path: Column, *extensions: str) -> Column:
    """Whether a file has one of the extensions, in any case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(*extensions)


def own_number(line: Column, page_no: Column) -> Column:
    """Whether a line is the number of its page, counted from 1."""
    return stripped(line) == (page_no + 1).cast("string")
