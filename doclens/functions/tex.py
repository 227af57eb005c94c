"""LaTeX source: balanced groups, environments, captions, headings and table columns.

Nested markup is no regular language, so these are Python functions over one source. `table_of` runs
one over a DataFrame of sources and gives a row for each record; `rewritten` runs a rewriting as a column. Both are Arrow-batched, need no shuffle, and take
null as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comments and escapes are lexed first, so that nothing within them counts.
LEXEME = re.compile(r"%[^\n]*\n?|\\[A-Za-z@]+|\\.|.", re.S)
TAG = re.compile(r"%[^\n]*|\\(begin|end)\s*\{([^}]+)\}|\\.", re.S)
PANEL_WIDTH = re.compile(r"\s*(\d+(?:\.\d+)?)?\s*\\(?:textwidth|linewidth|columnwidth)\s*")
# Command names that are recognised.
HEADINGS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
NUMBERED = {"section": 1, "subsection": 2, "subsubsection": 3}
TABULARS = frozenset({"tabular", "tabularx"})
TABLES = frozenset({"table", "table*"})
FIGURES = frozenset({"figure", "figure*"})
PANELS = frozenset({"subfigure"})

Edit = tuple[int, int, str]


class Tag(NamedTuple):
    opens: bool
    name: str
    start: int
    stop: int


class Caption(NamedTuple):
    start: int
    stop: int
    starred: bool
    text: str | None


class TableColumn(NamedTuple):
    letter: str
    align: str | None
    width: str | None


def edited(text: str, edits: Iterable[Edit]) -> str:
    """All edits, from the last place to the first."""
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def blank(text: str, at: int) -> int:
    """The next place that isn't white space."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def group(text: str, at: int, pair: str = "{}") -> tuple[str | None, int]:
    """The content of the balanced group that begins here, after white space, and the place behind it; (None, at) if none does or it never ends. Comments in it become a space."""
    begin = blank(text, at)
    if begin >= len(text) or text[begin] != pair[0]:
        return None, at
    depth, out = 0, []
    for m in LEXEME.finditer(text, begin):
        x = m[0]
        if x[0] == "%":
            out.append(" ")
            continue
        depth += (x == pair[0]) - (x == pair[1])
        if not depth:
            return "".join(out[1:]), m.end()
        out.append(x)
    return None, at


def optional(text: str, at: int) -> tuple[str | None, int]:
    """A group in square brackets, if one stands here."""
    return group(text, at, "[]")


def commands(text: str, names: str) -> Iterator[re.Match]:
    """Occurrences of a command outside comments; group 1 is its name, group 2 its star."""
    for m in re.finditer(rf"%[^\n]*|\\(?:({names})(?![A-Za-z])(\*)?|[A-Za-z@]+|.)", text, re.S):
        if m[1]:
            yield m


def tags(text: str) -> list[Tag]:
    """Begin and end tags outside comments."""
    return [Tag(m[1] == "begin", m[2], *m.span()) for m in TAG.finditer(text) if m[1]]


def environments(text: str, names: frozenset[str] | set[str]) -> list[tuple[int, int]]:
    """Outermost environments of the names, in order of their ends. An end tag closes the nearest open tag of its name and all in between; one without any is passed over."""
    open_: list[tuple[str, int | None]] = []
    out = []
    for t in tags(text):
        if t.opens:
            outer = any(start is not None for _, start in open_)
            open_.append((t.name, t.start if t.name in names and not outer else None))
            continue
        k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == t.name), None)
        if k is not None:
            start = open_[k][1]
            del open_[k:]
            if start is not None:
                out.append((start, t.stop))
    return out


def captions(text: str) -> list[Caption]:
    """Captions outside comments; text is None where it can't be parsed."""
    out = []
    for m in commands(text, "caption"):
        _, at = optional(text, m.end())
        body, stop = group(text, at)
        out.append(Caption(m.start(), stop, bool(m[2]), body))
    return out


def labels(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[1]) for m in re.finditer(r"\\label\s*\{([^}]+)\}", text)]


def ratio(width: str | None) -> float | None:
    """The multiple of a line width that an expression is."""
    m = PANEL_WIDTH.fullmatch(width or "")
    return float(m[1] or 1) if m else None


def panels(text: str) -> list[tuple[int, int, float | None]]:
    """(start, stop, ratio) of the subfigures."""
    out = []
    for a, b in environments(text, PANELS):
        t = next(t for t in tags(text[a:b]) if t.opens and t.name in PANELS)
        _, at = optional(text, a + t.stop)
        out.append((a, b, ratio(group(text, at)[0])))
    return out


def wide_panels(text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, stop, ratio) of subfigures, nested ones too, that take `least` of a line width; those never closed are none."""
    out, open_ = [], []
    for t in tags(text):
        if t.name not in PANELS:
            continue
        if t.opens:
            _, at = optional(text, t.stop)
            open_.append((t.start, ratio(group(text, at)[0])))
        elif open_:
            start, r = open_.pop()
            if r is not None and r >= least:
                out.append((start, t.stop, r))
    return sorted(out)


def images(text: str) -> list[tuple[int, str | None, str | None]]:
    """(start, options, path) of each image outside comments, in order."""
    out = []
    for m in commands(text, "includegraphics"):
        options, at = optional(text, m.end())
        path = group(text, at)[0]
        out.append((m.start(), options, path.strip() if path else path))
    return out


def wide_images(text: str) -> list[tuple[int, float]]:
    """(image index, ratio) of images of full line width in a wide panel; of nested panels the inner one tells."""
    wide, out = wide_panels(text), []
    for i, (at, options, _) in enumerate(images(text)):
        if options and re.search(r"\bwidth\s*=\s*\\(?:textwidth|linewidth|columnwidth)\b", options) and (around := [p for p in wide if p[0] < at < p[1]]):
            out.append((i, max(around)[2]))
    return out


def table_records(text: str) -> list[dict]:
    """A record for each parsable caption in a table float; those without a star are numbered on."""
    out, n = [], 0
    for k, (a, b) in enumerate(sorted(environments(text, TABLES))):
        for c in captions(text[a:b]):
            if c.text is not None:
                n += not c.starred
                out.append({"float_no": k, "number": None if c.starred else n, "caption": c.text.strip(), "starred": c.starred, "float": text[a:b], "start": a})
    return out


def figure_records(text: str) -> list[dict]:
    """A record for each unstarred caption of a figure float outside its panels. One that can't be parsed takes a number all the same."""
    out, n = [], 0
    for k, (a, b) in enumerate(sorted(environments(text, FIGURES))):
        block = text[a:b]
        inner = environments(block, PANELS)
        for c in captions(block):
            if c.starred or any(p <= c.start < q for p, q in inner):
                continue
            n += 1
            if c.text is not None:
                out.append({"float_no": k, "number": n, "caption": c.text.strip(), "prefix": f"Figure {n}.", "float": block, "start": a})
    return out


def panel_captions(figure: str) -> list[dict]:
    """Captions of a figure's panels, lettered from (a)."""
    out = []
    for a, b, _ in panels(figure):
        for c in captions(figure[a:b]):
            if not c.starred and c.text is not None:
                out.append({"caption": c.text.strip(), "prefix": f"({chr(97 + len(out))})"})
    return out


def headings(text: str) -> list[dict]:
    """Headings with the labels right behind them."""
    out = []
    for m in commands(text, "|".join(HEADINGS)):
        _, at = optional(text, m.end())
        title, at = group(text, at)
        if title is None:
            continue
        names = []
        while label := re.compile(r"\s*\\label\s*\{([^}]+)\}").match(text, at):
            names.append(label[1].strip())
            at = label.end()
        out.append({"start": m.start(), "command": m[1], "level": NUMBERED.get(m[1]), "starred": bool(m[2]), "title": title, "stop": at, "labels": names})
    return out


def appendix_headings(text: str) -> list[dict]:
    """Numbered levels after the first appendix switch, for the counters of doclens.operators.numbering."""
    switch = next(commands(text, "appendix"), None)
    return [h for h in headings(text) if switch and h["start"] > switch.start() and h["level"]]


def columns(spec: str) -> list[TableColumn]:
    """A column specification's columns: their letter, the alignment that a directive before them sets, and their width."""
    out: list[TableColumn] = []
    align, at = None, 0
    piece = re.compile(r"(?P<before>>(?=\{))|(?P<sized>[pmb])|(?P<plain>[lcrXY])|(?P<repeat>\*)|(?P<beside>[@!<])|\\[A-Za-z]+|\\.|.", re.S)
    while m := piece.match(spec, at):
        at = m.end()
        if m.lastgroup in ("before", "beside", "sized"):
            body, at = group(spec, at)
        if m.lastgroup == "before":
            align = next((a for command, a in (("\\centering", "c"), ("\\raggedleft", "r"), ("\\raggedright", "l")) if command in (body or "")), align)
        elif m.lastgroup in ("sized", "plain"):
            out.append(TableColumn(m[0], align, body if m.lastgroup == "sized" else None))
            align = None
        elif m.lastgroup == "repeat":
            count, at = group(spec, at)
            inner, at = group(spec, at)
            if inner and (count or "").strip().isdecimal():
                out += (columns(inner) or [TableColumn("", None, None)]) * int(count)
    return out


def alignment(spec: str) -> str:
    """One letter for each column."""
    return "".join(c.align or (c.letter if c.letter in ("l", "c", "r") and c.letter else "l") for c in columns(spec)) or "l"


def widths(spec: str) -> list[str | None]:
    return [c.width for c in columns(spec) if c.letter]


def tabular_heads(block: str) -> list[tuple[Tag, str | None, str, int]]:
    """(begin tag, total width, column specification, place behind it) of each tabular."""
    out = []
    for t in tags(block):
        if t.opens and t.name in TABULARS:
            total, at = group(block, t.stop) if t.name == "tabularx" else (None, t.stop)
            spec, at = group(block, at)
            if spec is not None:
                out.append((t, total, spec, at))
    return out


def column_specs(block: str) -> list[tuple[str | None, str]]:
    return [(total, spec) for _, total, spec, _ in tabular_heads(block)]


def without_comments(text: str) -> str:
    return re.sub(r"(\\.)|%[^\n]*", lambda m: m[1] or " ", text, flags=re.S)


def joined_rows(text: str) -> str:
    """A line of a tabular that begins with a column separator joins the last line before it that isn't blank or a comment, unless that one ends a row."""

    def join(block: str) -> str:
        out: list[str] = []
        for line in block.splitlines():
            k = next((i for i in range(len(out) - 1, -1, -1) if out[i].strip() and out[i].lstrip()[0] != "%"), None)
            if line.lstrip()[:1] == "&" and k is not None and not re.search(r"\\\\(?:\[[^]]*\])?\s*$", out[k]):
                out[k] = f"{out[k].rstrip()} {line.strip()}"
            else:
                out.append(line)
        return "\n".join(out)

    return edited(text, [(a, b, join(text[a:b])) for a, b in environments(text, TABULARS)])


def plain_tables(text: str) -> str:
    """Tabulars in the simplest form: no stretch tables, one letter per column, cell helpers as small tables, spans by one letter, no partial rules or extra space."""

    def plain(block: str) -> str:
        block = without_comments(block)
        edits: list[Edit] = [(t.start, at, f"\\begin{{tabular}}{{{alignment(spec)}}}") for t, _, spec, at in tabular_heads(block)]
        edits += [(t.start, t.stop, "\\end{tabular}") for t in tags(block) if not t.opens and t.name == "tabularx"]
        block = edited(block, edits)
        edits = []
        for m in commands(block, "makecell|multicolumn"):
            if m[1] == "makecell":
                options, at = optional(block, m.end())
                letter = re.search(r"[lcr]", options or "")
                body, stop = group(block, at)
                if body is not None:
                    edits.append((m.start(), stop, f"\\begin{{tabular}}{{{letter[0] if letter else 'c'}}}{body}\\end{{tabular}}"))
            else:
                _, first = group(block, m.end())
                spec, second = group(block, first)
                if spec is not None and group(block, second)[0] is not None:
                    edits.append((blank(block, first), second, f"{{{alignment(spec)}}}"))
        block = edited(block, edits)
        return joined_rows(re.sub(r"\\(?:(?:cmidrule|cline)\*?(?:\s*\[[^]]*\])?(?:\([^)]*\))?\s*\{[^}]*\}|addlinespace\*?(?:\s*\[[^]]*\])?)", " ", block))

    return edited(text, [(a, b, plain(text[a:b])) for a, b in environments(text, TABULARS)])


def unboxed_tables(text: str) -> str:
    """In table floats with a notes box, the first stretch table becomes a plain one and the boxes' tags go."""
    edits: list[Edit] = []
    for a, b in environments(text, TABLES):
        block, found = text[a:b], tags(text[a:b])
        head = next((h for h in tabular_heads(block) if h[0].name == "tabularx"), None)
        end = next((t for t in found if head and not t.opens and t.name == "tabularx" and t.start >= head[3]), None)
        if end is None or not any(t.opens and t.name == "minipage" for t in found):
            continue
        edits += [(a + head[0].start, a + head[3], f"\\begin{{tabular}}{{{alignment(head[2])}}}"), (a + end.start, a + end.stop, "\\end{tabular}")]
        edits += [(a + t.start, a + (group(block, optional(block, t.stop)[1])[1] if t.opens else t.stop), "") for t in found if t.name == "minipage"]
    return edited(text, edits)


def lifted_captions(text: str) -> str:
    """Captions of table floats as numbered paragraphs before their float."""
    edits: list[Edit] = []
    n = 0
    for a, b in sorted(environments(text, TABLES)):
        lifted = []
        for c in captions(text[a:b]):
            if c.text is None:
                continue
            n += not c.starred
            lifted.append(("" if c.starred else f"\\textbf{{Table {n}.}} ") + c.text.strip())
            edits.append((a + c.start, a + c.stop, ""))
        if lifted:
            edits.append((a, a, "\n\n" + "\n\n".join(lifted) + "\n\n"))
    return edited(text, edits)


def flat_image_options(text: str) -> str:
    """Image options on one line and without comments."""
    edits: list[Edit] = []
    for m in commands(text, "includegraphics"):
        begin = blank(text, m.end())
        body, stop = optional(text, begin)
        if body is not None:
            edits.append((begin, stop, "[" + re.sub(r"[\r\n\t]", " ", body).strip() + "]"))
    return edited(text, edits)


def standalone_tables(text: str) -> list[str]:
    """A source of its own for each top-level tabular of a captioned float: the preamble, its caption and the plain table."""
    begin = next((t for t in tags(text) if t.opens and t.name == "document"), None)
    if begin is None:
        return []
    out = []
    for r in table_records(text):
        caption = r["caption"] if r["starred"] else f"\\textbf{{Table {r['number']}.}} {r['caption']}"
        out += [f"{text[: begin.start]}\n\\begin{{document}}\n{caption}\n\n{plain_tables(r['float'][a:b])}\n\\end{{document}}\n" for a, b in sorted(environments(r["float"], TABULARS)) if tabular_heads(r["float"][a:b])]
    return out


def table_of(docs: DataFrame, f: Callable[[str], Iterable[tuple]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, the fields of schema): a row for each record that f finds in a source."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *r) for i, t in zip(b[id_col], b[text_col]) for k, r in enumerate(f(t or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "ord", *names], dtype=object)

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, ord int, {schema}")


def rewritten(text: Column, f: Callable[[str], str]) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: f(x or "")), "string")(text)
