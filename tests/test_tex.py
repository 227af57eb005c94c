from doclens.functions import tex


def test_groups_balance_and_protect():
    assert tex.group("  {a{b}\\}c}d", 0) == ("a{b}\\}c", 11)
    assert tex.group("{a% }\nb}", 0)[0] == "a b"
    assert tex.group("{a", 0) == (None, 0)
    assert tex.group("x{a}", 0) == (None, 0)


def test_environments_tolerate_bad_nesting():
    t = "\\begin{table}\\begin{x}\\end{table}\\end{x}\\end{table}%\\begin{table}\n\\begin{table}\\begin{table}\\end{table}\\end{table}"
    found = tex.environments(t, tex.TABLES)
    assert [t[a:b] for a, b in found] == ["\\begin{table}\\begin{x}\\end{table}", "\\begin{table}\\begin{table}\\end{table}\\end{table}"]


def test_table_numbers_pass_over_stars():
    t = "\\begin{table}\\caption{One}\\end{table}\\begin{table*}\\caption*{Note}\\caption[s]{Two}\\end{table*}"
    assert [(r["number"], r["caption"]) for r in tex.table_records(t)] == [(1, "One"), (None, "Note"), (2, "Two")]


def test_unparsable_figure_caption_takes_a_number():
    t = "\\begin{figure}\\caption\\end{figure}\\begin{figure}\\begin{subfigure}{.5\\textwidth}\\caption{in}\\end{subfigure}\\caption{Out}\\end{figure}"
    assert [(r["number"], r["caption"]) for r in tex.figure_records(t)] == [(2, "Out")]
    assert tex.panel_captions(tex.figure_records(t)[0]["float"]) == [{"caption": "in", "prefix": "(a)"}]


def test_columns():
    assert tex.alignment(">{\\centering\\arraybackslash}p{2cm}|l*{2}{r@{}X}") == "clrlrl"
    assert tex.widths("p{2cm}l*{2}{m{1in}}") == ["2cm", None, "1in", "1in"]
    assert tex.alignment("") == "l"


def test_plain_tables():
    t = "\\begin{tabularx}{\\textwidth}{lX}a & \\makecell[r]{b\\\\c} % x\n & \\multicolumn{2}{|c|}{d} \\\\\n\\cmidrule(lr){1-2}\\addlinespace[2pt]\n\\end{tabularx}"
    out = tex.plain_tables(t)
    assert out.startswith("\\begin{tabular}{ll}a & \\begin{tabular}{r}b\\\\c\\end{tabular}")
    assert "\\multicolumn{2}{c}{d}" in out and "cmidrule" not in out and "addlinespace" not in out and out.endswith("\\end{tabular}")
    assert tex.plain_tables(out) == out


def test_captions_are_lifted():
    t = "a\\begin{table}\\caption{ One }x\\end{table}"
    assert tex.lifted_captions(t) == "a\n\n\\textbf{Table 1.} One\n\n\\begin{table}x\\end{table}"


def test_notes_boxes_go():
    t = "\\begin{table}\\begin{minipage}{3cm}\\begin{tabularx}{4cm}{XX}a&b\\end{tabularx}n\\end{minipage}\\end{table}"
    assert tex.unboxed_tables(t) == "\\begin{table}\\begin{tabular}{ll}a&b\\end{tabular}n\\end{table}"


def test_image_options():
    assert tex.flat_image_options("\\includegraphics[ width=1in, % c\n height=2in]{a}%\\includegraphics[x]{b}") == "\\includegraphics[width=1in,   height=2in]{a}%\\includegraphics[x]{b}"


def test_wide_images():
    t = "\\includegraphics{x}\\begin{subfigure}{0.6\\textwidth}\\includegraphics[width=\\linewidth]{y}\\end{subfigure}\\begin{subfigure}{.4\\textwidth}\\includegraphics[width=\\linewidth]{z}\\end{subfigure}"
    assert tex.wide_images(t) == [(1, 0.6)]


def test_headings_and_labels():
    h = tex.headings("\\section{A}\\label{a} \\label{b}\\subsection*[s]{B}\\appendix\\section{C}")
    assert [(x["level"], x["starred"], x["title"], x["labels"]) for x in h] == [(1, False, "A", ["a", "b"]), (2, True, "B", []), (1, False, "C", [])]
    assert [x["title"] for x in tex.appendix_headings("\\section{A}\\appendix\\section{C}")] == ["C"]


def test_standalone_tables():
    t = "\\pre\\begin{document}\\begin{table}\\caption{T}\\begin{tabular}{ll}a&b\\end{tabular}\\end{table}\\end{document}"
    assert tex.standalone_tables(t) == ["\\pre\n\\begin{document}\n\\textbf{Table 1.} T\n\n\\begin{tabular}{ll}a&b\\end{tabular}\n\\end{document}\n"]
