"""Layout of HTML pages: tables, long inputs, and generated pages whose visible words are known."""

import random
import time

import pytest

from capturelab.llm.html_text import extract as e


def test_spanned_cells():
    assert e("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert e("<table><tr><td>a<td rowspan=3>long one<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>") == "a  long one  c\nd            e\nf            g\nh  i         j"
    assert e("<table><tr><td colspan=2 rowspan=2>xy<td>1<tr><td>2<tr><td>a<td>b<td>3</table>") == "xy    1\n      2\na  b  3"
    assert e("<table><tr><td rowspan=99999>a<td>b</table>") == "a  b"


def test_wide_tables_keep_their_text():
    page = "<table>" + f"<tr><td>{'w' * 50_000}<td>x" + "<tr><td>y<td>z" * 5_000 + "</table>"
    got = e(page)
    assert len(got) < 200_000 and got.count("y  z") == 5_000


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<", "<!", "</b>", "<b>", "<p>", "<table><tr><td>", "<li>", "&amp", "<a x='", "<title>", "<b></i>"])
def test_long_inputs(piece):
    began = time.time()
    e(piece * (300_000 // len(piece)))
    e("<b>" * 20_000 + piece * (100_000 // len(piece)) + ">")
    assert time.time() - began < 12, piece


def test_tail_without_tags():
    assert e("<p>a <b") == "a <b" and e("x<!-- y") == "x" and e("a < b <![CDATA[ c") == "a < b c" and e("1 <2") == "1 <2"


def test_generated_pages_show_the_words_they_show():
    r, n = random.Random(8), [0]
    hiding = ["hidden", "style='display:none'", 'style="x:y;DISPLAY: none"', "style='visibility:hidden'", "hidden=''"]
    harmless = ["class='hidden x'", "aria-hidden=false", "title='hidden'", "id=a", "data-hidden=1", "style='color:red'", ""]

    def page(depth, shown):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if depth == 0 or kind < 0.35:
                n[0] += 1
                word = f"k{n[0]}"
                if shown:
                    want.append(word)
                out.append(r.choice(["", " ", "\n"]) + word + r.choice([" ", "&nbsp;", "<!-- no -->"]) + " ")
            elif kind < 0.5:
                out.append(f"<{(t := r.choice(['div', 'b', 'span', 'section']))} {r.choice(hiding)}>{page(depth - 1, False)}</{t}>")
            elif kind < 0.6:
                out.append(r.choice(["<script>var a = '<b>no</b>';</script>", "<style>p {x: y}</style>", "<template>no</template>", "<noscript>no</noscript>", "<title>no</title>"]))
            elif kind < 0.7:
                out.append("<table>" + "".join(f"<tr>{''.join(f'<td {r.choice(harmless)}>{page(0, shown)}' for _ in range(r.randint(1, 3)))}" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.8:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{page(depth - 1, shown)}" for _ in range(2)) + f"</{t}>")
            else:
                t = r.choice(["div", "article", "span", "em", "h2", "blockquote", "a", "section"])
                out.append(f"<{t} {r.choice(harmless)}>{page(depth - 1, shown)}</{t}>")
        return "".join(out)

    for _ in range(300):
        want: list[str] = []
        source = page(4, True)
        text = e(f"<!doctype html><html><head><title>no</title></head><body>{source}</body></html>")
        assert [w for w in text.replace("\xa0", " ").split() if w.startswith("k")] == want and "no" not in text.split(), source


def test_one_long_cell_leaves_the_others_aligned():
    long = "w" * 9000
    got = e("<table>" + f"<tr><td>{long}<td>x" + "<tr><td>a<td>b<td>c<tr><td>ddd<td>eeee<td>f" * 100 + "</table>").split("\n")
    assert got[0] == f"{long}  x" and got[1] == "a    b     c" and got[2] == "ddd  eeee  f" and got[200] == "ddd  eeee  f"


def drawn(rows):
    """A table of cells without spans, as its definition says: columns as wide as their widest line of 120 characters or less, two spaces apart."""
    lines = [[c.split("\n") for c in row] for row in rows]
    wide = [max((len(x) for row in lines if c < len(row) for x in row[c] if len(x) <= 120), default=0) for c in range(max(map(len, rows)))]
    out = []
    for row in lines:
        for k in range(max(map(len, row))):
            text = ""
            for c, cell in enumerate(row):
                if k < len(cell) and cell[k]:
                    text = (text + "  " if text else "").ljust(sum(w + 2 for w in wide[:c])) + cell[k]
            out.append(text.rstrip())
    return "\n".join(out)


def test_layout_of_small_tables_and_lists():
    r = random.Random(3)
    for _ in range(300):
        rows = [["\n".join("x" * r.choice([1, 2, 5, 9, 119, 120, 121, 300]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 6))]
        cell = lambda t: "<td>" + t.replace("\n", "<br>")
        assert e("<table>" + "".join("<tr>" + "".join(map(cell, row)) for row in rows) + "</table>") == drawn(rows)
    assert e("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert e("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c" and e("<ol reversed start=9><li>a<li>b</ol>") == "9. a\n8. b"
    assert e("<ol type=a start=26><li>a<li>b</ol>") == "z. a\naa. b" and e("<ol type=I><li>a<li>b<li>c<li>d</ol>") == "I. a\nII. b\nIII. c\nIV. d" and e("<ol type=i start=0><li>a</ol>") == "0. a"
    assert e("<ul><li>a<ol reversed><li>b<li>c</ol><li>d</ul>") == "- a\n  2. b\n  1. c\n- d"
    assert e("a<details>no<summary>b</summary><p>no<details open>no</details><summary>no</summary></details>c") == "a\nb\nc" and e("<details open><summary>a</summary>b</details>") == "a\nb"
    assert e("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td colspan=2>d<tr><td>e<td>f</table>") == "a  b  c\n   d\n   e  f"


@pytest.mark.parametrize("page", [lambda n: "<span>" * n + "<td>a" * n, lambda n: "<x><table>" + "<span>" * n + "</x>" * n, lambda n: "<svg>" + "<g>" * n + "<mi><b></b></mi>" * n, lambda n: "<table><tr>" + "<td rowspan=9999>" * n + "<tr><td>x" * n, lambda n: "<table><tr><td>" + "a<br>" * n + "<td>b" * n, lambda n: "<table><tr>" + "<td colspan=1000 rowspan=2>x" * n + "<tr><td>y" * n, lambda n: "<table><tr>" + "".join(f"<td rowspan={2 + k % 97}>" for k in range(n)) + "<tr><td>x" * n, lambda n: "<ol reversed>" + "<li>a" * n])
def test_time_is_linear(page):
    took = []
    for n in (10_000, 20_000):
        began = time.process_time()
        e(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 3 and took[1] < 3.5 * took[0] + 0.2, took
