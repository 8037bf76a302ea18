"""Visible text of HTML pages, laid out as a reader would see it.

A tokenizer and a tree builder in one pass: an element's start closes what HTML says it
implies (a paragraph before a block, an item before an item, a cell, row or section of a
table before the next), and an end tag closes what is still open inside its element.
Invisible elements and those hidden by attribute or style give no text. Blocks start on
their own lines, with a blank line around paragraphs, headings, lists and tables; items
have markers and are indented by depth; table cells are padded to their columns' widths;
preformatted text keeps its white space.

Numbered lists follow start, reversed, type and the items' values; of closed details only the summary shows.

The builder works on a stack, so depth is no limit, and knows where the nearest open element of each
name is, so that a tag costs the same at any depth. Null html gives an empty text; text
without tags is one block; unclosed and unmatched tags are borne. A cell that spans rows leaves its
columns free in the rows below; one that spans columns is cut where such a cell begins, and spans 1,000 at most, as HTML has it. A column is as wide as its
widest line of WIDEST characters or less; a longer line runs on over its column's end, and what stands right of it follows after two spaces.
Columns that begin beyond REACH characters are set apart by two spaces. Both hold whatever else the table has, and bound the padding of a line. A page of any
length is one row of work, in time linear in its length; repeated rows are each given their text, an empty table gives none, and
columns besides page_id and html play no part, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*)))?""")
_NOTABLE = re.compile("hidden|style|colspan|rowspan|start|display|visibility|open|reversed|type|value", re.I)
#: What may still follow the last ">".
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[(.*)|<[!?].*", re.S)
#: Lines longer than WIDEST don't widen a column; columns beyond REACH aren't aligned.
WIDEST, REACH = 120, 1200
_COMMENT, _NUMBER = re.compile(r"/\*.*?(?:\*/|$)", re.S), re.compile(r"\s*([+-]?\d{1,9})")
_BLANK = re.compile(r"[ \t\n\f\r]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
#: Blank lines around, or only a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset".split())
LINED = frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody tfoot thead tr caption".split())
BLOCKS = SPACED | LINED
#: Start tags that leave head open.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements of svg and math that show no text, and those of svg that do.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
DRAWN = frozenset({"text", "foreignobject"})
#: Where HTML may stand inside svg and math, and the start tags that end them elsewhere.
WITHIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: A paragraph outside of these isn't closed from within.
SCOPES = frozenset("td th caption table button object template marquee applet foreignobject".split())
#: What an element's start closes, and where the search for it ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
CELLS = frozenset({"td", "th", "caption"})


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag, by name in lower case; the first of a name holds."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def styles(value: str) -> dict[str, str]:
    """The declarations of a style attribute: the last of a property holds, important ones before others."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", value).split(";"):
        name, _, what = part.partition(":")
        name, words = name.strip().lower(), what.lower().replace("!", " !").split()
        high = "".join(words).endswith("!important")
        if words and (high or not out.get(name, (False,))[0]):
            out[name] = (high, words[0])
    return {k: v for k, (_, v) in out.items()}


def _integer(value: str | None, default: int | None) -> int | None:
    m = _NUMBER.match(value or "")
    return int(m[1]) if m else default


class Marker:
    """An item's number, which in a reversed list is known when the list ends."""

    __slots__ = ("kind", "number")

    def __init__(self, kind: str, number: int):
        self.kind, self.number = kind, number

    def __str__(self) -> str:
        n, shown = self.number, ""
        if self.kind in ("a", "A") and n > 0:
            while n:
                n, k = divmod(n - 1, 26)
                shown = chr(ord(self.kind) + k) + shown
        elif self.kind in ("i", "I") and 0 < n < 4000:
            for value, sign in ROMAN:
                shown += sign * (n // value)
                n %= value
            shown = shown if self.kind == "I" else shown.lower()
        return f"{shown or self.number}. "


ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


class Flow:
    """Lines of text in the making."""

    __slots__ = ("parts", "breaks", "space", "indent", "marker", "started")

    def __init__(self):
        self.parts, self.breaks, self.space, self.indent, self.marker, self.started = [], 0, False, 0, "", False

    def line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def put(self, text: str) -> None:
        if self.breaks or not self.started:
            if self.started:
                self.parts.append("\n" * self.breaks)
            self.parts.append("  " * max(0, self.indent - bool(self.marker)))
            self.parts.append(self.marker)
            self.breaks, self.marker, self.started, self.space = 0, "", True, False
        elif self.space:
            self.parts.append(" ")
            self.space = False
        self.parts.append(text)

    def words(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if text == " ":
            self.space = True
            return
        if text[0] == " ":
            self.space = True
        self.put(text.strip(" "))
        self.space = text[-1] == " "

    def raw(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.breaks += 1
            if line:
                self.put(line)

    def lines(self, rows: list[str]) -> None:
        for row in rows:
            self.line(1)
            if row:
                self.put(row)

    def text(self) -> str:
        return "".join(map(str, self.parts))


class _Columns:
    """The columns that cells of rows above leave free, as intervals in order."""

    def __init__(self):
        self.starts, self.ends, self.freed = [0], [1 << 60], {}

    def row(self, r: int) -> None:
        """Frees what cells have held up to this row."""
        for a, b in self.freed.pop(r, ()):
            k = bisect_left(self.starts, a)
            if k and self.ends[k - 1] == a:
                k -= 1
                self.ends[k] = b
            else:
                self.starts.insert(k, a)
                self.ends.insert(k, b)
            if k + 1 < len(self.starts) and self.starts[k + 1] == b:
                self.ends[k] = self.ends.pop(k + 1)
                del self.starts[k + 1]

    def take(self, at: int, columns: int, r: int, down: int) -> tuple[int, int]:
        """The first free columns from `at` on, as many as are free of those asked for; held for the rows below too."""
        k = bisect_right(self.starts, at) - 1
        if k < 0 or self.ends[k] <= at:
            k += 1
        a = max(at, self.starts[k])
        b = min(a + columns, self.ends[k])
        if down > 1:
            self.freed.setdefault(r + down, []).append((a, b))
            rest = [(x, y) for x, y in ((self.starts[k], a), (b, self.ends[k])) if x < y]
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, _ in rest], [y for _, y in rest]
        return a, b


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table's rows of cells (text, columns, rows)."""
    width: dict[int, int] = {}
    free, placed = _Columns(), []
    for r, row in enumerate(rows):
        free.row(r)
        at, lines = 0, []  # for each line of the row, its cells
        for text, columns, down in row:
            begin, at = free.take(at, columns, r, down)
            for k, line in enumerate(text.split("\n")):
                if k == len(lines):
                    lines.append([])
                if line:
                    lines[k].append((begin, line))
                if len(line) <= WIDEST and columns == 1:
                    width[begin] = max(width.get(begin, 0), len(line))
        placed.append(lines)
    known = sorted(width)
    before = [0]
    for c in known:
        before.append(before[-1] + width[c])
    out = []
    for lines in placed:
        for cells in lines:
            line, size = [], 0
            for column, text in cells:
                begin = 2 * column + before[bisect_left(known, column)]
                gap = max(begin - size if begin <= REACH else 0, 2 if size else 0)
                line += [" " * gap, text]
                size += gap + len(text)
            out.append("".join(line).rstrip())
    return out


class Page:
    """The stack of open elements and the flow that text goes to; a table's cells are flows of their own."""

    def __init__(self):
        self.open: list[tuple] = []  # name, what it adds to the counts below, what it holds, whether a summary of it is still to show
        self.flow, self.pre = Flow(), 0
        #: Open elements that hide by name, attribute or display; svg outside its texts; hidden visibility.
        self.gone, self.svg, self.unseen = 0, 0, 0
        self.foreign, self.paragraphs = 0, [0]  # open svg and math; open paragraphs by scope
        self.lists: list[list] = []
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        self.tables: list[tuple] = []  # what open tables hold

    def start(self, name: str, rest: str) -> None:
        while self.open and self.open[-1][0] == "head" and name not in HEAD:
            self.pop()
        if self.foreign:
            if name in BREAKOUT:
                self.close({"svg", "math"}, WITHIN)
            if self.foreign and rest.endswith("/") and name not in VOID:
                return
        if name in BLOCKS and self.paragraphs[-1]:
            self.close({"p"}, ())
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name in VOID:
            given = attributes(rest) if rest and name in ("br", "hr") and _NOTABLE.search(rest) else {}
            if not (self.gone or self.svg or self.hides(name, given)[0]) and name in ("br", "hr"):
                if name == "br":
                    self.flow.breaks, self.flow.space = self.flow.breaks + 1, False
                else:
                    self.flow.line(2)
            return
        given = attributes(rest) if rest and _NOTABLE.search(rest) else {}
        adds = self.hides(name, given)
        self.gone, self.svg, self.unseen = self.gone + adds[0], self.svg + adds[1], self.unseen + adds[2]
        self.foreign += name in ("svg", "math")
        self.paragraphs[-1] += name == "p"
        if name in SCOPES:
            self.paragraphs.append(0)
        held: object = None
        if not (self.gone or self.svg):
            f = self.flow
            if name in BLOCKS:
                f.line(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)
            if name in ("ul", "ol", "menu"):
                back = name == "ol" and "reversed" in given
                # kind, next number, step, type of numbers, markers that wait for the list's length
                self.lists.append([name, _integer(given.get("start"), 1), -1 if back else 1, given.get("type", "1").strip(), [] if back and "start" not in given else None])
                f.indent += 1
                held = "list"
            elif name == "li":
                self.item(given)
            elif name in ("dd", "blockquote"):
                f.indent += 1
                held = "indent"
            elif name == "pre":
                self.pre += 1
                held = "pre"
            elif name == "table":
                held = ([], self.flow, self.lists)
                self.tables.append(held)
            elif name == "tr" and (t := self.table()):
                t[0].append([])
            elif name in CELLS and (t := self.table()):
                if name == "caption" or not t[0]:
                    t[0].append([])
                held = (t[0][-1], max(1, min(_integer(given.get("colspan"), 1), 1000)), max(1, _integer(given.get("rowspan"), 1)))
                self.flow, self.lists = Flow(), []
        self.places.setdefault(name, []).append(len(self.open))
        # a closed details still has its summary to show
        self.open.append((name, adds, held, [name == "details" and "open" not in given]))

    def item(self, given: dict[str, str]) -> None:
        """Sets the marker of a list's next item."""
        kind = self.lists[-1] if self.lists else None
        if kind is None or kind[0] != "ol":
            self.flow.marker = "- "
            return
        if (value := _integer(given.get("value"), None)) is not None:
            self.waiting(kind)
            kind[1], kind[4] = value, None
        marker = Marker(given.get("type", kind[3]).strip(), kind[1])
        if kind[4] is not None:
            kind[4].append(marker)
        kind[1] += kind[2]
        self.flow.marker = marker

    @staticmethod
    def waiting(kind: list) -> None:
        """Numbers the items of a reversed list, whose last item is 1."""
        for k, marker in enumerate(kind[4] or ()):
            marker.number = len(kind[4]) - k

    def hides(self, name: str, given: dict[str, str]) -> tuple[int, int, int]:
        """What an element adds to the counts of what hides; less than 0 where it shows again."""
        style = styles(given["style"]) if "style" in given else {}
        gone, svg, unseen = name in UNSEEN or ("hidden" in given and given["hidden"].strip().lower() != "until-found"), 0, 0
        if self.foreign:
            gone = gone or name in UNDRAWN
            style = {**{k: given[k].strip().lower() for k in ("display", "visibility") if k in given}, **style}
        gone = gone or style.get("display") == "none"
        gone = int(gone)
        if name == "details" and "open" not in given:
            gone += 1
        elif name == "summary" and self.open and self.open[-1][0] == "details" and self.open[-1][3][0]:
            self.open[-1][3][0] = False
            gone -= 1
        if name == "svg":
            svg = 1
        elif name in DRAWN:
            svg = -self.svg
        if style.get("visibility") in ("hidden", "collapse"):
            unseen = 1
        elif style.get("visibility") == "visible":
            unseen = -self.unseen
        return gone, svg, unseen

    def table(self):
        return self.tables[-1] if self.tables else None

    def close(self, names, until) -> None:
        """Closes the nearest open element of those names, and what is open inside it, unless an element of `until` lies between."""
        last = lambda of: max((p[-1] for n in of if (p := self.places.get(n))), default=-1)
        if (k := last(names)) >= 0 and k >= last(until):
            while len(self.open) > k:
                self.pop()

    def pop(self) -> None:
        name, adds, held, _ = self.open.pop()
        self.places[name].pop()
        shown = not (self.gone or self.svg)
        self.gone, self.svg, self.unseen = self.gone - adds[0], self.svg - adds[1], self.unseen - adds[2]
        self.foreign -= name in ("svg", "math")
        if name in SCOPES:
            self.paragraphs.pop()
        self.paragraphs[-1] -= name == "p"
        if shown:
            if name in CELLS and held:
                text, parent = self.flow.text(), self.table()
                held[0].append((text, held[1], held[2]))
                self.flow, self.lists = parent[1], parent[2]
                return
            if name == "table" and held:
                self.tables.pop()
                self.flow.line(2)
                self.flow.lines(_table(held[0]))
            elif held == "list":
                self.waiting(self.lists.pop())
                self.flow.indent -= 1
            elif held == "indent":
                self.flow.indent -= 1
            elif held == "pre":
                self.pre -= 1
            if name == "li":
                self.flow.marker = ""
            if name in BLOCKS:
                self.flow.line(2 if name in SPACED and not (name in ("ul", "ol") and self.lists) else 1)

    def text(self, text: str) -> None:
        if self.open and self.open[-1][0] == "head" and text.strip(" \t\n\f\r"):
            self.pop()
        if text and not (self.gone or self.svg or self.unseen):
            text = html.unescape(text) if "&" in text else text
            if self.pre:
                self.flow.raw(text)
            else:
                self.flow.words(text)


def extract(source: str) -> str:
    """The visible text of an HTML source."""
    page, at, size = Page(), 0, len(source)
    low, last = None, source.rfind(">")
    while at < size:
        if at > last:  # no tag ends any more
            m = _TAIL.search(source, at)
            page.text(source[at : m.start()] if m else source[at:])
            if m and m[1]:
                page.text(html.escape(m[1], quote=False))
            break
        m = _TAG.search(source, at)
        if m is None:
            page.text(source[at:])
            break
        if m.start() > at:
            page.text(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                page.text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "p" and not page.paragraphs[-1]:
                page.start("p", "")
            page.close({name}, CELLS | {"table"} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", *CELLS) else ({"table"} if name != "table" else set()))
            continue
        rest = m[3] if m[2] else m[6]
        page.start(name, rest)
        if name in RAW and not rest.endswith("/"):
            low = source.lower() if low is None else low
            if len(low) != size:  # lower-casing has changed the length
                end_at = re.compile(rf"</{name}", re.I).search(source, at)
                end = end_at.start() if end_at else size
            else:
                end = low.find(f"</{name}", at)
                end = size if end < 0 else end
            if name == "textarea":
                page.text(source[at:end])
            at = end
    while page.open:
        page.pop()
    return page.flow.text()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars for every row of pages (page_id, html)."""

    def run(batches):
        for b in batches:
            text = [extract(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
