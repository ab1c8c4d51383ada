"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware renderer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: HTML's kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript datalist title iframe noembed noframes object audio video canvas".split())
#: What svg and math do not draw.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask annotation annotation-xml".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes head html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure listing xmp hr".split())
BLOCK = SPACED | frozenset("address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option section summary body html tr caption search".split())
TABLE = {"tr": frozenset(["tr", "td", "th", "caption"]), "td": frozenset(["td", "th", "caption"]), "th": frozenset(["td", "th", "caption"]), **{k: frozenset("tr td th caption thead tbody tfoot colgroup".split()) for k in ("thead", "tbody", "tfoot", "caption", "colgroup")}}
LISTS = frozenset("ul ol menu dir".split())
#: A tag, comment or declaration; what else begins with < is text.
_MARK = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Open elements that lay text out, and among which tags look for the one that they end; characters to which a column, or a
#: cell over several ones, is padded at most; columns that a cell spans at most, and up to which rows that are spanned count.
DEPTH, COLUMN, SPANNED, COLUMNS = 512, 80, 240, 256
_DISPLAY = re.compile(r"display\s*:\s*([a-z-]+)(\s*!\s*important)?", re.I)
_STYLE = re.compile(r"<style(?=[\s>])[^>]*(?:>|\Z)(.*?)(?:</style|\Z)", re.S | re.I)
_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.I)
_VISIBLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Flow:
    """Lines of one column of text: the page's, or a table cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0  # line ends wanted before the next text
        self.space = False
        self.indent: list[str] = []
        self.bullet = ""

    def text(self, s: str) -> None:
        t = _WHITE.sub(" ", s)
        if t == " " or not t:
            self.space = self.space or bool(t)
            return
        self._open()
        if (t[0] == " " or self.space) and self.parts:
            self.parts.append(" ")
        self.parts.append(t.strip(" "))
        self.space = t[-1] == " "

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self._close(True)
            if line:
                self._open()
                self.parts.append(line)

    def _open(self) -> None:
        if not self.parts:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def _close(self, even_empty: bool = False) -> None:
        if self.parts or even_empty:
            lead = self.margin()
            if self.bullet:
                lead, self.bullet = lead[:len(lead) - len(self.bullet)] + self.bullet, ""
            self.lines.append((lead + "".join(self.parts)).rstrip(" ") if self.parts else "")
            self.parts = []
        self.space = False

    def margin(self) -> str:
        """The innermost indents, of COLUMN characters at most."""
        return "".join(self.indent[-COLUMN:])[-COLUMN:]

    def end_line(self, ends: int = 1) -> None:
        self._close()
        self.gap = max(self.gap, ends)

    def br(self) -> None:
        self._close(True)

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line(2)
        if lines and self.lines and self.lines[-1]:
            self.lines.append("")
        lead = self.margin()
        self.lines += [(lead + x).rstrip() for x in lines]
        self.gap = 2

    def done(self) -> list[str]:
        self._close()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned) with columns aligned and two spaces between them.

    A cell that spans rows keeps later cells out of its columns. Columns of more than COLUMN characters,
    and cells over several columns of more than SPANNED, push what stands right of them in their row;
    others are not padded that far, and a column in which no cell begins takes no room. So a table's text
    grows with its page, and memory with its cells.
    """
    placed, taken = [], {}  # taken: column to the last row that a cell from above fills
    for r, row in enumerate(rows):
        at, cells = 0, []
        for lines, span, down in row:
            while taken.get(at, -1) >= r:
                at += 1
            cells.append((at, lines, span))
            if down != 1:
                for c in range(at, min(at + span, COLUMNS)):
                    taken[c] = r + down - 1 if down else len(rows)
            at += span
        placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for at, lines, span in cells:
            if span == 1:
                width[at] = min(COLUMN, max([width.get(at, 0), *map(len, lines)]))
    # where columns begin in which a cell does, and the end of the last one
    begins = sorted({at for cells in placed for at, _, _ in cells})
    places = [0]
    for c in begins:
        places.append(places[-1] + width.get(c, 0) + 2)
    start = lambda c: places[bisect_left(begins, c)]
    out = []
    for cells in placed:
        for k in range(max([1, *(len(lines) for _, lines, _ in cells)])):
            line, last = "", 0
            for at, lines, span in cells:
                # as far as the last cell's columns reach, but not beyond the limit for what lies between
                gap = min(start(at) - start(last), SPANNED + 2) if last < at else 0
                line += " " * gap
                text = lines[k] if k < len(lines) else ""
                line += text.ljust(min(start(at + span) - start(at) - 2, SPANNED)) + "  "
                last = at + span
            out.append(line.rstrip())
    while out and not out[-1]:
        out.pop()
    return out


def css_rules(css: str):
    """(selectors, declarations) of a style sheet's rules outside at-rules, in one pass; nested and unfinished ones are left aside."""
    depth = deepest = start = 0
    head = body = ""
    for m in re.finditer("[{};]", css):
        if m[0] == "{":
            if not depth:
                head, start, deepest = css[start:m.start()].strip(), m.end(), 0
            depth += 1
            deepest = max(deepest, depth)
        elif m[0] == "}":
            if depth == 1 and deepest == 1 and not head.startswith("@"):
                body = css[start:m.start()]
                yield head, body
            depth = max(0, depth - 1)
            if not depth:
                start = m.end()
        elif not depth and css[start:start + 64].lstrip().startswith("@"):
            start = m.end()


def hiding(html: str) -> dict[str, tuple[bool, bool]]:
    """Simple selectors (tag, .class, #id, tag.class, tag#id) of a page's style elements to whether they hide, and whether that is important.

    The last rule for a selector counts, the last important one before others; at-rules and other
    selectors are left aside.
    """
    out: dict[str, tuple[bool, bool]] = {}
    if "<style" in html or "<STYLE" in html or re.search("<style", html, re.I):
        for m in _STYLE.finditer(html):
            for selectors, body in css_rules(_NOTE.sub("", m[1])):
                if shown := _shown(body):
                    for x in selectors.split(","):
                        if (x := x.strip()) and (simple := _SIMPLE.fullmatch(x)):
                            tag, rest = simple.groups()
                            name = (tag or "").lower() + (rest or "")
                            if shown[1] or not out.get(name, shown)[1]:
                                out[name] = shown
    return out


def _shown(declarations: str) -> tuple[bool, bool] | None:
    """Whether declarations hide and whether that is important; None if they do not say."""
    found = [(v.lower() == "none", bool(i)) for v, i in _DISPLAY.findall(declarations)]
    return next((x for x in reversed(found) if x[1]), found[-1] if found else None)


class Element:
    __slots__ = ("tag", "shown", "visible", "count", "rows", "flow", "span", "down", "opened", "summary", "bullet")

    def __init__(self, tag: str, shown: bool, visible: bool):
        self.tag, self.shown, self.visible = tag, shown, visible
        self.count, self.rows, self.flow, self.span, self.down, self.opened, self.summary, self.bullet = 0, None, None, 1, 1, True, False, ""


class Page:
    """Builds the tree as a stack of open elements and renders each part as it closes."""

    def __init__(self, hides: dict[str, tuple[bool, bool]] | None = None):
        self.stack = [Element("#root", True, True)]
        self.flows = [Flow()]
        self.hides = hides or {}
        self.open: Counter = Counter()  # open elements by tag

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def seen(self) -> bool:
        e = self.stack[-1]
        return e.shown and e.visible

    def open_at(self, tags, stop=frozenset(["table", "td", "th", "caption", "#root"])) -> int:
        """Place of the nearest open element of some tags, not beyond a stop or DEPTH elements; -1 without."""
        if not any(self.open[t] for t in tags):
            return -1
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - DEPTH), -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in stop:
                return -1
        return -1

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.pop()

    def implied(self, tag: str) -> None:
        """Ends what a start tag ends, and starts the table parts that it needs."""
        if tag not in HEAD and (k := self.open_at(["head"], ())) > 0:
            self.close_to(k)
        if tag in BLOCK and tag not in ("option", "optgroup", "tr", "caption") and (k := self.open_at(["p"])) > 0:
            self.close_to(k)
        if tag == "li" and (k := self.open_at(["li"], LISTS | {"table", "td", "th"})) > 0:
            self.close_to(k)
        elif tag in ("dd", "dt") and (k := self.open_at(["dd", "dt"], frozenset(["dl", "table", "td", "th"]))) > 0:
            self.close_to(k)
        elif tag in ("option", "optgroup") and (k := self.open_at(["option"])) > 0:
            self.close_to(k)
        elif re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.stack[-1].tag):
            self.pop()
        elif tag in TABLE:
            while self.open_at(["table"], ()) > 0 and (k := self.open_at(TABLE[tag], frozenset(["table"]))) > 0:
                self.close_to(k)
            if tag in ("td", "th") and self.open_at(["table"], ()) > 0 and self.stack[-1].tag != "tr":
                self.push("tr", {})

    def push(self, tag: str, attrs: dict) -> None:
        up = self.stack[-1]
        style = attrs.get("style") or ""
        shown = up.shown and tag not in UNSEEN and ("hidden" not in attrs or attrs["hidden"] == "until-found") and not self.hidden(tag, attrs, style)
        if tag in UNDRAWN and (self.open["svg"] or self.open["math"]):
            shown = False
        if up.tag == "details" and not up.opened:
            shown = shown and tag == "summary" and not up.summary
            up.summary = up.summary or tag == "summary"
        if tag == "dialog" and "open" not in attrs:
            shown = False
        v = _VISIBLE.search(style) if style else None
        e = Element(tag, shown, up.visible if v is None else v[1].lower() == "visible")
        e.opened = tag != "details" or "open" in attrs
        if shown:
            if tag in BLOCK:
                nested = tag in LISTS and self.open_at(LISTS) > 0
                self.flow.end_line(2 if tag in SPACED and not nested else 1)
            if len(self.stack) > DEPTH:  # hides and shows as others do, but lays nothing out
                pass
            elif tag in ("dd", "blockquote"):
                e.bullet = "  "
                self.flow.indent.append("  ")
            elif tag == "ol":
                e.count = int(attrs["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", attrs.get("start") or "") else 0
            elif tag == "li":
                owner = next((x for x in reversed(self.stack) if x.tag in LISTS), None)
                if owner is not None and owner.tag == "ol":
                    owner.count = int(attrs["value"]) if re.fullmatch(r"-?\d{1,9}", attrs.get("value") or "") else owner.count + 1
                    e.bullet = f"{owner.count}. "
                else:
                    e.bullet = "* "
                self.flow.indent.append(" " * len(e.bullet))
                self.flow.bullet = e.bullet
            elif tag == "table":
                e.rows = []
            elif tag == "tr" and (k := self.open_at(["table"], ())) > 0 and self.stack[k].rows is not None:
                self.stack[k].rows.append([])
            elif tag in ("td", "th", "caption") and self.open_at(["table"], ()) > 0:
                n, m = attrs.get("colspan") or "1", attrs.get("rowspan") or "1"
                e.span = min(COLUMNS, max(1, int(n))) if re.fullmatch(r"[0-9]{1,6}", n) else 1
                e.down = min(65534, int(m)) if re.fullmatch("[0-9]{1,6}", m) else 1
                e.flow = Flow()
                self.flows.append(e.flow)
        self.stack.append(e)
        self.open[tag] += 1

    def hidden(self, tag: str, attrs: dict, style: str) -> bool:
        """Whether display is none: by an important rule, the style attribute, or the most specific rule of a style element."""
        own = _shown(style) if style else None
        if own and own[1]:
            return own[0]
        gone = (False, False)
        if self.hides:
            classes = (attrs.get("class") or "").split()
            for x in (tag, *(f"{t}.{c}" for t in ("", tag) for c in classes), *(f"{t}#{attrs['id']}" for t in ("", tag) if attrs.get("id"))):
                if x in self.hides and (self.hides[x][1] or not gone[1]):
                    gone = self.hides[x]
        return own[0] if own and not gone[1] else gone[0]

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if not e.shown:
            return
        if e.flow is not None:
            while self.flows[-1] is not e.flow:
                self.flows.pop()
            self.flows.pop()
            t = next((x for x in reversed(self.stack) if x.tag == "table"), None)
            lines = e.flow.done()
            if e.tag == "caption" or t is None or t.rows is None:
                self.flow.whole(lines)
            elif t.rows:
                t.rows[-1].append((lines, e.span, e.down))
            return
        if e.tag == "table" and e.rows is not None:
            self.flow.whole(grid(e.rows))
            return
        if e.tag in BLOCK:
            nested = e.tag in LISTS and self.open_at(LISTS) > 0
            self.flow.end_line(2 if e.tag in SPACED and not nested else 1)
        if e.bullet and self.flow.indent:
            self.flow.indent.pop()
            if e.tag == "li":
                self.flow.bullet = ""

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            if tag == "body" and (k := self.open_at(["head"], ())) > 0:
                self.close_to(k)
            return
        self.implied(tag)
        a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
        if tag == "br":
            if self.seen():
                self.flow.br()
        elif tag == "hr":
            if self.seen() and "hidden" not in a:
                self.flow.whole(["---"])
        elif tag not in VOID:
            self.push(tag, a)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        if tag in ("html", "body"):
            return None
        if tag == "p" and self.open_at(["p"]) < 0:
            self.start("p", "")
        if tag in TABLE or tag == "table":
            k = self.open_at([tag], frozenset() if tag == "table" else frozenset(["table"]))
        elif tag in BLOCK:
            k = self.open_at([tag])
        elif re.fullmatch("h[1-6]", tag):
            k = self.open_at([f"h{i}" for i in range(1, 7)])
        else:
            k = self.open_at([tag], BLOCK | {"td", "th", "#root"})
        if k > 0:
            self.close_to(k)
        return None

    def data(self, s: str) -> None:
        if not s:
            return
        up = self.stack[-1]
        if up.tag == "head":
            if not s.strip():
                return
            self.close_to(self.open_at(["head"], ()))
            up = self.stack[-1]
        if not (up.shown and up.visible) or up.tag == "details" and not up.opened:
            return
        if up.tag in ("table", "tr", "thead", "tbody", "tfoot", "colgroup") and not s.strip():
            return
        s = unescape(s)
        if self.open_at(["pre", "listing", "xmp", "textarea"]) > 0:
            self.flow.raw(s.replace("\r\n", "\n"))
        else:
            self.flow.text(s)


def render(html: str | None) -> str:
    """Visible text of a page: blocks on lines of their own, blank lines around paragraphs, list marks
    with indents, tables with aligned columns. Null or empty gives an empty string. Time and text grow
    with the page: elements nested deeper than DEPTH hide and show text as others do, but lay nothing out,
    and a tag ends none that is more than DEPTH elements away."""
    h, at = html or "", 0
    page = Page(hiding(h))
    while (m := _MARK.search(h, at)) is not None:
        if m.start() > at:
            page.data(h[at:m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            page.start(tag, m[3] or "")
            if tag in RAW and page.stack[-1].tag == tag:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(h, at)
                body = h[at:end.start() if end else len(h)]
                if tag in ("textarea", "xmp"):
                    page.data(body)
                at = end.end() if end else len(h)
                page.end(tag)
            elif tag == "pre" and h.startswith("\n", at):
                at += 1
        elif m[1]:
            page.end(m[1].lower())
    page.data(h[at:])
    page.close_to(1)
    return "\n".join(page.flows[0].done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines for each row of pages (page_id, html); rows are rendered where they are read.

    Null and empty pages give empty texts, repeated rows equal ones, which each get their row, an empty
    table none. Very long pages are rendered whole, a few at a time. Other columns are not read, whatever
    their names.
    """
    def run(batches):
        for b in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            texts = [render(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_lines long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages").select("page_id", "html"))


QUERIES = {"op5_html_extraction": (op5_html_extraction, None)}
