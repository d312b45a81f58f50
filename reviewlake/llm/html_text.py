"""HTML to text by layout: a tree of open elements with implied tags and visibility rules, rendered as they close.

Every visible text is kept: blocks start on new lines and keep blank lines between paragraphs, list items get
bullets or numbers and hang under them, table cells are padded to the width of their column; a row outside a table is a line
of its own. Blanks are layout and bounded: lines are indented by ``DEEPEST`` at most, cells padded to ``WIDEST``. Formulas, labels of drawings (``text`` and ``foreignObject`` of svg) and the fallback of ``object`` are text. Left out
are scripts, styles, the head, templates, hidden elements, ``noscript``, frames' fallback, ``datalist``, and titles, descriptions and
annotations inside svg and math; ``pre`` keeps its blanks.

Nulls: a null page gives an empty text. Broken markup is taken as browsers mostly do: unknown end tags are ignored, open
elements end with the page. Texts of any length and nesting are whole (no recursion). Repeated rows give the same text; an
empty table gives no rows. Columns beyond page_id and html are neither read nor in the way.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: which elements are void, hidden, blocks, and which end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer main nav address form li dt dd tr caption figcaption hr "
    "legend details summary thead tbody tfoot option center dialog menu".split()
)
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th html body".split())
ENDS_P = (BLOCKS | {"hr"}) - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "option", "legend", "summary"}
#: Inside svg and math: what is not shown, and start tags that end a drawing.
FOREIGN_UNSEEN = frozenset("title desc metadata annotation annotation-xml".split())
ENDS_DRAWING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: A start tag ends these open elements, as far as the scope of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}), "body": ({"head"}, set()),
    **{x: ({"td", "th", "tr", "caption", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>?)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
BREAK = "\x00"
#: The most blanks before a line, and the width to which cells are padded at most.
DEEPEST, WIDEST = 64, 100


class _Element:
    """An open element with what it has rendered: ("text", s), ("raw", s), or ("block", gap, lines)."""

    __slots__ = ("tag", "unseen", "pre", "parts", "rows", "cells", "count", "ordered", "span", "foreign", "drawn")

    def __init__(self, tag, unseen, pre, span=1, foreign=False, drawn=False):
        self.tag, self.unseen, self.pre, self.parts = tag, unseen, pre, []
        self.rows, self.cells, self.count, self.ordered, self.span = [], [], 0, tag == "ol", span
        self.foreign, self.drawn = foreign, drawn  # inside svg or math; inside svg but for its texts


def _lines(parts) -> list[str]:
    """Inline texts flowed into lines, blocks put between them with the wider of two gaps."""
    out, inline, gap, started = [], [], 0, False

    def flow():
        nonlocal inline, gap, started
        if not inline:
            return
        raw = any(kind == "raw" for kind, _ in inline)
        if raw:
            found = "".join(s.replace(BREAK, "\n") for _, s in inline).split("\n")
            while found and not found[0].strip():
                found.pop(0)
            while found and not found[-1].strip():
                found.pop()
        else:
            found = [SPACE.sub(" ", s).strip(" ") for s in "".join(s for _, s in inline).split(BREAK)]
            while found and not found[-1]:
                found.pop()
        if found and any(found):
            add(found, 0)
        inline = []

    def add(found, own):
        nonlocal gap, started
        out.extend([""] * (max(gap, own) if started else 0))
        if len(found) > 4:
            out.append(_Inset(found, "", 0))  # as it is: lines are not copied at each level
        else:
            out.extend(found)
        gap, started = own, True

    for part in parts:
        if part[0] == "block":
            flow()
            if part[2]:
                add(part[2], part[1])
        else:
            inline.append(part)
    flow()
    return out


class _Inset:
    """Lines within others: the first one after a mark, the others further in by so many blanks."""

    __slots__ = ("lines", "mark", "indent")

    def __init__(self, lines, mark: str, indent: int):
        self.lines, self.mark, self.indent = lines, mark, indent


def _written(lines) -> list[str]:
    """The lines with all marks and indents. Each line is written once, however deep it stands."""
    out: list[str] = []
    # what is still to come of each level, its indent, and the marks that its first line has to carry
    levels = [(iter(lines), 0, None)]
    while levels:
        rest, indent, marks = levels[-1]
        line = next(rest, None)
        if line is None:
            levels.pop()
            continue
        before = marks if marks is not None else (None, " " * min(indent, DEEPEST))
        if marks is not None:
            levels[-1] = (rest, indent, None)
        if isinstance(line, _Inset):
            levels.append((iter(line.lines), indent + line.indent, (before, line.mark)))
        else:
            found = [line] if line else []
            while before is not None:
                before, mark = before
                if found or mark.strip():  # a line without text takes the mark of its item, and no blanks alone
                    found.append(mark)
            found = "".join(reversed(found))
            blanks = len(found) - len(found.lstrip(" "))
            own = len(line) - len(line.lstrip(" "))
            out.append(found[max(0, blanks - own - DEEPEST) :])
    return out


def _table(rows) -> list[str]:
    width: list[int] = []
    for cells in rows:
        for i, (cell, _) in enumerate(cells):
            if i == len(width):
                width.append(0)
            width[i] = min(WIDEST, max(width[i], len(cell)))
    return [" | ".join(cell.ljust(width[i]) for i, (cell, _) in enumerate(cells)).rstrip() for cells in rows if cells]


def _close(stack):
    own, up = stack.pop(), stack[-1]
    if own.unseen:
        return
    if own.tag in ("td", "th"):
        row = next((e for e in reversed(stack) if e.tag in ("tr", "table")), None)
        if row is not None and row.tag == "tr":
            row.cells.append((" ".join(x for x in _written(_lines(own.parts)) if x), own.span))
            row.cells.extend([("", 1)] * (own.span - 1))
            return
    if own.tag == "tr":
        table = next((e for e in reversed(stack) if e.tag == "table"), None)
        rest = _lines(own.parts)
        if table is not None:
            if own.cells:
                table.rows.append(own.cells)
            if rest:
                up.parts.append(("block", 0, rest))
        else:
            up.parts.append(("block", 0, [*rest, *_table([own.cells])]))
        return
    if own.tag == "text" and up.drawn:
        up.parts.extend([("text", " "), *own.parts, ("text", " ")])
        return
    found = None
    if own.tag == "table":
        found = _lines([*own.parts, ("block", 0, _table(own.rows))])
    elif own.tag == "li":
        found = _lines(own.parts)
        of = next((e for e in reversed(stack) if e.tag in ("ul", "ol", "menu")), up)
        of.count += 1
        mark = f"{of.count}. " if of.ordered else "- "
        found = [_Inset(found, mark, len(mark))] if found else []
    elif own.tag in ("blockquote", "dd"):
        found = _lines(own.parts)
        found = [_Inset(found, "  ", 2)] if found else []
    elif own.tag in BLOCKS:
        found = _lines(own.parts)
    if found is None:
        up.parts.extend(own.parts)
    else:
        nested = own.tag in ("ul", "ol") and any(e.tag == "li" for e in stack)
        up.parts.append(("block", 1 if own.tag in SPACED and not nested else 0, found))


def render(page: str | None) -> str:
    """The visible text of a page."""
    page = page or ""
    stack = [_Element("", False, False)]
    open_tags: dict[str, int] = {}

    def push(tag, unseen=False, pre=False, span=1):
        up = stack[-1]
        foreign = tag in ("svg", "math") or up.foreign and tag != "foreignobject"
        drawn = tag == "svg" or up.drawn and tag not in ("text", "foreignobject")
        stack.append(_Element(tag, up.unseen or unseen, up.pre or pre, span, foreign, drawn))
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def pop():
        open_tags[stack[-1].tag] -= 1
        _close(stack)

    def end(tags, scope, outermost=False):
        """Closes the innermost (or outermost) of ``tags`` that is open above the innermost of ``scope``."""
        if not any(open_tags.get(t) for t in tags):
            return
        at = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                at = i
                if not outermost:
                    break
            elif stack[i].tag in scope:
                break
        if at:
            while len(stack) > at:
                pop()

    def say(s):
        own = stack[-1]
        if s and not own.unseen and not own.drawn:
            s = html.unescape(s) if "&" in s else s
            own.parts.append(("raw" if own.pre else "text", s.replace(BREAK, "�")))

    at = 0
    while (found := TAG.search(page, at)) is not None:
        say(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                stack[-1].parts.append(("raw" if stack[-1].pre else "text", BREAK))
            elif tag == "p" and not open_tags.get("p"):
                stack[-1].parts.append(("block", 1, []))
            elif tag in BLOCKS or tag in ("td", "th"):
                end({tag}, set() if tag in TABLE_PARTS else {"table"})
            elif open_tags.get(tag):
                end({tag}, BLOCKS | {"td", "th"})  # an inline end tag doesn't close a block
            continue
        while stack[-1].drawn and tag in ENDS_DRAWING:
            end({"svg"}, set())
        if tag == "br":
            if not stack[-1].unseen:
                stack[-1].parts.append(("raw" if stack[-1].pre else "text", BREAK))
            continue
        if tag in ENDS:
            end(*ENDS[tag], outermost=True)
        if tag in ENDS_P and open_tags.get("p"):
            end({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ("td", "th") and open_tags.get("table") and not _inside(stack, "tr", "table"):
            push("tr")
        unseen, span = tag in UNSEEN or stack[-1].foreign and tag in FOREIGN_UNSEEN, 1
        if found[3] and not unseen:
            given = found[3]
            low = given.lower()
            if "hidden" in low or "none" in low or "collapse" in low or "colspan" in low:
                values = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(given)}
                unseen = "hidden" in values or bool(HIDES.search(values.get("style", "")))
                if tag in ("td", "th") and (n := values.get("colspan", "")).isdecimal():
                    span = min(max(int(n), 1), 1000)  # the limit of HTML itself
        if tag in VOID or (found[3] or "").endswith("/") and (stack[-1].foreign or tag in ("svg", "math", "path")):
            if tag == "hr" and not unseen:
                stack[-1].parts.append(("block", 1, []))
            continue
        push(tag, unseen, tag in ("pre", "textarea", "xmp"), span)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            say(page[at : stop.start() if stop else len(page)])
            at = stop.start() if stop else len(page)
    say(page[at:])
    while len(stack) > 1:
        pop()
    return "\n".join(_written(_lines(stack[0].parts)))


def _inside(stack, tag, scope) -> bool:
    for e in reversed(stack):
        if e.tag == tag:
            return True
        if e.tag == scope:
            return False
    return False


def _run(batches):
    for batch in batches:
        texts = [render(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of each page."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(_run, f"page_id {kind}, text string")
