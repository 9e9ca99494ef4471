"""HTML to text by layout: a tree builder with implied tags, visibility, blocks, lists
and aligned tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import table

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary ul listing xmp plaintext optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure listing xmp menu dir".split())
CLOSES_P = (BLOCK | {"table"}) - frozenset("body html option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HIDDEN = frozenset("head script style template noscript title datalist audio video canvas iframe "
                   "object rp noembed noframes annotation annotation-xml mphantom".split())
# Parts of a drawing that are not drawn themselves; elements that leave a drawing or formula;
# those of them that hold HTML; those whose own text is not shown, and those that show it again.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                     "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject mi mo mn ms mtext".split())
MUTE = frozenset("svg select".split())
SPEAKS = frozenset("text foreignobject option".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
PRE = frozenset("pre textarea listing xmp plaintext".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
SCOPE = frozenset("table td th caption button object template html".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]{2,}|[\t\n\r\f]")   # what collapsing changes
CSS_NOISE = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
BRACE = re.compile(r"[{}]")
DECLARED = re.compile(r"(?:\A|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
FEATURE = re.compile(r"(min-|max-)?(width|height)\s*(:|>=|<=|>|<|=)\s*([\d.]+)(px|em|rem)")
VIEW = {"width": 1280.0, "height": 800.0}    # the screen that media queries are asked about
HOLDS = frozenset("orientation:landscape prefers-color-scheme:light hover:hover pointer:fine color".split())
WIDE = 60                    # cells longer than this do not widen their column


def _feature(asked: str) -> bool:
    """Whether a media feature holds on the screen ``VIEW``; unknown ones do not."""
    asked = asked.strip()
    if asked.replace(" ", "") in HOLDS:
        return True
    m = FEATURE.fullmatch(asked)
    if m is None:
        turned = re.fullmatch(r"([\d.]+(?:px|em|rem))\s*(<=|<|>=|>)\s*(width|height)(.*)", asked)
        if turned is None:
            return False
        first = turned[3] + turned[2].translate(str.maketrans("<>", "><")) + turned[1]
        return _feature(first) and (not turned[4].strip() or _feature(turned[3] + turned[4]))
    try:
        have, want = VIEW[m[2]], float(m[4]) * (1 if m[5] == "px" else 16)
    except ValueError:
        return False
    how = {"min-": ">=", "max-": "<="}.get(m[1], m[3])
    return {">=": have >= want, "<=": have <= want, ">": have > want, "<": have < want}.get(how, have == want)


def on_screen(query: str) -> bool:
    """Whether a media query list holds on a screen of the size ``VIEW``."""
    if not query.strip():
        return True
    for one in " ".join(query.lower().split()).split(","):
        m = re.fullmatch(r"\s*(not\s+|only\s+)?([a-z-]+)?((?:\s*(?:\band\b)?\s*\([^()]*\))*)\s*", one)
        if m is None or not (m[2] or m[3]):
            continue
        holds = (m[2] or "all") in ("all", "screen") and all(map(_feature, re.findall(r"\(([^()]*)\)", m[3])))
        if holds != ((m[1] or "").strip() == "not"):
            return True
    return False


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in order: blocks of @media
    that hold, of @supports without "not" and of @layer are entered, other at-rules skipped."""
    todo = [(css, 0)]
    while todo:
        css, at = todo.pop()
        m = re.compile(r"[{};]").search(css, at)
        if m is None:
            continue
        head, at = css[at:m.start()].strip(), m.end()
        if m[0] != "{":
            todo.append((css, at))
            continue
        depth = 1
        for b in BRACE.finditer(css, at):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                break
        inner, at = (css[at:b.start()], b.end()) if not depth else (css[at:], len(css))
        todo.append((css, at))
        if not head.startswith("@"):
            flat, depth, last = [], 0, 0                 # without nested rules
            for b in BRACE.finditer(inner):
                if b[0] == "{":
                    if not depth:
                        flat.append(inner[last:b.start()])
                    depth += 1
                elif depth:
                    depth -= 1
                    last = b.end()
            yield head, ";".join(flat if depth else [*flat, inner[last:]])
            continue
        name, _, query = re.sub(r"^@([\w-]+)", r"\1 ", head).partition(" ")
        name = name.lower()
        if (name == "media" and on_screen(query) or name == "layer"
                or name == "supports" and not re.search(r"\bnot\b", query)):
            todo.append((inner, 0))


class _Flow:
    """Lines of one block flow: inline text, margins between blocks, indents, list marks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.cur: list[str] = []
        self.gap = 0
        self.indent: list[int] = []
        self.mark: str | None = None
        self.pre = False                     # the current line is preformatted

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *more = s.split("\n")
            self.cur.append(head)
            self.pre = True
            for line in more:
                self.end(keep=True)
                self.cur.append(line)
                self.pre = True
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " " and (not self.cur or self.cur[-1][-1:] in (" ", "")):
            s = s[1:]
        if s:
            self.cur.append(s)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        pad = sum(self.indent)
        if self.mark is not None and line:
            self.lines.append(" " * (pad - len(self.mark)) + self.mark + line)
            self.mark = None
        else:
            self.lines.append(" " * pad + line if line else "")

    def end(self, keep: bool = False) -> None:
        line = "".join(self.cur)
        self.cur = []
        line = line.rstrip() if keep or self.pre else line.strip(" \t\n\r\f")
        self.pre = False
        if line or keep and self.lines and not self.gap:
            self.put(line)

    def space(self, n: int) -> None:
        self.end()
        self.gap = max(self.gap, n)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    """Rows of cells; columns are padded to their widest cell."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}       # column -> rows still covered from above

    def row(self) -> None:
        self.rows.append([])
        self.skip = {c for c, n in self.taken.items() if n > 0}
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, lines: list[str], cols: int, rows: int) -> None:
        if not self.rows:
            self.row()
        last = self.rows[-1]
        at = last[-1][0] + last[-1][1] if last else 0
        while at in self.skip:
            at += 1
        last.append((at, cols, lines))
        if rows > 1:
            for c in range(at, at + cols):
                self.taken[c] = max(self.taken.get(c, 0), rows - 1)

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for r in self.rows:
            for at, cols, lines in r:
                for x in lines:
                    if cols == 1 and len(x) <= WIDE:
                        width[at] = max(width.get(at, 0), len(x))
        used = sorted(width)
        starts, x = {}, 0
        for c in used:
            starts[c] = x
            x += width[c] + 2
        out = []
        for r in self.rows:
            for k in range(max((len(lines) for _, _, lines in r), default=0)):
                line = ""
                for at, _, lines in r:
                    if k < len(lines) and lines[k]:
                        place = starts.get(at)
                        if line:
                            line += "  "
                        if place is not None and len(line) < place:
                            line += " " * (place - len(line))
                        line += lines[k]
                if line.strip():
                    out.append(line.rstrip())
        return out


def inside(el: dict | None) -> bool:
    """Whether children of ``el`` belong to a drawing or formula."""
    return bool(el and el["space"]) and el["tag"] not in HOLDS_HTML


def listbox(el: dict) -> bool:
    """Whether a select shows all its options."""
    size = el["attrs"].get("size", "")
    return "multiple" in el["attrs"] or size.isascii() and size.isdigit() and int(size[:9]) > 1


class _Builder:
    """Open elements of the tree; every start and end drives the layout."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.open: dict[str, int] = {}
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        # One name of a selector -> all its names -> property -> (weight, value).
        self.rules: dict[str, dict[frozenset, dict[str, tuple]]] = {}
        self.order = 0

    # -- visibility -------------------------------------------------------------
    def styles(self, css: str) -> None:
        """Store the last and weightiest display and visibility of every compound selector."""
        for names, body in css_rules(CSS_NOISE.sub(lambda m: "''" if m[0][0] in "\"'" else " ", css)):
            found = DECLARED.findall(body.replace(";", ";;"))
            if not found:
                continue
            self.order += 1
            for s in names.split(","):
                m = COMPOUND.fullmatch(s.strip())
                if m is None or not m[0]:
                    continue
                rest = re.findall(r"[.#][\w-]+", m[2])
                all_names = frozenset(rest + ([m[1].lower()] if m[1] and (m[1] != "*" or not rest) else []))
                ids = sum(x[0] == "#" for x in rest)
                weight = (ids, len(rest) - ids, int(bool(m[1]) and m[1] != "*"))
                key = rest[-1] if rest else m[1].lower()
                own = self.rules.setdefault(key, {}).setdefault(all_names, {})
                for name, value, important in found:
                    new = ((bool(important), 0, weight, self.order), value.lower())
                    own[name.lower()] = max(own.get(name.lower(), new), new, key=lambda x: x[0])

    def style(self, tag: str, attrs: dict) -> dict[str, str]:
        """Display and visibility that style sheets and the style attribute declare."""
        best: dict[str, tuple] = {}
        for name, value, important in DECLARED.findall(attrs.get("style", "").replace(";", ";;")):
            new = ((bool(important), 1, (), 0), value.lower())
            best[name.lower()] = max(new, best.get(name.lower(), new), key=lambda x: x[0])
        if self.rules:
            names = {"*", tag, "#" + attrs.get("id", "")} | {"." + c for c in attrs.get("class", "").split()}
            for n in names:
                for needed, own in self.rules.get(n, {}).items():
                    if needed <= names:
                        for name, new in own.items():
                            best[name] = max(best.get(name, new), new, key=lambda x: x[0])
        return {name: value for name, (_, value) in best.items()}

    def seen(self, tag: str, attrs: dict, top: dict | None) -> tuple[bool, bool]:
        """(rendered, visible) of a new element."""
        shown = top is None or top["shown"]
        visible = top is None or top["visible"]
        style = self.style(tag, attrs) if self.rules or "style" in attrs else {}
        display, visibility = style.get("display"), style.get("visibility")
        if tag in HIDDEN or display == "none":
            shown = False
        elif display is None and ("hidden" in attrs or tag == "dialog" and "open" not in attrs):
            shown = False
        if top is not None and top["tag"] == "details" and not top["open"] and tag != "summary":
            shown = False
        if visibility in ("visible", "initial"):
            visible = True
        elif visibility in ("hidden", "collapse"):
            visible = False
        return shown, visible

    # -- tree -------------------------------------------------------------------
    def push(self, tag: str, attrs: dict) -> None:
        top = self.stack[-1] if self.stack else None
        shown, visible = self.seen(tag, attrs, top)
        space = tag if tag in ("svg", "math") else top["space"] if inside(top) else ""
        if space == "svg" and tag in UNDRAWN:
            shown = False
        el = {"tag": tag, "shown": shown, "visible": visible, "open": "open" in attrs,
              "pre": tag in PRE or bool(top and top["pre"]), "attrs": attrs, "space": space,
              "mute": tag in MUTE or bool(top and top["mute"]) and tag not in SPEAKS}
        if shown:
            self.enter(el)
        if tag not in VOID:
            self.stack.append(el)
            self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> None:
        el = self.stack.pop()
        self.open[el["tag"]] -= 1
        if el["shown"]:
            self.leave(el)

    def close(self, tags, until) -> None:
        """Close the nearest open element of ``tags`` unless one of ``until`` is nearer."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i]["tag"] in until:
                return

    def start(self, tag: str, attrs: dict) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in BREAKOUT:
            while self.stack and inside(self.stack[-1]):
                self.pop()
        if tag in ("select", "input", "textarea") and self.open.get("select"):
            self.close(("select",), SCOPE)
            if tag == "select":                  # a start tag in a select only ends it
                return
        if tag not in IN_HEAD and tag != "html":
            if self.open.get("head") and tag != "head" and not self.open.get("template"):
                self.close(("head",), ())
        if tag in CLOSES_P:
            self.close(("p",), SCOPE)
        if tag in HEADINGS and self.stack and self.stack[-1]["tag"] in HEADINGS:
            self.pop()
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close(("option",), SCOPE | {"select", "datalist"})
        elif tag == "a":
            self.close_inline("a")
        elif tag in TABLE_PARTS:
            if not self.open.get("table"):
                return
            self.close(("td", "th", "caption"), ("table",))
            if tag not in ("td", "th"):
                self.close(("tr", "colgroup"), ("table",))
            elif not (self.stack and self.stack[-1]["tag"] == "tr"):
                self.close(("tr",), ("table",))
                self.push("tr", {})
            if tag in ("caption", "tbody", "thead", "tfoot"):
                self.close(("tbody", "thead", "tfoot"), ("table",))
        self.push(tag, attrs)

    def close_inline(self, tag: str) -> None:
        """Formatting has no layout: only its entry goes, blocks inside stay open."""
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i]["tag"]
            if t == tag:
                self.stack.pop(i)
                self.open[tag] -= 1
                return
            if t in ("td", "th", "caption", "table"):
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self.open.get("p"):
            self.flow.space(1)
        elif not self.open.get(tag) or tag in ("html", "body"):
            return
        elif tag in FORMATTING:
            self.close_inline(tag)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag in ("table",):
            self.close((tag,), ())
        elif tag in TABLE_PARTS:
            self.close((tag,), ("table",))
        elif tag == "select":
            self.close((tag,), SCOPE)
        elif tag in BLOCK:
            self.close((tag,), SCOPE - {tag})
        else:
            self.close((tag,), BLOCK | SCOPE - {tag})

    # -- layout -----------------------------------------------------------------
    @property
    def flow(self) -> _Flow:
        return self.flows[-1]

    def enter(self, el: dict) -> None:
        tag, flow = el["tag"], self.flow
        if tag == "br":
            flow.end(keep=True)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = bool(self.open.get("li"))
            flow.space(0 if nested else 1)
            first = el["attrs"].get("start", "1")
            el["next"] = int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1
        elif tag == "li":
            flow.end()
            owner = next((x for x in reversed(self.stack) if x["tag"] in ("ul", "ol", "menu", "dir")),
                         None)
            mark = "- "
            if owner is not None and owner["tag"] == "ol" and "next" in owner:
                mark = f"{owner['next']}. "
                owner["next"] += 1
            flow.indent.append(len(mark))
            flow.mark = mark
            el["flow"] = flow
        elif tag in ("blockquote", "dd"):
            flow.space(1 if tag == "blockquote" else 0)
            flow.indent.append(4)
            el["flow"] = flow
        elif tag == "table":
            flow.space(1)
            self.tables.append(_Table())
            el["table"] = self.tables[-1]
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in ("td", "th"):
            self.flows.append(_Flow())
            el["cell"] = self.flow
        elif tag == "select":
            el["options"] = []
            if listbox(el):
                flow.space(0)
        elif tag == "option" and self.open.get("select"):
            el["select"] = next(x for x in reversed(self.stack) if x["tag"] == "select")
            self.flows.append(_Flow())
            el["option"] = self.flow
        elif tag == "optgroup" and self.open.get("select"):
            owner = next(x for x in reversed(self.stack) if x["tag"] == "select")
            if listbox(owner) and el["attrs"].get("label"):
                owner["options"].append((el["attrs"]["label"], {}))
        elif tag == "text" and el["space"] == "svg":
            flow.space(0)
        elif tag in BLOCK:
            flow.space(1 if tag in SPACED else 0)

    def leave(self, el: dict) -> None:
        tag = el["tag"]
        if "cell" in el:
            lines = self.flows.pop().done()
            if self.tables:
                def number(name: str, most: int) -> int:
                    v = el["attrs"].get(name, "1")
                    return max(1, min(most, int(v))) if re.fullmatch(r"\d{1,9}", v) else 1
                self.tables[-1].cell(lines, number("colspan", 1000), number("rowspan", 65534))
        elif "option" in el:
            line = " ".join(self.flows.pop().done())
            line = el["attrs"].get("label") or line
            if el["visible"]:
                el["select"]["options"].append((line, el["attrs"]))
        elif tag == "select":
            shown = el["options"]
            if not listbox(el):                # the last one selected, else the first that can be
                shown = ([x for x in shown if "selected" in x[1]][-1:]
                         or [x for x in shown if "disabled" not in x[1]][:1])
            for line, _ in shown:
                if listbox(el):
                    self.flow.space(0)
                self.flow.text(f" {line} ", False)
            if listbox(el):
                self.flow.space(0)
        elif tag == "optgroup" and self.open.get("select"):
            pass
        elif tag == "text" and el["space"] == "svg":
            self.flow.space(0)
        elif "table" in el:
            self.flow.end()
            while self.tables and self.tables.pop() is not el["table"]:
                pass
            for line in el["table"].lines():
                self.flow.put(line)
            self.flow.space(1)
        elif "flow" in el:
            el["flow"].end()
            if el["flow"].indent:
                el["flow"].indent.pop()
            if tag == "li":
                el["flow"].mark = None
            elif tag == "blockquote":
                el["flow"].space(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.flow.space(0 if self.open.get("li") else 1)
        elif tag == "caption":
            self.flow.end()
        elif tag in BLOCK:
            self.flow.space(1 if tag in SPACED else 0)

    def text(self, s: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top is None or top["shown"] and top["visible"]:
            if top is not None and (top["mute"] or top["tag"] == "details" and not top["open"]):
                return
            self.flow.text(s, bool(top and top["pre"]))
        elif top["tag"] == "head" and s.strip():       # text ends the head
            self.close(("head",), ())
            self.text(s)


def render(html: str | None) -> str:
    """All visible text of a page; the empty string for null, empty or textless pages."""
    b = _Builder()
    html = (html or "").replace("\r\n", "\n").replace("\r", "\n")
    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            b.text(unescape(html[at:]))
            break
        if m.start() > at:
            b.text(unescape(html[at:m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        attrs: dict = {}
        for name, x, y, z in ATTR.findall(m[3]):
            attrs.setdefault(name.lower(), unescape(x or y or z))
        b.start(tag, attrs)
        if m[3].endswith("/") and b.stack and b.stack[-1]["space"] and b.stack[-1]["tag"] == tag:
            b.pop()                              # closes itself only in drawings and formulas
            continue
        if tag in PRE and html.startswith("\n", at):
            at += 1
        if tag == "plaintext":
            b.text(html[at:])
            break
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at:stop.start()] if stop else html[at:]
            if tag == "style":
                if on_screen(attrs.get("media", "")):
                    b.styles(inner)
            elif tag not in ("script",):
                b.text(unescape(inner) if tag in ESCAPABLE else inner)
            at = stop.end() if stop else end
            b.end(tag)
    while b.stack:
        b.pop()
    return "\n".join(b.flow.done())


def extract_text(pages: DataFrame, html: str = "html", keep=("page_id",)) -> DataFrame:
    """``keep`` columns and ``text``, one row per row of ``pages``.

    Blocks stand on lines of their own, paragraphs, headings, lists and tables after a blank
    line; list items are marked and indented; cells of a column start at the same place.
    Elements that a browser does not show (head, scripts, hidden attribute, display none,
    invisible, closed details and dialogs, rules of style sheets in the page) give no text.
    Of style sheets, selectors of one tag, its classes and ids count, by weight and order, as
    on a screen of the size ``VIEW``; those with combinators, attributes or pseudo-classes do not. Null and empty pages give the empty string; repeated rows keep their rows;
    an empty table gives an empty result; other columns are ignored.  Work is row-local,
    without a shuffle; depth and length of a page are bounded by its memory alone.
    """
    rows = pages.select(*keep, F.col(html).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[render(x) for x in b["text"]])

    return rows.mapInPandas(run, rows.schema)


def op10_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
