"""HTML articles to text, with the standard library's parser: what built-in functions can't express.

clean_article() drops junk elements, marks internal links with ids, turns formulas into LaTeX and wiki tables into rows,
writes the rest as plain text with '#' headings, and normalises lines. html_to_text is the function that runs on executors
over Arrow batches; any callable of the same form can take its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .text import BORDER, BORDER_WIDTH, LONGEST_LINE, MOST_SPACES, UNWANTED_SECTIONS

#: Elements that articles lose, as CSS selectors. Fixed values.
JUNK = (
    "style, script, link, .navbox, div.vertical-navbox, div.metadata, div.printfooter, div.mw-editsection, .sidebar, div.hatnote, div.rellink, dl.rellink, "
    "sup.reference, sup.mw-ref, span.mw-ref, .mw-ref, .noprint, div.reflist, ol.references, div.refbegin, div.refbegin-columns, table.infobox, table.ambox, "
    "table.tmbox, table.cmbox, table.fmbox, table.ombox, div.ambox, div.tmbox, div.cmbox, div.fmbox, div.ombox, div#toc, div.toc, #coordinates, span.coordinates, "
    ".shortdescription, div.topicon, figure, div.thumb, .gallery, .mw-file-description, .mw-empty-elt, .mw-cite-backlink, .mw-references-wrap, .sistersitebox, "
    ".side-box, .zim-footer, div#catlinks"
)
_SELECTORS = [re.fullmatch(r"(\w*)([.#]?)([\w-]*)", s.strip()).groups() for s in JUNK.split(",")]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"p", "div", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "blockquote", "pre", "dl", "dd", "dt", "body", "html"}
WRAPPERS = ("{\\displaystyle ", "{\\textstyle ")
MARKER = re.compile("\x7f?'\"`UNIQ--.*?`\"'\x7f?", re.S)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and any(n.tag == tag for n in self.stack[-2:]):  # unclosed ones end here
            while self.stack[-1].tag != tag:
                self.stack.pop()
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def is_junk(n: Node) -> bool:
    classes = n.classes()
    return any((not tag or tag == n.tag) and (not kind or (name in classes if kind == "." else n.attrs.get("id") == name)) for tag, kind, name in _SELECTORS)


def _replace(root: Node, decide: Callable[[Node], object]) -> None:
    """Put what decide() returns in the place of each element: the element itself, a string, or None for nothing. Replaced elements aren't entered."""
    stack = [root]
    while stack:
        n = stack.pop()
        kept = []
        for c in n.children:
            new = decide(c) if isinstance(c, Node) else c
            if new is not None:
                kept.append(new)
            if isinstance(new, Node):
                stack.append(new)
        n.children = kept


def _formula(n: Node) -> object:
    if n.tag != "math" and not (n.tag == "span" and "mwe-math-element" in n.classes()):
        return n
    found = next((a for a in n.walk() if a.tag == "annotation" and a.attrs.get("encoding") == "application/x-tex"), None)
    if found is None:
        return None
    latex = found.text().strip()
    for w in WRAPPERS:
        if latex.startswith(w):
            latex = latex[len(w) :].removesuffix("}")
            break
    return f" ${latex.strip()}$ "


def table_lines(table: Node) -> list[str]:
    """'H|…' for rows of headings only, 'R|…' for others with cells."""
    out = []
    for row in (n for n in table.walk() if n.tag == "tr"):
        cells = [n for n in row.walk() if n.tag in ("th", "td")]
        if cells:
            clean = [MARKER.sub("", c.text()).replace("⁠", "").replace("\n", " ").replace("|", "¦").strip() for c in cells]
            out.append("|".join(["H" if all(c.tag == "th" for c in cells) else "R", *clean]))
    return out


def plain_text(root: Node) -> str:
    """Blocks apart by blank lines, white space collapsed, '#' headings and '* ' items."""
    blocks: list[str] = []
    line: list[str] = []
    mark = [""]

    def flush() -> None:
        text = re.sub(r"[ \t\r\f\n]+", " ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(mark[0] + text)
        mark[0] = ""

    stack: list = [iter(root.children)]
    ends: list[bool] = [False]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(c, str):
            if "\0" in c:
                flush()
                blocks.append(c.strip())
            else:
                line.append(c)
        elif c.tag in ("head", "noscript", "template"):
            continue
        elif c.tag == "br":
            flush()
        else:
            block = c.tag in BLOCK
            if block:
                flush()
                if re.fullmatch("h[1-6]", c.tag):
                    mark[0] = "#" * int(c.tag[1]) + " "
                elif c.tag == "li":
                    mark[0] = "* "
            stack.append(iter(c.children))
            ends.append(block)
    flush()
    return "\n\n".join(blocks)


def normalise(text: str) -> str:
    """Without unwanted sections and headings that nothing follows; blank runs, borders and long runs of spaces shortened."""
    lines = text.strip().splitlines()
    kept, dropping = [], False
    for s in (x.strip() for x in lines):
        if s.startswith("#"):
            dropping = s.startswith(UNWANTED_SECTIONS)
        kept.append(not dropping)
    body = [i for i, s in enumerate(lines) if kept[i] and s.strip() and not s.strip().startswith("#")]
    out: list[str] = []
    at = 0
    for i, raw in enumerate(lines):
        if not kept[i]:
            continue
        s = raw.rstrip()
        if s.strip().startswith("#"):
            after = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith("#")), len(lines))
            while at < len(body) and body[at] <= i:
                at += 1
            if at >= len(body) or body[at] >= after:
                continue
        if not s.strip():
            if out and out[-1]:
                out.append("")
            continue
        if len(s) > LONGEST_LINE and not set(s) - set(BORDER):
            s = s[:BORDER_WIDTH]
        out.append(re.sub(" {%d,}" % (MOST_SPACES + 1), "   ", s))
    return "\n".join(out).strip()


def is_internal(href: str) -> bool:
    return not href.startswith(("#", "http://", "https://", "//", "www."))


def clean_article(html: str, resolve: Callable[[str, str], str | None] = lambda title, href: None) -> tuple[str, list[str], list[str]]:
    """Text, tables and targets of internal links of an article; resolve(title, href) gives an id, without one 'Q0' stands."""
    root = parse(html)
    root = next((n for n in root.walk() if n.tag == "div" and "mw-parser-output" in n.classes()), root)
    links: list[str] = []
    tables: list[str] = []
    _replace(root, lambda n: None if is_junk(n) else n)
    for a in (n for n in root.walk() if n.tag == "a"):
        href, title = a.attrs.get("href"), a.attrs.get("title", "")
        if href is not None and is_internal(href):
            links.append(href)
            if title:
                a.children.append(f" [{resolve(title, href) or 'Q0'}]")
    _replace(root, _formula)

    def table(n: Node) -> object:
        if n.tag != "table" or "wikitable" not in n.classes():
            return n
        tables.append("\n".join(table_lines(n)))
        return f"\0TABLE{len(tables) - 1}\0"

    _replace(root, table)
    text = normalise(plain_text(root))
    for i, t in enumerate(tables):
        text = text.replace(f"\0TABLE{i}\0", f"[[TABLE_START]]\n{t.strip()}\n[[TABLE_END]]")
    return text, tables, links


def html_to_text(pages: DataFrame, keys: list[str], html: str = "html", process: Callable[..., tuple[str, list[str], list[str]]] = clean_article, ids: str | None = None) -> DataFrame:
    """keys, body, tables, links and error of each page; a page that fails keeps its keys and gets an error instead of a body.

    `ids` names a column with a map from href to id, which resolves the page's links. Null HTML counts as empty. Keys pass in
    Arrow as they are.
    """
    rows = pages.select(*keys, html, *([ids] if ids else []))
    made = StructType.fromDDL("body string, tables array<string>, links array<string>, error string")
    schema = StructType([rows.schema[k] for k in keys] + made.fields)
    types = [f.type for f in to_arrow_schema(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            known = b.column(ids).to_pylist() if ids else [None] * b.num_rows
            for x, own in zip(b.column(html).to_pylist(), known):
                try:
                    own = dict(own or [])
                    done = process(x or "", lambda title, href: own.get(href)) if ids else process(x or "")
                    out.append((*done, None))
                except Exception as e:  # a dead letter, not a failed job
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
