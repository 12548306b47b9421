"""Pages as a tag stream: one linear pass keeps the stack of open elements, so that an end tag closes its own start tag and nested elements stay whole. It gives the page's text, its main text, titles and links together."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import config as C
from .cleanup import in_parts

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: How the attributes of an element without an end tag end; the slash of an unquoted value is part of it.
EMPTY = re.compile(r"""(?:^|[\s"'])/\s*$""")
#: Their content is no markup.
RAW = {name: re.compile(rf"</{name}\s*[^>]*>|\Z", re.I) for name in ("script", "style")}
#: A start tag ends an open element of these names right above it.
ENDS = {"a": ("a",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= dict.fromkeys(("p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "hr", "address", "fieldset", "center"), ("p",))

FOUND = StructType([StructField(c, StringType()) for c in ("text", "main", "main_source", "h1", "title")]).add(
    "links", ArrayType(StructType([StructField("href", StringType()), StructField("anchor", StringType())]))
)


def attributes(source: str) -> dict[str, str]:
    """Names in lower case; the first of equal ones counts, and entities in values are read."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


class Page:
    """The texts of a page, each with the depth of the innermost open element that is not shown, and the ranges of its main elements, headings and links."""

    def __init__(self, source: str):
        self.texts: list[tuple[str, int]] = []
        self.open: list[str] = []
        self.hidden: list[int] = []  # depths of open elements that are not shown
        self.watched: list[tuple[int, list]] = []  # depth and range of those that are wanted
        self.mains: dict[str, list] = {name: [] for name in C.MAIN_SOURCES}
        self.h1, self.title, self.links = None, None, []
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            tag = TAG.search(source, at)
            self._text(source[at : tag.start() if tag else end])
            if not tag:
                break
            at = tag.end()
            closing, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                self._end(name)
            elif name in RAW:
                at = RAW[name].search(source, at).end()
            else:
                self._start(name, rest)
        self._close(0)

    def _text(self, raw: str) -> None:
        if raw and (shown := html.unescape(raw).strip()):
            self.texts.append((shown, self.hidden[-1] if self.hidden else -1))

    def _start(self, name: str, rest: str) -> None:
        while self.open and self.open[-1] in ENDS.get(name, ()):
            self._close(len(self.open) - 1)
        depth, span = len(self.open), [len(self.texts), None, len(self.open)]
        known = attributes(rest) if rest else {}
        kinds = [k for k, hit in zip(C.MAIN_SOURCES, (name == "article", name == "main", known.get("role") == "main", known.get("itemprop") == "articleBody")) if hit and len(self.mains[k]) < 3]
        for k in kinds:
            self.mains[k].append(span)
        if name == "h1" and self.h1 is None:
            self.h1 = span
        elif name == "title" and self.title is None:
            self.title = span
        elif name == "a" and known.get("href", "").strip():
            self.links.append((known["href"].strip(), span))
        if name in C.VOID_TAGS or EMPTY.search(rest):
            span[1] = len(self.texts)
            return
        self.open.append(name)
        if name in C.HIDDEN_TAGS:
            self.hidden.append(depth)
        self.watched.append((depth, span))

    def _end(self, name: str) -> None:
        weight = C.END_WEIGHTS.get(name, 100)
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == name:
                self._close(depth)
                return
            if C.END_WEIGHTS.get(self.open[depth], 100) > weight:
                return

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        while self.hidden and self.hidden[-1] >= depth:
            self.hidden.pop()
        while self.watched and self.watched[-1][0] >= depth:
            self.watched.pop()[1][1] = len(self.texts)

    def within(self, span: list, shown: bool = True) -> list[str]:
        """Texts of an element; without those that it hides itself, if ``shown``."""
        first, last, depth = span
        return [t for t, hidden in self.texts[first:last] if not shown or hidden < depth]

    def found(self) -> dict:
        main, source = "", "empty"
        for kind, spans in self.mains.items():
            for span in spans:
                if len(text := joined(self.within(span))) > len(main):
                    main, source = text, kind
        h1 = " ".join(self.within(self.h1, False)) if self.h1 else ""
        title = " ".join(self.within(self.title, False)) if self.title else ""
        links = [{"href": href, "anchor": " ".join(self.within(span, False))[:120]} for href, span in self.links]
        return {"text": joined([t for t, hidden in self.texts if hidden < 0]), "main": main, "main_source": source, "h1": h1, "title": title, "links": links}


def joined(texts: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(texts)).strip()


def read_page(source: str | None) -> dict:
    """What FOUND holds of a page; of one that shows nothing, the text of everything but scripts and styles in one line."""
    out = Page(source or "").found()
    if not out["text"] and source:
        bare = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", source)
        out["text"] = " ".join(re.sub(r"<[^>]+>", " ", bare).split())
    return out


@arrow_udf(FOUND)
def _pages(source: pa.Array) -> pa.Array:
    return in_parts(source, read_page, to_arrow_type(FOUND))


def page(source: Column) -> Column:
    """text, main and main_source, h1, title and links of HTML."""
    return _pages(F.coalesce(source, F.lit("")))
