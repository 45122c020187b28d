"""XHTML and HTML bodies to AsciiDoc.

Parsing markup isn't a relational operation, so each document is read on its own, in
Arrow batches, by the standard library's tokenizer and an automaton; what is only needed of the markup (the
headings) is an expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import bound_batches, give_back

EMPTY = "EPUB vide"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_BLOCK = {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "table", "article", "section", "nav", "footer", "header"}


def _heading(tag: str) -> int:
    return int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0


#: What an open element's content is: blocks, a list's items, a quote's paragraphs, inline text, the text of an inline element, text as it is, or nothing.
_BLOCKS, _ITEMS, _QUOTES, _INLINE, _SPAN, _TEXT, _SKIP = range(7)
#: What inline elements put before and behind their text.
_MARKS = {"em": "_", "i": "_", "strong": "*", "b": "*", "code": "``"}


class _Automaton(HTMLParser):
    """Markup that may leave tags open to lines of AsciiDoc, event by event.

    Open elements are a stack of (tag, what the content is, what follows the text); text goes to one buffer while an element
    that becomes a line is open.  Nothing is nested in calls and no tree is kept, so depth costs a
    stack entry.  The first body counts alone; what stands before it is forgotten once it begins.
    """

    def __init__(self, plain: bool, head: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.plain, self.head = plain, head
        self.out: list[str] = list(head)
        self.open: list[tuple[str, int, str]] = [("", _BLOCKS, "")]
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.body = 0  # the stack's size with the body on it; -1 behind it

    def _content(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, str]:
        """What a new element's content is, and what follows its text."""
        above = self.open[-1][1]
        if above == _BLOCKS:
            if self.plain:
                return (_TEXT, "") if _heading(tag) or tag in ("pre", "p", "div") else (_BLOCKS, "")
            return ({"p": _INLINE, "pre": _TEXT, "ul": _ITEMS, "ol": _ITEMS, "blockquote": _QUOTES}.get(tag, _TEXT if _heading(tag) else _BLOCKS), "")
        if above == _ITEMS:
            return (_INLINE if tag == "li" else _SKIP), ""
        if above == _QUOTES:
            return (_INLINE if tag == "p" else _SKIP), ""
        if above == _INLINE:
            if tag == "br":
                self.text.append(" +\n")
            mark = _MARKS.get(tag, "")
            self.text.append(mark)
            return _SPAN, f"[{dict(attrs).get('href') or ''}]" if tag == "a" else mark
        return (_SKIP if above == _SKIP else _SPAN), ""

    def _enter(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and not self.body:
            self.out, self.text = list(self.head), []
            content, behind, self.body = _BLOCKS, "", len(self.open) + 1
        else:
            above = self.open[-1][1]
            content, behind = self._content(tag, attrs)
            if above in (_BLOCKS, _ITEMS, _QUOTES):
                self.text = []
                if content == _ITEMS:
                    self.out.append("")
        self.open.append((tag, content, behind))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _leave(self) -> None:
        at_body = len(self.open) == self.body
        tag, content, behind = self.open.pop()
        self.count[tag] -= 1
        if self.body == -1:
            return
        if at_body:
            self.body = -1
        above = self.open[-1][1]
        if content == _SPAN:
            self.text.append(behind)
        elif content == _ITEMS:
            self.out.append("")
        elif content in (_INLINE, _TEXT):
            self._line(tag, "".join(self.text), above)

    def _line(self, tag: str, text: str, above: int) -> None:
        level = _heading(tag)
        if self.plain:
            if level:
                self.out += ["", f"{'=' * level} {text.strip()}", ""]
            elif tag == "pre":
                if text := text.rstrip():
                    self.out += ["[source,text]", "----", *text.splitlines(), "----", ""]
            else:
                self.out.append(text.strip())
            return
        text = text.strip()
        if level:
            self.out.append(f"{'=' * level} {text}")
        elif tag == "pre":
            if text:
                self.out += ["[source,text]", "----", text, "----"]
        elif above == _ITEMS:
            self.out.append(f"* {text}")
        elif above == _QUOTES:
            self.out += ["[NOTE]", f"==== {text}", ""]
        elif text:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.body == -1:
            return
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCK else set())
        while len(self.open) > 1 and self.open[-1][0] in closes:
            self._leave()
            if self.body == -1:
                return
        self._enter(tag, attrs)
        if tag in _VOID:
            self._leave()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.body != -1:
            self._enter(tag, attrs)
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if self.body != -1 and self.count.get(tag):
            while self.open[-1][0] != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        tag, content, _ = self.open[-1]
        if self.body == -1 or tag in ("script", "style"):
            return
        if content in (_INLINE, _SPAN, _TEXT):
            self.text.append(data)
        elif content == _BLOCKS and self.plain and (text := data.strip()):
            self.out.append(text)

    def lines(self, markup: str) -> list[str]:
        self.feed(markup)
        self.close()
        while len(self.open) > 1:
            self._leave()
        return self.out


def asciidoc(markup: str, plain: bool = False, head: tuple[str, ...] = ()) -> str:
    """One document as AsciiDoc; without text it is marked as empty."""
    automaton = _Automaton(plain, head)
    text = "\n".join(automaton.lines(markup or "")).rstrip()
    if (not automaton.body) if plain else not text.strip():
        return f"= [{EMPTY}]\n\n"
    return f"{text}\n"


def to_asciidoc(pages: DataFrame, key: str, markup: str, plain: bool = False, head: tuple[str, ...] = ()) -> DataFrame:
    """key and text: every page's markup as AsciiDoc; a null page is empty."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "text": [asciidoc(m or "", plain, head) for m in batch[markup]]})
        give_back()

    bound_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, markup).mapInPandas(convert, f"`{key}` {kind}, text string")


def heading_texts(markup: Column, level: int) -> Column:
    """The raw inner markup of a level's headings, as an expression."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))


def body_markup(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)<body[^>]*>(.*)</body>", 1)
