"""Pages: title, language, date and text. The parser is Python's, for markup that is not well formed."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "br", "section", "article", "blockquote", "title", "body", "main", "ul", "ol", "table"}
VOID = {"br", "img", "hr", "input", "meta", "link"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.skip: list[str] = []
        self.title: list[str] = []
        self.in_title = False

    def _close(self) -> None:
        text = " ".join("".join(self.now).split())
        if text and (not self.blocks or self.blocks[-1] != text):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)
        if tag in BLOCKS:
            self._close()
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[self.skip.index(tag) :]
        if tag in BLOCKS:
            self._close()
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.now.append(data)


def read(html: str | None) -> dict[str, str | list[str] | None]:
    """Title and text blocks; neighbours that repeat are one block."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return {"title": " ".join("".join(reader.title).split()) or None, "blocks": reader.blocks}


def extract(html: Column) -> Column:
    """``title`` and ``blocks`` of a page."""
    return F.udf(read, "title string, blocks array<string>", useArrow=True)(html)


def first_date(text: Column) -> Column:
    """The first plausible ISO date (1990 to 2039) in ``text``."""
    found = F.regexp_extract(text, r"((?:199|20[0-3])[0-9]-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))", 1)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd"))


def tag_text(html: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
