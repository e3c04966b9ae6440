"""HTML to text with a real parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that break a line, and tags whose content is not shown.
_BREAKS = frozenset(("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4"))
_HIDDEN = frozenset(("script", "style"))
_SPACES = re.compile(r"[ \t]+")


class _Text(HTMLParser):
    """Collects what is shown; block tags begin and end a line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.shown: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BREAKS:
            self.shown.append("\n")

    def handle_endtag(self, tag):
        if tag in _BREAKS and tag != "br":  # a line break has no end of its own
            self.shown.append("\n")
        elif tag in _HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.shown.append(data)


def to_text(html: str | None) -> str | None:
    """The text of a page: null stays null; runs of spaces and of blank lines are cut short."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = [_SPACES.sub(" ", line) for line in "".join(p.shown).split("\n")]
    return "\n".join(line for line, before in zip(lines, ["", *lines]) if line or before).strip()


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`; batches of rows go to a parser in the Python workers."""
    from clauselake.session import ship

    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(to_text)

    return pages.withColumn("text", run(html))
