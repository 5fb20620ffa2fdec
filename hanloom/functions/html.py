"""Titles and text of HTML, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Elements whose content is no text of the page, and those that end a line.
SILENT = {"script", "style", "noscript", "template", "svg", "head"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "dd", "dt"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: dict[str, list[str]] = {"title": [], "h1": []}
        self.out: list[str] = []
        self.silent: list[str] = []
        self.inside: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
        if tag in self.titles and not self.titles[tag]:
            self.inside = tag
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]
        if tag == self.inside:
            self.inside = None
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.inside:
            self.titles[self.inside].append(data)
        if not self.silent:
            self.out.append(data)


def read_html(markup: str | None) -> tuple[str | None, str | None]:
    """(title or first heading, text by lines); nothing for null."""
    if markup is None:
        return None, None
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    title = next((t for k in ("title", "h1") if (t := re.sub(r"\s+", " ", "".join(reader.titles[k])).strip())), "")
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(reader.out).split("\n"))
    return title, "\n".join(x for x in lines if x)


def page(markup: Column) -> Column:
    """struct<title, text> of each page."""
    from ..session import ship

    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(m) for m in pages], columns=["title", "text"])

    from pyspark.sql import SparkSession

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(parse, StructType().add("title", "string").add("text", "string"))(markup)
