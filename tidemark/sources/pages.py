"""Filing pages to acceptance instants, exhibit links and plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

# Elements that end a line of text, and elements whose content is not text
BLOCKS = ("address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "li", "ol", "p", "pre", "section", "table", "tr", "ul")
SILENT = ("script", "style", "head", "noscript", "template")

_OPEN = re.compile(r"<(%s)\b|<!--" % "|".join(SILENT), re.I)
_ENDS = {kind: re.compile(rf"</{kind}\s*>", re.I) for kind in SILENT} | {"": re.compile("-->")}
_BREAK = re.compile(r"</?(%s)\b[^>]*>" % "|".join(BLOCKS), re.I)
_TAG = re.compile(r"<[^>]+>")
_SPACE = re.compile(r"[^\S\n]+")


def without_silent(markup: str) -> str:
    """The page without comments and silent elements. One without its end stays: whether there is an end further on is looked up once per
    kind and each time the last one found is passed, so a page is read once however many elements are left open."""
    out, at, ends = [], 0, {}
    for m in _OPEN.finditer(markup):
        if m.start() < at:
            continue
        kind = (m[1] or "").lower()
        found = ends.get(kind)
        if kind not in ends or found is not None and found.start() < m.end():
            found = ends[kind] = _ENDS[kind].search(markup, m.end())
        if found is not None:
            out.append(markup[at:m.start()])
            at = found.end()
    return "".join(out) + markup[at:]


def page_text(markup: str | None) -> str | None:
    """Visible text of one page, one line per block, blank lines dropped. Tags are looked for before the last closing bracket only, where each one
    that begins has an end."""
    if markup is None:
        return None
    body, bracket, rest = without_silent(markup).rpartition(">")
    body, bracket, rest_ = _BREAK.sub("\n", body + bracket).rpartition(">")
    body = _TAG.sub("", body + bracket) + rest_ + rest
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def plain_text(markup: Column) -> Column:
    """`page_text` over Arrow batches; pages are independent, so this runs where they are."""
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(page_text)
    return convert(markup)


def accepted_instant(markup: Column) -> Column:
    """UTC instant after the word Accepted, read as New York time; null when absent. A reading that names two instants is the later one,
    so that nothing is known before it was accepted."""
    found = F.regexp_extract(markup, r"Accepted[^0-9]{0,80}(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    return fn.later_utc(F.when(found != "", found).try_cast("timestamp"))


def exhibit_link(markup: Column) -> Column:
    """Link of the EX-99.1 row, else of the first EX-99 row."""
    row = r"(?is)href=\"([^\"]+)\"[^<>]*>[^<>]*</a>\s*</td>\s*<td[^>]*>\s*%s\s*<"
    exact, any_ = (F.regexp_extract(markup, row % t, 1) for t in (r"EX-99\.1", r"EX-99[^<]*"))
    return F.coalesce(F.when(exact != "", exact), F.when(any_ != "", any_))


def extract_filing_pages(pages: DataFrame) -> DataFrame:
    """page_id, accepted, exhibit and text of every page."""
    m = F.col("html")
    return pages.select("page_id", accepted_instant(m).alias("accepted"), exhibit_link(m).alias("exhibit"), plain_text(m).alias("text"))
