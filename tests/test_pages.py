"""Text of filing pages against plain patterns, and the time that hostile pages take."""

import html
import random
import re
import time

import pytest

from tidemark.sources import pages as pg

SILENT = re.compile(r"<(%s)\b.*?</\1\s*>|<!--.*?-->" % "|".join(pg.SILENT), re.S | re.I)
BREAK = re.compile(r"</?(%s)\b[^>]*>" % "|".join(pg.BLOCKS), re.I)
PIECES = ["<p>", "</p>", "<script>", "</script >", "<style", "</style>", "<!--", "-->", "<b>", "<", "> ", "a", "b &amp;", "\n", "<br/>", "</Div>", "<scripty>", "<head>x</head>",
          "<DIV class='x>y'>", "<>", "< p>", " ", "</script"]


def plain(markup):
    body = re.sub(r"<[^>]+>", "", BREAK.sub("\n", SILENT.sub("", markup)))
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def test_text_equals_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        page = "".join(rng.choices(PIECES, k=rng.randrange(14)))
        assert pg.page_text(page) == plain(page), page
    assert pg.page_text(None) is None


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<p ", "<", "<style></stylex>", "<script></script>", "<div>", "&", "<head", "a <b "])
def test_pages_of_five_megabytes(piece):
    start = time.process_time()
    pg.page_text(piece * (5_000_000 // len(piece)))
    assert time.process_time() - start < 8  # a second, on a quiet machine
