"""Pages of the given table, and long broken ones."""

from __future__ import annotations

import re
import time

import pytest

from vibrary.llm import html

DATA = "/root/testdata/sf0.001"
LONG = 1_000_000


def test_every_page_comes_back(spark) -> None:  # noqa: ANN001
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = html.op1_html_extraction(spark, DATA).collect()
    assert {r.page_id for r in got} == pages.keys() and len(got) == len(pages)
    tree = html.train_tree(spark)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == " ".join(r.text.split())
        assert not re.search(r"</?(?:p|div|script|article)\b", r.text)
        assert r.text == html.main_text(pages[r.page_id].html, tree)
    assert sum(r.n_chars > 200 for r in got) > 0.8 * len(got)
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", "", 2), (None, None, "<p>x", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html.extract(odd, 1).collect()) == [("", 0), ("", 0), ("x", 1)]


@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
@pytest.mark.parametrize("piece", ["<div class=", "<a ", '<p "', "<p '", "<div>", "<div></ul>", "<!-- ", "<!", '<a "x>" ', "<svg>", "<select>", "<script>", "</p", "&", "<div <p>x", "<head>", "class="])
def test_broken_markup_is_read_once(piece, end) -> None:  # noqa: ANN001
    began = time.time()
    html.blocks(piece * (LONG // len(piece)) + end)
    assert time.time() - began < 20


def test_closing_tags_of_nothing_are_cheap() -> None:
    began = time.time()
    assert html.blocks("<div>" * 100_000 + "</ul>" * 100_000 + "words") == [("words", 0.0, 0, 0)]
    assert time.time() - began < 20


def test_tags_that_do_not_end() -> None:
    assert [b[0] for b in html.blocks("<p>One <b>two</p><div class=x <p>three</p>four <i ")] == ["One two", "three", "four <i"]
    assert [b[0] for b in html.blocks("<p>a < b > c</p>x <!-- gone")] == ["a < b > c", "x"]
    assert [b[0] for b in html.blocks("<p title='a > b <c>'>kept</p> <!-- a > b --> end <!-- > gone <p>no")] == ["kept", "end"]
