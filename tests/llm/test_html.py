"""Main text of ordinary and awkward markup; nothing of an article is lost."""

import random

import pytest

from civicspark.llm import html_text

SENTENCE = "The council met on Monday, heard the report of its water board, and voted to repair the old main along the river road. "
PARAGRAPHS = [SENTENCE * 3 + f"Number {k}." for k in range(8)]
JUNK = '<nav><a href=/>Home</a> <a href=/n>News</a></nav><div class="sidebar"><p>Side note, side note.</p></div><footer>Imprint</footer>'


def page(body):
    return f"<html><body>{JUNK}{body}</body></html>"


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_paragraphs_in_wrappers_stay_together(depth):
    body = "".join("<div>" * depth + f"<p>{p}</p>" + "</div>" * depth for p in PARAGRAPHS)
    assert html_text.main_text(page(f"<div id=content>{body}</div>")) == "\n".join(PARAGRAPHS)


def test_a_second_column_of_short_paragraphs():
    first = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:4])
    short = ["Work begins in May and lasts six weeks at least.", "Buses will take the northern bridge in that time."]
    html = page(f"<div id=content><div>{first}</div><div>{''.join(f'<p>{s}</p>' for s in short)}</div></div>")
    assert html_text.main_text(html) == "\n".join([*PARAGRAPHS[:4], *short])


@pytest.mark.parametrize("title", ["<div class=title><h1>{}</h1></div>", "<div class=post-header><h1>{}</h1></div>", "<h1>{}</h1>", "<div><div><h1>{}</h1></div></div>"])
def test_titles_in_wrappers(title):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])
    for html in (f"<div>{title.format('River road')}<div>{body}</div></div>", f"{title.format('River road')}<div><div>{body}</div></div>"):
        assert html_text.main_text(page(html)) == "\n".join(["River road", *PARAGRAPHS[:3]])


def test_lists_of_links_inside_an_article():
    items = [f"Reference {k} of the report" for k in range(5)]
    links = "".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(items))
    html = page(f"<article><p>{PARAGRAPHS[0]}</p><ul>{links}</ul><p>{PARAGRAPHS[1]}</p></article>")
    assert html_text.main_text(html) == "\n".join([PARAGRAPHS[0], *items, PARAGRAPHS[1]])
    outside = page(f"<div><p>{PARAGRAPHS[0]}</p><ul>{links}</ul><p>{PARAGRAPHS[1]}</p></div>")
    assert html_text.main_text(outside) == "\n".join(PARAGRAPHS[:2])


def test_names_of_paragraphs_inside_an_article():
    html = page(f'<article><p class="share price">{PARAGRAPHS[0]}</p><p class="notice">{PARAGRAPHS[1]}</p><p class="advert">Buy now.</p><div class="notice">Cookies!</div></article>')
    assert html_text.main_text(html) == "\n".join(PARAGRAPHS[:2])


def tree(rng, left, depth=0):
    """Markup of ``left`` paragraphs in random wrappers, at most five deep."""
    if len(left) == 1:
        wraps = rng.randint(0, 2) if depth < 4 else 0
        return "<div>" * wraps + f"<p>{left[0]}</p>" + "</div>" * wraps
    cut = rng.randint(1, len(left) - 1)
    parts = tree(rng, left[:cut], depth + 1) + tree(rng, left[cut:], depth + 1)
    return f"<section>{parts}</section>" if depth < 3 and rng.random() < 0.5 else parts


@pytest.mark.parametrize("seed", range(8))
def test_random_trees_under_one_content_element(seed):
    rng = random.Random(seed)
    assert html_text.main_text(page(f"<main>{tree(rng, PARAGRAPHS)}</main>")) == "\n".join(PARAGRAPHS)
    assert html_text.main_text(page(f"<article><h1>T</h1>{tree(rng, PARAGRAPHS)}</article>")) == "\n".join(["T", *PARAGRAPHS])


def test_layout_tables_and_long_pages():
    cells = "".join(f"<tr><td>{p}</td></tr>" for p in PARAGRAPHS)
    assert html_text.main_text(page(f"<table>{cells}</table>")) == "\n".join(PARAGRAPHS)
    long = "".join(f"<p>{p}</p>" for p in PARAGRAPHS * 2000)
    assert html_text.main_text(page(f"<div>{long}</div>")) == "\n".join(PARAGRAPHS * 2000)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, Text string")
    assert html_text.page_texts(pages).count() == 0
    some = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", None), (2, "u", "", None)], pages.schema)
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.page_texts(some).collect()) == [(1, "", 0), (2, "", 0), (2, "", 0)]
