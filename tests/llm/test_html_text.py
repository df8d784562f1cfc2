"""Main text: ratios decide, names only weigh; plain counterparts on pages and random trees; hostile markup."""

import html
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarry.llm import html_text

PARAGRAPHS = [f"Paragraph {k} of the story goes on for a good while, with words enough to weigh, sentence {k * 7}." for k in range(20)]
LONG = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


def plain_article(page):
    """The blocks of the one <article> of a page of the test tables, by patterns."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)]
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_plain(sf):
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet").column("html").to_pylist()
    assert pages and [html_text.main_text(p) for p in pages] == [plain_article(p) for p in pages]


def test_flat_and_shuffled_ratios_change_the_text(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found, smoothed, rng = [html_text.main_text(p) for p in pages], html_text.smoothed, random.Random(1)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: [1.0] * len(ratios))
    assert all(html_text.main_text(p) != x for p, x in zip(pages, found))
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: rng.sample(smoothed(ratios), len(ratios)))
    assert sum(html_text.main_text(p) != x for p, x in zip(pages, found)) > len(pages) // 20


def test_ratios_tell_content_in_pages_without_names():
    links = "".join(f"<div><a href=/{k}><span>Topic {k}</span></a></div>" for k in range(8))
    text = html_text.main_text(f"<body><div>{links}</div><div><h2>Head</h2>{LONG}<p>Short.</div><div>{links}</div></body>")
    assert text == "\n".join(["Head", *PARAGRAPHS, "Short."])
    cells = "".join(f"<tr><td>{k}<td>x{k}" for k in range(30))  # neither links nor names
    assert html_text.main_text(f"<body><div><table>{cells}</table></div><div>{LONG}</div>") == "\n".join(PARAGRAPHS)


def test_an_article_only_weighs():
    assert html_text.main_text(f"<article><p>Short teaser.</p></article><div>{LONG}</div>").endswith("\n".join(PARAGRAPHS))
    assert html_text.main_text(f"<div><p>Teaser outside.</p></div><article><h1>A</h1>{LONG}</article>") == "\n".join(["A", *PARAGRAPHS])


def test_names_do_not_decide_alone():
    assert html_text.main_text(f'<div class="search-results">{LONG}</div>') == "\n".join(PARAGRAPHS)
    assert html_text.main_text('<p class="search-results">One sentence that a reader came for.</p><div class="post tags-page">And a shorter one.</div>') != ""
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Item {k}</a>" for k in range(5)) + "</ul>"
    assert html_text.main_text(f"<body>{menu}<div>{LONG}</div>") == "\n".join(PARAGRAPHS)
    comments = "<section id=comments>" + "<article class=comment><p>I have read it, and I think so too, at length.</article>" * 60 + "</section>"
    assert html_text.main_text(f"<main><article>{LONG}</article>{comments}</main>") == "\n".join(PARAGRAPHS)
    assert html_text.main_text("<nav>Menu</nav>") == html_text.main_text("<nav>Menu</nav><footer>All rights reserved by those who hold them.</footer>") == ""
    assert html_text.main_text("<div class=ad>Buy this now</div><article></article><footer>Foot</footer>") == ""


def test_smoothing_against_convolution():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        v = rng.random(n) * 100
        kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
        plain = np.convolve(v, kernel)[3:-3] / np.convolve(np.ones(n), kernel)[3:-3]
        assert np.allclose(html_text.smoothed(v.tolist()), plain)
    assert html_text.smoothed([5.0, 0.0, 5.0])[1] == 0


def test_region_gains_against_plain():
    """Sums over elements by walking up from every line."""
    rng = random.Random(3)
    for _ in range(60):
        page = html_text.Page()
        page.read("".join(rng.choice(["<div>", "</div>", "<p>some words", "<li>x", "<b>bold</b>", "<section>", "</section>", "<ul>"]) for _ in range(rng.randint(1, 80))))
        gains = {e: rng.uniform(-5, 5) for _, _, e in page.lines}
        plain = [0.0] * len(page.tag)
        for element, gain in gains.items():
            up = element
            while True:
                plain[up] += gain
                if not up:
                    break
                up = page.parent[up]
        assert np.allclose(page.summed(gains), plain)


@pytest.mark.parametrize("markup", [
    "<div>x" * 100_000, "<div class=ad>x" * 50_000, "<i><div>" + "<b>x" * 50_000 + "</i>" * 50_000, "<div>x" * 50_000 + "</p>" * 50_000, "<" * 50_000, "<!--a>" * 100_000, "<![x>" * 20_000,
    "<a " * 100_000, '<a b="' * 50_001 + ">", '<a b=">' * 50_001, "<![CDATA[>" * 50_000, "</a" * 100_000, "<?a" * 100_000, "<script>" + "</a>" * 100_000, "<ul><li>" * 50_000, "&#" * 100_000,
], ids=range(16))
def test_time_grows_with_length(markup):
    start = time.time()
    html_text.main_text(markup)
    assert time.time() - start < 20  # seconds; what grows with the square takes minutes


def test_cut_off_pages_keep_their_last_words():
    assert html_text.main_text('<p>First words</p><p>last &amp; words <a href="htt') == "First words\nlast & words"
    assert html_text.main_text("<p>a < b and c") == "a < b and c"
    assert html_text.main_text(f"<div>{LONG}</div><script>var a = '<p>';") == "\n".join(PARAGRAPHS)
