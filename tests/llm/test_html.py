"""Main text of pages: hand-written cases, broken markup, the style tree's counts against a plain version."""

import math
import time
from collections import Counter, defaultdict

from conftest_llm import plain

from ridgeline.llm.html_text import PAGES, extract_text, main_text, parse, site_tree, style_nodes

NONE = frozenset()


def test_articles_in_page_order():
    page = "<body><nav>menu</nav><article><h1>One</h1><p>a  b<br>c</p></article><aside><article>teaser</article></aside><article><p>Two &amp; three</p></article><footer>f</footer></body>"
    assert main_text(page, NONE) == "One\na b c\nTwo & three"


def test_no_article():
    assert main_text("<main><p>x<p>y</main><div>z</div>", NONE) == "x\ny"
    assert main_text("<div class=post><p>x</div><div>z</div>", NONE) == "x"
    assert main_text("plain <b>text</b> < 3", NONE) == "plain text < 3"
    assert main_text("", NONE) == main_text("<script>x</script><!-- y -->", NONE) == ""


def test_broken_markup():
    assert main_text("<article><p>a</b></i><p>b<div>c</article></div>", NONE) == "a\nb\nc"
    assert main_text("<article><a href='x>y</a>z</article>", NONE) == "yz"
    for bad in ("<a '" * 250_000, "<a \"" * 250_000, "</p>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<!-- " * 100_000, "<" * 500_000):
        began = time.process_time()
        parse(bad)
        assert time.process_time() - began < 20


def test_tags_that_run_into_each_other_take_linear_time():
    for bad in ('<a ">" ' * 150_000, "<a '>' " * 150_000, """<a ">'" '""" * 100_000, '<a b="' * 150_000, '<a x=">" y ' * 100_000 + "'", "<a 'x' <b " * 100_000):
        began = time.process_time()
        parse(bad)
        assert time.process_time() - began < 12


def test_article_text_stays_under_names_that_only_hold_a_noise_word():
    page = '<article class="comment-free"><div class="legal-analysis"><p>law</p></div><p class="share-price">price</p><p id="ad-astra">stars</p><div class="share-buttons">go</div><div class="post-comments">c</div><div class="ad-banner">a</div><div class="side-bar ad">b</div><div class="comment_12">d</div></article>'
    assert main_text(page, NONE) == "law\nprice\nstars"
    assert main_text('<div class="share-price">x</div><p>y</p>', NONE) == "y"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_importance_alone_decides(spark):
    """A block that is the same on a tenth of a host's pages goes, whatever the size of the host; others stay."""
    body = lambda i: f"<article><p>text {i} of its own</p>{'<div class=x1><span>same block</span></div>' if i % 10 == 0 else ''}</article>"
    rows = [(i, f"http://a.test/{i}", body(i)) for i in range(100)]
    for r in plain(extract_text(pages(spark, rows)), "page_id"):
        assert r["text"] == f"text {r['page_id']} of its own" and r["n_chars"] == len(r["text"])
    few = rows[: 10 * (PAGES - 2)]
    assert any("same block" in r["text"] for r in extract_text(pages(spark, few)).collect())


def test_site_tree(spark):
    rows = [(i, "h", f"<div class=c><p>{i % 3}</p></div><div class=d>same</div>") for i in range(12)]
    found = {r["path"]: (r["pages"], r["importance"]) for r in site_tree(spark.createDataFrame(rows, "page_id long, host string, html string")).collect()}
    seen = defaultdict(lambda: ([], []))
    for _, _, h in rows:
        for path, shown, content in style_nodes(h):
            seen[path][0].append(shown)
            seen[path][1].append(content)
    entropy = lambda xs: -sum(n / len(xs) * math.log(n / len(xs)) for n in Counter(xs).values()) / math.log(len(xs))
    assert found.keys() == seen.keys()
    for path, (shown, content) in seen.items():
        assert found[path][0] == len(shown) and abs(found[path][1] - 0.1 * entropy(shown) - 0.9 * entropy(content)) < 1e-9


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no host", "<p>x"), (1, "no host", "<p>x"), (2, "http://b.test", "")]
    assert [r["text"] for r in plain(extract_text(pages(spark, rows)), "page_id")] == ["", "x", "x", ""]
    assert extract_text(pages(spark, [])).collect() == []
