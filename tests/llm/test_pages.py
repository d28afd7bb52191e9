import re
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidepool.llm.html_text import extract, main_text

LONG = "The house on the hill was built by the people who came to it from the sea and it is old, for it was there when the town was not. " * 2


def test_article_with_everything_around_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <article><h1>A  title</h1><p>One &amp; two<br>three&nbsp;four.</p><div class="ad-slot">Buy now</div><p>Short.<form><label>Name</label></form>
    <p class="share">Share this</p><p>{LONG}</p><section id="comments"><p>{LONG} said a reader.</p></section></article>
    <aside>More</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "\n".join(["A title", "One & two three four.", "Short.", " ".join(LONG.split())])


def test_page_without_an_article_element():
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h2>Head</h2><p>{LONG}</p><p>So it was.</p><p>{LONG}</p></div><div><a href=z>About</a> us</div>"
    assert main_text(page) == "\n".join(["Head", " ".join(LONG.split()), "So it was.", " ".join(LONG.split())])


def test_wrappers_with_a_mark_word_lose_no_text():
    text, comments = " ".join(LONG.split()), f'<div id="comments"><p>{LONG} said a reader.</p></div>'
    around = "<nav><a href=x>Home</a></nav>", "<div class='ad'>Buy now</div><footer>&copy; me</footer>"
    for wrapper in ('<body class="has-sidebar">', '<div id="content-with-ads">', '<form action="./page.aspx">', '<body class="has-header"><form><div class="share-bar">'):
        for page in (f"<article><p>{LONG}</p><p>So it was.</p>{comments}</article>", f"<div><p>{LONG}</p><p>So it was.</p><p>{LONG}</p></div>"):
            want = [text, "So it was."] + [text] * ("<article" not in page)
            assert main_text(wrapper + around[0] + page + around[1]) == "\n".join(want)
    assert main_text(f"<article><p>{LONG}</p></article><div class=related><article><p>Another one.</p></article></div>") == text
    assert main_text(f"<article><p>A.</p></article>{comments}") == "A." and main_text(f"<div hidden><p>{LONG}</p></div>") == ""


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x") == main_text("<!-- a") == ""
    assert main_text("<article><p>a < b &lt; c</p><p><b>open") == "a < b < c\nopen"
    assert main_text("<article><p>x</p><!-- <p>no</p> --><p>y &am z</p>") == "x\ny &am z"


def test_pages_table(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", "<article><p>é x</p></article>", "clash"), (None, None, None, None), (1, "u", "", "clash"), (2, "u", "<article><p>" + "w " * 100_000, None)], schema)
    got = [(r.page_id, r.n_chars) for r in extract(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, 3), (None, 0), (1, 0), (2, 199_999)]))
    assert extract(df.limit(0)).count() == 0


def article_of(page):
    import html
    import re

    own = page[page.index("<article>") : page.index("</article>")]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|article)>", own))
    return "\n".join(p for p in parts if p)


def test_all_sample_pages_give_their_article_with_and_without_its_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in extract(pages).collect()} == want
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)(article|main)>", "$1div>"))
    assert {r.page_id: r.text for r in extract(renamed).collect()} == want


def test_menus_and_footers_without_their_elements():
    """Nothing marks a block: links, the copyright sign and stop words alone decide."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    plain = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p.replace(' class="ad"', "")) for p in pages]
    got = [main_text(p) for p in plain]
    want = [Counter(article_of(p).split("\n")) for p in pages]
    kept = sum((w & Counter(t.split("\n"))).total() for w, t in zip(want, got, strict=True)) / sum(w.total() for w in want)
    assert kept > 0.9, kept  # short paragraphs beside a menu go with it
    assert not any("\xa9" in t for t in got)


def test_ties_between_neighbours():
    """Of two neighbours equally far off the good one decides; a heading goes with what follows."""
    links, good = "<div><a href=x>Home</a></div>", f"<p>{LONG}</p>"
    text = " ".join(LONG.split())
    assert main_text(f"{links}<p>Short.</p>{good}") == f"Short.\n{text}" and main_text(f"{good}<p>Short.</p>{links}") == f"{text}\nShort."
    assert main_text(f"{good}<h2>Head</h2>{links}") == text and main_text(f"{links}<h2>Head</h2>{good}") == f"Head\n{text}"
    assert main_text(f"{links}<p>Far.</p><p>Near.</p><p>Nearer.</p>{good}").startswith("Near.\nNearer.")
    assert main_text("<p>Only short.</p>") == "Only short." and main_text(links) == ""


def test_text_around_an_article_element():
    enclosed = f"<article>{LONG}</article><p>{LONG} Between.</p><article>{LONG}</article>"
    text = " ".join(LONG.split())
    assert main_text(enclosed) == f"{text}\n{text} Between.\n{text}"
    assert main_text(f"<p>{LONG} Before.</p><article><p>{LONG}</p></article><p>After.</p>") == text
