"""Nothing of an article is lost: quotes and comments as HTML reads them, names and shared headings inside it, stray tags."""

import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import sentence  # noqa: E402
from gridloom.llm.html_extract import content, extract_main_text, parse  # noqa: E402


def plain(page):
    return content(*parse(page))


def test_quotes_count_only_after_a_sign_of_equality():
    assert plain("<article><p class=don't>One <b title=\"a > b\">two</b> three</p><p data-x='>' y>four</p><p a\"b>five</p></article>") == "One two three four five"
    assert plain("<article><p title=it's class=x id = 'q'>a</p><a href=x/y?z='1'>b</a></article>") == "a b"


def test_empty_and_odd_comments():
    assert plain("<article><!-->a<p>b<!--->c<!-- x -- y --!>d<!---->e</article>") == "a bcde"
    assert plain("<article>a<!-- never closed <p>b</article>") == "a"


def test_an_attribute_given_twice_is_its_first():
    assert plain("<div class=footer class=x>no</div><div class=x class=footer>yes</div>") == "yes"


def test_many_stray_end_tags_take_little_time():
    began = time.time()
    page = "<article>" + "<div>" * 20_000 + "text" + "</zz>" * 20_000 + "<span>" * 5000 + "</p>" * 5000 + "<i>" * 3000 + "<li>x" * 500
    assert plain(page).startswith("text") and time.time() - began < 5


def site(n, seed=3):
    """Pages of a host, and what their articles say: shared headings, paragraphs with telling names, an advert and comments."""
    rng = random.Random(seed)
    pages, wants = [], []
    for k in range(n):
        a, b, c, d = (sentence(rng, 25) for _ in range(4))
        pages.append((k, f"https://s.example/{k}", (
            f"<html><body><div class=don't><a href=/>Home</a><a href=/n>News</a></div><!--><div class=wrap><h1>{a[:30]}</h1><h2>Summary</h2><p>{a}</p><p class='share-prices'>{b}</p>"
            f"<div class=ad>Buy {rng.choice('xyz')} now</div><h2>Details</h2><p class=notice>{c}</p><p class='related'>{d}</p><h3>Related</h3><ul class=related><li><a href=/1>{sentence(rng, 3)}</a><li><a href=/2>{sentence(rng, 3)}</a></ul></div>"
            f"<div id=comments><p>{sentence(rng, 4)}</p></div><footer>All rights</footer></body></html>")))
        wants.append(" ".join([a[:30].strip(), "Summary", a, b, "Details", c, d]))
    return pages, wants


def test_names_and_shared_headings_inside_the_article(spark):
    pages, wants = site(12)
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k] for k, *_ in pages] == wants
