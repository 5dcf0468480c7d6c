"""Main texts of pages against the articles they were made of."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import sentence  # noqa: E402
from gridloom.llm import html_extract  # noqa: E402
from gridloom.llm.html_extract import MIN_SUPPORT, Matching, content, decide, extract_main_text, figures, induce_slots, loaded, parse  # noqa: E402


def plain(page):
    return content(*parse(page))


def test_blocks_entities_and_what_is_left_out():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>if (a<b) '</p>';</script></head><body><header>Top</header><nav><a href='/x'>Menu</a></nav>"
        "<div class='cookie-notice'>We use</div><article><h1>One &amp; two</h1><p>a <b>b</b>c<br>d&nbsp;e &copy; <p>f\n\t g<div class=comments><p>troll</div><aside>side</aside>"
        "<form><input>q</form></article><div id='sidebar'>s</div><footer>foot</footer></body></html>"
    )
    assert plain(page) == "One & two a bc d e © f g"


def test_broken_pages():
    assert plain(None) == plain("") == "" and plain("just text") == "just text"
    assert plain("<article><p>cut off <b>he") == "cut off he" and plain("<article>a<p>b</article><p") == "a b"
    assert plain("<article>1 < 2 & 3</article>") == "1 < 2 & 3"
    assert plain("<script>never closed <article>x</article>") == ""


def brute(x, i, y, j):
    """Pairs of nodes of the subtrees at i in x and at j in y."""
    if x[i].tag != y[j].tag:
        return 0
    a, b = x[i].kids, y[j].kids
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for p, k in enumerate(a, 1):
        for q, m in enumerate(b, 1):
            table[p][q] = max(table[p - 1][q], table[p][q - 1], table[p - 1][q - 1] + brute(x, k, y, m))
    return 1 + table[-1][-1]


def random_tree(rng, depth):
    tags = rng.sample(["div", "ul", "b", "i"], 4)
    return "".join(f"<{t}>{random_tree(rng, depth - 1)}</{t}>" for t in tags[: rng.randrange(4)]) if depth else ""


def test_tree_matching_is_the_largest(monkeypatch):
    rng = random.Random(3)
    for k in range(40):
        a, b = random_tree(rng, 4), random_tree(rng, 4)
        x, y = parse(a)[0], parse(b)[0]
        monkeypatch.setattr(html_extract, "SMALL", 4096 if k % 2 else 0)  # tables of numbers, and by rows of arrays
        matching = Matching(induce_slots([b]))
        found = matching.align(x)
        assert matching.value(x[0].shape, 0) == brute(x, 0, y, 0) == sum(u >= 0 for u in found)
        slots = matching.slots
        assert all(u < 0 or slots.tags[u] == x[i].tag and (i == 0 or slots.ups[u] == found[x[i].up]) for i, u in enumerate(found))


def test_runs_of_siblings_share_a_slot_either_way(monkeypatch):
    page = "<body><ul>" + "<li>a</li>" * 9 + "</ul><p>x</p><p>y</p></body>"
    longer = "<body><div>new</div><ul>" + "<li>a</li>" * 300 + "</ul><p>x</p></body>"
    slots = induce_slots([page])
    assert slots.tags.count("li") == 1 and slots.tags.count("p") == 2
    ways = []
    for small in (0, 4096):
        monkeypatch.setattr(html_extract, "SMALL", small)
        ways.append(Matching(slots).align(parse(longer)[0]))
    assert ways[0] == ways[1] and ways[0].count(slots.tags.index("li")) == 300 and ways[0].count(-1) == 1


def test_deep_and_wide_pages():
    deep = "<div>" * 10_000 + "text" + "</div>" * 10_000
    other = "<div>" * 10_000 + "<p>more</p>" + "</div>" * 9_000
    slots = induce_slots([deep, other])
    assert len(slots.tags) == 10_002 and Matching(slots).align(parse(deep)[0]).count(-1) == 0
    assert plain(deep) == "text"
    wide = "<body>" + "<p>a</p><h2>b</h2>" * 5_000 + "</body>"
    found = Matching(induce_slots([wide])).align(parse("<body>" + "<p>a</p><h2>b</h2>" * 2_000 + "</body>")[0])
    assert found.count(-1) == 0 and len(set(found)) == len(found)


def divs(rng, k):
    """A page without a telling element or name, and its article."""
    words = lambda n: sentence(rng, n)
    body = [words(9), *(words(rng.randrange(8, 60)) + "." for _ in range(rng.randrange(2, 9)))]
    menu = "".join(f"<div><a href='/{i}'>{words(1)}</a></div>" for i in range(rng.randrange(4, 8)))
    notice = f"<div>Get it now: {words(4)}</div>" if k % 3 else ""
    return f"<body><div>{menu}</div>{notice}<div><h1>{body[0]}</h1>{''.join(f'<p>{x}</p>' for x in body[1:])}<p>Read more on our site</p></div><div>&copy; {words(5)}</div></body>", " ".join(body)


def test_the_wrapper_finds_articles_without_elements_and_names(spark):
    rng = random.Random(5)
    made = [divs(rng, k) for k in range(60)]
    rows = [(k, "https://one.example/" + str(k), page) for k, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert sum(got[k] == text for k, (_, text) in enumerate(made)) == 60
    assert sum(plain(page) == text for page, text in made) == 0  # so without the wrapper


def test_what_only_some_seeds_share_is_content():
    rng = random.Random(6)
    pages = [divs(rng, k)[0].replace("Read more on our site", "The same line") if k < 2 else divs(rng, k)[0] for k in range(30)]
    slots = induce_slots(pages[:4])
    sums = {}
    for page in pages:
        for key, row in figures(page, Matching(slots)).items():
            sums[key] = [a + b for a, b in zip(sums.get(key, [0] * 4), row)]
    wrapper = decide(slots, [(*k, *v) for k, v in sums.items()], names=False)
    texts = [loaded(slots.dump(), html_extract.json.dumps(wrapper)).text(p, names=False) for p in pages]
    assert all("The same line" in t for t in texts[:2]) and not any("Read more" in t for t in texts[2:])
    assert not any("Get it now" in t or "©" in t for t in texts)


def test_constant_nodes_of_a_host_become_template(spark):
    rng, rows = random.Random(1), []
    for i in range(MIN_SUPPORT + 10):
        body = sentence(rng, 12)
        rows.append((i, "http://Host.example/a", f"<body><div><p>Read our promise to you.</p></div><div><p>{body}</p><p>{sentence(rng, 9)}.</p></div><div><p>All rights reserved</p></div></body>"))
    rows += [(900, "http://other.example/", "<body><p>alone</p></body>"), (901, None, None), (902, "http://host.example/b", "")]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("promise" not in got[i].text and "rights" not in got[i].text and len(got[i].text.split()) == 21 for i in range(MIN_SUPPORT + 10))
    assert got[900].text == "alone" and got[901].text == "" and got[902].n_chars == 0 and got[901].url is None


def test_copies_of_one_page_stay_whole(spark):
    rows = [(i, "http://h.example/", "<body><p>same text</p></body>") for i in range(MIN_SUPPORT * 2)]
    assert {r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"same text"}
