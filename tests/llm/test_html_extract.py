import random
import time

import pytest

from scriptorium.llm import html_extract as H

PAGE = """<!doctype html><html><head><title>No</title><script>var a="</p><p>no";</script></head><body>
<header class="site"><h1>Site</h1><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></header>
<div id="cookie-notice">We use cookies. Please accept all of them, it is good for you.</div>
<main><article><h1>Title &eacute; &#x41;</h1><p>Some long <b>body</b>   text
here, with words.&nbsp;And more<p>Second &lt;p&gt; paragraph, 1 &amp; 2 < 3.<ul><li>item one</li><li>item two</li></ul>
<form><label>Your mail</label><input></form><!-- hidden --></article>
<section class="comments"><h2>Comments</h2><p>Nice article, I liked it very much. Thanks a lot for writing!</p></section></main>
<aside><p>Sidebar text about something else, long enough to look like content of its own.</p></aside>
<footer>&copy; site, all rights reserved</footer>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE).split("\n") == ["Title é A", "Some long body text here, with words. And more", "Second <p> paragraph, 1 & 2 < 3.", "item one", "item two"]


P1 = "The first paragraph of the story goes on for a while, with commas, and then it ends."
P2 = "A second one follows. It is also of some length, so that nobody doubts it is text."
LAYOUTS = {
    "classes": (f'<div class="topNav"><a href=/>Home</a> <a href=/a>About</a></div><div id="sideBar"><p>{P2} More.</p></div><div class="post-content"><h2>Story</h2><p>{P1}</p><p>Yes.</p><p>{P2}</p></div><div class="userComments"><p>{P1}</p></div><div class="ad-slot">{P1}</div>', ["Story", P1, "Yes.", P2]),
    "bare": (f'<ul class=menu><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{P1}<p>{P2}<div id=cookieNotice>We use cookies. {P1}</div><div id="footer">Imprint</div>', [P1, P2]),
    "sections": (f'<main><section><h1>Head</h1><p>{P1}</p><table><tr><td>cell one</td><td>cell two</td></tr></table><pre>a  b\n c</pre></section><section id="comments"><h3>3 comments</h3><p>{P1}</p><form><textarea>x</textarea><button>Send</button></form></section></main><aside><p>{P2}</p></aside>', ["Head", P1, "cell one", "cell two", "a b c"]),
    "inside": (f'<article><header><h1>Title</h1></header><p>{P1}</p><nav><a href=a>prev</a></nav><div class="notice">Subscribe. {P2}</div><p>See <a href=z>this page</a> too.</p><footer>By me</footer></article><article class="comment"><p>{P1}</p></article>', ["Title", P1, "See this page too."]),
    "hidden": (f'<article><p>{P1}</p><div style="display: none">{P2}</div><p hidden>{P2}</p><p data-x="hidden-y">{P2}</p></article>', [P1, P2]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, blocks = LAYOUTS[name]
    assert H.main_text(page).split("\n") == blocks


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</", "<!--", "<script>x", "<nav><a href=x>y</a></nav>", "&am"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<article><p>" + "word, " * 30_000 + "</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in H.extract_pages(frame).collect()), key=str)
    want = [(i, u, t, len(t)) for i, u, h, _ in rows for t in [H.main_text(h)]]
    assert got == sorted(want, key=str)
    assert len(want[3][2]) == 6 * 30_000 - 1
    assert H.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 7)
    gain = [r.uniform(-3, 3) for _ in range(n)]
    edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

    def cost(labels):
        own = sum(max(0, -g) if keep else max(0, g) for g, keep in zip(gain, labels, strict=True))
        return own + sum(c for a, b, c in edges if labels[a] != labels[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(H.minimum_cut(gain, edges)) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(10))
def test_whole_pages_against_all_labellings(seed):
    """The kept blocks of a small page are those of a labelling that no other undercuts."""
    r = random.Random(seed)
    parts = []
    for k in range(9):
        tag, name = r.choice(["p", "div", "li", "td"]), r.choice(["", "", " class=nav", " class=entry"])
        inside = f"{k} " + "word " * r.choice([1, 8, 20]) + r.choice(["", ".", "?"])
        parts.append(f"<{tag}{name}>{f'<a href=x>{inside}</a>' if r.random() < 0.3 else inside}</{tag}>")
    page = "<div>" + "</div><div>".join(" ".join(parts[i : i + 3]) for i in range(0, 9, 3)) + "</div>"
    blocks = H.blocks_of(page)
    gain, edges = [H.score_block(b) for b in blocks], H.smoothness(blocks)

    def cost(mask):
        own = sum(max(0, -g) if mask >> i & 1 else max(0, g) for i, g in enumerate(gain))
        return own + sum(c for a, b, c in edges if (mask >> a & 1) != (mask >> b & 1))

    kept = {int(line.split()[0]) for line in H.main_text(page).split("\n") if line}
    mask = sum(1 << i for i, b in enumerate(blocks) if int(b.text.split()[0]) in kept)
    assert len(blocks) == 9 and cost(mask) == pytest.approx(min(map(cost, range(1 << 9))))


def test_the_cut_turns_a_short_block_between_paragraphs():
    page = f"<div><div><p>{P1}</p></div><div><div>Yes it does indeed</div></div><div><p>{P2}</p></div></div>"
    blocks = H.blocks_of(page)
    gain = [H.score_block(b) for b in blocks]
    assert [g > 0 for g in gain] == [True, False, True] and all(H.minimum_cut(gain, H.smoothness(blocks)))


def test_long_and_deep_pages_take_seconds():
    begin = time.monotonic()
    many = "".join(f"<div><p>Paragraph {i} has some words, and ends.</p><li><a href=x>link {i}</a></li><td>{i}</td></div>" for i in range(20_000))
    assert H.main_text(many).count("Paragraph") == 20_000
    deep = "<div>" * 50_000 + f"<p>{P1}</p>" + "</div></b></i>" * 50_000 + f"<p>{P2}</p>"
    assert H.main_text(deep) == f"{P1}\n{P2}"
    inline = "<b><x>" * 30_000 + f"<p>{P1}" + "</q></x>" * 30_000
    assert H.main_text(inline) == P1
    n = 30_000  # nothing decides by itself: one long chain for the flow
    r = random.Random(1)
    H.minimum_cut([r.uniform(-1, 1) for _ in range(n)], [(i, i + 1, 1.0) for i in range(n - 1)])
    assert time.monotonic() - begin < 40
