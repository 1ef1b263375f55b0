import itertools
import random

from sonoframe.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><div class="cookie-notice"><p>We use cookies, and you accept them by reading this long notice.</p></div>
<main><article><header><h1>A title &amp; more</h1></header><p>First   paragraph with <b>bold</b> text&nbsp;and a<br>break, and enough words to count.<p>Second paragraph, unclosed, which goes on for a while as well.
<aside><p>An aside with a promotion that should not be here at all.</p></aside><ul><li>A first point of the list that matters.</li><li>A second point of it.</li></ul>
<blockquote>Quoted words.</blockquote></article><section id="comments"><h2>Comments</h2><p>What a great article, I liked it very much indeed.</p></section></main>
<form><label>Mail</label><textarea>typed</textarea><button>Send</button></form><!-- <p>hidden</p> --><div class="ad">Buy this now.</div><footer><p>&copy; 2020 Somebody. All rights reserved.</p></footer></body>"""


def test_a_page():
    assert extraction.main_text(PAGE).split("\n\n") == [
        "A title & more", "First paragraph with bold text and a break, and enough words to count.", "Second paragraph, unclosed, which goes on for a while as well.",
        "A first point of the list that matters.", "A second point of it.", "Quoted words.",
    ]


def test_without_an_article_element():
    page = "<body><div id=nav><a href=1>One</a> <a href=2>Two</a></div><div class=content><h2>Head</h2><p>" + "Words of the story go on and on. " * 5 + "</p><p>Short.</p></div><div class='sidebar'><p>Other stories of the day.</p></div></body>"
    found = extraction.main_text(page).split("\n\n")
    assert found[0] == "Head" and found[-1] == "Short." and len(found) == 3


def test_broken_pages():
    assert extraction.main_text(None) == "" == extraction.main_text("") == extraction.main_text("<script>never ends") == extraction.main_text("<!-- never ends")
    assert extraction.main_text("<article><p>a < b and c > d in plain words here.</p></article>") == "a < b and c > d in plain words here."
    assert extraction.main_text("</p></div></article><article><p>Fine words stand here after all.") == "Fine words stand here after all."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 7)
        source, sink = [rng.randint(0, 6) for _ in range(n)], [rng.randint(0, 6) for _ in range(n)]
        edges = [(a, b, float(rng.randint(0, 3))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(kept):
            return sum(s for s, k in zip(source, kept) if not k) + sum(t for t, k in zip(sink, kept) if k) + sum(c for a, b, c in edges if kept[a] != kept[b])

        assert abs(cost(extraction.minimum_cut(source, sink, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


ARTICLE = "<article><h1>A headline of some length</h1>" + "".join(f"<p>Paragraph {k} says something in plain words, and then says some more of it, until it ends.</p>" for k in range(4)) + "</article>"


def test_scripts_may_hold_anything():
    want = extraction.main_text(f"<body>{ARTICLE}</body>")
    assert want.count("\n\n") == 4
    for raw in ("<script>for(var i=0;i<n;i++){}</script>", "<script>if(a<b)x('it')</script>", "<script>s = '<!--'; t = \"<p>\"</script >", "<style>a>b{content:'<'}</style>", "<svg><path d='a<b'/></svg>", "<SCRIPT>i<n;</SCRIPT>"):
        assert extraction.main_text(f"<body>{raw}{ARTICLE}</body>") == want, raw


def test_names_of_containers_are_weighed():
    want = extraction.main_text(f"<body>{ARTICLE}</body>")
    side = "<div class='sidebar'><p>Other stories of the week stand here.</p></div>"
    for head, tail in (("<div class='layout has-sidebar'>", "</div>"), ("<div class='post tags-music'>", "</div>"), ("<div id='search-result'>", "</div>"), ("<form action='/'>", "</form>"), ("<div class='header'>", "</div>")):
        assert extraction.main_text(f"<body>{head}{ARTICLE}{tail}{side}</body>") == want, head
    comments = "<div class='comments'>" + "<p>I liked this article a lot, and I will say so at length in this comment.</p>" * 8 + "</div>"
    assert extraction.main_text(f"<body>{ARTICLE}{comments}</body>") == want


def test_a_very_long_page():
    import time

    page = "<body>" + "".join(f"<p>Block {k} of the page has some words, {'as a long story would. ' * (k % 5)}</p><div class='{'ad' if k % 3 else 'body'}'>x {k}</div>" for k in range(10_000)) + "</body>"
    found = extraction.blocks(page)
    began = time.time()
    edges = [(k, k + 1, 0.6) for k in range(len(found) - 1)] + [(k, k + 2, 0.8) for k in range(len(found) - 2)]
    extraction.minimum_cut([b.content for b in found], [b.boiler for b in found], edges)
    assert len(found) == 20_000 and time.time() - began < 2
    assert extraction.main_text(page).startswith("Block 0 of the page")


def test_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(1, "u", f"<body>{ARTICLE}</body>", 7, "own", 3)], "page_id long, url string, html string, n_chars int, text string, block int")
    (r,) = extraction.extract(rows).collect()
    assert r.text.startswith("A headline") and r.n_chars == len(r.text)


def test_query(spark, sf_dir):
    rows = extraction.op3_minimum_cut(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) > 0 for r in rows)
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", PAGE, "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extraction.extract(pages).collect())[:2] == [0, 0]
    assert extraction.extract(pages.where("false")).count() == 0


PROSE = "This is a sentence of an article that has enough words in it to be taken for prose by everybody. "


def test_quotes_and_comments_as_browsers_read_them():
    page = f"<body><p data-x=it's>{PROSE}</p><p>{PROSE}Second.</p><p title='a > b'>{PROSE}Third.</p><!-- a --!><p>{PROSE}Fourth.</p><!--><p>{PROSE}Fifth.</p></body>"
    found = extraction.main_text(page)
    assert found.count("This is a sentence") == 5 and "Second" in found and "Fifth" in found


def test_a_name_on_every_block_says_nothing():
    inner = "".join(f'<div class="elementor-widget elementor-element"><p>{PROSE * 3}Part {k}.</p></div>' for k in range(6))
    page = f'<body><div class="page-widget-area"><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></div><h1>A heading of it</h1>{inner}</body>'
    found = extraction.main_text(page)
    assert all(f"Part {k}." in found for k in range(6)) and "About" not in found


def test_malformed_pages_take_linear_time():
    import time

    for page in ('<p class="x>some text here ' * 20_000, "<a href='" * 20_000, "<p data-x=it's>words and words " * 20_000, "<a " * 60_000, "<!-- " * 40_000, "<b =" * 40_000 + " " * 100_000):
        began = time.time()
        extraction.main_text(page)
        assert time.time() - began < 5
