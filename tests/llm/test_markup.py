"""Tags of malformed pages, main texts of hand-made pages, and positions and captions on them."""

import time

import pytest
from halyard.llm import html_extract, markup, media

LONG = "The river rose again in the spring of that year, and the people of the lower town moved their boats to the square."
MORE = "Nobody had expected the bridge to hold, yet it did; the old stones stood while the new wooden pier was carried off."


@pytest.mark.parametrize("junk", ["<a title='x>", "<a b=\"'>", "<a ' \" b", "<title>", "<a =", "<", "</", "<!--", '<a x=">', "<svg>", "</a b='", "<p '\">"])
def test_a_megabyte_of_junk_is_read_in_linear_time(junk):
    page = f"<article><p>{LONG}</p></article>" + junk * (1_000_000 // len(junk))
    began = time.process_time()
    for _ in markup.tags(page):
        pass
    assert time.process_time() - began < 5
    assert LONG in html_extract.extract_page(page, None)


def test_quotes_open_a_value_behind_an_equals_sign_only():
    got = [(n, c, markup.attributes(a)) for _, _, n, c, a in markup.tags("<a title='it's fine' href=x>here</a><B/ A=1 a=2 c=\"&amp;\">")]
    assert got == [("a", False, {"title": "it", "s": "", "fine'": "", "href": "x"}), ("a", True, {}), ("b", False, {"a": "1", "c": "&"})]


def page(body, head="<title>Site</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    # (html, text)
    (f"<article><p>It is <a title='it's fine' href=x>here</a>.</p><p>{LONG}</p></article>", f"It is here.\n{LONG}"),
    (f"<p>1 < 2 and {LONG}</p>", f"1 < 2 and {LONG}"),
    (page(f'<nav><a href="/">Home</a></nav><div class="post related-work"><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p></div><footer>Imprint</footer>'), f"Floods\n{LONG}\n{MORE}"),
    (page(f'<div class="content"><p class="share-price">At 31 the share stood high.</p><p>{LONG}</p><p class="ad">Buy now and save a lot of money today.</p></div>'), f"At 31 the share stood high.\n{LONG}"),
    (page(f'<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><main><h1>A</h1><p>{LONG}</p></main><div id="comments"><p>First! {MORE}</p></div>'), f"A\n{LONG}"),
    (page(f'<main><p>{LONG}</p><div class="comment-list"><p>I was there too. {MORE}</p></div></main><aside><p>{MORE}</p></aside>'), LONG),
    (page(f'<div class="sidebar"><ul><li><a href="/a">Other</a></li></ul></div><div class="story"><header><h1>Head</h1></header><p>{LONG}</p><form><p>Subscribe</p></form></div>'), f"Head\n{LONG}"),
    (page(f"<main><title>oops<p>{LONG}</p></main>"), f"oops\n{LONG}"),
    (f"<main><p>{LONG}</p><p>cut <a href='", f"{LONG}\ncut"),
    (f"<main><p>{LONG}</p><!-- no end <p>{MORE}</p>", LONG),
    ("", ""),
    (None, ""),
]


def test_hand_made_pages(spark):
    rows = [(i, f"https://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)]
    got = {r.page_id: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (html, want) in enumerate(PAGES):
        assert got[i].text == want, html
        assert got[i].n_chars == len(want)


def test_a_host_decides_over_names(spark):
    """On this host the articles stand in containers named widgets; elsewhere what is named so is left out."""
    rows = [(i, "https://w.example/x", page(f'<div class="widget"><p>{LONG} {i}</p><p>{MORE}</p><div class="ad"><p>Buy {i}</p></div></div><div class="top"><p>Hi</p></div>')) for i in range(4)]
    rows += [(10 + i, "https://v.example/x", page(f'<div class="text"><p>{LONG} {i}</p></div><div class="widget"><p>{MORE}</p></div>')) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].split("\n")[:2] for i in range(4)] == [[f"{LONG} {i}", MORE] for i in range(4)] and not any("Buy" in got[i] for i in range(4))
    assert [got[10 + i] for i in range(4)] == [f"{LONG} {i}" for i in range(4)]


def test_positions_and_captions_on_pages():
    ref = media.REFERENCE
    html = (
        f"<h1>T</h1><p>One <b>two</b></p><figure><img src='{ref}aa' alt='alt a'><figcaption><p>Cap &amp; more</p></figcaption></figure><p>Three"
        f"<img alt='it's' src={ref}bb><p>Four</p><img src='http://x/y.png'><figure><img src=\"{ref}cc\"><img src=\"{ref}dd\" alt=\"d\"><figcaption>Both</figcaption></figure><script>no</script>end"
    )
    got = [(x["pos"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse_sequence(html)]
    assert got == [
        (0, "text", "T", None, None),
        (1, "text", "One two", None, None),
        (2, "media", None, "aa", "Cap & more"),
        (3, "text", "Three", None, None),
        (4, "media", None, "bb", "it"),
        (5, "text", "Four", None, None),
        (6, "media", None, "cc", "Both"),
        (7, "media", None, "dd", "Both"),
        (8, "text", "end", None, None),
    ]
    assert [x["text"] for x in media.parse_sequence("<figure><figcaption>no end</figure>after")] == ["no end", "after"]


def test_sequences_of_the_pages_table(spark, small):
    """On real pages every reference is resolved in its place, and the text is the page's."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.sequence for r in media.interleaved_sequences(pages, "page_id", "html").collect()}
    assert len(got) == pages.count() and all([x.pos for x in s] == list(range(len(s))) for s in got.values())
    for r in pages.limit(40).collect():
        words = "".join(x.text for x in got[r.page_id] if x.kind == "text")
        assert "<" not in words and len(words) > 0


def test_deep_nesting_takes_linear_time_and_memory():
    """A megabyte of containers that are never closed, and closing tags that close nothing."""
    import time
    import tracemalloc

    from halyard.llm import html_extract

    n = 45_000
    deep = '<div class="a"><p>t</p>' * n
    began = time.perf_counter()
    tracemalloc.start()
    votes = html_extract.page_votes(deep)
    assert html_extract.extract_page(deep, votes[0][0]).count("t") == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and time.perf_counter() - began < 60  # some 3 s without tracing
    stray = "<div>" * 20_000 + "</table>" * 20_000 + "<p>x</p>" * 20_000
    began = time.perf_counter()
    assert html_extract.extract_page(stray, None).count("x") == 20_000
    assert time.perf_counter() - began < 20
