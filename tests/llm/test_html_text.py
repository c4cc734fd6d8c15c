import re

import pyarrow.parquet as pq

from matchday.llm import html_text as ht

SF = "/root/testdata/sf0.01"


def text(page):
    return ht.main_text(ht.blocks(page), [])


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a>b">menu</a></li></ul></nav><!-- x <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>One   two</b>&nbsp;three<br>four.<p>Five &lt;six&gt;
    <aside>side</aside><p>seven<form><input><label>mail</label></form>
    <section class="comments"><article class="comment"><p>first!</p></article></section></article>
    <aside>more</aside><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Head & line\n\nOne two three four.\n\nFive <six>\n\nseven"


def test_odd_markup():
    assert text(None) == "" and text("") == "" and text("<article></article>") == ""
    assert text("plain &amp words") == "plain & words"
    assert text("<article><p>cut off in <b>the mid") == "cut off in the mid"
    assert text("<article><p>a < b and c > d</p>") == "a < b and c > d"
    assert text('<main><div id="x">one</div><span>two</span> three</main><p>out</p>') == "one\n\ntwo three"
    assert text("<div class='post-content'><li>a<li>b<table><tr><td>c<td>d</table></div>") == "a\n\nb\n\nc d"
    assert text("<p>x</p><p class='share'>tweet</p><p>y</p>") == "x\n\ny"
    assert text("<article><p title=\"unclosed>a</p><p>b</p></article>") in ("a\n\nb", "b", "")
    assert len(text("<article>" + "<div>" * 3000 + "deep" + "x " * 50_000)) > 90_000


def test_pages_of_the_table(spark):
    got = {r.page_id: r for r in ht.op2_html_text(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    import html
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        assert got[r["page_id"]].text == "\n\n".join(w for w in want if w)
        assert got[r["page_id"]].n_chars == len(got[r["page_id"]].text) and got[r["page_id"]].url == r["url"]


def test_repeated_strings_of_a_host_go(spark):
    note = "Welcome to our lovely site, have a look around"
    own = ["The story of the first page is short.", "Another page tells of something else.", "A third one ends it all here."]
    pages = [(i, f"http://a.example/{i}", f"<p>{note}</p><p>{t}</p><p>Call us now or write to our office</p>") for i, t in enumerate(own)]
    pages += [(10, "http://b.example/1", f"<p>{note}</p><p>only here</p>"), (11, None, f"<p>{note}</p>"), (12, "x", None),
              (13, "http://c.example/1", "<p>A mirrored page with its whole text.</p>"),
              (14, "http://c.example/2", "<p>A mirrored page with its whole text.</p>"),
              (None, "http://a.example/9", f"<p>{note}</p><p>no id</p>"),
              (15, "http://d.example/1", "<p>twice on one page, twice on one page</p><p>twice on one page, twice on one page</p>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, raw string, _did int")
    for bucket in (1 << 20, 30):
        got = {r.page_id: r.text for r in ht.extract(df, bucket_bytes=bucket).collect()}
        assert [got[i] for i in range(3)] == own and got[None] == "no id"
        assert got[10] == f"{note}\n\nonly here" and got[11] == note and got[12] == ""
        assert got[13] == got[14] == "A mirrored page with its whole text."
        assert got[15].count("twice") == 4
    assert ht.extract(df.limit(0)).count() == 0


def test_strings_on_many_pages_leave_the_main_zone(spark):
    """An unclassed notice inside the article goes; text shared by few pages, and copies of whole articles, stay."""
    note, advert = "Join our readers' circle and never miss a story", "Fresh coffee beans, sent to your door each week"
    shared = "A paragraph that two of the pages have in common."
    own = [f"Story {i} has words that no other page has, number {i * i}." for i in range(20)]
    pages = []
    for i, t in enumerate(own):
        both = [f"<p>{note}</p>", f"<p>{advert}</p>"] if i % 2 else [f"<p>{note} {advert}</p>"]
        pages.append((i, f"http://a.example/{i}", f"<article><p>{t}</p>{''.join(both)}"
                      + f"<p>{shared}</p>" * (i < 2) + "</article>"))
    pages += [(100 + i, f"http://b.example/{i}", f"<main><p>{note}</p><p>{own[i]}</p></main>") for i in range(3)]
    pages += [(200 + i, f"http://c.example/{i}", "<article><p>One article that is mirrored, whole.</p></article>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for bucket in (1 << 20, 30):
        got = {r.page_id: r.text for r in ht.extract(df, bucket_bytes=bucket).collect()}
        for i, t in enumerate(own):
            assert got[i] == (f"{t}\n\n{shared}" if i < 2 else t)
        assert all(got[100 + i] == f"{note}\n\n{own[i]}" for i in range(3))
        assert all(got[200 + i] == "One article that is mirrored, whole." for i in range(12))


def test_layout_names_around_an_article():
    for page in ("<div class='has-sidebar'><article><p>one</p></article></div>", "<div id='page-with-menu'><p>one</p></div>",
                 "<article class='post category-social'><p>one</p></article>", "<div class='search-result-page'><p>one</p></div>",
                 "<article><section class='related-work'><p>one</p></section></article>",
                 "<div class='right-sidebar'><p>x</p><article><p>one</p><div class='ad-slot'>buy</div></article></div>",
                 "<div class='sidebar'><main class='search'><p>one</p></main></div>", "<article class='social'>one</article>",
                 "<div class='widget'><article><p>one</p><section class='comments'><article>no</article></section></article></div>",
                 "<div class='content'><article><p>one</p></article></div><div class='related'><article>card</article></div>"):
        assert text(page) == "one", page
    for name in ("ad", "ad-slot", "cookie-notice", "sidebar__inner", "share-buttons", "comment-list", "newsletter_signup"):
        assert text(f"<article><p>one</p><div class='{name}'>two</div></article>") == "one", name
    assert text("<article><div class='share'>tweet</div></article>") == ""
    assert text("<section class='comments'><article class='comment'><p>first!</p></article></section>") == ""


def test_text_beside_a_container(spark):
    """What a `main` has beside its article, and what lies beside an element that is only named as content, is open."""
    assert text("<main><h1>Head</h1><article><p>one</p></article></main><p>out</p>") == "Head\n\none"
    assert text("<div class='story'><p>lead</p></div><p>rest</p><nav>menu</nav>") == "lead\n\nrest"
    assert text("<div class='content'><article><p>one</p></article><p>x</p></div>") == "one"
    line = "Read more of our stories on the following pages"
    own = ["A first story about a river.", "The second one is of mountains.", "Now something on the sea."]
    pages = [(i, f"http://m.example/{i}", f"<main><h1>Head {t}</h1><article><p>{t}</p></article><p>{line}</p></main>") for i, t in enumerate(own)]
    pages += [(10 + i, f"http://n.example/{i}", f"<div class='story'><p>{t}</p></div><p>{line}</p><p>rest {i}</p>") for i, t in enumerate(own)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract(df).collect()}
    for i, t in enumerate(own):
        assert got[i] == f"Head {t}\n\n{t}" and got[10 + i] == f"{t}\n\nrest {i}"
