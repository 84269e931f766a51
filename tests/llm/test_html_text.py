import html
import random
import re
import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from softgrove.llm.html_text import extract, main_text  # noqa: E402

SF = "/root/testdata/sf0.01"
LONG = "word " * 40


def article(page):
    """Text of the pages' template, by hand."""
    body = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = re.sub(r"<br>|</?(?:p|h1)>", "\0", body)
    blocks = re.sub(r"</?b>", "", blocks).split("\0")
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_gives_the_articles_whole(spark):
    from softgrove.llm.queries import op3_html_text
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op3_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_that_are_not_the_article():
    parts = ["<nav>Home</nav>", "<header>Top</header>", "<footer>End</footer>", "<aside>Side</aside>", "<form>Name <input> Send</form>",
             '<div class="ad-box">Buy</div>', '<div id="cookieNotice">Cookies</div>', '<section class="post-comments"><p>Troll ' + LONG + "</p></section>",
             "<script>var a = '<p>x</p>';</script>", "<style>p{}</style>", "<!-- <p>gone</p> -->", '<ul role=navigation><li><a href="/">Menu</a></li></ul>',
             '<div hidden>Secret</div>', "<noscript>Enable</noscript>"]
    rng = random.Random(1)
    for _ in range(30):
        rng.shuffle(parts)
        while parts[7].startswith("<header"):  # an article's own header is part of it
            rng.shuffle(parts)
        page = "".join(parts[:7]) + f"<article><h1>Title</h1><p>{LONG}</p>{parts[7]}<p>Of.</p></article>" + "".join(parts[8:])
        assert main_text(page) == f"Title\n{LONG.strip()}\nOf."


def test_pages_without_an_article_mark():
    page = ('<body><ul><li><a href="/a">One link of the menu</a></li><li><a href="/b">Another link there</a></li></ul><div class="menu">x</div>'
            f'<p>{LONG}</p><p>Short.</p><p>{LONG}</p><div class="share">Share</div><p>Copyright us</p></body>')
    assert main_text(page) == f"{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_short_lines_next_to_long_ones_without_an_article_mark():
    long = LONG.strip()
    nested = f"<div><h1>Title here</h1><div><p>{LONG}</p></div><div><p>Short closing line.</p></div></div>"
    ad = '<div class="ad">Buy this</div>'
    menu = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul>'
    cases = {
        nested: f"Title here\n{long}\nShort closing line.", f"<body>{menu}{nested}{menu}</body>": f"Title here\n{long}\nShort closing line.",
        f"<body><p>{LONG}</p>{ad}<h2>Part</h2><p>{LONG}</p>{ad}<p>The end.</p></body>": f"{long}\nPart\n{long}\nThe end.",
        f'<body><h1>Title</h1><div class="share">Share</div><p>{LONG}</p><nav>Next</nav><p>Copyright us</p></body>': f"Title\n{long}",
        f'<div><p>{LONG}</p><aside>Box</aside><p>Of.</p></div>': f"{long}\nOf.", f'<p>{LONG}</p><nav>x</nav><p>Mid.</p><nav>y</nav><p>{LONG}</p>': f"{long}\nMid.\n{long}",
        f"<div><div><p>Intro.</p></div>{menu}<div><div><p>{LONG}</p></div></div><div><div>Tail one.</div><div>Tail two.</div></div></div>":
            f"{long}\nTail one.\nTail two.",
        f'<div><p>{LONG}</p><p><a href="/x">A line of links</a></p><p>Of.</p></div>': f"{long}\nA line of links\nOf.",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_article_marks_bound_the_text_but_do_not_choose_it():
    long = LONG.strip()
    teasers = "".join(f'<article><h3><a href="/{k}">Teaser {k}</a></h3><p>Read it.</p></article>' for k in range(4))
    other = "Other words than these stand in the box beside the article, and they are long enough to surge. " * 2
    cases = {
        # the marks are those of teasers
        f"<body><div><h1>Title</h1><p>{LONG}</p><p>Of.</p></div><div>{teasers}</div></body>": f"Title\n{long}\nOf.",
        f"<body><div>{teasers}</div><div><h1>Title</h1><p>{LONG}</p><p>Of.</p></div></body>": f"Title\n{long}\nOf.",
        # the article is larger, or as large
        f"<body><div><p>{other}</p></div><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Of.</p></article><p>Out.</p></body>":
            f"Title\n{long}\n{long}\nOf.",
        f"<body><p>{LONG}</p><article><p>{LONG}</p><p>Of.</p></article></body>": f"{long}\nOf.",
        # short marked parts next to the text, and a far one
        f"<main><article>{LONG}</article><article>Thanks!</article></main>": f"{long}\nThanks!",
        f"<body><article>{LONG}</article><p>Reply</p><article>Thanks!</article></body>": f"{long}\nThanks!",
        f"<body><article>{LONG}{LONG}</article><nav>More</nav><article>Read this too</article></body>": f"{long} {long}",
        # links inside are text
        f'<article><p>{LONG}</p>{"".join(f"<p><a href=/{k}>Source {k}</a></p>" for k in range(5))}</article>':
            "\n".join([long, *(f"Source {k}" for k in range(5))]),
        "<article><p>Few words.</p></article><p>No</p>": "Few words.",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_names_alone_do_not_drop_the_text():
    long = LONG.strip()
    body = f"<h1>Title</h1><p>{LONG}</p><p>Of.</p>"
    want = f"Title\n{long}\nOf."
    for name in ("content has-sidebar", "post no-comments", "page with-header", "page widget", "notice", "popup"):
        for tag in ("main", "article", "div", "section"):
            for key in ("class", "id", "role"):
                page = f'<body><nav>Home</nav><{tag} {key}="{name}">{body}</{tag}><footer>End</footer></body>'
                assert main_text(page) == want, page
    for name in ("related-work", "search-methods", "notice-period", "has-comments", "post-header", "entryHeader"):
        for tag in ("section", "div"):
            for outer in ("article", "div"):
                page = f'<{outer}>{body}<{tag} id="{name}"><h2 id="related">Part</h2><p>Own words.</p></{tag}><p>{LONG}</p></{outer}>'
                assert main_text(page) == f"{want}\nPart\nOwn words.\n{long}", page
    for name in ("ad", "ad-box", "google_ads_iframe", "cookieNotice", "post-comments", "comment-list", "related-posts", "sidebar-left", "share-buttons",
                 "site-header", "main-menu", "menu-item-12", "x widget", "newsletter-signup", "breadcrumb"):
        for tag in ("section", "div", "p", "span"):
            for outer in ("article", "div"):
                page = f'<{outer}>{body}<{tag} class="{name}">Not of it, however <b>long</b> it is.</{tag}></{outer}>'
                assert main_text(page) == want, page
    assert main_text(f'<article>{body}<p>One <span class="share-link">Share</span> line.</p></article>') == f"{want}\nOne line."
    replies = f'<article class="comment"><p>{LONG}</p></article>' * 3
    assert main_text(f'<main>{body}</main><section class="comments">{replies}</section>') == want
    assert main_text(f'<div>{body}</div><section class="comments">{replies}</section>') == want
    # an advert, and comments, may be longer than the text
    for name in ("ad", "comments"):
        for outer in ("article", "div"):
            page = f'<body><{outer}>{body}</{outer}><div class="{name}"><p>{LONG}</p><div class="box"><p>{LONG}</p></div></div></body>'
            assert main_text(page) == want, page
    assert main_text(f'<div class="comments"><p>{LONG}</p></div>') == long


BOXES = ("sidebar", "cookie-banner", "footer", "newsletter", "related", "comments", "disclaimer", "consent")


def test_a_marked_article_wins_over_named_boxes():
    """Short and long articles beside and around short and long boxes."""
    texts = {"Of few words.": "Of few words.", f"{LONG}{LONG}": (LONG + LONG).strip()}
    for own, want in texts.items():
        for name in BOXES:
            for words in ("Short box.", "Words of a box that are not the article's. " * 20):
                for inner in (f"<p>{words}</p>", f"<h2>Box</h2><p>{words}</p><p>{words}</p>"):
                    box = f'<div class="{name}">{inner}</div>'
                    for tag in ("article", "main"):
                        for page in (f"<body><{tag}><h1>Title</h1><p>{own}</p></{tag}>{box}</body>", f"<body>{box}<{tag}><h1>Title</h1><p>{own}</p></{tag}></body>",
                                     f"<body><{tag}><h1>Title</h1><p>{own}</p>{box}</{tag}></body>"):
                            assert main_text(page) == f"Title\n{want}", page


def test_named_boxes_on_pages_without_the_mark():
    for name in BOXES:
        box = f'<div class="{name}"><p>{"Words of a box that are not the text. " * 20}</p></div>'
        for own in ("Of few words.", LONG.strip()):
            assert main_text(f"<body><div><h1>Title</h1><p>{own}</p></div>{box}</body>") == f"Title\n{own}"
        assert main_text(f"<body>{box}</body>") == ("Words of a box that are not the text. " * 20).strip()


def test_links_between_lines_of_one_container_are_no_dive():
    long = LONG.strip()
    links = "".join(f'<p><a href="/{k}">Source {k}</a></p>' for k in range(5))
    listed = "<ul>" + "".join(f'<li><a href="/{k}">Source {k}</a></li>' for k in range(5)) + "</ul>"
    sources = "\n".join(f"Source {k}" for k in range(5))
    for middle in (links, listed):
        for tag in ("div", "section", "article", "main"):
            assert main_text(f"<body><{tag}><p>{LONG}</p>{middle}<p>Closing words.</p></{tag}></body>") == f"{long}\n{sources}\nClosing words."
        # in containers of their own, or in none, they part the text
        assert main_text(f"<body><div><p>{LONG}</p></div>{middle}<div><p>Copyright us</p></div></body>") == long
        assert main_text(f"<body><p>{LONG}</p>{middle}<p>Copyright us</p></body>") == long


def test_sums_choose_where_nothing_is_named():
    """Without marks and names only surges and dives tell text from the rest."""
    rng = random.Random(5)
    for _ in range(60):
        paragraphs = [sentence(rng, rng.randint(15, 60)) for _ in range(rng.randint(1, 6))]
        menu = lambda: "<div>" + "".join(f'<div><a href="/{k}">{sentence(rng, 2)}</a></div>' for k in range(rng.randint(4, 9))) + "</div>"
        page = f"<body>{menu()}<div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>{menu()}<div><div>{sentence(rng, 3)}</div></div></body>"
        assert main_text(page) == "\n".join(paragraphs), page
        # with a threshold of one character the short line at the end surges too
        assert main_text(page, surge=1) != main_text(page)


def test_markup_and_references():
    cases = {
        None: "", "": "", "   ": "", "plain  text": "plain text", "<p>a<p>b<p>c": "a\nb\nc", "x &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;y": "x <b> &amp; éé y",
        "<p>in<b>l</b>ine <i>and</i>\n\t more</p>": "inline and more", "a<br>b<br/>c": "a\nb\nc", "3 < 4 & 5 > 2": "3 < 4 & 5 > 2",
        "<p title='a>b'>q</p>": "q", "<p title='it>q</p>": "q", "<script>x": "", "<!-- open": "", "<nav>x<article>y</article>": "y",
        "<div class=ad>x<article><p>y</p></article></div><p>z</p>": "y", "<table><tr><td>a</td><td>b</td></tr></table>": "a\nb",
        "<article><header><h1>T</h1></header><p>x</p></article>": "T\nx", "&am &amp &copy 2": "&am & © 2", "\U0001f600<p>漢字</p>": "\U0001f600\n漢字",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_long_pages_stay_linear():
    import time
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<p>a" * 50_000, "<" * 200_000, "<!--" * 50_000, "<a href='" * 50_000, "</p>" * 50_000, "&amp;" * 100_000,
                 "<a href='" * 50_000 + ">", "<div>" * 50_000 + "</span>" * 50_000, "<b>" * 50_000 + "<p>a" * 50_000, "<script " * 50_000 + ">"):
        main_text(page)
    assert time.time() - began < 60


def test_table_with_clashing_names_repeats_and_nulls(spark):
    rng = random.Random(2)
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None), (2, "v", ""), (3, "w", f"<article>{sentence(rng, 30_000)}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("n_chars", F.lit(0))
    got = extract(df, keep=["page_id", "url"])
    assert sorted(((r.page_id, r.text[:5], r.n_chars) for r in got.collect()), key=str) == sorted(
        [(1, "x", 1), (1, "x", 1), (None, "", 0), (2, "", 0), (3, rows[4][2][9:14], len(rows[4][2]) - 19)], key=str)
    named = extract(df, name="body", length_name="size")
    assert named.columns == ["page_id", "url", "text", "n_chars", "body", "size"]
    assert extract(df.limit(0), keep=["page_id"]).collect() == []
