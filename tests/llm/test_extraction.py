import html
import re
import time

import pytest
from conftest import SMALL

from wardmap.llm.extraction import best_region, extracted, learned, main_text
from wardmap.llm.tables import table


def marked(page):
    """The marked article of a generated page, read plainly."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    inner = re.sub(r"<[^<>]*\Z", "", found[1])
    parts = (re.sub("<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
    return "\n".join(p for p in (" ".join(html.unescape(p).split()) for p in parts) if p)


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_whole_articles_of_the_pages(spark, folder):
    pages = {r.page_id: r for r in table(spark, folder, "pages").collect()}
    for r in extracted(table(spark, folder, "pages")).collect():
        assert r.text == marked(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_articles_are_found_without_their_mark(spark):
    pages = table(spark, SMALL, "pages").collect()
    weights = learned(table(spark, SMALL, "pages"))
    right = sum(main_text(re.sub("</?article>", "", p.html), weights) == marked(p.html) for p in pages)
    assert right >= 0.95 * len(pages)


def test_articles_are_found_without_marks_and_classes(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages").collect()[::5]
    weights = learned(table(spark, SMALL, "pages"))
    bare = lambda page: re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub("</?article>", "", page))
    right = sum(main_text(bare(p.html), weights) == marked(p.html) for p in pages)
    assert right >= 0.95 * len(pages)


STORY = "".join(f"<p>Paragraph {i} tells a part of the story in plain words, one after another.</p>" for i in range(6))
STORY_TEXT = "\n".join(f"Paragraph {i} tells a part of the story in plain words, one after another." for i in range(6))


@pytest.mark.parametrize("page, want", [
    # A menu that is a plain list of links, and links after the text.
    ("<body><ul><li><a href=1>Home</a><li><a href=2>About us</a><li><a href=3>Contact</a></ul><h1>The title</h1>" + STORY
     + "<p><a href=4>Older posts</a></p><div><a href=5>Next</a> <a href=6>Previous</a></div></body>", "The title\n" + STORY_TEXT),
    ("<body><div><div><a href=1>Home</a> | <a href=2>News</a></div><div><h1>The title</h1>" + STORY + "</div></div></body>",
     "The title\n" + STORY_TEXT),
    # The head of an entry is no page header.
    ("<body><div class='site-header'>The site</div><div class='entry-header'><h1>The title</h1><p class=byline>By Ann Lee</p>"
     "</div><div class='entry-content'>" + STORY + "</div></body>", "The title\nBy Ann Lee\n" + STORY_TEXT),
    # Classes that only begin like those of other parts.
    ("<article><h1>The title</h1><section class='feedback-loops'><p>Loops feed back.</p></section>" + STORY
     + "<p class='alert-level'>The level is high.</p><div class='ad-box'>Buy it</div></article>",
     "The title\nLoops feed back.\n" + STORY_TEXT + "\nThe level is high."),
    # Teasers beside the main article.
    ("<main><article><h2><a href=1>Another story</a></h2><p>A short teaser.</p></article><article><h1>The title</h1>" + STORY
     + "</article><article><h2><a href=2>One more</a></h2><p>Read on.</p></article></main>", "The title\n" + STORY_TEXT),
    ("<main><article><h2>One</h2><p>Some words here.</p></article><article><h2>Two</h2><p>Some more words.</p></article></main>",
     "One\nSome words here.\nTwo\nSome more words.")])
def test_weights_decide(spark, page, want):
    weights = learned(table(spark, "/root/testdata/sf0.1", "pages"))
    for known in ({}, weights):
        assert main_text(page, known) == want


@pytest.mark.parametrize("start, end", [("<span>", ""), ("<div>", ""), ("<p><b>", ""), ("<div class=ad>", ""), ("<article>", ""),
                                        ("<span>", "<div>x</div></i>"), ("<main><ul><li>", "</table>")])
def test_deep_nesting_takes_linear_time(start, end):
    page = "<h1>Title</h1><p>" + "words of the text " * 50 + start * 100_000 + "deep" + end * 1000
    began = time.time()
    main_text(page, {})
    assert time.time() - began < 20


PARTS = {
    "<nav><ul><li><a href=x>Home page</a></ul></nav>": "",
    "<h1>The title</h1>": "The title", "<p>First <b>para</b>graph &amp; more\n  words&nbsp;here.": "First paragraph & more words here.",
    "<div class='ad-box'>Buy this now</div>": "", "<p>Second &lt;p&gt; &#233; part": "Second <p> é part",
    "<figure><img src=z alt=w><figcaption>A caption</figcaption></figure>": "A caption",
    "<script>if (a < b) { '<p>no</p>' }</script>": "", "<style>p > a {}</style>": "", "<!-- <p>hidden</p> -->": "",
    "<ul><li>item one<li>item two</ul>": "item one\nitem two", "<aside><p>Beside it</p></aside>": "",
    "<form><label>Your name</label><input value='x'><button>Send</button></form>": "",
    "<blockquote>Quoted <i>words</i></blockquote>": "Quoted words", "<p>line one<br>line two</p>": "line one\nline two",
    "<table><tr><td>cell a<td>cell b</table>": "cell a\ncell b", "<div id=cookie-notice>We use cookies</div>": "",
    "<section class='comments'><h3>Comments</h3><p>Nice article, dear author, thanks a lot for it</p></section>": "",
    "<footer>&copy; all</footer>": "", "<p hidden>Not shown</p>": "", "<div style='display: none'>Nor this</div>": "",
    "<article class='comment'><p>First!</p></article>": "", "<div role=navigation><a href=y>More</a></div>": "",
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>"])
def test_other_parts_are_left_out(spark, wrap):
    weights = learned(table(spark, SMALL, "pages"))
    page = f"<html><head><title>t</title></head><body><header><h2>Site name</h2></header><div class=top>Top line</div>{wrap.format(''.join(PARTS))}</body></html>"
    want = "\n".join(t for t in PARTS.values() if t)
    for known in ({}, weights):
        assert main_text(page, known) == want


WRAPPERS = [
    ("<body class='no-sidebar comments-open'>", "</body>"), ("<html class='has-cookie-notice'><body class='header-image'>", "</body></html>"),
    ("<body><div class='post social-share'>", "</div></body>"), ("<body class='content-sidebar'><div id=top class='page has-sidebar'><div class='overflow-hidden'>", "</div></div></body>"),
]


@pytest.mark.parametrize("start, end", WRAPPERS)
@pytest.mark.parametrize("inner", [
    "<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "<article class='post comments-open'>{}</article>"])
def test_class_words_of_wrappers_say_nothing(spark, start, end, inner):
    weights = learned(table(spark, SMALL, "pages"))
    content = "<h1>The title</h1>" + "".join(f"<p>Paragraph {i} has some words of the story.</p>" for i in range(8))
    want = "\n".join(["The title", *[f"Paragraph {i} has some words of the story." for i in range(8)]])
    beside = "<div class=sidebar><p>Popular <a href=x>links</a> of today</p></div><section class=comments><article><p>A comment</p></article></section>"
    page = f"{start}<nav>Menu</nav>{inner.format(content + '<div class=share>Share it</div>')}{beside}{end}"
    for known in ({}, weights):
        assert main_text(page, known) == want


def test_wrappers_of_labelled_pages_keep_their_meaning_elsewhere(spark):
    story = "<p>" + "many words of a story " * 20 + "</p>"
    labelled = f"<body><div class='page has-sidebar'><article>{story}</article><div class=box>Links</div></div></body>"
    weights = learned(spark.createDataFrame([(i, labelled) for i in range(200)], "page_id long, html string"))
    assert weights[".page"] == (200, 0) and ".sidebar" not in weights and weights[".box"] == (0, 200)
    plain = f"<body><div class=story>{story}</div><div class=sidebar>Some popular links</div></body>"
    assert main_text(plain, weights) == ("many words of a story " * 20).strip()
    # Words of the lists are corrected by pages with such elements in the marked content.
    noted = f"<body><article>{story}<p class=notice>Mind the step</p></article></body>"
    weights = learned(spark.createDataFrame([(i, noted) for i in range(200)], "page_id long, html string"))
    assert main_text(noted, weights).endswith("Mind the step") and "Mind" not in main_text(noted, {})
    # Long comments are no wrapper.
    plain = f"<body><div class=story><h1>T</h1>{story}</div><div class=comments>{story * 3}</div></body>"
    assert main_text(plain, {}) == "T\n" + ("many words of a story " * 20).strip()


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "plain words"), (4, "u", "<p>cut &am"), (5, "u", "<p>cut <a hr"),
            (6, "u", "<nav>menu</nav>"), (7, "u", "<p>" + "word " * 300_000), (8, "u", "a < b > c <3"), (None, "u", "<p>x</p>"),
            (9, "u", "<div class=\"open>text</div><p>more")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = {r.page_id: r.text for r in extracted(pages).collect()}
    assert (found[1], found[2], found[3], found[4], found[5], found[6], found[None]) == (
        "", "", "plain words", "cut &am", "cut", "", "x")
    assert len(found[7]) == 300_000 * 5 - 1 and found[8] == "a < b > c <3"
    assert extracted(pages).count() == len(rows)
    assert extracted(pages.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    import random

    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-5, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        start, stop = best_region(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])
        assert sum(scores[start:stop]) == pytest.approx(best)
