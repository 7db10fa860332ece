import random

import pytest
from helpers import PAGE_SCHEMA, prose

from recentlake.llm import html_text as h

TREE = h.trained_tree()
A, B, C = prose(25, 1), prose(31, 2), prose(27, 3)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words only", "plain words only"[:0]),
    ("<article><h1>T</h1><p>a  b\n c<p>d &amp; e&nbsp;f<br>g</article>", "T\na b c\nd & e f g"),
    ("<nav><ul><li><a href=/>Home</a></ul></nav><article><p>x</article><footer>&copy; y", "x"),
    ("<main><p>one<aside>no</aside><p>two<div class='ad'>buy</div><form><p>q</form><ul><li>l1<li>l2</ul></main>", "one\ntwo\nl1\nl2"),
    ("<article><p>k<div id=comments><p>reader</div><section class='related-posts'><p>r</section><p>z</article>", "k\nz"),
    ("<article><p>a<script>var x='</p><p>no';</script>b<style>p{}</style><!-- <p>c</p> -->d</article>", "abd"),
    ("<article><p>half <b>open <i>tags</p><p>next</article></div></p>", "half open tags\nnext"),
    ("<article class='post has-sidebar'><p>kept</p><p hidden>gone</p><p style='display: none'>gone</p></article>", "kept"),
    ("<div class='page sidebar-left'><main><p>in</p><div class=sidebar><p>out</p></div></main><p>after</p></div>", "in"),
    ("<article><p>1 &lt; 2 &#65;&#x42;</p><p>a<b", "1 < 2 AB\na"),
    (f"<div class='cookie-notice'><p>{A}</p></div><div id=main><p>{B}</p><p>ok</p><p>{C}</p></div><div class=sidebar><p>{A}</p></div>", f"{B}\nok\n{C}"),
    (f"<header><p>{A}</p></header><div><a href=1>a b</a> <a href=2>c d</a></div><p>{B}</p><p>{C}</p><div><a href=3>more links here</a></div>", f"{B}\n{C}"),
])
def test_pages(page, text):
    assert h.main_text(page, TREE) == text


def test_tree_respects_the_place_of_a_block():
    rng = random.Random(1)
    for _ in range(3000):
        size, share = (lambda: rng.choice([0, 1, 2, 5, 12, 40, 150])), (lambda: rng.choice([0, 0, 0.1, 0.5, 1]))
        never, content = rng.random() < 0.4, rng.random() < 0.5
        has = content or rng.random() < 0.5
        row = (int(never), int(content), int(has), max(1, size()), share(), size(), share(), size(), share(), rng.randrange(2), rng.randrange(2))
        if never or content or has:
            assert h.classify(TREE, row) == int(content and not never)
    for row in h.LABELLED:
        assert h.classify(TREE, row[:-1]) == row[-1]


def test_long_and_broken_pages_take_linear_time():
    import time

    for page in ("<div>" * 20_000 + "x", "<a \"" * 20_000, "<" * 50_000, "<p>word " * 30_000, "<!--" * 20_000, "<b x='" * 20_000, "</p>" * 50_000, "&" * 50_000):
        start = time.time()
        h.main_text(page, TREE)
        assert time.time() - start < 5, page[:10]


@pytest.mark.parametrize("open_,close", [("<nav>", "</nav>"), ("<div class=sidebar>", "</div>" * 301), ("<form>", "</form>"), ("<section id=comments>", "</section>")])
def test_a_closing_tag_finds_its_element_at_any_depth(open_, close):
    for inside in ("<li><div>item" * 150, "<section2>item" * 250, "<div>item" * 300):
        assert h.main_text(f"{open_}{inside}{close}<article><p>{A}</p></article>", TREE) == A
    deep = "<span class=ad>" + "<i2>" * 20 + "<span>x</span> buy " + "</i2>" * 20 + "</span>"
    assert h.main_text(f"<article><p>{A}</p>{deep}<p>{B}</p></article>", TREE) == f"{A}\n{B}"


@pytest.mark.parametrize("tag", ["audio", "video", "canvas", "noscript", "svg", "template", "object", "math"])
def test_an_unclosed_element_loses_no_text(tag):
    assert h.main_text(f"<article><p>a</p><{tag} class=x><p>b</p></article><footer>c", TREE) == "a\nb"


def test_held_elements_and_the_text_of_math_and_object():
    page = ("<article><p>a <audio src=1> b <audio src=2>no</audio> c<svg><svg></svg> d</p>"
            "<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>no</annotation></semantics></math> holds</p>"
            "<object data=1><p>kept</p></object><canvas>no</canvas><noscript>no</noscript><video controls>no</video></article>")
    assert h.main_text(page, TREE) == "a b c d\nso x=2 holds\nkept"
    assert h.main_text("<article><p>a<script>no</article>", TREE) == "a"


def test_many_unclosed_elements_take_linear_time():
    import time

    for tag in sorted(h.HELD | h.RAW):
        for page in (f"<{tag}>" * 30_000, f"<{tag}'x>'>" * 20_000):
            start = time.time()
            h.main_text(page, TREE)
            assert time.time() - start < 5, page[:12]


def test_many_closing_tags_on_a_deep_page_take_linear_time():
    import time

    start = time.time()
    assert h.main_text("<nav>" + "<div><x1>" * 30_000 + "</x2>" * 30_000 + "</x1>" * 30_000 + f"</nav><article>{A}", TREE) == A
    assert time.time() - start < 5


@pytest.mark.parametrize("page,text", [
    ('<article><p title="a"b">one</p><p>two</p><p class="x">three</p></article>', "one\ntwo\nthree"),
    ("<article><p><a href=it's>one</a></p><p>two</p><p>it's three</p></article>", "one\ntwo\nit's three"),
    ("<article><p data-x=a\"b>one</p><p>two \"quoted\"</p></article>", 'one\ntwo "quoted"'),
    ('<article><p title = "a > b" class=\'c > d\'>one</p><p>two</p></article>', "one\ntwo"),
    ('<article><p alt="never closed>one</p><p>two</article>', "one\ntwo"),
    ("<article><img alt='it\"s' src=x><p>one</p></article>", "one"),
])
def test_quotes_count_after_an_equals_sign(page, text):
    assert h.main_text(page, TREE) == text


@pytest.mark.parametrize("mark", ['section class="related-work"', 'section id="social-policy"', 'div class="article-share-price"',
                                  'div class="search-algorithm"', 'p class="comment-on-method"', 'div id="notice-of-motion"'])
def test_names_that_hold_such_a_word_by_chance(mark):
    tag = mark.split()[0]
    assert h.main_text(f"<article><p>{A}</p><{mark}>{B}</{tag}><p>{C}</p></article>", TREE) == f"{A}\n{B}\n{C}"


@pytest.mark.parametrize("mark", ['section class="related-posts"', 'div id="comments-section"', 'div class="ad-slot-top"', 'div class="shareButtons"',
                                  'div class="widget-area"', 'div role="search"', 'aside', 'div class="sidebar-content"', 'div class="post cookie-notice"'])
def test_names_of_other_elements(mark):
    assert h.main_text(f"<article><p>{A}</p><{mark}>{B}</{mark.split()[0]}><p>{C}</p></article>", TREE) == f"{A}\n{C}"


def test_a_layout_class_around_the_page_is_no_sidebar():
    assert h.main_text(f'<div id="content-sidebar-right"><article><p>{A}</p></article><div class="sidebar">{B}</div></div>', TREE) == A


def test_tree_weighs_the_link_density_of_neighbours():
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(h.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(TREE)
    assert used & {"link_density_before", "link_density_after"}
    links = lambda n: "<div>" + " ".join(f"<a href={k}>link{k} to</a>" for k in range(n)) + "</div>"
    caption = "<p>five words of plain caption</p>"
    assert h.main_text(f"{links(20)}{caption}{links(20)}", TREE) == ""
    assert h.main_text(f"<p>{A}</p>{caption}<p>{B}</p>", TREE) == f"{A}\nfive words of plain caption\n{B}"


def test_on_spark(spark):
    rows = [(1, "u", "<article><p>é日本</article>"), (1, "u", "<article><p>é日本</article>"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], PAGE_SCHEMA + ", text string")
    got = sorted((tuple(r) for r in h.extracted(pages).collect()), key=str)
    assert got == sorted([(1, "u", "é日本", 3), (1, "u", "é日本", 3), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert h.extracted(pages.limit(0)).count() == 0
