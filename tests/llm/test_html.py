from valograph.llm import html

SCHEMA = "page_id bigint, url string, html string"
BODY = "<h1>The head &amp; line</h1><p>First  paragraph\nwith <b>bold</b> and <a href='x'>a link</a> &eacute;&#233;&nbsp;x.<br>Same block.<p>Second one is longer, as articles are, and goes on for some time."
CASES = [
    f"<html><head><title>T</title><script>if (a < b) '<p>no</p>'</script><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad box'>Buy this very fine thing now, it is cheap and good.</div><article>{BODY}</article><footer>&copy; Us and them and all the others</footer></body></html>",
    f"<body><div id=sidebar>One two three four five six</div><div class=content>{BODY}</div><div class='comments'><p>Great article, I like it a lot and more words.</div><form>Sign up <input> for more of this</form>",
    f"<header>Site name and claim</header><main>{BODY}<aside>See also this and that</aside></main><div class='cookie-notice'>We use cookies as all do</div><!-- <p>no --><footer>The end of the page</footer>",
    f"<div hidden>nothing to see here at all</div><div style='display: none'>nor here in this one</div><section>{BODY}</section><p class=",
]
TEXT = "The head & line\nFirst paragraph with bold and a link éé x. Same block.\nSecond one is longer, as articles are, and goes on for some time."


def test_layouts_give_the_article():
    for case in CASES:
        assert html.Page(case).main_text(html.DEFAULT) == TEXT


def test_learned_scores_extract_too(spark):
    rows = [(i, f"u{i}", CASES[i % 3]) for i in range(12)] + [(20, None, CASES[3]), (20, None, CASES[3]), (21, "n", None), (22, "e", ""), (None, "t", "just text"), (23, "w", "<nav>only a menu</nav>"), (24, "l", "<p>" + "word " * 200_000)]
    got = html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {}
    for x in got:
        texts.setdefault(x.page_id, []).append(x.text)
    assert all(texts[i] == [TEXT] for i in range(12))
    assert texts[20] == [TEXT, TEXT]
    assert texts[21] == texts[22] == texts[23] == [""]
    assert texts[None] == ["just text"]
    assert texts[24] == [("word " * 200_000).strip()]


def test_odd_markup_does_not_stop_it():
    for case in ("<", "a < b", "<p", "<p class='", "</", "<!-- open", "<script>open", "<a href=\"x>y", "&#xD800; &#0; &bogus;", "<div " * 2000, "<p '" * 2000, "</p>" * 50):
        html.Page(case).main_text(html.DEFAULT)
    assert html.Page("if a < b then c").main_text(html.DEFAULT) == "if a < b then c"


def test_empty_table(spark):
    assert html.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = "<p>" + "a long paragraph of many words " * 20 + "</p>"


def test_names_that_hold_a_mark_do_not_take_article_text_out(spark):
    rows = [(i, f"u{i}", CASES[i % 3]) for i in range(12)]
    learned = html.learned_scores(spark.createDataFrame(rows, SCHEMA))
    part = "Related work is told here in a section of its own."
    for name in ("id='related-work'", "class='social-history'", "class='product banner-years'", 'class="shareWorth"'):
        for holder in ("article", "div"):
            page = f"<nav><a href=/>Home</a></nav><{holder}><h1>Head line</h1><p>First one, long enough to outweigh two tags.</p><section {name}><p>{part}</p></section>{LONG}</{holder}><footer>End</footer>"
            want = f"Head line\nFirst one, long enough to outweigh two tags.\n{part}\n" + ("a long paragraph of many words " * 20).strip()
            assert html.Page(page).main_text(html.DEFAULT) == want, (name, holder)
            if holder == "article":
                assert html.Page(page).main_text(learned) == want, name


def test_names_that_say_nothing_but_the_mark_stay_out():
    for name in ("class=ad", "class='related-posts'", "class='x cookie_notice'", "id=sidebarLeft", "class='comment-list'", "role=navigation", "class='ad-slot-3'"):
        page = f"<article><h1>Head line</h1>{LONG}<div {name}><p>None of this at all.</p></div>{LONG}</article>"
        assert "None" not in html.Page(page).main_text(html.DEFAULT), name
        assert html.Page(page).main_text(html.DEFAULT).count("a long paragraph") == 40, name


def test_a_long_advert_does_not_end_the_article(spark):
    advert = "<div class=ad>" + "buy this thing now " * 100 + "</div>"
    rows = [(i, f"u{i}", CASES[i % 3]) for i in range(12)]
    scores = html.learned_scores(spark.createDataFrame(rows, SCHEMA))
    big = "<p>" + "a long paragraph of many words " * 200 + "</p>"
    got = html.Page(f"<body><article>{big}{advert}{big}</article>").main_text(scores)
    assert got == "\n".join(["a long paragraph of many words " * 200][0].strip() for _ in range(2))


def test_formulas_are_text_and_custom_elements_are_no_raw_ones():
    page = f"<article>{LONG}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> be.</p><video-box><p>A caption.</p></video-box>{LONG}</article>"
    got = html.Page(page).main_text(html.DEFAULT)
    assert "\nLet x=2 be.\nA caption.\n" in got
