import random

from seriesloom.llm.dom import blocks, parse
from seriesloom.llm.html_extraction import aligned, extract_main_text, fold, induce, main_text, match, not_article

NO_WRAPPER = {"main": "", "template": {}}


def page(i, body, article=True):
    tag = "article" if article else 'div class="story"'
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='</p>';</script></head><body><header><a href=/>Site</a></header>"
        f"<nav><ul><li>Home<li>News {i}</ul></nav><div class='ad'>Buy {i}</div><{tag}>{body}</{tag.split()[0]}>"
        f"<div class='comments'><p>reader {i} says</p></div><footer>&copy; {i}"
    )


def test_blocks_of_bad_markup():
    text = main_text(page(1, "<h1>A &amp;amp; B</h1><p><b>one\n two<br><p>three<br>four<ul><li>x<li>y</ul>tail &lt;p&gt;<form>no</form>"), NO_WRAPPER)
    assert text == "A &amp; B\n\none two\n\nthree four\n\nx\n\ny\n\ntail <p>"
    assert main_text(None, NO_WRAPPER) == main_text("", NO_WRAPPER) == main_text("<article></article>", NO_WRAPPER) == ""
    assert main_text("plain < text", NO_WRAPPER) == "plain < text"
    assert [line for _, line in blocks(parse("<table><tr><td>a<td>b<tr><td>c</table>"), not_article)] == ["a", "b", "c"]


def test_wrapper_without_article_element():
    """The main element is where the varying text lies, template text inside it goes."""
    share = '<div class="tools-x">Print this</div>'
    pages = [page(i, share + "".join(f"<p>story {i} part {k} with words" + " more" * i + "</p>" for k in range(3 + i)), article=False) for i in range(4)]
    wrapper = induce(pages)
    assert wrapper["main"].endswith("div.story")
    assert main_text(pages[2], wrapper) == "\n\n".join(f"story 2 part {k} with words more more" for k in range(5))


def test_copies_keep_their_text():
    """Paragraphs stay even if all pages have them."""
    pages = [page(i, "<h1>Same</h1><p>same text</p>") for i in range(3)]
    assert main_text(pages[0], induce(pages)) == "Same\n\nsame text"


def test_simple_tree_matching():
    a, b = (fold(parse(t)) for t in ("<div><p>1</p><ul><li>a</ul><p>2</p></div>", "<div><p>1</p><p>2</p><table></table></div>"))
    (a, _), (b, _) = a, b
    assert match(a, b)[0][len(a.labels) - 1, len(b.labels) - 1] == 3
    assert list(aligned(a, b)) == [(0, 0), (1, 1), (2, 2)]
    deep, _ = fold(parse("<div>" * 3000 + "x"))
    assert len(list(aligned(deep, deep))) == 3001


def brute_match(a, b, x, y):
    """The same number from its definition: all ways to leave out children."""
    if a.labels[x] != b.labels[y]:
        return 0

    def best(u, v):
        if not u or not v:
            return 0
        return max(best(u[1:], v), best(u, v[1:]), brute_match(a, b, u[0], v[0]) + best(u[1:], v[1:]))

    return 1 + best(a.children[x], b.children[y])


def test_matching_against_its_definition():
    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "ul", "table"], k=rng.randint(0, 4))) if depth else ""

    for _ in range(60):
        (a, _), (b, _) = (fold(parse(tree(3))) for _ in range(2))
        n = brute_match(a, b, len(a.labels) - 1, len(b.labels) - 1)
        pairs = list(aligned(a, b))
        assert match(a, b)[0][len(a.labels) - 1, len(b.labels) - 1] == n == len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_shared_headings_and_short_paragraphs_stay():
    pages = [f"<body><div class='x'>Top line</div><article><h2>Introduction</h2><p>story {i} goes on</p><p>Yes.</p><h2>References</h2></article></body>" for i in range(6)]
    wrapper = induce(pages)
    assert {main_text(p, wrapper).replace(str(i), "N") for i, p in enumerate(pages)} == {"Introduction\n\nstory N goes on\n\nYes.\n\nReferences"}


def test_short_article_does_not_bring_notices_back():
    pages = [f"<body><p>This site asks you to read its long terms of use</p><article><p>Story {i}</p></article></body>" for i in range(6)]
    assert main_text(pages[2], induce(pages)) == "Story 2"


def test_names_by_any_word():
    gone = "user-comments post-comments gdpr-banner site-nav main-menu left-sidebar article_comments_list site-header reader-comment post-share cookie-bar".split()
    kept = "lunch-menu article-header no-sidebar content-sidebar-wrap share-price market-share editor-comment has-ads entry-header".split()
    body = "".join(f"<div class='{n}'>gone</div>" for n in gone) + "".join(f"<div class='{n}'>{n}</div>" for n in kept)
    text = main_text(f"<article>{body}<section id='user-comments'><p>gone</p></section><div style='color:red; display : none'>gone</div><p style='display:none-x'>seen</p></article>", NO_WRAPPER)
    assert text.split("\n\n") == [*kept, "seen"]


def test_table_equals_wrapper_in_memory(spark):
    """Random pages of some hosts and layouts: Spark's result is that of the wrapper in memory."""
    rng = random.Random(9)
    lines = [f"line {k} of few" for k in range(6)]

    def part(depth):
        tag = rng.choice(["div", "p", "section", "ul", "div class='box'", "article", "h2"])
        inner = "".join(part(depth - 1) for _ in range(rng.randint(1, 3))) if depth and tag.split()[0] in ("div", "section", "article") else rng.choice([*lines, f"own {rng.random()}"])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    pages = [(i, f"http://h{rng.randrange(3)}.example/{i}", f"<body>{part(3)}{part(1)}</body>") for i in range(120)]
    pages += [(200 + i, u, p) for i, (_, u, p) in enumerate(pages[:20])]
    by_host = {}
    for _, u, p in pages:
        by_host.setdefault(u.split("/")[2], []).append(p)
    wrappers = {h: induce(ps) for h, ps in by_host.items()}
    want = {i: main_text(p, wrappers[u.split("/")[2]]) for i, u, p in pages}
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()} == want
    assert any(w["template"] for w in wrappers.values())


def test_table(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i, f"<p>text {i}</p>"), "x", "y") for i in range(12)]
    rows += [(0, "https://h0.example/0", rows[0][2], "x", "y"), (50, None, page(50, "<p>fifty</p>"), "x", "y"), (51, "https://h0.example/51", None, "x", "y"), (None, "https://h1.example/n", page(3, "<p>none</p>"), "x", "y"), (52, "not a url", "<p>" + "long " * 50_000, "x", "y")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, wrapper string")
    found = extract_main_text(frame).collect()
    assert len(found) == len(rows)
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in found)
    want = sorted([(i, f"text {i}") for i in range(12)] + [(0, "text 0"), (50, "fifty"), (51, ""), (-1, "none"), (52, ("long " * 50_000).strip())])
    assert got == want
    assert extract_main_text(frame.limit(0)).count() == 0


def test_attributes_by_full_name():
    """Values that hold the word hidden hide nothing, and names do not remove headings or slots."""
    body = (
        '<h1 class="header-title">Title</h1><h2 id="search-engines">Engines</h2><div class="share-price">12.30</div><p title="hidden gems">one</p>'
        '<p aria-hidden="false">two</p><p hidden>gone</p><div class="share-buttons">gone</div><p>a <span class="comment">b</span></p>'
    )
    assert main_text(f'<body style="overflow-x:hidden"><article>{body}</article>', NO_WRAPPER) == "Title\n\nEngines\n\n12.30\n\none\n\ntwo\n\na b"


def test_every_varying_slot_is_kept():
    """Teasers in article elements do not stand for the page, and a title or second body of its own is kept."""
    pages = [
        f"<body><div class='head-line'>Lead {i}</div><div class='content'><p>story {i} {'long ' * 40}</p></div><div class='second'>more of {i}</div>"
        f"<article class='card'>teaser {i}</article></body>"
        for i in range(5)
    ]
    assert main_text(pages[3], induce(pages)).split("\n\n") == ["Lead 3", f"story 3 {'long ' * 40}".strip(), "more of 3", "teaser 3"]


def test_template_of_all_pages(spark):
    """Each layout has its template; odd pages do not hinder, copies keep their text."""
    first = [f"<body><div class='top'>Menu one</div><article><p>story {i} goes on</p><div class='box'>Read our paper</div></article></body>" for i in range(40)]
    second = [f"<body><div class='lay'><div>Menu two</div><p>tale {i} goes on</p></div></body>" for i in range(5)]
    odd, copies = ["<body>error 500</body>"], [f"<body><div class='ad'>{i}</div><article><p>one copied text</p></article></body>" for i in range(30)]
    rows = [(i, "http://h.example/" + str(i), p) for i, p in enumerate(first + second + odd + copies)]
    found = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [found[i] for i in (0, 39, 40, 44, 45, 46, 75)] == ["story 0 goes on", "story 39 goes on", "tale 0 goes on", "tale 4 goes on", "error 500", "one copied text", "one copied text"]
