import random
import re
from urllib.parse import urlsplit

from lotwise.llm.html_text import Page, _rows, main_texts


def text(source):
    return " ".join(t for t, _ in Page(source).blocks())


def test_blocks_entities_and_space():
    assert text("<p>a&amp;b&nbsp;&eacute;\n c<p> d <b>e</b>f<br>g") == "a&b é c d ef g"
    assert text("plain &lt;text&gt; &#65;&#x42; &am") == "plain <text> AB &am"
    assert text("") == "" and text("<p> \n </p>") == ""


def test_what_is_no_article_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body><header>H</header><nav><ul><li>menu<li>more</ul></nav><!-- <p>no</p> --><div class="ad box">buy</div>
    <div id='cookie-notice'>cookies</div><article><h1>Title</h1><p><b>One.<br><p>Two <i>words</i>.</p>
    <aside>side</aside><form><input value="<p>no">Name</form><ul><li>x<li>y</ul>
    <div class="comments"><p>first!</p></div></article><footer>&copy; F</footer></body></html>"""
    assert text(page) == "Title One. Two words . x y".replace("words .", "words.")


def test_broken_markup():
    assert text("<article><p>one <b>two<p>three</article><p>out") == "one two three"
    assert text("a < b and 3 <4 <p") == "a < b and 3 <4"
    assert text('<p title="a>b">x</p></div></nav>y') == "x y"
    assert text("<nav>menu") == "" and text("<script>x") == ""
    assert text("<div>" * 3000 + "deep") == "deep"


def test_marks_drop_only_what_they_name():
    for name in ("has-sidebar", "no-sidebar", "comments-open", "menu-open"):
        assert text(f"<body class='{name}'><p>kept</p></body>") == "kept"
    assert text("<article class='post category-social'><p>kept</p></article>") == "kept"
    assert text("<main id=menu><div class='with-sidebar'><p>kept</p></div></main>") == "kept"
    assert text("<div class='x sidebar-left'>no</div><div id=Cookie_box>no</div><p>kept") == "kept"


def test_quotes_open_a_value_only_after_an_equals_sign():
    assert text("<p title=it's>two words</p><p>three</p><p>isn't four</p>") == "two words three isn't four"
    assert text("<p o'clock>one</p><p>it's</p>") == "one it's"
    assert text("""<p title = 'a>b' lang="c>d">x</p>""") == "x"
    assert text("x " + '<a b="c" ' * 3000) == "x"


def page(host, i, body):
    return (i, f"http://{host}/{i}", f"<html><body><div><p>Top of {host}</p></div>{body}</body></html>", "x")


def test_templates_are_counted_per_host(spark):
    share = '<div><span>Follow us</span></div>'
    rows = [page("a.com", i, f"<article><p>Story {i}</p><p>All rights reserved.</p>{share}</article>")
            for i in range(8)]
    rows += [page("b.com", 100 + i, f"<div><p>Note {i}</p></div>") for i in range(8)]
    rows += [page("c.com", 200, "<div><p>Alone</p></div>")]
    # equal pages are one page for the template, so copies do not erase each other
    rows += [(300 + i, "http://d.com/x", "<body><p>Same</p></body>", "x") for i in range(20)]
    rows += [(400, None, None, "x"), (401, "odd", "", None), (None, "http://e.com", "<p>n</p>", "x")]
    frame = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string, host string")
    got = {}
    for r in main_texts(frame).collect():
        assert got.setdefault(r.page_id, r.text) == r.text
    for i in range(8):
        assert got[i] == f"Story {i} All rights reserved."
        assert got[100 + i] == f"Note {i}"
    assert got[200] == "Top of c.com Alone"
    assert all(got[300 + i] == "Same" for i in range(20))
    assert got[400] == got[401] == "" and got[None] == "n"
    assert main_texts(frame).count() == len(rows) + 1


def test_copies_of_an_article_under_different_menus_keep_it(spark):
    story = "<h1>Head</h1><p>One story.</p><ul><li>a<li>b</ul><table><tr><td>c</table>"
    bodies = {"a.com": f"<article><div class=body>{story}</div></article>",
              "b.com": "<article><div>Plain</div><section>words</section></article>",
              "c.com": f"<div class=wrap><main>{story}<p>Licence</p></main></div>"}
    texts = {"a.com": "Head One story. a b c", "b.com": "Plain words", "c.com": "Head One story. a b c Licence"}
    rows = [page(h, 100 * k + i, f"<nav>menu {i}</nav>{b}<div class=comments>reply {i}</div>")
            for k, (h, b) in enumerate(bodies.items()) for i in range(10)]
    # other articles of the hosts, so that their copies are a part of the pages
    rows += [page(h, 1000 + 100 * k + i, f"<article><p>Own {i}</p></article>") for k, h in enumerate(bodies)
             for i in range(10)]
    # the date of each copy is in the article, the paragraphs stay in their container
    rows += [page("d.com", 2000 + i, f"<article><div>{story}</div><p>Day {i}</p></article>") for i in range(10)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in main_texts(frame).collect()}
    for k, h in enumerate(bodies):
        assert {got[100 * k + i] for i in range(10)} == {texts[h]}
        assert [got[1000 + 100 * k + i] for i in range(10)] == [f"Own {i}" for i in range(10)]
    assert [got[2000 + i] for i in range(10)] == [f"Head One story. a b c Day {i}" for i in range(10)]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_texts(frame).collect() == []


def test_marks_inside_an_article_are_whole_names():
    assert text("<article><div class='social-studies'><p>lesson text</p></div></article>") == "lesson text"
    assert text("<article><p class='alert-systems'>real prose</p><div class='comments'>no</div></article>") == "real prose"
    assert text("<div class='social-studies'><p>no</p></div><p>kept</p>") == "kept"


def test_very_long_pages_take_linear_time():
    import time
    began = time.process_time()
    flat = "".join(f"<div><b>{i}</b> words</div>" for i in range(100_000))
    nested = "".join(f"<div>level {i}" for i in range(20_000))
    unclosed = "<div>" * 20_000 + "</span>" * 20_000
    for source in (flat, nested, unclosed):
        _rows(source)
    assert time.process_time() - began < 20


def brute_templates(pages, least_pages=5, least_share=0.2):
    """Pages without ``article``, one text a div: what is left when the texts of a host recur."""
    found = {i: (urlsplit(u).hostname, re.findall(r"<div>([^<]*)</div>", h)) for i, u, h in pages}
    kept = {}
    hosts = {}
    for host, texts in found.values():
        hosts.setdefault(host, set()).add(tuple(texts))
    for i, (host, texts) in found.items():
        distinct = hosts[host]
        often = {t for t in texts if sum(t in d for d in distinct) >= max(least_pages, least_share * len(distinct))}
        left = [t for t in texts if t not in often]
        kept[i] = " ".join(left or texts) if len(distinct) >= least_pages else " ".join(texts)
    return kept


def test_templates_decide_pages_without_an_article(spark):
    rng, pages = random.Random(6), []
    for n in range(120):
        host = f"h{n % 4 if n % 3 else 0}.example"      # one host holds more than a third
        menu = ["Home", "About us", f"Shop of {host}"]
        body = [f"Story {rng.randint(0, 60)} of {host}" for _ in range(rng.randint(0, 3))]
        parts = menu[:rng.randint(1, 3)] + body + (["All about cookies"] if rng.random() < .5 else [])
        pages.append((n, f"http://{host}/{n}", "<body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(frame).collect()}
    want = brute_templates(pages)
    assert got == want
    assert sum(len(h) for _, _, h in pages) > sum(map(len, want.values())) > 0
    assert any("Home" not in t for t in want.values())
