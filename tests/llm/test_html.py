import html
import json
import random
import re

from tessera.llm.html import _matched, align, extract, extract_pages, infer_wrappers, parse, wrapper_of
from tessera.llm.html_query import op7_html_extraction


def plain(page):
    """What the made pages hold: h1 and paragraphs of their one article."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def page(i, body, extra=""):
    return f"""<html><head><title>t{i}</title><script>x('</p>')</script></head><body><div class="site-header">Site name</div>
    <div id="sidebar"><p>links {i}</p></div><div class=wrap><div class="post"><p>{body}</p><p>Second&nbsp;of {i} &lt;b&gt;</p>{extra}<p>All rights kept by Site.</p></div></div>
    <div class="cookie-notice">We use cookies</div><form><label>Name</label></form><div id=comments><p>First! {i}</p></div><footer>foot {i}</footer></body></html>"""


ODD = [(None, None, None), (1, "http://one.example/a", ""), (2, "http://one.example/b", "just text & more"), (3, None, "<p>un<b>closed <p>two"), (4, "x", "<article><p>a</p><nav>n</nav><aside>s</aside><p>b<!-- c --></p><div class='share ad'>no</div></article> tail")]


def test_odd_pages(spark):
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in ODD], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(frame).collect()}
    assert got == {None: ("", 0), 1: ("", 0), 2: ("just text & more", 16), 3: ("unclosed\ntwo", 12), 4: ("a\nb", 3)}
    assert extract_pages(frame.limit(0)).count() == 0


def test_wrapper_of_a_host(spark):
    rows = [(i, "https://site.example/" + str(i), page(i, f"Body number {i} " * (i + 3), "<p>more</p>" * (i % 3))) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    wrapper = infer_wrappers(frame).collect()
    assert len(wrapper) == 1 and wrapper[0].pages == 12 and wrapper[0].host == "site.example"
    assert '"+"' in wrapper[0].wrapper and '["x"]' in wrapper[0].wrapper
    got = {r.page_id: r.text for r in extract_pages(frame).collect()}
    for i in range(12):
        lines = got[i].split("\n")
        assert lines[0] == " ".join((f"Body number {i} " * (i + 3)).split()) and lines[1] == f"Second of {i} <b>"
        assert not any(w in got[i] for w in ("Site name", "links", "cookies", "First!", "foot", "Name"))


def test_alignment():
    a, b = (wrapper_of(parse(p)) for p in ("<ul><li>a<li>b</ul><p>same</p>", "<ul><li>c</ul><div>new</div><p>same</p>"))
    assert align(a, b) == [["e", "ul", [["+", ["e", "li", [["x"]]]]]], ["?", ["e", "div", [["c", "new"]]]], ["e", "p", [["c", "same"]]]]
    assert json.loads(json.dumps(a)) == a


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op7_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)
    assert extract("<article>x</article>") == "x"


def test_text_of_few_pages_is_kept(spark):
    same = "<div>Kept by the site.</div>"
    rare = {3: "<h2>Only here</h2>", 6: "<h2>Here twice</h2>", 9: "<h2>Here twice</h2>", 11: "<ul><li>ad hoc</li><li>ad hoc</li><li>ad hoc</li><li>ad hoc</li><li>ad hoc</li></ul>"}
    rows = [(i, f"http://a.example/{i}", f"<article><h1>T{i}</h1><p>a{i}</p>{rare.get(i, '')}<p>c{i}</p>{same}</article>") for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract_pages(frame).collect()}
    inner = {3: ["Only here"], 6: ["Here twice"], 9: ["Here twice"], 11: ["ad hoc"] * 5}
    assert got == {i: "\n".join([f"T{i}", f"a{i}", *inner.get(i, []), f"c{i}", "Kept by the site."]) for i in range(12)}


def test_names_never_leave_out_the_article():
    text = "<h1>Title</h1><p>The whole text of the article.</p>"
    whole = "Title\nThe whole text of the article."
    for page in (
        f"<body class='has-sidebar'><div>{text}</div></body>",
        f"<body class='sidebar no-sidebar ad-free'><article>{text}</article></body>",
        f"<main class='with-sidebar share'>{text}</main>",
        f"<div id='content' class='share-enabled'>{text}</div>",
        f"<div class='widget'><main>{text}</main></div>",
        f"<div class='social'><div class='post'>{text}</div></div>",
        f"<article class='post related related-topics comments-open'>{text}</article>",
        f"<article class='ad'><h1>Title</h1><div class='share'><p>The whole text of the article.</p></div></article>",
        f"<main><article>{text}</article><div class='comments'><article>First!</article></div></main>",
        f"<article>{text}<p class='share-price'></p><div class='ad-1'>Buy</div><div class='left sidebar'>x</div></article>",
    ):
        assert extract(page) == whole, page
    assert extract(f"<article>{text}<p class='share-price'>Up 3</p></article>") == whole + "\nUp 3"


def test_article_without_its_tag_among_neutral_names(spark):
    def made(i):
        return (
            f"<body><div class=a><p>Welcome to our pages, dear reader.</p></div><div class=b><h1>Title {i}</h1><p>{'Long text of the page. ' * 9}{i}</p>"
            f"<p>Second part {i}.</p><h4>Printed with care by us all.</h4></div><div class=c><p>Find us in the old town.</p></div></body>"
        )

    frame = spark.createDataFrame([(i, "http://n.example/", made(i)) for i in range(20)], "page_id long, url string, html string").repartition(3)
    for r in extract_pages(frame).collect():
        assert r.text == f"Title {r.page_id}\n{'Long text of the page. ' * 9}{r.page_id}\nSecond part {r.page_id}."
    alone = extract(made(1))
    assert "Printed with care" in alone  # what only the host's other pages can tell


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>one</p>two<nav>menu</nav>" + "</div>" * 3000 + "<p>three"
    assert extract(deep) == "one\ntwo\nthree"
    assert extract("<article>" + "<div>a" * 300 + "</div>b" * 300 + "</article>") == "\n".join("a" * 300 + "b" * 300)
    long = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(6000)) + "</article>"
    wrapper = align(wrapper_of(parse(long), True), wrapper_of(parse(long.replace("<p>p77</p>", "")), True))
    assert extract(long, wrapper, 2).count("\n") == 11999


def test_wrapper_does_not_grow_with_names_of_pages(spark):
    def size(n):
        rows = [(i, "http://g.example/", f"<body><div id='post-{'abcdefgh'[i % 8]}{i}' class='post-{i} entry'><p>text {i} of it</p></div></body>") for i in range(n)]
        return len(infer_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()[0].wrapper)

    assert size(200) < size(20) + 20


def test_names_inside_an_article_are_whole_tokens():
    page = "<article><div class='search-results-text'><p>Para on search</p></div><p>b</p><div class='share'>Share this</div></article>"
    assert extract(page) == "Para on search\nb"


def test_whole_table_by_its_wrappers_alone(spark, sf_dir):
    """Without any telling tag or name the hosts' wrappers find the same texts; pages by themselves don't all do."""
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    neutral = lambda h: re.sub("<(/?)(?:article|footer)>", r"<\1div>", h.replace('class="ad"', 'class="zz"'))
    rows = [(r.page_id, "http://one.example/", neutral(r.html)) for r in frame if r.html]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[r.page_id] == plain(r.html) for r in frame if r.html)


def test_common_texts_of_an_article_are_kept(spark):
    rows = [(i, "http://s.example/", f"<article><h1>Hello</h1><p>a{i}</p><h2>Summary</h2><p>c{i}</p></article>") for i in range(6)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Hello\na{i}\nSummary\nc{i}" for i in range(6)}


def test_no_depth_loses_text():
    for depth in (1, 119, 120, 121, 200, 900, 3000):
        assert extract("<div>" * depth + "x") == "x"
        assert extract("<div>" * depth + "<h1>T</h1>x" + "</div>" * depth) == "T\nx"
        assert extract("<article>" + "<div>" * depth + "<h2>T</h2><p>x</p>" + "</div>" * depth + "y</article>") == "T\nx\ny"


def test_what_stands_beside_the_heaviest_element():
    text = "long text of it. " * 30
    assert extract(f"<body><h1>Title of it</h1><div><p>{text}</p></div></body>") == "Title of it\n" + text.strip()
    assert extract(f"<body><div><p>lead</p><div><p>{text}</p><p>{text}</p></div><p>closing</p></div></body>") == "\n".join(["lead", text.strip(), text.strip(), "closing"])
    assert extract(f"<body><div>lead<div><p>{text}</p></div></div><div class='menu'>Home</div></body>") == "lead\n" + text.strip()
    assert extract(f"<body><div class=x>Other things</div><div><p>{text}</p></div></body>") == text.strip()


def longest_match(left, right):
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if left[i] == right[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_alignments_of_any_length_are_the_longest():
    rng = random.Random(3)
    for n, m, kinds in [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 6)) for _ in range(400)] + [(300, 200, 3), (1050, 1000, 4), (1001, 1001, 40)]:
        left, right = ([f"k{rng.randrange(kinds)}" for _ in range(size)] for size in (n, m))
        assert list(_matched(left, right)) == longest_match(left, right), (n, m, kinds)


def test_a_long_page_is_aligned_like_a_short_one():
    for n in (100, 1200):
        body = [["e", f"p{i * i % 97}", []] for i in range(n)]
        merged = align(body, body[: n // 2] + body[n // 2 + 30 :])  # farther apart than a few places
        assert [i for i, node in enumerate(merged) if node[0] == "?"] == list(range(n // 2, n // 2 + 30))
