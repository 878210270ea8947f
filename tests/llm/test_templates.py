import html
import random
import re

import pytest

from muster.llm import templates
from muster.llm.templates import main_text, parse

PAGE = """<!DOCTYPE html><HTML><head><title>T &amp; t</title><style>p{}</style><script>if (a < b) { "</p>" }</script></head><body class="no-sidebar has-comments">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies</div><div class='page-ad'>Buy!</div>
<form><label>Name <input name=n></label></form><!-- a > b --><aside>Side</aside>
<article><header><h1>A  title
here</h1></header><p>First &lt;b&gt; &eacute;&nbsp;x<b>bold<br>line</b> end<p>Second<script>no()</script> one.<ul><li>one<li>two <a href=z>link</a> and words that are not in it</ul>
<div class="share-buttons">Share</div><table><tr><td>c1<td>c2<tr><td>c3</table><blockquote>Quote<p>inner</blockquote>tail<hr>more
<div hidden>hid</div><div style="display: none">hid</div><div role=dialog>hid</div>
<section id="comments"><article class=comment><p>Reader says</p></article></section><footer>Filed under</footer></article><footer>&copy; me</footer></body></html>"""


def test_one_page():
    assert main_text(PAGE).split("\n\n") == ["A title here", "First <b> é x bold line end".replace("x bold", "xbold"), "Second one.", "one", "two link and words that are not in it", "c1", "c2", "c3", "Quote", "inner", "tail", "more"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain  words\n& more", "plain words & more"),
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
        ("<div>a<span> b </span>c</div><div>d", "a b c\n\nd"),
        ("a < b and c > d <3", "a < b and c > d <3"),
        ("<p>1 &amp 2 &amp;amp; 3 &#x41;&#66; &am &bogus;</p>", "1 & 2 &amp; 3 AB &am &bogus;"),
        ("<p>x<b>y<i>z</b>w</i>v</p>q", "xyzwv\n\nq"),
        ("<article><p>in</p></div></article><p>out</p>", "in"),
        ("<main><h1>H</h1><article><p>a</p></article></main><p>o", "H\n\na"),
        ("<div class='content with-sidebar'><article>kept</article></div><div class=sidebar>gone</div>", "kept"),
        ("<article>one</article><p>between</p><article>two</article>", "one\n\ntwo"),
        ("<p>text<script>never closed <p>x", "text"),
        ("<textarea>t</textarea><p>p</p><noscript>n</noscript>", "p"),
        ("<p>a</p><nav>b", "a"),
        ('<p title="x > y">a</p><p title=\'">\'>b</p>', "a\n\nb"),
        ("<article class=comment>r</article><div>body</div>", "body"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<p><b>open<br><p>next", "open\n\nnext"),
        ("</p></b></div>x", "x"),
        ("<", "<"),
        ("<article>", ""),
    ],
)
def test_markup(page, want):
    assert main_text(page) == want


def test_trees_do_not_depend_on_end_tags_left_out():
    a = parse("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table><dl><dt>t<dd>d</dl>")
    b = parse("<ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table><dl><dt>t</dt><dd>d</dd></dl>")
    templates.label(a)
    templates.label(b)
    assert a.digest == b.digest != 0


SCHEMA = "page_id long, url string, html string, text string, host string, template string"


def site(n):
    """Pages without telling names: only recurrence tells the template. Some pages are whole copies, and one sentence recurs in articles."""
    r = random.Random(4)
    words = lambda k: " ".join(r.choice(("sun", "moon", "tide", "rock", "wind", "leaf")) + str(r.randrange(99)) for _ in range(k))
    rows, want = [], []
    for i in range(n):
        article = [words(9), "A common sentence.", words(5)] if i % 5 else ["the copied page", "has two paragraphs"]
        host = "big.example" if i % 3 else f"h{i % 7}.example"
        body = "".join(f"<p>{x}</p>" for x in article)
        inner = f"<article>{body}<div>Read more from us</div></article>" if i % 2 else f"<div>{''.join(f'<div>{x}</div>' for x in article if x != 'A common sentence.')}</div>"
        rows.append((i, f"https://u@{host.upper() if i % 4 else host}:80/p/{i}", f"<body><div><ul><li>Start<li>About {host}</ul></div>{inner}<div>All rights <b>kept</b></div>", "x", "y", None))
        want.append((i, article if i % 2 else [x for x in article if x != "A common sentence."], host))
    return rows, want


def test_what_a_site_repeats_goes(spark):
    rows, want = site(240)
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "\n\n".join(x) for i, x, _ in want}


def test_template_table_may_be_joined(spark, monkeypatch):
    rows, want = site(240)
    monkeypatch.setattr(templates, "BROADCAST_BYTES", -1)
    rows += [rows[1], (None, None, "<p>no host", "", "", ""), (None, None, None, "", "", ""), (500, "mailto:x", "", "", "", "")]
    got = sorted(map(tuple, templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    texts = [(i, rows[i][1], "\n\n".join(x)) for i, x, _ in want]
    texts += [texts[1], (None, None, "no host"), (None, None, ""), (500, "mailto:x", "")]
    assert got == sorted(((*x, len(x[2])) for x in texts), key=repr)
    assert templates.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_are_those_of_a_plain_loop(spark):
    rows, _ = site(90)
    hosts, seen = {}, {}
    for i, url, page, *_ in rows:
        host = re.sub(":80/.*", "", url.split("@")[1]).lower()
        hosts[host] = hosts.get(host, 0) + 1
        root = parse(page)
        templates.label(root)
        for digest, parent in templates.subtrees(root):
            seen.setdefault((host, digest), set()).add(parent)
    want = {}
    for (host, digest), parents in seen.items():
        if len(parents) >= 4 and len(parents) >= 0.01 * hosts[host]:
            want.setdefault(host, []).append(digest)
    df = spark.createDataFrame(rows, SCHEMA).select(templates.host_of(templates.F.col("url")).alias("host"), templates.F.col("html").alias("text"))
    got = {r["host"]: r["template"] for r in templates.templates(df, templates.Scratch(spark, "t")).collect()}
    assert got == {h: sorted(x) for h, x in want.items()}


def test_sentences_that_recur_are_no_template(spark):
    """Pages without an article: a sentence of every tenth page stays, what all pages have goes, and so does a menu of every tenth."""
    words = [f"<div>{' '.join(f'w{i}x{k}' for k in range(9))}</div>" for i in range(200)]
    rows = [(i, "http://a.b/", f"<div><p>top</p></div><section>{w}{'<p>a common sentence</p>' if i % 10 == 0 else ''}</section>{'<div><ul><li>one<li>two</ul></div>' if i % 10 == 5 else ''}<p>All <i>rights</i></p>", "", "", "") for i, w in enumerate(words)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: [w[5:-6], *(["a common sentence"] if i % 10 == 0 else [])] for i, w in enumerate(words)}


def test_pages_of_the_table(spark):
    from muster.llm.queries import op13_html_extraction

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op13_html_extraction(spark, sf).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        plain = (" ".join(html.unescape(re.sub("</?(?:b|br)>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(x for x in plain if x) and r["n_chars"] == len(r["text"])
