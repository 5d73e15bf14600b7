"""Main text of pages: templates whose article is known, the query's table against a plain reading, markup rules."""

import html
import random
import re

import pandas as pd
import pytest
from conftest import SMOKE
from pyspark.sql import types as T

from spindle.llm import html_text

WORDS = ("the river town was built near a large hill and many people from other places came to live there while "
         "trade grew slowly in those years because boats could not pass").split()


def sentence(r, n=None):
    n = n or r.randint(6, 18)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + r.choice([".", ".", ".", "!", "?"])


def paragraph(r):
    return " ".join(sentence(r) for _ in range(r.randint(1, 6)))


def article(r):
    """(html, blocks): heading, paragraphs of very different length, a list, a quote."""
    parts, blocks = [], []

    def put(tag, text):
        parts.append(f"<{tag}>{html.escape(text)}</{tag}>")
        blocks.append(text)

    put("h1", sentence(r, 5))
    for i in range(r.randint(4, 9)):
        put("p", paragraph(r) if r.random() < 0.8 else "Yes.")
        if i == 1:
            put("h2", "History & trade")
        if i == 2:
            items = [sentence(r, 8) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            blocks.extend(items)
        if i == 3:
            q = paragraph(r)
            parts.append(f"<blockquote><p>{q}</p></blockquote>")
            blocks.append(q)
    return "".join(parts), blocks


def links(n):
    return "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(n))


TEMPLATES = {
    "article": "<html><head><title>T, t.</title><style>p{{margin:0}}</style></head><body><nav><ul>{menu}</ul></nav>"
               "<div class='ad'>{noise}</div><article>{body}</article><footer>&copy; {noise}</footer></body></html>",
    "div": "<html><body><div id='header'><a href='/'>Home</a><p>{noise}</p></div><div class='menu'><ul>{menu}</ul></div>"
           "<div class='post-body'>{body}</div><div class='sidebar'><h3>Recent</h3><p>{noise}</p></div>"
           "<div id='comments'><div class='c'><p>{noise}</p></div><div class='c'><p>{noise2}</p></div></div>"
           "<div class='footer'><p>{noise}</p></div></body></html>",
    "main": "<!doctype html><body class='has-sidebar'><header><h2>Site</h2><p>{noise}</p></header><main><section>{body}</section>"
            "<aside><p>{noise}</p></aside><form action='/s'><label>Your mail</label><p>{noise}</p><input name=q></form></main>"
            "<div class='cookie-notice' role='alert'>{noise}</div></body>",
    "plain": "<body><ul>{menu}</ul><div><div>{body}</div></div><ul>{menu}</ul><script>var x='<p>{noise}</p>';</script></body>",
    "table": "<body><table><tr><td><ul>{menu}</ul></td><td>{body}</td></tr></table><p><a href='/'>Home</a> | <a href='/c'>Contact us</a></p></body>",
    "titled": "<body><div class='site-header'><p>{noise}</p></div><div class='story'><div class='entry-header'><h2>Part one</h2></div>{body}"
              "<div class='post-footer'><p>{noise}</p></div></div></body>",
    "wrapped": "<body><div class='page-with-header search'><div class='content'>{body}</div><section class='related-posts'><p>{noise}</p></section>"
               "<ol class='commentlist'><li><p>{noise}</p></li><li><p>{noise2}</p></li></ol></div><nav>{menu}</nav></body>",
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates(name):
    for seed in range(40):
        r = random.Random(seed)
        body, blocks = article(r)
        page = TEMPLATES[name].format(body=body, menu=links(r.randint(4, 12)), noise=paragraph(r), noise2=paragraph(r))
        want = ["Part one", *blocks] if name == "titled" else blocks
        assert html_text.main_texts([page]) == ["\n".join(want)], (name, seed)


def test_long_comments_do_not_win():
    r = random.Random(1)
    body, blocks = article(r)
    talk = "".join(f"<div class='comment'><p>{paragraph(r)}</p></div>" for _ in range(60))
    assert html_text.main_texts([f"<body><article>{body}</article><section id='comments'>{talk}</section></body>"]) == ["\n".join(blocks)]


def test_markup():
    text = lambda s: html_text.main_texts([s])[0]
    assert text("<p>a&nbsp;&amp;amp; b\n\t c<br>d</p><p> </p><p>&#233;&#x1F600; <b>b</b>old<!-- x > <p>no</p> --></p>") == "a &amp; b c d\né\U0001F600 bold"
    assert text("<p><b>One, two.<br><p>Three, four.</p><p>Five<p>Six") == "One, two.\nThree, four.\nFive\nSix"
    assert text("<p>a < b and c > d, 5<6.</p>") == "a < b and c > d, 5<6."
    assert text('<p title="a>b">x, y.</p><script>if (a</b) "</p>"</script><p>z, w.</p>') == "x, y.\nz, w."
    assert text("<div>alpha, beta.<p>gamma, delta.</p>epsilon, zeta.</div>") == "alpha, beta.\ngamma, delta.\nepsilon, zeta."
    assert text("plain text, no markup.") == "plain text, no markup."
    assert text("<p>open, never closed <!-- cut") == "open, never closed"
    assert text("<nav><p>only a menu, here.</p></nav>") == ""
    assert html_text.main_texts([None, "", "<html></html>", "<p></p>"]) == [""] * 4
    assert html_text.main_texts([]) == []


def test_path_ratios_by_hand():
    rows = [(0, "a/p", 100, 4, 0), (0, "a/p", 20, 0, 0), (0, "a/nav", 30, 0, 30), (1, "b", 10, 1, 0)]
    out = html_text.path_ratios(pd.DataFrame(rows, columns=["page", "path", "chars", "punctuation", "links"]))
    chars, marks = [60, 60, 0, 10], [4.1 / 2, 4.1 / 2, 0, 1.1]

    def smooth(x):
        return [(0.5 * x[0] + 0.25 * x[1]) / 0.75, 0.25 * x[0] + 0.5 * x[1] + 0.25 * x[2], (0.25 * x[1] + 0.5 * x[2]) / 0.75, x[3]]

    want = [(c * m) ** 0.5 for c, m in zip(smooth(chars), smooth(marks))]
    assert out["fused"].tolist() == pytest.approx(want)
    assert out["ratio"].tolist() == pytest.approx([(want[0] + want[1]) / 2] * 2 + want[2:])
    assert out["content"].tolist() == [True, True, False, True] or out["content"].tolist()[:2] == [True, True]


def by_hand(page):
    """The article element of the test tables' one template, read with plain patterns."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]+>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def test_query_on_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()}
    out = html_text.op13_html_extraction(spark, SMOKE).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == by_hand(pages[r.page_id].html), r.page_id
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()),
                                                            ("path", T.StringType()), ("content", T.LongType()), ("ratio", T.StringType()))])
    long = "<p>" + "A long story, told again. " * 40000 + "</p>"
    rows = [(1, None, None, "x", 1, "r"), (None, "u", "<p>No id, still read.</p>", None, None, None), (2, "u", "", "x", 1, "r"),
            (3, "u", long, "x", 1, "r"), (4, "u", "<p>Same, same.</p>", "x", 1, "r"), (4, "u", "<p>Same, same.</p>", "x", 1, "r"),
            (5, "u", "<" * 3000, "x", 1, "r"), (6, "u", "<div>" * 3000 + "Deep, deep.", "x", 1, "r")]
    out = html_text.extract(spark.createDataFrame(rows, schema).repartition(3)).collect()
    got = sorted(((r.page_id is None, r.page_id, r.text, r.n_chars) for r in out), key=str)
    want = [(1, ""), (None, "No id, still read."), (2, ""), (3, ("A long story, told again. " * 40000).strip()), (4, "Same, same."),
            (4, "Same, same."), (5, "<" * 3000), (6, "Deep, deep.")]
    assert got == sorted(((i is None, i, t, len(t)) for i, t in want), key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        html_text.extract(spark.createDataFrame([], schema).withColumnRenamed("path", "text"))


@pytest.mark.parametrize("part", ["<div>x, y. ", "<b>", "<p><b>a. ", "<table><tr><td>x", "<li><a href=x>", "<", "<a title=\"", "</div>", "<!-", "&amp", "<ul><li>"])
def test_long_odd_markup_takes_linear_time(part):
    import time

    took = []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        html_text.main_texts([part * n])
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0] + 1, took
