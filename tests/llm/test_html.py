import os
import random
import re
from html import unescape

import pytest

from kymo.llm import html_text as H

WORDS = "plain words that make up the running text of an article, one after another, "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    p = WORDS * 4
    got = H.main_text(page(f"""<header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><!-- c --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
      <article><h1>A &amp; B</h1><p>{p}<p>Short.</p><aside>See also</aside><form><label>Mail</label><input></form><script>track()</script><p>a&nbsp;b<br>c <b>d</b>e</p><noscript>n</noscript>
      <section id="comments"><p>{p}</p></section></article><div class="sidebar"><p>{p}</p></div><footer>&copy;</footer>"""))
    assert got == "\n\n".join(["A & B", " ".join(p.split()), "Short.", "a b c de"])


def test_region_without_article_element():
    p = WORDS * 5
    body = f"<div id=top>Menu <a>a</a> <a>b</a> <a>c</a></div><div id=content><h2>Head</h2><p>{p}</p><p>Tiny</p><p>{p}</p></div><div id=bottom><a>x</a> <a>y</a></div>"
    assert H.main_text(page(body)) == "\n\n".join(["Head", " ".join(p.split()), "Tiny", " ".join(p.split())])


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x</script>") == ""
    assert H.main_text("just text") == "just text"
    assert H.main_text("<p>a<p>b") == "a\n\nb"
    assert H.main_text("<article><p>1 < 2 &amp; 3 &#233; &bogus;</p>") == "1 < 2 & 3 é &bogus;"
    assert H.main_text("<article>" + "<p>x</p>" * 5000) == "\n\n".join(["x"] * 5000)
    assert H.main_text('<article><p hidden>no</p><p style="display: none">no</p><div class="article-header"><p>yes</p></div></article>') == "yes"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "t"), (3, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(((r.row.page_id, r.text) for r in H.extract(df).collect()), key=str)
    assert got == sorted([(1, ""), (1, ""), (None, "x"), (3, "")], key=str)
    assert H.extract(spark.createDataFrame([], df.schema)).collect() == []


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(H.smoothed(np.full(7, 3.0)), 3.0)
    assert 1 < H.threshold(np.array([1.0, 1.1, 0.9, 50.0, 60.0])) < 50


def text_of(*blocks):
    return "\n\n".join(" ".join(b.split()) for b in blocks)


def test_all_parts_of_an_article_without_article_element():
    long, short = WORDS * 20, WORDS * 2
    body = f"<div id=top><a>a</a> <a>b</a> <a>c</a></div><div id=post><h1>Head</h1><p>Intro.</p><section><p>{long}</p><p>{long}</p></section><section><p>{short}</p></section></div><div id=bottom><a>x</a> <a>y</a></div>"
    assert H.main_text(page(body)) == text_of("Head", "Intro.", long, long, short)


def test_one_very_long_paragraph_does_not_silence_the_others():
    p = WORDS * 3
    for part in ("<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>"):
        body = f"<div id=top><a>a</a> <a>b</a> <a>c</a></div><div id=post><h1>Head</h1><p>{p}</p>{part.format(WORDS * 400)}<p>{p}</p><p>Tiny</p></div>"
        assert H.main_text(page(body)) == text_of("Head", p, WORDS * 400, p, "Tiny")


def test_two_articles():
    a, b = WORDS * 20, WORDS * 5
    assert H.main_text(page(f"<nav>n</nav><main><article><h1>A</h1><p>{a}</p></article><article><h1>B</h1><p>{b}</p></article></main>")) == text_of("A", a, "B", b)


def test_names_that_articles_have_too():
    p = WORDS * 4
    for name in ("widget text", "related-work", "search-results", "commentary", "social"):
        assert H.main_text(page(f'<div class="{name}"><h2>Head</h2><p>{p}</p><p>{p}</p></div><div class="widget"><a>x</a> <a>y</a></div>')) == text_of("Head", p, p)


def test_the_threshold_decides(monkeypatch):
    """With the threshold switched off every line is high: suspect elements stay and the region is the body."""
    p = WORDS * 4
    pages = [
        page(f'<nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><article><h1>Head</h1><p>{p}</p></article><footer>&copy;</footer>'),
        page(f"<div id=top>Menu <a>a</a> <a>b</a></div><div id=content><h2>Head</h2><p>{p}</p></div><div id=bottom><a>x</a> <a>y</a></div>"),
        page(f'<article><h1>Head</h1><p>{p}</p><section id="comments"><p>{p}</p></section></article>'),
        page(f'<article><h1>Head</h1><p>{p}</p><div class="related"><a>x</a> <a>y</a></div></article>'),
    ]
    with_it = [H.main_text(x) for x in pages]
    assert with_it == [text_of("Head", p)] * 4
    monkeypatch.setattr(H, "threshold", lambda values: -1.0)
    assert all(H.main_text(x) != y and "Head" in H.main_text(x) for x, y in zip(pages, with_it))


def test_the_threshold_decides_on_the_table(spark, monkeypatch):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the tables")
    pages = [r.html for r in spark.read.parquet(path).select("html").collect()]
    with_it = [H.main_text(x) for x in pages]
    # an independent reading of these pages: what stands between the article's tags, cut at block tags
    for html, got in zip(pages, with_it):
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:b|i|a)\b[^>]*>", "", x))).split()) for x in re.split(r"</?(?:p|h\d|ul|li|div)\b[^>]*>", re.sub(r"<!--.*?-->", "", article, flags=re.S))]
        assert got == "\n\n".join(x for x in blocks if x)
    monkeypatch.setattr(H, "threshold", lambda values: -1.0)
    assert sum(H.main_text(x) != y for x, y in zip(pages, with_it)) == len(pages)


def test_random_articles_against_their_source():
    """Blocks written out with inline elements, references and white space come back as they were."""
    rng = random.Random(11)
    inline = ["<b>{}</b>", "<i class=x>{}</i>", "<span>{}</span>", "<a href='/'>{}</a>", "{}", "{}<!-- c -->", "<code>{}</code>"]
    spaces = [" ", "\n", "\t ", "&#32;", "<br>", "&nbsp;"]
    quote = lambda w: w.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;")
    for _ in range(200):
        blocks, body = [], []
        for _ in range(rng.randrange(1, 9)):
            words = [rng.choice(["word", "été", "a<b", "x&y", "12", "“so”", "long" * 9]) + rng.choice(["", ".", ","]) for _ in range(rng.randrange(3, 60))]
            blocks.append(" ".join(words))
            text = "".join(rng.choice(inline).format(quote(w)) + rng.choice(spaces) for w in words)
            body.append(rng.choice(["<p>{}", "<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<section><div>{}</div></section>", "<pre>{}</pre>"]).format(text))
        around = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<div class='post'><article>", "</article></div>")])
        html = page(f"<header>Site</header><nav><a href=/>Home</a></nav>{around[0]}{''.join(body)}{around[1]}<aside>{WORDS}</aside><footer>&copy; {WORDS}</footer>")
        assert H.main_text(html) == "\n\n".join(blocks)


def test_names_in_camel_case_and_names_that_only_begin_alike():
    p = WORDS * 4
    for name in ("relatedPosts", "mainNav", "related-posts", "shareBox"):
        assert H.main_text(page(f'<article><h2>Head</h2><p>{p}</p><div class="{name}"><a>x</a> <a>y</a></div></article>')) == text_of("Head", p)
    for name in ("commentary", "advertence", "navigator", "footers-of-mountains"):
        got = H.main_text(page(f'<article><h2>Head</h2><p>{p}</p><section class="{name}"><p>{p}</p></section></article>'))
        assert got == text_of("Head", p, p)


def test_unclosed_nested_and_very_long_pages():
    p = WORDS * 4
    assert H.main_text(page(f'<div class="sidebar"><ul><li><a>x</a></ul><article><h1>Head</h1><p>{p}</p></article>')) == text_of("Head", p)
    assert H.main_text(page(f"<form action=/><nav>n</nav><main><h1>Head</h1><p>{p}</p></main></form>")) == text_of("Head", p)
    assert H.main_text(page(f"<article><p>{p}</p></article><footer>left open {p}")) == text_of(p)
    assert H.main_text(page("<div>" * 3000 + f"<p>{p}</p>" + "</div>" * 3000)) == text_of(p)
    assert H.main_text(page("<aside>" * 500 + p + "</aside>" * 500 + f"<article><p>{p}</p></article>")) == text_of(p)
    long = [f"{WORDS * 3} {i}" for i in range(12_000)]  # 3 MB
    assert H.main_text(page("<nav>n</nav><article>" + "".join(f"<p>{x}" for x in long) + "</article>")) == text_of(*long)
