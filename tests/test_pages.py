"""Page text and article bodies on hand-built pages."""

import html as standard

import pytest

from pitlens.sources import html

LONG = "Word " * 200


def texts(spark, pages, what=html.html_to_text):
    d = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id int, html string").repartition(2)
    return [r.t for r in d.select("id", what("html").alias("t")).orderBy("id").collect()]


@pytest.mark.parametrize("page,text", [
    ("<body><div hidden><div>x</div>secret</div>shown</body>", "shown"),
    ("<div style='color:red; display : none'><span>a</span><div><div>b</div></div></div><p>c", "c"),
    ("a<div class='hidden'>b</div><input type='hidden'>c<br hidden>d", "a\nb\nc\nd"),
    ("<p hidden>one<p>two<p hidden>three</p>four", "two\nfour"),
    ("<head><title>t</title><body>text", "text"),
    ("<div hidden>never closed <p>more", ""),
    ("<script>var t = '</p><div hidden>';</script>kept<style>p{}</style>", "kept"),
    ("1 < 2 and <b title='a>b'>bold</b> <!-- <p> --> end", "1 < 2 and\nbold\nend"),
    ("</div>stray<div hidden>x</div></div>after", "stray\nafter"),
    ("<ix:header><ix:hidden>1</ix:hidden></ix:header>2<template><div>3</div></template>", "2"),
    ("", ""), (None, None), ("  <p>\n</p>", "")])
def test_nested_and_hidden_elements(spark, page, text):
    assert texts(spark, [page]) == [text]


def test_character_references(spark):
    said = ["&#x27;", "&#128512;", "&#x1F600;", "&amp;lt;", "&#38;lt;", "&lt;b&gt;", "&hellip;&copy;&NotEqualTilde;", "&nosuch; &", "&#0;&#xD800;&#1114112;&#99999999999;", "&#146;&#x80;",
            "AT&ampT &copy 2020", "x&#65y&#x42z", "&#000065;", "a&b;c", "&frac12;&sup2;"]
    assert texts(spark, [f"<p>({s})</p>" for s in said]) == [f"({standard.unescape(s)})" for s in said]


def test_article_containers_and_noise(spark):
    body = "".join(f"<p>{LONG}{k}</p>" for k in range(2))
    said = f"{LONG.strip()} 0\n{LONG.strip()} 1"
    pages = [f"<div itemprop='articleBody'><div>{body}</div></div><article>{LONG} other</article>",
             f"<article>short</article><main><p>x</p><article>y</article></main><div class='x story-body'>{body}</div>tail",
             f"<article><div class='related-links'><div>promo</div>more</div>{body}<div id='advert-3'>buy</div><aside>z</aside></article>",
             f"<main><div><main>{body}</main></div></main>after", f"<div>{body}</div>", f"<article>{body.replace('Word', 'Subscribe to continue', 1)}</article>", "<p>short</p>", None,
             f"<article><nav>menu</nav>{body}"]
    got = texts(spark, pages, html.article_body)
    assert [r.outcome for r in got] == ["fetched"] * 5 + ["paywalled", "too_short", "too_short", "fetched"]
    assert [got[k].text for k in (0, 1, 2, 3, 8)] == [said] * 5
    assert got[4].text == said.replace("\n", "\n\n")
