from tidebar.llm.html_text import extract, extract_text

P = "The river ran past the old mill, and the miller, who was tired, slept. It was late in the day."
Q = "Nobody knew what he had dreamt; still, the wheel turned, and the flour was ground by morning!"


def page(article, before="", after=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if(a<b){{"</p>"}}</script></head><body>{before}{article}{after}</body></html>'


NOISE = '<header><h2>Site name, with words.</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day, and more</a></li></ul></nav><div class="ad">Buy this, now, at once, before it is gone.</div>'
TAIL = '<aside><p>Read also, in this place, something else.</p></aside><div id="comments"><p>I think, as a reader, that this is wrong, wrong, wrong.</p></div><form><p>Sign up, please.</p><input><button>Go</button></form><footer>&copy; site, 2020.</footer>'


def test_article_amid_noise():
    body = f"<article><h1>The mill</h1><p>{P}</p><p>Short.</p><p>{Q} <a href='/x'>linked words</a> end.</p></article>"
    want = "\n".join(["The mill", P, "Short.", f"{Q} linked words end."])
    assert extract(page(body, NOISE, TAIL)) == want
    assert extract(page(body.replace("article", "main"), NOISE, TAIL)) == want


def test_without_article_element():
    body = f'<div class="wrap"><div class="content"><h1>The mill</h1><p>{P}</p><p>{Q}</p><p>Short.</p></div></div>'
    assert extract(page(body, NOISE, TAIL)) == "\n".join(["The mill", P, Q, "Short."])


def test_references_blanks_and_malformed_markup():
    body = f"<article><p>{P} &amp;&nbsp;&eacute;&#x1D11E;&#233;  a\n\tb<p><b>{Q}<br><p>c<i>d</i>e<div>f</div></article>"
    assert extract(page(body)) == "\n".join([f"{P} & é𝄞é a b", Q, "cde", "f"])
    assert extract(f"<article><p>{P}</p><p>cut off <b>he")== f"{P}\ncut off he"
    assert extract(f"<article><p>{P}</p><p>in a tag <a href='x").endswith("in a tag")
    assert extract(f"<article><p>{P}</p><script>var a = '<p>never closed") == P
    assert extract(f"<article><p>{P}</p><!-- not <p>shown</p> --><p>x &am") == f"{P}\nx &am"


def test_edges(spark):
    assert extract(None) == extract("") == extract("<html></html>") == ""
    assert extract("plain text, no tags.") == "plain text, no tags."
    assert extract("<p>" * 2000 + P) == P
    assert extract(f"<article>{'<div>' * 400}{P}{'</div>' * 400}</article>") == P
    rows = [(1, "u", page(f"<article><p>{P}</p></article>"), "k"), (1, "u", page(f"<article><p>{P}</p></article>"), "k"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0), (P, len(P)), (P, len(P))]
    assert extract_text(pages.limit(0)).collect() == []
