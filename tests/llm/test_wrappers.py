"""Wrappers of hosts against pages whose article is known."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import wrappers
from tallyfold.llm.markup import parse
from tallyfold.llm.wrappers import align, decide, extract_main_text, is_noise, main_text, packed, page_wrapper, unpacked

WORDS = "river stone market letter garden window silver morning winter paper signal harbour engine bridge".split()


def said(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def blog(rng):
    """An article with headings, lists and quotes; around it all that is not main text."""
    blocks, body = [said(rng, 4)], []
    body.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randrange(1, 5)):
        for tag, inner in [("h2", None), ("p", None), ("p", None), ("ul", "li"), ("blockquote", "p")][: rng.randrange(2, 6)]:
            text = said(rng)
            blocks.append(text)
            body.append(f"<{tag}><{inner}>{text}</{inner}></{tag}>" if inner else f"<{tag}>{text}" + ("" if rng.random() < 0.3 and tag == "p" else f"</{tag}>"))
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, rng.randrange(2, 6)))
    notice = f'<div class="cookie-notice"><p>{said(rng)}</p></div>' if rng.random() < 0.5 else ""
    comments = "".join(f"<li><p>{said(rng)}</p></li>" for _ in range(rng.randrange(0, 4)))
    page = (
        f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style></head><body><header><p>{said(rng)}</p></header><nav><ul>{links}</ul></nav>{notice}"
        f'<div class="wrap"><article class="post">{"".join(body)}<div class="share-links">{said(rng, 3)}</div></article>'
        f'<aside><h3>Latest</h3><p>{said(rng)}</p></aside><section id="comments"><ol>{comments}</ol></section></div>'
        f'<form><label>Mail</label><input><textarea>x</textarea></form><footer>&copy; {said(rng)}</footer><script>var a="<p>no</p>"</script></body></html>'
    )
    return page, "\n".join(blocks)


def plain_site(rng):
    """No article element and no telling names: only the weight of text, and a line that all pages share."""
    blocks = [said(rng, 30) for _ in range(rng.randrange(2, 6))]
    links = "".join(f"<li><a href=x>{said(rng, 2)}</a></li>" for _ in range(5))
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<div><ul>{links}</ul></div><div id=x1><div><b>Printed by this site.</b></div>{body}</div><div><a href=y>Imprint</a></div>", "\n".join(blocks)


@pytest.fixture(scope="module")
def site():
    rng = random.Random(11)
    rows = [("http://Blog.example.org/a/%d" % i, *blog(rng)) for i in range(60)]
    rows += [("https://me@plain.example.org:80/%d" % i, *plain_site(rng)) for i in range(25)]
    return rows + [("https://lone.example.net", *blog(rng)), (None, *blog(rng)), ("no url", *blog(rng))]


def extracted(frame):
    return sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(frame).collect())


@pytest.mark.parametrize("deal", ["one", "many"])
def test_articles_are_found_and_nothing_around_them(spark, site, monkeypatch, deal):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0 if deal == "many" else 1 << 23)
    frame = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(site)], "page_id long, url string, html string")
    frame = frame.coalesce(1) if deal == "one" else frame.repartition(5)
    assert extracted(frame) == [(i, text, len(text)) for i, (_, _, text) in enumerate(site)]


def test_nulls_empty_pages_repeated_rows_and_other_columns(spark):
    page = "<article><p>Only words.</article>"
    rows = [(1, "http://a.b/", None), (2, "http://a.b/", ""), (None, None, page), (3, "http://a.b/", page), (3, "http://a.b/", page), (4, "http://c.d/", "<p> \n</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = frame.withColumns({c: F.lit("kept") for c in ("text", "n_chars", "host", "h", "c0", "wrapper", "part")})
    out = extract_main_text(clash)
    assert out.columns == ["page_id", "url", "host", "h", "c0", "wrapper", "part", "text", "n_chars"]
    got = sorted(((r["page_id"], r["text"], r["n_chars"], r["h"]) for r in out.collect()), key=repr)
    texts = {1: "", 2: "", 3: "Only words.", 4: "", None: "Only words."}
    assert got == sorted(((i, texts[i], len(texts[i]), "kept") for i, _, _ in rows), key=repr)
    assert extract_main_text(frame.where("false")).collect() == []


def test_very_long_and_very_deep_pages():
    long = "<article>" + "".join(f"<p>Paragraph {i}</p>" + "<hr>" * (i % 3) for i in range(30_000)) + "</article>"
    assert main_text(long, None) == "\n".join(f"Paragraph {i}" for i in range(30_000))
    deep = "<div>" * 5000 + "<p>Far down.</p>" + "</div>" * 5000 + "<footer>Foot</footer>"
    assert main_text(deep, None) == "Far down."
    odd = "<article>" + "".join(f"<{t}>{t} says</{t}>" for t in ("x-%d" % i for i in range(400))) + "</article>"
    assert main_text(odd, unpacked(packed(decide(page_wrapper(odd)[0]), True))) == "\n".join(f"x-{i} says" for i in range(400))


def shape(parts):
    flag = lambda p: ("?" if p.optional else "") + ("+" if p.repeated else "")
    return " ".join(("#" if p.literal is None else "=") + flag(p) if p.kind == "t" else f"{p.sign if p.kind == 'e' else ''}({shape(p.kids)}){flag(p)}" for p in parts)


def aligned(*pages):
    one = page_wrapper(pages[0])[0]
    for page in pages[1:]:
        one = align(one, page_wrapper(page)[0])
    return one


def test_mismatches_become_slots_optional_parts_and_repeated_groups():
    assert shape(aligned("<h1>A</h1><p>x</p>", "<h1>A</h1><p>y</p>")) == "h1(=) p(#)"
    assert shape(aligned("<h1>A</h1><p>x</p><p>y</p>", "<h1>A</h1><p>x</p>")) == "h1(=) p(#)+"
    assert shape(aligned("<h1>A</h1><hr><p>x</p>", "<h1>A</h1><ul><li>1<li>2</ul><p>x</p>")) == "h1(=) ul(li(#)+)? p(=)"
    pairs = "<dl><dt>a<dd>b<dt>c<dd>d</dl>"
    assert shape(aligned(pairs)) == "dl((dt(#) dd(#))+)"
    assert shape(aligned(pairs, "<dl><dt>e<dd>f</dl>")) == "dl((dt(#) dd(#))+)"
    assert shape(aligned("<dl><dt>e<dd>f</dl>", pairs)) == "dl((dt(#) dd(#))+)"
    assert shape(aligned("<h2>a</h2><p>b<p>c<h2>d</h2><p>e")) == "(h2(#) p(#)+)+"


def test_alignment_does_not_depend_on_order_of_pages_and_survives_packing():
    rng = random.Random(4)
    pages = [blog(rng)[0] for _ in range(12)]
    texts = []
    for order in (pages, pages[::-1], pages[6:] + pages[:6]):
        half = unpacked(packed(aligned(*order[:6])))
        plan = unpacked(packed(decide(align(half, unpacked(packed(aligned(*order[6:]))))), True))
        texts.append([main_text(p, plan) for p in pages])
    assert texts[0] == texts[1] == texts[2]


def test_template_texts_go_only_with_enough_distinct_pages():
    page = "<article><h1>T{0}</h1><div><b>Same line.</b></div><p>Text {0}</p></article>"
    plan = lambda n: decide(aligned(*[page.format(i) for i in range(n)]))
    assert main_text(page.format(1), plan(8)) == "T1\nText 1"
    assert main_text(page.format(1), plan(3)) == "T1\nSame line.\nText 1"
    assert main_text(page.format(1), decide(aligned(*[page.format(1)] * 9))) == "T1\nSame line.\nText 1"


def test_what_is_named_as_noise_stays_out_however_long_it_is():
    noise = ["div class=adBox", "section id='discussion-list'", "p class=site-notification", "div class='post-comments'", "div role=search", "div style='display: none'", "aside"]
    around = "".join(f"<{n}>{'noise text ' * 60}</{n.split()[0]}>" for n in noise)
    for page in (f"<div>{around}</div><div><p>Short but real.</p><p>And more of it.</p></div>", f"<article>{around}<p>Short but real.</p><p>And more of it.</p></article>"):
        assert main_text(page, None) == "Short but real.\nAnd more of it."


def test_tidy_tree_of_odd_markup():
    tree = lambda nodes: [n.text if hasattr(n, "text") else (n.signature, tree(n.kids)) for n in nodes]
    assert tree(parse("a &lt;b&gt; &#233;&nbsp; z<br>y < 3", is_noise)) == ["a <b> é z y < 3"]
    assert tree(parse("<div>a<span class='ad'>x<div>y</div></span>b<p>c<p>d</div>t", is_noise)) == [("div", ["ab", ("p", ["c"]), ("p", ["d"])]), "t"]
    assert tree(parse("<p>a<span class=ad>x</p><p>b", is_noise)) == [("p", ["a"]), ("p", ["b"])]
    assert tree(parse("<b>a<!-- <p> --><script>'</p>'</script>c</b></div><table><tr><td>1<td>2</table>", is_noise)) == ["ac", ("table", [("tr", [("td", ["1"]), ("td", ["2"])])])]
    assert tree(parse("<div title='a>b' CLASS=\"Post-12 x\">q</div><title>t", is_noise)) == [("div.post.x", ["q"])]
    assert tree(parse("x<!-- open", is_noise)) == ["x"]
