import html
import random

from dailyfolio.llm import htmltext

P1 = "The first paragraph tells, at some length, what happened in the valley before the long winter came."
P2 = "The second one, shorter but still of some weight, goes on with the story and ends it."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- <p>hidden</p> -->
    <div class="ad">Buy now, buy cheap, buy here, and do not wait any longer for it.</div>
    <article><h1>Head &amp; line</h1><p>{P1}<p><b>{P2}<br>tail</b></p><p>End.</p>
    <form><input value="x"><p>Your name, please, and your address too.</p></form>
    <div class="related-links"><a href="/b">Another story of that kind, with a long name</a></div></article>
    <aside><p>Beside it, a text that is not part of the article, though it is long enough.</p></aside>
    <div id="comments"><p>I think, as a reader, that all of this, every bit of it, is wrong.</p></div>
    <div class="cookie-notice">We use cookies, as everyone does, so please agree.</div>
    <footer>&copy; nobody</footer></body></html>"""
    assert htmltext.main_text(page) == f"Head & line {P1} {P2} tail End."


def test_page_without_article_element():
    page = f"""<body><div id="menu"><a href="/">Home</a> <a href="/b">More</a></div>
    <div class="content with-sidebar"><h1>Title</h1><p>{P1}</p><p>{P2}</p><ul><li>one point of it</li></ul></div>
    <div class="sidebar"><p>{P2}</p></div><div class="footer"><p>All rights, and so on, are reserved by us.</p></div></body>"""
    assert htmltext.main_text(page) == f"Title {P1} {P2} one point of it"


def test_decoding_spaces_and_broken_markup():
    assert htmltext.main_text("<p>a&nbsp;b  \n c &lt;d&gt; &#233;&#x20AC; &amp</p>") == "a b c <d> é€ &"
    assert htmltext.main_text("<article><p>open <b>bold<p>next</article>") == "open bold next"
    assert htmltext.main_text("a < b and c > d") == "a < b and c > d"
    assert htmltext.main_text("<p>cut off <a href='x") in ("cut off", "cut off <a href='x")


def test_tags_of_any_length_and_odd_quotes_are_no_text():
    many = " ".join(f'data-{i}="v > {i}"' for i in range(1000))
    assert htmltext.main_text(f"<article><p {many}>{P1}</p></article>") == P1
    for tag in ("<p title=it's>", "<p title='it's here'>", '<p class="a" "b>', "<p a = x b= 'y>z' c>", '<p title="a>b">', "<p/ x=/>",
                "<p a='\"' b=\"'\">", "<p ==x>"):
        assert htmltext.main_text(f"<article>{tag}{P1}</p></article>") == P1, tag
    assert htmltext.main_text("<article><p>" + "<b x=" * 20_000 + P1 + "</article>").endswith(P1)


def test_words_of_articles_in_class_names_keep_their_text():
    for name in ("share-price", "notice-of-intent", "search-for-truth", "social-history"):
        assert htmltext.main_text(f'<article><p>{P1}</p><div class="{name}"><p>{P2}</p></div></article>') == f"{P1} {P2}", name
    for name in ("share", "share-buttons", "post-share", "cookie-notice", "notice_box", "search-form", "social links", "social-bar"):
        assert htmltext.main_text(f'<article><p>{P1}</p><div class="{name}"><p>{P2}</p></div></article>') == P1, name


def test_the_odd_table(odd, nothing):
    pages = odd.selectExpr("doc_id as page_id", "source as url", "text as html", "lang", "'x' as text")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == odd.count() and all(r["n_chars"] == len(r["text"]) and "<p>" not in r["text"] for r in rows)
    texts = {r["page_id"]: r["text"] for r in rows if r["page_id"] is not None}
    assert texts[0] == texts[1] == texts[12] == "" and texts[10] == "1" * 5000 and len(texts[8].split()) == 30_000
    assert htmltext.extract(nothing.selectExpr("doc_id as page_id", "source as url", "text as html")).count() == 0


def test_empty_and_textless_pages():
    for page in (None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->", "<nav><a>b</a></nav>"):
        assert htmltext.main_text(page) == ""


def test_deep_long_and_repeated_pages(spark):
    deep = "<div>" * 5000 + P1 + "</div>" * 5000
    long = "<article>" + f"<p>{P1}</p>" * 5000 + "</article>"
    rows = spark.createDataFrame([(1, "u", deep, "t"), (2, None, long, "t"), (2, None, long, "t"), (None, None, None, None)],
                                 "page_id bigint, url string, html string, text string")
    out = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(rows).collect()), key=str)
    whole = " ".join([P1] * 5000)
    assert out == sorted([(1, P1, len(P1)), (2, whole, len(whole)), (2, whole, len(whole)), (0, "", 0)], key=str)
    assert htmltext.extract(rows.limit(0)).count() == 0


def made_page(seed):
    """A page around known blocks: references, white space, inline tags and surroundings are drawn by the seed."""
    rng = random.Random(seed)
    letters = ["stone", "river", "grün", "été", "a<b", "Q&A", "“so”", "漢字", "x > y", "5 €", "it's"]

    def shown(word):
        out = "".join(rng.choice([html.escape(c), f"&#{ord(c)};", f"&#x{ord(c):X};"]) if c in "&<>€é" else c for c in word)
        return rng.choice([out, out, out, f"<b>{out}</b>", f'<a href="/w">{out}</a>', f"<span class='k'>{out}</span>"])

    blocks, inner = [], []
    for k in range(rng.randint(3, 9)):
        words = [rng.choice(letters) + "," * (rng.random() < 0.2) for _ in range(rng.randint(25, 60))]
        blocks.append(" ".join(words))
        tag = rng.choice(["p", "p", "p", "blockquote", "div"]) if k else "h1"
        inner.append(f"<{tag}>" + rng.choice([" ", "\n  ", "&nbsp;", ""]) + rng.choice([" ", "\n", "\t \n"]).join(map(shown, words)) + f"</{tag}>")
        inner.append(rng.choice(["", "", "<!-- <p>no text</p> -->", "<script>if (a < b) { t = '<p>x</p>' }</script>", "<style>p > a {}</style>",
                                 "<form><label>Your mail, please</label><input value='v'></form>"]))
    start, end = rng.choice([("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"),
                             ("<div class='page'><div class='content'>", "</div></div>"), ("<section><div id='article-body'>", "</div></section>")])
    links = "".join(f"<li><a href='/{i}'>Topic number {i}</a></li>" for i in range(rng.randint(3, 12)))
    before = rng.sample([f"<nav><ul>{links}</ul></nav>", "<header><h2>Our site, with a name</h2></header>", f"<div id='menu'><ul>{links}</ul></div>",
                         "<div class='cookie-notice'>We use cookies, as everyone does, so please agree to all of them.</div>"], rng.randint(1, 4))
    after = rng.sample([f"<aside><h3>More</h3><ul>{links}</ul></aside>", "<footer>All rights, and so on, reserved.</footer>",
                        "<div class='ad'>Buy now, buy cheap, buy here.</div>",
                        "<div id='comments'><p>I think, as a reader, that all of this, every bit, is wrong.</p></div>"], rng.randint(1, 4))
    return f"<html><head><title>T</title></head><body>{''.join(before)}{start}{''.join(inner)}{end}{''.join(after)}</body></html>", " ".join(blocks)


def test_known_articles_come_back_whole():
    for seed in range(150):
        page, text = made_page(seed)
        assert htmltext.main_text(page) == text, seed
