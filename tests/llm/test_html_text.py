import random
import time

import pytest

from larkspur.llm.html_text import declared_language, extract, main_text

LONG = "The men of the town were in the square and it was a day that all of them had been waiting for since the winter, with the sun on the roofs and the wind from the sea."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Be. Erin.</p></article><footer>x</footer>", f"Title {LONG} Be. Erin."),
        (f"<article><p>a&amp;b&nbsp;&lt;c \n\t d<b>e</b>f<br>g <p>{LONG}</article>", f"a&b <c d" + "ef g " + LONG),
        (f"<body><div class='ad'>Buy the best of it</div><article><p>{LONG}</p><div id=comments><p>{LONG} me too</p></div></article>", LONG),
        (f"<header><h1>Site</h1></header><main><article><header><h1>Own</h1></header><p>{LONG}</p></article></main><aside>{LONG}</aside>", f"Own {LONG}"),
        (f"<div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div>&copy; 2020 Us</div>", f"{LONG} Short one. {LONG}"),
        (f"<article><p>{LONG}<script>var t='</p><p>'</script><style>p{{}}</style><form><p>{LONG}</p></form><!-- <p>no</p> --></article>", LONG),
        (f"<nav><a href=x>x</a><article><p>{LONG}</p></article>", LONG),
        (f"<div class='cookie-notice'>{LONG}</div><div class='sidebarRight'>{LONG}</div><p>{LONG}</p>", LONG),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<p", ""),
        (f"<article><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>", f"Discussion {LONG}"),
        (f"<article><p>{LONG}</p><section class='discussion'><div class='user'>Al</div><p>{LONG}</p></section></article>", LONG),
        (f"<article><p class='notice-of-death'>{LONG}</p><p class='legal-notice'>{LONG}</p></article>", LONG),
        (f"<article><p data-id='promo' aria-label='a hidden nav'>{LONG}</p></article>", LONG),
        (f"<div class=top>{LONG} {LONG}</div><article class=card><a href=x>More</a> to read</article><div><p>{LONG}</p></div>", f"{LONG} {LONG} {LONG}"),
        (f"<article><p title=it's>{LONG}</p><p title='x'>It's {LONG}</p></article>", f"{LONG} It's {LONG}"),
        (f"<article><p title='never closed>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div class='share-buttons'>{LONG}</div><ul class='related posts'><li>{LONG}</ul></article>", LONG),
        (f"<!--><article><p>{LONG}</p><!-- -- > <p>no</p> --></article>", LONG),
        (f"<article><script>var a;</script foo><p>{LONG}</p></article>", LONG),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_query_rows(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", 7), (1, "u", f"<article>{LONG}</article>", 7), (2, None, None, 8), (None, "w", "<p>" * 3000 + "x" * 300_000, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got[0] == (1, "u", LONG, len(LONG), None) and got[0] == got[1] and (2, None, "", 0, None) in got and len(got) == 4
    assert extract(df.limit(0)).count() == 0


def labelled_pages(rng, n):
    """Pages of many layouts, and the text of each one's article."""
    vocab = "the of and to in a is that it for as was with be by on not this are house river market winter painted carried evening garden window letter stone quiet morning harbour".split()
    sentence = lambda k: " ".join(rng.choices(vocab, k=k)).capitalize() + "."
    para = lambda: " ".join(sentence(rng.randint(6, 16)) for _ in range(rng.randint(2, 6)))
    links = lambda k: "".join(f"<li><a href='/{i}'>{rng.choice(vocab)}</a></li>" for i in range(k))
    for _ in range(n):
        title, body = sentence(6)[:-1], []
        for _ in range(rng.randint(3, 9)):
            body.append(para() if rng.random() < 0.8 else sentence(rng.randint(2, 4)))
        body.append(para())
        own = "".join(f"<p>{x}</p>" for x in body)
        furniture = [f"<nav><ul>{links(6)}</ul></nav>", f"<header><h1>{sentence(2)}</h1><p>{sentence(5)}</p></header>", f"<div class='{rng.choice(['sidebar', 'side-bar widget', 'widgetArea'])}'><p>{para()}</p></div>", f"<div id='cookie-banner'>{para()}</div>", f"<div class='{rng.choice(['ad', 'advert-box', 'sponsored'])}'>{sentence(12)}</div>", f"<form><label>{sentence(3)}</label><input></form>", f"<aside><p>{para()}</p></aside>"]
        rng.shuffle(furniture)
        tail = [f"<footer>&copy; {sentence(4)}</footer>", f"<section id='comments'><div class='comment'><p>{para()}</p></div></section>", f"<div class='related-posts'><ul>{links(4)}</ul></div>", f"<script>var x = '<p>{sentence(3)}</p>';</script>"]
        k = rng.randint(0, 4)
        frame = rng.choice([("<article><h1>{t}</h1>", "</article>"), ("<main><article><header><h1>{t}</h1></header>", "</article></main>"), ("<div class='content'><h1>{t}</h1>", "</div>"), ("<main><h1>{t}</h1><section class='discussion'>", "</section></main>")])
        yield "<html><body>" + "".join(furniture[:k]) + frame[0].format(t=title) + own + frame[1] + "".join(tail[: rng.randint(1, 4)]) + "</body></html>", " ".join([title, *body])


def test_precision_and_recall_on_labelled_pages():
    hits = found = wanted = 0
    for html, want in labelled_pages(random.Random(11), 300):
        got, own = main_text(html).split(), want.split()
        left = list(own)
        for w in got:
            if w in left:
                left.remove(w)
                hits += 1
        found += len(got)
        wanted += len(own)
    assert hits / found > 0.98 and hits / wanted > 0.98


HOSTILE = ["<a " * 130_000 + '"', '<a x="' * 70_000, '<a x="b>' * 50_000 + "'", "<b>" * 130_000, "<p><b>" * 70_000, "<a><div>" * 50_000, "<script>" + "</script" * 50_000, "<!--" * 100_000, "<html " * 70_000, "<div><b><a>" * 30_000 + "</div>" * 30_000, "<p class" + " " * 400_000]


@pytest.mark.parametrize("k", range(len(HOSTILE)))
def test_time_grows_with_length_only(k):
    began = time.process_time()
    main_text(HOSTILE[k])
    declared_language(HOSTILE[k])
    assert time.process_time() - began < 5


def test_declared_language():
    assert declared_language("<!doctype html><HTML class=x lang='pt-BR'>") == "pt-BR" and declared_language("<html lang>") is None and declared_language("<htmlx lang=de>") is None and declared_language(None) is None
