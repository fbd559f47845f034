"""Names of parts inside content, quotes in tags, and whole results: generated pages by construction, the given pages by an independent reader."""

import os
import random
from html.parser import HTMLParser

import pytest

from braidlex.llm import html_extract

SENTENCE = "Some real sentence, with a comma and more words here."


def paragraphs(n, start=0):
    return "".join(f"<p>Paragraph {i} tells a story. {SENTENCE} {SENTENCE}</p>" for i in range(start, start + n))


def told(text):
    return [int(x.split()[0]) for x in text.split("Paragraph ")[1:]]


@pytest.mark.parametrize("page,want", [
    (f"<article><h1>T</h1>{paragraphs(1)}<section class='social-history'>{paragraphs(4, 1)}</section></article>", range(5)),
    (f"<article class='share-price-analysis'>{paragraphs(5)}</article>", range(5)),
    (f"<article><h1>T</h1>{paragraphs(2)}<div class='share-price-analysis'>{paragraphs(3, 2)}</div></article>", range(5)),
    (f"<article>{paragraphs(2)}<p class='reply-letter'>Paragraph 2 {SENTENCE}</p></article>", range(3)),
    (f"<div class='public-notice'><h2>N</h2>{paragraphs(6)}</div>", range(6)),
    (f"<div id='page-menu-wrapper'>{paragraphs(5)}</div>", range(5)),
    (f"<div class='menu'>{paragraphs(5)}</div>", range(5)),
    (f"<form action='x'><h2>F</h2>{paragraphs(5)}<input name=q><button>Go, now.</button></form>", range(5)),
    (f"<div class='lead'><p>Paragraph 0 opens it. {SENTENCE} {SENTENCE}</p></div><div class='body'>{paragraphs(20, 1)}</div>", range(21)),
    (f"<article><p title=Bob's>Paragraph 0 {SENTENCE}</p><p class=\"x>Paragraph 1 {SENTENCE}</p><p>Paragraph 2 {SENTENCE}</p></article>", [0, 1, 2]),
    (f"<article><p title=\"a > b\" data-x='c > d'>Paragraph 0 {SENTENCE}</p><p data-a = un'quo\"ted>Paragraph 1 {SENTENCE}</p></article>", [0, 1]),
    (f"<article>{paragraphs(4)}<div class='cookie-notice'>{paragraphs(1, 9)}</div><div class='comment-list'>{paragraphs(2, 7)}</div><div class='ad ad-300x250'>{paragraphs(1, 6)}</div></article>", range(4)),
    (f"<div class='site-footer'>{paragraphs(1, 9)}</div><div id='content'><h1>T</h1>{paragraphs(4)}</div><section id='readerComments'>{paragraphs(6, 10)}</section>", range(4)),
    (f"<article><h1>T</h1>{paragraphs(1)}</article><div class='comments'>{paragraphs(30, 10)}</div>", range(1)),
    (f"<div class='newsletter-signup'>{paragraphs(1, 9)}</div>{paragraphs(5)}<div class='related-links'>{paragraphs(1, 8)}</div>", range(5)),
])
def test_names_and_quotes(page, want):
    text = html_extract.extract(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>Imprint, 2020.</footer></body></html>")
    assert told(text) == list(want) and "<" not in text and "Imprint" not in text and "Go, now" not in text


def generated(r):
    """A page and its main text."""
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + ", " + word() + "."
    blocks, text = [], []
    title = sentence(5)
    blocks.append(f"<h1 class='headline'>{title}</h1>")
    text.append(title)
    for _ in range(r.randrange(2, 12)):
        plain = [sentence(r.randrange(8, 30)) for _ in range(r.randrange(1, 4))]
        shown = " ".join(plain)
        written = r.choice(["{}", "<b>{}</b>", "<span lang=de>{}</span>", "{}<br>"]).format(shown.replace(",", r.choice([",", "&#44;", "&#x2c;"])).replace(" ", r.choice([" ", "\n", "  \t"])))
        blocks.append(r.choice(["<p>{}</p>", "<p>{}", "<div class=text><p>{}</p></div>", "<blockquote>{}</blockquote>", "<p data-x=it's>{}</p>", "<section class='share-of-market'><p>{}</p></section>"]).format(written))
        text.append(shown)
    junk = [
        f"<div class='{r.choice(['ad', 'sponsored', 'promo-box', 'share-buttons', 'cookie-notice', 'newsletter'])}'><p>{sentence(12)}</p></div>", f"<aside><p>{sentence(20)}</p></aside>", f"<form><label>{sentence(3)}</label><input></form>",
        f"<script>var a = '<p>{sentence(9)}</p>';</script>", f"<style>p {{ x: '{word()}' }}</style>", f"<!-- {sentence(5)} -->",
    ]
    for part in r.sample(junk, r.randrange(len(junk))):
        blocks.insert(r.randrange(1, len(blocks) + 1), f"</p>{part}" if r.random() < 0.5 else part)
    body = "\n".join(blocks)
    whole = r.choice(["<article>{}</article>", "<main><article class=story>{}</article></main>", "<main>{}</main>"]).format(body)
    menu = "<nav><ul>" + "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(9)) + "</ul></nav>"
    comments = f"<section class='{r.choice(['comments', 'comment-list', 'reader-comments'])}'>" + "".join(f"<p>{sentence(15)}</p>" for _ in range(r.randrange(6))) + "</section>"
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body><header><a href=/>{word()}</a></header>{menu}{whole}{comments}<footer><p>{sentence(10)}</p></footer></body></html>", " ".join(text)


def test_generated_pages_come_back_whole(spark):
    r = random.Random(12)
    pages = [generated(r) for _ in range(200)]
    table = spark.createDataFrame([(i, "u", html) for i, (html, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {x.page_id: x for x in html_extract.extract_pages(table).collect()}
    wrong = [i for i, (_, text) in enumerate(pages) if got[i].text != text]
    assert not wrong, (pages[wrong[0]], got[wrong[0]].text)
    assert all(got[i].n_chars == len(text) for i, (_, text) in enumerate(pages))


class Reader(HTMLParser):
    """The text of article elements, by blocks: an independent reader for pages that mark their article."""

    BLOCKS = ("p", "h1", "h2", "h3", "br", "div", "li", "ul")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS or tag == "article":
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1] += data

    def text(self):
        return " ".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_given_pages_as_an_independent_reader_has_them(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("the shared tables are not here")
    table = spark.read.parquet(path)
    got = {(r.page_id, r.url): r.text for r in html_extract.extract_pages(table).collect()}
    for row in table.collect():
        reader = Reader()
        reader.feed(row.html or "")
        reader.close()
        assert got[row.page_id, row.url] == reader.text()
