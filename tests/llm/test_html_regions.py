"""Main text of pages with several, nested and unmarked articles; sums by tag path against brute force; deep nesting."""

import random
from html.parser import HTMLParser

import pytest

from braidlex.llm import html_extract

SENTENCE = "Some real sentence, with a comma and more words here."


def p(n, attributes=""):
    return f"<p{attributes}>" + " ".join([SENTENCE] * n) + "</p>"


@pytest.mark.parametrize("page,sentences,also,never", [
    (f"<main><article>{p(8)}</article><article>{p(6)}</article></main><footer>Imprint, {SENTENCE}</footer>", 14, [], ["Imprint"]),
    ("<div id='c'>" + "".join(f"<article><h2>T{i}</h2>{p(i + 1)}</article>" for i in range(3)) + "</div>", 6, ["T0", "T1", "T2"], []),
    (f"<article>{p(4)}<article>{p(2)}</article></article>", 6, [], []),
    (f"<article>{p(4)}<div class='comments'><article class='comment'>{p(1)}</article></div></article>", 4, [], []),
    (f"<article><h1>T</h1>{p(4)}{p(2, ' class=legal')}<div class='search-result'>{p(3)}</div></article>", 9, ["T"], []),
    (f"<article><h1>T</h1>{p(2)}</article><article><a href='/x'>Next one</a></article>", 2, ["T"], ["Next"]),
    (f"<div class='post comments-open'><h1>T</h1>{p(3)}</div><div class='comments'>{p(1)}</div>", 3, ["T"], []),
    (f"<form id='page'><h1>T</h1>{p(3)}<label>Mail</label></form>", 3, ["T"], ["Mail"]),
    (f"<article>{p(5)}<p class='notice'>Cookies, please.</p><aside>{p(2)}</aside><form>Write, now.</form></article>", 5, [], ["Cookies", "Write"]),
    (f"<main><h1>T</h1><article>{p(5)}</article><article>{p(5)}</article>{p(3)}</main>", 13, [], []),
    (p(2) + p(2), 4, [], []),
])
def test_regions(page, sentences, also, never):
    text = html_extract.extract(f"<html><body><nav><a>Home</a></nav>{page}</body></html>")
    assert text.count(SENTENCE) == sentences and all(x in text for x in also) and not any(x in text for x in never)


def test_two_equal_articles_are_both_kept():
    assert html_extract.extract(f"<article>{p(3)}</article><article>{p(3)}</article>").count(SENTENCE) == 6


@pytest.mark.parametrize("page", ["<div>" * 10_000 + p(1) + "</div>" * 10_000, "<span>" * 10_000 + ("<p>" + SENTENCE + "</b></i>") * 1000, "<article>" + p(1) * 20_000 + "</article>"])
def test_deep_and_long_pages(page):
    assert html_extract.extract(page).count(SENTENCE) == page.count(SENTENCE)


class Brute(HTMLParser):
    """Sums by the written-out tag path, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.path, self.sums = [], {}

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        self.path.append(tag + "".join(f".{found[k]}" for k in ("class", "id") if found.get(k)))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        n = len(data.strip())
        if n:
            s = self.sums.setdefault(tuple(self.path), [0, 0, 0, 0])
            s[0] += n
            s[1] += sum(data.count(c) for c in ".,;:!?")
            s[2] += n * ("a" in [x.split(".")[0] for x in self.path])
            s[3] += 1


def test_path_sums_are_those_of_brute_force():
    r = random.Random(6)

    def part(depth):
        if depth == 0 or r.random() < 0.3:
            return " ".join(r.choices(["word", "one,", "end.", "why?"], k=r.randrange(6)))
        tag = r.choice(["div", "section", "span", "a", "em", "div"])
        name = r.choice(["", " class='x'", " id='y'", " class='x z'"])
        return f"<{tag}{name}>" + "".join(part(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"

    for _ in range(200):
        page = part(5)
        brute = Brute()
        brute.feed(page)
        brute.close()
        parsed = html_extract.parse(page)
        above = {number: (path, name) for (path, name), number in parsed.paths.items()}

        def written(number):
            return () if number == 0 else (*written(above[number][0]), above[number][1])  # noqa: B023

        sums = {written(k): v for k, v in html_extract.path_sums(parsed, parsed.texts).items()}
        assert sums == brute.sums and list(sums) == list(brute.sums)
