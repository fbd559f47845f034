"""What the snippet providers answer, parsed: raw response bodies to snippets, as expressions.

Each function takes the body of one response (a string column) and gives an
array of (title, content, url) in the response's order; contents are cut like
all snippets. Bodies that cannot be read, and entries without what the provider
needs, give nothing. Fetching is the business of ``providers``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidlex.operators.retrieval import strip_tags, truncate

#: Most results that are read of a list.
MOST = 10


def _snippet(title: Column, content: Column, url: Column | None = None) -> Column:
    return F.struct(title.alias("title"), truncate(content).alias("content"), (F.lit("") if url is None else F.coalesce(url, F.lit(""))).alias("url"))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _line(value: Column) -> Column:
    return F.replace(strip_tags(value), F.lit("\n"), F.lit(" "))


def hackernews(body: Column) -> Column:
    """One item; only stories count, and their text is made of title, points and number of comments."""
    item = F.from_json(body, "type string, title string, url string, score long, descendants long")
    content = F.concat(_text(item["title"]), F.lit(" ("), F.coalesce(item["score"], F.lit(0)), F.lit(" points, "), F.coalesce(item["descendants"], F.lit(0)), F.lit(" comments)"))
    return F.when(item["type"] == "story", F.array(_snippet(_text(item["title"]), content, item["url"]))).otherwise(F.array())


def arxiv(feed: Column) -> Column:
    """Entries of an Atom feed: title and, where there is one, summary; entries without a title are left out."""
    entries = F.regexp_extract_all(_text(feed), F.lit("(?s)<entry>(.*?)</entry>"), F.lit(1))
    titled = F.filter(entries, lambda e: e.rlike("(?s)<title[^>]*>.*?</title>"))

    def snippet(entry: Column) -> Column:
        title = _line(F.regexp_extract(entry, "(?s)<title[^>]*>(.*?)</title>", 1))
        summary = _line(F.regexp_extract(entry, "(?s)<summary[^>]*>(.*?)</summary>", 1))
        return _snippet(title, F.when(summary != "", F.concat(title, F.lit(". "), summary)).otherwise(title), F.trim(F.regexp_extract(entry, "<id>(.*?)</id>", 1)))

    return F.transform(titled, snippet)


def arxiv_query(categories: Column) -> Column:
    return F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR ")


def wikipedia(status: Column, summary: Column, search: Column) -> Column:
    """The page's summary; where the page does not exist (404), the first hit of a search."""
    page = F.from_json(summary, "title string, extract string, content_urls struct<desktop:struct<page:string>>")
    hit = F.get(F.from_json(search, "query struct<search:array<struct<title:string,snippet:string>>>")["query"]["search"], F.lit(0))
    found = F.when(hit.isNotNull(), F.array(_snippet(_text(hit["title"]), strip_tags(_text(hit["snippet"]))))).otherwise(F.array())
    read = F.when(_text(page["extract"]) != "", F.array(_snippet(_text(page["title"]), page["extract"], page["content_urls"]["desktop"]["page"]))).otherwise(F.array())
    return F.when(status == 404, found).otherwise(read)


def newsapi(body: Column) -> Column:
    """Articles with a title and a body: the description or, without one, the content."""
    articles = F.from_json(body, "articles array<struct<title:string,description:string,content:string,url:string>>")["articles"]

    def text(a: Column) -> Column:
        return F.when(_text(a["description"]) != "", a["description"]).otherwise(_text(a["content"]))

    whole = F.filter(articles, lambda a: (_text(a["title"]) != "") & (text(a) != ""))
    return F.coalesce(F.transform(whole, lambda a: _snippet(a["title"], F.concat(a["title"], F.lit(". "), text(a)), a["url"])), F.array())


def tmdb(body: Column) -> Column:
    """Of the first results those with a title or a name: kind, vote and overview."""
    results = F.slice(F.from_json(body, "results array<struct<title:string,name:string,overview:string,media_type:string,vote_average:double>>")["results"], 1, MOST)

    def title(r: Column) -> Column:
        return F.when(_text(r["title"]) != "", r["title"]).otherwise(_text(r["name"]))

    def content(r: Column) -> Column:
        return F.concat(title(r), F.lit(" ("), _text(r["media_type"]), F.lit(", "), F.format_number(F.coalesce(r["vote_average"], F.lit(0.0)), 1), F.lit("/10). "), _text(r["overview"]))

    return F.coalesce(F.transform(F.filter(results, lambda r: title(r) != ""), lambda r: _snippet(title(r), content(r))), F.array())


def semantic_scholar(body: Column) -> Column:
    """Papers by citations, most first (in the given order on ties): year, citations, and 200 characters of the abstract."""
    papers = F.from_json(body, "data array<struct<title:string,abstract:string,year:int,citationCount:long>>")["data"]
    ranked = F.array_sort(F.transform(papers, lambda p, i: F.struct((-F.coalesce(p["citationCount"], F.lit(0))).alias("rank"), i.alias("pos"), p.alias("paper"))))

    def snippet(p: Column) -> Column:
        year = F.coalesce(p["year"].cast("string"), F.lit(""))
        return _snippet(p["title"], F.concat(p["title"], F.lit(" ("), year, F.lit(", "), F.coalesce(p["citationCount"], F.lit(0)), F.lit(" citations). "), F.substring(_text(p["abstract"]), 1, 200)))

    return F.coalesce(F.transform(F.filter(F.transform(ranked, lambda r: r["paper"]), lambda p: _text(p["title"]) != ""), snippet), F.array())


def search_query(template: Column, topic: Column) -> Column:
    return F.replace(template, F.lit("{topic}"), topic)


def web_search(page: Column) -> Column:
    """Of the first results of a result page those with a title and a snippet."""
    # Fixed value: the marks of a result in the page.
    result = r'(?s)class="result__a"[^>]*>(.*?)</a>.*?class="result__snippet">(.*?)</div>'
    titles, texts = (F.slice(F.regexp_extract_all(_text(page), F.lit(result), F.lit(k)), 1, MOST) for k in (1, 2))
    both = F.zip_with(titles, texts, lambda t, s: F.struct(strip_tags(t).alias("title"), strip_tags(s).alias("text")))
    return F.transform(F.filter(both, lambda b: (b["title"] != "") & (b["text"] != "")), lambda b: _snippet(b["title"], F.concat(b["title"], F.lit(". "), b["text"])))
