"""Queries of the snippet providers' answers: bodies are made from the tables, parsed, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.operators import retrieval as R
from braidlex.sources import providers, responses

WS = r"[\x09-\x0D\x20]"
#: The order of the providers of a topic, and the one for topics that have none; other event types are in no chain.
CHAIN, FALLBACK = (("view", 0), ("purchase", 1), ("click", 2)), "signup"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, key: str, snippets: Column) -> DataFrame:
    """key, pos, title, content, url of each snippet."""
    found = df.select(key, snippets.alias("found")).select(key, F.posexplode_outer("found").alias("pos", "s"))
    return found.filter("s is not null").select(key, "pos", "s.title", "s.content", "s.url")


def _listed(df: DataFrame, key: str, order: str, item: Column) -> DataFrame:
    """key and its items as an array in order."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["item"]).alias("items"))


def hackernews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "comment").when(F.col("event_type") == "signup", "job").otherwise("story")
    item = F.struct(
        kind.alias("type"), F.concat(F.lit("Post "), "event_id").alias("title"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("http://h/"), "event_id")).alias("url"),
        F.when(F.pmod("event_id", F.lit(7)) != 0, F.floor("value")).alias("score"), F.col("user_id").alias("descendants"),
    )
    return _rows(_table(spark, sf_dir, "events").select("event_id", F.to_json(item).alias("body")), "event_id", responses.hackernews(F.col("body")))


def arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("item_id").cast("string")
    entry = F.concat(
        F.lit("<entry>\n<id>http://a/"), number, F.lit("</id>"), F.when(F.pmod("item_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("<title type='text'>Paper "), number, F.lit("\n on <i>x</i> </title>"))),
        F.lit("<summary>"), F.when(F.pmod("item_id", F.lit(4)) == 0, "").otherwise(F.coalesce("text", F.lit(""))), F.lit("</summary></entry>"),
    )
    feeds = _listed(_table(spark, sf_dir, "benchmark").withColumn("feed", F.pmod("item_id", F.lit(4))), "feed", "item_id", entry)
    return _rows(feeds.withColumn("body", F.concat(F.lit("<feed>"), F.array_join("items", "\n"), F.lit("</feed>"))), "feed", responses.arxiv(F.col("body")))


def wikipedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    page = F.struct(F.col("n_name").alias("title"), F.when(k % 3 == 1, F.concat(F.lit("About "), "n_name")).otherwise("").alias("extract"), F.struct(F.struct(F.concat(F.lit("http://w/"), k).alias("page")).alias("desktop")).alias("content_urls"))
    hits = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("Hit "), "n_name").alias("title"), F.lit("<b>Found</b> it ").alias("snippet")), F.struct(F.lit("second").alias("title"), F.lit("no").alias("snippet")))).otherwise(
        F.array().cast("array<struct<title:string,snippet:string>>")
    )
    found = F.to_json(F.struct(F.struct(hits.alias("search")).alias("query")))
    answers = _table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 3 == 0, 404).otherwise(200).alias("status"), F.to_json(page).alias("page"), found.alias("search"))
    return _rows(answers, "n_nationkey", responses.wikipedia(F.col("status"), F.col("page"), F.col("search")))


def newsapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    item = F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("News "), k)).alias("title"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("Short "), "c_name")).alias("description"),
        F.when(k % 7 != 0, F.concat(F.lit("Long "), k)).alias("content"), F.concat(F.lit("http://n/"), k).alias("url"),
    )
    bodies = _listed(_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", item).select("c_nationkey", F.to_json(F.struct(F.col("items").alias("articles"))).alias("body"))
    return _rows(bodies, "c_nationkey", responses.newsapi(F.col("body")))


def tmdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    item = F.struct(
        F.when(k % 2 == 1, F.concat(F.lit("Film "), k)).alias("title"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("Show "), k)).alias("name"), F.col("p_name").alias("overview"),
        F.col("p_type").alias("media_type"), (k % 100 / 10).alias("vote_average"),
    )
    bodies = _listed(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", item).select("p_brand", F.to_json(F.struct(F.col("items").alias("results"))).alias("body"))
    return _rows(bodies, "p_brand", responses.tmdb(F.col("body")))


def semantic_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    item = F.struct(F.when(k % 9 != 0, F.col("p_name")).alias("title"), F.repeat("p_type", 20).alias("abstract"), (F.lit(2000) + k % 20).cast("int").alias("year"), (k % 50).alias("citationCount"))
    bodies = _listed(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", item).select("p_brand", F.to_json(F.struct(F.col("items").alias("data"))).alias("body"))
    return _rows(bodies, "p_brand", responses.semantic_scholar(F.col("body")))


def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    item = F.concat(F.lit('<a class="result__a" href="x">Site <b>'), k, F.lit('</b></a>\n<div class="result__snippet">'), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("text of "), k)), F.lit("</div>"))
    pages = _listed(_table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", item).select("s_nationkey", F.array_join("items", "\n").alias("body"))
    return _rows(pages, "s_nationkey", responses.web_search(F.col("body")))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snippets: a topic is a user, a provider an event type."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), F.col("event_type").alias("provider"), F.col("event_id").alias("pos"), F.concat(F.lit(" Item "), (F.col("event_id") % 40).cast("string")).alias("title"))


def chain(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    every = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(n).alias("priority")) for p, n in CHAIN])
    topics = _table(spark, sf_dir, "events").filter("user_id % 5 <> 0").select(F.col("user_id").alias("topic")).distinct()
    return R.provider_chain(snippets(spark, sf_dir), limit, topics.select("topic", F.inline(every)), FALLBACK)


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of a registered provider on each nation, read on the workers."""
    providers.register_sources(spark, {"atlas": lambda topic, limit: [(f"{topic}/{i}", topic.lower() * i, "atlas") for i in range(limit)]})
    topics = ",".join(r.n_name for r in _table(spark, sf_dir, "nation").select("n_name").collect())  # 25 names
    return spark.read.format("snippets").option("provider", "atlas").option("topics", topics).option("limit", "4").load()


def queries() -> dict:
    return {
        "tr1_source": source_rows,
        "tr2_truncate": lambda s, d: _table(s, d, "documents").select("doc_id", R.truncate(F.col("text")).alias("snippet")),
        "tr3_strip_tags": lambda s, d: _table(s, d, "pages").select("page_id", F.md5(R.strip_tags(F.col("html"))).alias("text_md5")),
        "tr4_hackernews": hackernews, "tr5_arxiv": arxiv, "tr6_wikipedia": wikipedia, "tr7_newsapi": newsapi, "tr8_tmdb": tmdb, "tr9_semantic_scholar": semantic_scholar, "tr10_web_search": web_search,
        "tr10_query": lambda s, d: _table(s, d, "nation").select("n_nationkey", responses.search_query(F.lit("{topic} today"), F.col("n_name")).alias("query"), responses.arxiv_query(F.array("n_name", F.lit("x"))).alias("categories")),
        "tr12_provider_chain": lambda s, d: chain(s, d, 8).select("topic", "provider", "pos", "title", "rank"),
        "tr15_ttl_cache": lambda s, d: R.ttl_cache(_table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id", 86400).select("user_id", "event_type", "event_id", "hit"),
        "tr15_cached_value": lambda s, d: R.cached_values(
            _table(s, d, "events").withColumn("found", F.col("event_id") % 3 != 0), _table(s, d, "events").filter("event_id % 3 <> 0").select("event_id", "value", F.concat(F.lit("about "), "props").alias("content")),
            ["user_id", "event_type"], "ts", "event_id", 86400, "found",
        ).select("user_id", "event_type", "event_id", "hit", "answered_by", "value", F.md5("content").alias("content_md5")),
        "tr15_empty_results": lambda s, d: R.ttl_cache(_table(s, d, "events").withColumn("found", F.col("event_id") % 3 != 0), ["user_id", "event_type"], "ts", "event_id", 86400, "found").select("user_id", "event_type", "event_id", "hit"),
        "tr16_format": lambda s, d: R.format_snippets(chain(s, d, 3).select(F.col("topic").alias("k"), "rank", F.trim("title").alias("content"), F.col("provider").alias("source")), "k"),
        "tr16_format_zh": lambda s, d: R.format_snippets(chain(s, d, 3).select(F.col("topic").alias("k"), "rank", F.trim("title").alias("content"), F.when(F.col("rank") > 1, F.col("provider")).alias("source")), "k", R.FRAMES["zh"]),
    }


def oracle_sql() -> dict[str, str]:
    trim = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    short = lambda x: f"CASE WHEN length({x}) > 300 THEN left({x}, 297) || '...' ELSE {x} END"
    place = lambda key, order: f"(row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1)::INT AS pos"
    rules = ", ".join(f"('{p}', {n})" for p, n in CHAIN)
    on1 = f"""sn AS (SELECT user_id AS topic, event_type AS provider, event_id AS pos, ' Item ' || (event_id % 40) AS title FROM events),
kn AS (SELECT sn.*, priority FROM sn JOIN (VALUES {rules}) p(provider, priority) USING (provider) WHERE topic % 5 <> 0 UNION ALL SELECT sn.*, 0 FROM sn WHERE topic % 5 = 0 AND provider = '{FALLBACK}'),
cn AS (SELECT topic, provider, coalesce(sum(n) OVER (PARTITION BY topic ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM (SELECT topic, provider, priority, count(*) AS n FROM kn GROUP BY ALL)),
"""
    def chained(limit: int) -> str:
        return on1 + f"""on1 AS (SELECT kn.* FROM kn JOIN cn USING (topic, provider) WHERE earlier < {limit} QUALIFY row_number() OVER (PARTITION BY topic, lower(trim(title)) ORDER BY priority, pos) = 1),
ranked AS (SELECT topic, provider, pos, title, row_number() OVER (PARTITION BY topic ORDER BY priority, pos) AS rank FROM on1 QUALIFY rank <= {limit})"""

    def block(source: str, frame: tuple[str, str]) -> str:
        head, tail = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in frame)
        return f"""WITH {chained(3)} SELECT topic AS k, '{head}' || string_agg(rank || '. ' || trim(title) || CASE WHEN coalesce({source}, '') <> '' THEN chr(10) || '   (' || {source} || ')' ELSE '' END, chr(10) || chr(10) ORDER BY rank) || '{tail}' AS block
FROM ranked GROUP BY topic"""

    def cache(kept: str, source: bool = False) -> str:
        return f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, epoch_us(ts) AS t, {kept} AS found, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_type, event_id, n, CASE WHEN found THEN t END AS last, false AS hit, event_id AS answered_by, CASE WHEN found THEN event_id END AS source FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN coalesce(e.t - f.last < 86400000000, false) OR NOT e.found THEN f.last ELSE e.t END, coalesce(e.t - f.last < 86400000000, false),
    CASE WHEN coalesce(e.t - f.last < 86400000000, false) THEN f.source ELSE e.event_id END, CASE WHEN coalesce(e.t - f.last < 86400000000, false) OR NOT e.found THEN f.source ELSE e.event_id END
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1) {"SELECT f.user_id, f.event_type, f.event_id, hit, answered_by, r.value, md5('about ' || r.props) AS content_md5 FROM f LEFT JOIN (SELECT * FROM events WHERE event_id % 3 <> 0) r ON r.event_id = answered_by" if source else "SELECT user_id, event_type, event_id, hit FROM f"}"""

    paper = "'Paper ' || item_id || '  on x'"
    cleaned = trim("replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), chr(10), ' ')")
    papers = f"(SELECT *, {paper} AS title, CASE WHEN item_id % 4 = 0 THEN '' ELSE {cleaned} END AS summary FROM benchmark WHERE item_id % 3 <> 0)"
    news = "(SELECT *, 'News ' || c_custkey AS title, CASE WHEN c_custkey % 3 = 1 THEN 'Short ' || c_name WHEN c_custkey % 7 <> 0 THEN 'Long ' || c_custkey ELSE '' END AS body FROM customer WHERE c_custkey % 5 <> 0)"
    films = "(SELECT *, CASE WHEN p_partkey % 2 = 1 THEN 'Film ' || p_partkey WHEN p_partkey % 6 = 0 THEN '' ELSE 'Show ' || p_partkey END AS title FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 10))"
    film = "title || ' (' || p_type || ', ' || printf('%.1f', p_partkey % 100 / 10.0) || '/10). ' || p_name"
    study = "p_name || ' (' || (2000 + p_partkey % 20) || ', ' || (p_partkey % 50) || ' citations). ' || left(repeat(p_type, 20), 200)"
    return {
        "tr1_source": "SELECT n_name AS topic, i::INT AS pos, n_name || '/' || i AS title, repeat(lower(n_name), i) AS content, 'atlas' AS source, NULL::VARCHAR AS error FROM nation, range(0, 4) r(i)",
        "tr2_truncate": f"SELECT doc_id, {short('text')} AS snippet FROM documents",
        "tr3_strip_tags": f"SELECT page_id, md5({trim('''regexp_replace(html, '<[^>]+>', '', 'g')''')}) AS text_md5 FROM pages",
        "tr4_hackernews": "SELECT event_id, 0 AS pos, 'Post ' || event_id AS title, 'Post ' || event_id || ' (' || CASE WHEN event_id % 7 <> 0 THEN floor(value)::BIGINT ELSE 0 END || ' points, ' || user_id || ' comments)' AS content, "
        "CASE WHEN event_id % 3 = 0 THEN 'http://h/' || event_id ELSE '' END AS url FROM events WHERE event_type NOT IN ('error', 'signup')",
        "tr5_arxiv": f"SELECT item_id % 4 AS feed, {place('item_id % 4', 'item_id')}, title, {short('c')} AS content, 'http://a/' || item_id AS url FROM (SELECT *, title || CASE WHEN summary <> '' THEN '. ' || summary ELSE '' END AS c FROM {papers})",
        "tr6_wikipedia": "SELECT n_nationkey, 0 AS pos, CASE WHEN n_nationkey % 3 = 0 THEN 'Hit ' || n_name ELSE n_name END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'Found it' ELSE 'About ' || n_name END AS content, "
        "CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'http://w/' || n_nationkey END AS url FROM nation WHERE (n_nationkey % 3 = 0 AND n_nationkey % 2 = 0) OR n_nationkey % 3 = 1",
        "tr7_newsapi": f"SELECT c_nationkey, {place('c_nationkey', 'c_custkey')}, title, {short('c')} AS content, 'http://n/' || c_custkey AS url FROM (SELECT *, title || '. ' || body AS c FROM {news} WHERE body <> '')",
        "tr8_tmdb": f"SELECT p_brand, {place('p_brand', 'p_partkey')}, title, {short('c')} AS content, '' AS url FROM (SELECT *, {film} AS c FROM {films} WHERE title <> '')",
        "tr9_semantic_scholar": f"SELECT p_brand, {place('p_brand', 'p_partkey % 50 DESC, p_partkey')}, p_name AS title, {short('c')} AS content, '' AS url FROM (SELECT *, {study} AS c FROM part WHERE p_partkey % 9 <> 0)",
        "tr10_web_search": f"SELECT s_nationkey, {place('s_nationkey', 's_suppkey')}, 'Site ' || s_suppkey AS title, 'Site ' || s_suppkey || '. text of ' || s_suppkey AS content, '' AS url FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 10) WHERE s_suppkey % 4 <> 0",
        "tr10_query": "SELECT n_nationkey, n_name || ' today' AS query, 'cat:' || n_name || ' OR cat:x' AS categories FROM nation",
        "tr12_provider_chain": f"WITH {chained(8)} SELECT * FROM ranked",
        "tr15_ttl_cache": cache("true"),
        "tr15_empty_results": cache("event_id % 3 <> 0"),
        "tr15_cached_value": cache("event_id % 3 <> 0", source=True),
        "tr16_format": block("provider", R.FRAMES["en"]),
        "tr16_format_zh": block("CASE WHEN rank > 1 THEN provider END", R.FRAMES["zh"]),
    }
