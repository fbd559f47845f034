"""Text analysis: tokens, segments, switch points, mixing index, matrix language, sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlex.functions.lang import SEGMENT, SENTENCE_ENDS, SPACE, LanguagePair, token_tag, token_tag_sql, tokens


def _count(col: Column | str, keep: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{keep}]", ""))


def analyze(df: DataFrame, pair: LanguagePair, text: str = "text", words: str | None = None) -> DataFrame:
    """``df`` plus the analysis of its text, in one projection (nothing is shuffled).

    toks, tags, segs (tags by segment), n_tokens, n1, n2, n_content, cmi,
    matrix, n_segs, n_switches, n_inter, n_intra, has_fixed, motives (one for
    each switch). Null text counts as empty. ``words`` names the column with
    the lexicon's words of each text (``lang.dealt``), where the lexicon is a table.
    """
    staged = df.withColumn("toks", tokens(F.col(text), pair)).withColumn("tags", F.array_join(F.transform("toks", lambda t: token_tag(t, pair, F.col(words) if words else None)), ""))
    staged = staged.withColumn("segs", F.regexp_extract_all("tags", F.lit(SEGMENT), F.lit(0)))
    staged = staged.withColumns({
        "n_tokens": F.size("toks"),
        "n1": _count("tags", "yz"),
        "n2": _count("tags", "a-h"),
        "n_segs": F.size(F.filter("segs", lambda s: s.rlike("[yza-h]"))),
        "low": F.lower(F.coalesce(F.col(text), F.lit(""))),
    }).withColumns({
        "n_content": F.col("n1") + F.col("n2"),
        "matrix": F.when(F.col("n1") >= F.col("n2"), pair.l1).otherwise(pair.l2),
        "n_switches": F.greatest(F.col("n_segs") - 1, F.lit(0)),
        "n_inter": F.size(F.filter("segs", lambda s: s.endswith("s"))) - F.when(F.element_at(F.col("segs"), F.size("segs")).endswith("s"), 1).otherwise(0),
        "has_fixed": reduce(lambda found, x: found | F.contains("low", F.lit(x)), pair.expressions, F.lit(False)),  # a regular expression of them takes five times as long
    })
    staged = staged.withColumn("n_inter", F.when(F.size("segs") > 0, F.col("n_inter")).otherwise(0))
    every = F.sequence(F.lit(1), F.size("segs") - 1)
    staged = staged.withColumns({
        "cmi": F.when(F.col("n_content") == 0, F.lit(0.0)).otherwise((F.col("n_content") - F.greatest("n1", "n2")) / F.col("n_content")),
        "n_intra": F.col("n_switches") - F.col("n_inter"),
        "motives": F.when((F.col("n_switches") > 0) & F.col("has_fixed"), F.transform(every, lambda i: _motive(i, True))).when(F.col("n_switches") > 0, F.transform(every, lambda i: _motive(i, False))).otherwise(F.array().cast("array<string>")),
    })
    return staged.drop("low")


def clear_mixing(analyzed: DataFrame, pair: LanguagePair) -> DataFrame:
    """``analyzed`` plus n_ambiguous (words of both the lexicon and common English) and cmi_clear, the index without them."""
    low = F.transform("toks", F.lower)
    found = F.size(F.filter(low, lambda t: t.isin(*pair.ambiguous))) if pair.ambiguous else F.lit(0)
    n1, n = F.col("n1") - F.col("n_ambiguous"), F.col("n_content") - F.col("n_ambiguous")
    clear = F.when(n == 0, F.lit(0.0)).otherwise((n - F.greatest(n1, F.col("n2"))) / n)
    return analyzed.withColumn("n_ambiguous", found).withColumn("cmi_clear", clear)


def clear_mixing_sql(source: str, pair: LanguagePair, name: str = "cm") -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in pair.ambiguous)
    return f"""{name}0 AS (SELECT *, len(list_filter(toks, lambda t: list_contains([{words}]::VARCHAR[], lower(t))))::INT AS n_ambiguous FROM {source}),
{name} AS (SELECT *, CASE WHEN n_content = n_ambiguous THEN 0.0::DOUBLE ELSE (n_content - n_ambiguous - greatest(n1 - n_ambiguous, n2))::DOUBLE / (n_content - n_ambiguous) END AS cmi_clear FROM {name}0)"""


def _motive(i: Column, has_fixed: bool) -> Column:
    """Why the switch into segment ``i`` (from 0) happens: the first rule that matches.

    ``has_fixed`` is a constant here: inside the lambda the search of the whole
    text would run once for each switch.
    """
    segs = F.col("segs")
    before = F.get(segs, i - 1)
    after = F.concat_ws("", F.get(segs, i), F.get(segs, i + 1), F.get(segs, i + 2))
    near = F.concat(F.right(before, F.lit(1)), F.substring(after, 1, 2))
    return (
        F.when(near.rlike("[ycd]"), "interjection")
        .when(near.rlike("[ef]"), "discourse_marker")
        .when(F.lit(has_fixed), "fixed_expression")
        .when(F.substring(after, 1, 3).rlike("[gh]"), "domain_term")
        .when(before.endswith("s"), "topic_shift")
        .otherwise("")
    )


def analysis_sql(source: str, pair: LanguagePair, name: str = "a") -> str:
    """DuckDB CTEs that end in ``name`` with the columns of ``analyze``."""
    fixed = " OR ".join("contains(lower(text), '" + x.replace("'", "''") + "')" for x in pair.expressions)
    return rf"""{name}0 AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{pair.token}') AS toks FROM {source}),
{name}1 AS (SELECT *, coalesce(array_to_string(list_transform(toks, lambda t: {token_tag_sql(pair)}), ''), '') AS tags FROM {name}0),
{name}2 AS (SELECT *, regexp_extract_all(tags, '{SEGMENT}') AS segs, len(toks)::INT AS n_tokens,
  length(regexp_replace(tags, '[^yz]', '', 'g'))::INT AS n1, length(regexp_replace(tags, '[^a-h]', '', 'g'))::INT AS n2, coalesce({fixed}, false) AS has_fixed FROM {name}1),
{name}3 AS (SELECT *, (n1 + n2)::INT AS n_content, CASE WHEN n1 >= n2 THEN '{pair.l1}' ELSE '{pair.l2}' END AS matrix,
  len(list_filter(segs, lambda s: regexp_matches(s, '[yza-h]')))::INT AS n_segs,
  len(list_filter(segs[1:len(segs)-1], lambda s: s LIKE '%s'))::INT AS n_inter FROM {name}2),
{name} AS (SELECT *, greatest(n_segs - 1, 0)::INT AS n_switches, (greatest(n_segs - 1, 0) - n_inter)::INT AS n_intra,
  CASE WHEN n_content = 0 THEN 0.0::DOUBLE ELSE (n_content - greatest(n1, n2))::DOUBLE / n_content END AS cmi,
  CASE WHEN n_segs > 1 THEN list_transform(range(2, len(segs) + 1), lambda i: CASE
    WHEN regexp_matches(right(segs[i-1], 1) || left(segs[i] || coalesce(segs[i+1], '') || coalesce(segs[i+2], ''), 2), '[ycd]') THEN 'interjection'
    WHEN regexp_matches(right(segs[i-1], 1) || left(segs[i] || coalesce(segs[i+1], '') || coalesce(segs[i+2], ''), 2), '[ef]') THEN 'discourse_marker'
    WHEN has_fixed THEN 'fixed_expression'
    WHEN regexp_matches(left(segs[i] || coalesce(segs[i+1], '') || coalesce(segs[i+2], ''), 3), '[gh]') THEN 'domain_term'
    WHEN segs[i-1] LIKE '%s' THEN 'topic_shift' ELSE '' END) ELSE [] END AS motives FROM {name}3)"""


def segments(analyzed: DataFrame, ids: list[str], pair: LanguagePair) -> DataFrame:
    """One row per segment: seg, lang, n_content, start, stop, text (tokens joined without spaces), last_mark."""
    # outer: from an inner explode Spark infers a filter and pushes the whole analysis, inlined, below it
    rows = analyzed.select(*ids, "toks", F.posexplode_outer("segs").alias("seg", "tags")).filter("tags is not null")
    order = Window.partitionBy(*[c for c in ids if c != "motives"]).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("tags")).over(order), F.lit(0)).cast("int")
    lang = F.when(F.col("tags").rlike("[yz]"), pair.l1).when(F.col("tags").rlike("[a-h]"), pair.l2).otherwise("other")
    rows = rows.withColumns({"start": start, "lang": lang, "n_content": _count("tags", "yza-h")})
    part = F.slice(F.col("toks"), F.col("start") + 1, F.length("tags"))
    content = F.filter(part, lambda t, i: F.substring(F.col("tags"), i + 1, F.lit(1)).rlike("[yza-h]"))
    return rows.select(
        *ids, "seg", "lang", "n_content", "start", (F.col("start") + F.length("tags") - 1).alias("stop"), F.array_join(part, "").alias("text"),
        F.col("tags").endswith("s").alias("ends_sentence"), content.alias("content"),
    )


def switch_points(analyzed: DataFrame, ids: list[str], pair: LanguagePair) -> DataFrame:
    """One row per switch: position, from_lang, to_lang, switch_type, context_before, context_after, motivation."""
    order = Window.partitionBy(*ids).orderBy("seg")
    segs = segments(analyzed, [*ids, "motives"], pair)
    n = F.size("before")
    rows = segs.withColumns({"before": F.lag("content").over(order), "from_lang": F.lag("lang").over(order), "closed": F.lag("ends_sentence").over(order)}).filter("from_lang is not null")
    return rows.select(
        *ids, "seg", F.col("start").alias("position"), "from_lang", F.col("lang").alias("to_lang"), F.when(F.col("closed"), "inter").otherwise("intra").alias("switch_type"),
        F.array_join(F.slice(F.col("before"), F.greatest(n - 2, F.lit(1)), F.lit(3)), " ").alias("context_before"), F.array_join(F.slice("content", 1, 3), " ").alias("context_after"),
        F.get("motives", F.col("seg") - 1).alias("motivation"),
    )


def segments_sql(ids: str, pair: LanguagePair, name: str = "a") -> str:
    """DuckDB CTE ``seg`` over the analysis ``name``."""
    return rf"""seg0 AS (SELECT {ids}, toks, unnest(segs) AS tags, unnest(range(0, len(segs)))::INT AS seg FROM {name}),
seg1 AS (SELECT *, coalesce(sum(length(tags)) OVER (PARTITION BY {ids} ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM seg0),
seg AS (SELECT {ids}, seg, CASE WHEN regexp_matches(tags, '[yz]') THEN '{pair.l1}' WHEN regexp_matches(tags, '[a-h]') THEN '{pair.l2}' ELSE 'other' END AS lang,
  length(regexp_replace(tags, '[nsp]', '', 'g'))::INT AS n_content, start, (start + length(tags) - 1)::INT AS stop,
  array_to_string(toks[start + 1 : start + length(tags)], '') AS text, tags LIKE '%s' AS ends_sentence,
  list_filter(toks[start + 1 : start + length(tags)], lambda t, i: regexp_matches(substr(tags, i, 1), '[yza-h]')) AS content FROM seg1)"""


def sentences(text: Column, endings: str = SENTENCE_ENDS) -> Column:
    """Sentences: cut behind each terminator, trimmed, empty ones dropped."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{endings}]*[{endings}]|[^{endings}]+"), F.lit(0))
    trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def sentences_sql(text: str, endings: str = SENTENCE_ENDS) -> str:
    trimmed = f"list_transform(regexp_extract_all(coalesce({text}, ''), '[^{endings}]*[{endings}]|[^{endings}]+'), lambda s: regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"
