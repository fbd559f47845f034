"""The six quality scores, veto, weights and verdict.

Scores are SQL expressions over the columns of ``analysis.analyze`` and a few
counts, the same text in Spark and in the DuckDB twin; number literals with a
point become doubles in both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlex.functions.lang import SPACE
from braidlex.operators import rules
from braidlex.plans.ranks import in_ranges, joined_to, place_in_order, with_first
from braidlex.plans.tables import cut

# Garbage patterns, reasoning markers, natural endings, region and register markers.
GARBAGE = r"<[a-zA-Z/][^>]*>|&[a-z]+;|\\x[0-9a-fA-F]{2}|[\x00-\x08\x0b\x0c\x0e-\x1f]"
GARBAGE_MARK = r"[<&\\\x00-\x08\x0b\x0c\x0e-\x1f]"  # a character with which one of them begins
REASONING = ("**Analyze", "**Role:**", "**Task:**", "**Constraint", "**Drafting", "Thinking Process")
NATURAL_END = r"[。！？.!?~…了的呢吧啊吗\p{L}]$"
ADJACENT = r"[\x{4E00}-\x{9FFF}][a-zA-Z]|[a-zA-Z][\x{4E00}-\x{9FFF}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
#: The characters of ``SPACE``, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
REGION_MARKERS = {
    "singapore": ("lah", "lor", "leh", "sia", "hor", "meh", "ar"),
    "malaysia": ("lah", "lor", "ma", "bah"),
    "hongkong": ("啦", "嘅", "嗰", "喺", "咩", "嘢"),
}
INFORMAL = ("666", "yyds", "绝绝子", "awsl", "xswl", "srds", "tmd", "草", "卧槽", "靠")
FORMAL_ONLY = ("wtf", "lmao", "lol", "bruh", "ngl", "omg")
ARCHETYPE_CMI = {"ARC_01": (0.05, 0.25), "ARC_02": (0.25, 0.45), "ARC_03": (0.45, 0.70), "ARC_04": (0.15, 0.40), "ARC_05": (0.01, 0.10), "ARC_06": (0.10, 0.50)}
WEIGHTS = {"fluency": 0.20, "naturalness": 0.25, "switch_motivation": 0.20, "profile_consistency": 0.15, "cultural_coherence": 0.10, "diversity": 0.10}


def doubles(sql: str) -> str:
    """Number literals with a point as doubles, and counts as divisors that give null for zero, in both dialects."""
    sql = re.sub(r"/ (n2|n_segs|n_content|l2_segs|n_switches|before_all)\b", r"/ nullif(\1, 0)", sql)
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"CAST(\1 AS DOUBLE)", sql)


def _round2(sql: str) -> str:
    """Two digits, halves up, with room for the binary error of a sum: engines differ in how they round such halves."""
    return f"CAST(floor(({sql}) * 100 + 0.500001) AS DOUBLE) / 100"


def _weighted(parts: dict[str, float]) -> str:
    return _round2(f"greatest(0.0, least(10.0, {' + '.join(f'{c} * {w}' for c, w in parts.items())}))")


def steps_of(given: rules.Rules) -> list[dict[str, str]]:
    """Steps of expressions; each may use the columns of the ones before."""
    return [
        {
            "guard": "CASE WHEN n1 = 0 OR n2 = 0 THEN 'one language' WHEN n_content < 5 THEN 'too few tokens' WHEN n_content > 500 THEN 'too many tokens' "
            "WHEN is_garbage THEN 'garbage' WHEN is_reasoning THEN 'reasoning' ELSE '' END",
            "l1_quality": "CASE WHEN l1_segs > 0 AND l1_single * 2 > l1_segs THEN 8.0 ELSE 10.0 END",
            "l2_quality": "CASE WHEN n2 > 0 AND CAST(n_unknown AS DOUBLE) / n2 > 0.7 THEN 7.0 WHEN n2 > 0 AND CAST(n_unknown AS DOUBLE) / n2 > 0.5 THEN 8.5 ELSE 10.0 END",
            "completeness": "10.0 - CASE WHEN unbalanced THEN 0.5 ELSE 0.0 END - CASE WHEN cut_off THEN 2.0 ELSE 0.0 END",
            "switch_frequency": "10.0 - CASE WHEN n_content = 0 THEN 0.0 WHEN CAST(n_content AS DOUBLE) / n_segs < 1.5 THEN 4.0 WHEN CAST(n_content AS DOUBLE) / n_segs < 2.5 THEN 2.0 ELSE 0.0 END "
            "- CASE WHEN n_content = 0 THEN 0.0 WHEN cmi < 0.02 THEN 4.0 WHEN cmi < 0.05 AND n_switches <= 1 THEN 2.0 ELSE 0.0 END",
            "l2_integrity": "CASE WHEN l2_segs > 2 AND CAST(l2_single AS DOUBLE) / l2_segs > 0.8 THEN 8.0 ELSE 10.0 END",
            "language_mode": "CASE WHEN n_content > 0 AND CAST(greatest(n1, n2) AS DOUBLE) / n_content < 0.55 THEN 8.5 ELSE 10.0 END",
            "switch_syntax": "CASE WHEN n_adjacent > 3 THEN 7.0 ELSE 10.0 - 0.5 * n_adjacent END",
            "attribution": "CASE WHEN n_switches > 0 THEN CAST(n_attributed AS DOUBLE) / n_switches ELSE 0.0 END",
            "cmi_range": "CASE WHEN cmi_lo IS NULL OR (cmi >= cmi_lo AND cmi <= cmi_hi) THEN 10.0 ELSE "
            "CASE WHEN (CASE WHEN cmi < cmi_lo THEN cmi_lo - cmi ELSE cmi - cmi_hi END) <= 0.05 THEN 8.0 WHEN (CASE WHEN cmi < cmi_lo THEN cmi_lo - cmi ELSE cmi - cmi_hi END) <= 0.10 THEN 6.0 ELSE 3.0 END END",
            "switch_type": rules.part_score(given, "switch_type"),
            "l2_span": rules.part_score(given, "l2_span"),
            "domain_words": "CASE WHEN n_domain IS NULL OR n_domain >= 2 THEN 10.0 WHEN n_domain = 1 THEN 7.0 ELSE 4.0 END",
            "formality_score": "10.0 - CASE WHEN formality = 'formal' THEN least(4.0, (n_informal + n_formal_only) * 1.5) WHEN formality = 'semi_formal' THEN least(3.0, n_informal * 1.0) ELSE 0.0 END",
            "regional": "CASE WHEN region = '' THEN 10.0 ELSE greatest(0.0, 10.0 - " + " - ".join(f"CASE WHEN region = '{r}' THEN 0.0 ELSE least(3.0, n_{r} * 1.5) END" for r in REGION_MARKERS) + ") END",
            "sensitivity": "10.0",
        },
        {
            "fluency": f"CASE guard WHEN 'one language' THEN 1.0 WHEN '' THEN {_weighted({'l1_quality': 0.4, 'l2_quality': 0.4, 'completeness': 0.2})} ELSE 0.0 END",
            "naturalness": _weighted({"switch_frequency": "0.30", "l2_integrity": "0.25", "language_mode": "0.25", "switch_syntax": "0.20"}),
            "switch_motivation": "CASE WHEN n_switches = 0 THEN 8.0 ELSE " + _round2("least(10.0, CASE WHEN attribution >= 0.60 THEN 9.0 + attribution WHEN attribution >= 0.40 THEN 7.0 + (attribution - 0.40) * 10 "
            "WHEN attribution >= 0.20 THEN 5.0 + (attribution - 0.20) * 10 ELSE 4.0 + attribution * 5 END)") + " END",
            "profile_consistency": _weighted({"cmi_range": "0.35", "switch_type": "0.30", "l2_span": "0.20", "domain_words": "0.15"}),
            "cultural_coherence": _weighted({"formality_score": "0.50", "regional": "0.30", "sensitivity": "0.20"}),
        },
    ]


STEPS = steps_of(rules.DEFAULT)
VERDICT: list[dict[str, str]] = [
    {
        "veto": "CASE WHEN guard NOT IN ('', 'one language') THEN 'fluency: ' || guard WHEN fluency < 2.0 THEN 'fluency' WHEN naturalness < 2.0 THEN 'naturalness' "
        "WHEN switch_motivation < 2.0 THEN 'switch_motivation' WHEN profile_consistency < 2.0 THEN 'profile_consistency' WHEN cultural_coherence < 2.0 THEN 'cultural_coherence' "
        "WHEN is_copy THEN 'diversity: copy' WHEN diversity < 2.0 THEN 'diversity' ELSE '' END",
    },
    {"final_score": "CASE WHEN veto <> '' THEN 0.0 ELSE " + _round2(" + ".join(f"{k} * {w:.2f}" for k, w in WEIGHTS.items())) + " END"},
    {"decision": "CASE WHEN veto <> '' THEN 'fail' WHEN final_score >= 6.0 THEN 'pass' WHEN final_score >= 5.0 THEN 'review' ELSE 'fail' END"},
]


def apply_steps(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: F.expr(doubles(v)) for k, v in step.items()})
    return df


def steps_sql(source: str, steps: list[dict[str, str]], name: str) -> str:
    ctes = []
    for i, step in enumerate(steps):
        out = name if i == len(steps) - 1 else f"{name}_{i}"
        ctes.append(f"{out} AS (SELECT *, " + ", ".join(f"{doubles(v)} AS {k}" for k, v in step.items()) + f" FROM {source})")
        source = out
    return ",\n".join(ctes)


def measured(analyzed: DataFrame) -> DataFrame:
    """The counts that the scores need besides the analysis."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.col("__low")

    def segs(pattern: str):
        return F.size(F.filter("segs", lambda s: s.rlike(pattern)))

    def times(mark: str):
        return F.when(F.contains(text, F.lit(mark)), F.regexp_count(text, F.lit(mark))).otherwise(0)

    def uneven(a: str, b: str):
        return times(a) != times(b)

    def present(words: tuple[str, ...]):
        return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))

    # each search of the whole text that needs more than one look at a character runs behind a cheap one
    every_marker = F.array(*[F.lit(w) for w in dict.fromkeys(w for words in REGION_MARKERS.values() for w in words)])
    staged = analyzed.withColumns({"__low": F.lower(text), "__last": F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1)), "__markers": F.array_intersect(F.transform("toks", F.lower), every_marker)})
    return staged.withColumns({
        "l1_segs": segs("[yz]"), "l1_single": segs("^[nsp]*[yz][nsp]*$"), "l2_segs": segs("[a-h]"), "l2_single": segs("^[nsp]*[a-h][nsp]*$"),
        "l2_longest": F.coalesce(F.array_max(F.transform("segs", lambda s: F.length(F.regexp_replace(s, "[^a-h]", "")))), F.lit(0)),
        "n_unknown": F.length(F.regexp_replace("tags", "[^bdfh]", "")),
        "is_garbage": text.rlike(GARBAGE_MARK) & text.rlike(GARBAGE), "is_reasoning": sum((F.contains(text, F.lit(m)).cast("int") for m in REASONING), F.lit(0)) > 0,
        "unbalanced": uneven("（", "）") | uneven("「", "」") | uneven("【", "】"),
        "cut_off": (F.col("__last") != "") & ~F.col("__last").rlike(NATURAL_END),
        "n_adjacent": F.when(text.rlike(HAN), F.regexp_count(text, F.lit(ADJACENT))).otherwise(0),
        "n_attributed": F.size(F.filter("motives", lambda m: m != "")),
        "n_informal": present(INFORMAL), "n_formal_only": present(FORMAL_ONLY),
        **{f"n_{r}": F.size(F.array_intersect("__markers", F.array(*map(F.lit, words)))) for r, words in REGION_MARKERS.items()},
        "n_domain": F.when(F.size("wanted") > 0, F.size(F.filter("wanted", lambda w: F.contains(low, F.lower(w))))),
    }).drop("__low", "__last", "__markers")


def measured_sql(source: str, name: str = "m") -> str:
    seg = lambda p: f"len(list_filter(segs, lambda s: regexp_matches(s, '{p}')))::INT"
    text = "coalesce(text, '')"
    any_of = lambda words, t: " + ".join(f"contains({t}, '{w}')::INT" for w in words)
    uneven = " OR ".join(f"len(regexp_extract_all({text}, '{a}')) <> len(regexp_extract_all({text}, '{b}'))" for a, b in ("（）", "「」", "【】"))
    trimmed = f"regexp_replace({text}, '[{SPACE}]+$', '')"
    regions = ", ".join(
        "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: list_contains(list_transform(toks, lambda t: lower(t)), w)))::INT AS n_{r}" for r, words in REGION_MARKERS.items()
    )
    return f"""{name} AS (SELECT *, {seg('[yz]')} AS l1_segs, {seg('^[nsp]*[yz][nsp]*$')} AS l1_single, {seg('[a-h]')} AS l2_segs, {seg('^[nsp]*[a-h][nsp]*$')} AS l2_single,
  coalesce(list_max(list_transform(segs, lambda s: length(regexp_replace(s, '[^a-h]', '', 'g')))), 0)::INT AS l2_longest, length(regexp_replace(tags, '[^bdfh]', '', 'g'))::INT AS n_unknown,
  regexp_matches({text}, '{GARBAGE}') AS is_garbage, ({any_of(REASONING, text)}) > 0 AS is_reasoning, ({uneven}) AS unbalanced,
  {trimmed} <> '' AND NOT regexp_matches({trimmed}, '{NATURAL_END}') AS cut_off, len(regexp_extract_all({text}, '{ADJACENT}'))::INT AS n_adjacent,
  len(list_filter(motives, lambda x: x <> ''))::INT AS n_attributed, ({any_of(INFORMAL, f'lower({text})')})::INT AS n_informal, ({any_of(FORMAL_ONLY, f'lower({text})')})::INT AS n_formal_only,
  {regions}, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda w: contains(lower({text}), lower(w))))::INT END AS n_domain FROM {source})"""


def located(scored: DataFrame) -> DataFrame:
    """The tokens at which rules of ``rules.all_rules`` show first (from 0; null where they do not)."""

    def start_of(k: Column) -> Column:
        return F.when(k > 0, F.aggregate(F.slice("segs", F.lit(1), (k - 1).cast("int")), F.lit(0), lambda n, s: n + F.length(s)))

    def first_segment(found) -> Column:
        return start_of(F.array_position(F.transform("segs", found), True))

    def first_token(words: tuple[str, ...]) -> Column:
        at = F.array_position(F.transform("toks", lambda t: F.lower(t).isin(*words)), True)
        return F.when(at > 0, (at - 1).cast("int"))

    def where_any(n: str, found: Column) -> Column:
        """``found`` where the count ``n`` says that there is one: the search lowers every token."""
        return F.when(F.col(n) > 0, found)

    run = lambda s: F.length(F.regexp_replace(s, "[^a-h]", ""))
    return scored.withColumns({
        "at_l1_single": where_any("l1_single", first_segment(lambda s: s.rlike("^[nsp]*[yz][nsp]*$"))), "at_l2_single": where_any("l2_single", first_segment(lambda s: s.rlike("^[nsp]*[a-h][nsp]*$"))),
        "at_longest": F.when(F.col("l2_longest") > 0, first_segment(lambda s: run(s) == F.col("l2_longest"))),
        "at_unknown": F.when(F.col("n_unknown") > 0, F.length(F.regexp_extract("tags", "^[^bdfh]*", 0))),
        "at_switch": F.when(F.col("n_switches") > 0, F.length(F.get("segs", F.lit(0)))),
        "at_unmotivated": F.when(F.array_position("motives", "") > 0, start_of(F.array_position("motives", "") + 1)),
        **{f"at_{r}": where_any(f"n_{r}", first_token(words)) for r, words in REGION_MARKERS.items()},
    })


def located_sql(source: str, name: str = "lo") -> str:
    start = lambda k: f"CASE WHEN coalesce({k}, 0) > 0 THEN coalesce(list_sum(list_transform(segs[1:{k} - 1], lambda s: length(s))), 0)::INT END"
    where = lambda p: f"list_position(list_transform(segs, lambda s: {p}), true)"
    regions = ", ".join(
        f"CASE WHEN coalesce(list_position(list_transform(toks, lambda t: lower(t) IN ({', '.join(f"'{w}'" for w in words)})), true), 0) > 0 "
        f"THEN (list_position(list_transform(toks, lambda t: lower(t) IN ({', '.join(f"'{w}'" for w in words)})), true) - 1)::INT END AS at_{r}"
        for r, words in REGION_MARKERS.items()
    )
    longest = where("length(regexp_replace(s, '[^a-h]', '', 'g')) = l2_longest")
    motive = "(list_position(motives, '') + 1)"
    return f"""{name} AS (SELECT *, {start(where("regexp_matches(s, '^[nsp]*[yz][nsp]*$')"))} AS at_l1_single, {start(where("regexp_matches(s, '^[nsp]*[a-h][nsp]*$')"))} AS at_l2_single,
  CASE WHEN l2_longest > 0 THEN {start(longest)} END AS at_longest, CASE WHEN n_unknown > 0 THEN length(regexp_extract(tags, '^[^bdfh]*'))::INT END AS at_unknown,
  CASE WHEN n_switches > 0 THEN length(segs[1])::INT END AS at_switch, CASE WHEN coalesce(list_position(motives, ''), 0) > 0 THEN {start(motive)} END AS at_unmotivated, {regions} FROM {source})"""


def novelty_inputs(analyzed: DataFrame, n: int = 4) -> DataFrame:
    """``analyzed`` plus text_hash, pattern and grams (hashes of the distinct shingles of n content tokens).

    Tokens are paired with their tags as arrays: a lambda that indexes the tag
    string would tag the whole text again for each token where Spark inlines
    that column.
    """
    marks = F.filter(F.split("tags", ""), lambda m: m != "")
    content = F.filter(F.zip_with(F.transform("toks", F.lower), marks, lambda t, m: F.when(~m.isin("n", "s", "p"), t)), lambda t: t.isNotNull())
    codes = F.transform(F.sequence(F.lit(1), F.size("segs") - 1), _switch_code)
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[{SPACE}]+", "")
    staged = analyzed.withColumns({"content": content, "text_hash": F.md5(text), "pattern": F.when(F.col("n_switches") > 0, F.array_join(codes, "|")).otherwise("no_switch")})
    gram = lambda i: F.xxhash64(F.concat_ws("|", *[F.get(F.col("content"), i - 1 + k) for k in range(n)]))
    return staged.withColumn("grams", F.when(F.size("content") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("content") - n + 1), gram)))).drop("content")


@dataclass(frozen=True)
class Known:
    """What earlier runs accepted: grams(gram), hashes(text_hash), patterns(pattern, n), and the number of texts."""

    grams: DataFrame
    hashes: DataFrame
    patterns: DataFrame
    total: int


_BEFORE_ALL = -(1 << 63)


def shared_shingles(inputs: DataFrame, row: str, known: Known | None = None) -> DataFrame:
    """The written shingles (row, gram) that more than one of ``inputs`` has, or a text of ``known``: no other can be seen before."""
    shingles = inputs.select(row, F.explode("grams").alias("gram"))
    every = shingles.select("gram") if known is None else shingles.select("gram").unionByName(known.grams.select("gram").distinct())
    common = cut(every.groupBy("gram").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "common")
    return cut(joined_to(shingles, common, "gram"), "shared")


def _novel_shingles(inputs: DataFrame, key: str, row: str) -> DataFrame:
    """The rows of ``inputs`` with the number of their shingles that no row with a smaller key has.

    A shingle is new with the smallest key that has it, so counting first
    occurrences by key needs no way back to the rows. Only rows that share
    their key look their shingles up.
    """
    first = inputs.select(key, F.explode("grams").alias("gram")).groupBy("gram").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("__n"))
    keys = cut(inputs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "keys")
    shared = keys.filter("__n > 1")
    alone = shared.isEmpty()
    first = first.drop("__n") if alone else cut(first, "first")
    new = first.groupBy(F.col("first").alias(key)).agg(F.count(F.lit(1)).alias("new"))
    tally = cut(keys.join(new, key, "left").withColumnRenamed("__n", "alike").withColumn("__n", F.col("alike")), "tally")
    out = joined_to(inputs.select(row, key), tally, key)
    if alone:
        return out.select(row, "new")
    own = joined_to(inputs.select(row, key, "grams"), shared, key).select(row, key, F.explode("grams").alias("gram"))
    found = joined_to(own, first, "gram").filter(F.col("first") == F.col(key)).groupBy(row).agg(F.count(F.lit(1)).alias("looked_up"))
    return out.join(found, row, "left").select(row, F.when(F.col("alike") > 1, F.col("looked_up")).otherwise(F.col("new")).alias("new"))


def diversity(
    inputs: DataFrame, key: str, accepted: str | None = None, row: str | None = None, carried: tuple[str, ...] = (), known: Known | None = None, shared: DataFrame | None = None
) -> DataFrame:
    """One row for each of ``inputs``: key, is_copy, overlap, pattern, pattern_share, diversity: novelty against all earlier texts (order by ``key``).

    With ``accepted``, a boolean column, it is novelty against those earlier
    texts where it holds; texts of ``known`` are earlier than all of them.

    ``inputs`` is a written table with key, text_hash, pattern and grams; with
    ``shared`` (of ``shared_shingles``) n_grams, their number, instead of grams.
    ``row`` tells rows apart where keys may repeat; rows of one key are not
    earlier than each other. Keys are longs and not null. Shingles and hashes
    are compared by the earliest key that has them (an aggregate with partial
    minima, and ``ranks.with_first`` where rows need the key itself),
    places come from counts of key ranges that grow in number with the rows, so
    no hot shingle, copy or pattern meets one task.
    """
    one = row or key
    own = F.when(F.col(accepted), F.col(key)) if accepted else F.col(key)
    ids = list(dict.fromkeys([one, key]))

    def first(rows: DataFrame, of: str, earlier: DataFrame | None, name: str, value: Column | None = None) -> DataFrame:
        """``with_first`` over these rows and those of earlier runs, which come before all."""
        rows = rows.withColumn("old", F.lit(False))
        if earlier is not None:
            told = earlier.select(*[F.lit(_BEFORE_ALL).alias(c) for c in ids], (F.lit(_BEFORE_ALL) if value is None else value).alias("own"), of, F.lit(True).alias("old"))
            rows = rows.unionByName(told.select(*rows.columns))
        return with_first(rows, of, "own", name).filter("NOT old").drop("old")

    counted = inputs if shared is not None else inputs.withColumn("n_grams", F.greatest(F.size("grams"), F.lit(0)))
    if accepted or known or shared is not None:
        if shared is None:
            shared = shared_shingles(inputs, one, known)
        judged = shared.join(inputs.select(*ids, *([accepted] if accepted else [])), one)
        found = first(judged.select(*ids, own.alias("own"), "gram"), "gram", known and known.grams, "first").filter(F.col("first") < F.col(key))
        seen = counted.select(one, "n_grams").join(found.groupBy(one).agg(F.count(F.lit(1)).alias("seen")), one, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    else:
        seen = counted.select(one, "n_grams").join(_novel_shingles(inputs, key, one), one).withColumn("seen", F.col("n_grams") - F.coalesce("new", F.lit(0)))
    overlap = seen.select(one, F.when(F.col("n_grams") > 0, F.col("seen") / F.col("n_grams")).otherwise(0.0).alias("overlap"))
    hashed = inputs.select(*ids, "text_hash", own.alias("own"))
    copies = first(hashed, "text_hash", known and known.hashes, "first_copy").select(one, F.coalesce(F.col("first_copy") < F.col(key), F.lit(False)).alias("is_copy"))
    light = in_ranges(inputs.select(*ids, *carried, "text_hash", "pattern", *([accepted] if accepted else [])), key)
    ranks = place_in_order(place_in_order(light, [], key, "before_all", accepted), ["pattern"], key, "before_same", accepted).drop("__range")
    if known:
        patterns = inputs.select(*ids, "pattern", F.lit(None).cast("long").alias("own"))
        tallied = first(patterns, "pattern", known.patterns, "earlier", F.col("n").cast("long")).select(one, F.coalesce("earlier", F.lit(0)).alias("earlier"))
        ranks = ranks.join(tallied, one).withColumns({"before_all": F.col("before_all") + known.total, "before_same": F.col("before_same") + F.col("earlier")}).drop("earlier")
    return apply_steps(ranks.join(copies, one).join(overlap, one), DIVERSITY)


DIVERSITY: list[dict[str, str]] = [
    {"pattern_share": "CASE WHEN before_all > 0 THEN CAST(before_same AS DOUBLE) / before_all ELSE 0.0 END"},
    {
        "ngram_novelty": "CASE WHEN overlap > 0.70 THEN 2.0 WHEN overlap > 0.50 THEN 5.0 WHEN overlap > 0.30 THEN 7.5 ELSE 10.0 END",
        "pattern_novelty": "CASE WHEN before_all > 100 AND pattern_share > 0.10 THEN 5.0 WHEN before_all > 100 AND pattern_share > 0.05 THEN 7.5 ELSE 10.0 END",
    },
    {"diversity": "CASE WHEN is_copy THEN 0.0 WHEN before_all = 0 THEN 10.0 ELSE " + _round2("ngram_novelty * 0.50 + pattern_novelty * 0.50") + " END"},
]


def _switch_code(i):
    before, after = F.get(F.col("segs"), i - 1), F.get(F.col("segs"), i)
    lang = lambda s: F.when(s.rlike("[yz]"), "1").otherwise("2")
    return F.concat(lang(before), F.lit(">"), lang(after), F.lit(":"), F.when(before.endswith("s"), "inter").otherwise("intra"))


def diversity_sql(source: str, key: str, name: str = "dv", n: int = 4) -> str:
    code = "(CASE WHEN regexp_matches(segs[i-1], '[yz]') THEN '1' ELSE '2' END) || '>' || (CASE WHEN regexp_matches(segs[i], '[yz]') THEN '1' ELSE '2' END) || ':' || (CASE WHEN segs[i-1] LIKE '%s' THEN 'inter' ELSE 'intra' END)"
    return f"""{name}0 AS (SELECT {key}, md5(regexp_replace(lower(coalesce(text, '')), '[{SPACE}]+', '', 'g')) AS text_hash,
  list_filter(list_transform(toks, lambda t: lower(t)), lambda t, i: regexp_matches(substr(tags, i, 1), '[yza-h]')) AS content,
  CASE WHEN n_switches > 0 THEN array_to_string(list_transform(range(2, len(segs) + 1), lambda i: {code}), '|') ELSE 'no_switch' END AS pattern FROM {source}),
{name}g AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, len(content) - {n - 2}), lambda i: array_to_string(content[i:i+{n - 1}], '|'))) AS gram FROM {name}0),
{name}o AS (SELECT {key}, sum((f < {key})::INT)::DOUBLE / count(*) AS overlap FROM (SELECT {key}, min({key}) OVER (PARTITION BY gram) AS f FROM {name}g) GROUP BY {key}),
{name}1 AS (SELECT {key}, text_hash, pattern, coalesce(overlap, 0.0::DOUBLE) AS overlap, min({key}) OVER (PARTITION BY text_hash) < {key} AS is_copy,
  row_number() OVER (ORDER BY {key}) - 1 AS before_all, row_number() OVER (PARTITION BY pattern ORDER BY {key}) - 1 AS before_same FROM {name}0 LEFT JOIN {name}o USING ({key})),
""" + steps_sql(f"{name}1", DIVERSITY, name)


def best_of(attempts: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Best of the attempts up to the first that reaches the threshold; earliest on ties; none above zero: no row."""
    group = Window.partitionBy(*by)
    stop = F.min(F.when(F.col("score") >= threshold, F.col("attempt"))).over(group)
    kept = attempts.withColumn("stop", stop).filter("(stop IS NULL OR attempt <= stop) AND score > 0")
    best = F.row_number().over(group.orderBy(F.desc("score"), "attempt"))
    return kept.withColumn("best", best).filter("best = 1").drop("best", "stop")
