"""Queries of the text analysis and the evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.functions.lang import PAIRS, SEGMENT, token_tag_sql
from braidlex.operators import analysis as A
from braidlex.operators import rules as R
from braidlex.operators import scoring as S
from braidlex.plans import lexicon
from braidlex.plans.tables import cut, spread

FR, ZH = PAIRS["fr_en"], PAIRS["zh_en"]
#: Our own sentences, for the pairs told apart by script; the queries put one before each document.
FIXTURE = (
    "我明天要去 office 开会，你 ready 了吗？", "This is fine. 我们走吧！", "只有中文没有别的", "only english words here", "", "。。。", "3 点 meeting，4点 lunch",
    "Wow 好厉害！Really? 真的。 ok", "我用API写code，debug很久", "他说 by the way 记得 bring 雨伞",
    "那个 deadline 是 tomorrow lah，wtf 我还没 finish report（好累", "今天 so tired 啊 lor，we 一起去 eat 吧 yyds", "<b>你好</b> hello world 大家好 friends",
    "**Role:** 你是 helper 请 answer 我的 question 吧", "我 love 你 and 你 love me right 对不对 okay 好的", "我们 the the 那么 we 走 so 吧 you 好", "咩嘢 you say 嗰 thing ar 佢 hor",
)
FIXTURE_SQL = "(SELECT doc_id, ([" + ", ".join(f"'{t}'" for t in FIXTURE) + f"])[doc_id % {len(FIXTURE)} + 1] || ' ' || coalesce(text, '') AS text FROM documents)"
TOPIC_WORDS = ("report", "the", "question", "with")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIXTURE)), "doc_id long, text string")


def by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for the pairs told apart by script: one of our sentences before each text."""
    sentence = F.get(F.array(*map(F.lit, FIXTURE)), F.pmod("doc_id", F.lit(len(FIXTURE))).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(sentence, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def profiled(df: DataFrame) -> DataFrame:
    """Deterministic speaker profiles: archetype, its range, register, region and wanted words from the id."""
    k = F.pmod("doc_id", F.lit(6)).cast("int")
    ranges = list(S.ARCHETYPE_CMI.values())
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), F.pmod("doc_id", F.lit(by)).cast("int"))
    return df.withColumns({
        "archetype": F.concat(F.lit("ARC_0"), (k + 1).cast("string")), "cmi_lo": pick([r[0] for r in ranges], 6), "cmi_hi": pick([r[1] for r in ranges], 6),
        "formality": pick(("casual", "semi_formal", "formal"), 3), "region": pick(("singapore", "malaysia", "hongkong", ""), 4), "wanted": F.array(*map(F.lit, TOPIC_WORDS)),
    })


def profiled_sql(source: str, name: str = "p") -> str:
    ranges = list(S.ARCHETYPE_CMI.values())
    lows, highs = (", ".join(f"{r[i]}::DOUBLE" for r in ranges) for i in (0, 1))
    return f"""{name} AS (SELECT *, 'ARC_0' || (doc_id % 6 + 1) AS archetype, ([{lows}])[doc_id % 6 + 1] AS cmi_lo, ([{highs}])[doc_id % 6 + 1] AS cmi_hi,
  (['casual', 'semi_formal', 'formal'])[doc_id % 3 + 1] AS formality, (['singapore', 'malaysia', 'hongkong', ''])[doc_id % 4 + 1] AS region, {list(TOPIC_WORDS)} AS wanted FROM {source})"""


def scored(df: DataFrame, pair, given: R.Rules = R.DEFAULT) -> DataFrame:
    """All scores but diversity, which looks at other texts."""
    return S.apply_steps(S.measured(profiled(A.analyze(df, pair))), S.steps_of(given))


_NOVELTY = ["text_hash", "pattern", "grams"]


def _numbered(df: DataFrame) -> DataFrame:
    """Rows get a number, as ids may be missing or repeated, and ``seq``, the order of the texts: the id, rows without one last."""
    return df.withColumns({"row": F.monotonically_increasing_id(), "seq": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))})


def novelty(df: DataFrame, pair) -> DataFrame:
    inputs = cut(_numbered(S.novelty_inputs(A.analyze(df, pair)).select("doc_id", *_NOVELTY)), "novelty")
    return S.diversity(inputs, "seq", row="row", carried=("doc_id",))


_OTHER = ["doc_id", "guard", "cmi", "n_switches", "matrix", "archetype", "fluency", "naturalness", "switch_motivation", "profile_consistency", "cultural_coherence"]
_SEEN = ["is_copy", "diversity", "before_all", "overlap", "pattern_share"]


def _scores(df: DataFrame, pair, given: R.Rules = R.DEFAULT, more: dict[str, str] | None = None) -> DataFrame:
    """The scores but diversity, its inputs, and ``more`` (SQL by name), as a written table; no text is shuffled."""
    rows = S.novelty_inputs(scored(df, pair, given))
    if more:
        rows = S.located(rows).withColumns({name: F.expr(S.doubles(sql)) for name, sql in more.items()})
    return cut(_numbered(rows.select(*_OTHER, *_NOVELTY, *(more or {}))), "scores")


def _judged(scores: DataFrame, seen: DataFrame, more: list[str]) -> DataFrame:
    return S.apply_steps(scores.select("row", *_OTHER, *more).join(seen.select("row", *_SEEN), "row"), S.VERDICT)


def verdicts(df: DataFrame, pair, given: R.Rules = R.DEFAULT, more: dict[str, str] | None = None) -> DataFrame:
    """The whole evaluator: six scores, veto, final score, decision; diversity as if every text were accepted.

    One row for each row of ``df``, also where ids are missing or repeated.
    """
    scores = _scores(df, pair, given, more)
    return _judged(scores, S.diversity(scores.select("row", "seq", *_NOVELTY), "seq", row="row"), list(more or {}))


def accepted_verdicts(df: DataFrame, pair, passes: str = "decision = 'pass'", known: S.Known | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The evaluator where diversity looks only at earlier texts that passed themselves, and at those of ``known``; plus ``accepted``.

    Whether a text passes depends on earlier texts only, so the recurrence has
    one solution. It is found by rounds over all rows: each judges by what the
    round before accepted, settles at least the first text that was still open,
    and the rounds end where no decision changes any more (in practice after
    a few).
    """
    scores = _scores(df, pair)
    more = list(carried)  # of the inputs of diversity
    shared = S.shared_shingles(scores.select("row", "grams"), "row", known)
    light = scores.select("row", "seq", "text_hash", "pattern", F.greatest(F.size("grams"), F.lit(0)).alias("n_grams"))
    state = cut(scores.select("row", F.lit(True).alias("accepted")), "accepted")
    while True:
        inputs = cut(light.join(state, "row"), "novelty")
        seen = S.diversity(inputs, "seq", "accepted", "row", known=known, shared=shared)
        judged = cut(_judged(scores, seen, []).select("row", F.expr(passes).alias("accepted"), *_SEEN), "judged")
        if judged.join(state.withColumnRenamed("accepted", "before"), "row").filter("accepted <> before").isEmpty():
            return _judged(scores, judged, more).join(judged.select("row", "accepted"), "row")
        state = judged.select("row", "accepted")


#: The rules of every checker; those of diversity come after the comparison with other texts.
RULES = R.all_rules(R.DEFAULT, tuple(S.REGION_MARKERS))
_OWN_RULES, _SEEN_RULES = [r for r in RULES if r.checker != "diversity"], [r for r in RULES if r.checker == "diversity"]
_REPORTS = {f"report_{c}": R.report(_OWN_RULES, c) for c in list(S.WEIGHTS)[:-1]}


def violations(df: DataFrame, pair) -> DataFrame:
    """One row per text and broken rule: doc_id, checker, rule, up to three numbers, and the first token."""
    found = verdicts(df, pair, more={"broken": R.violations(_OWN_RULES)}).withColumn("seen_broken", F.expr(S.doubles(R.violations(_SEEN_RULES))))
    rows = found.select("doc_id", F.explode_outer(F.concat("broken", "seen_broken")).alias("v")).filter("v is not null")
    return rows.select("doc_id", "v.checker", "v.rule", *[F.get("v.numbers", F.lit(i)).alias(f"number_{i + 1}") for i in range(3)], "v.token")


def violations_sql(source: str, pair) -> str:
    own, seen = (S.doubles(R.violations(rules, "duckdb")) for rules in (_OWN_RULES, _SEEN_RULES))
    return (
        f"WITH {scored_sql(source, pair)},\n{S.located_sql('s')},\n{S.diversity_sql('a', 'doc_id')},\n"
        f"x AS (SELECT lo.doc_id, unnest(list_concat({own}, {seen})) AS v FROM lo JOIN dv USING (doc_id))\n"
        "SELECT doc_id, v.checker AS checker, v.rule AS rule, v.numbers[1] AS number_1, v.numbers[2] AS number_2, v.numbers[3] AS number_3, v.token AS token FROM x"
    )


def summaries(df: DataFrame, pair) -> DataFrame:
    head = {"head_text": HEAD_TEXT, **_REPORTS}
    return verdicts(df, pair, more=head).withColumn("report_diversity", F.expr(S.doubles(R.report(_SEEN_RULES, "diversity")))).select("doc_id", F.expr(S.doubles(SUMMARY)).alias("summary"))


def summaries_sql(source: str, pair) -> str:
    reports = ", ".join(f"{S.doubles(sql)} AS {name}" for name, sql in {"head_text": HEAD_TEXT, **_REPORTS, "report_diversity": R.report(_SEEN_RULES, "diversity")}.items())
    shown = "j AS (SELECT s.*, dv.* EXCLUDE (doc_id, text_hash, pattern) FROM s JOIN dv USING (doc_id))"
    ctes = ",\n".join([scored_sql(source, pair), S.diversity_sql("a", "doc_id"), shown, S.steps_sql("j", S.VERDICT, "v"), f"w AS (SELECT *, {reports} FROM v)"])
    return f"WITH {ctes}\nSELECT doc_id, {S.doubles(SUMMARY)} AS summary FROM w"


#: Our own evaluation tables of two configurations, as a pair's folder would hold them.
CONFIGURATIONS = {
    "strict": """
switch_type_expectations: {ARC_01: {intra_min: 0.9}, ARC_02: {inter_min: 0.8}, ARC_03: {intra_min: 0.7}, ARC_04: {intra_min: 0.2, inter_min: 0.2}, ARC_05: {max_cmi: 0.05}, ARC_06: {max_cmi: 0.3}}
l2_span_expectations: {ARC_01: {typical_max: 2}, ARC_02: {typical_min: 6}, ARC_03: {typical_max: 3}, ARC_06: {typical_min: 2, typical_max: 4}}
filler_words: []
""",
    "lenient": """
switch_type_expectations: {ARC_01: {intra_min: 0.3, desc: mostly inside sentences}, ARC_02: {inter_min: 0.2}, ARC_05: {max_cmi: 0.5}}
l2_span_expectations: {ARC_01: {typical_max: 12}}
filler_words: [the, data, report, "of the"]
interjections: [a, an, et]
""",
}
_BY_RULES = ["switch_type", "l2_span", "n_attributed", "switch_motivation", "profile_consistency"]


def configured() -> dict[str, R.Rules]:
    import yaml

    return {name: R.read_rules(yaml.safe_load(text)) for name, text in CONFIGURATIONS.items()}


def by_rules(df: DataFrame, pair) -> DataFrame:
    """The scores that a pair's tables decide, under each of the configurations."""
    parts = [_digest(scored(df, given.words(pair), given), _BY_RULES).withColumn("rules", F.lit(name)) for name, given in configured().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_rules_sql(source: str, pair) -> str:
    return "\nUNION ALL\n".join(f"SELECT *, '{name}' AS rules FROM ({_sql(scored_sql(source, given.words(pair), given), _BY_RULES, 's')})" for name, given in configured().items())


def scored_sql(source: str, pair, given: R.Rules = R.DEFAULT) -> str:
    return ",\n".join([A.analysis_sql(source, pair), profiled_sql("a"), S.measured_sql("p"), S.steps_sql("m", S.steps_of(given), "s")])


def verdicts_sql(source: str, pair) -> str:
    return ",\n".join([scored_sql(source, pair), S.diversity_sql("a", "doc_id"), "j AS (SELECT s.*, dv.is_copy, dv.diversity FROM s JOIN dv USING (doc_id))", S.steps_sql("j", S.VERDICT, "v")])


#: The beginning of the text in the report, whose lines are about the whole of it.
HEAD_TEXT = "substr(coalesce(text, ''), 1, 80) || CASE WHEN length(coalesce(text, '')) > 80 THEN '...' ELSE '' END"


def _checker_line(checker: str) -> str:
    weight = R.number(S.WEIGHTS[checker])
    shown = f"CAST(CAST({checker} AS DECIMAL(6,2)) AS STRING) || '/10 x ' || '{S.WEIGHTS[checker]:.2f}' || ' = ' || CAST(CAST({checker} * {weight} AS DECIMAL(8,4)) AS STRING)"
    return f"chr(10) || '  [{checker}] ' || {shown} || report_{checker}"


SUMMARY = (
    "'=== ' || upper(decision) || ' (' || CAST(CAST(final_score AS DECIMAL(6,2)) AS STRING) || '/10) ===' || chr(10) || 'text: ' || head_text || chr(10) || 'CMI ' || CAST(CAST(cmi AS DECIMAL(6,3)) AS STRING) || "
    "', matrix ' || matrix || ', switches ' || CAST(n_switches AS STRING) || CASE WHEN veto <> '' THEN chr(10) || '[veto: ' || veto || ']' ELSE '' END || " + " || ".join(map(_checker_line, S.WEIGHTS))
)

_ANALYSIS = ["n_tokens", "n1", "n2", "n_content", "n_segs", "n_switches", "n_intra", "n_inter", "cmi", "matrix", "tags"]
_SCORES = {
    "q_fluency": ["guard", "l1_quality", "l2_quality", "completeness", "fluency"],
    "q_naturalness": ["switch_frequency", "l2_integrity", "language_mode", "switch_syntax", "naturalness"],
    "q_motivation": ["n_switches", "n_attributed", "attribution", "switch_motivation"],
    "q_profile": ["archetype", "cmi_range", "switch_type", "l2_span", "domain_words", "profile_consistency"],
    "q_cultural": ["formality", "region", "formality_score", "regional", "sensitivity", "cultural_coherence"],
}
_VERDICT = ["fluency", "naturalness", "switch_motivation", "profile_consistency", "cultural_coherence", "diversity", "is_copy", "veto", "final_score", "decision"]
_DIVERSITY = ["text_hash", "is_copy", "overlap", "pattern", "pattern_share", "ngram_novelty", "pattern_novelty", "diversity"]


def _digest(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("doc_id", *[F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns])


_DOUBLES = {"cmi", "cmi_clear", "l1_quality", "l2_quality", "completeness", "fluency", "switch_frequency", "l2_integrity", "language_mode", "switch_syntax", "naturalness", "attribution", "switch_motivation", "cmi_range",
            "switch_type", "l2_span", "domain_words", "profile_consistency", "formality_score", "regional", "sensitivity", "cultural_coherence", "overlap", "pattern_share", "ngram_novelty", "pattern_novelty", "diversity", "final_score"}


def _sql(ctes: str, columns: list[str], source: str) -> str:
    return f"WITH {ctes}\nSELECT doc_id, " + ", ".join(f"round({c}::DOUBLE, 9) AS {c}" if c in _DOUBLES else c for c in columns) + f" FROM {source}"


def queries() -> dict:
    out = {
        "ta1_char_class": lambda s, d: A.analyze(by_script(s, d), ZH).select(F.explode_outer("toks").alias("tok"), "tags").filter("tok is not null").groupBy(F.substring("tok", 1, 1).alias("ch")).agg(F.count(F.lit(1)).alias("n")),
        "ta2_tokenize_unicode": lambda s, d: A.analyze(by_script(s, d), ZH).select("doc_id", F.posexplode_outer("toks").alias("pos", "tok"), "tags").filter("tok is not null").select("doc_id", "pos", "tok", F.substring(F.col("tags"), F.col("pos") + 1, F.lit(1)).alias("tag")),
        "ta3_tokenize_lexicon": lambda s, d: A.analyze(documents(s, d), FR).select("doc_id", "n_tokens", F.md5("tags").alias("tags_md5"), F.md5(F.array_join("toks", " ")).alias("tokens_md5")),
        "ta3_ambiguous": lambda s, d: _digest(A.clear_mixing(A.analyze(documents(s, d), FR), FR), ["n_ambiguous", "cmi_clear"]),
        "ta3_lexicon_table": lambda s, d: lexicon.analyze(documents(s, d), FR, corpus_lexicon(s, d), limit=LISTED_WORDS).select("doc_id", "n1", "n2", "n_switches", F.md5("tags").alias("tags_md5")),
        "ta4_segments": lambda s, d: _conversation(s, d, A.segments).drop("content"),
        "ta5_switch_points": lambda s, d: _conversation(s, d, A.switch_points),
        "ta6_switch_type": lambda s, d: A.analyze(documents(s, d), FR).select("doc_id", "n_intra", "n_inter"),
        "ta7_switch_context": lambda s, d: _conversation(s, d, A.switch_points).select("conv_id", "turn", "seg", "context_before", "context_after"),
        "ta8_sentences": lambda s, d: documents(s, d).select("doc_id", A.sentences(F.col("text")).alias("x")).select("doc_id", F.size("x").alias("n_sentences"), F.md5(F.array_join("x", "\n")).alias("sentences_md5")),
        "ta9_cmi": lambda s, d: _digest(A.analyze(documents(s, d), FR), ["n1", "n2", "cmi"]),
        "ta10_matrix_language": lambda s, d: A.analyze(documents(s, d), FR).groupBy("matrix").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_content").alias("n_content")),
        "ta11_analyze": lambda s, d: _digest(A.analyze(documents(s, d), FR), _ANALYSIS),
        "ta11_analyze_fixture": lambda s, d: _digest(A.analyze(by_script(s, d), ZH), _ANALYSIS),
        "q_garbage_pages": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).rlike(S.GARBAGE).alias("is_garbage")),
        "q_motivation_distribution": lambda s, d: A.analyze(documents(s, d), FR).select(F.explode_outer("motives").alias("motivation")).filter("motivation is not null").groupBy("motivation").agg(F.count(F.lit(1)).alias("n")),
        "q_diversity": lambda s, d: _digest(novelty(documents(s, d), FR), _DIVERSITY),
        "q_verdict": lambda s, d: _digest(verdicts(documents(s, d), FR), _VERDICT),
        "q_verdict_fixture": lambda s, d: _digest(verdicts(by_script(s, d), ZH), _VERDICT),
        "q_accept": lambda s, d: _digest(accepted_verdicts(documents(s, d), FR), [*_VERDICT, "accepted"]),
        "q_decide": lambda s, d: verdicts(documents(s, d), FR).groupBy("archetype", "decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final_score"), 6).alias("avg_score")),
        "q_summary": lambda s, d: summaries(documents(s, d), FR).select("doc_id", F.md5("summary").alias("summary_md5"), F.length("summary").alias("n_chars")),
        "q_violations": lambda s, d: violations(documents(s, d), FR),
        "q_by_rules": lambda s, d: by_rules(documents(s, d), FR),
    }
    for name, columns in _SCORES.items():
        out[name] = lambda s, d, c=columns: _digest(scored(documents(s, d), FR), c)
        out[f"{name}_fixture"] = lambda s, d, c=columns: _digest(scored(by_script(s, d), ZH), c)
    return out


#: Words up to which the lexicon of ``ta3_lexicon_table`` would be a list: it is longer, so the query joins.
LISTED_WORDS = 50


def corpus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and turns of which an MD5 begins with a digit: a lexicon that grows with the tables."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"))
    words = spread(texts).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).distinct()
    return words.filter(F.md5("word").rlike("^[0-9]"))


def lexicon_table_sql() -> str:
    pair = FR.replaced(lexicon=(), outside=True)
    return f"""WITH lx AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE regexp_matches(md5(word), '^[0-9]')),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pair.token}') AS toks FROM documents),
x AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, {token_tag_sql(pair, "tok", "word IS NOT NULL")} AS tag FROM x LEFT JOIN lx ON lx.word = lower(tok)),
t AS (SELECT doc_id, string_agg(tag, '' ORDER BY i) AS tags FROM g GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(tags, '') AS tags FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, length(regexp_replace(tags, '[^yz]', '', 'g'))::INT AS n1, length(regexp_replace(tags, '[^a-h]', '', 'g'))::INT AS n2,
  greatest(len(list_filter(regexp_extract_all(tags, '{SEGMENT}'), lambda s: regexp_matches(s, '[yza-h]'))) - 1, 0)::INT AS n_switches, md5(tags) AS tags_md5 FROM w"""


def _conversation(spark: SparkSession, sf_dir: str, what) -> DataFrame:
    return what(A.analyze(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")), FR), ["conv_id", "turn"], FR)


def oracle_sql() -> dict[str, str]:
    doc, fix = A.analysis_sql("documents", FR), A.analysis_sql(FIXTURE_SQL, ZH)
    conv = A.analysis_sql("conversations", FR) + ",\n" + A.segments_sql("conv_id, turn", FR)
    switches = (
        conv + ",\nsw0 AS (SELECT *, lag(lang) OVER w AS from_lang, lag(ends_sentence) OVER w AS closed, lag(content) OVER w AS before FROM seg WINDOW w AS (PARTITION BY conv_id, turn ORDER BY seg)),\n"
        "sw AS (SELECT sw0.conv_id, sw0.turn, seg, start AS position, from_lang, lang AS to_lang, CASE WHEN closed THEN 'inter' ELSE 'intra' END AS switch_type, "
        "array_to_string(before[greatest(len(before) - 2, 1):], ' ') AS context_before, array_to_string(content[1:3], ' ') AS context_after, a.motives[seg] AS motivation "
        "FROM sw0 JOIN a ON a.conv_id = sw0.conv_id AND a.turn = sw0.turn WHERE from_lang IS NOT NULL)"
    )
    out = {
        "ta1_char_class": f"WITH {fix} SELECT left(tok, 1) AS ch, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM a) GROUP BY ALL",
        "ta2_tokenize_unicode": f"WITH {fix} SELECT doc_id, (i - 1)::INT AS pos, tok, substr(tags, i, 1) AS tag FROM (SELECT doc_id, tags, unnest(toks) AS tok, unnest(range(1, len(toks) + 1))::INT AS i FROM a)",
        "ta3_tokenize_lexicon": f"WITH {doc} SELECT doc_id, n_tokens, md5(tags) AS tags_md5, md5(coalesce(array_to_string(toks, ' '), '')) AS tokens_md5 FROM a",
        "ta3_lexicon_table": lexicon_table_sql(),
        "ta3_ambiguous": _sql(doc + ",\n" + A.clear_mixing_sql("a", FR), ["n_ambiguous", "cmi_clear"], "cm"),
        "ta4_segments": f"WITH {conv} SELECT conv_id, turn, seg, lang, n_content, start, stop, text, ends_sentence FROM seg",
        "ta5_switch_points": f"WITH {switches} SELECT * FROM sw",
        "ta6_switch_type": f"WITH {doc} SELECT doc_id, n_intra, n_inter FROM a",
        "ta7_switch_context": f"WITH {switches} SELECT conv_id, turn, seg, context_before, context_after FROM sw",
        "ta8_sentences": f"SELECT doc_id, len(x)::INT AS n_sentences, md5(coalesce(array_to_string(x, chr(10)), '')) AS sentences_md5 FROM (SELECT doc_id, {A.sentences_sql('text')} AS x FROM documents)",
        "ta9_cmi": _sql(doc, ["n1", "n2", "cmi"], "a"),
        "ta10_matrix_language": f"WITH {doc} SELECT matrix, count(*) AS n_docs, sum(n_content)::BIGINT AS n_content FROM a GROUP BY ALL",
        "ta11_analyze": _sql(doc, _ANALYSIS, "a"),
        "ta11_analyze_fixture": _sql(fix, _ANALYSIS, "a"),
        "q_garbage_pages": f"SELECT page_id, regexp_matches(coalesce(html, ''), '{S.GARBAGE}') AS is_garbage FROM pages",
        "q_motivation_distribution": f"WITH {doc} SELECT motivation, count(*) AS n FROM (SELECT unnest(motives) AS motivation FROM a) GROUP BY ALL",
        "q_diversity": _sql(doc + ",\n" + S.diversity_sql("a", "doc_id"), _DIVERSITY, "dv"),
        "q_verdict": _sql(verdicts_sql("documents", FR), _VERDICT, "v"),
        "q_verdict_fixture": _sql(verdicts_sql(FIXTURE_SQL, ZH), _VERDICT, "v"),
        "q_decide": f"WITH {verdicts_sql('documents', FR)} SELECT archetype, decision, count(*) AS n, round(avg(final_score), 6) AS avg_score FROM v GROUP BY ALL",
        "q_summary": f"SELECT doc_id, md5(summary) AS summary_md5, length(summary)::INT AS n_chars FROM ({summaries_sql('documents', FR)})",
        "q_violations": violations_sql("documents", FR),
        "q_by_rules": by_rules_sql("documents", FR),
    }
    for name, columns in _SCORES.items():
        out[name] = _sql(scored_sql("documents", FR), columns, "s")
        out[f"{name}_fixture"] = _sql(scored_sql(FIXTURE_SQL, ZH), columns, "s")
    return out
