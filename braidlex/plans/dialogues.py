"""Queries of sampling, turn logic, retrieval, voices and audio."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.functions import audio
from braidlex.functions.lang import PAIRS
from braidlex.operators import analysis as A
from braidlex.operators import dialogue as D
from braidlex.operators import sampling as S
from braidlex.operators import voice as V
from braidlex.plans.ranks import in_ranges, place_in_order
from braidlex.plans.tables import cut, run_dir, spread
from braidlex.sources import config, providers

FR = PAIRS["fr_en"]
_PROFILE = ["row", "persona", "archetype", "topic", "relationship", "formality", "dialogue_type", "region", "profession", "domain_words", "effective_cmi", "level"]

#: Our own raw replies, one for each rule of the cleaning.
REPLIES = (
    "<reply>好的 we can go</reply>", "<think>plan\nmore</think> <reply> Hello there </reply> tail", "<reply>cut off text", "1. first item", "Let me think about it", "A: **bold** and *soft* words",
    'Sure, "quoted text"', "“引用的 text”", "plain short reply", "line one\nline  two", "x" * 210, "<reply>" + "y" * 205 + "</reply>", "Speaker A: okay then", "", "以下是目前的对话 echo", "Okay, short",
)
REGIONS = ("Hong Kong", "中国大陆北京", "Singapore (East)", "Malaysia", "台湾", "Paris", "")
PERSONA_TEXTS = (
    ("她 is a graduate student", "student"), ("a retired male professor", "professor"), ("一位老先生", "teacher"), ("a young woman", "engineer"), ("uncle with a shop", "owner"), ("an engineer", "software engineer"), ("a lady and her sister", ""),
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: tuple, cols: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else f"{x}::BIGINT" for x in r) + ")" for r in rows) + f") v({cols}))"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: What models put around their words; a turn gets one of them by its number.
WRAPPINGS = (("<reply>", "</reply>"), ("<think>plan\nmore</think>\n<reply> ", " </reply> tail"), ("A: **", "**"), ("Sure, \"", "\""), ("Let me think. ", ""), ("说话人A：", ""), ("", ""), ("<reply>", ""))


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as a model might have sent them."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(WRAPPINGS))).cast("int")
    before, after = (F.get(F.array(*[F.lit(w[i]) for w in WRAPPINGS]), k) for i in (0, 1))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.concat(before, F.coalesce("text", F.lit("")), after).alias("raw"))


RAW_SQL = "(SELECT conv_id, turn, ([{0}])[(conv_id + turn) % {2} + 1] || coalesce(text, '') || ([{1}])[(conv_id + turn) % {2} + 1] AS raw FROM conversations)".format(*(", ".join(_q(w[i]) for w in WRAPPINGS) for i in (0, 1)), len(WRAPPINGS))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns behind one of our raw replies."""
    reply = F.get(F.array(*map(F.lit, REPLIES)), F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(REPLIES))).cast("int"))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.concat(reply, F.lit(" "), F.coalesce("text", F.lit(""))).alias("raw"))


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the mixing index and a score from it; written once, as several windows read them."""
    an = A.analyze(spread(conversations(spark, sf_dir)), FR)
    score = F.round(F.lit(10.0) - F.abs(F.col("cmi") - 0.2) * 8, 6)
    return cut(an.select("conv_id", "turn", F.col("role").alias("speaker"), "text", "cmi", "n_switches", score.alias("score"), F.lit(0.15).alias("base")), "turns")


TURNS_SQL = A.analysis_sql("conversations", FR) + ",\nt AS (SELECT conv_id, turn, role AS speaker, text, cmi, n_switches, round(10.0::DOUBLE - abs(cmi - 0.2::DOUBLE) * 8, 6) AS score, 0.15::DOUBLE AS base FROM a)"
_DIFF = "round(partner_mean - base, 9)"
_STEP = f"CASE WHEN {_DIFF} > 0.15::DOUBLE THEN 'strong_up' WHEN {_DIFF} > 0.05::DOUBLE THEN 'up' WHEN {_DIFF} < -0.15::DOUBLE THEN 'strong_down' WHEN {_DIFF} < -0.05::DOUBLE THEN 'down' ELSE '' END"
_HEARD = """h AS (SELECT *, list_transform(list_filter(list(struct_pack(s := speaker, c := cmi)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x.s <> speaker), lambda x: x.c) AS o FROM t),
ac AS (SELECT *, list_avg(o[-2:]) AS partner_mean FROM h)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: three in a row of a user make one turn."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("n", n - 1).select("user_id", F.floor(F.col("n") / 3).alias("turn"), (F.col("n") % 3 + 1).alias("attempt"), F.round(F.col("value") / 50, 6).alias("score"), "event_id")


ATTEMPTS_SQL = "att AS (SELECT user_id, n // 3 AS turn, n % 3 + 1 AS attempt, round(value / 50, 6) AS score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"
_BEST = """b0 AS (SELECT *, min(CASE WHEN score >= 6.0 THEN attempt END) OVER (PARTITION BY user_id, turn) AS stop FROM att),
b AS (SELECT * FROM b0 WHERE (stop IS NULL OR attempt <= stop) AND score > 0 QUALIFY row_number() OVER (PARTITION BY user_id, turn ORDER BY score DESC, attempt) = 1)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("ARC_0"), (F.pmod("user_id", F.lit(60)) + 1).cast("string")).alias("archetype"), F.col("event_type").alias("topic"), F.col("value").alias("score")
    )


BANK_SQL = "bank AS (SELECT event_id AS seq, 'ARC_0' || (user_id % 60 + 1) AS archetype, event_type AS topic, value AS score FROM events)"


def requests(spark: SparkSession) -> DataFrame:
    topics = F.get(F.array(*map(F.lit, ("click", "purchase", "none", "view"))), F.pmod("id", F.lit(4)).cast("int"))
    return spark.range(200).select(F.col("id").alias("req"), F.concat(F.lit("ARC_0"), (F.pmod("id", F.lit(70)) + 1).cast("string")).alias("archetype"), topics.alias("topic"))


REQUESTS_SQL = "req AS (SELECT i AS req, 'ARC_0' || (i % 70 + 1) AS archetype, (['click', 'purchase', 'none', 'view'])[i % 4 + 1] AS topic FROM range(200) r(i))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people of a region: one of ours with the nation's name."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    own = F.get(F.array(*map(F.lit, REGIONS)), F.pmod("c_custkey", F.lit(len(REGIONS))).cast("int"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.trim(F.concat(own, F.lit(" "), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.initcap("n_name")).otherwise(""))).alias("region"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions of a person: one of ours before each text."""
    k = F.pmod("doc_id", F.lit(len(PERSONA_TEXTS))).cast("int")
    text, job = (F.get(F.array(*[F.lit(p[i]) for p in PERSONA_TEXTS]), k) for i in (0, 1))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat(text, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"), job.alias("job"))


REGIONS_SQL = "(SELECT c_custkey AS id, trim(([" + ", ".join(map(_q, REGIONS)) + f"])[c_custkey % {len(REGIONS)} + 1] || ' ' || CASE WHEN c_custkey % 2 = 0 THEN list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) ELSE '' END) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)"
PEOPLE_SQL = "(SELECT doc_id AS id, ([" + ", ".join(_q(p[0]) for p in PERSONA_TEXTS) + f"])[doc_id % {len(PERSONA_TEXTS)} + 1] || ' ' || coalesce(text, '') AS text, ([" + ", ".join(_q(p[1]) for p in PERSONA_TEXTS) + f"])[doc_id % {len(PERSONA_TEXTS)} + 1] AS job FROM documents)"


def _pair_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each nation that has customers, with a language.yaml (a dimension: 25 small files), and what is found there."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    names = n.join(c, n.n_nationkey == c.c_nationkey, "left_semi").select(F.lower(F.regexp_replace("n_name", " ", "_")).alias("pair"))
    root = f"{run_dir(spark)}/pairs-{uuid.uuid4().hex}"
    config.write_files(spark, {f"{root}/{r.pair}_en/language.yaml": f"l1_code: {r.pair[:2]}\nl2_code: en\n" for r in names.collect()} | {f"{root}/no_pair/notes.txt": "x"})
    return config.pair_folders(spark, root)


def voice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, g, a, list(ls), c) for v, g, a, ls, c in V.VOICES], "voice string, gender string, age string, languages array<string>, accent string")


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as speakers."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), F.pmod("c_custkey", F.lit(by)).cast("int"))
    out = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.array(pick(("zh", "fr", "yue", "ms"), 4), pick(("en", "en", "en", "ta"), 4)).alias("languages"),
        *[pick(v, n).alias(f"{k}_{s}") for s, d in (("a", 0), ("b", 1)) for k, v, n in (("gender", ("female", "male", "unknown")[d:] + ("male",) * d, 3), ("age", ("young", "middle", "senior", "middle", "young"), 5), ("accent", ("mainland", "singapore", "", "hongkong"), 4))],
    )
    return out


_VOICE_SQL = "vo AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{g}', '{a}', {list(ls)}, '{c}')" for v, g, a, ls, c in V.VOICES) + ") v(voice, gender, age, languages, accent))"
_SPEAKERS_SQL = """sp AS (SELECT c_custkey AS id, [(['zh', 'fr', 'yue', 'ms'])[c_custkey % 4 + 1], (['en', 'en', 'en', 'ta'])[c_custkey % 4 + 1]] AS languages,
  (['female', 'male', 'unknown'])[c_custkey % 3 + 1] AS gender_a, (['young', 'middle', 'senior', 'middle', 'young'])[c_custkey % 5 + 1] AS age_a, (['mainland', 'singapore', '', 'hongkong'])[c_custkey % 4 + 1] AS accent_a,
  (['male', 'unknown', 'male'])[c_custkey % 3 + 1] AS gender_b, age_a AS age_b, accent_a AS accent_b FROM customer)"""


def _voice_sql(source: str, side: str, seed: int, exclude: str, out: str) -> str:
    return f"""{out} AS (SELECT * FROM (SELECT s.*, voice AS {out}_voice, list_has_any(s.languages, v.languages) AS shares,
  CASE WHEN list_contains(v.languages, s.languages[1]) THEN 16 WHEN list_has_any(s.languages, v.languages) THEN 4 ELSE 0 END + CASE WHEN s.gender_{side} <> 'unknown' AND s.gender_{side} = v.gender THEN 4 ELSE 0 END
  + CASE WHEN s.age_{side} = v.age THEN 2 ELSE 0 END + CASE WHEN s.accent_{side} <> '' AND s.accent_{side} = v.accent THEN 1 ELSE 0 END AS {out}_score FROM {source} s CROSS JOIN vo v WHERE {exclude})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY shares DESC, {out}_score DESC, md5('{seed}|' || id || '|' || {out}_voice) DESC) = 1)"""


def _contains_sum(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


def _accent_sql(region: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({region}), '{k}') THEN '{v}'" for k, v in V.REGION_ACCENT) + f" ELSE lower({region}) END"


#: Samples a second of the fake voice in the queries: it speaks every turn whole, so its sound is kept small.
RATE = 1000


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, voiced by the fake voice."""
    pieces = spread(conversations(spark, sf_dir)).select("conv_id", "turn", V.speech_pieces(F.col("text")).alias("pieces"))
    return providers.synthesize(pieces, partial(providers.fake_voice, rate=RATE), RATE).withColumn("pause_ms", F.lit(400))


def _picky_voice(text: str, rate: int):
    """The fake voice, which cannot ask."""
    if "?" in text:
        raise ValueError("no voice for questions")
    return providers.fake_voice(text, rate)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, ok, seconds: a dialogue is kept where all its turns were spoken."""
    pieces = spread(conversations(spark, sf_dir)).select("conv_id", "turn", V.speech_pieces(F.col("text")).alias("pieces"))
    spoken = providers.synthesize(pieces, partial(_picky_voice, rate=RATE), RATE, attempts=1)
    return spoken.groupBy("conv_id").agg(F.every(F.col("error").isNull()).alias("ok"), F.sum("seconds").alias("seconds"))


def _turn_prompts(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """Prompts of all turns with every block that the table can give."""
    frame = D.FRAMES[language]
    turns = D.history(scored_turns(spark, sf_dir))
    said = D.turn_instruction(F.col("turn"), F.lit(6), S.draw("close", 42, F.col("conv_id")), F.col("speaker"), frame)
    more = F.when(F.col("cmi") > 0.2, D.filled(frame["more"], level=F.lit("less mixed"))).otherwise("")
    return D.turn_prompt(
        turns.select("conv_id", "turn", F.lit("Two friends.").alias("context"), F.lit("").alias("topic_info"), F.lit("e.g. ok").alias("examples"), "history", more.alias("accommodation_text"), F.lit("Be brief.").alias("requirements"), said.alias("instruction")), frame
    ).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


def _speaker(u: Column) -> Column:
    """All that is known of a speaker, as a record."""
    mode = F.struct("level", F.round("effective_cmi", 3).alias("effective_cmi"))
    return F.to_json(F.struct("persona", "age_group", "region", "profession", "proficiency", "archetype", "cmi_lo", "cmi_hi", "topic", "relationship", "formality", "dialogue_type", "domain_words", mode.alias("language_mode"), F.round(S.tendency(F.lit("mixed"), u), 6).alias("accommodation_tendency")))


PERSONS = {"close_friends": "a good friend", "teacher_student": "a teacher", "strangers": "somebody just met"}


def _system(language: str) -> Column:
    place = D.situation(F.col("dialogue_type"), F.col("relationship"), F.col("topic"), PERSONS, D.FRAMES[language])
    role = F.concat(F.lit("A "), "profession", F.lit(" from "), "region", F.lit("."))
    names = {"l1_name": "Chinese", "l2_name": "English"}
    behaviour = D.told(F.col("archetype"), D.BEHAVIOURS, "ARC_01", domain=D.domain_context(F.col("topic"), F.col("domain_words")), **names)
    return D.system_prompt(role, D.told(F.col("proficiency"), D.PROFICIENCIES, **names), behaviour, F.lit(""), place, F.col("formality"), S.level_text(F.col("level"), "Chinese", "English"))


def queries() -> dict:
    dims = S.dimensions
    rows = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("row"))
    acc = lambda s, d, **k: D.accommodation(scored_turns(s, d), **k)
    return {
        "sa_profiles": lambda s, d: S.sample(rows(s, d), dims(s)).select(*_PROFILE),
        "sa1_weighted_choice": lambda s, d: S.sample(rows(s, d), dims(s)).groupBy("persona").agg(F.count(F.lit(1)).alias("n")),
        "sa3_archetype_given_persona": lambda s, d: S.sample(rows(s, d), dims(s)).groupBy("persona", "archetype").agg(F.count(F.lit(1)).alias("n")),
        "sa12_level_text": lambda s, d: S.sample(rows(s, d), dims(s)).select("row", S.level_text(F.col("level"), "Chinese", "English").alias("description")),
        "sa14_export": lambda s, d: S.sample(rows(s, d), dims(s)).select("row", _speaker(S.draw("tendency", 42, F.col("row"))).alias("record")),
        "sa15_speaker_pair": lambda s, d: S.speaker_pairs(rows(s, d), dims(s)),
        "sa16_tendency": lambda s, d: rows(s, d).withColumn("mode", F.get(F.array(*map(F.lit, ("convergent", "divergent", "mixed", "maintain"))), F.pmod("row", F.lit(4)).cast("int"))).select("row", "mode", F.round(S.tendency(F.col("mode"), S.draw("tendency", 42, F.col("row"))), 9).alias("tendency")),
        "dg1_alternation": lambda s, d: conversations(s, d).select("conv_id", "turn", F.when(F.pmod("turn", F.lit(2)) == 1, "A").otherwise("B").alias("speaker")),
        "dg3_partner_mean": lambda s, d: acc(s, d).select("conv_id", "turn", F.round("partner_mean", 9).alias("partner_mean")),
        "dg4_convergence": lambda s, d: acc(s, d).select("conv_id", "turn", "instruction"),
        "dg5_divergence": lambda s, d: acc(s, d, mode="divergent").select("conv_id", "turn", "instruction"),
        "dg6_mixed_mode": lambda s, d: acc(s, d, mode="mixed", tendency=0.6).groupBy("instruction").agg(F.count(F.lit(1)).alias("n")),
        "dg8_best_of_n": lambda s, d: _best(s, d).select("user_id", "turn", "attempt", "score", "event_id"),
        "dg9_turn_record": lambda s, d: scored_turns(s, d).select("conv_id", "turn", F.round("cmi", 3).alias("cmi"), F.col("n_switches").alias("switches"), "score"),
        "dg10_roll_up": lambda s, d: D.roll_up(scored_turns(s, d)).select("conv_id", "avg_score", "total_turns", F.get("turns", F.lit(0))["speaker"].alias("first_speaker")),
        "dg11_dialogue_id": lambda s, d: conversations(s, d).select("conv_id").distinct().select("conv_id", D.dialogue_id(42, F.col("conv_id")).alias("dialogue_id")),
        "dg12_counters": lambda s, d: _best(s, d).agg(F.countDistinct("user_id").alias("dialogues"), F.count(F.lit(1)).alias("turns"), F.sum(F.col("attempt") - 1).alias("retries")),
        "dg13_history": lambda s, d: D.history(scored_turns(s, d)).select("conv_id", "turn", F.md5("history").alias("history_md5")),
        "dg14_turn_instruction": lambda s, d: _instructions(s, d, "en"),
        "dg15_turn_prompt": lambda s, d: _turn_prompts(s, d, "en"),
        "dg15_turn_prompt_zh": lambda s, d: _turn_prompts(s, d, "zh"),
        "dg14_turn_instruction_zh": lambda s, d: _instructions(s, d, "zh"),
        "dg16_system_prompt": lambda s, d: S.sample(rows(s, d), dims(s)).select("row", _system("en").alias("prompt")),
        "dg17_clean_reply": lambda s, d: D.clean_reply(replies(s, d), "raw", "reply").select("conv_id", "turn", "reply"),
        "dg17_clean_turns": lambda s, d: D.clean_reply(raw_replies(s, d), "raw", "reply").select("conv_id", "turn", "reply"),
        "dg18_clean_reply_old": lambda s, d: D.clean_reply_old(replies(s, d), "raw", "reply").select("conv_id", "turn", "reply"),
        "dg18_clean_turns_old": lambda s, d: D.clean_reply_old(raw_replies(s, d), "raw", "reply").select("conv_id", "turn", "reply"),
        "dg19_speaker_record": lambda s, d: S.sample(rows(s, d).withColumn("draw", F.concat_ws(":", "row", F.lit("b"))), dims(s), row="draw").select("row", _speaker(S.draw("tendency", 42, F.col("draw"))).alias("speaker")),
        "dg20_dialogue_json": lambda s, d: _dialogue_records(s, d),
        "dg21_chat": lambda s, d: providers.chat(conversations(s, d).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt")), lambda prompt: f"<reply>{prompt}</reply>", keys=("conv_id", "turn")),
        "dg22_endpoint": lambda s, d: _endpoints(s, d, 3),
        "dg24_situation": lambda s, d: S.sample(rows(s, d), dims(s)).select("row", D.situation(F.col("dialogue_type"), F.col("relationship"), F.col("topic"), PERSONS).alias("situation")),
        "dg23_prompt_forms": lambda s, d: S.sample(rows(s, d), dims(s)).select("row", D.user_prompt(F.col("dialogue_type"), F.col("level"), S.draw("task", 42, F.col("row"))).alias("prompt")),
        "eb1_admit": lambda s, d: D.admit_examples(scored_turns(s, d), 9.0).select("conv_id", "turn", "score", "cmi", F.md5("context").alias("context_md5")),
        "eb2_bank_order": lambda s, d: _bank_read_back(s, d).select("seq", "archetype", F.md5("speaker_text").alias("text_md5"), "score"),
        "eb3_retrieve": lambda s, d: D.retrieve_examples(requests(s), bank(s, d), 3),
        "eb7_total": lambda s, d: D.admit_examples(scored_turns(s, d), 9.0).agg(F.count(F.lit(1)).alias("n")),
        "vo1_accent": lambda s, d: regions(s, d).select("id", V.accent(F.col("region")).alias("accent")),
        "vo2_gender_age": lambda s, d: people(s, d).select("id", V.gender(F.col("text")).alias("gender"), V.age_group(F.col("text"), F.col("job")).alias("age")),
        "vo6_best_voice": lambda s, d: V.best_voice(speakers(s, d).select("id", "languages", F.col("gender_a").alias("gender"), F.col("age_a").alias("age"), F.col("accent_a").alias("accent")), voice_table(s)).select("id", "voice", F.col("voice_score").cast("int").alias("voice_score")),
        "vo7_voice_pair": lambda s, d: V.voice_pairs(speakers(s, d), voice_table(s)),
        "vo8_by_language": lambda s, d: speakers(s, d).select(F.explode("languages").alias("language"), F.col("id").alias("voice")),
        "au1_speech_pieces": lambda s, d: conversations(s, d).select("conv_id", "turn", V.speech_pieces(F.col("text")).alias("p")).select("conv_id", "turn", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\n")).alias("pieces_md5")),
        "au2_synthesize": lambda s, d: _speech(s, d).select("conv_id", "turn", "seconds", F.length("wav").alias("n_bytes"), "error"),
        "au4_turn_file": lambda s, d: conversations(s, d).select("conv_id", "turn", V.turn_file(F.col("turn"), F.col("role")).alias("file")),
        "au7_silence": lambda s, d: conversations(s, d).select("conv_id", "turn", V.silence_samples(16000, 300 + F.pmod(F.col("conv_id") * 37 + F.col("turn") * 91, F.lit(501))).alias("n")),
        "au11_resample": lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", V.resample(F.col("embedding").cast("array<double>"), 1.5).alias("x")).select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
        "au12_durations": lambda s, d: V.assembled(conversations(s, d).select("conv_id", "turn", (F.length("text") * 800).cast("long").alias("n_samples"), (F.lit(300) + F.pmod(F.col("turn") * 37, F.lit(500))).alias("pause_ms"))),
        "au12_assemble": lambda s, d: audio.assemble(_speech(s, d), RATE).select("conv_id", "seconds", F.length("wav").alias("n_bytes")),
        "au13_all_turns": lambda s, d: _outcomes(s, d).select("conv_id", F.col("ok").alias("kept")),
        "au14_manifest": lambda s, d: config.manifest(_outcomes(s, d)).select("total", "success", "failed", "seconds"),
        "io11_list_pairs": lambda s, d: _pair_folders(s, d),
    }


def _bank_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good turns written as a bank in order, and read again."""
    good = D.admit_examples(scored_turns(spark, sf_dir), 9.0)
    lines = good.select(
        "conv_id", "turn", F.concat(F.lit("ARC_0"), (F.pmod("conv_id", F.lit(6)) + 1).cast("string")).alias("archetype_id"), F.col("speaker").alias("topic"), F.lit("casual").alias("formality"),
        F.coalesce("text", F.lit("")).alias("speaker_text"), F.col("score").alias("eval_score"), "cmi", F.col("context").alias("dialogue_context"),
    )
    path = f"{run_dir(spark)}/bank-{uuid.uuid4().hex}"
    config.write_json_lines(lines.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").drop("conv_id", "turn"), path)
    return config.read_examples(spark, path)


def _endpoints(spark: SparkSession, sf_dir: str, endpoints: int) -> DataFrame:
    """The endpoint of each turn's call: calls are counted over all dialogues in order, so the loads differ by one at most."""
    calls = in_ranges(conversations(spark, sf_dir).select("conv_id", "turn", F.struct("conv_id", "turn").alias("call")), "call")
    return place_in_order(calls, [], "call", "made").select("conv_id", "turn", D.endpoint(F.col("made"), endpoints).cast("int").alias("endpoint"))


def _instructions(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    said = D.turn_instruction(F.col("turn"), F.lit(6), S.draw("close", 42, F.col("conv_id")), F.col("role"), D.FRAMES[language])
    return conversations(spark, sf_dir).select("conv_id", "turn", said.alias("instruction"))


def _dialogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialogue's record: topic, its two speakers and their languages, what was looked up, and its turns."""
    speakers = S.speaker_pairs(conversations(spark, sf_dir).select(F.col("conv_id").alias("row")).distinct(), S.dimensions(spark)).withColumnRenamed("row", "conv_id")
    a, b = (F.struct(*[F.col(f"{k}_{side}").alias(k) for k in ("persona", "archetype", "effective_cmi")]).alias(f"speaker_{side}") for side in ("a", "b"))
    record = F.struct(
        D.dialogue_id(42, F.col("conv_id")).alias("dialogue_id"), F.lit("daily_life").alias("topic"), F.array(F.lit(FR.l1), F.lit(FR.l2)).alias("language_pair"), "avg_score", "total_turns", a, b,
        F.array(F.struct(F.lit("t").alias("title"), F.lit("s").alias("source"))).alias("injected_info"), "turns",
    )
    return D.roll_up(scored_turns(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))).join(speakers, "conv_id").select("conv_id", F.md5(F.to_json(record, {"ignoreNullFields": "false"})).alias("record_md5"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlex.operators.scoring import best_of

    return best_of(attempts(spark, sf_dir), ["user_id", "turn"], 6.0)


def oracle_sql() -> dict[str, str]:
    sa = S.sample_sql("(SELECT c_custkey AS row FROM customer)")
    acc = f"WITH {TURNS_SQL},\n{_HEARD}"
    tiers = " UNION ALL ".join(
        f"SELECT req, {tier} AS tier, rank, seq FROM req JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank, count(*) OVER (PARTITION BY {keys}) AS have FROM bank) x USING ({keys}) WHERE have >= {least} AND rank <= 3"
        for tier, keys, least, order in ((1, "archetype, topic", 3, "score DESC, seq"), (2, "archetype", 3, "score DESC, seq"), (3, "topic", 1, "score DESC, seq"), (4, "archetype, topic", 1, "seq"))
    )
    replies = "(SELECT conv_id, turn, ([" + ", ".join(map(_q, REPLIES)) + f"])[(conv_id * 5 + turn) % {len(REPLIES)} + 1] || ' ' || coalesce(text, '') AS raw FROM conversations)"
    clean = f"WITH {D.clean_reply_sql(replies, 'raw')} SELECT conv_id, turn, t AS reply FROM cl"
    old = f"WITH {D.clean_reply_old_sql(replies, 'raw')} SELECT conv_id, turn, t AS reply FROM co"
    voices = f"WITH {_VOICE_SQL},\n{_SPEAKERS_SQL},\n{_voice_sql('sp', 'a', 42, 'true', 'va')}"
    people = PEOPLE_SQL
    fem, mal = _contains_sum("lower(text)", V.FEMALE), _contains_sum("lower(text)", V.MALE)
    both = "lower(text || ' ' || job)"
    level = f"({S.LEVEL_SQL})"
    spoken = f"CASE {level} " + " ".join(f"WHEN {_q(k)} THEN {_q(v.format(l1_name='Chinese', l2_name='English'))}" for k, v in S.LEVEL_TEXT.items()) + " END"
    pair_a = S.sample_sql("(SELECT c_custkey AS row, c_custkey || ':a' AS draw FROM customer)", row="draw", name="pa")
    pair_b = S.sample_sql("(SELECT c_custkey AS row, i AS attempt, c_custkey || ':b:' || i AS draw FROM customer, range(1, 12) r(i))", row="draw", name="pb")
    past = "coalesce(string_agg(role || '：' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
    gap = "chr(10) || chr(10)"
    marks = V.SPEECH_MARKS
    parts = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^{marks}]*[{marks}]|[^{marks}]+'), lambda p: trim(p)), lambda p: p <> '')"
    joined = f"list_reduce(p, lambda a, x: CASE WHEN length(list_last(string_split(a, chr(1)))) + length(x) <= {V.PIECE} THEN a || x ELSE a || chr(1) || x END)"
    spoken_chars = "CASE WHEN len(p) > 0 THEN list_sum(list_transform(p, lambda x: length(x))) ELSE length(coalesce(text, '')) END"
    said = f"(SELECT conv_id, turn, {RATE // 20} * {spoken_chars} AS n FROM (SELECT *, {parts} AS p FROM conversations))"
    person = "CASE relationship " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PERSONS.items()) + " ELSE relationship END"
    place = f"CASE dialogue_type WHEN 'monologue' THEN 'talking alone about ' || topic WHEN 'dyadic' THEN 'talking with ' || {person} || ' about ' || topic ELSE 'talking with several ' || {person} || ' about ' || topic END"
    domain = "CASE WHEN domain_words <> '' THEN 'On ' || topic || ', words like ' || array_to_string(string_split(domain_words, ',')[1:5], ', ') || ' come naturally.' ELSE 'On ' || topic || ', a foreign word slips in now and then.' END"
    of_pair = {"l1_name": "'Chinese'", "l2_name": "'English'"}

    def told_sql(key: str, templates: dict[str, str], default: str, **values: str) -> str:
        def one(template: str) -> str:
            text = _q(template)
            for name, value in values.items():
                text = f"replace({text}, '{{{name}}}', {value})"
            return text

        return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {one(t)}" for k, t in templates.items()) + f" ELSE {one(templates[default]) if default else _q('')} END"

    behaves = told_sql("archetype", D.BEHAVIOURS, "ARC_01", domain=domain, **of_pair)
    proficient = told_sql("proficiency", D.PROFICIENCIES, "", **of_pair)
    names = ("persona", "age_group", "region", "profession", "proficiency", "archetype", "cmi_lo", "cmi_hi", "topic", "relationship", "formality", "dialogue_type", "domain_words")
    quoted = " || ',' || ".join(f"'\"{n}\":' || {n}" if n.startswith("cmi") else f"'\"{n}\":\"' || {n} || '\"'" for n in names)

    def record(key: str) -> str:
        mode = f"'\"language_mode\":{{\"level\":\"' || {level} || '\",\"effective_cmi\":' || round(effective_cmi, 3) || '}}'"
        return f"'{{' || {quoted} || ',' || {mode} || ',\"accommodation_tendency\":' || round(0.3::DOUBLE + {S.draw_sql('tendency', 42, key)} * 0.5, 6) || '}}'"

    def _filled(template: str, **values: str) -> str:
        text = _q(template)
        for name, value in values.items():
            text = f"replace({text}, '{{{name}}}', {value})"
        return text

    def instruction_of(language: str, name: str) -> str:
        frame = {k: _filled(v, name=name) for k, v in D.FRAMES[language].items()}
        return f"CASE WHEN turn = 1 THEN {frame['open']} WHEN turn = 6 AND {S.draw_sql('close', 42, 'conv_id')} < 0.2 THEN {frame['close']} WHEN turn = 6 THEN {frame['last']} ELSE {frame['middle']} END"

    def instructions(language: str) -> str:
        return f"SELECT conv_id, turn, {instruction_of(language, 'role')} AS instruction FROM conversations"

    def prompts(language: str) -> str:
        frame = D.FRAMES[language]
        more = f"CASE WHEN cmi > 0.2::DOUBLE THEN {_filled(frame['more'], level=_q('less mixed'))} || {gap} ELSE '' END"
        earlier = past.replace("role ||", "speaker ||")
        return f"""WITH {TURNS_SQL}, h AS (SELECT *, {earlier} AS h FROM t) SELECT conv_id, turn, md5('Two friends.' || {gap} || 'e.g. ok' || {gap} || CASE WHEN h <> '' THEN h || {gap} ELSE '' END || {more} || 'Be brief.' || {gap}
  || {instruction_of(language, 'speaker')} || {gap} || {_q(frame['rule'])}) AS prompt_md5 FROM h"""

    tasks, setups = ("[" + ", ".join(map(_q, x)) + "]" for x in (D.TASKS, D.SETUPS))
    u = S.draw_sql("task", 42, "row")
    length = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in D.LENGTHS[:-1]) + f" ELSE '{D.LENGTHS[-1][1]}' END || ' sentences'"
    en = D.FRAMES["en"]
    forms = (
        f"CASE WHEN dialogue_type = 'monologue' THEN {_filled(en['monologue'], task=f'({tasks})[floor({u} * {len(D.TASKS)})::INT + 1]', length=length)} "
        f"ELSE {_filled(en['dialogue'], setup=f'({setups})[floor({u} * {len(D.SETUPS)})::INT + 1]', rounds=_q(D.ROUNDS), length=length)} END"
    )
    sb = S.sample_sql("(SELECT c_custkey AS row, c_custkey || ':b' AS draw FROM customer)", row="draw", name="sb")
    conv_a = S.sample_sql("(SELECT conv_id AS row, conv_id || ':a' AS draw FROM (SELECT DISTINCT conv_id FROM conversations))", row="draw", name="pa")
    conv_b = S.sample_sql("(SELECT conv_id AS row, i AS attempt, conv_id || ':b:' || i AS draw FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 12) r(i))", row="draw", name="pb")
    speaker = lambda x: f"struct_pack(persona := {x}.persona, archetype := {x}.archetype, effective_cmi := {x}.effective_cmi)"
    dialogue = f"""WITH {TURNS_SQL},\n{conv_a},\n{conv_b}, sp AS (SELECT pb.row AS conv_id, {speaker('pa')} AS speaker_a, {speaker('pb')} AS speaker_b FROM pb JOIN pa ON pa.row = pb.row
  WHERE pa.persona <> pb.persona OR pa.archetype <> pb.archetype OR attempt = 11 QUALIFY row_number() OVER (PARTITION BY pb.row ORDER BY attempt) = 1),
r AS (SELECT conv_id, round(avg(score), 2) AS avg_score, count(*) AS total_turns, list(struct_pack(turn := turn, speaker := speaker, text := coalesce(text, ''), score := score) ORDER BY turn) AS turns FROM t GROUP BY conv_id)
SELECT conv_id, md5(CAST(to_json(struct_pack(dialogue_id := 'DLG_' || substr(md5('42_' || conv_id), 1, 12), topic := 'daily_life', language_pair := ['{FR.l1}', '{FR.l2}'], avg_score := avg_score, total_turns := total_turns, speaker_a := speaker_a,
  speaker_b := speaker_b, injected_info := [struct_pack(title := 't', source := 's')], turns := turns)) AS VARCHAR)) AS record_md5 FROM r JOIN sp USING (conv_id)"""
    return {
        "sa14_export": f"WITH {sa} SELECT row, {record('row')} AS record FROM sa",
        "dg19_speaker_record": f"WITH {sb} SELECT row, {record('draw')} AS speaker FROM sb",
        "dg20_dialogue_json": dialogue,
        "dg21_chat": "SELECT conv_id, turn, '<reply>' || coalesce(text, '') || '</reply>' AS reply, NULL::VARCHAR AS error FROM conversations",
        "dg23_prompt_forms": f"WITH {sa} SELECT row, {forms} AS prompt FROM sa",
        "au1_speech_pieces": f"SELECT conv_id, turn, len(s)::INT AS n_pieces, md5(array_to_string(s, chr(10))) AS pieces_md5 FROM (SELECT *, CASE WHEN len(p) > 0 THEN string_split({joined}, chr(1)) ELSE [coalesce(text, '')] END AS s FROM (SELECT *, {parts} AS p FROM conversations))",
        "au2_synthesize": f"SELECT conv_id, turn, round(n / {RATE}::DOUBLE, 3) AS seconds, (44 + 2 * n)::INT AS n_bytes, NULL::VARCHAR AS error FROM {said}",
        "au12_assemble": f"SELECT conv_id, round((sum(n) + (count(*) - 1) * {RATE * 400 // 1000}) / {RATE}::DOUBLE, 3) AS seconds, (44 + 2 * (sum(n) + (count(*) - 1) * {RATE * 400 // 1000}))::INT AS n_bytes FROM {said} GROUP BY conv_id",
        "sa12_level_text": f"WITH {sa} SELECT row, {spoken} AS description FROM sa",
        "sa15_speaker_pair": f"""WITH {pair_a},\n{pair_b} SELECT pb.row, pa.persona AS persona_a, pa.archetype AS archetype_a, pa.effective_cmi AS effective_cmi_a, attempt::INT AS attempt, pb.persona AS persona_b, pb.archetype AS archetype_b,
  pb.effective_cmi AS effective_cmi_b FROM pb JOIN pa ON pa.row = pb.row WHERE pa.persona <> pb.persona OR pa.archetype <> pb.archetype OR attempt = 11 QUALIFY row_number() OVER (PARTITION BY pb.row ORDER BY attempt) = 1""",
        "dg14_turn_instruction": instructions("en"),
        "dg15_turn_prompt": prompts("en"),
        "dg15_turn_prompt_zh": prompts("zh"),
        "dg14_turn_instruction_zh": instructions("zh"),
        "dg16_system_prompt": f"WITH {sa} SELECT row, 'A ' || profession || ' from ' || region || '.' || chr(10) || {proficient} || chr(10) || {behaves} || chr(10) || {place} || chr(10) || formality || chr(10) || {spoken} AS prompt FROM sa",
        "sa_profiles": f"WITH {sa} SELECT {', '.join(c for c in _PROFILE if c != 'level')}, {S.LEVEL_SQL} AS level FROM sa",
        "sa1_weighted_choice": f"WITH {sa} SELECT persona, count(*) AS n FROM sa GROUP BY ALL",
        "sa3_archetype_given_persona": f"WITH {sa} SELECT persona, archetype, count(*) AS n FROM sa GROUP BY ALL",
        "sa16_tendency": f"SELECT c_custkey AS row, (['convergent', 'divergent', 'mixed', 'maintain'])[c_custkey % 4 + 1] AS mode, round(([0.7, 0.2, 0.3 + {S.draw_sql('tendency', 42, 'c_custkey')} * 0.5, 0.0])[c_custkey % 4 + 1]::DOUBLE, 9) AS tendency FROM customer",
        "dg1_alternation": "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'A' ELSE 'B' END AS speaker FROM conversations",
        "dg3_partner_mean": acc + " SELECT conv_id, turn, round(partner_mean, 9) AS partner_mean FROM ac",
        "dg4_convergence": acc + f" SELECT conv_id, turn, {_STEP} AS instruction FROM ac",
        "dg5_divergence": acc + f" SELECT conv_id, turn, CASE WHEN {_DIFF} > 0.10::DOUBLE THEN 'down' WHEN {_DIFF} < -0.10::DOUBLE THEN 'up' ELSE '' END AS instruction FROM ac",
        "dg6_mixed_mode": acc + f" SELECT {_STEP} AS instruction, count(*) AS n FROM ac GROUP BY ALL",
        "dg8_best_of_n": f"WITH {ATTEMPTS_SQL},\n{_BEST} SELECT user_id, turn, attempt, score, event_id FROM b",
        "dg9_turn_record": f"WITH {TURNS_SQL} SELECT conv_id, turn, round(cmi, 3) AS cmi, n_switches AS switches, score FROM t",
        "dg10_roll_up": f"WITH {TURNS_SQL} SELECT conv_id, round(avg(score), 2) AS avg_score, count(*) AS total_turns, first(speaker ORDER BY turn) AS first_speaker FROM t GROUP BY ALL",
        "dg11_dialogue_id": "SELECT DISTINCT conv_id, 'DLG_' || substr(md5('42_' || conv_id), 1, 12) AS dialogue_id FROM conversations",
        "dg12_counters": f"WITH {ATTEMPTS_SQL},\n{_BEST} SELECT count(DISTINCT user_id) AS dialogues, count(*) AS turns, sum(attempt - 1)::BIGINT AS retries FROM b",
        "dg13_history": "SELECT conv_id, turn, md5(coalesce(string_agg(role || '：' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history_md5 FROM conversations",
        "dg17_clean_reply": clean,
        "dg17_clean_turns": f"WITH {D.clean_reply_sql(RAW_SQL, 'raw')} SELECT conv_id, turn, t AS reply FROM cl",
        "dg18_clean_turns_old": f"WITH {D.clean_reply_old_sql(RAW_SQL, 'raw')} SELECT conv_id, turn, t AS reply FROM co",
        "dg18_clean_reply_old": old,
        "dg22_endpoint": "SELECT conv_id, turn, ((rank() OVER (ORDER BY conv_id, turn) - 1) % 3)::INT AS endpoint FROM conversations",
        "dg24_situation": f"WITH {sa} SELECT row, {place} AS situation FROM sa",
        "eb1_admit": f"WITH {TURNS_SQL}, l AS (SELECT *, left(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 100) AS context FROM t) SELECT conv_id, turn, score, round(cmi, 3) AS cmi, md5(context) AS context_md5 FROM l WHERE score >= 9.0",
        "eb2_bank_order": f"WITH {TURNS_SQL} SELECT row_number() OVER (ORDER BY conv_id, turn) AS seq, 'ARC_0' || (conv_id % 6 + 1) AS archetype, md5(coalesce(text, '')) AS text_md5, score FROM t WHERE score >= 9.0",
        "eb3_retrieve": f"WITH {BANK_SQL},\n{REQUESTS_SQL},\nf AS ({tiers}) SELECT req, tier, rank, seq FROM f QUALIFY tier = min(tier) OVER (PARTITION BY req)",
        "eb7_total": f"WITH {TURNS_SQL} SELECT count(*) AS n FROM t WHERE score >= 9.0",
        "vo1_accent": f"SELECT id, {_accent_sql('region')} AS accent FROM {REGIONS_SQL}",
        "vo2_gender_age": f"SELECT id, CASE WHEN {fem} > {mal} THEN 'female' WHEN {mal} > {fem} THEN 'male' ELSE 'unknown' END AS gender, CASE WHEN {_contains_sum(both, V.YOUNG)} > 0 THEN 'young' WHEN {_contains_sum(both, V.SENIOR)} > 0 THEN 'senior' ELSE 'middle' END AS age FROM {people}",
        "vo6_best_voice": voices + " SELECT id, va_voice AS voice, va_score::INT AS voice_score FROM va",
        "vo7_voice_pair": voices + f",\n{_voice_sql('va', 'b', 43, 'voice <> va_voice', 'vb')} SELECT id, va_voice AS voice_a, vb_voice AS voice_b FROM vb".replace("shares,\n", "shares,\n"),
        "vo8_by_language": f"WITH {_SPEAKERS_SQL} SELECT unnest(languages) AS language, id AS voice FROM sp",
        "au4_turn_file": "SELECT conv_id, turn, 'turn_' || turn || '_' || role || '.wav' AS file FROM conversations",
        "au7_silence": "SELECT conv_id, turn, (16000 * (300 + (conv_id * 37 + turn * 91) % 501) // 1000)::BIGINT AS n FROM conversations",
        "au11_resample": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), i AS (SELECT vec_id, x, unnest(range(0, floor(len(x) / 1.5)::BIGINT)) AS k FROM e), p AS (SELECT *, k * 1.5::DOUBLE AS place, floor(k * 1.5)::BIGINT AS lo FROM i)\n"
        "SELECT vec_id, count(*)::INT AS n, round(sum(CASE WHEN lo + 1 < len(x) THEN x[lo + 1] * (1.0 - (place - lo)) + x[lo + 2] * (place - lo) ELSE x[lo + 1] END), 6) AS total FROM p GROUP BY vec_id",
        "au12_durations": "WITH t AS (SELECT conv_id, length(text) * 800 + CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN 0 ELSE 16000 * (300 + turn * 37 % 500) // 1000 END AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS n_samples, round(sum(n) / 16000::DOUBLE, 3) AS seconds, count(*) AS n_turns FROM t GROUP BY ALL",
        "au13_all_turns": "SELECT conv_id, bool_and(NOT contains(coalesce(text, ''), '?')) AS kept FROM conversations GROUP BY conv_id",
        "au14_manifest": f"WITH g AS (SELECT conv_id, bool_and(NOT contains(coalesce(text, ''), '?')) AS ok, sum(round(n / {RATE}::DOUBLE, 3)) AS seconds FROM {said.replace('SELECT conv_id, turn,', 'SELECT conv_id, turn, text,', 1)} GROUP BY conv_id) "
        "SELECT count(*) AS total, sum(ok::INT)::BIGINT AS success, sum((NOT ok)::INT)::BIGINT AS failed, round(sum(CASE WHEN ok THEN seconds END), 3) AS seconds FROM g",
        "io11_list_pairs": "SELECT DISTINCT replace(lower(n_name), ' ', '_') || '_en' AS pair FROM nation JOIN customer ON n_nationkey = c_nationkey",
    }
