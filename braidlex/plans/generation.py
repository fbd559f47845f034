"""Dialogues turn by turn: bulk-synchronous rounds with written state.

A round is one turn of all open dialogues at once. From the state of each
dialogue (what was said, how much each speaker mixed lately) come the
accommodation and the prompt; the client answers; the reply is cleaned and
evaluated; dialogues whose reply is empty or below the wanted score go into
the next attempt, all others wait. The best attempt becomes the turn, its
mixing index is observed, and the new state is written. A turn without any
scored attempt has failed: it is counted, and the dialogue goes on without it.

A round's table holds its turns and the state after it, so a run that was
interrupted goes on after its last complete round (``resume``): the client is
not asked again for what is written. All tables have one row a dialogue, and
a dialogue's state is as long as its turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlex.functions.lang import PAIRS, LanguagePair
from braidlex.operators import analysis as A
from braidlex.operators import dialogue as D
from braidlex.operators import sampling
from braidlex.operators import scoring as S
from braidlex.plans.tables import cut, run_dir, spread

#: asked(conv_id, prompt, call) and the round's number to (conv_id, reply, error); ``call`` counts a dialogue's calls from 1.
Answer = Callable[[DataFrame, int], DataFrame]
SPEAKER = ("archetype", "cmi_lo", "cmi_hi", "region")
_HEARD = 2


def evaluate(replies: DataFrame, pair: LanguagePair) -> DataFrame:
    """The evaluator's verdict on single texts: nothing has been accepted yet, so diversity is full."""
    alone = S.apply_steps(S.measured(A.analyze(replies, pair)), S.STEPS).withColumns({"is_copy": F.lit(False), "diversity": F.lit(10.0)})
    return S.apply_steps(alone, S.VERDICT)


def opened(dialogues: DataFrame) -> DataFrame:
    """dialogues(conv_id, formality, wanted, and SPEAKER for the sides _a and _b) with the state before the first turn."""
    return dialogues.withColumns({
        "said": F.array().cast("array<string>"), "heard_a": F.array().cast("array<double>"), "heard_b": F.array().cast("array<double>"),
        "calls": F.lit(0), "retries": F.lit(0), "failed": F.lit(0),
    })


def asked(state: DataFrame, round_: int, turns: int, mode: str, frame: dict[str, str], history_lines: int | None, seed: int) -> DataFrame:
    """The state plus the speaker's own columns and the prompt of this turn."""
    side, other = ("a", "b") if round_ % 2 else ("b", "a")
    heard = F.col(f"heard_{other}")
    mean = F.when(F.size(heard) > 0, F.aggregate(heard, F.lit(0.0), lambda total, x: total + x) / F.size(heard))
    said = F.col("said") if history_lines is None else F.slice(F.col("said"), F.greatest(F.size("said") - history_lines + 1, F.lit(1)), F.lit(history_lines))
    own = state.withColumns({name: F.col(f"{name}_{side}") for name in SPEAKER})
    told = D.instruction(F.round(mean - (F.col("cmi_lo") + F.col("cmi_hi")) / 2, 9), mode)
    parts = own.withColumns({
        "history": F.array_join(said, "\n"), "accommodation_text": D.accommodation_text(told, frame),
        "instruction": D.turn_instruction(F.lit(round_), F.lit(turns), sampling.draw("close", seed, F.col("conv_id")), F.lit(side.upper()), frame),
    })
    return D.turn_prompt(parts, frame).drop("history", "accommodation_text", "instruction")


def attempt(waiting: DataFrame, number: int, round_: int, answer: Answer, pair: LanguagePair) -> DataFrame:
    """One call for each waiting dialogue: conv_id, attempt, outcome (error, empty or scored), text, score, decision, cmi, switches."""
    speaker = "A" if round_ % 2 else "B"
    replies = answer(waiting.select("conv_id", "prompt", (F.col("calls") + number).alias("call")), round_).select("conv_id", "reply", "error")
    cleaned = D.clean_reply(replies, "reply", "text", speaker)
    profile = waiting.select("conv_id", "formality", "wanted", *SPEAKER)
    judged = evaluate(cleaned.join(profile, "conv_id"), pair)
    scored = F.col("reply").isNotNull() & (F.col("text") != "")
    kept = {"text": F.col("text"), "score": F.col("final_score"), "decision": F.col("decision"), "cmi": F.col("cmi"), "switches": F.col("n_switches")}
    outcome = F.when(F.col("reply").isNull(), "error").when(F.col("text") == "", "empty").otherwise("scored")
    return judged.select("conv_id", F.lit(number).alias("attempt"), outcome.alias("outcome"), *[F.when(scored, value).alias(name) for name, value in kept.items()])


def play(state: DataFrame, round_: int, turns: int, answer: Answer, pair: LanguagePair, attempts: int, least: float, mode: str, frame: dict[str, str], history_lines: int | None, seed: int) -> DataFrame:
    """The turn of one round and the state after it."""
    state = state.drop("turn", "prompt_md5")  # of the round before
    everyone = cut(asked(state, round_, turns, mode, frame, history_lines, seed), "asked")
    waiting, tried = everyone, []
    for number in range(1, attempts + 1):
        tried.append(cut(attempt(waiting, number, round_, answer, pair), "attempt"))
        done = tried[-1].filter(F.col("score") >= least).select("conv_id")
        waiting = waiting.join(done, "conv_id", "left_anti")
        if number < attempts and waiting.isEmpty():
            break
    # at most ``attempts`` rows a dialogue
    every = reduce(DataFrame.unionByName, tried)
    below = (F.col("outcome") == "empty") | F.coalesce(F.col("score") < least, F.lit(False))
    best = F.max_by(F.struct("attempt", "text", "score", "decision", "cmi", "switches"), F.when(F.col("score") > 0, F.struct("score", -F.col("attempt"))))
    found = every.groupBy("conv_id").agg(F.max("attempt").alias("made"), F.sum(below.cast("int")).alias("below"), F.when(F.max("score") > 0, best).alias("turn"))
    side = "a" if round_ % 2 else "b"
    got, cmi = F.col("turn").isNotNull(), F.col("turn.cmi")
    said = F.concat(F.col("said"), F.array(F.concat(F.lit(f"{side.upper()}："), F.col("turn.text"))))
    heard = F.concat(F.col(f"heard_{side}"), F.array(cmi))
    after = everyone.join(found, "conv_id").withColumns({
        "said": F.when(got, said).otherwise(F.col("said")),
        f"heard_{side}": F.when(got, F.slice(heard, F.greatest(F.size(heard) - _HEARD + 1, F.lit(1)), F.lit(_HEARD))).otherwise(F.col(f"heard_{side}")),
        "calls": F.col("calls") + F.col("made"), "retries": F.col("retries") + F.col("below").cast("int"), "failed": F.col("failed") + (~got).cast("int"), "prompt_md5": F.md5("prompt"),
    })
    return after.select(*state.columns, "turn", "prompt_md5")


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def generate(
    dialogues: DataFrame, answer: Answer, pair: LanguagePair, turns: int = 8, attempts: int = 3, least: float = 6.0, mode: str = "convergent",
    frame: dict[str, str] = D.FRAMES["en"], history_lines: int | None = None, seed: int = 42, folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The turns of all dialogues, and one row a dialogue with its counters.

    ``dialogues``: conv_id (unique, not null), formality, wanted, and archetype,
    cmi_lo, cmi_hi, region for the sides _a and _b. Turns: conv_id, turn,
    speaker, attempt, text, score, decision, cmi (three digits), switches,
    prompt_md5; a turn that failed has no row. Counters: conv_id, total_turns,
    avg_score, calls, retries (replies that were empty or too low), failed;
    dialogues without a turn are in the counters only. With ``folder`` (a
    place that all executors share) the rounds are kept there, and a call with
    the same folder goes on after its last complete round.
    """
    spark = dialogues.sparkSession
    root = folder or f"{run_dir(spark)}/dialogues-{uuid.uuid4().hex}"
    state = opened(dialogues)
    rounds = []
    for round_ in range(1, turns + 1):
        path = f"{root}/round={round_}"
        if not _complete(spark, path):
            play(state, round_, turns, answer, pair, attempts, least, mode, frame, history_lines, seed).write.mode("overwrite").parquet(path)
        state = spark.read.parquet(path)
        rounds.append(state.filter("turn is not null").select("conv_id", F.lit(round_).alias("number"), F.lit("A" if round_ % 2 else "B").alias("speaker"), "turn", "prompt_md5"))
    spoken = reduce(DataFrame.unionByName, rounds)
    out = spoken.select(
        "conv_id", F.col("number").alias("turn"), "speaker", "turn.attempt", "turn.text", "turn.score", "turn.decision", F.round("turn.cmi", 3).alias("cmi"), "turn.switches", "prompt_md5"
    )
    in_turn = F.sort_array(F.collect_list(F.struct("turn", "score")))
    totals = out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total_turns"), in_turn.alias("turns")).withColumn("avg_score", D.mean_score(F.col("turns.score"))).drop("turns")
    counters = state.select("conv_id", "calls", "retries", "failed").join(totals, "conv_id", "left").withColumn("total_turns", F.coalesce("total_turns", F.lit(0)))
    return out, counters.select("conv_id", "total_turns", "avg_score", "calls", "retries", "failed")


# The registered run: recorded turns as the client's answers, one after the other.

FR = PAIRS["fr_en"]
TURNS, ATTEMPTS, LEAST = 4, 3, 6.0
_FORMALITY, _REGIONS, _WANTED = ("casual", "semi_formal", "formal"), ("singapore", "malaysia", "hongkong", ""), ("report", "the", "question", "with")


def _speakers(conv_id: Column) -> dict[str, Column]:
    out = {}
    for side, shift in (("a", 0), ("b", 2)):
        k = F.pmod(conv_id + shift, F.lit(6)).cast("int")
        lows, highs = (F.array(*[F.lit(r[i]) for r in S.ARCHETYPE_CMI.values()]) for i in (0, 1))
        region = F.get(F.array(*map(F.lit, _REGIONS)), F.pmod(conv_id + shift, F.lit(4)).cast("int"))
        out |= {f"archetype_{side}": F.concat(F.lit("ARC_0"), (k + 1).cast("string")), f"cmi_lo_{side}": F.get(lows, k), f"cmi_hi_{side}": F.get(highs, k), f"region_{side}": region}
    return out


def recorded_dialogues(conversations: DataFrame) -> DataFrame:
    ids = conversations.filter("conv_id is not null").select("conv_id").distinct()
    formality = F.get(F.array(*map(F.lit, _FORMALITY)), F.pmod("conv_id", F.lit(3)).cast("int"))
    return ids.withColumns({"formality": formality, "wanted": F.array(*map(F.lit, _WANTED)), **_speakers(F.col("conv_id"))})


def replay(conversations: DataFrame) -> Answer:
    """A client that answers a dialogue's n-th call with its n-th recorded turn, and fails where there is none."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    script = cut(conversations.select("conv_id", number.alias("call"), F.coalesce("text", F.lit("")).alias("reply")), "script")

    def answer(prompts: DataFrame, round_: int) -> DataFrame:
        told = prompts.join(script, ["conv_id", "call"], "left")
        return told.select("conv_id", "reply", F.when(F.col("reply").isNull(), "nothing recorded").alias("error"))

    return answer


def recorded_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conversations = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return generate(recorded_dialogues(conversations), replay(conversations), FR, TURNS, ATTEMPTS, LEAST)


def _run_sql() -> str:
    """The run as recursive SQL: outcomes of every place of the script under both speakers first, then one row a round."""
    def _q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    lows, highs = (", ".join(f"{r[i]}::DOUBLE" for r in S.ARCHETYPE_CMI.values()) for i in (0, 1))
    sides = "\nUNION ALL ".join(
        f"SELECT *, '{side.upper()}' AS side, 'ARC_0' || ((conv_id + {shift}) % 6 + 1) AS archetype, ([{lows}])[(conv_id + {shift}) % 6 + 1] AS cmi_lo, ([{highs}])[(conv_id + {shift}) % 6 + 1] AS cmi_hi, "
        f"({list(_REGIONS)})[(conv_id + {shift}) % 4 + 1] AS region FROM cl{side}"
        for side, shift in (("a", 0), ("b", 2))
    )
    frame = D.FRAMES["en"]
    named = lambda key: "replace(" + _q(frame[key]) + ", '{name}', nx.side)"
    instruction = (
        f"CASE WHEN nx.round = 1 THEN {named('open')} WHEN nx.round = {TURNS} AND {sampling.draw_sql('close', 42, 'nx.conv_id')} < 0.2 THEN {named('close')} "
        f"WHEN nx.round = {TURNS} THEN {named('last')} ELSE {named('middle')} END"
    )
    diff = "round(list_avg(nx.heard) - nx.base, 9)"
    told = f"CASE WHEN {diff} > 0.15::DOUBLE THEN {_q(frame['strong_up'])} WHEN {diff} > 0.05::DOUBLE THEN {_q(frame['up'])} WHEN {diff} < -0.15::DOUBLE THEN {_q(frame['strong_down'])} WHEN {diff} < -0.05::DOUBLE THEN {_q(frame['down'])} ELSE '' END"
    gap = "chr(10) || chr(10)"
    prompt = f"CASE WHEN len(nx.said) > 0 THEN array_to_string(nx.said, chr(10)) || {gap} ELSE '' END || CASE WHEN {told} <> '' THEN {told} || {gap} ELSE '' END || {instruction} || {gap} || {_q(frame['rule'])}"
    steps = ",\n".join([A.analysis_sql("src", FR), S.measured_sql("a"), S.steps_sql("m", S.STEPS, "s"), "s1 AS (SELECT *, false AS is_copy, 10.0::DOUBLE AS diversity FROM s)", S.steps_sql("s1", S.VERDICT, "v")])
    base = "(list_avg([([{0}])[(r.conv_id + shift) % 6 + 1], ([{1}])[(r.conv_id + shift) % 6 + 1]]))".format(lows, highs)
    return f"""WITH RECURSIVE rec AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, coalesce(text, '') AS raw FROM conversations WHERE conv_id IS NOT NULL),
{D.clean_reply_sql('rec', 'raw', 'A', 'cla')},
{D.clean_reply_sql('rec', 'raw', 'B', 'clb')},
src AS (SELECT conv_id, n, side, t AS text, archetype, cmi_lo, cmi_hi, region, ({list(_FORMALITY)})[conv_id % 3 + 1] AS formality, {list(_WANTED)} AS wanted FROM ({sides})),
{steps},
c AS (SELECT conv_id, side, n, text, CASE WHEN text <> '' THEN final_score END AS score, decision, cmi, n_switches FROM v),
w AS (SELECT x.side, x.conv_id, x.n - 1 AS p, c.n, c.text, c.score, c.decision, c.cmi, c.n_switches, min(CASE WHEN c.score >= {LEAST} THEN c.n END) OVER (PARTITION BY x.conv_id, x.side, x.n) AS stop
  FROM c x JOIN c ON c.conv_id = x.conv_id AND c.side = x.side AND c.n BETWEEN x.n AND x.n + {ATTEMPTS - 1}),
o AS (SELECT conv_id, side, p, coalesce(min(stop), p + {ATTEMPTS}) AS next, sum((coalesce(score, 0) < {LEAST})::INT) AS below,
  arg_max(struct_pack(attempt := (n - p)::INT, text := text, score := score, decision := decision, cmi := cmi, switches := n_switches), struct_pack(s := score, n := -n)) FILTER (WHERE score > 0) AS turn
  FROM w WHERE stop IS NULL OR n <= stop GROUP BY conv_id, side, p),
r AS (
  SELECT DISTINCT conv_id, 0 AS round, 0::BIGINT AS calls, 0::BIGINT AS retries, 0 AS failed, []::VARCHAR[] AS said, []::DOUBLE[] AS heard_a, []::DOUBLE[] AS heard_b, NULL::STRUCT(attempt INT, text VARCHAR, score DOUBLE, decision VARCHAR, cmi DOUBLE, switches INT) AS turn, '' AS prompt_md5 FROM rec
  UNION ALL
  SELECT nx.conv_id, nx.round, coalesce(o.next, nx.calls + {ATTEMPTS}), nx.retries + coalesce(o.below, 0), nx.failed + (o.turn IS NULL)::INT,
    CASE WHEN o.turn IS NULL THEN nx.said ELSE list_append(nx.said, nx.side || '：' || o.turn.text) END,
    CASE WHEN o.turn IS NULL OR nx.side = 'B' THEN nx.heard_a ELSE list_append(nx.heard_a, o.turn.cmi)[-{_HEARD}:] END,
    CASE WHEN o.turn IS NULL OR nx.side = 'A' THEN nx.heard_b ELSE list_append(nx.heard_b, o.turn.cmi)[-{_HEARD}:] END, o.turn, md5({prompt})
  FROM (SELECT r.*EXCLUDE (round, turn, prompt_md5), round + 1 AS round, CASE WHEN round % 2 = 0 THEN 'A' ELSE 'B' END AS side, CASE WHEN round % 2 = 0 THEN heard_b ELSE heard_a END AS heard,
    {base.replace('shift', '(CASE WHEN round % 2 = 0 THEN 0 ELSE 2 END)')} AS base FROM r WHERE round < {TURNS}) nx
  LEFT JOIN o ON o.conv_id = nx.conv_id AND o.side = nx.side AND o.p = nx.calls)"""


def queries() -> dict:
    def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, _ = recorded_run(spark, sf_dir)
        return out.select("conv_id", "turn", "speaker", "attempt", F.md5("text").alias("text_md5"), "score", "decision", "cmi", "switches", "prompt_md5")

    return {"dg_run": turns, "dg12_run_counters": lambda s, d: recorded_run(s, d)[1]}


def oracle_sql() -> dict[str, str]:
    run = _run_sql()
    counters = f"""SELECT r.conv_id, coalesce(total_turns, 0)::BIGINT AS total_turns, avg_score, calls::INT AS calls, retries::INT AS retries, failed
FROM r LEFT JOIN (SELECT conv_id, count(*) AS total_turns, round(avg(turn.score), 2) AS avg_score FROM r WHERE turn IS NOT NULL GROUP BY conv_id) t USING (conv_id) WHERE round = {TURNS}"""
    turns = """SELECT conv_id, round AS turn, CASE WHEN round % 2 = 1 THEN 'A' ELSE 'B' END AS speaker, turn.attempt AS attempt, md5(turn.text) AS text_md5, turn.score AS score, turn.decision AS decision,
round(turn.cmi, 3) AS cmi, turn.switches AS switches, prompt_md5 FROM r WHERE turn IS NOT NULL"""
    return {"dg_run": f"{run}\n{turns}", "dg12_run_counters": f"{run}\n{counters}"}
