"""The turn loop against a plain loop, runs that are interrupted and go on, and calls side by side."""

import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from braidlex.functions.lang import PAIRS
from braidlex.plans import generation as G
from braidlex.sources import providers

FR = PAIRS["fr_en"]
TEXTS = ["we go avec vous to the market", "nothing but english here", "le report est pour the meeting and nous avons a question", "", "<reply>je pense que the data is not good for us</reply>", "Let me think about it", "bonjour the team, on va regarder the report with you", "oui we can pas de problem"]


def conversations(spark):
    rows = [(c, t, "user", TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(1, 7) for t in range(1, 9 if c != 5 else 2)] + [(9, 1, "user", ""), (9, 2, "user", None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain_loop(spark, table, turns, attempts, least):
    """The same run one dialogue, turn and attempt after the other; single texts are judged by the evaluator itself."""
    script = {}
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        script.setdefault(r.conv_id, []).append(r.text or "")
    profiles = {r.conv_id: r for r in G.recorded_dialogues(table).collect()}
    asked = []
    for conv_id, texts in script.items():
        asked += [(conv_id, n, side, text) for n, text in enumerate(texts) for side in "ab"]
    raw = spark.createDataFrame(asked, "conv_id long, n int, side string, raw string")
    from braidlex.operators import dialogue as D

    cleaned = D.clean_reply(raw, "raw", "text", "A").filter("side = 'a'").unionByName(D.clean_reply(raw, "raw", "text", "B").filter("side = 'b'"))
    own = {name: F.expr(f"CASE side WHEN 'a' THEN {name}_a ELSE {name}_b END") for name in G.SPEAKER}
    judged = {(r.conv_id, r.n, r.side): r for r in G.evaluate(cleaned.join(G.recorded_dialogues(table), "conv_id").withColumns(own), FR).collect()}
    turns_out, counters = [], {}
    for conv_id, texts in script.items():
        calls = retries = failed = 0
        for turn in range(1, turns + 1):
            best = None
            for attempt in range(1, attempts + 1):
                calls += 1
                if calls > len(texts):
                    continue
                r = judged[conv_id, calls - 1, "a" if turn % 2 else "b"]
                score = r.final_score if r.text else None
                if score and (best is None or score > best[1]):
                    best = (attempt, score, r.text, r.decision, r.n_switches)
                if score is not None and score >= least:
                    break
                retries += 1
            if best is None:
                failed += 1
            else:
                turns_out.append((conv_id, turn, "A" if turn % 2 else "B", *best))
        counters[conv_id] = (calls, retries, failed, sum(t[0] == conv_id for t in turns_out))
    assert set(profiles) == set(script)
    return sorted(turns_out), counters


@pytest.mark.parametrize("least", [6.0, 9.0])
def test_rounds_are_the_plain_loop(spark, least):
    table = conversations(spark)
    turns, counters = G.generate(G.recorded_dialogues(table), G.replay(table), FR, turns=3, attempts=2, least=least)
    want, counted = plain_loop(spark, table, 3, 2, least)
    assert sorted((r.conv_id, r.turn, r.speaker, r.attempt, r.score, r.text, r.decision, r.switches) for r in turns.collect()) == want and want
    assert {r.conv_id: (r.calls, r.retries, r.failed, r.total_turns) for r in counters.collect()} == counted
    assert counted[9] == (6, 2, 3, 0)  # two empty replies, then nothing recorded: every turn failed


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    table = conversations(spark)
    whole, _ = G.generate(G.recorded_dialogues(table), G.replay(table), FR, turns=3, attempts=2)
    asked = []

    def breaking(prompts, round_, broken=3, inner=G.replay(table)):
        asked.append(round_)
        if round_ == broken:
            raise ConnectionError("the client is gone")
        return inner(prompts, round_)

    run = partial(G.generate, G.recorded_dialogues(table), pair=FR, turns=3, attempts=2, folder=str(tmp_path / "run"))
    with pytest.raises(ConnectionError):
        run(answer=breaking)
    assert set(asked) == {1, 2, 3}
    asked.clear()
    turns, _ = run(answer=partial(breaking, broken=0))
    assert set(asked) == {3} and sorted(turns.collect()) == sorted(whole.collect())
    asked.clear()
    assert sorted(run(answer=breaking)[0].collect()) == sorted(whole.collect()) and not asked
    assert G.generate(G.recorded_dialogues(table.limit(0)), G.replay(table), FR, turns=1)[1].count() == 0


def test_prompts_hold_what_was_said(spark):
    table = conversations(spark).filter("conv_id = 1")
    seen = {}

    def watching(prompts, round_, inner=G.replay(table)):
        seen.setdefault(round_, []).extend(r.prompt for r in prompts.collect())
        return inner(prompts, round_)

    turns, _ = G.generate(G.recorded_dialogues(table), watching, FR, turns=3, attempts=2, history_lines=1)
    said = {r.turn: f"{r.speaker}：{r.text}" for r in turns.collect()}
    earlier = [t for t in said if t < 3]
    assert said[max(earlier)] in seen[3][0] and all(said[t] not in seen[3][0] for t in earlier[:-1])
    assert "Mix " in "".join(p for r in (2, 3) for p in seen[r])


def test_calls_side_by_side(spark):
    """Eight slow calls take the time of one, in order; a call beyond its time counts as failed; endpoints take turns."""
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "id long, prompt string").coalesce(1)

    def slow(prompt):
        time.sleep(1.0)
        return prompt.upper()

    began = time.perf_counter()
    rows = providers.chat(prompts, slow, parallel=8).collect()
    assert time.perf_counter() - began < 5 and [(r.id, r.reply) for r in rows] == [(i, f"P{i}") for i in range(8)]

    def stuck(prompt):
        if prompt == "p3":
            threading.Event().wait(30)
        return prompt

    began = time.perf_counter()
    rows = providers.chat(prompts, stuck, attempts=1, seconds=0.5).collect()
    assert time.perf_counter() - began < 15 and [r.id for r in rows if r.error] == [3] and "within 0.5 seconds" in rows[3].error

    def flaky(prompt, endpoint):
        if prompt in ("p1", "p5") and endpoint == 0:
            raise RuntimeError("down")
        return f"{endpoint}"

    rows = providers.chat(prompts, flaky, endpoints=3, parallel=1).collect()
    used = [int(r.reply) for r in rows]
    assert [r.endpoint for r in rows] == used and all(r.error is None for r in rows)
    calls = sum(r.calls for r in rows)
    loads = [sum(1 for k in range(calls) if k % 3 == e) for e in range(3)]
    assert max(loads) - min(loads) <= 1 and calls >= 8
