"""The engine against hand-computed fixtures, an independent character loop, and invariants."""

import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlex.functions import audio
from braidlex.functions.lang import FRENCH_WORDS, PAIRS
from braidlex.operators import analysis as A
from braidlex.operators import dialogue as D
from braidlex.operators import retrieval as R
from braidlex.operators import sampling as S
from braidlex.operators import scoring as Q
from braidlex.operators import voice as V
from braidlex.plans import evaluation as E
from braidlex.plans import registry
from braidlex.plans import ranks, tables
from braidlex.sources import config, providers
from braidlex.streaming import stateful

#: Hand-computed: tokens, first language, second, switches within and between sentences, mixing index.
EXPECTED = [
    (14, 10, 2, 4, 0, 0.1667), (9, 4, 3, 0, 1, 0.4286), (8, 8, 0, 0, 0, 0.0), (4, 0, 4, 0, 0, 0.0), (0, 0, 0, 0, 0, 0.0), (3, 0, 0, 0, 0, 0.0), (7, 2, 2, 3, 0, 0.5), (11, 5, 3, 1, 3, 0.375),
    (9, 5, 3, 4, 0, 0.375), (10, 6, 4, 4, 0, 0.4),
]


def test_fixture(spark):
    rows = A.analyze(E.fixture(spark), E.ZH).orderBy("doc_id").collect()
    got = [(r.n_tokens, r.n1, r.n2, r.n_intra, r.n_inter, round(r.cmi, 4)) for r in rows]
    assert got[:10] == EXPECTED


def loop(text, is_l1):
    """Tokens (text, kind) by a character loop, segments, and switches (kind)."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif is_l1(c):
            out.append((c, "1"))
            i += 1
        elif c.isascii() and c.isalpha():
            j = i
            while j < len(text) and text[j].isascii() and text[j].isalpha():
                j += 1
            out.append((text[i:j], "2"))
            i = j
        elif c.isdigit():
            j = i
            while j < len(text) and text[j].isdigit():
                j += 1
            out.append((text[i:j], "n"))
            i = j
        else:
            out.append((c, "p"))
            i += 1
    segments, now = [], None
    for token, kind in out:
        if kind in "12" and now not in (None, kind):
            segments.append([])
        if kind in "12":
            now = kind
        if not segments:
            segments.append([])
        segments[-1].append(token)
    inter = sum(s[-1][-1] in "。！？.!?" for s in segments[:-1])
    return out, segments, inter


def test_random_texts(spark):
    r = random.Random(1)
    alphabet = "我你他好。！，.!? 12abC \n（"
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    analyzed = A.analyze(df, PAIRS["zh_en"])
    rows = {x.doc_id: x for x in analyzed.collect()}
    segs = A.segments(analyzed, ["doc_id"], PAIRS["zh_en"]).orderBy("doc_id", "seg").collect()
    for i, text in enumerate(texts):
        tokens, segments, inter = loop(text or "", lambda c: "一" <= c <= "鿿")
        x = rows[i]
        assert x.toks == [t for t, _ in tokens]
        assert (x.n1, x.n2) == (sum(k == "1" for _, k in tokens), sum(k == "2" for _, k in tokens))
        assert [s.text for s in segs if s.doc_id == i] == ["".join(s) for s in segments]
        assert x.n_inter == (inter if x.n_content else 0) and 0 <= x.cmi <= 0.5 and len(x.motives) == x.n_switches


def test_lexicon_mode(spark):
    df = spark.createDataFrame([(0, "Le meeting est très long, étrange!")], "doc_id long, text string")
    row = A.analyze(df, PAIRS["fr_en"]).first()
    assert (row.n1, row.n2) == (3, 3) and "le" in FRENCH_WORDS


def test_verdict(spark):
    rows = {r.doc_id: r for r in E.verdicts(E.fixture(spark), E.ZH).collect()}
    assert all(rows[i].decision == "fail" and rows[i].final_score == 0 for i in (2, 3, 4, 5, 12, 13))
    assert all(0 <= getattr(r, c) <= 10 for r in rows.values() for c in Q.WEIGHTS)
    assert all((r.veto == "") == (r.final_score > 0) for r in rows.values())


def test_later_copy_is_vetoed(spark):
    text = "我们 today 一起 go 吃饭 okay 吗"
    df = spark.createDataFrame([(1, text), (2, "别的 text 在 here 呢 now"), (3, text.upper() + "\n")], "doc_id long, text string")
    rows = {r.doc_id: r for r in E.verdicts(df, E.ZH).collect()}
    assert not rows[1].is_copy and not rows[2].is_copy and rows[3].is_copy and rows[3].veto == "diversity: copy"


@pytest.mark.parametrize("size", [500_000, 40])
def test_places(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    r = random.Random(2)
    rows = [(r.randrange(10**6), r.choice("ab")) for _ in range(500)] + [(10**15, "a")]  # one key far out
    rows = list({k: g for k, g in rows}.items())
    ranged = ranks.in_ranges(spark.createDataFrame(rows, "k long, g string"), "k")
    assert ranged.select("__range").distinct().count() == max(1, -(-len(rows) // size))
    out = ranks.place_in_order(ranged, ["g"], "k", "n").collect()
    assert all(x.n == sum(g == x.g and k < x.k for k, g in rows) for x in out)


def test_language_mode(spark):
    """Midpoint of the range, plus the topic's and the register's shift."""
    for mid, shift, formality, want, name in ((0.35, -0.05, 0, 0.30, "moderate"), (0.575, 0, 0, 0.575, "dense"), (0.15, 0.08, 0.05, 0.28, "moderate")):
        got = spark.range(1).select(S.level(F.lit(round(mid + shift + formality, 6))).alias("level")).first().level
        assert round(mid + shift + formality, 6) == want and got == name


def test_sampling(spark):
    rows = spark.range(4000).withColumnRenamed("id", "row")
    out = S.sample(rows, S.dimensions(spark)).toPandas()
    assert len(out) == 4000 and out.effective_cmi.between(0, 1).all()
    total = sum(p[1] for p in S.PERSONAS)
    for p in S.PERSONAS:
        mine = out[out.persona == p[0]]
        assert abs(len(mine) / 4000 - p[1] / total) < 0.03
        assert set(mine.archetype) <= set(p[4]) and set(mine.relationship) <= set(p[5]) and set(mine.topic) <= set(p[6])
    pairs = S.speaker_pairs(rows.limit(200), S.dimensions(spark)).toPandas()
    assert len(pairs) == 200 and ((pairs.persona_a != pairs.persona_b) | (pairs.archetype_a != pairs.archetype_b) | (pairs.attempt == 11)).all()


def test_best_of(spark):
    rows = [(1, 1, 3.0), (1, 2, 7.0), (1, 3, 9.0), (2, 1, 5.0), (2, 2, 5.0), (3, 1, 0.0), (4, 1, 2.0), (4, 2, 4.0)]
    got = {r.t: r.attempt for r in Q.best_of(spark.createDataFrame(rows, "t int, attempt int, score double"), ["t"], 6.0).collect()}
    assert got == {1: 2, 2: 1, 4: 2}


def test_clean_reply(spark):
    cases = {"<think>x</think><reply> A: hi there </reply>": "hi there", "<reply>open": "open", "2. list": "", "z" * 201: "", '"quoted"': "quoted", "Okay, **bold**": "bold", "a\n\nb   c": "a b c"}
    df = spark.createDataFrame(list(enumerate(cases)), "id long, raw string")
    assert [r.reply for r in D.clean_reply(df, "raw", "reply").orderBy("id").collect()] == list(cases.values())


def test_ttl_cache(spark):
    df = spark.createDataFrame([("k", i, f"2024-01-0{d} {h}:00:00") for i, (d, h) in enumerate([(1, "00"), (1, "12"), (2, "00"), (2, "23"), (3, "00")])], "key string, o long, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.o: r.hit for r in R.ttl_cache(df, ["key"], "t", "o", 86400).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_speech_pieces(spark):
    texts = ["你好，我们走吧。今天 the weather is really nice, let us go out for a walk!", "", "short", None]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "id long, t string").select(V.speech_pieces(F.col("t")).alias("p")).collect()]
    assert got[0] == ["你好，我们走吧。", "今天 the weather is really nice,", "let us go out for a walk!"] and got[1:] == [[""], ["short"], [""]]


@pytest.mark.parametrize("width,values", [(1, [0, 128, 255]), (2, [-32768, 0, 32767]), (3, [-8388608, 0, 8388607]), (4, [-(2**31), 0, 2**31 - 1])])
def test_decode(width, values):
    raw = b"".join((v if width == 1 else v & ((1 << 8 * width) - 1)).to_bytes(width, "little") for v in values)
    want = [v - 128 for v in values] if width == 1 else values
    assert audio.decode(raw, width).tolist() == want
    assert audio.to_16_bit(audio.decode(raw, width), width).tolist() == [-32768, 0, 127 * 256 if width == 1 else 32767]


def test_audio():
    assert audio.to_mono(np.array([1, 2, -3, 0]), 2).tolist() == [1, -2] and audio.to_mono(np.arange(6), 3).tolist() == [0, 3]
    assert audio.resample(np.array([0, 10, 20, 30]), 2, 1).tolist() == [0, 20] and len(audio.resample(np.arange(100), 8000, 16000)) == 200
    samples, rate = audio.read_wav(audio.write_wav(np.array([1, -2, 3]), 16000))
    assert samples.tolist() == [1, -2, 3] and rate == 16000 and len(audio.silence(300, 16000)) == 4800


def test_assemble(spark):
    wav = audio.write_wav(np.ones(1600, np.int64), 16000)
    rows = [(1, 1, wav, 500), (1, 2, wav, 500), (2, 1, wav, 500), (2, 2, None, 500)]
    out = audio.assemble(spark.createDataFrame([(c, t, bytearray(w) if w else None, p) for c, t, w, p in rows], "conv_id long, turn long, wav binary, pause_ms int")).collect()
    assert [(r.conv_id, r.seconds) for r in out] == [(1, 0.7)]


def test_sources(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(
        '{"dialogue_id": "a", "turns": [{"turn": 1, "speaker": "A", "text": "x", "score": 7.0, "decision": "pass", "cmi": 0.1, "switches": 2}]}\nnot json\n'
        '{"dialogue_id": "b", "turns": [{"turn_number": 1, "speaker": "B", "text": "y", "eval_score": 6.0, "eval_decision": "pass", "cmi": 0.2, "num_switches": 3}]}\n'
    )
    rows = config.read_dialogues(spark, str(tmp_path)).orderBy("dialogue_id").collect()
    assert [(r.turns[0].turn, r.turns[0].score, r.turns[0].switches) for r in rows] == [(1, 7.0, 2), (1, 6.0, 3)] and rows[0]._source_file == "d.jsonl"
    assert config.read_dialogues(spark, str(tmp_path), limit=1).count() == 1
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "words.txt").write_text("Bonjour\n\n salut \n")
    pair = config.with_lexicon(PAIRS["fr_en"], config.read_lexicon(spark, str(tmp_path / "lex")))
    assert pair.lexicon == ("bonjour", "salut")
    (tmp_path / "c.yaml").write_text("a: [1, 2]")
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    assert config.read_yaml(spark, str(tmp_path / "c.yaml")) == config.read_json(spark, str(tmp_path / "c.json")) == {"a": [1, 2]}
    with pytest.raises(KeyError, match="zh_en"):
        config.load_pair("xx_yy")
    config.write_json_lines(spark.range(3).toDF("n"), str(tmp_path / "out"))
    config.write_json_lines(spark.range(2).toDF("n"), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_boundaries(spark):
    calls = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")

    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    got = {r.id: (r.reply, r.error) for r in providers.chat(calls, client).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "down")}
    providers.register_sources(spark)
    assert spark.read.format("snippets").option("topics", "a,b").option("limit", "2").load().count() == 4


def _stream(spark, tmp_path, df, name, make, files=3):
    for i in range(files):
        df.filter(F.pmod(F.col("part"), F.lit(files)) == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_accommodation_stream(spark, tmp_path):
    rows = [(c, t, "AB"[t % 2], (c * 7 + t * 3) % 10 / 20, t // 2) for c in range(4) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, cmi double, part int")
    df = df.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60))
    got = {(r.conv_id, r.turn): r.partner_mean for r in _stream(spark, tmp_path, df, "acc", lambda s: stateful.accommodation_stream(s, "at")).collect()}
    batch = {(r.conv_id, r.turn): r.partner_mean for r in D.accommodation(df.withColumn("base", F.lit(0.15))).collect()}
    assert got.keys() == batch.keys() and all((got[k] is None) == (batch[k] is None) and abs((got[k] or 0) - (batch[k] or 0)) < 1e-9 for k in got)


def test_cache_stream(spark, tmp_path):
    df = spark.createDataFrame([("k", i, 1704067200 + i * 40_000, i // 2) for i in range(12)], "key string, o long, s long, part int").select("key", "o", F.timestamp_seconds("s").alias("t"), "part")
    got = {r.o: r.hit for r in _stream(spark, tmp_path, df, "cache", lambda s: stateful.cache_stream(s, 86400), 6).collect()}
    assert got == {r.o: r.hit for r in R.ttl_cache(df, ["key"], "t", "o", 86400).collect()}


def test_fresh_texts_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1704067200 + i, i) for i, t in enumerate(["A b", "ab", "c", "C", "d", "a B"])], "id long, text string, s long, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = _stream(spark, tmp_path, df, "fresh", lambda s: stateful.fresh_texts(s, "ts"))
    assert got.count() == 3


def test_registry():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in queries)


def test_grams_are_linear_in_any_projection(spark):
    """A text of 20 000 words, of which nothing but the grams is asked for."""
    r = random.Random(5)
    text = " ".join(r.choices(["le", "meeting", "est", "okay", "x", "12", "très,"], k=20_000))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.perf_counter()
    alone = Q.novelty_inputs(A.analyze(df, PAIRS["fr_en"])).select(F.size("grams").alias("n")).first().n
    assert time.perf_counter() - began < 20
    words = [w for w in re.findall(r"[^\W\d]+|\d+|[^\s]", text.lower()) if w.isalpha()]
    assert alone == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})


def test_rows_are_spread_over_the_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert tables.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(50)
    assert tables.spread(many) is many


def test_providers_reach_the_workers(spark):
    def failing(topic, limit):
        raise OSError("no route")

    providers.register_sources(spark, {"arxiv": lambda t, n: [(f"real {t}", "body", "arxiv")], "mine": lambda t, n: [(t, t, "mine")] * n, "down": failing})
    read = lambda name: spark.read.format("snippets").option("provider", name).option("topics", "a,b").load().collect()
    assert sorted(r.title for r in read("arxiv")) == ["real a", "real b"] and len(read("mine")) == 6
    assert {(r.topic, r.title, r.error) for r in read("down")} == {("a", None, "OSError: no route"), ("b", None, "OSError: no route")}
    with pytest.raises(Exception, match="no provider 'nobody'"):
        read("nobody")


def test_provider_chain_order_and_fallback(spark):
    rows = [("t", "zeta", 0, "One"), ("t", "zeta", 1, "Two"), ("t", "alpha", 0, "one "), ("t", "alpha", 1, "Three"), ("t", "other", 0, "Four"), ("u", "web", 0, "Five"), ("u", "alpha", 0, "Six")]
    snippets = spark.createDataFrame([(*r, None) for r in rows] + [("t", "alpha", None, None, "down")], "topic string, provider string, pos int, title string, error string")
    chain = spark.createDataFrame([("t", "zeta", 0), ("t", "missing", 1), ("t", "alpha", 2)], "topic string, provider string, priority int")
    out = lambda n: sorted((r.topic, r["rank"], r.title) for r in R.provider_chain(snippets, n, chain, "web").collect())
    assert out(3) == [("t", 1, "One"), ("t", 2, "Two"), ("t", 3, "Three"), ("u", 1, "Five")] and out(2) == [("t", 1, "One"), ("t", 2, "Two"), ("u", 1, "Five")]


def test_cache_walk_against_a_loop(spark):
    """A hot key over many batches, keys with nulls, ties, and results that are not kept."""
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), i, r.randrange(400_000), r.random() < 0.5) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, o long, s long, found boolean").withColumn("t", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x.o: x.hit for x in R.ttl_cache(df, ["key"], "t", "o", 3600, "found").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for key, o, s, found in sorted(rows, key=lambda x: (x[2], x[1])):
        want[o] = key in last and s - last[key] < 3600
        if not want[o] and found:
            last[key] = s
    assert got == want


def test_accommodation_of_a_long_conversation(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice("ABC"), r.random() if t % 9 else None, 0.15) for c in range(3) for t in range(3000)]
    got = {(x.conv_id, x.turn): x.partner_mean for x in D.accommodation(spark.createDataFrame(rows, "conv_id long, turn long, speaker string, cmi double, base double")).collect()}
    for c in range(3):
        mine = [x for x in rows if x[0] == c]
        for t in (0, 1, 2, 17, 2999):
            heard = [x[3] for x in mine[:t] if x[2] != mine[t][2] and x[3] is not None][-2:]
            assert got[c, t] == (pytest.approx(sum(heard) / len(heard)) if heard else None)


def test_synthesis_is_tried_again(spark, tmp_path):
    folder = str(tmp_path)

    def voice(text):
        if "never" in text:
            raise RuntimeError("no voice")
        mark = os.path.join(folder, text.strip("<>"))
        if "once" in text and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("busy")
        return np.full(100, 2.0)

    rows = [(1, 1, ["fine", "once"]), (1, 2, ["fine", "never"]), (2, 1, []), (2, 2, None)]
    pieces = spark.createDataFrame(rows, "conv_id long, turn long, pieces array<string>")
    got = {(r.conv_id, r.turn): r for r in providers.synthesize(pieces, voice, 1000, backoff=0.01, marker="<").collect()}
    assert got[1, 1].seconds == 0.2 and audio.read_wav(got[1, 1].wav)[0].tolist() == [32767] * 200 and got[1, 1].error is None
    assert (got[1, 2].wav, got[1, 2].error) == (None, "RuntimeError: no voice") and got[2, 2].seconds == 0


def test_pair_folder_and_persona_pool(spark, tmp_path):
    root = tmp_path / "pairs"
    for name, mode in (("xx_en", "unicode"), ("yy_en", "lexicon")):
        at = root / name
        at.mkdir(parents=True)
        (at / "language.yaml").write_text(f"l1_code: {name[:2]}\nl2_code: en\ndetection_mode: {mode}\nl1_unicode_ranges:\n  - [0x4E00, 0x9FFF]\nsentence_endings: '.!?'\n")
        (at / "calibration.json").write_text('{"mean": 0.2}')
        (at / "evaluation.yaml").write_text("pass: 6.0")
        (at / "prompts.yaml").write_text("hello: hi")
        (at / "personas.yaml").write_text(
            "persona_templates:\n  - {id: p1, weight: 0.5, region: {id: singapore, label: S}, profession: {id: chef}, age_group: senior, L2_proficiency: {id: basic}, compatible_archetypes: [ARC_05], "
            "compatible_relationships: [family], natural_topics: [food]}\n"
        )
        if mode == "lexicon":
            (at / "l1_lexicon.txt").write_text("Bonjour\n\nsalut\n")
    (root / "not_a_pair").mkdir()
    assert [r.pair for r in config.pair_folders(spark, str(root)).collect()] == ["xx_en", "yy_en"]
    assert config.pair_folders(spark, str(tmp_path / "nowhere")).count() == 0
    by_script, by_list = config.read_pair(spark, str(root), "xx_en"), config.read_pair(spark, str(root), "yy_en")
    assert by_list.language.lexicon == ("bonjour", "salut") and by_script.calibration == {"mean": 0.2} and by_script.evaluation == {"pass": 6.0} and by_script.prompts == {"hello": "hi"}
    text = spark.createDataFrame([(0, "我 like 你."), (1, "Salut my friend")], "doc_id long, text string")
    assert [(r.n1, r.n2) for r in A.analyze(text, by_script.language).orderBy("doc_id").collect()] == [(2, 1), (0, 3)]
    assert [(r.n1, r.n2) for r in A.analyze(text, by_list.language).orderBy("doc_id").collect()][1] == (1, 2)
    with pytest.raises(FileNotFoundError, match="xx_en, yy_en"):
        config.read_pair(spark, str(root), "zz_en")
    out = S.sample(spark.range(20).withColumnRenamed("id", "row"), S.pool_dimensions(spark, by_script.personas)).collect()
    assert len(out) == 20 and {(r.persona, r.region, r.profession, r.age_group, r.proficiency, r.archetype, r.topic, r.relationship) for r in out} == {("p1", "singapore", "chef", "senior", "basic", "ARC_05", "food", "family")}


def test_example_bank_and_documents(spark, tmp_path):
    (tmp_path / "bank.jsonl").write_text('{"archetype_id": "A1", "topic": "food", "speaker_text": "x", "eval_score": 9.0, "cmi": 0.2}\nbroken\n')
    rows = config.read_examples(spark, str(tmp_path / "bank.jsonl")).collect()
    assert [(r.archetype, r.topic, r.score) for r in rows] == [("A1", "food", 9.0)]
    config.write_json_documents(spark.createDataFrame([(1, "é")], "n int, t string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"n":1,"t":"é"}']


def test_gram_stream(spark, tmp_path):
    rows = [(7, 1, 0), (8, 1, 0), (7, 2, 1), (9, 2, 1), (9, 3, 2), (9, 3, 2)]
    df = spark.createDataFrame(rows, "gram long, doc_id long, part int")
    got = sorted(map(tuple, _stream(spark, tmp_path, df, "grams", stateful.gram_novelty).collect()))
    assert got == [(7, 1, False), (7, 2, True), (8, 1, False), (9, 2, False), (9, 3, True)]
