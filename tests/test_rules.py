"""Evaluation tables compiled to scores, violations with their provenance, reports, hot keys, missing and repeated ids."""

import pytest
from pyspark.sql import functions as F

from braidlex.functions.lang import PAIRS
from braidlex.operators import rules as R
from braidlex.operators import scoring as S
from braidlex.plans import evaluation as E
from braidlex.plans import ranks
from braidlex.sources import config

FR, ZH = PAIRS["fr_en"], PAIRS["zh_en"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def broken(spark, pair, texts):
    out = {}
    for r in E.violations(docs(spark, texts), pair).collect():
        out.setdefault(r.doc_id, {})[r.rule] = (r.checker, [x for x in (r.number_1, r.number_2, r.number_3) if x is not None], r.token)
    return out


def test_violations_say_where_and_by_which_numbers(spark):
    texts = [
        "只有中文没有别的",  # one language
        "你 hi",  # too few words
        "今天 we are going to the big market now 吧，lah 好吗",  # a long run, words of a region
        "我ab你bc他cd们dd好ef 对 hmm 的 xyzzyx qwrtp zxcvb asdfg",  # words cut by switches, unknown words
        "我们今天去 market 买东西（然后回家休息一下好不好呢 really",  # a bracket without its other half
        "我们今天去 market 买东西然后回家休息一下好不好呢 really",
        "我们今天去 market 买东西然后回家休息一下好不好呢 really",  # a copy
    ]
    got = broken(spark, ZH, texts)
    assert got[0]["one_language"] == ("fluency", [8.0, 0.0], None)
    assert got[1]["too_few_tokens"] == ("fluency", [2.0, 5.0], None) and "l1_single" not in got[1]
    run = got[2]["longest_run"]  # ARC_03 wants five words at most
    assert run == ("profile_consistency", [8.0, 5.0], 2)
    assert got[2]["words_of_singapore"][0] == "cultural_coherence" and got[2]["words_of_singapore"][2] == 12
    assert got[3]["inside_words"][1] == [5.0] and got[3]["l2_unknown"][0] == "fluency" and got[3]["l2_unknown"][2] is not None
    assert got[4]["brackets"] == ("fluency", [], None) and "brackets" not in got[5]
    assert got[6]["copy"] == ("diversity", [], None) and "copy" not in got[5]
    report = {r.doc_id: r.summary.split("\n") for r in E.summaries(docs(spark, texts), ZH).collect()}
    assert report[1][3].startswith("[veto: fluency") and "    -> too_few_tokens: 2 words, at least 5" in report[1]
    for i, rules in got.items():
        lines = [x for x in report[i] if x.startswith("    -> ")]
        assert [x.split(": ")[0].removeprefix("    -> ") for x in lines] == list(dict.fromkeys(r.name for r in E.RULES if r.name in rules))
    assert sum(x.startswith("  [") for x in report[5]) == 6 and "  [fluency] 10.00/10 x 0.20 = 2.0000" in report[5] and report[2][1] == "text: " + texts[2]


def test_scores_follow_the_tables(spark):
    text = ["we go maintenant avec vous to the market pour le report"] * 6
    strict = R.read_rules({"switch_type_expectations": {"ARC_02": {"inter_min": 1.0, "desc": "x"}}, "l2_span_expectations": {"ARC_01": {"typical_max": 1}}})
    rows = {r.doc_id: r for r in E.scored(docs(spark, text), FR, strict).collect()}
    usual = {r.doc_id: r for r in E.scored(docs(spark, text), FR).collect()}
    assert rows[1].switch_type == 5.0 and usual[1].switch_type == 5.0  # no switch between sentences: the most that it can cost
    assert rows[0].l2_span == 4.0 and usual[0].l2_span == 10.0
    assert rows[2].switch_type == 10.0  # an archetype that the tables leave out has no expectations
    told = R.read_rules({"filler_words": ["maintenant", "go maintenant", ""], "interjections": ["Vous"]}).words(FR)
    assert told.markers[-1] == "maintenant" and told.expressions[-1] == "go maintenant" and told.interjections_l1[-1] == told.interjections_l2[-1] == "vous"
    motives = [E.scored(docs(spark, text[:1]), pair).first().motives for pair in (FR, told)]
    assert motives[0] != motives[1] and "fixed_expression" in motives[1]


@pytest.mark.parametrize("tables", [
    {"switch_type_expectations": {"ARC_01": {"intra_max": 0.3}}}, {"l2_span_expectations": {"ARC_01": {"typical_max": "three"}}}, {"l2_span_expectations": {"ARC_01": {"typical_max": True}}},
    {"switch_type_expectations": {"ARC' OR 1=1": {}}}, {"span_expectations": {}},
])
def test_unknown_rules_are_errors(tables):
    with pytest.raises(ValueError):
        R.read_rules(tables)


def test_rules_of_a_folder(spark, tmp_path):
    folder = tmp_path / "fr_xx"
    folder.mkdir()
    (folder / "language.yaml").write_text("l1_code: fr\nl2_code: en\ndetection_mode: lexicon\nsentence_endings: '.!?'\n")
    (folder / "l1_lexicon.txt").write_text("le\nla\navec\n")
    (folder / "personas.yaml").write_text("personas: []\n")
    (folder / "calibration.json").write_text('{"cmi_distribution": {"by_topic": {"work": {"mean_shift": 0.2}, "_note": "x"}}}')
    (folder / "evaluation.yaml").write_text("l2_span_expectations:\n  ARC_01: {typical_max: 2}\nfiller_words: [bref]\n")
    (folder / "prompts.yaml").write_text("mixing_level_descriptions: {light: 'un peu de {l2_name}'}\ncs_behavior_templates: {ARC_01: 'mots de {l2_name}'}\n")
    found = config.read_pair(spark, str(tmp_path), "fr_xx")
    assert found.rules.l2_span == {"ARC_01": {"typical_max": 2.0}} and found.rules.switch_type == R.SWITCH_TYPE
    assert found.rules.shifts == {"work": 0.2} and found.rules.levels == {"light": "un peu de {l2_name}"} and found.rules.behaviours == {"ARC_01": "mots de {l2_name}"}
    assert "bref" in found.language.markers


def test_hot_keys_do_not_meet_one_task(spark, monkeypatch):
    """A key with nearly all rows gets its first value where the rows are; the skew rule is off."""
    monkeypatch.setattr(ranks, "HOT_ROWS", 1000)
    rows = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("v"), F.when(F.col("id") % 10 < 9, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"))
    plain = {r.k: r.f for r in rows.groupBy("k").agg(F.min("v").alias("f")).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = ranks.with_first(rows, "k", "v", "f").cache()
        assert out.count() == 200_000 and out.filter(F.col("k") == -1).count() == 180_000
        assert {(r.k, r.f) for r in out.select("k", "f").distinct().collect()} == set(plain.items())
        largest = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert largest < 30_000  # of 200 000: an eighth of the hot rows, or a share of the others
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_verdicts_keep_every_row(spark):
    texts = ["we go avec vous to the market", "we go avec vous to the market", "the report est pour la question", None, "le the le the le the"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[0]), (9, texts[4])]
    for parts in (1, 4):
        got = E.verdicts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), FR).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        copies = sorted((str(r.doc_id), r.is_copy) for r in got)
        assert copies == sorted([("1", False)] * 3 + [("2", True), ("9", False), ("None", True), ("None", False)])
        accepted = E.accepted_verdicts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), FR)
        assert accepted.count() == len(rows)
    assert S.REGION_MARKERS.keys() == {"singapore", "malaysia", "hongkong"}
