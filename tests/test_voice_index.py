"""Long catalogues by signature give the voices of the short form."""

import pytest
from pyspark.sql import functions as F

from braidlex.operators import voice as V

TRAITS = "voice string, gender string, age string, languages array<string>, accent string"


def catalogue(spark, n):
    pick = lambda values, k: F.get(F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("v"), i).alias("voice"), pick(["female", "male", None], i).alias("gender"), pick(["young", "middle", "senior"], i / 3).alias("age"), pick([["zh", "en"], ["en"], ["fr", "en"], ["ms"]], i / 9).alias("languages"), pick(["mainland", "", "hongkong"], i / 36).alias("accent")
    )


def speakers(spark, n):
    rows = [(i % 40, [["zh", "en"], ["en", "zh"], ["fr"], ["de"], ["ms", "en"], []][i % 6], ["female", "male", "unknown"][i % 3], ["young", "middle", "senior"][i % 5 % 3], ["mainland", "", "hongkong", "nowhere"][i % 4]) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None)], "id long, languages array<string>, gender string, age string, accent string")


@pytest.mark.parametrize("signatures,tile", [(2000, 5000), (2, 1), (7, 3)])
def test_the_index_is_the_short_form(spark, monkeypatch, signatures, tile):
    voices = catalogue(spark, 130).unionByName(spark.createDataFrame([("only", "male", "young", ["de"], "nowhere")], TRAITS))
    people = speakers(spark, 60)
    pairs = people.select("id", "languages", *[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("gender", "age", "accent")])
    want = sorted(map(str, V.best_voice(people, voices).collect())), sorted(map(str, V.voice_pairs(pairs, voices, strict=False).collect()))
    monkeypatch.setattr(V, "MAX_VOICES", 3)
    monkeypatch.setattr(V, "SIGNATURES", signatures)
    monkeypatch.setattr(V, "VOICE_TILE", tile)
    got = sorted(map(str, V.best_voice(people, voices).collect())), sorted(map(str, V.voice_pairs(pairs, voices, strict=False).collect()))
    assert got == want and "only" in str(want[1])


def test_a_million_voices(spark):
    voices, people = catalogue(spark, 1_000_000), speakers(spark, 6).filter("id is not null")
    got = {r.id: (r.voice, r.voice_score) for r in V.best_voice(people, voices).collect()}
    side = {name: F.col(name) for name in ("languages", "gender", "age", "accent")}
    shares, score = V._rank(side, F.col("v"))
    every = people.crossJoin(F.broadcast(voices.select(F.struct("voice", "gender", "age", "languages", "accent").alias("v"))))
    best = every.groupBy("id").agg(F.max(F.struct(shares.alias("shares"), score.alias("score"), V._tie(42, F.col("id"), F.col("v.voice")).alias("tie"), F.col("v.voice").alias("voice"))).alias("best"))
    assert got == {r.id: (r.best.voice, r.best.score) for r in best.collect()} and len(got) == 6
