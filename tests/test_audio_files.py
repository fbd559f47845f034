"""WAV files are written whole or not at all; the manifest counts what was spoken."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlex.functions.audio import write_wav
from braidlex.sources import audio_files, config, providers


@pytest.fixture(scope="module")
def wav(spark):
    audio_files.register(spark)
    return spark


def spoken(spark, n=30, parts=4):
    pieces = spark.createDataFrame([(i, 1, ["hello", "x" * (i % 5)]) for i in range(n)], "conv_id long, turn long, pieces array<string>").repartition(parts)

    def voice(text):
        if text == "xxx":
            raise RuntimeError("no voice for this")
        return providers.fake_voice(text, 1000)

    made = providers.synthesize(pieces, voice, 1000, attempts=1)
    return made.select(F.concat(F.lit("dialogue_"), "conv_id", F.lit("/turn_"), "turn", F.lit(".wav")).alias("path"), "wav", "seconds", "error")


def files_of(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_write_and_read_back(wav, tmp_path):
    folder = str(tmp_path / "out")
    rows = spoken(wav)
    rows.write.format("wav").mode("append").save(folder)
    good = {f"dialogue_{i}/turn_1.wav" for i in range(30) if i % 5 != 3}
    names = files_of(folder)
    assert {n.split("/", 1)[1] for n in names if n.endswith(".wav")} == good and not [n for n in names if "_temporary" in n]
    told = json.load(open(audio_files.manifests(folder)[0]))
    assert (told["total"], told["success"], told["failed"]) == (30, 24, 6) and set(told["parts"]) == {n.split("/")[0] for n in names if n.endswith(".wav")}
    back = {r.path: (bytes(r.wav), r.seconds) for r in wav.read.format("wav").load(folder).collect()}
    want = {r.path: (bytes(r.wav), r.seconds) for r in rows.filter("error is null").collect()}
    assert back == {k: (w, pytest.approx(s)) for k, (w, s) in want.items()}
    assert told["seconds"] == pytest.approx(sum(s for _, s in want.values()), abs=0.01)
    assert config.read_wavs(wav, folder + "/*/*").count() == 24
    # a dialogue is kept only where all its turns were spoken
    kept = rows.groupBy(F.substring_index("path", "/", 1).alias("dialogue")).agg(F.every(F.col("error").isNull()).alias("ok"), F.sum("seconds").alias("seconds"))
    assert config.manifest(kept).first().failed == 6


def test_a_failing_task_leaves_nothing(wav, tmp_path):
    folder = str(tmp_path / "out")
    spoken(wav, 6, 2).write.format("wav").mode("append").save(folder)
    before = files_of(folder)
    sound = write_wav(np.array([0, 1, 2]), 1000)
    rows = [(f"new/{i}.wav" if i != 17 else "../out.wav", bytearray(sound), 0.1, None) for i in range(20)]
    with pytest.raises(Exception, match="no place in the folder"):
        wav.createDataFrame(rows, audio_files.SCHEMA).repartition(4).write.format("wav").mode("append").save(folder)
    assert files_of(folder) == before and not os.path.exists(tmp_path / "out.wav")
    with pytest.raises(Exception, match="two rows"):
        wav.createDataFrame([rows[0], rows[0]], audio_files.SCHEMA).coalesce(1).write.format("wav").mode("append").save(folder)
    assert files_of(folder) == before
    assert wav.read.format("wav").load(folder).count() == len([n for n in before if n.endswith(".wav")])


def test_append_overwrite_and_empty(wav, tmp_path):
    folder = str(tmp_path / "out")
    sound = bytearray(write_wav(np.array([5, 6]), 1000))
    one = wav.createDataFrame([("a.wav", sound, 0.002, None)], audio_files.SCHEMA)
    one.write.format("wav").mode("append").save(folder)
    wav.createDataFrame([("b/c.wav", sound, 0.002, None), ("d.wav", None, None, "failed")], audio_files.SCHEMA).write.format("wav").mode("append").save(folder)
    assert sorted(r.path for r in wav.read.format("wav").load(folder).collect()) == ["a.wav", "b/c.wav"] and len(audio_files.manifests(folder)) == 2
    wav.createDataFrame([("z.wav", sound, 0.002, None)], audio_files.SCHEMA).write.format("wav").mode("overwrite").save(folder)
    assert [n for n in files_of(folder) if n.endswith("z.wav")] == [n for n in files_of(folder) if n.endswith(".wav")] and len(audio_files.manifests(folder)) == 1
    wav.createDataFrame([], audio_files.SCHEMA).write.format("wav").mode("append").save(str(tmp_path / "none"))
    assert wav.read.format("wav").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="lack"):
        one.drop("seconds").write.format("wav").mode("append").save(folder)
