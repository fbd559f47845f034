"""Each command line over small inputs, in the session of the tests."""

import json
import pathlib

import pytest

from braidlex.__main__ import main, parser
from braidlex.plans import generation
from braidlex.sources import audio_files


def client(prompt):
    return f"<reply>我们 today 去 the office 讨论 project, 然后 meeting 再说 number {len(prompt) % 7}</reply>"


def atlas(topic, limit):
    return [(f"{topic} {i}", "text " * i, "atlas") for i in range(limit)]


def broken(topic, limit):
    raise OSError("no network")


FUNCTIONS = {"atlas": atlas, "broken": broken}


def tone(text, rate):
    import numpy as np

    if "?" in text:
        raise ValueError("no questions")
    return np.zeros(len(text) * rate // 100)


def test_sample_and_prompts(spark, tmp_path):
    main(["sample", "-n", "30", "--seed", "7", "--output", str(tmp_path / "s")], spark)
    rows = spark.read.json(str(tmp_path / "s")).collect()
    assert len(rows) == 30 and {r.row for r in rows} == set(range(30)) and all(r.archetype for r in rows)
    main(["prompts", "-n", "12", "--output", str(tmp_path / "p"), "--language", "zh", "--l1-name", "French"], spark)
    told = spark.read.json(str(tmp_path / "p")).collect()
    assert len(told) == 12 and all(r.system_prompt and r.user_prompt for r in told) and any("French" in r.system_prompt for r in told)


def test_sample_of_a_pool(spark, tmp_path):
    pool = tmp_path / "personas.yaml"
    pool.write_text(json.dumps({"personas": [{"id": f"p{k}", "weight": k, "region": {"id": "r"}, "profession": {"id": "x"}, "compatible_archetypes": ["ARC_01"], "compatible_relationships": ["family"], "natural_topics": ["food"]} for k in range(4)]}))
    main(["sample", "-n", "60", "--personas", str(pool), "--output", str(tmp_path / "s")], spark)
    assert {r.persona for r in spark.read.json(str(tmp_path / "s")).collect()} == {"p1", "p2", "p3"}  # p0 weighs nothing


def test_evaluate(spark, tmp_path, capsys):
    texts = spark.createDataFrame([(1, "我们 today 去 office 开会 with the team"), (2, ""), (3, None)], "doc_id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    main(["evaluate", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--domain-words", "office,team", "--cmi-range", "0.1", "0.4"], spark)
    got = {r.doc_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3} and got[1].final_score > 0 and got[2].decision == "fail"
    main(["evaluate", "--text", "我们 today 去 office"], spark)
    assert "decision" in capsys.readouterr().out


def test_generate_goes_on_from_its_folder(spark, tmp_path, monkeypatch):
    common = ["generate", "-n", "5", "--client", "tests.test_commands:client", "--turns", "2", "--attempts", "1", "--folder", str(tmp_path / "rounds"), "--example-bank", str(tmp_path / "bank"), "--example-score", "0.5"]
    main([*common, "--output", str(tmp_path / "a")], spark)
    first = {r.dialogue_id: r for r in spark.read.json(str(tmp_path / "a/dialogues")).collect()}
    assert len(first) == 5 and all(r.total_turns == 2 and len(r.turns) == 2 for r in first.values())
    assert spark.read.json(str(tmp_path / "bank")).count() == 10
    monkeypatch.setattr(generation, "attempt", None)  # nothing is asked again
    main([*common, "--output", str(tmp_path / "b")], spark)
    assert {r.dialogue_id: r for r in spark.read.json(str(tmp_path / "b/dialogues")).collect()} == first


def test_snippets(spark, tmp_path):
    main(["snippets", "--topic", "tea", "rain", "--providers", "broken", "atlas", "--functions", "tests.test_commands:FUNCTIONS", "--max-snippets", "2", "--output", str(tmp_path / "o")], spark)
    blocks = {r.topic: r.block for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert set(blocks) == {"tea", "rain"} and "tea 1" in blocks["tea"] and "tea 2" not in blocks["tea"]


def test_speech(spark, tmp_path):
    turn = lambda k, text: {"turn": k, "speaker": "A", "text": text}
    lines = [{"dialogue_id": "d1", "turns": [turn(1, "hello there."), turn(2, "你好。")]}, {"dialogue_id": "d2", "turns": [turn(1, "why?"), turn(2, "so.")]}, {"dialogue_id": "d3", "turns": []}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    main(["speech", "--input", str(tmp_path / "in.jsonl"), "--output", str(tmp_path / "wavs"), "--voice", "tests.test_commands:tone", "--rate", "1000", "--retries", "1"], spark)
    sounds = spark.read.format("wav").load(str(tmp_path / "wavs")).collect()
    assert [r.path for r in sounds] == ["d1.wav"] and 0.15 + 0.3 <= sounds[0].seconds <= 0.15 + 0.8  # 12 and 3 characters, a pause between
    told = json.loads(pathlib.Path(audio_files.manifests(str(tmp_path / "wavs"))[0]).read_text())
    assert (told["total"], told["success"], told["failed"]) == (3, 1, 2)


def test_wrong_arguments():
    for argv in (["evaluate"], ["generate", "--output", "x"], ["generate", "--output", "x", "--client", "nothing"], ["sample", "-n", "3"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(argv)
