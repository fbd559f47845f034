"""Diversity by counting first occurrences, and the searches behind cheap ones."""

import glob
import random

import duckdb

from braidlex.functions.lang import PAIRS
from braidlex.operators import analysis as A
from braidlex.operators import scoring as S
from braidlex.plans import evaluation as E
from braidlex.plans import tables

FR = PAIRS["fr_en"]


def _texts(n: int) -> list[str]:
    dice = random.Random(5)
    words = ["le", "la", "pour", "the", "report", "market", "question", "friend", "vous", "house"]
    out = [" ".join(dice.choices(words, k=40)) for _ in range(n)]
    return [t if i % 7 else " ".join(out[i // 2].split()[:20] + t.split()[:20]) for i, t in enumerate(out)]


def _written(spark) -> dict[str, int]:
    return {p: spark.read.parquet(p).count() for p in glob.glob(f"{tables.run_dir(spark).removeprefix('file:')}/*")}


def test_overlap_against_brute_force_and_no_shingle_is_written(spark):
    texts = _texts(120)
    before = _written(spark)
    for ids in (list(range(120)), [None if i % 50 == 0 else i // 3 if i % 10 < 3 else i + 100 for i in range(120)]):
        rows = E._numbered(S.novelty_inputs(A.analyze(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3), FR)))
        inputs = tables.cut(rows.select("row", "seq", "text_hash", "pattern", "grams"), "inputs")
        got = {r.row: round(r.overlap, 12) for r in S.diversity(inputs, "seq", row="row").collect()}
        own = {r.row: (r.seq, r.grams or []) for r in inputs.collect()}
        first: dict[int, int] = {}
        for seq, grams in own.values():
            for g in grams:
                first[g] = min(first.get(g, seq), seq)
        assert got == {row: round(sum(first[g] < seq for g in grams) / len(grams), 12) if grams else 0.0 for row, (seq, grams) in own.items()}
        if ids[0] is not None:
            assert max(n for p, n in _written(spark).items() if p not in before) <= 120  # one row a text at most


def test_measures_equal_sql_on_odd_texts(spark):
    marks = ["a\x85", "fin ", "fin 　\t", "<b", "<b>x", "&amp;", "\\x4f", "x\x01y", "\\x4", "（x）（", "「」【", "你a你b", "le lah LAR ma Ma", "by the way le", "", " ", "\x85", "ok 了", "a😀"]
    frame = spark.createDataFrame(list(enumerate(marks)), "doc_id long, text string")
    columns = ["is_garbage", "unbalanced", "cut_off", "n_adjacent", "n_singapore", "n_malaysia", "n_hongkong", "has_fixed"]
    got = S.measured(E.profiled(A.analyze(frame, FR))).orderBy("doc_id").select("doc_id", *columns).collect()
    duckdb.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT unnest(range(len(?::VARCHAR[])))::BIGINT AS doc_id, unnest(?::VARCHAR[]) AS text", [marks, marks])
    want = duckdb.execute(f"WITH {A.analysis_sql('documents', FR)}, {E.profiled_sql('a')}, {S.measured_sql('p')} SELECT doc_id, {', '.join(columns)} FROM m ORDER BY doc_id").fetchall()
    assert list(map(tuple, got)) == want
