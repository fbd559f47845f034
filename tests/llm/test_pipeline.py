"""The pipeline end to end: each stage's output against brute force over its own input."""

import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from braidlex.llm import mixing, sharding, toxicity
from braidlex.llm.base import cut, table
from braidlex.llm.queries import MIX_POWERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, topic string, shard int, component_id long, fp string"


def build():
    r = random.Random(21)
    plain, bad = [f"word{i}" for i in range(3000)], ["vile", "nasty", "zorkel"]
    items = [" ".join(r.choices(plain, k=k)) for k in (25, 12, 6)]
    rows, labels = [], []
    for i in range(260):
        w = r.choices(plain, k=r.choice([30, 60, 120]))
        if i % 6 == 0:
            w[4:4] = [r.choice(bad) + r.choice(["", "s"]) for _ in range(4)]
        elif i % 10 == 1:
            w[7:7] = r.choice(items).split()
        elif i % 10 == 3 and rows[i - 1][1] and (i - 1) % 6:
            w = rows[i - 1][1].split()
            w[-1] = "changed"
        elif i % 50 == 7:
            w = []
        text = None if i % 100 == 57 else " ".join(w)
        rows.append((i, text, "en" if i % 3 else "fr", "hot" if i % 3 else f"s{i % 4}", len(w), 1, "t", 9, i, "x"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [rows[20], rows[20], (None, rows[21][1], None, None, 0, None, None, None, None, None), (None, None, None, None, 0, None, None, None, None, None)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = build()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    whole = docs
    # toxicity: the rows that the model scores at a half or more, and all planted ones, go
    kept = cut(corpus_pipeline.drop_toxic(spark, docs, folder), "one")
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels"))).collect()
    assert kept.columns == whole.columns and ids(kept) == Counter(r.doc_id for r in scores if r.score < 0.5)
    missed = [i for i in ids(kept) if i is not None and i % 6 == 0]
    assert len(missed) <= 0.05 * 44 and len(ids(kept)) >= 0.95 * 260 * 5 / 6, missed
    # near copies: classes by all pairs
    docs = kept
    kept = cut(corpus_pipeline.drop_near_duplicates(spark, docs, folder), "two")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    want = Counter({i: 1 for i, low in label.items() if i == low})  # the rows without an id are copies of others
    assert kept.columns == whole.columns and ids(kept) == want and len(want) < len(label)
    # leaks: every document, item and pair of places
    docs = kept
    kept = cut(corpus_pipeline.drop_leaks(spark, docs, folder), "three")
    items = [w for r in table(spark, folder, "benchmark").collect() if (w := re.findall("[a-z0-9]+", (r.text or "").lower()))]

    def leaked(text):
        d = re.findall("[a-z0-9]+", (text or "").lower())
        for t in items:
            n = min(20, len(t))
            if any(sum(x == y for x, y in zip(d[a : a + n], t[b : b + n], strict=True)) >= 0.8 * n for a in range(len(d) - n + 1) for b in range(len(t) - n + 1)):
                return True
        return False

    want = Counter(r.doc_id for r in docs.collect() if not leaked(r.text))
    assert ids(kept) == want and sum(want.values()) < docs.count()
    # mixture: as often as the weights of raked cells say
    docs = kept
    kept = cut(corpus_pipeline.draw_mixture(spark, docs, folder), "four")
    drawn = Counter()
    for r in mixing.mix(docs, MIX_POWERS).collect():
        drawn[r.doc_id] += r.copies
    assert kept.columns == whole.columns and ids(kept) == +drawn
    # shards: all rows, counts at most one apart
    out = corpus_pipeline.deal_shards(spark, kept, folder).collect()
    assert Counter(r.doc_id for r in out) == +drawn
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(24)) <= 1 and all(sorted(r.slot for r in out if r.shard == k) == list(range(n)) for k, n in sizes.items())
    # and the same at once
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in out)
    assert {r.law for r in again} == {"rows"} and sharding.digest(kept).columns == list(again[0].asDict())


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
