"""Near copies link by the exact similarity of their shingle sets, whatever their fingerprints."""

import itertools
import os
import random

import pytest

from braidlex.llm import simhash_dedup


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(15):  # the same set of shingles, one passage ten times as often
        passage, rest = r.sample(words, 40), r.sample(words, 250)
        out += [" ".join(passage * n + rest) for n in (2, 20)]
    for cut in (26, 30, 34, 38):  # similarities around 0.8
        for _ in range(8):
            own = r.sample(words, 274)
            out += [" ".join(own), " ".join(own[: 274 - cut] + r.sample(words, cut))]
    return out


@pytest.mark.parametrize("tile,tile_bytes", [(1024, 2_000_000), (4, 3000)])
def test_links_are_exact(spark, texts, monkeypatch, tile, tile_bytes):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    monkeypatch.setattr(simhash_dedup, "TILE_BYTES", tile_bytes)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    label = list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(label, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in near:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert 15 < len(near) < 47
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs).collect()} == dict(enumerate(label))


def test_radius_leaves_out_next_to_nothing():
    """The share of differing bits of small sets is that of trying all bits; simulated large sets stay within the radius."""
    import numpy as np

    for a, b, common in ((1, 0, 4), (1, 1, 8), (0, 2, 8), (2, 1, 5)):
        differ = 0
        for bits in itertools.product((0, 1), repeat=a + b + common):
            x, y = bits[:a] + bits[a + b :], bits[a:]
            differ += (sum(x) * 2 > len(x)) != (sum(y) * 2 > len(y))
        assert abs(simhash_dedup._differ(a, b, common) - differ / 2 ** (a + b + common)) < 1e-12
    radius = simhash_dedup.radius_of(0.8)
    assert 0.15 < simhash_dedup.differing_share(0.8) < 0.2 and 60 < radius < 100
    r = np.random.default_rng(4)
    for n in (5, 9, 45, 450):
        own = (n - int(np.ceil(n * 8 / 9 - 1e-9))) if n != 5 else 1
        for _ in range(200):
            h = r.integers(0, 1 << 64, n + own, dtype=np.uint64).tolist()
            left, right = (h[:n], h[own:]) if n != 5 else (h[:5], h[:4])
            prints = [np.unpackbits(np.frombuffer(simhash_dedup.signature(x)[1], np.uint8)) for x in (left, right)]
            assert (prints[0] != prints[1]).sum() <= radius


def test_wide_prints_are_compared_bit_by_bit():
    import numpy as np

    r = random.Random(7)
    base = [r.getrandbits(256) for _ in range(4)]
    prints = [b ^ sum(1 << k for k in r.sample(range(256), r.randrange(60))) for b in base for _ in range(40)]
    group = sorted(r.randrange(3) for _ in prints)
    words = np.array([[p >> 64 * k & (1 << 64) - 1 for k in range(4)] for p in prints], np.uint64)
    u, v = simhash_dedup.bitsliced_links(np.array(group), words, 50)
    want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if group[i] == group[j] and (prints[i] ^ prints[j]).bit_count() <= 50}
    assert {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)} == want and len(want) > 100


def test_recall_on_the_small_documents(spark):
    """All pairs at 0.8 or more among the documents at hand, found by brute force over shared shingles."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no documents here")
    docs = spark.read.parquet(path)
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(simhash_dedup.shingle_hashes((r.text or "").encode(), 5, 42)) for r in rows}
    label = {i: i for i in sets}
    at = {}
    for i, s in sets.items():
        for h in s or ["none"]:
            at.setdefault(h, []).append(i)
    pairs = {p for ids in at.values() for p in itertools.combinations(sorted(ids), 2)}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs).collect()}
    found = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 50 and found / len(near) >= 0.999
    assert sum(got[i] != label[i] for i in got) <= 0.001 * len(got)


def test_split_joins_keep_all_rows(spark, texts, monkeypatch):
    """Keys cut into parts give the same classes: copies by the hundred, and a star of links."""
    from braidlex.llm import base

    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(300)] + [(2000 + i, None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    usual = [sorted(map(tuple, f().collect())) for f in (lambda: simhash_dedup.near_copies(docs), lambda: simhash_dedup.near_duplicates(docs), lambda: simhash_dedup.connected(star))]
    monkeypatch.setattr(base, "HOT_ROWS", 20)
    split = [sorted(map(tuple, f().collect())) for f in (lambda: simhash_dedup.near_copies(docs), lambda: simhash_dedup.near_duplicates(docs), lambda: simhash_dedup.connected(star))]
    assert usual == split and len(usual[0]) == len(rows) and {x for n, x in usual[2] if n < 500} == {0}


def test_rows_are_known_by_id_and_text(spark):
    """Texts that share an id are kept both; rows without an id are compared; of equal rows one stays, whatever the partitioning."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, "u"), (1, b, "u"), (2, a, "v"), (None, a, "w"), (None, c, "w"), (None, c, "x"), (None, c + " more", "y"), (5, d, "z"), (5, d, "z"), (5, d, "k"), (None, None, "n"), (7, "", "n")]
    seen = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        kept = simhash_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        seen.append(sorted((str(r.doc_id), r.text, r.source) for r in kept.collect()))
        ids = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_dedup.near_copies(docs).collect())
        assert ids == sorted([("1", "1")] * 2 + [("2", "1"), ("None", "1")] + [("None", "None")] * 3 + [("5", "5")] * 3 + [("None", "7"), ("7", "7")])
    assert seen[0] == seen[1]
    by_id = sorted((i, t) for i, t, _ in seen[0])
    assert [x for x in by_id if x[0] != "None"] == [("1", a), ("1", b), ("5", d), ("7", "")]
    nameless = [x for x in by_id if x[0] == "None"]
    assert len(nameless) == 1 and nameless[0][1] in (c, c + " more")


@pytest.mark.parametrize("hot", [100_000, 7])
def test_components_of_chains_stars_and_random_links(spark, monkeypatch, hot):
    from braidlex.llm import base

    monkeypatch.setattr(base, "HOT_ROWS", hot)
    r = random.Random(3)
    shuffled = r.sample(range(1000, 1200), 200)
    links = [(i, i + 1) for i in range(1, 120)] + list(itertools.pairwise(shuffled)) + [(500, 500 + k) for k in range(1, 90)] + [(r.randrange(2000, 2150), r.randrange(2000, 2150)) for _ in range(120)] + [(7, 8), (8, 7), (9000, 9000)]
    label = {}
    for a, b in links:
        low, high = sorted((label.setdefault(a, a), label.setdefault(b, b)))
        label = {k: low if v == high else v for k, v in label.items()}
    got = {x.node: x.label for x in simhash_dedup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {n for n in label if n not in got}
    assert got == {k: v for k, v in label.items() if k in got} and all(label[n] == n and list(label.values()).count(n) == 1 for n in alone)
    assert simhash_dedup.connected(spark.createDataFrame([], "a long, b long")).count() == 0
