"""The operators against brute force, on small tables with nulls, ties, repeats, long and empty texts, extra columns."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
import xxhash
from license_alternatives import evaluate
from pyspark.sql import functions as F

from braidlex.llm import decontaminate, html_extract, jpeg, license_scan, lm_score, media, mixing, sharding, simhash_dedup, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, topic_x int"


def corpus(n=120, seed=1):
    """Texts with copies, near copies, shared passages, repeats inside one text, empty and null ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "é", "ß", "#"]
    passage = " ".join(r.choices(words, k=45))
    out = []
    for i in range(n):
        k = i % 10
        body = r.choices(words, k=r.choice([0, 1, 3, 19, 20, 21, 60, 150]))
        if k == 1 and out:
            text = out[-1]
        elif k == 2 and out and out[-1]:
            near = out[-1].split(" ")
            near[len(near) // 2] = "changed"
            text = " ".join(near)
        elif k in (3, 4):
            text = " ".join(body) + "\n" + passage + "\t" + " ".join(r.choices(words, k=5))
        elif k == 5:
            text = " ".join(["tick"] * 50)
        elif k == 6:
            text = None
        elif k == 7:
            text = ""
        else:
            text = "  ".join(body) + "\x0b"
        out.append(text)
    return out


@pytest.fixture(scope="module")
def rows():
    texts = corpus()
    out = [(i * 3, t, "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}", 0, 7, "x", 1) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[3], "en", None, 0, 7, "x", 1)]  # repeated rows, and one without an id


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("chunk,window", [(100, 20), (600_000, 20), (50, 5), (80, 1), (150, 9), (600_000, 50)])
def test_substring_dedup(docs, rows, monkeypatch, chunk, window):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs, window).collect()}
    seen = set()
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}):
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            gone |= set(range(k, k + window)) if g in seen else set()
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert got[None].n_removed == 0


def test_lm_score(docs, rows, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 700)
    got = sorted((r.n_words, r.n_backoff, round(r.log_score, 6)) for r in lm_score.score(docs, 3).collect())
    texts = [words_of(r[1]) for r in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    every = {n: Counter(g for w in texts for g in grams(w, n)) for n in (1, 2, 3)}
    total = sum(map(len, texts))
    want = []
    for w in texts:
        own = {n: Counter(grams(w, n)) for n in (1, 2, 3)}
        left = lambda g: every[len(g)][g] - own[len(g)][g]  # noqa: E731, B023
        score, backs = 0.0, 0
        for i in range(len(w)):
            n, penalty = min(3, i + 1), 0.0
            while n > 1 and left(tuple(w[i - n + 1 : i + 1])) <= 0:
                n, penalty, backs = n - 1, penalty + math.log(lm_score.ALPHA), backs + 1
            g = tuple(w[i - n + 1 : i + 1])
            score += penalty + (math.log(max(left(g), 0.5) / total) if n == 1 else math.log(left(g) / max(left(g[:-1]), 1)))
        want.append((len(w), backs, round(score, 6)))
    assert len(got) == len(want) and all(abs(a[2] - b[2]) < 2e-6 and a[:2] == b[:2] for a, b in zip(got, sorted(want), strict=True))


def test_masks_find_all_patterns():
    masks = [sum(1 << i for i, x in enumerate(m) if x == "1") for m in decontaminate.MASKS]
    spans = [len(m) for m in decontaminate.MASKS]
    for gone in itertools.combinations(range(20), 4):
        left = ((1 << 20) - 1) & ~sum(1 << i for i in gone)
        assert any(left >> o & m == m for m, n in zip(masks, spans, strict=True) for o in range(20 - n + 1))


def test_decontaminate(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [" ".join(r.choices(vocabulary, k=r.choice([8, 15, 25, 40]))) for _ in range(12)]
    texts, want = [], set()
    for i in range(60):
        body = r.choices(vocabulary, k=80)
        if i % 2:
            item = r.randrange(12)
            w = items[item].split()
            if len(w) >= 20 and i % 3:
                for k in r.sample(range(20), 4):
                    w[k] = "other"
            body[30:30] = [x.upper() + "," for x in w]
            want.add((i, item))
        texts.append((i, " ".join(body), 1))
    texts += [(98, None, 1), (99, "", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([*enumerate(items), (50, None), (51, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()}
    assert got == want
    clean = decontaminate.clean(docs, tests)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in texts} - {i for i, _ in want}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()} == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == len(texts)


def test_html_extract(spark):
    page = (
        "<html><head><title>x</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy now, today.</div><article><h1>Title &amp; more</h1>"
        "<p><b>Lead <br>text.<p>First,\n paragraph &eacute;.</p><form>mail</form><div class='comments'>Great post, thanks.</div></article><footer>&copy; me</footer>"
    )
    rows = [(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p>Only text, without more.", 5), (4, "u", "<nav>menu</nav>", 5)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect())
    main = "Title & more Lead text. First, paragraph é."
    assert [g[1] for g in got] == ["Only text, without more.", main, main, "", "", ""] and all(len(t) == n for _, t, n in got)


@pytest.mark.parametrize("tile", [1024, 4])
def test_simhash(docs, rows, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    got = simhash_dedup.near_duplicates(docs, 4, 4).collect()
    prints = {}
    for i, text, *_ in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    distinct = sorted(set(prints.values()))
    label = {p: p for p in distinct}
    for _ in distinct:
        for a, b in itertools.combinations(distinct, 2):
            if (a ^ b).bit_count() <= 4:
                label[a] = label[b] = min(label[a], label[b])
    best = {}
    for i, p in prints.items():
        if i is not None:
            best[label[p]] = min(best.get(label[p], i), i)
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == best[label[prints[r.doc_id]]] for r in got)


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_copies(docs, rows, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    label = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs).collect()}
    sets = {i: frozenset(simhash_dedup.shingle_hashes((t or "").encode(), 5, 42)) for i, t, *_ in rows if i is not None}
    alike = lambda a, b: 1.0 if sets[a] == sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(a, b) >= 0.8:
            assert label[a] == label[b]
    for a in sets:  # nothing is linked but over similar texts
        assert label[a] == a or any(alike(a, b) >= 0.6 for b in sets if b != a and label[b] == label[a])
        assert label[a] == min(b for b in sets if label[b] == label[a])
    kept = simhash_dedup.keep_one(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert kept.columns == docs.columns and sorted(ids) == sorted(set(label.values()))


def test_bitsliced_links_all_distances():
    import numpy as np

    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(8))) for b in base for _ in range(40)]
    group = sorted(r.randrange(3) for _ in prints)
    u, v = simhash_dedup.bitsliced_links(np.array(group), np.array(prints, np.uint64), 4)
    want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if group[i] == group[j] and (prints[i] ^ prints[j]).bit_count() <= 4}
    assert {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)} == want


def test_mixing(docs, rows, spark):
    wanted = {"source": 0.3, "lang": 0.5, "topic": 1.0}
    out = mixing.mix(docs, wanted, sweeps=30).toPandas()
    assert len(out) == len(rows)
    for dim, power in wanted.items():
        seen = (out.weight * out.n_tokens).groupby(out[dim]).sum()
        tokens = out.n_tokens.groupby(out[dim]).sum().astype(float)
        goal = tokens[tokens > 0] ** power
        assert ((seen / seen.sum())[goal.index] - goal / goal.sum()).abs().max() < 1e-3
    assert ((out.copies - out.weight).abs() < 1).all()
    table = spark.createDataFrame([("hot", 1.0)], "value string, share double")
    only = mixing.mix(docs, wanted | {"source": table}, sweeps=3).toPandas()
    assert (only[only.source != "hot"].weight == 0).all()
    kept = mixing.sample(docs, wanted)
    assert kept.columns == docs.columns and set(kept.toPandas().doc_id.dropna()) == set(out[out.copies > 0].doc_id.dropna())


def test_sharding(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 8)
    out = sharding.digest(docs, 7).toPandas()
    assert len(out) == len(rows)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 7
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)
    by_source = out.assign(source=out.source.fillna("")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by_source.max(axis=1) - by_source.min(axis=1)).max() <= 2
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out.itertuples():
        text = texts[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    again = sharding.digest(docs.repartition(5), 7).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_segments_are_maximal():
    """Ruzzo-Tompa by its definition: the best stretch, then the same left and right of it."""

    def brute(values, shift=0):
        best = max(((sum(values[i:j]), -(j - i), -i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return brute(values[:i], shift) + [(shift + i, shift + j, best[0])] + brute(values[j:], shift + j)

    r = random.Random(3)
    for _ in range(300):
        values = [r.choice([-5, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(16))]
        got = toxicity.segments(values)
        want = brute(values)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_toxicity(spark):
    r = random.Random(4)
    plain, bad = [f"word{i}" for i in range(200)], ["vile", "nasty", "zorkel"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = r.choices(plain, k=40)
        if toxic:
            w[5:5] = [r.choice(bad) + r.choice(["", "s", "ing"]) for _ in range(3)]
        rows.append((i, " ".join(w), toxic))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, False), (1001, "", False), (1002, "vile " * 5000, True)]
    docs, known = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([*labels, (2000, None, None)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(out[i].predicted == int(t) for i, _, t in rows if i in held)
    assert right / len(held) > 0.97 and all(0 <= x.score <= 1 for x in out.values()) and out[1002].predicted == 1 and out[1000].predicted == 0
    assert {x.doc_id for x in docs.withColumn("h", toxicity.held_out(F.col("doc_id"))).filter("h").collect()} == held
    clean = toxicity.clean(docs, known)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {i for i, x in out.items() if x.predicted == 0}
    assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, known.limit(0))).collect()} == {0.0}


def test_jpeg_round_trip_and_slow_path():
    for n in (0, 1, 64, 65, 700, 30_000):
        for data in (os.urandom(n), bytes([255, 254]) * (n // 2), b"a" * n):
            payload = jpeg.padded(data)
            file = jpeg.encode(payload)
            image = jpeg.decode(file)
            assert image.payload() == payload and image.rgb().shape == (image.height, image.width, 3)
            if n < 1000:
                slow = jpeg.decode(file, fast=False)
                assert all((a.coefficients == b.coefficients).all() for a, b in zip(image.components, slow.components, strict=True))


def test_jpeg_samples_follow_the_formula():
    import math

    import numpy as np

    block = np.zeros(64)
    block[[0, 1, 2, 9]] = 40, -20, 15, 7  # zigzag places
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = block
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    want = [sum(c(u) * c(v) / 4 * natural[v * 8 + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for y in range(8) for x in range(8)]
    assert np.abs(block.astype(np.float32) @ jpeg.IDCT - want).max() < 1e-3


def test_media(docs, rows):
    files = media.to_media(docs)
    out = media.from_media(files).collect()
    assert len(out) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        text = texts[r.doc_id]
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.rgb) == r.height * r.width * 3
    by_text = {}
    for r in out:
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    nothing = media.from_media(files.withColumn("media", F.lit(None).cast("binary"))).first()
    assert nothing.payload_bytes is None and nothing.rgb is None


def test_license_scan(spark):
    texts = [
        "Under the MIT License and the Apache-License; GNU General Public License.", "CC BY-NC 4.0, CC-BY", None, "", "mit mit license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Zlib",
        "SPDX-License-Identifier: MIT OR", "emitlicense mit licenses", "é mit license ß",
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None)) and 0 <= r.score <= 1
    assert got[5].labels == "gpl-2.0-only-with-classpath-exception-2.0,mit,zlib" and got[5].n_choices == 2 and got[5].permissive_choice
    assert got[6].expressions == ["MIT OR"] and got[6].n_choices == 0


@pytest.mark.parametrize("expression,want", [
    ("MIT", {("mit",)}), ("A OR B AND C", {("a",), ("b", "c")}), ("(A OR B) AND C", {("a", "c"), ("b", "c")}), ("A WITH X AND B", {("a-with-x", "b")}), ("a or (b and (c or d))", {("a",), ("b", "c"), ("b", "d")}),
])
def test_license_expressions(expression, want):
    found, well_formed = evaluate(expression)
    assert well_formed and {tuple(sorted(s)) for s in found} == want


@pytest.mark.parametrize("bad", ["", "AND", "A B", "(A", "A)", "A OR", "WITH A", "()"])
def test_malformed_expressions(bad):
    assert license_scan.to_postfix(bad) is None and not evaluate(bad)[1]


def test_empty_tables(empty, spark):
    tests, labels = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        substring_dedup.drop_repeats(empty), lm_score.score(empty), decontaminate.leaks(empty, tests), simhash_dedup.near_duplicates(empty), mixing.mix(empty, {"source": 0.3, "lang": 0.5, "topic": 0.7}, sweeps=1),
        sharding.digest(empty), toxicity.score(empty, toxicity.fit(empty, labels)), media.from_media(media.to_media(empty)), license_scan.scan(empty),
        html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0
