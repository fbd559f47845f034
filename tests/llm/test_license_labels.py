"""Added labels and score against brute force; permissive families; prose behind a tag; long and repeated texts."""

import random
import re

import pytest

from braidlex.llm import license_scan


@pytest.mark.parametrize("expression,free", [
    ("CC-BY-NC-4.0", False), ("CC-BY-SA-4.0", False), ("CC-BY-ND-4.0", False), ("CC-BY-4.0", True), ("CC-BY", True), ("CC0-1.0", True), ("MIT-0", True), ("mitre-1", False), ("BSD-3-Clause", True), ("BSD-Protection", False),
    ("0BSD", True), ("BSL-1.0", True), ("GPL-3.0-only OR CC-BY-NC-4.0", False), ("GPL-3.0-only OR ISC", True),
])
def test_permissive_families(expression, free):
    assert license_scan.weigh(expression)[2] is free


@pytest.mark.parametrize("line,want", [
    ("MIT and then we went", ["MIT"]), ("MIT", ["MIT"]), ("see the file", []), ("MIT OR Apache-2.0 with thanks to all", ["MIT OR Apache-2.0"]), ("(MIT OR (then", ["( MIT"]), ("MIT OR", ["MIT OR"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0.", ["GPL-2.0-only WITH Classpath-exception-2.0"]), ("GPL-2.0+ AND LicenseRef-Own", ["GPL-2.0+ AND LicenseRef-Own"]), ("MIT and well-known things", ["MIT"]),
])
def test_prose_behind_a_tag_is_left_out(line, want):
    assert license_scan.expressions(f"é SPDX-License-Identifier: {line}\nMIT".encode()) == want
    assert license_scan.expressions(f"spdx-license-identifier {line}".encode()) == []  # no colon, no tag


def generated(r, depth):
    """An expression as a tree and its text."""
    if depth == 0 or r.random() < 0.3:
        name = r.choice(["MIT", "GPL-3.0-only", "Apache-2.0", "MPL-2.0", "ISC", "CC-BY-SA-4.0"])
        return (name.lower(), name)
    (a, left), (b, right) = generated(r, depth - 1), generated(r, depth - 1)
    kind = r.choice(["AND", "OR"])
    return ((kind, a, b), f"({left} {kind} {right})")


def names_of(tree):
    return {tree} if isinstance(tree, str) else names_of(tree[1]) | names_of(tree[2])


def test_labels_and_score_are_those_of_brute_force(spark):
    r = random.Random(9)
    phrases = license_scan.NOTICE_PHRASES | license_scan.BASE_PHRASES
    words = [w for p in phrases for w in p.split()] + ["other", "mits", "é"]
    rows, want = [], {}
    for i in range(300):
        parts, named, tags = [], set(), 0
        for _ in range(r.randrange(6)):
            parts += r.choice([r.choices(words, k=3), [r.choice(list(phrases)).title()], ["x,"]])
        for _ in range(r.choice([0, 0, 1, 2])):
            tree, text = generated(r, 3)
            parts.append(f"\nSPDX-License-Identifier: {text}\n")
            named |= names_of(tree)
            tags += 1
        text = " ".join(parts)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [label for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        rows.append((i, text))
        want[i] = (",".join(sorted(set(places) | named)), round(1 - 0.5 ** len(places) * 0.1**tags, 12))
    rows += [(i, t) for i, t in rows[:5]] + [(1000, "MIT License " * 200_000), (None, "mit license")]
    want |= {1000: ("mit", 1.0), None: ("mit", 0.5)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS n_words")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows) and all((r.labels, round(r.score, 12)) == want[r.doc_id] for r in got)
    assert next(r.n_base for r in got if r.doc_id == 1000) == 200_000


@pytest.mark.parametrize("line,labels,free", [
    ("HPND", "hpnd", False), ("JSON OR Ruby", "json,ruby", False), ("Vim", "vim", False), ("Sleepycat AND MIT", "mit,sleepycat", False), ("MIT AND 2020 Foo", "mit", True), ("MIT and 3 files follow", "mit", True),
    ("MIT and Python bindings", "mit", True), ("Python-2.0 OR PHP-3.01", "php-3.01,python-2.0", False), ("2024", "", False), ("X11-distribute-modifications-variant OR (Zlib-acknowledgement)", "x11-distribute-modifications-variant,zlib-acknowledgement", True),
    ("GPL-2.0-or-later WITH Bison-exception-2.2", "gpl-2.0-or-later-with-bison-exception-2.2", False), ("(MS-PL OR OGL-UK-3.0) AND Unicode-DFS-2016", "ms-pl,ogl-uk-3.0,unicode-dfs-2016", False), ("mitre", "", False), ("GPL-", "", False),
])
def test_identifiers_and_prose(line, labels, free):
    row = license_scan.scan_text(f"x\nSPDX-License-Identifier: {line}\ny".encode())
    assert row[5] == labels and row[9] is free


def test_every_family_is_found_in_any_case_and_version(spark):
    rows = [(i, f"SPDX-License-Identifier: {name}") for i, f in enumerate(sorted(license_scan.FAMILIES)) for name in (f, f.upper() + "-9.9", f.title() + "-1.0-only")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.labels for r in got) == sorted(t.split(": ")[1].lower() for _, t in rows)
    own = spark.createDataFrame([(1, "SPDX-License-Identifier: Own-1.0 OR MIT")], "doc_id long, text string")
    assert license_scan.scan(own).first().labels == "" and license_scan.scan(own, frozenset({"own", "mit"})).first().labels == "mit,own-1.0"
    assert len(license_scan.FAMILIES) <= 200 and license_scan.PROSE <= license_scan.FAMILIES
