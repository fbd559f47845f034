"""Long licence expressions keep their exact number of choices and their permissive choice."""

import pytest
from license_alternatives import evaluate

from braidlex.llm import license_scan


@pytest.mark.parametrize("expression,n_choices,permissive", [
    (" AND ".join(f"(MIT OR gpl-{i})" for i in range(7)), 2**7, True),
    (" AND ".join(f"(lgpl-{i} OR gpl-{i})" for i in range(7)), 2**7, False),
    (" OR ".join([*[f"gpl-{i}" for i in range(65)], "MIT"]), 66, True),
    ("(" + " OR ".join([*[f"gpl-{i}" for i in range(65)], "MIT"]) + ") AND gpl-x", 66, False),
    (" AND ".join(f"(MIT OR gpl-{i})" for i in range(70)), 2**63 - 1, True),
])
def test_long_expressions(expression, n_choices, permissive):
    *_, named, got, free = license_scan.scan_text(f"SPDX-License-Identifier: {expression}\n".encode())
    assert named and (got, free) == (n_choices, permissive)


@pytest.mark.parametrize("expression", ["MIT", "A OR B AND MIT", "(A OR MIT) AND Zlib", "A WITH X AND B", "(MIT OR B) WITH X", "a or (b and (c or d))"])
def test_short_expressions_as_before(expression):
    alternatives, _ = evaluate(expression)
    permissive = any(all(x.startswith(license_scan.PERMISSIVE) for x in s) for s in alternatives)
    assert license_scan.weigh(expression) == (frozenset(x for s in alternatives for x in s), len(alternatives), permissive)


@pytest.mark.parametrize("bad", ["MIT OR", "A B", "(A"])
def test_malformed_ones_give_no_choice(bad):
    assert license_scan.weigh(bad)[1:] == (0, False)
