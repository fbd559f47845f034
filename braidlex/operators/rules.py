"""A pair's evaluation tables compiled to scores and violations.

One table of ``Rule`` rows is the source of everything: the sub-scores that
configuration decides (their deductions are summed), the violations of every
checker, and the lines of the report. Rules are SQL over the columns of the
analysis and the scores, the same text in Spark and in the DuckDB twin; only
the literals of records and lists differ.

A violation is a record of provenance: checker, rule, the numbers that broke
it, and the token at which it shows first (null where it is the whole text).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from braidlex.functions.lang import LanguagePair

# The default expectations by archetype.
SWITCH_TYPE = {"ARC_01": {"intra_min": 0.70}, "ARC_02": {"inter_min": 0.60}, "ARC_03": {"intra_min": 0.50, "min_switch_density": 0.15}, "ARC_04": {}, "ARC_05": {"max_cmi": 0.15}, "ARC_06": {}}
L2_SPAN = {"ARC_01": {"typical_max": 3.0}, "ARC_02": {"typical_min": 4.0}, "ARC_03": {"typical_max": 5.0}}
#: What the two tables may say of an archetype. A density is read and kept; no score depends on it.
KNOWN_SWITCH, KNOWN_SPAN = ("intra_min", "inter_min", "max_cmi", "min_switch_density"), ("typical_max", "typical_min")
#: The longest run of second-language words where a typical maximum is set.
LONGEST_RUN = 5


@dataclass(frozen=True)
class Rules:
    """The tables of one pair."""

    switch_type: dict[str, dict[str, float]] = field(default_factory=lambda: SWITCH_TYPE)
    l2_span: dict[str, dict[str, float]] = field(default_factory=lambda: L2_SPAN)
    fillers: tuple[str, ...] = ()
    interjections: tuple[str, ...] = ()
    shifts: dict[str, float] = field(default_factory=dict)
    behaviours: dict[str, str] = field(default_factory=dict)
    proficiencies: dict[str, str] = field(default_factory=dict)
    levels: dict[str, str] = field(default_factory=dict)

    def words(self, pair: LanguagePair) -> LanguagePair:
        """The pair with these fillers as discourse markers (those of several words as fixed expressions) and these interjections, besides its own."""

        def besides(own: tuple[str, ...], more: tuple[str, ...], several: bool = False) -> tuple[str, ...]:
            return tuple(dict.fromkeys((*own, *(w.lower() for w in more if w and bool(re.search(r"\s", w)) == several))))

        return pair.replaced(
            markers=besides(pair.markers, self.fillers), expressions=besides(pair.expressions, self.fillers, several=True),
            interjections_l1=besides(pair.interjections_l1, self.interjections), interjections_l2=besides(pair.interjections_l2, self.interjections),
        )


def read_rules(evaluation: dict, calibration: dict | None = None, prompts: dict | None = None) -> Rules:
    """Rules from a pair's parsed evaluation.yaml, calibration.json and prompts.yaml; a table or rule that is not known is an error."""

    def expectations(name: str, known: tuple[str, ...], default: dict) -> dict[str, dict[str, float]]:
        table = evaluation.get(name)
        if table is None:
            return default
        out = {}
        for archetype, given in table.items():
            if not re.fullmatch(r"\w+", str(archetype)):
                raise ValueError(f"{name}: {archetype!r} is no archetype")
            rules = {k: v for k, v in (given or {}).items() if k != "desc"}
            for rule, value in rules.items():
                if rule not in known:
                    raise ValueError(f"{name}, {archetype}: no rule {rule!r}; there are {', '.join(known)}")
                if not isinstance(value, (int, float)) or isinstance(value, bool):
                    raise ValueError(f"{name}, {archetype}, {rule}: {value!r} is no number")
            out[archetype] = {rule: float(value) for rule, value in rules.items()}
        return out

    def shifts_of(by_topic: dict | list) -> dict[str, float]:
        rows = by_topic.items() if isinstance(by_topic, dict) else ((r.get("topic"), r) for r in by_topic)
        return {str(k): float(v["mean_shift"]) for k, v in rows if isinstance(v, dict) and "mean_shift" in v}

    allowed = {"switch_type_expectations", "l2_span_expectations", "filler_words", "interjections"}
    for key, value in evaluation.items():
        if isinstance(value, dict) and key not in allowed and not str(key).startswith("_"):
            raise ValueError(f"no evaluation table {key!r}; there are {', '.join(sorted(allowed))}")
    texts = lambda name: {str(k): str(v) for k, v in ((prompts or {}).get(name) or {}).items()}
    return Rules(
        expectations("switch_type_expectations", KNOWN_SWITCH, SWITCH_TYPE), expectations("l2_span_expectations", KNOWN_SPAN, L2_SPAN),
        tuple(evaluation.get("filler_words") or ()), tuple(evaluation.get("interjections") or ()),
        shifts_of((calibration or {}).get("cmi_distribution", {}).get("by_topic") or {}), texts("cs_behavior_templates"), texts("proficiency_descriptions"), texts("mixing_level_descriptions"),
    )


@dataclass(frozen=True)
class Rule:
    """When it is broken (SQL), what it costs (SQL; empty where the score has its own steps), the numbers that say so, and the first token."""

    checker: str
    name: str
    broken: str
    numbers: tuple[str, ...] = ()
    token: str = "CAST(NULL AS INT)"
    part: str = ""
    cost: str = ""
    text: str = ""


_INTRA, _INTER, _SPAN = "CAST(n_intra AS DOUBLE) / n_switches", "CAST(n_inter AS DOUBLE) / n_switches", "CAST(n2 AS DOUBLE) / l2_segs"


def number(value: float) -> str:
    """A literal with a point, so that it becomes a double."""
    text = f"{value:.10f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


def profile_rules(rules: Rules) -> list[Rule]:
    """The rules of both tables, with what they cost."""
    out = []
    for archetype, given in rules.switch_type.items():
        of = f"archetype = '{archetype}' AND n_switches > 0 AND "
        for key, share in (("intra_min", _INTRA), ("inter_min", _INTER)):
            if key in given:
                least = number(given[key])
                out.append(Rule("profile_consistency", key, f"{of}{share} < {least}", (share, least), "at_switch", "switch_type", f"least(5.0, ({least} - {share}) * 15)", "share of such switches {0}, wanted {1}"))
        if "max_cmi" in given:
            most = number(given["max_cmi"])
            out.append(Rule("profile_consistency", "max_cmi", f"{of}cmi > {most}", ("cmi", most), "at_switch", "switch_type", "4.0", "mixing index {0}, wanted {1} at most"))
    for archetype, given in rules.l2_span.items():
        of = f"archetype = '{archetype}' AND l2_segs > 0 AND "
        if "typical_max" in given:
            most = number(given["typical_max"])
            out.append(Rule("profile_consistency", "typical_max", f"{of}{_SPAN} > {most} * 1.5", (_SPAN, most), "at_longest", "l2_span", "6.0", "second language in runs of {0} words, wanted {1} at most"))
            out.append(Rule("profile_consistency", "longest_run", f"{of}l2_longest > {LONGEST_RUN}", ("l2_longest", most), "at_longest", "l2_span", "4.0", "a run of {0} words in the second language, wanted {1} at most"))
        if "typical_min" in given:
            least = number(given["typical_min"])
            out.append(Rule("profile_consistency", "typical_min", f"{of}{_SPAN} < {least} * 0.5", (_SPAN, least), "at_longest", "l2_span", "3.0", "second language in runs of {0} words, wanted {1} at least"))
    return out


def part_score(rules: Rules, part: str) -> str:
    """A sub-score: ten less what the broken rules of ``part`` cost, not below zero."""
    costs = [f"CASE WHEN {r.broken} THEN {r.cost} ELSE 0.0 END" for r in profile_rules(rules) if r.part == part]
    return f"greatest(0.0, 10.0 - ({' + '.join(costs) or '0.0'}))"


_OPEN = "guard = '' AND "
_LESS, _MORE = "cmi_lo - cmi", "cmi - cmi_hi"
_OFF = f"CASE WHEN cmi < cmi_lo THEN {_LESS} ELSE {_MORE} END"
_EXPECTED = "cmi_lo IS NOT NULL AND (cmi < cmi_lo OR cmi > cmi_hi) AND "


def all_rules(rules: Rules, regions: tuple[str, ...]) -> list[Rule]:
    """The rules of every checker, in the order of the report. Diversity needs the columns of ``scoring.diversity``."""
    per = "CAST(n_content AS DOUBLE) / n_segs"
    dominant = "CAST(greatest(n1, n2) AS DOUBLE) / n_content"
    out = [
        Rule("fluency", "one_language", "guard = 'one language'", ("n1", "n2"), text="words of the two languages: {0} and {1}"),
        Rule("fluency", "too_few_tokens", "guard = 'too few tokens'", ("n_content", "5"), text="{0} words, at least {1}"),
        Rule("fluency", "too_many_tokens", "guard = 'too many tokens'", ("n_content", "500"), text="{0} words, at most {1}"),
        Rule("fluency", "garbage", "guard = 'garbage'", text="markup or stray characters"),
        Rule("fluency", "reasoning", "guard = 'reasoning'", text="traces of reasoning"),
        Rule("fluency", "l1_single", f"{_OPEN}l1_segs > 0 AND l1_single * 2 > l1_segs", ("l1_single", "l1_segs"), "at_l1_single", text="{0} of {1} runs of the first language are single words"),
        Rule("fluency", "l2_unknown", f"{_OPEN}n2 > 0 AND CAST(n_unknown AS DOUBLE) / n2 > 0.7", ("n_unknown", "n2"), "at_unknown", text="{0} of {1} words of the second language are unknown"),
        Rule("fluency", "brackets", f"{_OPEN}unbalanced", text="a bracket without its other half"),
        Rule("fluency", "cut_off", f"{_OPEN}cut_off", ("n_tokens",), "n_tokens - 1", text="ends in the middle, after {0} tokens"),
        Rule("naturalness", "ping_pong", f"n_content > 0 AND {per} < 1.5", (per,), "at_switch", text="{0} words a run"),
        Rule("naturalness", "many_switches", f"n_content > 0 AND {per} >= 1.5 AND {per} < 2.5", (per,), "at_switch", text="{0} words a run"),
        Rule("naturalness", "hardly_mixed", "n_content > 0 AND cmi < 0.02", ("cmi",), text="mixing index {0}"),
        Rule("naturalness", "few_switches", "n_content > 0 AND cmi >= 0.02 AND cmi < 0.05 AND n_switches <= 1", ("n_switches",), "at_switch", text="{0} switches"),
        Rule("naturalness", "l2_single", "l2_segs > 2 AND CAST(l2_single AS DOUBLE) / l2_segs > 0.8", ("l2_single", "l2_segs"), "at_l2_single", text="{0} of {1} runs of the second language are single words"),
        Rule("naturalness", "no_matrix", f"n_content > 0 AND {dominant} < 0.55", (dominant,), text="the leading language has a share of {0}"),
        Rule("naturalness", "inside_words", "n_adjacent > 3", ("n_adjacent",), text="{0} switches inside a word"),
        Rule("switch_motivation", "no_motive", "n_switches > 0 AND attribution < 0.20", ("attribution",), "at_unmotivated", text="a share of {0} has a motive"),
        Rule("profile_consistency", "cmi_off", f"{_EXPECTED}{_OFF} > 0.05 AND {_OFF} <= 0.10", ("cmi", "cmi_lo", "cmi_hi"), text="mixing index {0}, wanted {1} to {2}"),
        Rule("profile_consistency", "cmi_far_off", f"{_EXPECTED}{_OFF} > 0.10", ("cmi", "cmi_lo", "cmi_hi"), text="mixing index {0}, wanted {1} to {2}"),
        *profile_rules(rules),
        Rule("profile_consistency", "no_domain_word", "n_domain = 0", text="none of the wanted words"),
        Rule("cultural_coherence", "informal", "formality = 'semi_formal' AND n_informal > 0", ("n_informal",), text="{0} informal words"),
    ]
    out += [Rule("cultural_coherence", f"words_of_{r}", f"region <> '' AND region <> '{r}' AND n_{r} > 0", (f"n_{r}",), f"at_{r}", text="{0} words of another region") for r in regions]
    fresh = "NOT is_copy AND before_all > 0 AND "
    return out + [
        Rule("diversity", "copy", "is_copy", text="a copy of an earlier text"),
        Rule("diversity", "known_passages", f"{fresh}overlap > 0.50", ("overlap",), text="a share of {0} stands in earlier texts"),
        Rule("diversity", "known_pattern", f"{fresh}before_all > 100 AND pattern_share > 0.10", ("pattern_share",), text="a share of {0} has the same switches"),
    ]


def _rounded(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6)"


def violations(rules: list[Rule], dialect: str = "spark") -> str:
    """SQL for the array of broken rules: checker, rule, numbers, token."""
    if dialect == "spark":
        record = lambda r: f"named_struct('checker', '{r.checker}', 'rule', '{r.name}', 'numbers', CAST(array({', '.join(map(_rounded, r.numbers))}) AS ARRAY<DOUBLE>), 'token', CAST({r.token} AS INT))"
        return "array_compact(array(" + ", ".join(f"CASE WHEN {r.broken} THEN {record(r)} END" for r in rules) + "))"
    record = lambda r: f"{{'checker': '{r.checker}', 'rule': '{r.name}', 'numbers': [{', '.join(map(_rounded, r.numbers))}]::DOUBLE[], 'token': CAST({r.token} AS INT)}}"
    return "list_filter([" + ", ".join(f"CASE WHEN {r.broken} THEN {record(r)} END" for r in rules) + "], lambda v: v IS NOT NULL)"


def line(rule: Rule) -> str:
    """SQL for the rule's line of the report; numbers with three digits, whole ones without."""
    pieces = []
    for piece in re.split(r"(\{\d\})", rule.text):
        if re.fullmatch(r"\{\d\}", piece):
            sql = rule.numbers[int(piece[1])]
            pieces.append(f"CAST({sql} AS STRING)" if re.fullmatch(r"\d+|n_\w+|n[12]|l[12]_\w+", sql) else f"CAST(CAST(floor(CAST({sql} AS DOUBLE) * 1000 + 0.500001) / 1000 AS DECIMAL(10,3)) AS STRING)")
        elif piece:
            pieces.append("'" + piece + "'")
    return " || ".join(pieces)


def report(rules: list[Rule], checker: str) -> str:
    """SQL for the lines of one checker's broken rules, each after a line break."""
    mine = [r for r in rules if r.checker == checker]
    return " || ".join(f"CASE WHEN {r.broken} THEN chr(10) || '    -> {r.name}: ' || {line(r)} ELSE '' END" for r in mine) or "''"


DEFAULT = Rules()
