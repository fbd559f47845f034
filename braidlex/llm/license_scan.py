"""License scans: an Aho-Corasick automaton finds notice phrases and
identifier tags; a shunting-yard parser evaluates AND / OR / WITH expressions.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
The automaton runs over the words joined by single spaces (one before, one
after), with each phrase padded alike, so a match is a run of whole words.

Base labels come from the four fixed phrases. The method adds labels from
further notice phrases and from ``SPDX-License-Identifier`` tags, which a
second automaton finds in the bytes as they are; the expression behind a tag
is read as far as identifiers and operators alternate (prose behind it is no
part of it) and parsed: its value is the set of licences that it names (with
their exceptions as ``id-with-exception``), the number of alternatives as
written (those of AND multiply, those of OR add up), and whether a permissive
choice exists; all three are exact for any length (the number up to 2^63 - 1).

Score: the licence evidence, 1 - (1 - 0.5)^places * (1 - 0.9)^tags, so none is
0 and each further place moves it nearer to 1 (from 60 places on it is 1 in
double precision, whatever follows).

Defined results. Null or empty text: no words, no labels, score 0. Repeated
rows each get a row. Extra columns are ignored. A malformed expression gives
the identifiers that it names, and no choice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import binary, columns_as

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases (of public licence texts) and the labels that they add.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Families whose terms let a licensee close the work; of the last one the plain form alone, without NC, SA or ND.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "boost", "zlib", "unlicense", "cc0", "cc-by")
_PERMISSIVE = re.compile(r"(?:mit|apache|0?bsd|isc|boost|zlib|unlicense|cc0)(?:[-.+ ].*)?|bsl-1\.0|cc-by(?:-[\d.]+)?")
#: Not permissive, though of such a family by name.
NOT_PERMISSIVE = frozenset(("bsd-protection",))
#: Families of public licence identifiers, without versions and variants. A longer list is a parameter of ``scan``.
FAMILIES = frozenset(
    "0bsd aal adsl afl agpl aladdin aml ampas antlr-pd apache apl apsl artistic bahyph barr beerware bittorrent blessing blueoak borceux bsd bsl bzip2 c-uda cal caldera catosl cc cc0 cddl cdla cecill "
    "cern-ohl clartistic cnri condor copyleft-next cpal cpl cpol cua-opl curl d-fsl doc drl ecl efl egenix elastic entessa epics epl erlpl etalab eudatagrid eupl eurosym fair frameworx freeimage fsfap "
    "fsful ftl gfdl giftware glide glwtpl gnuplot gpl gsoap haskellreport hippocratic hpnd htmltidy ibm-pibs icu ijg imagemagick info-zip intel interbase ipa ipl isc jasper jpnic json lal latex2e "
    "leptonica lgpl lgpllr libpng libselinux libtiff liliq linux-openib lpl lppl miros mit mitnfa mpich2 mpl ms-pl ms-rl mtll mulanpsl multics mup naist nasa nbpl ncgl ncsa net-snmp netcdf ngpl "
    "nist-pd nlod nlpl nosl noweb npl nposl nrl ntp o-uda occt-pl oclc odbl odc-by ofl ogc ogl ogtsl oldap oml openssl opl oset-pl osl parity pddl php polyform postgresql psf python qhull qpl "
    "rpl rpsl rsa-md rscpl ruby saxpath sendmail sgi-b sgp4 shl simpl sissl sleepycat snia spencer spl ssh-openssh sspl sugarcrm swl tapr-ohl tcl tcp-wrappers tmate tosl ucl unicode unlicense "
    "upl vim vostrom vsl w3c watcom wtfpl x11 xerox xfree86 xinetd xnet zed zend zimbra zlib zpl none noassertion licenseref documentref".split()
)
#: Families that are words of prose too: behind an operator they count only where it is in upper case.
PROSE = frozenset("apache artistic blessing condor doc elastic fair glide intel json multics none parity python ruby unicode vim watcom xerox zed curl".split())

_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BEHIND_TAG = re.compile(rb"\s*:[ \t]*([A-Za-z0-9.+()\- \t]+)")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"\(|\)|[^\s()]+")
_BINDS = {"or": 1, "and": 2, "with": 3}

_automaton = _tag_automaton = None


def tag_automaton() -> ahocorasick.Automaton:
    """Finds identifier tags in lower-cased bytes, read as one character each."""
    global _tag_automaton
    if _tag_automaton is None:
        built = ahocorasick.Automaton()
        for tag in (TAG.replace(" ", "-"), TAG.replace(" ", "_"), TAG):
            built.add_word(tag, len(tag))
        built.make_automaton()
        _tag_automaton = built
    return _tag_automaton


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        built = ahocorasick.Automaton()
        for phrases, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
            for phrase, label in phrases.items():
                built.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 2, label, base))
        built.add_word(f" {TAG} ", (3, len(TAG) + 2, "", False))
        built.make_automaton()
        _automaton = built
    return _automaton


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order; None if it is malformed."""
    out, waiting, want_operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDS:
            if want_operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            want_operand = True
        elif token == "(":
            if not want_operand:
                return None
            waiting.append(token)
        elif token == ")":
            if want_operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not want_operand:
                return None
            out.append(low)
            want_operand = False
    if want_operand:
        return None
    while waiting:
        if waiting[-1] == "(":
            return None
        out.append(waiting.pop())
    return out


def weigh(expression: str) -> tuple[frozenset[str], int, bool]:
    """The licences named, the number of alternatives as written, and whether one of them is permissive; no choice if malformed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return frozenset(t.lower() for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _BINDS), 0, False
    stack: list[tuple[list[str], int, bool]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(([token], 1, is_permissive(token)))
            continue
        (right, more, right_free), (left, n, left_free) = stack.pop(), stack.pop()
        if token == "with":
            exception = "-or-".join(sorted(set(right)))
            stack.append(([f"{x}-with-{exception}" for x in left], n, left_free))
        elif token == "and":
            stack.append((left + right, n * more, left_free and right_free))
        else:
            stack.append((left + right, n + more, left_free or right_free))
    names, n, free = stack[0]
    return frozenset(names), n, free


def is_permissive(identifier: str) -> bool:
    return identifier not in NOT_PERMISSIVE and _PERMISSIVE.fullmatch(identifier) is not None


def looks_like_id(token: str, before: str = "", families: frozenset[str] = FAMILIES) -> bool:
    """Whether a word behind a tag is an identifier, not prose: a family, alone or with versions and variants behind hyphens.

    ``before`` is the operator before it as written; an exception's name may be
    any hyphenated one. A number or a year alone is never an identifier.
    """
    pieces = token.split("-")
    family = next((f for n in range(len(pieces), 0, -1) if (f := "-".join(pieces[:n])) in families), None)
    if family is None or not all(pieces):
        return before.lower() == "with" and "-" in token.strip("-")
    return token not in PROSE or not before or before.isupper()


def expressions(text: bytes, families: frozenset[str] = FAMILIES) -> list[str]:
    """The licence expressions behind identifier tags: as far as identifiers and operators alternate.

    An operator before a word that is no identifier belongs to the prose; one
    with nothing behind it stays, and makes the expression malformed.
    """
    found = []
    for last, _ in tag_automaton().iter(text.translate(_LOWER).decode("latin-1")):
        match = _BEHIND_TAG.match(text, last + 1)
        if not match:
            continue
        kept, want_operand, depth = [], True, 0
        for token in _TOKEN.findall(match[1].decode()):
            low = token.lower()
            if token == "(" and want_operand:
                depth += 1
            elif token == ")" and depth and not want_operand:
                depth -= 1
            elif low in _BINDS and not want_operand:
                want_operand = True
            elif token not in "()" and low not in _BINDS and want_operand:
                operator = next((k for k in reversed(kept) if k != "("), "")
                if not looks_like_id(low.rstrip(".+"), operator, families):
                    while kept and (kept[-1].lower() in _BINDS or kept[-1] == "("):
                        kept.pop()
                    break
                token = token.rstrip(".")
                want_operand = False
            else:
                break
            kept.append(token)
        if kept:
            found.append(" ".join(kept))
    return found


def scan_text(text: bytes, families: frozenset[str] = FAMILIES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, n_choices, permissive."""
    words = text.translate(_WORD_TABLE).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    base, labels, starts, places, tags = set(), set(), [], 0, 0
    seen, word = 0, 0
    hits = sorted((end - size + 1, n, label, is_base) for end, (n, size, label, is_base) in automaton().iter(joined))
    for start, _, label, is_base in hits:
        word += joined.count(" ", seen, start)
        seen = start
        if not label:
            tags += 1
            continue
        labels.add(label)
        places += 1
        if is_base:
            base.add(label)
            starts.append(word)
    named = expressions(text, families) if tags else []
    choices, permissive = 0, False
    for expression in named:
        names, n, free = weigh(expression)
        labels |= names
        choices += n
        permissive |= free
    score = 1.0 - 0.5 ** min(places, 60) * 0.1 ** min(len(named), 60)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, named, min(choices, 2**63 - 1), permissive)


def scan(docs: DataFrame, families: frozenset[str] = FAMILIES) -> DataFrame:
    """One row per document: word and place counts, base and all labels, score, and the parsed expressions.

    ``families`` are the known identifiers in lower case, without versions.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("n_choices", pa.int64()), ("permissive_choice", pa.bool_()),
    ])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t or b"", families) for t in binary(batch.column("text"))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    texts = columns_as(docs, doc_id="bigint", text="string")
    return texts.mapInArrow(
        rows_of,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "expressions array<string>, n_choices long, permissive_choice boolean",
    )
