"""Language pairs, word lists, and token tags.

A text becomes an array of tokens and a string of tags, one character a token.
All later steps (segments, switch points, counts, neighbourhoods) are regular
expressions and array functions over that string, so a document is analysed in
one projection, without an explode or a shuffle.

Tags: ``z`` first language (``y``: an interjection of it); second language
``a`` known and ``b`` unknown word, ``c d`` interjection, ``e f`` discourse
marker, ``g h`` domain term (known, unknown each); ``n`` number, ``s`` sentence
end, ``p`` other mark.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x09-\x0D\x20\p{Z}"
L2_TAGS, L1_TAGS = "a-h", "yz"
SEGMENT = "[nsp]*[yz][yznsp]*|[nsp]*[a-h][a-hnsp]*|[nsp]+"

# The lists by which switches are attributed and scored.
DISCOURSE_MARKERS = (
    "like", "well", "so", "actually", "basically", "literally", "honestly", "anyway",
    "right", "okay", "ok", "sure", "exactly", "obviously", "seriously", "apparently",
)
INTERJECTIONS_L2 = ("oh", "wow", "oops", "hmm", "huh", "ah", "ugh", "yay", "omg")
INTERJECTIONS_L1 = ("哎", "唉", "哇", "嗯", "啊", "呀", "哦", "嘿", "诶")
DOMAIN_TERMS = (
    "debug", "deploy", "commit", "push", "pull", "merge", "code", "api", "database", "server", "frontend", "backend", "stack", "framework", "algorithm",
    "function", "variable", "interface", "module", "package", "library", "docker", "cloud",
    "meeting", "deadline", "project", "email", "schedule", "report", "budget", "client", "feedback", "presentation", "proposal", "strategy", "kpi", "roi",
    "paper", "research", "study", "thesis", "professor", "lecture", "seminar", "assignment", "course", "exam", "grade", "campus", "lab", "data", "model",
)
FIXED_EXPRESSIONS = (
    "by the way", "make sense", "no problem", "you know", "i mean", "come on", "take care", "oh my god", "for example", "in fact", "of course", "kind of", "sort of",
    "as well", "to be honest", "no wonder", "never mind", "on the other hand", "at the end", "long time no see", "no choice", "last time", "next time", "so far", "in case", "what the",
)
SENTENCE_ENDS = "。！？.!?"

#: Our own list of frequent English words; a longer one is a parameter (a text file, one word a line).
COMMON_WORDS = tuple(
    "a about after again all also always am an and any are around as ask at back be because been before best big but by call can come could day did do does done down each eat end "
    "enough even ever every far feel few find fine first for free from get give go good great had has have he help her here him his home how i if in into is it its just keep know last "
    "late let life like little long look make man many may me mean meeting more most much must my need never new next nice no not now of off office ok old on one only open or other our "
    "out over people plan please problem read ready really right said same say see she should show so some still such take tell than thank that the their them then there these they "
    "thing think this those time to today too try two under up us use very want was way we week well were what when where which while who why will with work would year yes yet you your".split()
)
#: Our own list of French function words, the default lexicon of the fr_en pair.
FRENCH_WORDS = tuple(
    "à ai aller alors après as au aussi autre aux avait avec avoir beaucoup bien bon ça car ce cela ces cette chez ci comme dans de des donc du elle elles en encore entre est et être eux "
    "fait faire fois ici il ils je la le les leur lui ma mais me mes moi mon même ne nos notre nous on ont ou où par pas peu peut plus pour quand que quel quelle qui quoi sa sans se ses si "
    "son sont sous sur ta te tes toi ton tous tout toute toutes très tu un une va vers vos votre vous y".split()
)


#: Our own lists of Spanish and Malay function words.
SPANISH_WORDS = tuple(
    "a al algo antes aquí así aún bien cada casi como con cual cuando de del desde donde dos el ella ellas ellos en entre era es esa ese eso esta estar este esto está están fue gracias ha hace hay "
    "hasta hoy la las le les lo los más me mi mucho muy nada ni no nos nosotros nuestro o otra otro para pero poco por porque pues que quien qué se ser si sin sobre solo son su sus sí también tan te "
    "tiene todo todos tu tus un una uno usted va vamos y ya yo".split()
)
MALAY_WORDS = tuple(
    "ada adalah akan aku anda antara apa atau awak baru belum bila boleh buat dah dalam dan dari dengan di dia dua hari ialah ini itu jadi jangan juga kalau kami kata ke kepada kerana kita lagi lah lebih "
    "makan mana mereka mesti nak nanti oleh orang pada pergi pula saja sama sangat satu saya sebab sedang semua sini sudah supaya tak tapi telah tempat tentang tidak untuk yang".split()
)


@dataclass(frozen=True)
class LanguagePair:
    """How to tell the two languages of a text apart: by script, or by a lexicon of the first one."""

    pair_id: str
    l1: str
    l2: str
    l1_script: str = ""
    endings: str = SENTENCE_ENDS
    lexicon: tuple[str, ...] = ()
    outside: bool = False  # the lexicon is a table: its words of a text come in a column
    common: tuple[str, ...] = field(default=COMMON_WORDS)
    markers: tuple[str, ...] = DISCOURSE_MARKERS
    interjections_l1: tuple[str, ...] = INTERJECTIONS_L1
    interjections_l2: tuple[str, ...] = INTERJECTIONS_L2
    expressions: tuple[str, ...] = FIXED_EXPRESSIONS

    def replaced(self, **values) -> LanguagePair:
        return replace(self, **values)

    @property
    def by_lexicon(self) -> bool:
        return bool(self.lexicon) or self.outside

    @property
    def ambiguous(self) -> tuple[str, ...]:
        """Words of the lexicon that are common in the second language too."""
        return tuple(sorted(set(self.lexicon) & set(self.common)))

    @property
    def token(self) -> str:
        word = r"\p{L}+" if self.by_lexicon else f"[{self.l1_script}]|[A-Za-z]+"
        return rf"{word}|\p{{Nd}}+|[^{SPACE}]"


_HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
#: Scripts of the pairs that are told apart by script, and endings.
PAIRS = {
    "zh_en": LanguagePair("zh_en", "zh", "en", _HAN),
    "yue_en": LanguagePair("yue_en", "yue", "en", _HAN),
    "min_en": LanguagePair("min_en", "min", "en", _HAN),
    "ja_en": LanguagePair("ja_en", "ja", "en", r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"),
    "hi_en": LanguagePair("hi_en", "hi", "en", r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", "।.!?"),
    "fr_en": LanguagePair("fr_en", "fr", "en", lexicon=FRENCH_WORDS, endings=".!?"),
    "es_en": LanguagePair("es_en", "es", "en", lexicon=SPANISH_WORDS, endings=".!?¿¡"),
    "ms_en": LanguagePair("ms_en", "ms", "en", lexicon=MALAY_WORDS, endings=".!?"),
}


def tokens(text: Column, pair: LanguagePair) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(pair.token), F.lit(0))


def _interjection(token: Column, pair: LanguagePair) -> Column:
    """An interjection of the first language; scripts with cases are compared in lower case."""
    return (F.lower(token) if pair.by_lexicon else token).isin(*pair.interjections_l1)


def _interjection_sql(t: str, pair: LanguagePair) -> str:
    return f"{f'lower({t})' if pair.by_lexicon else t} IN {_in(pair.interjections_l1)}"


def dealt(words: Column) -> Column:
    """An array of words as an array of about as many groups as a group has words, by a hash: a token is then sought in one group."""
    n = F.ceil(F.sqrt(F.greatest(F.size(words), F.lit(1)))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(words, lambda w: F.pmod(F.hash(w), n) == i))


def token_tag(token: Column, pair: LanguagePair, words: Column | None = None) -> Column:
    """``words``: the words of the text that are in the lexicon, ``dealt``, where it is a table."""
    low = F.lower(token)
    known = low.isin(*pair.common) | (F.length(token) <= 1)

    def pick(tag: str, unknown: str) -> Column:
        return F.when(known, tag).otherwise(unknown)

    second = (
        F.when(low.isin(*pair.interjections_l2), pick("c", "d"))
        .when(low.isin(*pair.markers), pick("e", "f"))
        .when(low.isin(*DOMAIN_TERMS), pick("g", "h"))
        .otherwise(pick("a", "b"))
    )
    first = F.when(_interjection(token, pair), "y").otherwise("z")
    if pair.by_lexicon:
        listed = low.isin(*pair.lexicon) if words is None else F.array_contains(F.get(words, F.pmod(F.hash(low), F.size(words))), low)
        out = F.when(token.rlike(r"^\p{L}"), F.when(listed, first).otherwise(second))
    else:
        out = F.when(token.rlike(f"^[{pair.l1_script}]"), first).when(token.rlike("^[A-Za-z]"), second)
    return out.when(token.rlike(r"^\p{Nd}"), "n").when(token.isin(*SENTENCE_ENDS), "s").otherwise("p")


def _in(words: tuple[str, ...] | str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def token_tag_sql(pair: LanguagePair, t: str = "t", listed: str | None = None) -> str:
    """The same tags in DuckDB; ``listed`` says whether a word is in the lexicon, where it is a table."""
    known = f"(lower({t}) IN {_in(pair.common)} OR length({t}) <= 1)"
    pick = lambda a, b: f"CASE WHEN {known} THEN '{a}' ELSE '{b}' END"
    second = (
        f"CASE WHEN lower({t}) IN {_in(pair.interjections_l2)} THEN {pick('c', 'd')} WHEN lower({t}) IN {_in(pair.markers)} THEN {pick('e', 'f')} "
        f"WHEN lower({t}) IN {_in(DOMAIN_TERMS)} THEN {pick('g', 'h')} ELSE {pick('a', 'b')} END"
    )
    first = f"CASE WHEN {_interjection_sql(t, pair)} THEN 'y' ELSE 'z' END"
    if pair.by_lexicon:
        head = f"WHEN regexp_matches({t}, '^\\p{{L}}') THEN CASE WHEN {listed or f'lower({t}) IN {_in(pair.lexicon)}'} THEN {first} ELSE {second} END"
    else:
        head = f"WHEN regexp_matches({t}, '^[{pair.l1_script}]') THEN {first} WHEN regexp_matches({t}, '^[A-Za-z]') THEN {second}"
    return f"CASE {head} WHEN regexp_matches({t}, '^\\p{{Nd}}') THEN 'n' WHEN {t} IN {_in(SENTENCE_ENDS)} THEN 's' ELSE 'p' END"
