"""Words of a text that are in a lexicon's table are dealt into groups: a token is not compared with all of them."""

from pyspark.sql import functions as F

from braidlex.functions import lang
from braidlex.functions.lang import PAIRS
from braidlex.operators import analysis as A
from braidlex.plans import lexicon


def _word(i: int) -> str:
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_groups_of_a_long_text_are_short_and_tags_are_those_of_a_list(spark):
    words = [_word(7 * i) for i in range(6000)]
    texts = spark.createDataFrame([(1, " ".join(words).upper() + " 12 xx."), (2, "no such thing"), (3, None), (4, words[5])], "doc_id long, text string")
    sizes = [len(g) for g in spark.range(1).select(lang.dealt(F.array(*map(F.lit, words[:2000]))).alias("g")).first().g]
    assert sum(sizes) == 2000 and max(sizes) < 100  # of 45 on average
    listed = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    got = {r.doc_id: r.tags for r in lexicon.analyze(texts, PAIRS["fr_en"], listed, limit=10).collect()}
    known = set(words[::2])
    want = {r.doc_id: "".join("z" if t.lower() in known else x for t, x in zip(r.toks, r.tags)) for r in A.analyze(texts, PAIRS["fr_en"].replaced(lexicon=("qqqqq",))).collect()}
    assert got == want
