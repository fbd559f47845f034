"""Voice matching and audio timing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlex.plans.tables import cut

# Region keys in order, and the keywords from which gender and age are inferred.
REGION_ACCENT = (
    ("中国大陆", "mainland"), ("mainland", "mainland"), ("北京", "mainland"), ("上海", "mainland"), ("香港", "hongkong"), ("hongkong", "hongkong"), ("hong kong", "hongkong"), ("台湾", "taiwan"),
    ("taiwan", "taiwan"), ("新加坡", "singapore"), ("singapore", "singapore"), ("马来西亚", "malaysia"), ("malaysia", "malaysia"),
)
FEMALE = ("女", "female", "她", "mother", "sister", "妈", "姐", "妹", "小姐", "阿姨", "lady", "woman")
MALE = ("男", "male", "他", "father", "brother", "爸", "哥", "弟", "先生", "叔", "uncle", "man")
YOUNG = ("学生", "student", "大学", "university", "研究生", "grad", "实习", "intern", "college", "undergraduate", "读研", "读博", "bachelor")
SENIOR = ("教授", "professor", "senior", "退休", "retired", "老", "elder", "veteran", "资深")
#: Marks behind which speech is cut, and the longest piece that short ones are joined to.
SPEECH_MARKS, PIECE = "。！？.!?，,、；;：:", 30
#: Our own voices.
VOICES = (
    ("v1", "female", "young", ("zh", "en"), "mainland"), ("v2", "male", "young", ("zh", "en"), "singapore"), ("v3", "female", "middle", ("yue", "en"), "hongkong"),
    ("v4", "male", "middle", ("zh",), "mainland"), ("v5", "female", "senior", ("en",), "malaysia"), ("v6", "male", "senior", ("zh", "en"), "taiwan"), ("v7", "female", "young", ("fr", "en"), "singapore"),
)


def accent(region: Column) -> Column:
    low = F.lower(region)
    out = F.when(F.contains(low, F.lit(REGION_ACCENT[0][0])), REGION_ACCENT[0][1])
    for key, value in REGION_ACCENT[1:]:
        out = out.when(F.contains(low, F.lit(key)), value)
    return out.otherwise(low)


def _hits(low: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def gender(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_hits(low, FEMALE) > _hits(low, MALE), "female").when(_hits(low, MALE) > _hits(low, FEMALE), "male").otherwise("unknown")


def age_group(text: Column, profession: Column) -> Column:
    low = F.lower(F.concat_ws(" ", text, profession))
    return F.when(_hits(low, YOUNG) > 0, "young").when(_hits(low, SENIOR) > 0, "senior").otherwise("middle")


#: Voices of a catalogue that travels as one row; signatures in one piece of an index, and voices in one tile of a class.
MAX_VOICES, SIGNATURES, VOICE_TILE = 10_000, 2000, 5000
_TRAITS = ("voice", "gender", "age", "languages", "accent")
_SIGNATURE = ("gender", "age", "languages", "accent")


def _is_short(voices: DataFrame) -> bool:
    return voices.limit(MAX_VOICES + 1).count() <= MAX_VOICES


def _catalogue(voices: DataFrame) -> DataFrame:
    """All voices of a short catalogue in one row."""
    return voices.agg(F.collect_list(F.struct(*_TRAITS)).alias("__voices"))


def _rank(side: dict[str, Column], v: Column) -> tuple[Column, Column]:
    """Whether a language is shared, and the score."""
    shares = F.arrays_overlap(side["languages"], v["languages"])
    score = (
        F.when(F.array_contains(v["languages"], F.get(side["languages"], F.lit(0))), 16).when(shares, 4).otherwise(0)
        + F.when((side["gender"] != "unknown") & (side["gender"] == v["gender"]), 4).otherwise(0)
        + F.when(side["age"] == v["age"], 2).otherwise(0)
        + F.when((side["accent"] != "") & (side["accent"] == v["accent"]), 1).otherwise(0)
    )
    return shares, score


def _tie(seed: int, id_: Column, voice: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string"), F.lit("|"), voice))


def _best(voices: Column, side: dict[str, Column], seed: int) -> Column:
    """struct(shares, score, tie, voice) of the best of an array of voices; null where there is none."""

    def rank(v: Column) -> Column:
        shares, score = _rank(side, v)
        return F.struct(shares.alias("shares"), score.alias("score"), _tie(seed, side["id"], v["voice"]).alias("tie"), v["voice"].alias("voice"))

    return F.array_max(F.transform(voices, rank))


@dataclass(frozen=True)
class Index:
    """A long catalogue by signature (the traits without the voice): pieces of signatures, and the voices of each in tiles."""

    pieces: DataFrame  # piece, signatures
    n_pieces: int
    tiles: DataFrame  # class, names


def voice_index(voices: DataFrame) -> Index:
    counted = voices.groupBy(*_SIGNATURE).agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id())
    classes = cut(counted, "voice_classes")
    n_pieces = max(1, -(-classes.count() // SIGNATURES))
    piece = F.pmod(F.xxhash64("class"), F.lit(n_pieces)).cast("int").alias("piece")
    pieces = cut(classes.groupBy(piece).agg(F.collect_list(F.struct("class", "n", *_SIGNATURE)).alias("signatures")), "signatures")
    same = F.lit(True)
    for trait in _SIGNATURE:
        same = same & voices[trait].eqNullSafe(classes[trait])
    placed = voices.join(classes, same).select("class", voices["voice"], F.pmod(F.xxhash64(voices["voice"]), F.ceil(F.col("n") / VOICE_TILE)).alias("tile"))
    return Index(pieces, n_pieces, cut(placed.groupBy("class", "tile").agg(F.collect_list("voice").alias("names")), "voice_tiles"))


def _from_index(speakers: DataFrame, index: Index, seed: int, exclude: str | None = None) -> DataFrame:
    """speakers(__row, id, languages, gender, age, accent) to __row, __voice, __score.

    Distinct speaker signatures meet the pieces of signatures; the best class
    stays, and the next best where the best holds one voice alone, which may be
    the excluded one. Then only the voices of those classes are compared by the
    tie, tile by tile.
    """
    distinct = cut(speakers.select(*_SIGNATURE).distinct().withColumn("__key", F.monotonically_increasing_id()), "speaker_signatures")
    side = {name: F.col(name) for name in _SIGNATURE}

    def ranked(v: Column) -> Column:
        shares, score = _rank(side, v)
        return F.struct(F.struct(shares.alias("shares"), score.alias("score")).alias("rank"), v["n"].alias("n"), v["class"].alias("class"))

    met = distinct.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(index.n_pieces - 1)))).join(index.pieces, "piece")
    found = met.select("__key", F.transform("signatures", ranked).alias("found"))
    # of each piece, the classes of its two best ranks
    tops = found.withColumn("tops", F.slice(F.sort_array(F.array_distinct(F.transform("found", lambda c: c["rank"])), asc=False), 1, 2))
    kept = tops.select("__key", F.inline(F.filter("found", lambda c: F.array_contains(F.col("tops"), c["rank"]))))
    by_rank = Window.partitionBy("__key").orderBy(F.desc("rank"))
    placed = kept.withColumns({"place": F.dense_rank().over(by_rank), "held": F.sum("n").over(Window.partitionBy("__key", "rank"))})
    best = placed.filter("place <= 2").withColumn("alone", F.min(F.when(F.col("place") == 1, F.col("held"))).over(Window.partitionBy("__key")) == 1)
    winners = best.filter("place = 1 OR alone").select("__key", "class", "rank")
    same = F.lit(True)
    for trait in _SIGNATURE:
        same = same & speakers[trait].eqNullSafe(distinct[trait])
    keyed = speakers.join(distinct, same).select(speakers["__row"], speakers["id"], "__key", *([speakers[exclude]] if exclude else []))
    tiles = keyed.join(winners, "__key").join(index.tiles, "class")
    names = F.filter("names", lambda n: n != F.col(exclude)) if exclude else F.col("names")
    one = F.array_max(F.transform(names, lambda n: F.struct(_tie(seed, F.col("id"), n).alias("tie"), n.alias("voice"))))
    top = F.max(F.when(one.isNotNull(), F.struct("rank", one.alias("one")))).alias("top")
    return tiles.groupBy("__row").agg(top).select("__row", F.col("top.one.voice").alias("__voice"), F.col("top.rank.score").alias("__score"))


def best_voice(speakers: DataFrame, voices: DataFrame, seed: int = 42) -> DataFrame:
    """speakers(id, languages, gender, age, accent) plus voice and voice_score: shared language first, ties by a hash.

    Candidates share a language; where there is none, all voices are. A
    catalogue of at most MAX_VOICES voices is one row, so speakers are ranked
    in one projection, without a shuffle; a longer one is an index by
    signature. Equal rows stay apart. An empty catalogue gives null.
    """
    if _is_short(voices):
        best = _best(F.col("__voices"), {n: F.col(n) for n in ("id", "languages", "gender", "age", "accent")}, seed)
        ranked = speakers.crossJoin(F.broadcast(_catalogue(voices))).withColumn("__best", best)
        return ranked.select(*speakers.columns, F.col("__best.voice").alias("voice"), F.col("__best.score").alias("voice_score"))
    rows = cut(speakers.withColumn("__row", F.monotonically_increasing_id()), "speakers")
    found = _from_index(rows, voice_index(voices), seed)
    return rows.join(found, "__row", "left").select(*speakers.columns, F.col("__voice").alias("voice"), F.col("__score").alias("voice_score"))


def voice_pairs(dialogues: DataFrame, voices: DataFrame, strict: bool = True) -> DataFrame:
    """dialogues(id, languages, gender_a, age_a, accent_a, gender_b, ...) to id, voice_a and another voice_b.

    Where no second voice is left, the job fails; with ``strict`` off the
    dialogue stays, with null for what is missing.
    """

    def side(s: str) -> dict[str, Column]:
        return {"id": F.col("id"), "languages": F.col("languages"), **{n: F.col(f"{n}_{s}") for n in ("gender", "age", "accent")}}

    if _is_short(voices):
        first = dialogues.crossJoin(F.broadcast(_catalogue(voices))).withColumn("voice_a", _best(F.col("__voices"), side("a"), 42)["voice"])
        others = F.filter("__voices", lambda v: v["voice"] != F.col("voice_a"))
        out = first.withColumn("voice_b", _best(others, side("b"), 43)["voice"])
    else:
        index = voice_index(voices)
        rows = cut(dialogues.withColumn("__row", F.monotonically_increasing_id()), "dialogues")
        a = _from_index(rows.select("__row", *[c.alias(n) for n, c in side("a").items()]), index, 42).select("__row", F.col("__voice").alias("voice_a"))
        with_a = cut(rows.join(a, "__row", "left"), "first_voices")
        b = _from_index(with_a.select("__row", "voice_a", *[c.alias(n) for n, c in side("b").items()]), index, 43, "voice_a").select("__row", F.col("__voice").alias("voice_b"))
        out = with_a.join(b, "__row", "left")
    second = F.col("voice_b")
    if strict:
        second = F.coalesce(second, F.raise_error(F.concat(F.lit("no second voice for dialogue "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("string"))
    return out.select("id", "voice_a", second.alias("voice_b"))


def speech_pieces(text: Column) -> Column:
    """Pieces behind each mark, trimmed, short ones joined while they stay within ``PIECE`` characters; else the text."""
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPEECH_MARKS}]*[{SPEECH_MARKS}]|[^{SPEECH_MARKS}]+"), F.lit(0))
    parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(part) <= PIECE
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, F.concat(acc["open"], part)).otherwise(part).alias("open"), done.alias("done"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    merged = F.aggregate(parts, start, step, finish)
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(F.coalesce(text, F.lit(""))))


def turn_file(turn: Column, speaker: Column) -> Column:
    return F.format_string("turn_%s_%s.wav", turn.cast("string"), speaker)


def silence_samples(rate: int, ms: Column) -> Column:
    return F.floor(F.lit(rate) * ms / 1000).cast("long")


def resample(samples: Column, ratio: float) -> Column:
    """Linear interpolation to floor(n / ratio) samples, of float samples."""
    n = F.size(samples)

    def at(i: Column) -> Column:
        place = i * F.lit(float(ratio))
        low = F.floor(place).cast("int")
        part = place - low
        left = F.get(samples, low)
        return F.when(low + 1 < n, left * (F.lit(1.0) - part) + F.get(samples, low + 1) * part).otherwise(left)

    count = F.floor(n / F.lit(float(ratio))).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def assembled(turns: DataFrame, rate: int = 16000) -> DataFrame:
    """turns(conv_id, turn, n_samples, pause_ms) to the length of each dialogue; no pause after the last turn."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    padded = turns.withColumn("n", F.col("n_samples") + F.when(last, F.lit(0)).otherwise(silence_samples(rate, F.col("pause_ms"))))
    return padded.groupBy("conv_id").agg(F.sum("n").alias("n_samples"), F.round(F.sum("n") / rate, 3).alias("seconds"), F.count(F.lit(1)).alias("n_turns"))
