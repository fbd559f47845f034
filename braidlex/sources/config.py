"""Readers of configuration, lexicons and dialogue files, and writers of results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlex.functions.lang import PAIRS, SENTENCE_ENDS, LanguagePair
from braidlex.operators.rules import Rules, read_rules
from braidlex.plans.tables import cut

#: Words a lexicon may have to be matched by a list in the plan.
MAX_LEXICON = 100_000

DIALOGUE = (
    "dialogue_id string, topic string, topic_id string, formality string, relationship string, language_pair array<string>, avg_score double, total_turns int, "
    "speaker_a map<string,string>, speaker_b map<string,string>, injected_info array<struct<title:string,source:string,content:string>>, "
    "turns array<struct<turn:int,turn_number:int,speaker:string,text:string,score:double,eval_score:double,decision:string,eval_decision:string,cmi:double,switches:int,num_switches:int>>"
)


def whole_file(spark: SparkSession, path: str) -> str:
    """A configuration file's text, through Spark's readers, so any store will do."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # configuration: one small file


def read_yaml(spark: SparkSession, path: str) -> dict:
    import yaml

    return yaml.safe_load(whole_file(spark, path)) or {}


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(whole_file(spark, path))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, blank lines dropped, lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def with_lexicon(pair: LanguagePair, words: DataFrame) -> LanguagePair:
    """The pair with a lexicon of checked size."""
    found = [r.word for r in words.limit(MAX_LEXICON + 1).collect()]
    if len(found) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} words")
    return LanguagePair(pair.pair_id, pair.l1, pair.l2, endings=pair.endings, lexicon=tuple(sorted(found)), common=pair.common)


def load_pair(pair_id: str) -> LanguagePair:
    if pair_id not in PAIRS:
        raise KeyError(f"no language pair {pair_id!r}; there are {', '.join(list_pairs())}")
    return PAIRS[pair_id]


def list_pairs() -> list[str]:
    return sorted(PAIRS)


@dataclass(frozen=True)
class PairConfig:
    """All that a pair's folder holds; ``rules`` and the words of ``language`` come from its tables.

    A lexicon of more than MAX_LEXICON words stays a table: ``plans.lexicon``
    analyses texts with ``lexicon``, whatever its size.
    """

    language: LanguagePair
    settings: dict
    calibration: dict
    evaluation: dict
    prompts: dict
    personas: list[dict]
    rules: Rules
    lexicon: DataFrame | None = None


def pair_folders(spark: SparkSession, root: str) -> DataFrame:
    """pair: the folders below ``root`` with a language.yaml, sorted by name."""
    found = spark.read.format("binaryFile").load(f"{root}/*/language.yaml") if _exists(spark, f"{root}/*/language.yaml") else spark.createDataFrame([], "path string")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("pair")).distinct().orderBy("pair")


def write_files(spark: SparkSession, files: dict[str, str]) -> None:
    """Small configuration files, by path, through Hadoop's file system, so any store will do."""
    jvm = spark.sparkContext._jvm
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(text.encode())
        out.close()


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def read_pair(spark: SparkSession, root: str, pair_id: str) -> PairConfig:
    """The pair's language.yaml, calibration.json, evaluation.yaml, prompts.yaml, personas.yaml and, where there is one, l1_lexicon.txt."""
    known = [r.pair for r in pair_folders(spark, root).collect()]  # a handful of folders
    if pair_id not in known:
        raise FileNotFoundError(f"no language pair {pair_id!r} in {root}; there are {', '.join(known) or '(none)'}")
    at = f"{root}/{pair_id}"
    settings, personas = read_yaml(spark, f"{at}/language.yaml"), read_yaml(spark, f"{at}/personas.yaml")
    scripts = "".join(rf"\x{{{_code(low):04X}}}-\x{{{_code(high):04X}}}" for low, high in settings.get("l1_unicode_ranges") or [])
    endings = "".join(settings.get("sentence_endings") or "") or SENTENCE_ENDS
    pair = LanguagePair(pair_id, settings["l1_code"], settings["l2_code"], scripts, endings)
    lexicon = None
    if settings.get("detection_mode") == "lexicon":
        lexicon = read_lexicon(spark, f"{at}/l1_lexicon.txt")
        long = lexicon.limit(MAX_LEXICON + 1).count() > MAX_LEXICON
        pair = pair.replaced(outside=True) if long else with_lexicon(pair, lexicon)
    listed = personas.get("persona_templates") or personas.get("personas") or [] if isinstance(personas, dict) else personas
    calibration, evaluation, prompts = read_json(spark, f"{at}/calibration.json"), read_yaml(spark, f"{at}/evaluation.yaml"), read_yaml(spark, f"{at}/prompts.yaml")
    rules = read_rules(evaluation, calibration, prompts)
    own = Rules(fillers=tuple(w for k in ("filler_words_l1", "filler_words_l2") for w in settings.get(k) or ()), interjections=tuple(settings.get("interjections_l1") or ()))
    return PairConfig(rules.words(own.words(pair)), settings, calibration, evaluation, prompts, listed, rules, lexicon)


def _code(value: int | str) -> int:
    return value if isinstance(value, int) else int(value, 16)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """The example bank's lines, malformed ones skipped, with ``seq``, their order of admission from 1: by file name, then by line.

    Spark reads a file in blocks. A line is numbered within its block, in the
    order in which the block is read, and blocks are put in order by prefix
    sums of their counts, so no file is sorted by one task; equal lines keep
    numbers of their own. Appended batches keep their order if each is in a
    folder or file whose name is greater than those before.
    """
    schema = "archetype_id string, topic string, formality string, speaker_text string, eval_score double, cmi double, dialogue_context string"
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("example"), at, F.monotonically_increasing_id().alias("line"))
    kept = cut(lines.filter("example.archetype_id is not null"), "examples")
    counts = kept.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of a file
    ahead = counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("line"))
    rows = kept.join(ahead, "block").select("example.*", (F.col("ahead") + place).alias("seq"))
    return rows.withColumnRenamed("archetype_id", "archetype").withColumnRenamed("eval_score", "score")


def read_dialogues(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Dialogues from JSON lines of either layout; malformed lines are skipped, ``_source_file`` is kept."""
    rows = spark.read.schema(DIALOGUE).option("mode", "DROPMALFORMED").json(path).withColumn("_source_file", F.col("_metadata.file_name"))
    turn = F.transform(
        "turns",
        lambda t: F.struct(
            F.coalesce(t["turn"], t["turn_number"]).alias("turn"), t["speaker"].alias("speaker"), t["text"].alias("text"), F.coalesce(t["score"], t["eval_score"]).alias("score"),
            F.coalesce(t["decision"], t["eval_decision"]).alias("decision"), t["cmi"].alias("cmi"), F.coalesce(t["switches"], t["num_switches"]).alias("switches"),
        ),
    )
    rows = rows.withColumn("turns", turn).filter("dialogue_id is not null")
    return rows if limit is None else rows.orderBy("_source_file", "dialogue_id").limit(limit)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row; non-ASCII text is kept."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "length", F.col("content").alias("wav"))


def manifest(dialogues: DataFrame, elapsed: float = 0.0) -> DataFrame:
    """dialogues(conv_id, seconds, ok) to one row: counts and total length."""
    return dialogues.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("ok").cast("int")).alias("success"), F.sum((~F.col("ok")).cast("int")).alias("failed"),
        F.round(F.sum(F.when(F.col("ok"), F.col("seconds"))), 3).alias("seconds"), F.lit(elapsed).alias("elapsed"),
    )
