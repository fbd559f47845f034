"""Command lines: ``python -m braidlex COMMAND --help``.

Each command is one Spark job over the library: its input and output are
folders that Spark reads and writes, so it runs on one machine or, by
``spark-submit``, on a cluster. A boundary (model, snippets, voice) is named as
``module:attribute``; the function is sent to the workers.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.functions import audio
from braidlex.functions.lang import PAIRS
from braidlex.operators import dialogue as D
from braidlex.operators import retrieval as R
from braidlex.operators import sampling as S
from braidlex.operators import voice as V
from braidlex.operators.scoring import ARCHETYPE_CMI, WEIGHTS
from braidlex.plans import generation
from braidlex.plans.tables import cut, release, spread
from braidlex.sources import audio_files, config, providers

MODES = ("convergent", "divergent", "mixed", "maintain")
_VERDICT = (*WEIGHTS, "final_score", "decision")


def named(what: str):
    """The attribute that ``module:attribute`` names."""
    module, _, attribute = what.partition(":")
    if not attribute:
        raise argparse.ArgumentTypeError(f"{what!r} is not of the form module:attribute")
    return getattr(importlib.import_module(module), attribute)


def profiles(spark: SparkSession, args: argparse.Namespace, n: int) -> DataFrame:
    """``n`` speaker profiles, from the pool of a file where one is given."""
    dims = S.dimensions(spark)
    if args.personas:
        found = config.read_yaml(spark, args.personas)
        dims = S.pool_dimensions(spark, found.get("persona_templates") or found.get("personas") if isinstance(found, dict) else found, dims)
    return S.sample(spark.range(n).withColumnRenamed("id", "row"), dims, args.seed, tables=bool(args.personas))


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    config.write_json_lines(profiles(spark, args, args.n), args.output)


def prompts(spark: SparkSession, args: argparse.Namespace) -> None:
    task = D.user_prompt(F.col("dialogue_type"), F.col("level"), S.draw("task", args.seed, F.col("row")), D.FRAMES[args.language])
    named_as = {"l1_name": args.l1_name, "l2_name": args.l2_name}
    place = D.situation(F.col("dialogue_type"), F.col("relationship"), F.col("topic"), {}, D.FRAMES[args.language])
    behaviour = D.told(F.col("archetype"), D.BEHAVIOURS, "ARC_01", domain=D.domain_context(F.col("topic"), F.col("domain_words")), **named_as)
    role = F.concat_ws(", ", "profession", "region")
    system = D.system_prompt(role, D.told(F.col("proficiency"), D.PROFICIENCIES, **named_as), behaviour, F.lit(""), place, F.col("formality"), S.level_text(F.col("level"), args.l1_name, args.l2_name))
    config.write_json_lines(profiles(spark, args, args.n).select("row", system.alias("system_prompt"), task.alias("user_prompt")), args.output)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """A text, or all rows of a Parquet folder with the columns doc_id and text, as one speaker's."""
    texts = spread(spark.read.parquet(args.input)) if args.input else spark.createDataFrame([(0, args.text)], "doc_id long, text string")
    low, high = args.cmi_range or ARCHETYPE_CMI[args.archetype]
    words = [w.strip() for w in args.domain_words.split(",") if w.strip()]
    given = {"archetype": F.lit(args.archetype), "cmi_lo": F.lit(float(low)), "cmi_hi": F.lit(float(high)), "formality": F.lit(args.formality), "region": F.lit(args.region), "wanted": F.array(*map(F.lit, words)).cast("array<string>")}
    judged = generation.evaluate(texts.select("doc_id", "text").withColumns(given), PAIRS[args.pair]).select("doc_id", "cmi", "n_switches", *_VERDICT)
    if args.output:
        config.write_json_lines(judged, args.output)
    else:
        judged.show(truncate=False)


def speakers(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """``n`` dialogues of two profiles each, as ``generation.generate`` takes them."""
    found = cut(profiles(spark, args, 2 * args.n), "profiles")
    own = ("archetype", "cmi_lo", "cmi_hi", "region")
    side = lambda k, name: found.filter(F.col("row") % 2 == k).select(F.floor(F.col("row") / 2).alias("conv_id"), *[F.col(c).alias(f"{c}_{name}") for c in own])
    words = F.filter(F.split("domain_words", ","), lambda w: w != "")
    shared = found.filter("row % 2 = 0").select(F.floor(F.col("row") / 2).alias("conv_id"), "formality", "topic", words.alias("wanted"))
    return shared.join(side(0, "a"), "conv_id").join(side(1, "b"), "conv_id")


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    def answer(asked: DataFrame, round_: int) -> DataFrame:
        rows = spread(asked.select("conv_id", "prompt"))
        return providers.chat(rows, args.client, args.retries, ("conv_id",), args.parallel, args.seconds, args.endpoints).select("conv_id", "reply", "error")

    dialogues = cut(speakers(spark, args), "dialogues")
    turns, counters = generation.generate(dialogues.drop("topic"), answer, PAIRS[args.pair], args.turns, args.attempts, args.least, args.accommodation, D.FRAMES[args.language], args.history_lines, args.seed, args.folder)
    turns = cut(turns, "turns")
    rolled = D.roll_up(turns).join(dialogues.select("conv_id", "topic", "formality", "archetype_a", "archetype_b"), "conv_id")
    config.write_json_lines(rolled.withColumn("dialogue_id", D.dialogue_id(args.seed, F.col("conv_id"))), f"{args.output}/dialogues")
    config.write_json_lines(counters, f"{args.output}/counters")
    if args.example_bank:
        shown = {"archetype_id": F.when(F.col("speaker") == "A", F.col("archetype_a")).otherwise(F.col("archetype_b")), "speaker_text": F.col("text"), "eval_score": F.col("score")}
        good = turns.filter(F.col("score") >= args.example_score).join(dialogues, "conv_id").withColumns(shown).orderBy("conv_id", "turn")
        config.write_json_lines(good.select("archetype_id", "topic", "formality", "speaker_text", "eval_score", "cmi"), args.example_bank, append=True)


def snippets(spark: SparkSession, args: argparse.Namespace) -> None:
    """Snippets of each topic by the providers in their order, as rows with the block that a prompt takes."""
    names = args.providers or ["web_search"]
    providers.register_sources(spark, dict(args.functions or {}))
    read = spark.read.format("snippets").option("topics", ",".join(args.topic)).option("limit", str(args.max_snippets))
    found = None
    for name in names:
        rows = read.option("provider", name).load().withColumn("provider", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    asked = spark.createDataFrame([(t, p, n) for t in args.topic for n, p in enumerate(names)], "topic string, provider string, priority int")
    chosen = R.provider_chain(cut(found, "snippets"), args.max_snippets, asked)
    block = R.format_snippets(chosen.withColumn("content", R.truncate(F.concat_ws(": ", "title", "content"))), "topic", R.FRAMES[args.language])
    if args.output:
        config.write_json_lines(block, args.output)
    else:
        block.show(truncate=False)


def speech(spark: SparkSession, args: argparse.Namespace) -> None:
    """Dialogues of JSON lines as one WAV each, with a manifest; a dialogue without turns or with one that fails has no sound and counts as failed."""
    found = cut(config.read_dialogues(spark, args.input, args.limit).withColumn("conv_id", F.monotonically_increasing_id()), "dialogues")
    turns = found.select("conv_id", F.inline("turns")).select("conv_id", "turn", V.speech_pieces(F.col("text")).alias("pieces"))
    pause = args.pause_min + S.draw("pause", args.seed, F.concat_ws(":", "conv_id", "turn")) * (args.pause_max - args.pause_min)
    spoken = providers.synthesize(spread(turns), partial(args.voice, rate=args.rate), args.rate, args.retries).withColumn("pause_ms", F.floor(pause).cast("int"))
    spoken = cut(spoken, "spoken")
    failed = spoken.groupBy("conv_id").agg(F.min("error").alias("turn_error"))
    whole = found.select("conv_id", "dialogue_id").join(failed, "conv_id", "left").join(audio.assemble(spoken, args.rate), "conv_id", "left")
    error = F.when(F.col("wav").isNull(), F.coalesce("error", "turn_error", F.lit("no turns"))).alias("error")
    audio_files.register(spark)
    whole.select(F.concat("dialogue_id", F.lit(".wav")).alias("path"), "wav", "seconds", error).write.format("wav").mode("append").save(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidlex", description=__doc__.split("\n", 1)[0])
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(run, about: str, seeded: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(run.__name__, help=about)
        own.set_defaults(run=run)
        if seeded:
            own.add_argument("--seed", type=int, default=42)
        return own

    for run, about in ((sample, "speaker profiles"), (prompts, "system and user prompts of profiles")):
        own = command(run, about)
        own.add_argument("-n", type=int, default=10)
        own.add_argument("--personas", help="a YAML file with a pool")
        own.add_argument("--output", required=True)
    own.add_argument("--language", choices=sorted(D.FRAMES), default="en")
    own.add_argument("--l1-name", default="Chinese")
    own.add_argument("--l2-name", default="English")

    own = command(evaluate, "scores of a text or of a table of texts", seeded=False)
    source = own.add_mutually_exclusive_group(required=True)
    source.add_argument("--text")
    source.add_argument("--input")
    own.add_argument("--output")
    own.add_argument("--pair", choices=sorted(PAIRS), default="zh_en")
    own.add_argument("--archetype", choices=sorted(ARCHETYPE_CMI), default="ARC_01")
    own.add_argument("--cmi-range", type=float, nargs=2)
    own.add_argument("--formality", default="casual")
    own.add_argument("--region", default="")
    own.add_argument("--domain-words", default="")

    own = command(generate, "dialogues by a model")
    own.add_argument("-n", type=int, default=10)
    own.add_argument("--client", type=named, required=True, help="module:function of a prompt, to its reply")
    own.add_argument("--output", required=True)
    own.add_argument("--pair", choices=sorted(PAIRS), default="zh_en")
    own.add_argument("--personas", help="a YAML file with a pool")
    own.add_argument("--language", choices=sorted(D.FRAMES), default="en")
    own.add_argument("--accommodation", choices=MODES, default="convergent")
    own.add_argument("--folder", help="where the rounds are kept; the same folder goes on after the last complete one")
    own.add_argument("--example-bank", help="a folder to which good turns are added")
    own.add_argument("--example-score", type=float, default=8.0)
    for name, default in (("turns", 8), ("attempts", 3), ("retries", 3), ("parallel", 8), ("endpoints", 0), ("history-lines", None)):
        own.add_argument(f"--{name}", type=int, default=default)
    own.add_argument("--least", type=float, default=6.0)
    own.add_argument("--seconds", type=float, help="the time limit of a call")

    own = command(snippets, "snippets on topics", seeded=False)
    own.add_argument("--topic", nargs="+", required=True)
    own.add_argument("--max-snippets", type=int, default=3)
    own.add_argument("--providers", nargs="+", help="names, in the order in which they are asked")
    own.add_argument("--functions", type=named, help="module:attribute of a dict of provider functions by name")
    own.add_argument("--language", choices=sorted(R.FRAMES), default="en")
    own.add_argument("--output")

    own = command(speech, "sound of dialogues")
    own.add_argument("--input", required=True)
    own.add_argument("--output", required=True)
    own.add_argument("--voice", type=named, required=True, help="module:function of a text and its rate, to samples")
    own.add_argument("--rate", type=int, default=16000)
    own.add_argument("--pause-min", type=int, default=300)
    own.add_argument("--pause-max", type=int, default=800)
    own.add_argument("--retries", type=int, default=3)
    own.add_argument("--limit", type=int, help="the first dialogues only")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("braidlex").getOrCreate()
    try:
        args.run(session, args)
    finally:
        if spark is None:
            release(session)
            session.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
