"""Speaker profiles: constrained weighted sampling with deterministic draws.

A draw is the first 32 bits of an MD5 of seed, row and stage, so any engine
gives the same profile for a row, whatever the partitioning. Candidates with
cumulative weights are one array a persona; a pick is a filter over it. For
long pools ``sample`` can draw from alias tables instead (``operators.alias``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlex.operators.alias import alias_draw, alias_table

# Archetype weights and ranges, topics, dialogue types, shifts, levels.
ARCHETYPES = (
    ("ARC_01", 0.30, 0.05, 0.25), ("ARC_02", 0.25, 0.25, 0.45), ("ARC_03", 0.12, 0.45, 0.70), ("ARC_04", 0.13, 0.15, 0.40), ("ARC_05", 0.12, 0.01, 0.10), ("ARC_06", 0.08, 0.10, 0.50),
)
TOPICS = (
    ("technology", 0.15, 0.08), ("academic", 0.12, 0.06), ("work", 0.15, 0.0), ("daily_life", 0.15, -0.03), ("food", 0.08, -0.05), ("emotion", 0.08, -0.08), ("entertainment", 0.10, 0.03),
    ("travel", 0.07, 0.0), ("sports", 0.05, 0.0), ("shopping", 0.05, 0.0),
)
DIALOGUE_TYPES = (("monologue", 0.30), ("dyadic", 0.45), ("group", 0.25))
FORMALITY_SHIFT = (("casual", 0.05), ("semi_formal", 0.0), ("formal", -0.10))
RELATIONSHIPS = (("close_friends", "casual"), ("colleagues", "semi_formal"), ("classmates", "casual"), ("teacher_student", "semi_formal"), ("strangers", "semi_formal"), ("family", "casual"))
#: Our own personas (name, weight, region, profession, archetypes, relationships, topics, age group, proficiency); a pool is read with ``sources.config``.
PERSONAS = (
    ("engineer", 0.30, "singapore", "software engineer", ("ARC_01", "ARC_03"), ("close_friends", "colleagues"), ("technology", "work", "food"), "young", "advanced"),
    ("student", 0.25, "mainland", "student", ("ARC_01", "ARC_05", "ARC_06"), ("classmates", "teacher_student", "family"), ("academic", "entertainment", "daily_life"), "young", "intermediate"),
    ("banker", 0.20, "hong_kong", "finance", ("ARC_02", "ARC_03", "ARC_04"), ("colleagues", "strangers"), ("work", "travel", "shopping"), "middle", "fluent"),
    ("teacher", 0.15, "malaysia", "teacher", ("ARC_02", "ARC_04"), ("teacher_student", "family"), ("academic", "emotion", "sports"), "middle", "advanced"),
    ("cook", 0.08, "taiwan", "chef", ("ARC_05",), ("family", "strangers"), ("food", "daily_life"), "senior", "basic"),
)
#: Our own domain words by topic and profession; ``general`` is the fallback.
DOMAIN_WORDS = {("technology", "software engineer"): "debug,deploy,code", ("technology", "general"): "app,phone", ("work", "general"): "meeting,deadline,email", ("academic", "student"): "paper,exam", ("food", "general"): "brunch"}
LEVELS = ((0.08, "minimal"), (0.20, "light"), (0.35, "moderate"), (0.50, "heavy"))
LEVEL_TEXT = {
    "minimal": "almost only {l1_name}; {l2_name} for names alone", "light": "{l1_name} with a few {l2_name} words", "moderate": "{l1_name} and {l2_name}, changing by topic",
    "heavy": "changes often between {l1_name} and {l2_name}", "dense": "{l1_name} and {l2_name} in nearly every clause",
}


def draw(stage: str, seed: int, row: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{stage}|"), row.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_sql(stage: str, seed: int, row: str) -> str:
    return f"(('0x' || substr(md5('{seed}|{stage}|' || {row}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def with_bounds(df: DataFrame, by: list[str], weight: str, order: str) -> DataFrame:
    """``df`` plus lo and hi: the stretch of [0, 1) that each row of its group takes."""
    group = Window.partitionBy(*by)
    running = F.sum(weight).over(group.orderBy(order))
    total = F.sum(weight).over(group)
    return df.withColumns({"lo": (running - F.col(weight)) / total, "hi": running / total})


def choices(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """One row a group: an array of (hi, value) in order; ``pick`` chooses from it."""
    bounded = with_bounds(df, by, weight, value)
    grouped = bounded.groupBy(*by) if by else bounded.groupBy()
    return grouped.agg(F.sort_array(F.collect_list(F.struct("hi", value))).alias(f"{value}_choices"))  # a dimension: few rows a group


def pick(choices_col: str, value: str, u: Column) -> Column:
    """The first choice whose upper bound is above the draw (the last one against rounding)."""
    above = F.filter(choices_col, lambda c: c["hi"] > u)
    return F.when(F.size(above) > 0, F.get(above, F.lit(0))[value]).otherwise(F.element_at(choices_col, -1)[value])


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    personas = make([(*p[:4], *p[7:]) for p in PERSONAS], "persona string, weight double, region string, profession string, age_group string, proficiency string")
    archetypes = make(list(ARCHETYPES), "archetype string, weight double, cmi_lo double, cmi_hi double")
    topics = make(list(TOPICS), "topic string, weight double, shift double")
    return {
        "personas": personas, "archetypes": archetypes, "topics": topics,
        "persona_archetype": make([(p[0], a) for p in PERSONAS for a in p[4]], "persona string, archetype string"),
        "persona_relationship": make([(p[0], a) for p in PERSONAS for a in p[5]], "persona string, relationship string"),
        "persona_topic": make([(p[0], a) for p in PERSONAS for a in p[6]], "persona string, topic string"),
        "relationships": make(list(RELATIONSHIPS), "relationship string, formality string"),
        "formality": make(list(FORMALITY_SHIFT), "formality string, formality_shift double"),
        "dialogue_types": make(list(DIALOGUE_TYPES), "dialogue_type string, weight double"),
        "domain_words": make([(t, p, w) for (t, p), w in DOMAIN_WORDS.items()], "topic string, key string, words string"),
    }


def sample(rows: DataFrame, dims: dict[str, DataFrame], seed: int = 42, row: str = "row", tables: bool = False) -> DataFrame:
    """A profile for each row id: persona, archetype, topic, relationship, formality, dialogue type, words, CMI, level.

    Dimensions are usually tens of rows from a configuration; Spark knows their
    sizes and broadcasts those below its threshold, so the rows are not
    shuffled. A pool of any size can stand in for them; with ``tables`` a draw
    is a lookup in an alias table, whatever the length of the pool (other draws
    by the same weights).
    """
    u = lambda stage: draw(stage, seed, F.col(row))
    arch = dims["persona_archetype"].join(dims["archetypes"], "archetype", "left").select("persona", "archetype", F.coalesce("weight", F.lit(0.15)).alias("weight"))
    topic = dims["persona_topic"].join(dims["topics"], "topic", "left").select("persona", "topic", F.coalesce("weight", F.lit(0.1)).alias("weight"))
    relation = dims["persona_relationship"].withColumn("weight", F.lit(1.0))

    def drawn(out: DataFrame, table: DataFrame, by: list[str], value: str, stage: str) -> DataFrame:
        if tables:
            return alias_draw(out, alias_table(table, by, value, "weight"), by, value, stage, seed, row)
        own = choices(table, by, value, "weight")
        joined = out.join(own, by) if by else out.crossJoin(own)
        return joined.withColumn(value, pick(f"{value}_choices", value, u(stage))).drop(f"{value}_choices")

    out = drawn(rows, dims["personas"], [], "persona", "persona")
    for table, value in ((arch, "archetype"), (topic, "topic"), (relation, "relationship")):
        out = drawn(out, table, ["persona"], value, value)
    out = drawn(out, dims["dialogue_types"], [], "dialogue_type", "type")
    out = out.join((dims["personas"].drop("weight")), "persona").join((dims["relationships"]), "relationship").join((dims["formality"]), "formality")
    out = out.join((dims["archetypes"].drop("weight")), "archetype").join((dims["topics"].select("topic", "shift")), "topic")
    words = dims["domain_words"]
    exact, general = words.withColumnRenamed("key", "profession").withColumnRenamed("words", "own_words"), words.filter("key = 'general'").select("topic", F.col("words").alias("general_words"))
    out = out.join((exact), ["topic", "profession"], "left").join((general), "topic", "left")
    cmi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cmi_lo") + F.col("cmi_hi")) / 2 + F.col("formality_shift") + F.col("shift")))
    return out.withColumns({"domain_words": F.coalesce("own_words", "general_words", F.lit("")), "effective_cmi": F.round(cmi, 6)}).withColumn("level", level(F.col("effective_cmi"))).drop("own_words", "general_words")


def level(cmi: Column) -> Column:
    out = F.when(cmi < LEVELS[0][0], LEVELS[0][1])
    for bound, name in LEVELS[1:]:
        out = out.when(cmi < bound, name)
    return out.otherwise("dense")


def level_text(level_col: Column, l1_name: str, l2_name: str) -> Column:
    text = F.create_map(*[F.lit(x) for pair in LEVEL_TEXT.items() for x in pair])[level_col]
    return F.replace(F.replace(text, F.lit("{l1_name}"), F.lit(l1_name)), F.lit("{l2_name}"), F.lit(l2_name))


def speaker_pairs(rows: DataFrame, dims: dict[str, DataFrame], seed: int = 42, attempts: int = 10) -> DataFrame:
    """Two profiles a dialogue: the first of ten second draws that differs in persona or archetype, else the eleventh."""
    keep = ["persona", "archetype", "effective_cmi"]
    first = sample(rows.withColumn("draw", F.concat_ws(":", F.col("row"), F.lit("a"))), dims, seed, "draw").select("row", *[F.col(k).alias(f"{k}_a") for k in keep])
    many = rows.select("row", F.explode(F.sequence(F.lit(1), F.lit(attempts + 1))).alias("attempt")).withColumn("draw", F.concat_ws(":", "row", F.lit("b"), "attempt"))
    second = sample(many, dims, seed, "draw").select("row", "attempt", *[F.col(k).alias(f"{k}_b") for k in keep])
    differs = (F.col("persona_a") != F.col("persona_b")) | (F.col("archetype_a") != F.col("archetype_b")) | (F.col("attempt") == attempts + 1)
    packed = F.min(F.struct("attempt", "persona_b", "archetype_b", "effective_cmi_b")).alias("b")
    return second.join(first, "row").filter(differs).groupBy("row", "persona_a", "archetype_a", "effective_cmi_a").agg(packed).select("row", "persona_a", "archetype_a", "effective_cmi_a", "b.*")


def pool_dimensions(spark: SparkSession, personas: list[dict], shared: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Dimensions with the personas of a pool (as configuration files hold them) instead of our own.

    A persona has an id, a weight, a region and a profession (each with an id),
    an age group, a proficiency in the second language, and the archetypes,
    relationships and topics that go with it.
    """
    named = lambda p, key: (p.get(key) or {}).get("id", "") if isinstance(p.get(key), dict) else str(p.get(key) or "")
    rows = [(p["id"], float(p.get("weight", 1.0)), named(p, "region"), named(p, "profession"), str(p.get("age_group") or ""), named(p, "L2_proficiency")) for p in personas]
    out = dict(shared or dimensions(spark))
    out["personas"] = spark.createDataFrame(rows, "persona string, weight double, region string, profession string, age_group string, proficiency string")
    for table, column, key in (("persona_archetype", "archetype", "compatible_archetypes"), ("persona_relationship", "relationship", "compatible_relationships"), ("persona_topic", "topic", "natural_topics")):
        out[table] = spark.createDataFrame([(p["id"], x) for p in personas for x in p.get(key) or []], f"persona string, {column} string")
    return out


def tendency(mode: Column, u: Column) -> Column:
    return F.when(mode == "convergent", 0.7).when(mode == "divergent", 0.2).when(mode == "mixed", F.lit(0.3) + u * 0.5).otherwise(0.0)


def sample_sql(rows: str, seed: int = 42, row: str = "row", name: str = "sa") -> str:
    """DuckDB CTEs for ``sample``."""
    values = lambda rows_, cols: "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows_) + f") v({cols}))"
    person = values([(*p[:4], *p[7:]) for p in PERSONAS], "persona, weight, region, profession, age_group, proficiency")
    arch, topics = values(ARCHETYPES, "archetype, weight, cmi_lo, cmi_hi"), values(TOPICS, "topic, weight, shift")
    bridge = lambda i, col: values([(p[0], a) for p in PERSONAS for a in p[i]], f"persona, {col}")

    def bounded(source: str, by: str, value: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        whole = f"(PARTITION BY {by})" if by else "()"
        return f"(SELECT *, (sum(weight) OVER ({part}ORDER BY {value}) - weight) / sum(weight) OVER {whole} AS lo, sum(weight) OVER ({part}ORDER BY {value}) / sum(weight) OVER {whole} AS hi FROM {source})"

    u = lambda stage: draw_sql(stage, seed, row)
    steps = [
        f"{name}0 AS (SELECT r.*, d.persona, d.region, d.profession, d.age_group, d.proficiency FROM {rows} r JOIN {bounded(person, '', 'persona')} d ON {u('persona')} >= d.lo AND {u('persona')} < d.hi)",
        f"{name}1 AS (SELECT r.*, d.archetype FROM {name}0 r JOIN {bounded(f'(SELECT persona, archetype, coalesce(weight, 0.15::DOUBLE) AS weight FROM {bridge(4, 'archetype')} LEFT JOIN {arch} USING (archetype))', 'persona', 'archetype')} d ON r.persona = d.persona AND {u('archetype')} >= d.lo AND {u('archetype')} < d.hi)",
        f"{name}2 AS (SELECT r.*, d.topic FROM {name}1 r JOIN {bounded(f'(SELECT persona, topic, coalesce(weight, 0.1::DOUBLE) AS weight FROM {bridge(6, 'topic')} LEFT JOIN {topics} USING (topic))', 'persona', 'topic')} d ON r.persona = d.persona AND {u('topic')} >= d.lo AND {u('topic')} < d.hi)",
        f"{name}3 AS (SELECT r.*, d.relationship FROM {name}2 r JOIN {bounded(f'(SELECT *, 1.0::DOUBLE AS weight FROM {bridge(5, 'relationship')})', 'persona', 'relationship')} d ON r.persona = d.persona AND {u('relationship')} >= d.lo AND {u('relationship')} < d.hi)",
        f"{name}4 AS (SELECT r.*, d.dialogue_type FROM {name}3 r JOIN {bounded(values(DIALOGUE_TYPES, 'dialogue_type, weight'), '', 'dialogue_type')} d ON {u('type')} >= d.lo AND {u('type')} < d.hi)",
        f"""{name} AS (SELECT r.*, f.formality, a.cmi_lo, a.cmi_hi, t.shift, s.formality_shift, coalesce(w.words, g.words, '') AS domain_words,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (a.cmi_lo + a.cmi_hi) / 2 + s.formality_shift + t.shift)), 6) AS effective_cmi
  FROM {name}4 r JOIN {values(RELATIONSHIPS, 'relationship, formality')} f USING (relationship) JOIN {values(FORMALITY_SHIFT, 'formality, formality_shift')} s USING (formality)
  JOIN {arch} a USING (archetype) JOIN {topics} t USING (topic)
  LEFT JOIN {values([(t, k, w) for (t, k), w in DOMAIN_WORDS.items()], 'topic, profession, words')} w ON w.topic = r.topic AND w.profession = r.profession
  LEFT JOIN {values([(t, w) for (t, k), w in DOMAIN_WORDS.items() if k == 'general'], 'topic, words')} g ON g.topic = r.topic)""",
    ]
    return ",\n".join(steps)


LEVEL_SQL = "CASE " + " ".join(f"WHEN effective_cmi < {b}::DOUBLE THEN '{n}'" for b, n in LEVELS) + " ELSE 'dense' END"
