"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights
are raked: scaled to the target share of each source, then of each language,
then of each topic, again and again until all three marginals hold to within
``TOLERANCE`` (a total variation). A gap that stands still says nothing by
itself: a cell that has to grow from a very small share grows by a constant
factor a sweep and moves the marginals only at the end. So sweeps go on while
any cell still grows or the gap still falls. Targets that no weights can meet together (where pairs of
values have no cell) end in shares of which none grows any more, with the
topics' marginal met and a gap in the others, which is logged; if neither holds
after ``MAX_SWEEPS``, that is an error. A
document's weight is its cell's raked tokens over the cell's own tokens, times
the budget: how often it should be seen. Sampling is by calibrated
probability: the whole part of the weight gives sure copies, the fraction is
the probability of one more, drawn by a hash of the id.

DataFrame and SQL functions only. The cells (sources x languages x topics) are
few next to the documents; they are joined by size (Spark broadcasts them only
below its threshold) and aggregated with partial sums, so a hot source costs
no more than others. The documents' texts are read once; ids, cells and counts
are written to the shared folder.

Targets: for each dimension either a power (share proportional to the
dimension's tokens to that power: 1 keeps the mixture, 0 makes it even) or a
table (value, share). Values that a table leaves out get nothing.

Defined results. A null source or language counts as the empty name. Null or
empty text: no tokens; a cell without tokens has weight 0. Repeated rows get
the same draw. An empty table gives an empty table. Extra columns are ignored,
also one named ``topic``, unless ``topic`` names the column that holds it.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, repeated

DIMS = ("source", "lang", "topic")
#: Shares of a text's characters from which it counts as numeric, markup or loud.
NUMERIC, MARKUP, LOUD = 0.05, 0.03, 0.2
_WORD = r"[^\x20\x09-\x0D]+"
#: How far the marginals may be from their targets (half the sum of the differences), the share by which a table of sweeps lowers that while it settles, the growth of a cell's share in one sweep that counts as none, and the most sweeps.
TOLERANCE, GAIN, STILL, MAX_SWEEPS = 1e-12, 0.01, 1e-6, 2000
#: Cells that are raked in one partition, and sweeps between two written tables.
FEW_CELLS, SWEEPS_A_TABLE = 50_000, 4
#: Digits of a weight; far fewer than raking settles, so that any engine gives the same ones.
DIGITS = 6


def topic_of(text: Column) -> Column:
    """A topic for texts without one: numeric, markup, notice, loud or prose, from counts over the whole text."""
    n = F.length(text)

    def share(chars: str) -> Column:
        return F.regexp_count(text, F.lit(chars)) / n

    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(share("[0-9]") >= NUMERIC, "numeric")
        .when(share("[#$%&*|]") >= MARKUP, "markup")
        .when(F.contains(F.lower(text), F.lit("licen")), "notice")
        .when(share("[A-Z]") >= LOUD, "loud")
        .otherwise("prose")
    )


def cell_of(topic: str | None) -> dict[str, Column]:
    topic = F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else topic_of(F.col("text").cast("string"))
    return {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": topic}


def features(docs: DataFrame, topic: str | None = None) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[value.alias(dim) for dim, value in cell_of(topic).items()],
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def targets(cells: DataFrame, dim: str, wanted: float | DataFrame) -> DataFrame:
    """value, share: the target marginal of one dimension; shares sum to 1."""
    if isinstance(wanted, DataFrame):
        raw = wanted.select(F.col("value").cast("string").alias(dim), F.col("share").cast("double").alias("raw"))
        raw = raw.join(cells.groupBy(dim).agg(F.sum("tokens").alias("have")), dim, "left_semi")
    else:
        raw = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(wanted))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total")).first().total  # one number
    return raw.select(dim, (F.col("raw") / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, wanted: dict[str, float | DataFrame], sweeps: int | None = None) -> DataFrame:
    """The cells (with tokens) plus ``mass``: their raked shares, by ``sweeps`` sweeps or until the marginals hold.

    Up to ``FEW_CELLS`` cells (counted) are held in one partition, so that no
    sweep shuffles; more are spread as usual.
    """
    few = cells.count() <= FEW_CELLS
    now = cells.withColumn("mass", F.col("tokens").cast("double"))
    for dim in DIMS:
        goal = targets(cells, dim, wanted[dim]).withColumnRenamed("share", f"goal_{dim}")
        now = now.join(goal, dim, "left").withColumn(f"goal_{dim}", F.coalesce(f"goal_{dim}", F.lit(0.0)))
    now = cut(now.coalesce(1) if few else now, "cells")
    done, most, gap = 0, sweeps or MAX_SWEEPS, float("inf")
    while done < most:
        now = now.coalesce(1) if few else now
        for _ in range(min(SWEEPS_A_TABLE, most - done)):
            now = now.withColumn("before", F.col("mass"))
            for dim in DIMS:
                now = _scaled(now, dim, few)
            done += 1
        now = cut(now, "cells")
        if sweeps is None:
            before, (gap, growth) = gap, progress(now.coalesce(1) if few else now)
            if gap <= TOLERANCE:
                break
            if growth <= STILL and gap > before * (1 - GAIN):
                logging.getLogger(__name__).warning("the targets cannot be met together: the marginals stay %.6g away from them", gap)
                break
            if done >= most:
                raise ValueError(f"after {done} sweeps the marginals are {gap:.6g} away from their targets, and cells still grow by {growth:.3g} a sweep")
    return now.drop("before")


def _scaled(cells: DataFrame, dim: str, few: bool) -> DataFrame:
    """The cells' masses times target over present share of their value of ``dim``."""
    if few:  # one partition: a window needs no shuffle
        have = F.sum("mass").over(Window.partitionBy(dim))
        return cells.withColumn("mass", F.when(have > 0, F.col("mass") * F.col(f"goal_{dim}") / have).otherwise(0.0))
    joined = cells.join(cells.groupBy(dim).agg(F.sum("mass").alias("have")), dim)
    scaled = joined.withColumn("mass", F.when(F.col("have") > 0, F.col("mass") * F.col(f"goal_{dim}") / F.col("have")).otherwise(0.0))
    return cut(scaled.drop("have"), "cells")


def progress(cells: DataFrame) -> tuple[float, float]:
    """The largest total variation between a marginal and its target, and the largest growth of a cell in the last sweep; two numbers."""
    grown = F.when(F.col("before") > 0, F.col("mass") / F.col("before") - 1)
    found = cells.agg(F.lit(0.0).alias("gap"), F.max(grown).alias("growth"))
    for dim in DIMS:
        of_value = cells.groupBy(dim).agg(F.abs(F.sum("mass") - F.first(f"goal_{dim}")).alias("gap"))
        found = found.union(of_value.agg((F.sum("gap") / 2).alias("gap"), F.lit(0.0).alias("growth")))
    row = found.agg(F.max("gap").alias("gap"), F.max("growth").alias("growth")).first()
    return row.gap or 0.0, row.growth or 0.0


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from the id: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cell_weights(rows: DataFrame, wanted: dict[str, float | DataFrame], budget: float, sweeps: int | None) -> DataFrame:
    """The cells of ``features`` with tokens, and their weights."""
    tokens = F.sum("n_tokens").alias("tokens")
    cells = cut(rows.groupBy(*DIMS).agg(tokens).filter("tokens > 0"), "cells")
    raked = rake(cells, wanted, sweeps)
    total = cells.agg(F.sum("tokens").alias("total")).first().total or 0  # one number
    return raked.select(*DIMS, F.round(F.col("mass") * F.lit(total) * budget / F.col("tokens"), DIGITS).alias("weight"))


def last_copy(weight: Column) -> Column:
    return F.round(weight - F.floor(weight), DIGITS)


def copies_of(weight: Column, doc_id: Column, seed: int) -> Column:
    return (F.floor(weight) + F.when(draw(doc_id, seed) < last_copy(weight), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, wanted: dict[str, float | DataFrame], budget: float = 1.0, sweeps: int | None = None, seed: int = 7, topic: str | None = None) -> DataFrame:
    """One row per document: its cell, n_tokens, weight, probability (of the last copy), copies.

    ``budget`` is the wanted number of tokens over the number at hand.
    """
    rows = cut(features(docs, topic), "features")
    joined = rows.join(cell_weights(rows, wanted, budget, sweeps), list(DIMS), "left")
    weight = F.coalesce(F.col("weight"), F.lit(0.0))
    copies = copies_of(weight, F.col("doc_id"), seed)
    return joined.select("doc_id", *DIMS, "n_tokens", weight.alias("weight"), last_copy(weight).alias("probability"), copies.alias("copies"))


def sample(docs: DataFrame, wanted: dict[str, float | DataFrame], budget: float = 1.0, sweeps: int | None = None, seed: int = 7, topic: str | None = None) -> DataFrame:
    """The documents, all columns, each as often as it is drawn; the texts are not shuffled."""
    weights = cell_weights(cut(features(docs, topic), "features"), wanted, budget, sweeps)
    own = {f"__{dim}": value for dim, value in cell_of(topic).items()}
    of_cell = weights.select(*[F.col(dim).alias(f"__{dim}") for dim in DIMS], F.col("weight").alias("__weight"))
    drawn = docs.withColumns(own).join(of_cell, list(own), "left")
    copies = copies_of(F.coalesce(F.col("__weight"), F.lit(0.0)), F.col("doc_id").cast("long"), seed)
    return repeated(drawn.withColumn("__copies", copies), "__copies").select(*docs.columns)


def mix_sql(wanted: dict[str, float], budget: float = 1.0, sweeps: int = 60, seed: int = 7) -> str:
    """DuckDB SQL for the rows of ``mix`` over ``documents`` with powers as targets; a fixed number of sweeps, more than raking needs."""
    parts = [
        rf"""f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
       WHEN len(regexp_extract_all(text, '[0-9]')) / length(text) >= {NUMERIC} THEN 'numeric'
       WHEN len(regexp_extract_all(text, '[#$%&*|]')) / length(text) >= {MARKUP} THEN 'markup'
       WHEN contains(lower(text), 'licen') THEN 'notice'
       WHEN len(regexp_extract_all(text, '[A-Z]')) / length(text) >= {LOUD} THEN 'loud'
       ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM f GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for dim in DIMS:
        parts.append(f"g_{dim} AS (SELECT {dim}, raw / sum(raw) OVER () AS share FROM (SELECT {dim}, pow(sum(tokens)::DOUBLE, {float(wanted[dim])}) AS raw FROM c GROUP BY {dim}))")
    last = "(SELECT source, lang, topic, tokens, tokens::DOUBLE AS mass FROM c)"
    for i in range(sweeps):
        for dim in DIMS:
            parts.append(f"m_{i}_{dim} AS (SELECT source, lang, topic, tokens, mass * (SELECT share FROM g_{dim} g WHERE g.{dim} = x.{dim}) / sum(mass) OVER (PARTITION BY {dim}) AS mass FROM {last} x)")
            last = f"m_{i}_{dim}"
    parts.append(f"w AS (SELECT source, lang, topic, round(mass * (SELECT sum(tokens) FROM c) * {budget} / tokens, {DIGITS}) AS weight FROM {last})")
    parts.append(f"j AS (SELECT f.*, coalesce(weight, 0.0) AS weight, round(coalesce(weight, 0.0) - floor(coalesce(weight, 0.0)), {DIGITS}) AS probability FROM f LEFT JOIN w USING (source, lang, topic))")
    return (
        "WITH " + ",\n".join(parts) + "\n"
        "SELECT doc_id, source, lang, topic, n_tokens, weight, probability, (floor(weight) + CASE WHEN "
        f"('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability THEN 1 ELSE 0 END)::BIGINT AS copies FROM j"
    )
