"""Toxicity by maximum-scoring segments.

Learning. Of the labelled ids at most ``max_train`` (those with the smallest
hashes) give, by class, the number of texts with each feature; a feature is a
word or one of its prefixes of 3 to 6 letters, so that inflected words share
evidence. A feature's weight is its log-odds with a Dirichlet prior (half a
text, plus ``PRIOR`` times the feature's count in both classes), kept where
it is ``MIN_ODDS`` or more and ``MIN_Z`` standard deviations above zero.

Scoring. Each word scores its best feature, or a small penalty. A linear scan
over the words finds all maximal scoring segments. In texts without toxic
passages the best segment follows an extreme-value law: among ``n`` words,
P(S >= x) = 1 - exp(-K n e^(-lambda x)). A segment is significant where its
expected number of chance matches is under ``MAX_E``; the significant ones are
summed as -log(E), and a ridge logistic curve turns the sum and the best
segment into a probability.

Calibration. lambda, K and the curve are fitted on scores of texts that had no
part in the weights they are scored with: the training rows fall into
``FOLDS`` folds, and each is scored with the weights of the others.

The model is a weight for each feature that passes (all of them, without a
cap: only the labelled rows are bounded) and five numbers. The training texts
are written once; all texts are read once to be scored, never shuffled. From
the training rows the driver takes sums, a count for each distinct score, and
three numbers a row.

Defined results. Null or empty text: no words, no segments, the curve's value
at zero evidence. A null label is no label; of several labels of one id the
largest counts, of several rows of one id the least text is learnt from.
Without labelled rows every score is 0. Repeated rows each get a row; a null
doc_id counts as the empty text in the fold. Extra columns, also ones with the
names of the result or of labels, are ignored (``clean`` carries them through).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import CACHE_WORDS, binary, columns_as, cut

PREFIXES = (3, 4, 5, 6)
#: Strength of the informative prior, as a share of the counts; least z and log-odds of a kept feature; score of a word without one; largest expected chance matches.
PRIOR, MIN_Z, MIN_ODDS, PENALTY, MAX_E = 0.002, 3.0, 2.0, -0.5, 0.05
#: Parts of the training rows, each scored by the weights of the others.
FOLDS = 5
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_TABLE).split()


def features_of(word: bytes) -> list[bytes]:
    """The word, and its prefixes marked by a star (which no word holds); by letters, not bytes."""
    letters = word.decode("utf-8", "replace")
    return [word, *[letters[:k].encode() + b"*" for k in PREFIXES if len(letters) > k]]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] | None = None

    def score_of(self, evidence: float, best: float) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(evidence) + c * math.log1p(best)))))


class WordScores(dict):
    """Word to its score; a bounded cache."""

    def __init__(self, weights: dict[bytes, float], most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        found = [self.weights[f] for f in features_of(word) if f in self.weights]
        value = self[word] = max(found) if found else PENALTY
        return value


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time.

    Kept are candidates with the running total before and after each; a new
    candidate joins earlier ones as long as that raises its score.
    """
    values = np.asarray(scores)
    positive = np.flatnonzero(values > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(values)])
    out: list[list] = []  # start, stop, total before, total after
    links: list[int] = []  # nearest earlier candidate with a smaller total before
    for i in positive.tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = links[j]
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                links.append(j)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:], links[j:]
    return [(a, b, float(after - before)) for a, b, before, after in out]


def passages(model: Model, cache: WordScores, text: bytes) -> tuple[int, list[tuple[int, int, float, float]], float, float]:
    """Number of words, significant segments (start, stop, score, expected chance matches), evidence, best score."""
    words = words_of(text)
    found, best, evidence = [], 0.0, 0.0
    for start, stop, score in segments(list(map(cache.__getitem__, words))):
        best = max(best, score)
        expected = model.scale * len(words) * math.exp(-model.rate * score)
        if expected <= MAX_E:
            found.append((start, stop, score, expected))
            evidence -= math.log(max(expected, 1e-300))
    return len(words), found, evidence, best


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """text, toxic and fold of at most ``max_train`` labelled ids outside the held-out fold."""
    known = columns_as(labels, doc_id="bigint", toxic="int").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = columns_as(docs, doc_id="bigint", text="string")
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most max_train rows
    once = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


_COUNTS = [f"n{toxic}_{fold}" for fold in range(FOLDS) for toxic in (0, 1)]


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, and n0_k and n1_k for each fold k: texts with the feature, by class."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in _COUNTS]

        def flush() -> pa.RecordBatch:
            names = list(set().union(*counts))
            columns = [pa.array(names, pa.binary()), *[pa.array([c[f] for f in names], pa.int64()) for c in counts]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", *_COUNTS])

        for batch in batches:
            for text, toxic, fold in zip(binary(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                counts[2 * fold + toxic].update({f for word in set(words_of(text or b"")) for f in features_of(word)})
                if sum(map(len, counts)) > CACHE_WORDS:
                    yield flush()
        yield flush()

    out = rows.mapInArrow(rows_of, "feature binary, " + ", ".join(f"{c} long" for c in _COUNTS))
    return out.groupBy("feature").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _log_odds(n0: Column, n1: Column, all0: float, all1: float) -> Column:
    """The feature's weight, or null where the evidence is too thin."""
    prior = F.lit(0.5) + F.lit(PRIOR) * (n0 + n1)
    strength = PRIOR * (all0 + all1)
    one, none = n1 + prior, n0 + prior
    odds = F.log(one / (F.lit(all1 + strength) - one + 1)) - F.log(none / (F.lit(all0 + strength) - none + 1))
    return F.when((odds / F.sqrt(1 / one + 1 / none) >= MIN_Z) & (odds >= MIN_ODDS), odds)


def learn_weights(rows: DataFrame) -> list[dict[bytes, float]]:
    """The weights of all training rows, then those without each fold."""
    counts = cut(feature_counts(rows), "features")
    words = counts.filter(~F.endswith(F.col("feature"), F.lit(b"*"))).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]).first().asDict()
    columns = []
    for left_out in (None, *range(FOLDS)):
        used = [k for k in range(FOLDS) if k != left_out]
        n0, n1 = (sum((F.col(f"n{toxic}_{k}") for k in used), F.lit(0)) for toxic in (0, 1))
        all0, all1 = (float(sum(words[f"n{toxic}_{k}"] for k in used)) for toxic in (0, 1))
        columns.append(_log_odds(n0, n1, all0, all1).alias(f"w{len(columns)}"))
    names = [f"w{i}" for i in range(FOLDS + 1)]
    passed = counts.select("feature", *columns).filter(F.coalesce(*names).isNotNull())
    out: list[dict[bytes, float]] = [{} for _ in names]
    for row in passed.collect():  # features with evidence from at most max_train texts
        for weights, value in zip(out, row[1:], strict=True):
            if value is not None:
                weights[bytes(row.feature)] = float(value)
    return out


def judged_rows(rows: DataFrame, weights: list[dict[bytes, float]]) -> DataFrame:
    """toxic, n words, hits (positive word scores with counts), segments (scores): each row by the weights without its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    hit = pa.struct([("score", pa.float64()), ("count", pa.int64())])
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("hits", pa.list_(hit)), ("segments", pa.list_(pa.float64()))])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [WordScores(w, CACHE_WORDS // FOLDS) for w in shared.value[1:]]
        for batch in batches:
            out = []
            for text, toxic, fold in zip(binary(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                scores = list(map(caches[fold].__getitem__, words_of(text or b"")))
                hits = Counter(s for s in scores if s > 0)
                out.append((toxic, len(scores), [{"score": s, "count": n} for s, n in hits.items()], [s for _, _, s in segments(scores)]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(rows_of, "toxic int, n long, hits array<struct<score:double,count:long>>, segments array<double>")


def _solve_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """lambda with sum(share * exp(lambda * score)) = 1, by bisection."""
    low, high = 1e-6, 1.0
    value = lambda x: float(np.sum(shares * np.exp(np.minimum(x * scores, 500)))) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression on two inputs by Newton steps, halved until the loss falls."""
    design = np.column_stack([np.ones(len(x)), np.log1p(x)])
    beta = np.zeros(3)
    penalty = np.diag([1e-3, ridge, ridge])

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float(np.sum(np.logaddexp(0, z) - y * z) + at @ penalty @ at / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        now, share = loss(beta), 1.0
        while loss(beta + share * step) > now and share > 1e-6:
            share /= 2
        beta = beta + share * step
        if np.abs(share * step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Model:
    """Learn a model from at most ``max_train`` labelled ids outside the held-out fold."""
    rows = cut(training_rows(docs, labels, max_train), "training")
    if rows.isEmpty():
        return Model()
    weights = learn_weights(rows)
    model = Model(weights[0])
    judged = cut(judged_rows(rows, weights), "judged").withColumn("best", F.coalesce(F.array_max("segments"), F.lit(0.0)))
    clean = judged.filter("toxic = 0")
    hits = clean.select(F.explode("hits").alias("hit")).groupBy("hit.score").agg(F.sum("hit.count").alias("count")).collect()  # distinct weights
    size = clean.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    chance = [(r.score, float(r["count"])) for r in hits] + [(max(weights[0].values(), default=1.0), 1.0)]  # one more, so that chance is never ruled out
    rest = max(size.words - sum(n for _, n in chance) + 1, 1)
    shares = np.array([n for _, n in chance] + [rest])
    model.rate = _solve_rate(np.array([s for s, _ in chance] + [PENALTY]), shares / shares.sum())
    reached = clean.agg(F.sum(F.col("n") * F.exp(F.col("best") * -model.rate)).alias("total")).first().total or 0.0
    model.scale = max(1e-6, size.rows / max(reached, 1e-9)) if size.rows else 1.0
    expected = F.transform("segments", lambda s: F.col("n") * model.scale * F.exp(s * -model.rate))
    evidence = F.aggregate(F.filter(expected, lambda e: e <= MAX_E), F.lit(0.0), lambda total, e: total - F.log(F.greatest(e, F.lit(1e-300))))
    inputs = judged.select("toxic", evidence.alias("evidence"), "best").collect()  # three numbers for each of at most max_train rows
    inputs.sort(key=tuple)  # sums in one order whatever the tasks
    model.curve = _fit_curve(np.array([(r.evidence, r.best) for r in inputs]), np.array([float(r.toxic) for r in inputs]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_words, and the significant passages (word ranges) with score and expected chance matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_words", pa.int64()), ("passages", pa.list_(passage))])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = WordScores(model.weights)
        for batch in batches:
            out = []
            for text in binary(batch.column("text")):
                n, found, evidence, best = passages(model, cache, text or b"")
                value = model.score_of(evidence, best)
                out.append((value, int(value >= 0.5), n, [dict(zip(("start", "stop", "score", "expected"), f, strict=True)) for f in found]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return columns_as(docs, doc_id="bigint", text="string").mapInArrow(
        rows_of, "doc_id long, score double, predicted int, n_words long, passages array<struct<start:int,stop:int,score:double,expected:double>>"
    )


def clean(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """The documents, all columns, that the model does not hold toxic; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = WordScores(model.weights)
        for batch in batches:
            judged = (passages(model, cache, text or b"") for text in binary(batch.column("text")))
            yield batch.filter(pa.array([model.score_of(evidence, best) < 0.5 for _, _, evidence, best in judged], pa.bool_()))

    return docs.mapInArrow(rows_of, docs.schema)
