"""Quality of documents by co-training two views.

The *text view* sees the words of a document (whether it holds the words that tell the
classes apart best) and the shape of its text; the *metadata view* sees language, source,
length and line layout. Each view has a logistic classifier. In every round both are fitted
on the labelled rows and on the pseudo-labels that the other view has given to rows of an
unlabelled pool of which it is confident, and are calibrated on labelled rows kept aside.
At the end the calibrated views are combined by a logistic function fitted on these rows,
and every document is scored. The same is done for two targets, quality and toxicity; a
document is kept if its quality is likely and its toxicity is not.

Fitted on bounded samples: at most ``labelled_rows`` labelled and ``pool_rows`` unlabelled
documents, those with the smallest hashes of their id, and at most ``vocabulary`` words. The
labelled rows are drawn from each combination of labels, the rarest first and whole if they
fit; weights undo that within a class, and the true shares of the classes enter the log-odds
at the end. The words are chosen anew in each round, pseudo-labelled rows included.
Scoring covers all documents in one pass without a shuffle.

Null text, language or source count as empty, a null length as zero. Null ids are scored but
never labelled. Several labels of one document count as their majority (a tie as the
positive class), null labels not at all. A class with so few labels that none is kept aside
(or none is left to fit on) serves for both. Where a target has no label of a class at all,
a warning says so, its score is null and it rejects nothing. Repeated rows are scored each; of rows
with one id the sample takes one (the smallest hash of what is read). Only the
named columns are read.
"""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import kind, logistic
from panelcast.session import materialize

LABELLED_ROWS = 8_000
POOL_ROWS = 8_000
VOCABULARY = 600
ROUNDS = 2
CONFIDENT = 0.97
ROWS_A_TASK = 8_000  # of the sample while it is fitted: each step of a fit is a job, of which the driver keeps something for every stage and task
LANGUAGES, SOURCES = 16, 64  # hashed places of languages and sources
SHAPES = 10  # numbers that describe the shape of a text
TARGETS = ("quality", "toxic")
VIEWS = {"text": ["words", "shape"], "meta": ["meta"]}  # the columns each view is fitted on


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_CAPITALS, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))


def _look(text: str | None, lang, source, length) -> tuple[set[bytes], list[float], list[float]]:
    """What the views see of one document: its words, the shape of its text, its metadata."""
    raw = (text or "").encode()
    words = _WORD.findall(raw.lower())
    distinct = set(words)
    n, some, length = len(raw), len(words), float(length or 0)
    per = lambda x, y: x / y if y else 0.0
    without = lambda these: n - len(raw.translate(None, these))
    marks, lines = without(_MARKS), raw.count(b"\n")
    shape = [
        per(marks, n), per(without(_CAPITALS), n), per(without(_DIGITS), n), per(marks, some), per(n, some) / 10,
        per(len(distinct), some), per(math.log1p(len(distinct)), math.log1p(some)), float(some == 0), float(some < 30), math.log1p(some) / 5,
    ]
    meta = [math.log1p(max(length, 0.0)) / 5, per(lines, length) * 100, math.log1p(max(length, 0.0) / (lines + 1)) / 5, float(length <= 0)]
    for value, places in ((lang, LANGUAGES), (source, SOURCES)):
        one = [0.0] * places
        one[xxhash.xxh64_intdigest(str("" if value is None else value).encode()) % places] = 1.0
        meta += one
    return distinct, shape, meta


def _seen(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The columns the views read, under fixed names, next to those to carry along."""
    return docs.select(*carry, *[F.col(f"`{c}`").alias(n) for n, c in (("_id", id_col), ("_text", text_col), ("_lang", lang_col), ("_source", source_col), ("_length", length_col))])


def _looks(b: pa.RecordBatch):
    columns = (b.column(c) for c in ("_text", "_lang", "_source", "_length"))
    for text, lang, source, length in zip(*columns, strict=True):
        yield _look(text.as_py(), lang.as_py(), source.as_py(), length.as_py())


def features(seen: DataFrame, carry: list[str]) -> DataFrame:
    """``(carried columns, id, words array<binary>, shape array<double>, meta array<double>)``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = list(_looks(part))
                yield pa.RecordBatch.from_pydict({
                    **{c: part.column(c) for c in carry}, "id": part.column("_id"), "words": pa.array([sorted(w) for w, _, _ in found], pa.list_(pa.binary())),
                    "shape": pa.array([x for _, x, _ in found], pa.list_(pa.float64())), "meta": pa.array([x for _, _, x in found], pa.list_(pa.float64())),
                })

    types = ", ".join([*[f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in carry], f"id {kind(seen, '_id')}"])
    return seen.mapInArrow(run, f"{types}, words array<binary>, shape array<double>, meta array<double>")


@dataclass
class View:
    """A fitted classifier and the line that calibrates its logit."""

    column: str
    model: LogisticRegressionModel
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, df: DataFrame) -> DataFrame:
        raw = self.model.transform(df)
        return raw.withColumn(f"{self.column}_logit", self.slope * vector_to_array("rawPrediction")[1] + self.offset).drop("rawPrediction", "probability", "prediction")


class Target:
    """All that scores one target, in plain numbers."""

    def __init__(self, vocabulary: list[str], views: list[View], combine: np.ndarray):
        text, meta = views
        self.vocabulary, self.combine = vocabulary, combine
        weights = text.model.coefficients.toArray()
        n = len(weights) - SHAPES
        self._words = {w.encode(): float(x) for w, x in zip(vocabulary, weights[:n], strict=True) if x}
        self._shape, self._text_start = weights[n:], text.model.intercept
        self._meta, self._meta_start = meta.model.coefficients.toArray(), meta.model.intercept
        self._lines = [(v.slope, v.offset) for v in views]

    def score(self, words: set[bytes], shape: list[float], meta: list[float]) -> float:
        known = self._words
        text = sum(known[w] for w in words & known.keys()) + float(self._shape @ shape) + self._text_start
        logits = (text, float(self._meta @ meta) + self._meta_start)
        z = sum(c * (a * x + b) for c, (a, b), x in zip(self.combine, self._lines, logits, strict=False)) + self.combine[-1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _vectors(df: DataFrame, words: CountVectorizerModel, *views: str) -> DataFrame:
    """``df`` with the vectors that these views read."""
    if "meta" in views:
        df = df.withColumn("meta_vector", array_to_vector("meta"))
    if "text" in views:
        df = words.transform(df.withColumn("texts", F.transform("words", lambda w: F.decode(w, "UTF-8")))).withColumn("shape_vector", array_to_vector("shape"))
        df = VectorSizeHint(inputCol="shape_vector", size=SHAPES, handleInvalid="optimistic").transform(df)  # else a job looks at the first row
        df = VectorAssembler(inputCols=["word_vector", "shape_vector"], outputCol="text_vector").transform(df).drop("texts", "word_vector", "shape_vector")
    return df


def _telling_words(labelled: DataFrame, target: str, n: int) -> list[str]:
    """Words whose presence tells the classes apart, over all labelled rows of the sample.

    Taken are those whose log-likelihood ratio is too large for chance even if every word
    is tried (5 % over all of them), at most ``n``, best first.
    """
    per = labelled.select(target, F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col(target)).alias("a"), F.count(F.lit(1)).alias("k")
    ).where("k >= 3")
    size = labelled.agg(F.sum(target).alias("pos"), F.count(F.lit(1)).alias("all")).first()
    tried = max(1, per.count())
    pos, every = float(size["pos"]), float(size["all"])
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    cells = [(a, k * pos / every), (k - a, k * (every - pos) / every), (F.lit(pos) - a, (every - k) * pos / every), (every - pos - k + a, (every - k) * (every - pos) / every)]
    ratio = sum((part(x, e) for x, e in cells), F.lit(0.0))
    return [bytes(r["word"]).decode() for r in per.select("word", ratio.alias("g")).where(F.col("g") > float(np.log(tried / 0.05))).orderBy(F.desc("g"), "word").limit(n).collect()]


def _fit_target(sample: DataFrame, target: str, vocabulary: int, rounds: int, confident: float, parts: int) -> Target | None:
    labelled = sample.where(F.col(target).isNotNull())
    stands = F.col("stands_for")
    counts = {r[target]: r for r in labelled.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.sum(stands).alias("all"), F.sum(F.col("aside").cast("int")).alias("n_aside")).collect()}
    if len(counts) < 2:
        warnings.warn(f"no document has the label {target} = {0 if 0.0 not in counts else 1}: the target cannot be fitted and rejects nothing", stacklevel=2)
        return None
    both = [c for c, r in counts.items() if r["n_aside"] in (0, r["n"])]  # too few to be split
    shift = math.log(counts[1.0]["all"] / counts[0.0]["all"]) - math.log(counts[1.0]["n"] / counts[0.0]["n"])  # from the sample's shares of the classes to the true ones
    own = [(c, r["n"] / r["all"]) for c, r in counts.items()]
    of_class = F.when(F.col(target) == own[0][0], own[0][1]).when(F.col(target) == own[1][0], own[1][1])
    rows = sample.select("words", "shape", "meta", F.col(target).alias("label"), F.coalesce(stands * of_class, F.lit(1.0)).alias("weight"),
                         (~F.col("aside") | F.col(target).isin(both)).alias("fits"), (F.col("aside") | F.col(target).isin(both)).alias("checks"))
    rows = materialize(rows.coalesce(2 * parts))
    columns = tuple(VIEWS)
    given: dict[str, DataFrame | None] = {c: None for c in columns}  # rows of the pool with the pseudo-labels each view receives
    for number in range(rounds + 1):
        fitting = {}
        for c in columns:
            train = rows.where("label IS NOT NULL AND fits").select(*VIEWS[c], "label", "weight")
            fitting[c] = train if given[c] is None else train.unionByName(given[c])
        found = _telling_words(fitting["text"].withColumnRenamed("label", target), target, vocabulary)
        found = found or ["-"]  # no word tells: one that no text can hold
        words = CountVectorizerModel.from_vocabulary(found, inputCol="texts", outputCol="word_vector")
        words.setBinary(True)
        views = []
        for c in columns:
            train = _vectors(fitting[c], words, c).select(f"{c}_vector", "label", "weight").coalesce(parts)
            model = LogisticRegression(featuresCol=f"{c}_vector", labelCol="label", weightCol="weight", regParam=0.01, maxIter=500, tol=1e-6).fit(train)
            if model.summary.totalIterations >= 500:
                warnings.warn(f"{target}, {c} view: the fit has not met its tolerance", stacklevel=2)
            views.append(View(c, model))
        kept_aside = _vectors(rows.where("label IS NOT NULL AND checks"), words, *columns)
        for view in views:
            kept_aside = view.logit(kept_aside)
        table = np.array([[r[f"{c}_logit"] for c in columns] + [r["label"], r["weight"]] for r in kept_aside.select(*(f"{c}_logit" for c in columns), "label", "weight").collect()])
        y, weight = table[:, 2], table[:, 3]
        for i, view in enumerate(views):
            w = logistic(table[:, [i]], y, weight=weight)
            view.slope, view.offset = float(max(w[0], 0.0)), float(w[1] if w[0] > 0 else np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
            table[:, i] = view.slope * table[:, i] + view.offset
        if number == rounds:
            combine = logistic(table[:, :2], y, weight=weight)
            combine[-1] += shift
            return Target(found, views, combine)
        pool = rows.where("label IS NULL").drop("label")
        edge = float(np.log(confident / (1 - confident)))
        for view, other in zip(views, columns[::-1], strict=True):
            logit = F.col(f"{view.column}_logit") + F.lit(shift)
            sure = view.logit(_vectors(pool, words, view.column)).where(F.abs(logit) >= edge)
            given[other] = materialize(sure.select(*VIEWS[other], (logit > 0).cast("double").alias("label"), "weight"))
    raise AssertionError


def _per_class(labels: DataFrame, labelled_rows: int) -> DataFrame:
    """``labels`` of at most so many ids and how many each ``stands_for``: rare combinations of labels whole, the others share the rest."""
    sizes = sorted(((r["count"], tuple(r[t] for t in TARGETS)) for r in labels.groupBy(*TARGETS).count().collect()), key=lambda x: (x[0], str(x[1])))
    drawn, left = labels.limit(0).withColumn("stands_for", F.lit(None).cast("double")), labelled_rows
    for i, (size, values) in enumerate(sizes):
        n = min(size, left // (len(sizes) - i))
        left -= n
        if n:
            of = labels.where(" AND ".join(f"{t} <=> {'NULL' if v is None else f'{v:.1f}D'}" for t, v in zip(TARGETS, values, strict=True)))
            drawn = drawn.union((of if n == size else of.orderBy(F.xxhash64("id"), "id").limit(n)).withColumn("stands_for", F.lit(size / n)))
    return drawn


def _sample(docs: DataFrame, labels: DataFrame, ids: DataFrame, labelled_rows: int, pool_rows: int, columns: dict[str, str]) -> DataFrame:
    """Features of the labelled sample and of the unlabelled pool; their ids are chosen first, so that no other text is looked at."""
    order = F.xxhash64("id")
    chosen = _per_class(labels, labelled_rows)
    pool = ids.join(labels.select("id"), "id", "left_anti").distinct().orderBy(order, "id").limit(pool_rows).select("id", *[F.lit(None).cast("double").alias(t) for t in (*TARGETS, "stands_for")])
    picked = chosen.unionByName(pool).select(F.col("id").alias("_picked"), *[F.col(t).alias(f"_label_{t}") for t in (*TARGETS, "stands_for")])
    marks = [f"_label_{t}" for t in (*TARGETS, "stands_for")]
    own = docs.join(F.broadcast(picked), F.col(f"`{columns.get('id_col', 'doc_id')}`") == F.col("_picked"))  # bounded by the two limits
    seen = _seen(own, marks, **columns)
    read = [c for c in seen.columns if c not in (*marks, "_id")]
    one = seen.groupBy("_id", *marks).agg(F.min(F.struct(F.xxhash64(*read), *read)).alias("_one")).select(*marks, "_id", *[F.col(f"_one.{c}") for c in read])  # one row an id
    rows = features(one, marks)
    return rows.select("id", "words", "shape", "meta", F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(4)).eqNullSafe(0).alias("aside"), *[F.col(f"_label_{t}").alias(t) for t in (*TARGETS, "stands_for")])


def train(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, vocabulary: int = VOCABULARY, rounds: int = ROUNDS,
    confident: float = CONFIDENT, **columns: str,
) -> dict[str, Target | None]:
    """Fit both targets; ``labels`` has (id, quality, toxic) with 0 and 1."""
    id_col = columns.get("id_col", "doc_id")
    majority = lambda t: (F.avg(F.col(t).cast("double")) >= 0.5).cast("double").alias(t)
    own = labels.select(F.col(f"`{id_col}`").alias("id"), *TARGETS).where("id IS NOT NULL").groupBy("id").agg(*map(majority, TARGETS)).where(" OR ".join(f"{t} IS NOT NULL" for t in TARGETS))
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL")
    own = materialize(own.join(ids.distinct(), "id", "left_semi"))  # read once for each combination of labels
    sample = materialize(_sample(docs, own, ids, labelled_rows, pool_rows, columns))
    parts = max(2, math.ceil((labelled_rows + pool_rows) / ROWS_A_TASK))
    return {t: _fit_target(sample, t, vocabulary, rounds, confident, parts) for t in TARGETS}


def _scored(docs: DataFrame, targets: dict[str, Target | None], keep_above: float, toxic_below: float, carry: list[str], columns: dict[str, str]) -> DataFrame:
    seen = _seen(docs, carry, **columns)
    quality, toxic = targets["quality"], targets["toxic"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                good, bad = [], []
                for look in _looks(part):
                    good.append(quality and quality.score(*look))
                    bad.append(toxic and toxic.score(*look))
                keep = [(g is None or g >= keep_above) and (t is None or t < toxic_below) for g, t in zip(good, bad, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    **{c: part.column(c) for c in carry}, "id": part.column("_id"), "score": pa.array(good, pa.float64()), "toxic_score": pa.array(bad, pa.float64()), "keep": pa.array(keep, pa.bool_()),
                })

    types = ", ".join([*[f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in carry], f"id {kind(seen, '_id')}"])
    return seen.mapInArrow(run, f"{types}, score double, toxic_score double, keep boolean")


def score(docs: DataFrame, targets: dict[str, Target | None], keep_above: float = 0.5, toxic_below: float = 0.5, **columns: str) -> DataFrame:
    """``(id, score, toxic_score, keep)`` for every row."""
    return _scored(docs, targets, keep_above, toxic_below, [], columns).withColumnRenamed("id", columns.get("id_col", "doc_id"))


def keep(docs: DataFrame, labels: DataFrame, keep_above: float = 0.5, toxic_below: float = 0.5, **options) -> DataFrame:
    """``docs`` with all its columns, without the rejected rows; no shuffle of texts."""
    columns = {k: v for k, v in options.items() if k.endswith("_col")}
    targets = train(docs, labels, **options)
    carried = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return _scored(carried, targets, keep_above, toxic_below, ["_row"], columns).where("keep").select("_row.*")
