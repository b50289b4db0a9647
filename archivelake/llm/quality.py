"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a fixed vector of transformed statistics. Per class, mean and covariance are
gathered over all labelled training rows as sums (nothing is sampled); the covariance is shrunk
towards the pooled one and towards its diagonal, factored once by Cholesky, and a text's score is
the logistic of the difference of the two log densities plus the log prior ratio.

Defined cases: a null text counts as empty; an empty text is scored like any other (its statistics are
zeros); a null label or a label other than 0 and 1 is left out; repeated label rows of a document count
once, and a document with labels of both kinds is left out; with no row of one class the score is the share of class 1 (0.5 without any row); an empty
table gives an empty result. Columns other than those named are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, mapped, prepared

SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\")\]]+(?=\s|$)")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)")
#: Statistics of texts of fewer words are pulled towards zero by these many unseen words.
PRIOR_WORDS = 3.0


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text; zeros for an empty one."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return np.zeros(len(NAMES))
    w, c = n + PRIOR_WORDS, chars + 10.0
    upper = sum(x.isupper() and len(x.strip("!?.,")) > 1 for x in words)
    distinct = len(set(words))
    counts = Counter(lines)
    repeated = sum(v - 1 for v in counts.values())
    spaces = chars - len("".join(words))
    alone = sum(not any(ch.isalnum() for ch in x) for x in words if len(x) <= 4)
    letters = sum(map(str.isalpha, words))
    by_line = sum(len(x) for x in lines if x.rstrip()[-1:] in ".!?\"'")
    digits = sum(text.count(d) for d in "0123456789")
    signs = sum(text.count(d) for d in "#$%&*@^~=<>{}[]\\_+/")
    worst = 0.0
    for x in lines:  # the largest line of each kind of junk
        own = x.split()
        k = len(own) + PRIOR_WORDS
        worst = max(worst, sum(y.isupper() and len(y) > 2 for y in own) / k, x.count("|") / k, len(SYMBOL_END.findall(x)) / k)
    share = lambda k, of: np.sqrt(max(k, 0) / of)
    return np.array(
        [
            np.log1p(n),
            np.log1p(chars / n),
            share(upper, w),
            share(text.count("!"), w),
            share(text.count("|"), w),
            share(len(SYMBOL_END.findall(text)), w),
            share(signs, c),
            share(digits, c),
            share(alone, w),
            share(letters, w),
            share(len(SENTENCE_END.findall(text)), w),
            share(text.count(","), w),
            np.log(distinct / n + 0.05),
            share(repeated, len(lines) + 1.0),
            share(by_line, c),
            np.log1p(n / len(lines)),
            share(spaces, c),
            np.sqrt(worst),
            share(max(Counter(words).values()) - 1, w),
            np.log1p(len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1))) - np.log1p(chars),
        ]
    )


NAMES = [
    "words", "word_length", "capitals", "exclamations", "bars", "symbol_ends", "signs", "digits", "signs_alone",
    "plain_words", "sentence_ends", "commas", "distinct_words", "repeated_lines", "ended_lines", "line_words",
    "spaces", "worst_line", "top_word", "compressed",
]
SCHEMA_X = "doc_id bigint, x array<double>"


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    log_prior: float
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.factors):
            return np.full(len(x), 1 / (1 + np.exp(-self.log_prior)))
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + logdet))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature + self.log_prior, -40, 40)))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every whole text."""
    def run(cols):
        return {"doc_id": cols["doc_id"], "x": [statistics(t).tolist() for t in cols["text"]]}

    return map_batches(prepared(docs, "doc_id", "text"), run, SCHEMA_X)


def moments(x: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of each class: at most 2 * (k + 2) rows reach the driver, each summed over all rows."""
    quality = F.col("quality").cast("double")
    labels = labels.where(quality.isin(0.0, 1.0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(quality).alias("low"), F.max(quality).alias("high"))
    labels = labels.where("low = high").select("doc_id", F.col("low").cast("int").alias("label"))
    rows = x.join(labels, "doc_id").select("label", "x")
    k = len(NAMES)

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
            if not len(label):
                continue
            z = np.asarray(batch.column(1).to_pylist()).reshape(len(label), k)
            z = np.hstack([np.ones((len(z), 1)), z])
            for c in np.unique(label):
                own = z[label == c]
                total[int(c)] = total.get(int(c), 0) + own.T @ own
        out = [(c, i, row.tolist()) for c, m in total.items() for i, row in enumerate(m)]
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array([r[0] for r in out], pa.int32()), "i": pa.array([r[1] for r in out], pa.int32()), "v": pa.array([r[2] for r in out], pa.list_(pa.float64()))}
        )

    cells = rows.mapInArrow(partial, "label int, i int, v array<double>").groupBy("label", "i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(k + 1)])
    found: dict[int, np.ndarray] = {}
    for r in cells.collect():
        found.setdefault(r["label"], np.zeros((k + 1, k + 1)))[r["i"]] = [r[f"s{j}"] for j in range(k + 1)]
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in found.items()}


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.25, diagonal: float = 0.1, ridge: float = 1e-3, temperature: float = 3.0) -> Discriminant:
    """``pooled`` and ``diagonal`` are the shares of shrinkage towards the pooled covariance and its diagonal; ``temperature`` softens the log density difference."""
    if len(found) < 2:
        n1, n = sum(m[0] for c, m in found.items() if c), sum(m[0] for m in found.values())
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    means = np.array([found[c][1] / found[c][0] for c in (0, 1)])
    covs = [found[c][2] / found[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    counts = np.array([found[c][0] for c in (0, 1)])
    both = sum(n * s for n, s in zip(counts, covs, strict=True)) / counts.sum()
    factors, logdets = [], []
    for s in covs:
        s = (1 - pooled) * s + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + np.diag(ridge * (np.diag(both) + 1e-3))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(logdets), float(np.log(counts[1] / counts[0])), temperature)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, spark: SparkSession, threshold: float = 0.7, **options) -> DataFrame:
    """Every document with held_out, score and predicted; learns from labelled rows that are not held out."""
    scratch = Scratch(spark, "quality")
    x = scratch.write(vectors(docs), "x")
    model = fit(moments(x.where(~held_out()), labels), **options)

    def run(cols):
        z = np.asarray(cols["x"], dtype=float).reshape(len(cols["x"]), len(NAMES))
        return {"doc_id": cols["doc_id"], "score": model.score(z).tolist()}

    scored = map_batches(x, run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, spark: SparkSession, threshold: float = 0.7, **options) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold; scored in the pass that filters, without a join."""
    scratch = Scratch(spark, "accepted")
    x = scratch.write(vectors(docs.where(~held_out()).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), "x")
    sent = spark.sparkContext.broadcast(fit(moments(x, labels), **options))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            z = np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES))
            yield batch.filter(pa.array(sent.value.score(z) >= threshold))

    return mapped(docs, run, docs.schema)
