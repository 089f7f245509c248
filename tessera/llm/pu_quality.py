"""Quality scores by positive-unlabelled learning.

Texts become dense features in one pass. Trusted positives and unlabelled texts train a small network by the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), sigmoid loss. The class prior is
estimated from the data: the least ratio, over score thresholds, of the share of unlabelled texts above it to that of held-back
positives. Negative labels are never used, only whether a row is a trusted positive.

Defined results: null and empty texts have all-zero counts and get a score like any other; a row without an id is not held
out and has no label; labels that repeat or contradict: any quality 1 of an id makes it a positive; without positives all
scores are the prior 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Bound of the training sample: this many positives and as many unlabelled rows.
SAMPLE, FOLDS, THRESHOLD = 20_000, 5, 0.3
HIDDEN, STEPS, EPOCHS, BATCH, RATE, SEED = 12, 3000, 400, 512, 0.01, 3
_NAMES = ("log_bytes", "log_words", "word_len", "symbols", "pipes", "bangs", "upper", "digits", "stops", "foreign", "lines", "dup_lines", "distinct", "top_word", "squeeze", "short_words", "long_words", "line_len")
_COUNTED = {"symbols": b"#*$%&<>", "pipes": b"|", "bangs": b"!", "upper": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".,;:?", "foreign": bytes(range(128, 256))}


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    share = [(len(raw) - len(raw.translate(None, c))) / n for c in _COUNTED.values()]
    lengths = list(map(len, words))
    squeezed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, len(raw), 65536)) / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(lengths) / w, *share,
        len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), len(counts) / w**0.8, max(counts.values(), default=0) / w, squeezed,
        sum(x <= 2 for x in lengths) / w, sum(x > 15 for x in lengths) / w, np.log1p(len(raw) / max(1, len(lines))),
    ]


class Scorer:
    """One hidden layer on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: list[np.ndarray]) -> None:
        self.mean, self.scale, self.params = mean, scale, params

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.params
        h = np.tanh(z @ a + b)
        return h, h @ c + d

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(np.clip((x - self.mean) / self.scale, -6, 6))[1]

    def _gradients(self, p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
        """Of the risk of a batch (standardised positives p, unlabelled u) by parameter. With a prior: where the part that stands
        for negatives has fallen below 0, its gradient is reversed."""
        sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        z = np.concatenate([p, u])
        h, s = self._forward(z)
        sp, su = s[: len(p)], s[len(p) :]
        if prior is None:
            g = np.concatenate([-sig(-sp) / len(sp), sig(su) / len(su)])
        else:
            slope_p, slope_u = sig(sp) * sig(-sp), sig(su) * sig(-su)
            g_plus = np.concatenate([-prior * slope_p / len(sp), np.zeros(len(su))])
            g_minus = np.concatenate([-prior * slope_p / len(sp), slope_u / len(su)])
            g = -g_minus if sig(su).mean() < prior * sig(sp).mean() else g_plus + g_minus
        dh = np.outer(g, self.params[2]) * (1 - h**2)
        return [z.T @ dh + 1e-3 * self.params[0], dh.sum(axis=0), h.T @ g + 1e-3 * self.params[2], g.sum()]

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None) -> Scorer:
        """By the non-negative risk; without a prior, a plain logistic fit of positives against unlabelled."""
        rng, m, v, step = np.random.default_rng(SEED), [0.0] * 4, [0.0] * 4, 0
        p, u = (np.clip((x - self.mean) / self.scale, -6, 6) for x in (pos, unl))
        for _ in range(min(EPOCHS, -(-STEPS * BATCH // max(BATCH, len(u))))):
            order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
            for i in range(0, len(u), BATCH):
                up, uu = order_p[np.arange(i, i + min(BATCH, len(u) - i)) % len(p)], order_u[i : i + BATCH]
                grads = self._gradients(p[up], u[uu], prior)
                step += 1
                for k, q in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                    self.params[k] = self.params[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _fresh(x: np.ndarray) -> Scorer:
    rng = np.random.default_rng(SEED)
    return Scorer(x.mean(axis=0), x.std(axis=0) + 1e-6, [rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.float64(0)])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Estimated share of positives among the unlabelled. A scorer of positives against unlabelled is fitted on one half; on
    the other half unlabelled texts rank above a threshold at least prior times as often as positives do."""
    half_p, half_u = len(pos) // 2, len(unl) // 2
    if half_p < 20 or half_u < 20:
        return 0.5
    rng = np.random.default_rng(SEED)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    s = _fresh(np.concatenate([pos[:half_p], unl[:half_u]])).fit(pos[:half_p], unl[:half_u], None)
    sp, su = np.sort(s.logit(pos[half_p:])), np.sort(s.logit(unl[half_u:]))
    at = np.quantile(sp, np.linspace(0.02, 0.5, 25))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.95))


def train(pos: np.ndarray, unl: np.ndarray) -> tuple[Scorer | None, float]:
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = class_prior(pos, unl)
    return _fresh(np.concatenate([pos, unl])).fit(pos, unl, prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = pa.array([np.array(features(t.as_py()), np.float32) for t in x.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([x.column(0), found], ["doc_id", "x"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = durable(base.mapInArrow(extract, "doc_id long, x array<float>"), "pu-features").withColumn("held_out", F.coalesce(rest == 0, F.lit(False)))
    trusted = labels.select(F.col("doc_id").cast("long").alias("_l"), "quality").where("quality = 1").select("_l").distinct()
    learn = feats.where("not held_out and doc_id is not null")
    order = F.xxhash64("doc_id", F.lit(SEED))

    def bounded(df: DataFrame) -> np.ndarray:
        """At most sample rows, those of least hash: first the ones below a bound that lets about twice as many pass, so that
        what the partitions send does not grow with their number."""
        n = df.count()
        near = df if n <= 2 * sample else df.where(order < F.lit(int((2.0 * (2 * sample / n) - 1) * 2**63)))
        rows = near.orderBy(order).limit(sample).select("x").collect()
        if len(rows) < min(n, sample):  # ids that repeat very often
            rows = df.orderBy(order).limit(sample).select("x").collect()
        return np.array([r.x for r in rows], np.float64).reshape(len(rows), len(_NAMES))

    pos = bounded(learn.join(trusted, F.col("doc_id") == F.col("_l"), "left_semi"))
    model, prior = train(pos, bounded(learn))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).flatten().to_numpy().astype(np.float64).reshape(len(b), len(_NAMES))
            s = np.full(len(b), prior) if model is None else 1 / (1 + np.exp(-np.clip(model.logit(raw), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", "held_out", "x").mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_pu_quality": op7_pu_quality}
SQL: dict[str, str] = {}
