"""Quality classifier: ordinal cumulative-link regression on graded ratings (op 5).

Grades: 0 low quality, 1 usable but toxic, 2 good.  P(grade <= k) =
sigmoid(threshold_k - w·x) with one weight vector w shared by all grades and
ordered thresholds.  x: presence of hashed lower-cased words, and of a few
shape marks of the text (length, symbols, capitals, repetition, each in
buckets).  Trained on a bounded sample of labelled documents; every document is
scored with its whole text: expected grade, tail probability P(grade = 2), and
``selected`` where the tail is at least ``SELECT``.

Cases: a null or empty text has the shape marks of an empty text and is not
selected; labels without grade or document are left out of training; without
any labels the thresholds alone decide and all grades are equally likely.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6_000  # labelled documents to train on, about
BITS = 18
GRADES = 3
SELECT = 0.7
MIN_DOCS, MIN_Z = 10, 6.0  # a slot counts if so many training documents have it and it tells grades apart
_ALNUM = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SYMBOLS = b"#*$%&|<>"


class _Slots(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = 64 + xxhash.xxh32_intdigest(word) % ((1 << BITS) - 64)
        return h


def features(data: bytes | None, slots: dict) -> set[int]:
    """Slots of a text: 0-63 shape marks, the rest hashed words."""
    data = data or b""
    low = data.lower()
    words = _ALNUM.findall(low)
    out = set(map(slots.__getitem__, words))
    n, size = len(words), max(1, len(data))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    upper = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if data else 0
    bucket = lambda x, scale: min(7, int(x * scale))
    out.add(min(15, n.bit_length()))
    out.add(16 + bucket(symbols / size, 40))
    out.add(24 + bucket(upper / size, 20))
    out.add(32 + bucket(len(out) / max(1, n), 8))
    out.add(40 + bucket(data.count(b"!!") / max(1, n), 8))
    return out


def informative(y, doc, col, size: int):
    """Slots whose frequency differs between the grades above and below some threshold (two-sample z test)."""
    import numpy as np

    seen = np.bincount(col, minlength=size)
    out = np.zeros(size, bool)
    for k in range(GRADES - 1):
        above = y > k
        n1, n0 = max(1, above.sum()), max(1, (~above).sum())
        a = np.bincount(col[above[doc]], minlength=size)
        p = np.clip(seen / y.size, 1e-9, 1 - 1e-9)
        out |= np.abs(a / n1 - (seen - a) / n0) >= MIN_Z * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return out & (seen >= MIN_DOCS)


class OrdinalModel:
    """Weights and ordered thresholds; ``fit`` maximises the penalised cumulative-link likelihood by Adam."""

    def __init__(self, weights, cuts):
        self.weights, self.cuts = weights, cuts

    @classmethod
    def fit(cls, rows: list[tuple[int, list[int]]], steps: int = 400, rate: float = 0.05, ridge: float = 5e-5):
        import numpy as np

        size = 1 << BITS
        if not rows:
            return cls(np.zeros(size, np.float32), [math.log((k + 1) / (GRADES - k - 1)) for k in range(GRADES - 1)])
        y = np.array([g for g, _ in rows])
        doc = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
        col = np.fromiter((c for _, x in rows for c in x), np.int64, doc.size)
        ok = informative(y, doc, col, size)[col]
        doc, col = doc[ok], col[ok]
        used, col = np.unique(col, return_inverse=True)
        # Parameters: weights, first threshold, logarithms of the steps to the next ones (so they stay ordered).
        share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / y.size, 0.01, 0.99)
        start = np.log(share / (1 - share))
        theta = np.r_[np.zeros(used.size), start[0], np.log(np.maximum(np.diff(start), 0.1))]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for t in range(1, steps + 1):
            w, raw = theta[:used.size], theta[used.size:]
            cuts = np.r_[-np.inf, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))], np.inf]
            f = np.bincount(doc, w[col], len(rows))
            hi, lo = sig(cuts[y + 1] - f), sig(cuts[y] - f)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # d log p / d cut
            grad = np.zeros_like(theta)
            grad[:used.size] = np.bincount(col, (dhi - dlo)[doc], used.size) / len(rows) + ridge * w
            dcut = np.array([(dlo[y == k + 1].sum() - dhi[y == k].sum()) / len(rows) for k in range(GRADES - 1)])
            grad[used.size] = dcut.sum()
            for k in range(1, GRADES - 1):
                grad[used.size + k] = dcut[k:].sum() * np.exp(raw[k])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        weights = np.zeros(size, np.float32)
        weights[used] = theta[:used.size]
        raw = theta[used.size:]
        return cls(weights, (raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]).tolist())

    def probabilities(self, slots: set[int]) -> list[float]:
        f = float(self.weights[list(slots)].sum())
        below = [1 / (1 + math.exp(-max(-30.0, min(30.0, c - f)))) for c in self.cuts]
        return [b - a for a, b in zip([0.0, *below], [*below, 1.0])]


def _featurised(docs: DataFrame, extra: str):
    def run(batches):
        import pyarrow as pa

        slots = _Slots()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                got = [sorted(features(x, slots)) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32()))], [extra, "slots"])

    return docs.select(extra, "text").mapInArrow(run, f"{extra} {dict(docs.dtypes)[extra]}, slots array<int>")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade); several labels of a document count by their smallest grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.cast("int").alias("grade"), "quality").where(
        "doc_id is not null and quality is not null and grade is not null").groupBy(
        "doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on about ``sample`` labelled documents, chosen by the hash of their id."""
    grades = graded(labels)
    share = max(1, min(1_000_000, round(1_000_000 * sample / max(1, grades.count()))))
    some = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)  # bounded by the share
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = _featurised(rows.select("grade", "text"), "grade").toArrow()
    pairs = sorted(zip(got.column("grade").to_pylist(), got.column("slots").to_pylist()))
    return OrdinalModel.fit(pairs)


def score(docs: DataFrame, model: OrdinalModel, select: float = SELECT) -> DataFrame:
    """(doc_id, n_slots, expected_grade, p_good, selected) for every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def run(batches):
        import pyarrow as pa

        slots = _Slots()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part, rows = b.slice(s, 256), []
                for x in part.column(1).cast(pa.binary()).to_pylist():
                    got = features(x, slots)
                    p = kept.value.probabilities(got)
                    words = bool(x) and _ALNUM.search(x.lower()) is not None
                    rows.append((len(got), sum(k * q for k, q in enumerate(p)), p[-1], words and p[-1] >= select))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_slots", "expected_grade", "p_good", "selected"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_slots long, expected_grade double, p_good double, selected boolean")


def op5_quality_ordinal(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).drop("n_slots")
