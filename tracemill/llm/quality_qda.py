"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts writes a short feature vector for each document. Class moments (counts, sums
and cross products) are summed by Spark over all training rows, so only 2 * (1 + d + d * d) numbers reach the
driver. Each class covariance is shrunk towards the pooled one and towards a multiple of the
identity; its Cholesky factor is inverted once and shipped, and a score is the logistic of the
difference of the Mahalanobis log-densities and of the log-priors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import SYMBOLS, duplicate_lines, repeated_words
from .shared import held_out_py, slices, stage

FEATURES = ["words", "word_chars", "upper", "digits", "stops", "symbols", "shouts", "other_marks", "words_a_line", "dup_lines", "repeats", "distinct", "entropy", "bare_words", "long_words", "longest_run"]
TO_POOLED, TO_IDENTITY = 0.1, 0.02
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    """The transformed statistics of a whole text (null: empty), each finite."""
    import numpy as np

    text = text or ""
    words = text.encode().split()
    n, m = max(len(words), 1), max(len(text), 1)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ascii_count = np.bincount(c[c < 128], minlength=128)
    upper, lower = int(ascii_count[65:91].sum()), int(ascii_count[97:123].sum())
    upper += sum(map(str.isupper, text)) - upper if not text.isascii() else 0
    marks = ascii_count[33:127].sum() - ascii_count[65:91].sum() - ascii_count[97:123].sum() - ascii_count[48:58].sum()
    stops, shouts, symbols = ascii_count[[44, 46]].sum(), ascii_count[[33, 63]].sum(), ascii_count[[ord(x) for x in SYMBOLS]].sum()
    count = np.unique(c, return_counts=True)[1] if len(c) else np.array([1])
    ids: dict = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    edges = np.flatnonzero(np.diff(c)) if len(c) else np.empty(0, int)
    run = int(np.diff(np.concatenate([[-1], edges, [len(c) - 1]])).max()) if len(c) else 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    bare = sum(not any(b > 127 or 65 <= b | 32 and 97 <= b | 32 <= 122 for b in w[:12]) for w in ids)
    lines = text.count("\n") + 1
    root = math.sqrt
    return [
        math.log1p(len(words)), math.log1p(float(size.mean()) if len(words) else 0.0), root(upper / max(upper + lower, 1)), root(ascii_count[48:58].sum() / m), root(stops / m), root(symbols / m), root(shouts / m), root(max(marks - stops - shouts - symbols, 0) / m),
        math.log1p(len(words) / lines), root(duplicate_lines(text) / lines), root(repeated_words(row) / n), math.log1p(len(ids)) / math.log1p(n), math.log2(m) - float((count * np.log2(count)).sum()) / m, root(bare / max(len(ids), 1)), root(float((size > 20).sum()) / n), math.log1p(run),
    ]


def _featured(batches):
    import pyarrow as pa

    for batch in slices(batches):
        keys = [i for i, f in enumerate(batch.schema) if f.name != "text"]
        ids = batch.column("id").to_pylist()
        rows = [features(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keys), pa.array([held_out_py(x) for x in ids]), pa.array(rows, pa.list_(pa.float64()))],
            schema=pa.schema([*(batch.schema.field(i) for i in keys), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))]),
        )


def _moments(batches):
    import numpy as np
    import pyarrow as pa

    total: dict = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = np.array(batch.column("x").to_pylist())
        x = np.hstack([np.ones((len(x), 1)), x])
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for label in np.unique(y):
            own = x[y == label]
            total[int(label)] = total.get(int(label), 0) + own.T @ own
    for label, m in total.items():
        flat = m.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["label", "at", "value"])


class Discriminant:
    """Two Gaussians with shrunk covariances, from augmented moment matrices (rows of 1, x)."""

    def __init__(self, moments: dict, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        import numpy as np

        self.parts, self.constant = None, 0.5
        counts = {k: m[0, 0] for k, m in moments.items()}
        total = sum(counts.values())
        if total:
            self.constant = (counts.get(1, 0) + 1) / (total + 2)
        if min(counts.get(0, 0), counts.get(1, 0)) < 2:
            return  # one class only: its share stands for every score
        d = len(moments[0]) - 1
        mean = {k: m[0, 1:] / counts[k] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / counts[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(counts[k] * cov[k] for k in cov) / total
        centre = sum(counts[k] * mean[k] for k in mean) / total
        spread = pooled + sum(counts[k] * np.outer(mean[k] - centre, mean[k] - centre) for k in mean) / total
        self.scale = 1 / np.sqrt(np.maximum(np.diag(spread), 1e-12))
        self.parts = {}
        for k in (0, 1):
            s = ((1 - to_pooled) * cov[k] + to_pooled * pooled) * np.outer(self.scale, self.scale)
            s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(s)
            self.parts[k] = (mean[k] * self.scale, np.linalg.inv(low).T, -np.log(np.diag(low)).sum() + math.log(counts[k] / total))

    def score(self, x):
        import numpy as np

        if self.parts is None:
            return np.full(len(x), self.constant)
        logs = []
        for k in (0, 1):
            mean, inverse, constant = self.parts[k]
            z = (x * self.scale - mean) @ inverse
            logs.append(constant - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _scored(model, threshold):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            score = model.score(np.array(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row; score is the probability of label 1.

    Learns from label rows that are 0 or 1 and whose crc32(id as text) mod 5 is not 0 (null ids are held
    out); null labels are skipped and repeated label rows count each. Null texts are empty texts. If
    a class has fewer than two rows, every score is the smoothed share of label 1 (0.5 without labels).
    Other columns of either table are not read.
    """
    import numpy as np

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    x = stage(rows.mapInArrow(_featured, f"id {kind}, held_out boolean, x array<double>"), "quality")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull()).select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sums = x.where(~F.col("held_out")).join(known, "id").select("label", "x").mapInArrow(_moments, "label int, at int, value double")
    size = 1 + len(FEATURES)
    moments: dict = {}
    for r in sums.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        moments.setdefault(r.label, np.zeros(size * size))[r["at"]] = r.value
    model = Discriminant({k: m.reshape(size, size) for k, m in moments.items()})
    return x.mapInArrow(_scored(model, threshold), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
