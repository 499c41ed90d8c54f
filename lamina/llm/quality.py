"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, slices, table

#: Rows that the classifier is fitted on at most; labelled rows are drawn by a hash of their id.
MOST_LABELLED = 40_000
#: Cosines that approximate the Gaussian kernel, its width in standard deviations, and the ridge penalty a row.
COSINES, WIDTH, PENALTY = 384, 3.0, 1e-4
#: Part of the score that keeps the order of documents within one step of the calibration.
ORDER = 0.02
THRESHOLD = 0.3
#: Tasks that sum normal equations; each sends the driver one matrix.
SUMMERS = 8
SYMBOLS = [b"#$%&*@^~_=<>+\\", b"|", b"!", b".", b",;:?", b"\"'()[]{}-/"]


def statistics(text: str) -> np.ndarray:
    """Numbers of one whole text, scaled so that none grows with its length but the first three."""
    raw = text.encode()
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    p = count[count > 0] / max(n, 1)
    symbols = [float(sum(count[c] for c in group)) for group in SYMBOLS]
    upper, lower, digits, other = float(count[65:91].sum()), float(count[97:123].sum()), float(count[48:58].sum()), float(count[128:].sum())
    bare = sum(x.isalpha() for x in seen.elements()) if w else 0
    caps = sum(k for x, k in seen.items() if len(x) > 1 and x.isupper())
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    return np.array(
        [
            np.log1p(n), np.log1p(w), np.log1p(m),
            *[np.sqrt(s / max(n, 1)) for s in symbols],
            *[np.sqrt(s / max(w, 1)) for s in symbols[:3]],
            upper / max(n, 1), upper / max(upper + lower, 1), lower / max(n, 1), np.sqrt(digits / max(n, 1)), np.sqrt(other / max(n, 1)),
            bare / max(w, 1), caps / max(w, 1), len(seen) / max(w, 1), max(seen.values(), default=0) / max(w, 1),
            lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(set(lines)) / max(m, 1), ended / max(m, 1), np.log1p(w / max(m, 1)), np.log1p(w / max(symbols[3], 1)),
            float(-(p * np.log(p)).sum()), count[32] / max(n, 1),
        ]
    )


FEATURES = len(statistics(""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``x``, the statistics of each whole text; a null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        for batch in slices(batches):
            x = [statistics(t or "") for t in batch.column(1).to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(flat.astype(np.float32), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "x"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(make, f"id {kind}, x array<float>")
    return out.withColumnRenamed("id", id_col)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising step function by pooling neighbours, one at the middle of each pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # mean label, weight, sum of scores
    for s, y in zip(score[order], label[order]):
        pools.append([float(y), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (m, w, t), (m0, w0, t0) = pools.pop(), pools.pop()
            pools.append([(m * w + m0 * w0) / (w + w0), w + w0, t + t0])
    return np.array([t / w for _, w, t in pools]), np.array([m for m, _, _ in pools])


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase)), z / 10, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return (1 - ORDER) * level + ORDER / (1 + np.exp(-4 * (raw - 0.5)))

    def of(self, texts: list[str | None]) -> np.ndarray:
        x = [statistics(t or "") for t in texts]
        return self.score(np.stack(x).astype(np.float32).astype(np.float64)) if x else np.zeros(0)


def fit(train: DataFrame, width: float = WIDTH, penalty: float = PENALTY, seed: int = 7) -> Model:
    """Fit on rows of ``x``, ``y`` (0 or 1) and ``calibrates``, of which there are a bounded number.

    Tasks sum moments, then normal equations; the driver adds a few matrices. Rows with ``calibrates`` take no
    part in the ridge fit but in the calibration. Without rows every score is one half.
    """

    def moments(batches):
        total = np.zeros((3, FEATURES))
        for batch in batches:
            x = matrix(batch.column(0))
            total += np.stack([np.full(FEATURES, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
        return sum((np.frombuffer(r[0]).reshape(shape) for r in df.collect()), np.zeros(shape))

    n, first, second = added(train.select("x").mapInArrow(moments, "sums binary"), (3, FEATURES))
    n = max(n[0], 1)
    center = first / n
    scale = np.sqrt(np.maximum(second / n - center**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(center, np.where(scale > 1e-9, scale, 1), rng.normal(size=(FEATURES, COSINES)) / (width * np.sqrt(FEATURES / 10)), rng.uniform(0, 2 * np.pi, COSINES), np.zeros(0), np.zeros(0), np.zeros(0))
    size = COSINES + FEATURES + 1

    def normal(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.cosines(matrix(batch.column(0)))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = added(train.where(~F.col("calibrates")).select("x", "y").mapInArrow(normal, "sums binary"), (size, size + 1))
    model.weight = np.linalg.solve(sums[:, :size] + np.eye(size) * (penalty * n + 1e-6), sums[:, size])

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(batch.column(0)))), batch.column(1)], names=["s", "y"])

    seen = np.array([tuple(r) for r in train.where("calibrates").select("x", "y").mapInArrow(raw, "s double, y double").collect()]).reshape(-1, 2)
    model.knots, model.levels = isotonic(seen[:, 0], seen[:, 1])
    return model


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """The classifier, fitted on rows of ``docs`` whose crc32(id as text) mod 5 isn't 0, of which about ``most`` at most are drawn by a hash of the id.

    Null ids and null labels are skipped; of an id with several labels the greatest counts, and of an id with several texts the
    least text: an id is one row of the fit, so the bound holds whatever is repeated. Without labels every score is near one half.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary"))
    labelled = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("__y")).where(F.col("__y").isNotNull() & (fold % 5 != 0)).groupBy(id_col).agg(F.max("__y").alias("__y"))
    total = labelled.count()
    if total > most:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    # about ``most`` ids at most are sent to the tasks, so the texts stay where they are until one of each id is left
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(labelled), id_col).groupBy(id_col, "__y").agg(F.min("__text").alias("__text"))
    # a quarter of the drawn rows, by another digit of the same checksum, calibrates
    named = texts.select(F.struct(id_col, "__y").alias("__id"), "__text")
    train = features(named, "__id", "__text").select("x", F.col("__id.__y").alias("y"), (F.floor(F.crc32(F.col("__id")[id_col].cast("string").cast("binary")) / 5) % 4 == 0).alias("calibrates"))
    return fit(cut(train.repartition(SUMMERS)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Labels are learnt as :func:`learned` says; a score depends on the whole text alone, is made where the text is, and nothing
    is shuffled. A null text is empty and is scored as such; a null id counts as held out; repeated rows each get a row; an
    empty table gives none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_col, text_col, label_col, most))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.of(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    scored = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return scored.select(id_col, F.coalesce(fold % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, filtered where they are; each row goes or stays by its own text, whatever its id."""
    model, at = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_col, text_col)), docs.columns.index(text_col)

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(model.value.of(batch.column(at).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
