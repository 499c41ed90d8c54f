"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so its size follows the text's, the
union of two sketches is the sketch of both texts, and containment can be estimated between texts of very
unequal length. A short text may have no hash below the fraction: its sketch is empty, as the rule has it.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import saved, table

#: Code points in a shingle; a power of two. A shorter text is one shingle.
SHINGLE = 8
#: A sketch keeps hashes below 1 / FRACTION of the hash space of ``BITS`` bits.
FRACTION, BITS = 16, 32
#: Rows between drawn rows that cut the order of documents into stretches, and the most drawn rows a driver holds.
STRETCH, MOST_BOUNDS = 32, 50_000
#: Draws of one and the same row from which on its copies are counted and not sent, and copies that one task writes.
CROWD, COPIES = 8, 20_000
U, MASK = np.uint64, (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingle_hashes(points: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 32-bit hash of each shingle in order: a polynomial, doubled log2(size) times, then mixed."""
    h = points.astype(U) + U(1)
    if not len(h):
        return h
    base = 0x9E3779B97F4A7C15
    if len(h) < size:
        whole = len(h)
        for x in h.tolist():
            whole = (whole * base + x) & MASK
        h = np.array([whole], U)
    else:
        width = 1
        while width < size:
            h = h[:-width] * U(base) + h[width:]
            base, width = base * base & MASK, width * 2
    return _mixed(h) >> U(64 - BITS)


def kept(hashes: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch: distinct hashes under the threshold, ascending."""
    return np.unique(hashes[hashes < U((1 << BITS) // fraction)])


def sketch(text: str, size: int = SHINGLE, fraction: int = FRACTION) -> np.ndarray:
    return kept(shingle_hashes(code_points(text), size), fraction)


def encode(sketch: np.ndarray) -> str:
    """Base64 of the hashes, four bytes each, ascending."""
    return base64.b64encode(sketch.astype(">u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(U)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return kept(np.concatenate([a, b]), fraction)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the shared part of both texts' shingles; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the part of a's shingles that b has; nothing is within anything."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """``id_col``, ``n_chars`` and ``fingerprint`` per row, in one pass.

    A null text is empty, with fingerprint '', as is that of a text without a hash below the fraction. Repeated rows each give a row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                prints = [encode(sketch(t, size, fraction)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=["id", "n_chars", "fingerprint"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(make, f"id {kind}, n_chars long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


class _Document:
    def __init__(self, key, text: str, size: int, fraction: int):
        self.key, self.text, self.points = key, text, code_points(text)
        self.hashes = shingle_hashes(self.points, size)
        self.sketch = kept(self.hashes, fraction)


def _edited(own: _Document, after: _Document, size: int, fraction: int) -> tuple[str, np.ndarray]:
    """The edited text and its sketch; only shingles over the seam are hashed anew."""
    cut = len(own.text) - len(own.text) // 2
    text = own.text[:cut] + after.text[: len(own.text) // 2]
    taken = len(text) - cut
    if cut < size or taken < size:
        return text, kept(shingle_hashes(code_points(text), size), fraction)
    seam = shingle_hashes(np.concatenate([own.points[cut - size + 1 : cut], after.points[: size - 1]]), size)
    return text, kept(np.concatenate([own.hashes[: cut - size + 1], seam, after.hashes[: taken - size + 1]]), fraction)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, within_edited double, within_next double"
KEY = ["__known", "__id", "__h"]


def edited_fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next document's beginning.

    Documents follow each other by doc_id, an integer; null ids come first, equal ids by their texts' xxhash64, and the first
    document follows the last. A null text is empty. Other columns are not read; an empty table gives no rows.

    Drawn rows cut that order into stretches; each stretch also gets the document that follows it, so one shuffle of the texts
    is enough and no task holds more than its stretches. Cuts are by id and text hash, so that one id with very many texts is
    cut too. Of a row that is repeated very often, the copies are counted before the shuffle: all but one follow themselves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns(
        {"__known": F.col("doc_id").isNotNull().cast("int"), "__id": F.coalesce("doc_id", F.lit(0)), "__h": F.xxhash64("text")}
    )
    total, least = rows.agg(F.count("*"), F.min(F.struct(*KEY))).first()
    step = max(STRETCH, total // MOST_BOUNDS)
    drawn = {tuple(r)[:3]: r["n"] for r in rows.where(F.rand(17) * step < 1).groupBy(*KEY).agg(F.count("*").alias("n")).collect()}
    least = tuple(least or ())  # none in an empty table
    bounds = sorted(k for k in drawn if k > least)
    heads = {k: i for i, k in enumerate(bounds)} | {least: len(bounds)}  # the first of stretch i + 1 ends stretch i
    sent = spark.sparkContext.broadcast((bounds, heads))
    crowd = [k for k, n in drawn.items() if n >= CROWD]
    repeated = None
    if crowd:
        named = F.broadcast(spark.createDataFrame(crowd, "__known int, __id long, __h long"))  # at most MOST_BOUNDS / CROWD rows
        many = saved(rows.join(named, KEY).groupBy(*rows.columns).agg((F.count("*") - 1).alias("__n")), "repeated")
        rows = rows.join(named, KEY, "left_anti").unionByName(many.drop("__n"))
        repeated = _copies(many, size, fraction)

    @F.pandas_udf("stretch int, follows int")
    def place(known: pd.Series, ids: pd.Series, h: pd.Series) -> pd.DataFrame:
        bounds, heads = sent.value
        keys = list(zip(known.tolist(), ids.tolist(), h.tolist()))
        return pd.DataFrame({"stretch": np.array([bisect_right(bounds, k) for k in keys], np.int32), "follows": pd.Series([heads.get(k) for k in keys], dtype="Int32")})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8192 + 1)
    at = F.array(F.struct(F.col("at.stretch").alias("stretch"), F.lit(False).alias("guest")), F.struct(F.col("at.follows").alias("stretch"), F.lit(True).alias("guest")))
    placed = (
        rows.withColumn("at", place(*KEY))
        .select("doc_id", "text", *KEY, F.explode(F.filter(at, lambda x: x["stretch"].isNotNull())).alias("at"))
        .select("at.stretch", "at.guest", "doc_id", "text", *KEY)
        .repartition(tasks, "stretch")
        .sortWithinPartitions("stretch", "guest", *KEY)
        .select("stretch", "guest", "doc_id", "text")
    )

    def make(batches):
        before, ended, out = None, None, []
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for s, guest, key, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if s == ended:
                        continue  # the same guest again
                    own = _Document(key, text, size, fraction)
                    if before is not None:
                        out.append(_pair(before, own, size, fraction))
                    before, ended = (None, s) if guest else (own, None)
                if out:
                    yield _pairs(out)
                    out = []

    pairs = placed.mapInArrow(make, OUT)
    return pairs if repeated is None else pairs.unionByName(repeated)


def _pair(own: _Document, after: _Document, size: int, fraction: int) -> tuple:
    text, edited = _edited(own, after, size, fraction)
    return (own.key, len(own.text), hashlib.sha256(text.encode()).hexdigest(), encode(own.sketch), encode(edited), resemblance(own.sketch, edited), resemblance(own.sketch, after.sketch), containment(own.sketch, edited), containment(own.sketch, after.sketch))


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in OUT.split(", ")])


def _copies(many: DataFrame, size: int, fraction: int) -> DataFrame:
    """The rows of documents that the same document follows, ``__n`` of each; written in parts, so that no task writes all copies."""

    def make(batches):
        for batch in batches:
            for key, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = _Document(key, text, size, fraction)
                row = _pairs([_pair(own, own, size, fraction)])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([n], pa.int64())], names=[*row.schema.names, "__n"])

    once = many.where("__n > 0").select("doc_id", "text", "__n").mapInArrow(make, f"{OUT}, __n long")
    parts = once.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES)))).repartition("doc_id", "fingerprint", "__part")
    left = F.least(F.lit(COPIES), F.col("__n") - F.col("__part") * COPIES).cast("int")
    return parts.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), left))).drop("__n", "__part", "__copy")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
