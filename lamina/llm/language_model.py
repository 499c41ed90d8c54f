"""Stupid-backoff scores (Brants et al., 2007) from n-gram counts of the corpus itself.

Relationally: n-grams are exploded, counted by n-gram in tables partitioned by hash, joined to their counts and summed by
document. Rows of these tables are packed: a chunk of documents explodes into its different n-grams, each once, sorted
and cut by hash into buckets, one row for each bucket and length. A bucket's group is the count table of its part of the
hashes; it sums the chunks' counts and answers each chunk, which scores its documents. So a frequent n-gram is one
entry a chunk, and no task gathers its occurrences. There are never more rows than exploded n-grams; with more
chunks and buckets each holds fewer, down to one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import file_system, fresh_dir, read_range, saved, table

#: Words of an n-gram at most, and the backoff factor.
ORDER, ALPHA = 3, 0.4
#: Words of a chunk, and of the corpus for each bucket.
CHUNK_WORDS, BUCKET_WORDS = 2_000_000, 4_000_000
#: Bits that n-grams are told apart by: of 10^13 different ones, one in 7,000 shares its count with another.
BITS = 56
#: Arrays of fewer numbers are packed as they are.
SMALL = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """An integer array, compressed by planes of bytes: the high ones of small numbers are zeros."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return b"\0" + planes if len(values) < SMALL else b"\1" + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = data[1:] if data[:1] == b"\0" else zstandard.ZstdDecompressor().decompress(data[1:])
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def extended(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that are one word longer."""
    h = (left * U(0x9E3779B97F4A7C15) + right) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(31))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


def chunks(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Write chunks of many documents below ``path``; returns where each is, its words ``n`` and its number.

    A chunk has ids, numbers of words, the hashes of the different words, and the words by number. Each task writes a file under
    a new name, and only what tasks that finished have written is in the table.
    """

    def make(batches):
        files, root = file_system(path)
        files.create_dir(root, recursive=True)
        name, offset = f"chunks-{uuid.uuid4().hex}", 0
        ids, sizes, words, known, total = [], [], [], {}, 0

        def row(out):
            nonlocal offset
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), U, len(known))
            spoken = np.concatenate(words)
            order = np.argsort(-np.bincount(spoken, minlength=len(known)), kind="stable")  # frequent words get small numbers
            number = np.empty(len(known), np.int32)
            number[order] = np.arange(len(known), dtype=np.int32)
            own = pa.concat_arrays(ids)
            one = pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *[pa.array([pack(x)], pa.binary()) for x in (np.array(sizes, np.int32), hashes[order], number[spoken])]],
                names=["ids", "sizes", "hashes", "words"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as w:
                w.write_batch(one)
            data = sink.getvalue()
            out.write(data)
            offset += len(data)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, offset - len(data), len(data), total)], names=["file", "offset", "length", "n"])

        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for i, text in enumerate(batch.column(1)):
                    own = (text.as_py() or "").encode().translate(LOWER).split()
                    ids.append(batch.column(0).slice(i, 1))
                    sizes.append(len(own))
                    words.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int32, len(own)))
                    total += len(own)
                    if total >= CHUNK_WORDS:
                        yield row(out)
                        ids, sizes, words, known, total = [], [], [], {}, 0
            if ids:
                yield row(out)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(make, "file string, offset long, length long, n long")
    return saved(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def grams(sizes: np.ndarray, hashes: bytes, words: bytes, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the key of the n-gram that ends at each word, and where one does. n-grams don't cross documents."""
    one = unpack(hashes, U)[unpack(words, np.int32)]
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, now = [], one
    for n in range(1, order + 1):
        if n > 1:
            now = np.concatenate([np.zeros(1, U), extended(now[:-1], one[1:])])[: len(one)]
        out.append((now >> U(64 - BITS), place >= n - 1))
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``id_col``, ``n_words`` and ``log10_score`` for each row, by the counts of all other rows' whole texts.

    A word scores its n-gram's count over its context's, for the longest n-gram (up to ``order`` words) that another row has,
    times ``alpha`` for each word that was left out; both counts leave the row's own text out, or every n-gram
    would have been seen. A single word scores its part of all words, its own text's included, so no score is of zero. Words
    are runs of anything but ASCII white space, with A to Z as a to z. n-grams do not cross documents. A null or
    empty text has no words and a score of 0; repeated rows count and are scored each; an empty table gives no rows. Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = fresh_dir(docs.sparkSession, "words")
    rows = chunks(docs, id_col, text_col, path)
    total, parts = rows.agg(F.sum("n"), F.count("*")).first()
    total, parts = total or 0, max(parts, 1)
    buckets = total // BUCKET_WORDS + 1
    floors = np.array([(i << BITS) // buckets for i in range(buckets)], U)

    def load(files, root, file, offset, length):
        with pa.ipc.open_stream(read_range(files, f"{root}/{file}", offset, length)) as r:
            one = r.read_next_batch()
        sizes = unpack(one["sizes"][0].as_py(), np.int32).astype(np.int64)
        return one["ids"].flatten(), sizes, grams(sizes, one["hashes"][0].as_py(), one["words"][0].as_py(), order)

    def ask(batches):
        files, root = file_system(path)
        for batch in batches:
            for at in batch.to_pylist():
                for n, (h, whole) in enumerate(load(files, root, at["file"], at["offset"], at["length"])[2], 1):
                    distinct, count = np.unique(h[whole], return_counts=True)
                    cuts = np.r_[0, np.searchsorted(distinct, floors[1:]), len(distinct)]
                    full = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int64()), pa.array(np.full(len(full), n), pa.int32()), pa.array([at["chunk"]] * len(full), pa.int64()),
                            pa.array([pack(np.diff(distinct[cuts[b] : cuts[b + 1]], prepend=floors[b])) for b in full], pa.binary()), pa.array([pack(count[cuts[b] : cuts[b + 1]].astype(np.uint32)) for b in full], pa.binary()),
                        ],
                        names=["bucket", "n", "chunk", "hashes", "counts"],
                    )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(h, U), dtype=U) + floors[b] for h, b in zip(pdf["hashes"], pdf["bucket"])]
        counts = np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]).astype(np.float64)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.bincount(at, counts, len(distinct)).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pdf[["chunk", "n", "bucket"]].assign(counts=[pack(found[e - len(k) : e]) for k, e in zip(keys, ends)])

    def score(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        files, root = file_system(path)
        at = next(r for r in rows if r["n"] == 0)
        ids, sizes, own = load(files, root, at["file"], at["offset"], at["length"])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        value, shorter = np.zeros(len(owner)), None
        for n, (h, whole) in enumerate(own, 1):
            mine = sorted((r["bucket"], r["counts"]) for r in rows if r["n"] == n)
            counts = np.concatenate([np.zeros(0, np.int64), *[unpack(c, np.int64) for _, c in mine]])  # in the order of the keys asked for
            place = np.flatnonzero(whole)
            distinct, which = np.unique(h[place], return_inverse=True)
            _, pair, times = np.unique(owner[place] * len(distinct) + which, return_inverse=True, return_counts=True)
            others = np.zeros(len(owner), np.int64)
            others[place] = counts[which] - times[pair]
            if n == 1:
                value[place] = np.log10(counts[which] / max(total, 1))
            else:
                seen = others > 0
                value[whole & ~seen] += np.log10(alpha)
                value[seen] = np.log10(others[seen] / shorter[np.flatnonzero(seen) - 1])
            shorter = others
        return pa.table([ids, pa.array(sizes), pa.array(np.bincount(owner, value, len(sizes)).astype(np.float64))], names=["id", "n_words", "log10_score"])

    place = rows.select("chunk", F.lit(0).alias("n"), "file", "offset", "length")
    asked = place.drop("n").repartition(parts).mapInArrow(ask, "bucket long, n int, chunk long, hashes binary, counts binary")
    answers = asked.groupBy("bucket", "n").applyInPandas(answer, "chunk long, n int, bucket long, counts binary")
    scored = answers.unionByName(place, allowMissingColumns=True).groupBy("chunk").applyInArrow(score, f"id {kind}, n_words long, log10_score double")
    return scored.withColumnRenamed("id", id_col)


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round(F.col("log10_score") / F.when(F.col("n_words") > 0, F.col("n_words")), 6).alias("log10_per_word"))


ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w1, unnest(range(1, len(words) + 1)) AS i FROM t),
b AS (SELECT *, lag(w1) OVER (PARTITION BY r ORDER BY i) || ' ' || w1 AS w2, lag(w1, 2) OVER (PARTITION BY r ORDER BY i) || ' ' || lag(w1) OVER (PARTITION BY r ORDER BY i) || ' ' || w1 AS w3 FROM w),
c AS (SELECT r, i, w2, w3, count(*) OVER (PARTITION BY w1) AS c1, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY r, w1) AS o1,
  count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY r, w2) AS o2, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY r, w3) AS o3 FROM b),
p AS (SELECT *, lag(o1) OVER (PARTITION BY r ORDER BY i) AS p1, lag(o2) OVER (PARTITION BY r ORDER BY i) AS p2 FROM c),
s AS (SELECT r, CASE WHEN i >= 3 AND o3 > 0 THEN log10(o3 / p2) WHEN i >= 2 AND o2 > 0 THEN log10(o2 / p1) + CASE WHEN i >= 3 THEN log10({ALPHA}) ELSE 0 END
  ELSE log10(c1 / (SELECT count(*) FROM w)) + log10({ALPHA}) * least(i - 1, 2) END AS value FROM p)
SELECT any_value(t.doc_id) AS doc_id, CAST(any_value(len(words)) AS BIGINT) AS n_words, round(coalesce(sum(value), 0), 4) AS log10_score,
  round(sum(value) / any_value(len(words)), 6) AS log10_per_word
FROM t LEFT JOIN s ON t.r = s.r GROUP BY t.r
"""
