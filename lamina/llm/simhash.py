"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within distance t of each other agree within t_i on some part i, for any split of their bits into
parts and any thresholds with sum(t_i + 1) = t + 1 (a threshold of -1 leaves a part out). Bits that go together
in the data share a part, and each fingerprint gets the thresholds that dynamic programming finds cheapest for
the candidates estimated for it, so crowded parts are left to a fingerprint's other parts.

Near-duplicates by a similarity differ in too many bits for that guarantee. Their fingerprints are longer and have as many
parts, each with a threshold of one bit in a block, as make it next to certain that one is within it; the sets are compared then.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log, log1p, log2
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import minhash
from lamina.llm.common import cut, saved, slices, split_by, table
from lamina.llm.graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Fingerprints from which on a key is a crowd, whose probes are counted before they are joined.
CROWD = 256
#: Shingles of one side of a block of sets, and rounds in which larger groups are first held against single sets.
TOKENS, ROUNDS = 1_000_000, 2
#: Blocks of a part and their bits, of which one may differ, and fingerprints that share a part's other bits, on average and at most.
BLOCKS, FREE, GROUP = 4, 15, 1 << 15
#: Words of two fingerprints that are compared, and bits of them that may differ. Sets of few shingles need that many: ties
#: clear their bits, so those that share nothing agree in up to 0.57 of them.
COMPARED, APART = 6, 115
#: How often a bit differs between sets of a similarity of 0.8: at most this, and this where none has over ``SHORT`` shingles.
DIFFER, DIFFER_SHORT, SHORT = 0.1612, 0.1875, 5
#: The probability that a pair at exactly that similarity is near in none of its parts.
MISSED = 7e-8
#: Pairs of rows that are compared at once.
PAIRS = 1 << 20


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, lower-cased A to Z and joined by a space, repeats included."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, U)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(line, 42)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return np.fromiter((hashed(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), U, len(words) - size + 1)


def more_bits(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` words of bits for each hash: the hash itself, then mixes of it."""
    out = [h]
    for i in range(1, lanes):
        x = (h + U(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        out.append(x ^ (x >> U(31)))
    return np.stack(out, 1)


def majority(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The 64-bit words of a fingerprint: a bit is set if over half of the hashes have it."""
    votes = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(more_bits(h[at : at + CHUNK], lanes).astype(">u8").view(np.uint8).reshape(-1, 8 * lanes), axis=1)
        votes += bits.sum(0, dtype=np.int32)
    return np.packbits(votes * 2 > len(h)).view(">u8").astype(U)


def fingerprint(text: str, size: int, lanes: int = 1) -> tuple[np.ndarray, int]:
    """The fingerprint's 64-bit words, and the number of shingles."""
    h = shingle_hashes(text, size)
    return majority(h, lanes), len(h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, lanes: int = 1) -> DataFrame:
    """``id_col``, ``fp`` (long, or binary of 8 bytes a lane for more lanes) and ``n`` shingles for each row.

    A null text is empty; a text without words has a fingerprint of zeros, one of fewer words than ``size`` a
    single shingle. Texts are read whole, in chunks of shingles.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        for batch in slices(batches):
            found = [fingerprint(t or "", size, lanes) for t in batch.column(1).to_pylist()]
            if lanes == 1:
                prints = pa.array(np.array([f[0] for f, _ in found], U).view(np.int64) if found else [], pa.int64())
            else:
                prints = pa.array([f.astype(">u8").tobytes() for f, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array([n for _, n in found], pa.int64())], names=["id", "fp", "n"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(
        make, f"id {kind}, fp {'long' if lanes == 1 else 'binary'}, n long"
    )
    return out.withColumnRenamed("id", id_col)


def bits_of(words: np.ndarray) -> np.ndarray:
    """Rows of 64 bits; column 0 is the highest."""
    return np.unpackbits(np.ascontiguousarray(words, U).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def together(fps: DataFrame) -> np.ndarray:
    """Correlations of the 64 bits over all rows of ``fp``: tasks add up counts, and 2,081 sums reach the driver."""

    def count(batches):
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(U)).astype(np.float32)
            for at in range(0, len(bits), CHUNK):
                total += (part := bits[at : at + CHUNK]).T @ part
            n += len(bits)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, 64], pa.int32()), pa.array(np.r_[j, 64], pa.int32()), pa.array(np.r_[total[i, j], n].astype(np.int64))], names=["i", "j", "n"])

    sums = np.zeros((65, 65))
    for i, j, n in fps.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        sums[i, j] = sums[j, i] = n
    n = max(sums[64, 64], 1)
    p = sums.diagonal()[:64] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return (sums[:64, :64] / n - np.outer(p, p)) / np.outer(spread, spread)


def parts_of(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size; each takes the free bit that goes best with those it has."""
    strength = np.abs(correlation) - np.eye(64)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        own = [max(free, key=lambda b: (strength[b, sorted(free)].max(), -b))]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (strength[b, own].sum(), -b)))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def keys_of(words: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, packed into an integer."""
    key = np.zeros(len(words), np.int64)
    for b in bits:
        key = (key << 1) | ((words >> U(63 - b)) & U(1)).astype(np.int64)
    return key


def masks(width: int, radius: int) -> np.ndarray:
    """All patterns of up to ``radius`` of ``width`` bits, lighter ones first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def allocate(cost: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds plus one for each row and part with the least cost, and that cost, where they add up to ``total``.

    ``cost``: rows x parts x (threshold + 1); the first is of a part that is left out.
    """
    rows, parts, levels = cost.shape
    best = np.full((parts + 1, rows, total + 1), np.inf)
    best[0, :, 0] = 0
    took = np.zeros((parts, rows, total + 1), np.int8)
    for i in range(parts):
        for level in range(min(levels, total + 1)):
            now = best[i, :, : total + 1 - level] + cost[:, i, level, None]
            better = now < best[i + 1, :, level:]
            best[i + 1, :, level:][better] = now[better]
            took[i, :, level:][better] = level
    out, left = np.zeros((rows, parts), np.int8), np.full(rows, total)
    for i in reversed(range(parts)):
        out[:, i] = took[i, np.arange(rows), left]
        left = left - out[:, i]
    return out, best[parts, :, total]


def plan_parts(rows: int, near: int) -> int:
    """The number of parts with the fewest probes and expected candidates for evenly spread fingerprints."""

    def cost(parts: int) -> float:
        widths = [64 * (k + 1) // parts - 64 * k // parts for k in range(parts)]
        one = np.array([[[0.0] + [sum(comb(w, s) for s in range(r + 1)) * (1 + rows / 2.0**w) for r in range(near + 1)] for w in widths]])
        return float(allocate(one, near + 1)[1][0])

    return min(range(2, near + 3), key=cost)


def links(fps: DataFrame, near: int = 2) -> DataFrame:
    """All pairs ``a``, ``b`` of distinct fingerprints (``fp``, each once) that differ in 1 to ``near`` bits.

    Small ``near`` only: probes are rows. An index has each fingerprint's key in each part. A fingerprint's
    candidates in a part are estimated from the key's count in the whole table, thresholds are allocated to it,
    and it is joined by all keys within them. Where even the cheapest thresholds would meet more candidates
    than the whole ball of ``near`` flipped bits has patterns, it probes that ball instead. So does a fingerprint whose estimate
    was wrong, as it lies beside a crowd and not in it: what probes of crowded keys would meet is summed before they are
    joined. So each costs a bounded number of rows, whatever groups of similar fingerprints there are.
    """
    rows = fps.count()
    parts = parts_of(together(fps), plan_parts(rows, near))
    widths = [len(p) for p in parts]
    ball = [[sum(comb(w, s) for s in range(r + 1)) for r in range(near + 1)] for w in widths]
    flips = {(w, r): masks(w, r) for w in set(widths) for r in range(near + 1)}
    whole = [sum(1 << b for b in c) for r in range(1, near + 1) for c in combinations(range(64), r)]
    whole = np.array(whole, object).astype(U).view(np.int64)

    def index(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            words = own.view(U)
            keys = [keys_of(words, p) for p in parts] + [own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(keys)), len(own)), pa.int32()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.tile(own, len(keys)), pa.int64())], names=["part", "key", "fp"]
            )

    table = cut(fps.select("fp").mapInArrow(index, "part int, key long, fp long"))
    crowd = table.where(F.col("part") < len(parts)).groupBy("part", "key").agg(F.count("*").alias("n"))
    seen = (
        table.where(F.col("part") < len(parts)).join(crowd, ["part", "key"]).groupBy("fp")
        .agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(len(parts))])
    )

    def probe(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            counts = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(parts))]
            # a key's neighbours: those of a crowd fall off like 1/s!, the others are spread evenly
            cost = np.stack(
                [np.stack([np.zeros(len(own))] + [ball[i][r] * (1 + rows / 2.0**w) + counts[i] * sum(1 / np.prod(np.arange(1, s + 1)) for s in range(r + 1)) for r in range(near + 1)], 1) for i, w in enumerate(widths)], 1
            )
            level, least = allocate(cost, near + 1)
            all_bits = least > 2 * len(whole)
            words = own.view(U)
            for at in range(0, len(own), 256):
                crowded = own[at : at + 256][all_bits[at : at + 256]]
                if len(crowded):
                    key = (crowded[:, None] ^ whole[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), len(parts)), pa.int32()), pa.array(key), pa.array(np.repeat(crowded, len(whole)))], names=["part", "key", "a"])
            for i, w in enumerate(widths):
                key = keys_of(words, parts[i])
                for r in range(near + 1):
                    goes = np.flatnonzero((level[:, i] == r + 1) & ~all_bits)
                    f = flips[w, r]
                    for at in range(0, len(goes), max(1, (1 << 18) // len(f))):
                        some = goes[at : at + max(1, (1 << 18) // len(f))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some) * len(f), i), pa.int32()), pa.array((key[some][:, None] ^ f[None, :]).ravel()), pa.array(np.repeat(own[some], len(f)))], names=["part", "key", "a"]
                        )

    def ball_of(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                key = (some[:, None] ^ whole[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), len(parts)), pa.int32()), pa.array(key), pa.array(np.repeat(some, len(whole)))], names=["part", "key", "a"])

    probes = cut(seen.mapInArrow(probe, "part int, key long, a long"))
    meets = probes.join(crowd.where(F.col("n") > CROWD), ["part", "key"]).groupBy("a").agg(F.sum("n").alias("n"))
    over = cut(meets.where(F.col("n") > 2 * len(whole)).select("a"))
    probes = probes.join(over, "a", "left_anti").select("part", "key", "a").unionByName(over.mapInArrow(ball_of, "part int, key long, a long"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = probes.join(table.withColumnRenamed("fp", "b"), ["part", "key"]).where((F.col("a") != F.col("b")) & (apart <= near))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def label(prints: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Add ``component_id``, the least id of the component, to rows of ``id_col`` and ``fp``; equal prints are one node."""
    nodes = components(edges)
    fps = prints.groupBy("fp").agg(F.min(id_col).alias("__first"))
    rooted = fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").drop("root"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, near: int = 2) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` for each row; fingerprints link at ``near`` or fewer bits.

    Null and empty texts share the zero fingerprint and link like any other. component_id is the least id that
    can be reached; null ids are skipped unless a component has no other. Repeated rows share a component.
    """
    prints = cut(fingerprints(docs, id_col, text_col, size).drop("n"))
    return label(prints, links(prints.select("fp").distinct(), near), id_col)


def place_of(id_col: str, text_col: str) -> Column:
    """A 64-bit hash of a row's id and text: where its text is found again."""
    return F.xxhash64(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


class Parts(NamedTuple):
    """How long fingerprints are cut: a part has ``fixed`` bits that must agree, and blocks of ``FREE`` of one of which one bit may differ."""

    fixed: int
    long: int
    short: int

    def lanes(self, parts: int) -> int:
        return max(COMPARED, -(-parts * (self.fixed + BLOCKS * FREE) // 64))

    def cut(self, prints: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """For rows of words and their parts: the part's number with its fixed bits, and its blocks in one integer."""
        width = self.fixed + BLOCKS * FREE
        bits = bits_of(prints).reshape(len(prints), -1)[:, : parts * width].reshape(len(prints), parts, width)
        fixed, free = (bits[..., some] @ (1 << np.arange(n, dtype=np.int64)[::-1]) for some, n in ((slice(self.fixed), self.fixed), (slice(self.fixed, width), BLOCKS * FREE)))
        return np.arange(parts) << self.fixed | fixed, free


def blocks_of(free: np.ndarray) -> list[np.ndarray]:
    return [free >> FREE * i & (1 << FREE) - 1 for i in range(BLOCKS)]


def plan_similar(rows: int) -> Parts:
    """The parts for a table of ``rows``: the more rows, the more fixed bits, so that a group stays of ``GROUP``, and the more parts."""
    fixed = ceil(log2(max(1, rows / GROUP)))

    def parts(differ: float) -> int:
        same = 1 - differ
        block = same**FREE + FREE * differ * same ** (FREE - 1)
        return ceil(log(MISSED) / log1p(-(same**fixed) * (1 - (1 - block) ** BLOCKS)))

    return Parts(fixed, parts(DIFFER), parts(DIFFER_SHORT))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id_col``, ``fp`` (a 64-bit hash of the set of shingles), ``n`` different shingles, the set's long fingerprint ``bits`` and the text's ``place`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    plan = plan_similar(docs.count())

    def bits(s: np.ndarray) -> bytes:
        # sets of up to three shingles are only similar if they are equal
        return majority(s, plan.lanes(plan.short if len(s) <= SHORT else plan.long)).astype(">u8").tobytes() if len(s) > 3 else b""

    def make(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or "", size)) for t in batch.column(1).to_pylist()]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array([bits(s) for s in sets], pa.binary()), batch.column(2)], names=["id", "fp", "n", "bits", "place"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), place_of(id_col, text_col).alias("place")).mapInArrow(make, f"id {kind}, fp long, n long, bits binary, place long")
    return saved(out, "sets").withColumnRenamed("id", id_col)


def spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ranges, one range after the other, and the number of each place's range."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def pieces(count: np.ndarray):
    """Slices of ranges with ``PAIRS`` places together, or of a single range."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        yield slice(at, to)
        at = to


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        a, b = (x[root[a] != root[b]] for x in (a, b))
    return root


def joined_prints(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row for each row, the same one for rows that pairs join whose keys differ in at most one bit and ``words`` in at most ``APART``.

    Every such pair is compared, except where the rows are joined already. Each row is first held against the first one of its
    key and of each key beside it, so that a crowd of near copies is one group after a comparison each.
    """
    order = np.argsort(key, kind="stable")
    key, words = key[order], words[order]
    keys, start = np.unique(key, return_index=True)
    masks_ = [0, *(1 << b for b in range(FREE))]

    def near(a, b):
        ok = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) <= APART
        return a[ok], b[ok]

    def beside(keys_, mask):
        """Places of keys that differ by ``mask``, each pair once."""
        other = keys_ ^ mask
        at = np.minimum(np.searchsorted(keys_, other), len(keys_) - 1)
        here = np.flatnonzero((keys_[at] == other) & (keys_ <= other))
        return here, at[here]

    count = np.diff(np.r_[start, len(key)])
    edges = []
    for mask in masks_:
        p, q = beside(keys, mask)
        owner, row = spans(start[q], count[q])
        edges.append(near(start[p][owner], row))
    root = roots(len(key), *map(np.concatenate, zip(*edges)))

    # rows of a key that are joined already are one bunch; only bunches that aren't joined are compared, row by row
    again = np.lexsort((root, key))
    bunch = np.flatnonzero(np.r_[True, (np.diff(key[again]) != 0) | (np.diff(root[again]) != 0)])
    size, own = np.diff(np.r_[bunch, len(key)]), root[again][bunch]
    first = np.searchsorted(key[again][bunch], keys)
    many = np.diff(np.r_[first, len(bunch)])
    for mask in masks_:
        p, q = beside(keys, mask)
        owner, s = spans(first[p], many[p])
        meets = many[q[owner]]
        for piece in pieces(meets):
            at, t = spans(first[q[owner[piece]]], meets[piece])
            u = s[piece][at]
            differ = (own[u] != own[t]) & ((mask > 0) | (u < t))
            u, t = u[differ], t[differ]
            of, row = spans(bunch[u], size[u])
            for some in pieces(size[t[of]]):
                at, other = spans(bunch[t[of[some]]], size[t[of[some]]])
                edges.append(near(again[row[some][at]], again[other]))
    out = np.empty(len(key), np.int64)
    out[order] = order[roots(len(key), *map(np.concatenate, zip(*edges)))]
    return out


def candidates(sets: DataFrame) -> DataFrame:
    """``fp`` and ``band``, once each, for sets that may be similar by their long fingerprints: similar ones share a band, or the sets between them do.

    A group has the rows that share a part's fixed bits. In it, rows that differ in at most one bit of some block are candidates if
    the first words of their fingerprints are within ``APART`` bits; the least ``fp`` that these pairs reach is the band.
    """
    plan = plan_similar(sets.count())
    names = [f"w{i}" for i in range(COMPARED)]

    def deal(batches):
        for batch in slices(batches, 256):
            n, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for parts, some in ((plan.short, np.flatnonzero(n <= SHORT)), (plan.long, np.flatnonzero(n > SHORT))):
                if not len(some):
                    continue
                prints = np.frombuffer(b"".join(batch.column(2).take(pa.array(some)).to_pylist()), ">u8").astype(U).reshape(len(some), -1)
                part, free = plan.cut(prints, parts)
                columns = [part.ravel(), free.ravel(), np.repeat(fp[some], parts), *(np.repeat(prints[:, i].view(np.int64), parts) for i in range(COMPARED))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "free", "fp", *names])

    def join(rows: pa.Table) -> pa.Table:
        fp = rows["fp"].to_numpy()
        words = np.stack([rows[n].to_numpy().view(U) for n in names], 1)
        joins = [joined_prints(key, words) for key in blocks_of(rows["free"].to_numpy())]
        root = roots(len(fp), np.tile(np.arange(len(fp)), BLOCKS), np.concatenate(joins))
        least = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(least, root, fp)
        kept = np.bincount(root, minlength=len(fp))[root] > 1
        return pa.table({"fp": fp[kept], "band": least[root][kept]})

    distinct = sets.where("n > 3").groupBy("fp").agg(F.max("n").alias("n"), F.first("bits").alias("bits")).select("n", "fp", "bits")
    dealt = distinct.mapInArrow(deal, ", ".join(f"{c} long" for c in ("part", "free", "fp", *names)))
    return dealt.groupBy("part").applyInArrow(join, "fp long, band long").distinct()


def stars(keyed: DataFrame) -> DataFrame:
    """``fp`` and ``least`` for each ``fp`` that shares a band with a lower one: edges to the least of each band."""
    return keyed.join(keyed.groupBy("band").agg(F.min("fp").alias("least")), "band").where("fp != least").select("fp", "least").distinct()


def verified_links(sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, tokens: int = TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """Links ``a``, ``b`` that join exactly what all pairs of sets that share a band join at a similarity of 0.8.

    Bands only say which sets may meet; each pair is checked on the two sets, made again from the texts of one row a set, and
    only links that pass are returned. Components of sets that share bands are the tasks, and small ones share a task. In a
    component of over ``tokens`` shingles each set is first held against the least of each of its bands, which is linear; bands
    whose sets those links join need no more, and the others go on without their least set. What is still that large after
    ``rounds`` of it, so many sets that share bands and aren't similar, is dealt into blocks of which a task holds two.
    """
    keyed = cut(candidates(sets))
    own = cut(sets.groupBy("fp").agg(F.min("place").alias("place"), F.max("n").alias("n")).join(keyed.select("fp").distinct(), "fp"))
    rows = docs.select(place_of(id_col, text_col).alias("place"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows that are equal in id and text are one before they are shuffled
    texts = split_by(rows, F.col("place"), own.select("place"))[0].groupBy("place").agg(F.min("text").alias("text")).join(own.select("place", "fp"), "place").select("fp", "text")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in pdf.groupby("root"):
            found += minhash.verified(part["fp"].tolist(), [np.unique(shingle_hashes(t, size)) for t in part["text"]])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def check_star(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for least, part in pdf.groupby("least"):
            centre = np.unique(shingle_hashes(part["text"][part["fp"] == least].iloc[0], size))
            others = part[part["fp"] != least]
            found += [(least, fp) for fp, t in zip(others["fp"], others["text"]) if minhash.similar(centre, np.unique(shingle_hashes(t, size)))]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    out = None
    for left in reversed(range(rounds + 1)):
        nodes = cut(own.join(components(stars(keyed)).withColumnRenamed("node", "fp"), "fp"))
        blocks = nodes.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(tokens)).cast("int").alias("blocks"))
        total, most = nodes.join(blocks, "root").agg(F.sum("n"), F.max("blocks")).first()
        most, tasks = most or 0, (total or 0) // tokens + 1
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        alone = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("q")))
        others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != mine), lambda x: F.struct(F.col("root").alias("task"), F.least(mine, x).alias("i"), F.greatest(mine, x).alias("q")))
        placed = nodes.join(blocks, "root").select("fp", "root", "blocks", F.when(F.col("blocks") < 2, alone).otherwise(others).alias("places"))
        placed = placed if not left else placed.where("blocks < 2")
        dealt = placed.join(texts, "fp").select("fp", "root", "text", F.explode("places").alias("at")).select("at.*", "root", "fp", "text")
        found = dealt.groupBy("task", "i", "q").applyInPandas(check, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if most < 2 or not left:
            return out
        keyed = cut(keyed.join(nodes.join(blocks.where("blocks > 1"), "root").select("fp"), "fp"))
        edges = stars(keyed).join(own.select("fp", "n"), "fp")
        parts = edges.groupBy("least").agg(F.ceil(F.sum("n") / F.lit(tokens)).cast("int").alias("parts"))
        ends = edges.join(parts, "least").select("least", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
        ends = ends.unionByName(parts.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("least").alias("fp")))
        # a part's centre is always there; a part without others costs one set
        linked = cut(ends.join(texts, "fp").groupBy("least", "part").applyInPandas(check_star, "a long, b long"))
        out = out.unionByName(linked)
        rest = keyed.join(keyed.groupBy("band").agg(F.min("fp").alias("least")), "band").where("fp != least").join(components(linked).withColumnsRenamed({"node": "fp"}), "fp", "left")
        rest = rest.withColumn("root", F.coalesce("root", "fp"))
        apart = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
        keyed = cut(rest.join(apart, "band").select("fp", "band"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """``id_col`` and ``component_id``, the least id of its group, for shingles of ``size`` words and a similarity of 0.8.

    Similarity is Jaccard's, of sets: shingles that a text repeats count once. Groups are the components of links
    that were each checked on the sets; texts of equal sets are one node, told apart by 64-bit hashes. A pair at
    exactly 0.8 becomes no candidate with a probability of 1.3e-7, a closer one with less. Null texts are empty; texts without
    words are one group; null ids are skipped as least ids; an empty table gives no rows.
    """
    sets = shingle_sets(docs, id_col, text_col, size)
    return label(sets.select(id_col, "fp"), verified_links(sets, docs, id_col, text_col, size), id_col).drop("fp")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each group, the one with the least id stays.

    Rows that repeat an id are one document and stay or go together; rows with a null id stay. Only rows that a bitmap of
    the ids that go has are shuffled.
    """
    gone = cut(similar_documents(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    maybe, stay = split_by(docs, F.xxhash64(id_col), gone.select(F.xxhash64(id_col).alias("at")))
    return stay.unionByName(maybe.join(gone, id_col, "left_anti").select(*docs.columns))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
