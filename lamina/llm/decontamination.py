"""Benchmark decontamination by the q-gram lemma: counts in diagonal bands, then banded alignment.

If a passage of a text is within k edits of an item of L characters, the two share at least L - q + 1 - k q of
the item's q-grams, and their diagonals (text place less item place) differ by k at most. So bands of diagonals,
each overlapping the next by half, are counted, and only bands that reach the bound are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import saved, slices, table
from lamina.llm.sketches import code_points

Q = 8
#: Edits allowed for each character of an item.
RATE = 0.08
#: Longer items are looked for in windows of this many characters, half overlapping.
WINDOW = 512
#: A verbatim part of an item of so many characters is a passage, wherever it starts; any lies whole in some window.
PART = 160
#: Characters of items in one index; a larger benchmark is looked for in several passes.
INDEX_CHARS = 2_000_000
#: Places of a text that are searched at once, and by how many they overlap: more than any passage and its bands have.
SEGMENT, OVERLAP = 65_536, 1024
#: Pairs of a text's gram and an item's place from which on a segment is cut in two, and the least size that is cut.
PAIRS, LEAST = 4_000_000, 256
#: Half the width of a band of diagonals; at least the largest edit budget.
STEP = 64
U = np.uint64
BITS = 22


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with runs of white space as one space, and the place of each in the text."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    points = code_points(lower)
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | (points == 0x85) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x3000)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[:1] = ~blank[:1]
    places = np.flatnonzero(keep)
    out = np.where(blank, 32, points)[places]
    if len(out) and out[-1] == 32:
        out, places = out[:-1], places[:-1]
    return out.astype(np.uint32), places


def plain(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(points: np.ndarray) -> np.ndarray:
    h, base, width = points.astype(U) + U(1), 0x9E3779B97F4A7C15, 1
    if len(h) < Q:
        return h[:0]
    while width < Q:
        h = h[:-width] * U(base) + h[width:]
        base, width = base * base & 0xFFFFFFFFFFFFFFFF, width * 2
    return h ^ (h >> U(29))


@dataclass
class Index:
    items: list
    probes: list[np.ndarray]
    owner: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    probe: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    short: list[tuple[int, str]]
    kind: pa.DataType | None


def build(items: list[tuple], kind: pa.DataType | None = None) -> Index:
    """An index of (id, text) items. Items of fewer than ``Q`` characters have no grams and are searched for as they are; empty ones are left out. ``kind`` is the ids' type."""
    ids, probes, owner, short = [], [], [], []
    for key, text in items:
        points, _ = normal(text or "")
        if not len(points):
            continue
        ids.append(key)
        if len(points) < Q:
            short.append((len(ids) - 1, plain(points)))
            continue
        last = max(len(points) - WINDOW, 0)
        for at in sorted({*range(0, last, WINDOW // 2), last}):
            probes.append(points[at : at + WINDOW])
            owner.append(len(ids) - 1)
    size = np.array([len(p) for p in probes], np.int64)
    # short items keep a bound of a few grams, or of all they have
    budget = np.minimum((size * RATE).astype(np.int64), np.maximum((size - Q + 1 - 4) // Q, 0))
    all_grams = [grams(p) for p in probes]
    hashes = np.concatenate(all_grams) if probes else np.zeros(0, U)
    order = np.argsort(hashes, kind="stable")
    distinct, starts = np.unique(hashes[order], return_index=True)
    mask = np.zeros(1 << BITS, bool)
    mask[distinct >> U(64 - BITS)] = True
    return Index(
        ids, probes, np.array(owner, np.int64), budget, size - Q + 1 - budget * Q, distinct, np.r_[starts, len(hashes)],
        np.repeat(np.arange(len(probes)), [len(g) for g in all_grams])[order], np.concatenate([np.arange(len(g)) for g in all_grams])[order] if probes else np.zeros(0, np.int64), mask, short, kind,
    )


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int, free: bool = True) -> tuple[int, int]:
    """Least edits between all of ``item`` and a passage of ``text`` on diagonals ``low`` to ``high``, and the passage's end.

    The passage starts anywhere, or at 0 without ``free``, and ends anywhere. The least of a row never falls from
    one row to the next, so an alignment that has gone over ``budget`` is given up.
    """
    width = high - low + 1
    far = np.int64(1 << 30)
    steps = np.arange(width)
    padded = np.full(width + len(item), 0xFFFFFFFF, np.uint32)  # text from place low on; outside nothing matches
    inside = np.arange(low, low + len(padded))
    ok = (inside >= 0) & (inside < len(text))
    padded[ok] = text[inside[ok]]
    place = steps + low
    cost = np.where((place >= 0) & (place <= len(text)), 0, far) if free else np.where(place == 0, 0, far)
    if not free:
        cost = np.minimum.accumulate(cost - steps) + steps
    for j in range(len(item)):
        now = cost + (padded[j : j + width] != item[j])
        now[:-1] = np.minimum(now[:-1], cost[1:] + 1)
        place = steps + low + j + 1
        now = np.where((place >= 0) & (place <= len(text)), now, far)
        cost = np.minimum.accumulate(now - steps) + steps
        if j % 8 == 7 and cost.min() > budget:
            break
    best = int(np.argmin(cost))
    return int(min(cost[best], far)), best + low + len(item)


def matches(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of the best passage for each item that the whole text has a passage of.

    Where an item isn't there whole (or no whole window of a long one), its longest verbatim part counts.
    """
    points, places = normal(text)
    best = passages(index, points)
    if index.short:
        whole = plain(points)
        best |= {own: (0, start, start + len(item)) for own, item in index.short if (start := whole.find(item)) >= 0}
    return [(own, int(places[s]), int(places[e - 1]) + 1, k) for own, (k, s, e) in sorted(best.items())]


def passages(index: Index, points: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """(edits, start, end) in normalised points for each item of ``Q`` or more characters.

    The text is searched in overlapping segments, each of which has every passage that begins in it whole, so memory follows
    neither from the text's length nor from how often a gram is in both text and benchmark: it is some 1,280 times the places
    that the most frequent gram of the index has in items of which a segment has enough grams, at most.
    """
    best: dict[int, tuple[int, int, int]] = {}
    parts: dict[int, tuple[int, int]] = {}
    if not len(index.hashes):
        return best
    todo = [(at, min(at + SEGMENT, len(points))) for at in range(0, len(points), SEGMENT)][::-1]
    while todo:
        low, high = todo.pop()
        piece = points[low : high + OVERLAP]
        h = grams(piece)
        if not len(h):
            continue
        at = np.flatnonzero(index.filter[h >> U(64 - BITS)])
        found = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
        hit = index.hashes[found] == h[at]
        at, found = at[hit], found[hit]
        if not len(at):
            continue
        # an item's places whose grams are anywhere in the segment: too few of them rule it out before any pair is made
        present, which = np.unique(found, return_inverse=True)
        size = index.starts[present + 1] - index.starts[present]
        entries = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - index.starts[present], size)
        alive = np.bincount(index.probe[entries], minlength=len(index.least)) >= np.minimum(index.least, PART - Q + 1)
        kept = alive[index.probe[entries]]
        size = np.bincount(np.repeat(np.arange(len(present)), size)[kept], minlength=len(present))
        entries, starts, many = entries[kept], np.cumsum(size) - size, size[which]
        if not len(entries):
            continue
        if many.sum() > PAIRS and high - low > LEAST:
            middle = (low + high) // 2
            todo += [(middle, high), (low, middle)]
            continue
        entry = entries[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - starts[which], many)]
        whole, runs = _segment(index, piece, np.repeat(at, many), entry)
        for own, (edits, start, end) in whole.items():
            if (now := (edits, start + low, end + low)) < best.get(own, (1 << 30,)):
                best[own] = now
        for own, (n, start) in runs.items():
            parts[own] = min(parts.get(own, (0, 0)), (n, start + low))
    return {own: (0, start, start - n) for own, (n, start) in parts.items()} | best


def _segment(index: Index, points: np.ndarray, where: np.ndarray, entry: np.ndarray) -> tuple[dict, dict]:
    """Whole passages (edits, start, end) and verbatim runs (minus the length, start) in a segment, by item, from pairs of a place and the index's entry of its gram."""
    probe = index.probe[entry]
    diagonal = where - index.place[entry]
    band = (diagonal + WINDOW) // STEP  # never below 0
    bands = int(band.max()) + 2
    keys = np.concatenate([probe * bands + band, probe * bands + band - 1])  # band b has the diagonals of steps b and b + 1
    key, count = np.unique(keys[keys >= 0], return_counts=True)
    dense = key[count > PART - Q]
    key = key[count >= index.least[key // bands]]
    if len(key):  # a gram of the item counts once in a band, however often a repetitive text has it
        some = np.isin(keys, key)
        key, count = np.unique(np.unique(keys[some] * WINDOW + np.tile(index.place[entry], 2)[some]) // WINDOW, return_counts=True)
        key = key[count >= index.least[key // bands]]
    best: dict[int, tuple[int, int, int]] = {}
    for p, b in zip((key // bands).tolist(), (key % bands).tolist()):
        item, budget = index.probes[p], int(index.budget[p])
        low, high = b * STEP - WINDOW - budget, (b + 2) * STEP - 1 - WINDOW + budget
        first = max(low, 0)
        region = points[first : high + len(item) + 1]
        exact = region.astype("<u4").tobytes().find(item.astype("<u4").tobytes())
        if exact >= 0 and exact % 4 == 0:
            edits, start, end = 0, first + exact // 4, first + exact // 4 + len(item)
        else:
            edits, end = align(item, points, low, high, budget)
            if edits > budget:
                continue
            back, length = align(item[::-1], points[max(0, end - len(item) - budget) : end][::-1], -budget, budget, budget, free=False)
            start = end - length
        own = int(index.owner[p])
        if start < end and (edits, start) < best.get(own, (1 << 30,))[:2]:
            best[own] = (edits, start, end)
    parts: dict[int, tuple[int, int]] = {}
    if len(dense):  # runs of grams on a diagonal
        some = np.flatnonzero(np.isin(keys[: len(entry)], dense) | np.isin(keys[len(entry) :], dense))
        some = some[np.lexsort((where[some], diagonal[some], probe[some]))]
        first = np.flatnonzero(np.r_[True, (np.diff(probe[some]) != 0) | (np.diff(diagonal[some]) != 0) | (np.diff(where[some]) != 1)])
        length = np.diff(np.r_[first, len(some)]) + Q - 1
        for i, n in zip(some[first[length >= PART]].tolist(), length[length >= PART].tolist()):
            own, start, place = int(index.owner[probe[i]]), int(where[i]), int(where[i] - diagonal[i])
            if (points[start : start + n] == index.probes[probe[i]][place : place + n]).all():
                parts[own] = min(parts.get(own, (0, 0)), (-n, start))
    return best, parts


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Index, bool]]:
    """Indexes that cover the whole benchmark, each of about ``INDEX_CHARS`` characters at most, one at a time, and whether each is the only one.

    Equal items share one entry, that of the least id.
    """
    items = benchmark.where(F.col(text_col).isNotNull()).groupBy(text_col).agg(F.min(id_col).alias("id"))
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    passes = total // INDEX_CHARS + 1
    part = F.pmod(F.xxhash64(text_col), F.lit(passes))
    for i in range(passes):
        rows = items.where(part == i).select("id", text_col).toArrow()
        yield build(list(zip(*(c.to_pylist() for c in rows.columns))), rows.schema.field(0).type), passes == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row of ``id_col``, ``item_col``, ``start``, ``end`` and ``edits`` for each document and item that it has a passage of.

    A passage is a whole item within 8 % edits, a whole window (512 characters, at strides of 256) of a longer one
    within as many, or a verbatim part of an item of ``PART`` (160) characters or more, from any place in it. A
    shorter part, or one with edits that has no such verbatim run, isn't found. An
    item of fewer than 8 characters is searched for exactly, also inside words.

    The place, in code points of the text, is of the passage with the fewest edits, then of the first. One pass
    over the documents for each index, without a shuffle; only the index is sent to the tasks, and its size is
    bounded; with several, one is held at a time and what it finds is written. Null and empty texts have no passages, null
    items none to find; of equal items the least id stands for all; repeated rows each give their matches; texts are searched
    whole, in segments; ids are of any type; other columns are not read; an empty table on either side gives no rows.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    context, out = docs.sparkSession.sparkContext, None
    for index, only in indexes(benchmark, item_col):
        sent = context.broadcast(index)

        def find(batches, sent=sent):
            index = sent.value
            for batch in slices(batches):
                rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in matches(index, t or "")]
                if rows:
                    doc, item, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), pa.array([index.items[i] for i in item], index.kind), *[pa.array(r, pa.int64()) for r in rest]], names=["id", "item", "start", "end", "edits"]
                    )

        some = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(find, f"id {kinds[0]}, item {kinds[1]}, start long, end long, edits long")
        if not only:
            some = saved(some, "passages")
            sent.destroy()
        out = some if out is None else out.unionAll(some)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has no passage of the benchmark, filtered where they are; null and empty texts stay.

    With several indexes, what each leaves is written before the next is made.
    """
    at, context = docs.columns.index(text_col), docs.sparkSession.sparkContext
    for index, only in indexes(benchmark):
        sent = context.broadcast(index)

        def keep(batches, sent=sent):
            index = sent.value
            for batch in slices(batches):
                yield batch.filter(pa.array([not matches(index, t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if not only:
            docs = saved(docs, "clean")
            sent.destroy()
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
