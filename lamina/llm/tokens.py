"""Token counts by rank-synchronous merging of ragged arrays, for byte-level BPE vocabularies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lamina.llm.common import table

#: Fixed value: the split pattern that such vocabularies are built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Known pieces that a worker keeps, and their characters; beyond either the memory is emptied, which costs time and changes no count.
KNOWN, KNOWN_CHARS = 400_000, 8 << 20
#: Bytes of text that are split at once.
BLOCK = 4 << 20
NONE = np.iinfo(np.int64).max


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges as sorted arrays: pair of symbols to rank, and rank to merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kind = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or a prefix space")
        vocab = model["vocab"]
        self.bytes = np.zeros(256, np.int64)
        for name, b in byte_names().items():
            self.bytes[b] = vocab[name]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece. All pieces merge their own lowest-rank pair in each round.

        A rank belongs to one pair, so a round merges every place of that pair in its piece; where places overlap
        (a run of one symbol), every other one from the left. Only pieces that merged go on to the next round.
        """
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        live = np.flatnonzero(out > 1)
        symbols = self.bytes[np.frombuffer(b"".join(pieces[i] for i in live), np.uint8)]
        sizes = out[live]
        while len(live):
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[starts + sizes - 1] = NONE  # a piece's last symbol has no partner
            least = np.minimum.reduceat(rank, starts)
            goes = least != NONE
            out[live[~goes]] = sizes[~goes]
            owner = np.repeat(np.arange(len(live)), sizes)
            merge = (rank == least[owner]) & (rank != NONE)
            at = np.flatnonzero(merge)
            if len(at):
                first = np.r_[True, np.diff(at) != 1]
                run = np.flatnonzero(first)[np.cumsum(first) - 1]
                same_run = (np.arange(len(at)) - run) % 2 == 0
                at = at[same_run]
                symbols = symbols.copy()
                symbols[at] = self.made[rank[at]]
                keep = np.repeat(goes, sizes)
                sizes = sizes - np.bincount(owner[at], minlength=len(live))
                keep[at + 1] = False
                symbols = symbols[keep]
            else:
                symbols = symbols[:0]
            live, sizes = live[goes], sizes[goes]
        return out


class Counter:
    """Token counts of texts, with the counts of known pieces kept between calls.

    What it holds is bounded by ``KNOWN`` and ``KNOWN_CHARS`` and what one block of texts needs beyond them.
    """

    def __init__(self, merges: Merges):
        self.merges, self.known, self.inner, self.chars, self.inner_chars = merges, {}, {}, 0, 0
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        # white space beside a lone space, where a space does not open a token of its own
        self.odd = regex.compile(r"^\s|\s$| \s|\s ").search

    def learn(self, wanted: set[str]) -> None:
        """Count the pieces that aren't known: their tokens after the split, all in one ragged array."""
        pieces = wanted.difference(self.known)
        if len(self.known) + len(pieces) > KNOWN or self.chars > KNOWN_CHARS:
            self.known.clear()
            self.chars, pieces = 0, wanted
        if not pieces:
            return
        if len(self.inner) > KNOWN or self.inner_chars > KNOWN_CHARS:
            self.inner.clear()
            self.inner_chars = 0
        self.chars += sum(map(len, pieces))
        parts = {p: self.split(p) for p in pieces}
        fresh = list({x for own in parts.values() for x in own if x not in self.inner})
        self.inner_chars += sum(map(len, fresh))
        self.inner.update(zip(fresh, self.merges.count([x.encode() for x in fresh]).tolist()))
        inner = self.inner
        self.known.update({p: sum(inner[x] for x in own) for p, own in parts.items()})

    def pieces(self, text: str) -> list[str]:
        """Parts of a text without special strings that can be split apart: a lone space opens a token always."""
        if not text:
            return []
        if self.odd(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def __call__(self, texts: list[str]) -> list[int]:
        found, extra = [], []
        for text in texts:
            if self.special and self.special.search(text):
                between = self.special.split(text)
                found.append([p for x in between for p in self.pieces(x)])
                extra.append(len(between) - 1)
            else:
                found.append(self.pieces(text))
                extra.append(0)
        self.learn({p for own in found for p in own})
        known = self.known.__getitem__
        return [sum(map(known, own)) + n for own, n in zip(found, extra)]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about BLOCK characters each; a longer text is a block of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > BLOCK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row, in one pass without a shuffle.

    ``vocabulary`` is the path of a byte-level BPE file, read by each worker. The strings of its special tokens
    count as one token each, as the vocabulary's library has it by default. A null text is empty: 0 bytes and 0 tokens. Whole texts of any length
    count; repeated rows each give a row; other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def count(batches):
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(Merges(vocabulary))
        counter = _counters[vocabulary]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [n for a, b in blocks(texts) for n in counter(texts[a:b])]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(
        count, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    ).withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), vocabulary)
