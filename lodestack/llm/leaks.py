"""Evaluation texts leaking into a corpus.

Every run of `width` words of an evaluation item is fingerprinted with SimHash, and so is every such run of every
document: item-sized windows at the size of the smallest passage that counts. Fingerprints within `radius` bits
are found without loss by multi-index blocks: with radius + 1 blocks of bits, two fingerprints that differ in at most
`radius` bits agree in at least one block. Candidates are verified exactly by the weighted similarity of their
five-word shingles, and by equality word for word.

Fingerprints within the radius find all equal windows, but few of the merely similar ones, so for similarity all
candidates come from the shingles, without loss: a window that reaches the threshold with an item's window shares more
of its weight than the threshold leaves out, so it shares one of the rarest shingles that together weigh more than
that. Windows of `width` words are compared, and windows of each item's own size with the item as a whole.

The corpus is only scanned: each document is decided where it is read, nothing of it is shuffled or collected,
and a text that leaked into a third of the documents costs no more than another. The items are collected in
passes of at most `pass_windows` windows; each pass scans the corpus once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import flat_lists, mix, shingles, windows, word_hashes
from lodestack.session import ship_package

BITS = 64
SHINGLE = 5
#: Windows of documents handled at once; bounds memory for texts of any length.
CHUNK = 1 << 15
#: Pairs of windows or of shingles compared at once, for the same reason.
PAIRS = 1 << 20


class Weights:
    """Weights of words: the rarer among the items, the heavier (1 to 8); words of no item weigh the most."""

    def __init__(self, words: np.ndarray, holders: np.ndarray, items: int):
        """words: hashes; holders: how many of the items have each."""
        order = np.argsort(words)
        self.words = np.asarray(words, dtype=np.int64)[order]
        share = np.asarray(holders, dtype=float)[order] / max(1, items)
        self.values = np.clip(np.rint(-np.log2(share)) + 1, 1, 8).astype(np.int32)

    @classmethod
    def counted(cls, lists: list[list[int]]) -> Weights:
        words, holders = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(x) for x in lists]]), return_counts=True)
        return cls(words, holders, len(lists))

    def of(self, values: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(values), 8, np.int32)
        at = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        return np.where(self.words[at] == values, self.values[at], np.int32(8))


def simhash(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of each window, from the weighted bits of its words."""
    bits = np.unpackbits(mix(values.astype(np.int64, copy=False).view(np.uint64)).view(np.uint8).reshape(-1, 8), axis=1)
    signed = (bits.astype(np.int32) * 2 - 1) * weights[:, None]
    sums = np.zeros((len(values) + 1, BITS), dtype=np.int32)
    np.cumsum(signed, axis=0, out=sums[1:])
    above = (sums[starts + width] - sums[starts]) > 0
    return np.packbits(above, axis=1).view(np.uint64).ravel()


def _first(hashes: np.ndarray) -> np.ndarray:
    """Whether each shingle of each window (a row) is its first in the window."""
    order = np.argsort(hashes, axis=1, kind="stable")
    ranked = np.take_along_axis(hashes, order, axis=1)
    out = np.ones(hashes.shape, bool)
    np.put_along_axis(out, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], axis=1)
    return out


class ItemIndex:
    """The fingerprints of all windows of some items, indexed by each block of bits."""

    def __init__(self, ids: list, lists: list[list[int]], width: int, radius: int, weights: Weights | None = None):
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        self.values = np.array([v for x in lists for v in x], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.width, self.radius, self.ids = width, radius, np.array(ids, dtype=np.int64)
        self.weights = weights or Weights.counted(lists)
        self.known = np.unique(self.values)
        self.word_weights = self.weights.of(self.values)
        starts, owner = windows(self.values, offsets, width)
        if len(starts):
            # windows that are equal word for word in one item are one window
            whole = shingles(self.values, starts, width)
            _, keep = np.unique(np.stack([whole, owner.astype(np.uint64)]), axis=1, return_index=True)
            starts, owner = starts[keep], owner[keep]
            self.prints = simhash(self.values, self.word_weights, starts, width)
        else:
            self.prints = np.zeros(0, np.uint64)
        self.starts, self.owner = starts, owner
        blocks = radius + 1
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            key = self.block(self.prints, low, high)
            order = np.argsort(key, kind="stable")
            self.blocks.append((low, high, key[order], order))

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each word occurs in one of these items."""
        if not len(self.known):
            return np.zeros(len(values), bool)
        return self.known[np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)] == values

    @staticmethod
    def block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into prints, item window) within the radius."""
        found = []
        for low, high, keys, order in self.blocks:
            key = self.block(prints, low, high)
            first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            counts = last - first
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            counts = counts[hit]
            left = np.repeat(hit, counts)
            at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            right = order[np.repeat(first[hit], counts) + at]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(np.stack([left[close], right[close]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def weighted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of windows (a row each) and their weights; repeated ones weigh nothing."""
        n = self.width - SHINGLE + 1
        at = (np.arange(len(rows)) * self.width)[:, None] + np.arange(n)
        hashes = shingles(rows.ravel(), at.ravel(), SHINGLE).reshape(len(rows), n)
        word = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(self.weights.of(rows.ravel()).reshape(rows.shape), axis=1)], axis=1)
        return hashes, (word[:, SHINGLE:] - word[:, :-SHINGLE]) * _first(hashes)

    def shingled(self, threshold: float) -> ItemIndex:
        """Indexes the windows by their rarest shingles, as many as weigh more than the threshold leaves out."""
        keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if len(self.starts):
            hashes, weights = self.weighted(self.values[self.starts[:, None] + np.arange(self.width)])
            known, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(np.where(weights > 0, counts[place.reshape(hashes.shape)], len(hashes) * self.width), axis=1, kind="stable")
            heavy = np.take_along_axis(weights, order, axis=1)
            taken = (np.cumsum(heavy, axis=1) - heavy <= (1 - threshold) * weights.sum(axis=1, keepdims=True) + 1e-9) & (heavy > 0)
            keys.append(np.take_along_axis(hashes, order, axis=1)[taken])
            at.append(np.nonzero(taken)[0])
        key, window = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        self.keys, self.key_window = key[order], window[order]
        return self

    def sharing(self, hashes: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (start of a window, item window) with an indexed shingle in common, in parts of bounded size. The
        shingles stand at `places` of a text from `starts` to `ends`."""
        first, last = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        n = self.width - SHINGLE + 1
        hit = np.flatnonzero(last > first)
        counts = last[hit] - first[hit]
        part = np.cumsum(counts * n) // PAIRS
        for k in np.unique(part):
            here, much = hit[part == k], counts[part == k]
            row = np.repeat(here, much)
            window = self.key_window[np.arange(int(much.sum())) - np.repeat(np.cumsum(much) - much, much) + np.repeat(first[here], much)]
            begin = places[row][:, None] - np.arange(n)
            fits = (begin >= starts[row][:, None]) & (begin + self.width <= ends[row][:, None])
            pairs = np.unique(np.stack([begin[fits], np.broadcast_to(window[:, None], begin.shape)[fits]]), axis=1)
            if pairs.shape[1]:
                yield pairs[0], pairs[1]

    def similarity(self, values: np.ndarray, starts: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted similarity of the shingles of window pairs, and whether all words are equal."""
        span = np.arange(self.width)
        a, b = values[starts[:, None] + span], self.values[self.starts[mine][:, None] + span]
        equal = (a == b).all(axis=1)
        out = np.ones(len(starts))
        rest = np.flatnonzero(~equal)
        if len(rest):
            step = max(1, PAIRS // self.width**2)
            for low in range(0, len(rest), step):
                part = rest[low:low + step]
                (sa, wa), (sb, wb) = self.weighted(a[part]), self.weighted(b[part])
                same = (wa * (sa[:, :, None] == sb[:, None, :]).any(axis=2)).sum(axis=1)
                out[part] = same / np.maximum(1, wa.sum(axis=1) + wb.sum(axis=1) - same)
        return out, equal


def _scan(index: ItemIndex, shingled: list[ItemIndex], threshold: float):
    """shingled: indexes whose windows are found by shingles; none, if only equal windows are wanted."""
    all_keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x.keys for x in shingled]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_lists(batch.column(1))
            starts, owner = windows(values, offsets, index.width)
            # a window with a word of no item equals no item's window
            unknown = np.concatenate([[0], np.cumsum(~index.has(values))])
            whole = unknown[starts + index.width] == unknown[starts]
            starts, owner = starts[whole], owner[whole]
            parts = []
            for low in range(0, len(starts), CHUNK):
                own, begin = owner[low:low + CHUNK], starts[low:low + CHUNK]
                # the words of these windows, without the gaps between them
                step = np.minimum(np.diff(begin, prepend=begin[0] - index.width), index.width)
                places = np.cumsum(step) - step[0]
                piece = np.empty(int(places[-1]) + index.width, dtype=np.int64)
                for k in range(index.width):
                    piece[places + k] = values[begin + k]
                prints = simhash(piece, index.weights.of(piece), places, index.width)
                left, right = index.near(prints)
                if len(left):
                    similar, equal = index.similarity(piece, places[left], right)
                    parts.append((own[left], index.owner[right], similar, equal))
            if len(all_keys):
                places, owner = windows(values, offsets, SHINGLE)
                hashes = shingles(values, places, SHINGLE)
                kept = np.flatnonzero(all_keys[np.minimum(np.searchsorted(all_keys, hashes), len(all_keys) - 1)] == hashes)
                hashes, places, owner = hashes[kept], places[kept], owner[kept]
                for x in shingled:
                    for begin, mine in x.sharing(hashes, places, offsets[owner], offsets[owner + 1]):
                        similar, equal = x.similarity(values, begin, mine)
                        own = np.searchsorted(offsets, begin, "right") - 1
                        good = similar >= threshold
                        parts.append((own[good], x.owner[mine[good]], similar[good], equal[good]))
            parts = [x for x in parts if len(x[0])]
            if not parts:
                continue
            doc, item, similar, equal = (np.concatenate(x) for x in zip(*parts))
            pairs, at = np.unique(np.stack([doc, item]), axis=1, return_inverse=True)
            best, exact, hits = np.zeros(pairs.shape[1]), np.zeros(pairs.shape[1], bool), np.bincount(at.ravel())
            np.maximum.at(best, at.ravel(), similar)
            np.logical_or.at(exact, at.ravel(), equal)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pairs[0])), pa.array(index.ids[pairs[1]]), pa.array(best),
                 pa.array(exact), pa.array(hits.astype(np.int64))],
                ["doc_id", "item_id", "similarity", "exact", "window_pairs"],
            )

    return run


def leaks(
    docs: DataFrame, items: DataFrame, width: int = 12, radius: int = 3, threshold: float = 0.8,
    pass_windows: int = 50_000, similar: bool = True,
) -> DataFrame:
    """(doc_id, item_id, similarity, exact, window_pairs) of every document (doc_id, text) with a window of
    `width` words whose weighted shingle similarity to a window of an item (item_id, text) is at least
    `threshold`, or a window of as many words as the item has that is so similar to the whole item. exact: a run of
    `width` words is the same word for word.

    Guarantee: all of these are found. Without `similar`, only pairs with an equal window are sure to be (equal windows
    have equal fingerprints), and those of the same words within `radius` bits. The weights are those of all items, so `pass_windows` doesn't change the result. Defined cases: null or empty texts and texts under `width` words match nothing; rows with a null id
    are ignored; repeated rows count once; no items or no documents give an empty result.
    """
    ship_package(docs.sparkSession)
    wanted = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), word_hashes(F.col("text")).alias("h")
    ).where(F.size("h") >= width)
    items_with, total = wanted.agg(F.count("*"), F.sum(F.size("h") - (width - 1))).first()
    passes = max(1, -(-(total or 0) // pass_windows))
    # one number for each different word of the items
    held = wanted.select(F.explode(F.array_distinct("h")).alias("word")).groupBy("word").count().toArrow()
    weights = Weights(held.column("word").to_numpy(), held.column("count").to_numpy(), items_with)
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", word_hashes(F.col("text")).alias("h"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id bigint, similarity double, exact boolean, window_pairs bigint"
    result = None
    for k in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        index, shingled = ItemIndex([r[0] for r in rows], [r[1] for r in rows], width, radius, weights), []
        if similar and width >= SHINGLE:
            by_size: dict[int, list[int]] = {width: list(range(len(rows)))}
            for at, r in enumerate(rows):
                if len(r[1]) > width:
                    by_size.setdefault(len(r[1]), []).append(at)
            for size, some in by_size.items():
                x = ItemIndex([rows[at][0] for at in some], [rows[at][1] for at in some], size, radius, weights)
                x.owner = np.array(some, dtype=np.int64)[x.owner]  # positions in `index`
                shingled.append(x.shingled(threshold))
        part = source.mapInArrow(_scan(index, shingled, threshold), schema).where(F.col("similarity") >= threshold)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max("exact").alias("exact"), F.max("window_pairs").alias("window_pairs")
    )
