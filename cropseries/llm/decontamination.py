"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, text_slices, texts_of
from .grams import SHINGLE, mix64, shingles, words

BITS = 64
#: At similarity 0.75 the fingerprints of window and item differ in about 11 bits, with deviation 3.
RADIUS = 23
SIMILARITY = 0.75
#: Text bytes of benchmark items that are searched for at once.
BLOCK_BYTES = 16 << 20
#: Pairs of windows and items that are compared at once.
PAIRS = 1 << 16


def bit_signs(grams: np.ndarray) -> np.ndarray:
    """(n, 64) matrix of +1 and -1: each shingle's vote on each bit."""
    bits = np.unpackbits(mix64(grams ^ np.uint64(0xA0761D6478BD642F)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of vote sums: a bit is set where the sum is positive."""
    return np.packbits(votes > 0, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class ItemIndex:
    """Benchmark items: their shingles with multiplicity, sizes, and fingerprints in Hamming blocks by item size.

    Two fingerprints within ``radius`` agree in at least one of ``radius + 1`` blocks of bits, so looking up the blocks
    finds all of them.
    """

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS, similarity: float = SIMILARITY):
        self.ids = [i for i, _ in items]
        self.radius, self.similarity = radius, similarity
        hashes, offsets = words([(t or "").encode("utf-8", "surrogatepass") for _, t in items])
        grams, ends = shingles(hashes, offsets)
        self.n_words = np.diff(offsets)
        self.counts = [np.unique(grams[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:])]
        owners = np.repeat(np.arange(len(items)), np.diff(ends))
        self.vocabulary, place = np.unique(grams, return_inverse=True)
        def listed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The distinct values of each shingle, one shingle after another, and where each shingle's begin."""
            room = int(values.max(initial=0)) + 1
            both = np.unique(place.astype(np.int64) * room + values)
            return both % room, np.searchsorted(both // room, np.arange(len(self.vocabulary) + 1))
        #: word counts of the items that hold a shingle, and those items
        self.sizes, self.sizes_at = listed(self.n_words[owners])
        self.holders, self.holders_at = listed(owners)
        self.n_grams = np.diff(ends)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        edges = np.linspace(0, BITS, min(radius + 1, BITS) + 1).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.prints = np.zeros(len(items), dtype=np.uint64)
        self.tables: dict[int, list[dict[int, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if b > a:
                self.prints[k] = fingerprints(bit_signs(grams[a:b]).sum(axis=0)[None, :])[0]
                by_size[int(self.n_words[k])].append(k)
        for size, members in by_size.items():
            tables = []
            for shift, mask in self.blocks:
                cells: dict[int, list[int]] = defaultdict(list)
                for k in members:
                    cells[int((self.prints[k] >> shift) & mask)].append(k)
                tables.append({v: np.array(m) for v, m in cells.items()})
            self.tables[size] = tables
        self.short_sizes = sorted({int(n) for n in self.n_words if 0 < n < SHINGLE})

    def possible(self, places: np.ndarray, size: int, span: int) -> np.ndarray:
        """Whether each item can reach the similarity in a window of ``span`` shingles among text that holds the shingles ``places``.

        Each shared shingle of a window is one of these that the item holds, so an item with fewer of them than the sizes ask for
        cannot. Only items of ``size`` words count."""
        shared = np.zeros(len(self.ids), dtype=np.int64)
        for p, n in zip(*(v.tolist() for v in np.unique(places, return_counts=True))):
            shared[self.holders[self.holders_at[p]:self.holders_at[p + 1]]] += n
        need = self.similarity * (span + self.n_grams) / (1 + self.similarity) - 1e-9
        return (shared >= need) & (shared > 0) & (self.n_words == size)

    def near(self, prints: np.ndarray, size: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) index pairs of the allowed items of ``size`` words within the radius of the windows' fingerprints."""
        found = []
        for (shift, mask), cells in zip(self.blocks, self.tables[size]):
            values = (prints >> shift) & mask
            for value, members in cells.items():
                members = members[allowed[members]]
                at = np.flatnonzero(values == np.uint64(value)) if len(members) else members
                if len(at):
                    found.append((np.repeat(at, len(members)) * len(self.ids) + np.tile(members, len(at))))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found))
        w, k = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(prints[w] ^ self.prints[k]) <= self.radius
        return w[close], k[close]

    def windows(self, grams: np.ndarray, hits: np.ndarray, size: int, n_words: int) -> np.ndarray:
        """First shingles of the windows of ``size`` words that hold a shingle of an item of that size."""
        span = max(size - SHINGLE + 1, 1)
        last = max(len(grams) - span, 0)
        marks = np.zeros(last + 2, dtype=np.int32)
        np.add.at(marks, np.minimum(np.maximum(hits - span + 1, 0), last + 1), 1)
        np.add.at(marks, np.minimum(hits, last) + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[:last + 1] > 0)

    def search(self, grams: np.ndarray, n_words: int) -> dict[int, tuple[float, int, int]]:
        """Item index -> (similarity, first word, Hamming distance) of its best window; ``grams`` in text order."""
        best: dict[int, tuple[float, int, int]] = {}
        at = np.flatnonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return best
        place = np.searchsorted(self.vocabulary, grams[at])
        place[place == len(self.vocabulary)] = 0
        sure = self.vocabulary[place] == grams[at]
        at, place = at[sure], place[sure]
        place_at = np.full(len(grams), -1, dtype=np.int64)
        place_at[at] = place
        hits: dict[int, list[int]] = defaultdict(list)
        for a, p in zip(at.tolist(), place.tolist()):
            for size in self.sizes[self.sizes_at[p]:self.sizes_at[p + 1]].tolist():
                hits[size].append(a)
        for size, positions in hits.items():
            if n_words < SHINGLE and size != n_words:
                continue  # a short text's one shingle is its whole sequence
            starts = self.windows(grams, np.array(positions), size, n_words)
            span = min(max(size - SHINGLE + 1, 1), len(grams))
            # runs of starts share their votes; each run is summed once
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for cut in range(0, len(run), 4096):
                    part = run[cut:cut + 4096]
                    around = place_at[part[0]:part[-1] + span]
                    allowed = self.possible(around[around >= 0], size, span)
                    step = max(PAIRS // max(int(allowed.sum()), 1), 1)
                    for k in range(0, len(part) if allowed.any() else 0, step):
                        self._score(grams, part[k:k + step], span, size, allowed, best)
        return best

    def _score(self, grams, starts, span, size, allowed, best) -> None:
        lo, hi = int(starts[0]), int(starts[-1]) + span
        sums = np.concatenate((np.zeros((1, BITS), dtype=np.int32), np.cumsum(bit_signs(grams[lo:hi]), axis=0, dtype=np.int32)))
        prints = fingerprints(sums[starts - lo + span] - sums[starts - lo])
        w, k = self.near(prints, size, allowed)
        for wi, ki in zip(w.tolist(), k.tolist()):
            first = int(starts[wi])
            value = self._similarity(grams[first:first + span], ki)
            if value >= self.similarity:
                entry = (value, first, int(np.bitwise_count(prints[wi] ^ self.prints[ki])))
                old = best.get(ki)
                if old is None or (-entry[0], entry[1]) < (-old[0], old[1]):
                    best[ki] = entry

    def _similarity(self, window: np.ndarray, k: int) -> float:
        """Sum of minima over sum of maxima of the shingles' counts in window and item."""
        values, counts = self.counts[k]
        place = np.searchsorted(values, window)
        place[place == len(values)] = 0
        same = values[place] == window
        shared = int(np.minimum(np.bincount(place[same], minlength=len(values)), counts).sum())
        return shared / (len(window) + int(counts.sum()) - shared)


_last: tuple[list | None, tuple, ItemIndex | None] = (None, (), None)


def index_of(items: list, radius: int, similarity: float) -> ItemIndex:
    """The index of a block of items, built once by a worker as long as its tasks get the same broadcast."""
    global _last
    if _last[0] is not items or _last[1] != (radius, similarity):
        _last = (items, (radius, similarity), ItemIndex(items, radius, similarity))
    return _last[2]


def _short_items(index: ItemIndex, hashes: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """Items under five words: their one shingle is the whole sequence, looked for among runs of as many words."""
    best: dict[int, tuple[float, int, int]] = {}
    for size in index.short_sizes:
        if len(hashes) > size:
            n = len(hashes) - size + 1
            flat = np.lib.stride_tricks.sliding_window_view(hashes, size).ravel()
            runs = shingles(flat, np.arange(0, (n + 1) * size, size))[0]
            for k in np.flatnonzero(index.n_words == size).tolist():
                at = np.flatnonzero(runs == index.counts[k][0][0])
                if len(at):
                    best[k] = (1.0, int(at[0]), 0)
    return best


def search_texts(index: ItemIndex, texts: list[bytes]) -> Iterator[dict[int, tuple[float, int, int]]]:
    hashes, offsets = words(texts)
    grams, ends = shingles(hashes, offsets)
    for i in range(len(texts)):
        n = int(offsets[i + 1] - offsets[i])
        found = index.search(grams[ends[i]:ends[i + 1]], n)
        if index.short_sizes:
            found |= _short_items(index, hashes[offsets[i]:offsets[i + 1]])
        yield found


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, each small enough for the driver and every task."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct().collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       radius: int = RADIUS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item found in it: id, item_id, similarity, first_word, n_words, hamming.

    Windows as long as an item slide over the whole text, and a text shorter than the item is one window. Windows that
    hold none of the items' shingles have similarity 0 and are passed over, and so are items that hold too few of the shingles around
    to reach the similarity; each of the other windows gets a SimHash fingerprint of its five-word shingles, each weighted by its
    number in the window. Items within ``radius`` bits, found by Hamming blocks, are candidates; those whose weighted Jaccard
    similarity reaches ``similarity`` are reported with their best window, the first of equals. Under five words, the whole
    sequence is the shingle.

    The items are searched in blocks of bounded size, one pass over the documents for each; nothing is shuffled. Null and
    empty texts, items and tables find nothing; a null id is reported as it is; repeated rows are reported each.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for items in item_blocks(benchmark, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, radius, similarity)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    hits = []
                    for doc, found in zip(part.column(0).to_pylist(), search_texts(index, texts_of(part))):
                        hits += [(doc, index.ids[k], v, first, int(index.n_words[k]), h) for k, (v, first, h) in sorted(found.items())]
                    if hits:
                        yield pa.RecordBatch.from_pydict(dict(zip(SCHEMA.names, map(list, zip(*hits)))), schema=SCHEMA)

        part = rows.mapInArrow(scan, "id long, item_id long, similarity double, first_word long, n_words long, hamming int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


SCHEMA = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()),
                    ("n_words", pa.int64()), ("hamming", pa.int32())])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", radius: int = RADIUS,
                      similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark item is found."""
    name = fresh(docs.columns, "items_found")
    for items in item_blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("int")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = index_of(shared.value, radius, similarity)
            for texts in batches:
                batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
                yield pd.Series([len(hit) for part in text_slices(batch, "text") for hit in search_texts(index, texts_of(part))], dtype="int32")

        docs = docs.withColumn(name, found(F.col(text_col))).filter(F.col(name) == 0).drop(name)
    return docs
