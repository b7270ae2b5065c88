"""Token-ID files, Re-Pair compressed.

File format: a Parquet table with one row per block of consecutive documents (ascending id), its fields little-endian:

* ``shard, block``: place in the order of all documents; ``n_docs``, ``n_tokens``
* ``doc_ids`` (int64), ``doc_null`` (uint8), ``doc_tokens`` (uint32: ids of each document, the end id included)
* ``rules`` (uint16 pairs): rule r stands for symbol ``base + r``; its two symbols come before it
* ``lengths`` (uint32): ids that each rule expands to
* ``symbols`` (uint16), ``doc_symbols`` (uint32: symbols of each document)

No symbol spans two documents, so a document is decoded from its own symbols; with the expansion lengths, so is any range
of its ids.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import order_columns, partitions, text_slices, texts_of

END = 1
TOKENIZER = "word_bpe_49k.json"
#: Ids of a block before it is closed; a block holds whole documents.
BLOCK_IDS = 1 << 21
#: Rules added in one pass, and the count from which a pair is replaced: a rule takes 8 bytes and saves 2 for each occurrence.
RULES_PER_ROUND, MIN_COUNT = 3072, 5
_CELL_BITS = 20
FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int32()),
                         ("doc_ids", pa.binary()), ("doc_null", pa.binary()), ("doc_tokens", pa.binary()), ("doc_symbols", pa.binary()),
                         ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])
FILE_DDL = ("shard int, block int, n_docs long, n_tokens long, base int, doc_ids binary, doc_null binary, doc_tokens binary, "
            "doc_symbols binary, rules binary, lengths binary, symbols binary")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Normaliser and word pattern of the tokenizers whose words can be encoded one by one.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_encoders: dict[str, WordEncoder] = {}


def _plain_letters(word: str) -> bool:
    """Lower-case letters up to Latin Extended-B, which normalisation leaves alone and the word pattern keeps together."""
    return word.isalpha() and max(word) < "\u0250" and word == word.lower()


class _Memory(dict):
    """Words and their ids; a word looked up for the first time is encoded."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.encoder.word(word.decode())
        return ids


class WordEncoder:
    """Encodes texts; with a tokenizer that normalises, drops white space and splits by word pattern, each distinct word once.

    Words are parted by white space and lower-cased (ASCII only; the tokenizer does so itself). Punctuation that ends a word
    after a letter is looked up on its own, where the word pattern splits anyway. Words of plain letters go straight to the
    tokenizer's model, others through the whole tokenizer. Texts that hold ``<|``, which begins the special strings, are
    encoded whole, as all texts are with any other tokenizer. The memory is dropped when it holds ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        patterns = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = kinds == _NORMAL and patterns == [_PATTERN, None]
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): self.bytes_of.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x250)) if c.isalpha()}
        self.limit = limit
        self.memory = _Memory(self)

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The worker's encoder, kept from task to task."""
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def _plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, text: str) -> bytes:
        """Ids of a lower-cased word without white space."""
        core = text.rstrip(_PUNCTUATION)
        # a letter that normalisation turns into a letter and a mark (capital I with dot) doesn't end a word of letters
        if core and core != text and core[-1].isalpha() and core[-1] < "\u0250" and len(core[-1].lower()) == 1:
            return self.memory[core.encode()] + self.memory[text[len(core):].encode()]
        if _plain_letters(text):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else text.translate(self.letters))]).tobytes()
        return self._plain(text.encode())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed with the end id, and the number of ids of each text."""
        if len(self.memory) > self.limit:
            self.memory.clear()
        known = self.memory.__getitem__
        parts = [b"".join(map(known, t.lower().split())) if self.by_word and b"<|" not in t else self._plain(t) for t in texts]
        end = END.to_bytes(4, "little")
        ids = np.frombuffer(b"".join([p for part in parts for p in (part, end)]), dtype="<u4")
        return ids, np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4 + 1


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (n, 2) symbols
    lengths: np.ndarray

    def pool(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all rules, one after another, and where each begins."""
        begins = np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int64)
        pool = np.zeros(begins[-1], dtype=np.uint32)
        for r, (a, b) in enumerate(self.rules.tolist()):
            at = begins[r]
            for s in (a, b):
                if s < self.base:
                    pool[at] = s
                    at += 1
                else:
                    n = self.lengths[s - self.base]
                    pool[at:at + n] = pool[begins[s - self.base]:begins[s - self.base] + n]
                    at += n
        return pool, begins

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        known = np.concatenate((self.lengths.astype(np.int64), [1]))
        return known[np.where(symbols >= self.base, symbols.astype(np.int64) - self.base, len(self.lengths))]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.rules):
            return symbols.astype(np.uint32)
        pool, begins = self.pool()
        terminals = np.arange(self.base, dtype=np.uint32)
        both = np.concatenate((terminals, pool))
        size = self.sizes(symbols)
        first = np.where(symbols >= self.base, self.base + begins[np.maximum(symbols.astype(np.int64) - self.base, 0)], symbols.astype(np.int64))
        ends = np.cumsum(size)
        return both[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the text that ``symbols`` stand for, expanding only the symbols that hold them."""
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before:stop - before]


def _cells(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _CELL_BITS)


def _frequent_pairs(pairs: np.ndarray, cells: np.ndarray, limit: int, least: int) -> np.ndarray:
    """The at most ``limit`` most frequent of the coded pairs that occur ``least`` times, most frequent first.

    Of pairs that share a cell of the counting table only the first is taken; the other may follow in the next round."""
    heavy = np.bincount(cells, minlength=1 << _CELL_BITS) >= least  # a cell counts no less than any of its pairs
    values, counts = np.unique(pairs[heavy[cells]], return_counts=True)
    good = (counts >= least) & (values >> np.uint32(16) != END) & (values & np.uint32(0xFFFF) != END)
    values, counts = values[good], counts[good]
    values = values[np.lexsort((values, -counts))]
    return values[np.sort(np.unique(_cells(values), return_index=True)[1])[:limit]]


def repair(ids: np.ndarray, base: int, per_round: int = RULES_PER_ROUND, least: int = MIN_COUNT) -> tuple[np.ndarray, Grammar]:
    """Re-Pair: in each round the most frequent pairs become new symbols and are replaced from left to right, until no pair occurs
    ``least`` times or the symbols, which stay below 65,536, are used up.

    Replacing many pairs in a round keeps the number of passes small; where marked pairs overlap, every second one of the
    run is replaced. Pairs with the end id stay apart, also where it is a token of a text.
    """
    seq, rules = ids.astype(np.uint16), []
    size_of = np.ones(1 << 16, dtype=np.uint32)
    while True:
        first, room = base + len(rules), min(per_round, (1 << 16) - base - len(rules))
        if room <= 0 or len(seq) < 2:
            break
        pairs = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        cells = _cells(pairs)
        chosen = _frequent_pairs(pairs, cells, room, least)
        if not len(chosen):
            break
        slot = np.full(1 << _CELL_BITS, -1, dtype=np.int32)
        slot[_cells(chosen)] = np.arange(len(chosen))
        place = slot[cells]
        at = np.flatnonzero(place >= 0)
        place = place[at]
        hit = chosen[place] == pairs[at]
        at, place = at[hit], place[hit]
        # runs of overlapping marks: keep the first, third, ...
        fresh = np.concatenate(([True], np.diff(at) > 1))
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - run_start) % 2 == 0
        at, place = at[keep], place[keep]
        a, b = (chosen >> np.uint32(16)).astype(np.int64), (chosen & np.uint32(0xFFFF)).astype(np.int64)
        size_of[first:first + len(chosen)] = size_of[a] + size_of[b]
        rules += list(zip(a.tolist(), b.tolist()))
        seq[at] = (first + place).astype(np.uint16)
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        seq = seq[stays]
    return seq, Grammar(base, np.array(rules, dtype=np.uint16).reshape(-1, 2), size_of[base:base + len(rules)].copy())


def _block_row(shard: int, block: int, base: int, docs: list, ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    flat, n_ids = np.concatenate(ids), np.concatenate(counts)
    symbols, grammar = repair(flat, base)
    # symbols of each document by what they expand to: the end id may also be an ordinary token of a text
    ends = np.searchsorted(np.cumsum(grammar.sizes(symbols)), np.cumsum(n_ids))
    row = {"shard": shard, "block": block, "n_docs": len(docs), "n_tokens": len(flat), "base": base,
           "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_null": np.array([d is None for d in docs], np.uint8).tobytes(),
           "doc_tokens": n_ids.astype("<u4").tobytes(), "doc_symbols": np.diff(np.concatenate(([-1], ends))).astype("<u4").tobytes(),
           "rules": grammar.rules.astype("<u2").tobytes(), "lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, end id appended, and write the ids in ascending id order (nulls last) to ``path``.

    Documents are range-sorted by id; each part is a shard, cut into blocks of whole documents with a grammar each, so a
    task holds one block. Null texts are empty: their one id is the end id. Rows that repeat an id follow one another.
    """
    tokenizer = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, shard = None, 0, 0
        docs_, ids, counts, held = [], [], [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                if encoder is None:
                    from pyspark import TaskContext
                    shard, encoder = TaskContext.get().partitionId(), WordEncoder.of(tokenizer)
                    base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
                    if base > (1 << 16) - 256:
                        raise ValueError("the file's symbols have 16 bits, too few for this vocabulary and rules")
                flat, n = encoder.encode(texts_of(part))
                docs_ += part.column(0).to_pylist()
                ids.append(flat)
                counts.append(n)
                held += len(flat)
                if held >= block_ids:
                    yield _block_row(shard, block, base, docs_, ids, counts)
                    block, docs_, ids, counts, held = block + 1, [], [], [], 0
        if docs_:
            yield _block_row(shard, block, base, docs_, ids, counts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [*order_columns(["id"]), F.length("text").asc_nulls_first()]
    (rows.repartitionByRange(partitions(docs.sparkSession), *order_columns(["id"])).sortWithinPartitions(*order)
     .mapInArrow(encode, FILE_DDL).write.parquet(path))


def decode_block(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids of one block of the file."""
    grammar = Grammar(row["base"], np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"))
    ids = grammar.expand(np.frombuffer(row["symbols"], "<u2"))
    names = np.frombuffer(row["doc_ids"], "<i8").tolist()
    null = np.frombuffer(row["doc_null"], np.uint8)
    return [None if z else d for d, z in zip(names, null)], np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64), ids


def read_tokens(row: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the ``doc``-th document of a block, expanding only the symbols needed."""
    grammar = Grammar(row["base"], np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"))
    per_doc = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    first = int(per_doc[:doc].sum())
    symbols = np.frombuffer(row["symbols"], "<u2")[first:first + per_doc[doc]]
    return grammar.slice(symbols, start, int(np.frombuffer(row["doc_tokens"], "<u4")[doc]) if stop is None else stop)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32, shard, block.

    Blocks are decoded in Arrow batches; the ids before each shard are a running sum over one small row per shard.
    """
    blocks = spark.read.schema(FILE_DDL).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs, n, ids = decode_block(row)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                sums = [zlib.crc32(raw[4 * (b - c):4 * b]) for b, c in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_pydict({"id": pa.array(docs, pa.int64()), "inside": pa.array(ends - n), "n_tokens": pa.array(n),
                                                  "ids_crc32": pa.array(sums, pa.int64()), "shard": pa.array([row["shard"]] * len(docs), pa.int32()),
                                                  "block": pa.array([row["block"]] * len(docs), pa.int32())})

    totals = blocks.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    per_shard = totals.groupBy("shard").agg(F.sum("n").alias("n"))  # one row per write task
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = per_shard.select("shard", before(Window.orderBy("shard")).alias("_shard_start"))
    inner = totals.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("_block_start"))
    starts = inner.join(shards, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_block_start")).alias("_start"))
    docs = blocks.mapInArrow(decode, "id long, inside long, n_tokens long, ids_crc32 long, shard int, block int")
    return docs.join(starts, ["shard", "block"]).select(
        F.col("id").alias(id_col), (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
