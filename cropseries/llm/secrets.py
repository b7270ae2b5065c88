"""Secret scans: patterns, and two character Markov models whose log-likelihood ratio tells random strings from identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import DENSE, dense_rows, dense_total, task_salt, text_slices, texts_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
#: Runs that the models judge: of letters, digits and the signs of base 64 and of names, padding at most at the end.
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Character -> state; 0 is any other character, which begins and ends strings. So a name of several words is judged by its words.
_STATE = np.zeros(256, dtype=np.int32)
_STATE[list(_CHARACTERS)] = np.arange(1, len(_CHARACTERS) + 1)
STATES = len(_CHARACTERS) + 1
CELLS = STATES ** 3
#: Log-likelihood ratio, in nats, from which a run is reported, and different characters that it has at least.
LEAST, DIFFERENT = 24.0, 6
#: Bytes of text whose triples are counted at once.
PIECE = 1 << 20


def base_matches(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _values(text: bytes, matches: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the secrets themselves lie: group 2 of assignments, else the whole match."""
    return [(m.start(2), m.end(2)) if kind == 0 and (m := _ASSIGN.match(text, start)) else (start, end) for start, kind, end in matches]


def triples(states: np.ndarray) -> np.ndarray:
    """Cell of each character given the two before it; what lies before the string's beginning doesn't count. State 0 has none."""
    one = np.concatenate(([0], states[:-1]))
    two = np.where(one == 0, 0, np.concatenate(([0, 0], states[:-2]))[:len(states)])
    return ((two * STATES + one) * STATES + states)[states > 0]


@dataclass
class SecretModel:
    """Log ratio of each character's probability in random strings and in identifiers, given the two characters before."""
    ratio: np.ndarray

    @staticmethod
    def of_counts(random: np.ndarray, ordinary: np.ndarray, smoothing: float = 0.5) -> SecretModel:
        """Smoothed with the less detailed model: a character given one before it, and that with the uniform one."""
        def log_probabilities(counts: np.ndarray) -> np.ndarray:
            table = counts.reshape(STATES, STATES, STATES)[:, :, 1:].astype(np.float64)
            # after one character: those at the start of a string (no character two before) count too
            pairs = table.sum(axis=0) + smoothing / (STATES - 1)
            pairs /= pairs.sum(axis=1, keepdims=True)
            weight = smoothing * (STATES - 1)
            full = (table + weight * pairs[None]) / (table.sum(axis=2, keepdims=True) + weight)
            return np.log(full)
        ratio = np.zeros((STATES, STATES, STATES), dtype=np.float32)
        ratio[:, :, 1:] = log_probabilities(random) - log_probabilities(ordinary)
        return SecretModel(ratio.ravel())

    def score(self, run: bytes) -> float:
        """Log-likelihood ratio of a string, signs left out."""
        return float(self.ratio[triples(_STATE[np.frombuffer(run, np.uint8)])].sum(dtype=np.float64))


def random_spans(text: bytes, base: list[tuple[int, int, int]], model: SecretModel, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the runs outside the pattern matches that the models take for random strings."""
    found, taken = [], sorted((start, end) for start, _, end in base)
    at = 0
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(start < m.end() and end > m.start() for start, end in taken[at:at + 4]):
            continue
        if len(set(m.group())) >= DIFFERENT and model.score(m.group()) >= least:
            found.append((m.start(), 3, m.end()))
    return found


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int64)))
    return [(int(before[start]), kind, int(before[end])) for start, kind, end in spans]


def _count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, extra) -> dense counts of triples: those of random strings, then those of ordinary ones."""
    tables = np.zeros(2 * CELLS, dtype=np.int64)

    def add(which: int, data: bytes) -> None:
        if which:
            data = _RUN.sub(b" ", data)
        found = triples(_STATE[np.frombuffer(data, np.uint8)])
        part = tables[which * CELLS:(which + 1) * CELLS]
        if len(found) > CELLS // 4:
            part += np.bincount(found, minlength=CELLS)
        else:
            np.add.at(part, found, 1)

    for batch in batches:
        for part in text_slices(batch, "text"):
            secrets, ordinary, held = [e.encode() for e in part.column(1).to_pylist() if e], [], 0
            for text in texts_of(part):
                at, base = 0, base_matches(text)
                for start, end in sorted(_values(text, base)):
                    secrets.append(text[start:end])
                    ordinary.append(text[at:start])
                    at = max(at, end)
                ordinary.append(text[at:])
                held += len(text)
                if held > PIECE:
                    add(1, b" ".join(ordinary))
                    ordinary, held = [], 0
            add(1, b" ".join(ordinary))
            add(0, b" ".join(secrets))
    yield from dense_rows(tables, task_salt())


def train_secret_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Count character triples of the labelled samples of all documents, in dense tables of fixed size that are added up.

    The patterns label: what they find is random. Other strings of the texts are ordinary where they are too short to be reported,
    so that secrets that no pattern finds don't teach the models that they are ordinary. Since the patterns find few alphabets, each document also gives four random strings drawn from the digests of its id: in lower- and upper-case
    hexadecimal digits, in base 64, and in letters and digits.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), key), 256)
    base64 = lambda k: F.rtrim(F.lit("="), F.base64(F.unhex(digest(k))))
    drawn = F.concat_ws(" ", digest(0), F.upper(digest(1)), base64(2), F.translate(base64(3), "+/", ""))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), drawn.alias("drawn"))
    total = dense_total(rows.mapInArrow(_count_samples, DENSE), 2 * CELLS)
    return SecretModel.of_counts(total[:CELLS], total[CELLS:])


SPANS = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans: array of struct(start, kind, end, kind_name), by start, then kind as in ``KINDS``.

    Spans are counted in code points, the end exclusive. ``assign`` is a match of a key word with its value (8 characters or more,
    ASCII letters of the key word in either case), ``access`` an AKIA key of 16 characters or more, ``hex`` a run of
    32 or more hexadecimal digits in lower case; per kind they are leftmost and don't overlap. ``random`` is a run of at least 16
    letters, digits and ``+/_-`` that touches none of them, holds a few different characters, and whose log-likelihood ratio
    between the two character models reaches ``least`` nats. Without ``model``, one is trained on ``docs``.

    Texts are judged where they lie, nothing but the models' counts (of fixed size) is shuffled, and the table of ratios of
    fixed size is broadcast. Null and empty texts have no spans; null ids and repeated rows are scanned as they are; an empty table gives no rows.
    """
    model = model or train_secret_model(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(KINDS, pa.string())
        for batch in batches:
            for part in text_slices(batch, "text"):
                spans, ends = [], [0]
                for text in texts_of(part):
                    base = base_matches(text)
                    spans += code_points(text, sorted(base + random_spans(text, base, shared.value, least)))
                    ends.append(len(spans))
                start, kind, end = (pa.array([s[k] for s in spans], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64())))
                found = pa.StructArray.from_arrays([start, kind, end, kinds.take(kind)], ["start", "kind", "end", "kind_name"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(scan, "id long, spans array<struct<start:long,kind:int,end:long,kind_name:string>>")
    return found.withColumnRenamed("id", id_col)


def secret_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of :func:`scan_secrets`: id, n_assign, n_access, n_hex, base_sha256 (of the pattern matches), spans (all, ``kind:start:end`` joined by commas)."""
    n = lambda name: F.size(F.filter("spans", lambda s: s["kind_name"] == name)).cast("long").alias(f"n_{name}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind_name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind_name"] != "random")
    return scanned.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
