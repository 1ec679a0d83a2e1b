"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, slices, sum_packed, text_buffer

SIZES = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Counts travel in pieces of so many buckets.
PIECE = 1 << 12
ALPHA = 0.5
UNKNOWN = "und"
_chars: list[np.ndarray] = []  # for each code point below 65,536: what it is folded to, and whether it is a letter


def _fold(c: int) -> tuple[int, bool]:
    """A letter as its lower-case code point; a mark as itself; anything else as a space. And whether it is a letter."""
    x = chr(c)
    kind = unicodedata.category(x)
    if kind[0] == "L":
        low = x.lower()
        return (ord(low) if len(low) == 1 else c), True
    return (c if kind[0] == "M" else 32), False


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points with one space around each text and each run of letters, where texts begin, and the letters of each text."""
    if not _chars:
        folded = [(32, False) if 0xD800 <= c < 0xE000 else _fold(c) for c in range(1 << 16)]
        _chars.extend([np.array([c for c, _ in folded], np.uint32), np.array([x for _, x in folded], bool)])
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = (data & 0xC0) != 0x80
    number = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=number[1:])
    start = number[at]
    plane = np.minimum(code, 0xFFFF)
    low, letter = _chars[0][plane], _chars[1][plane]
    for i in np.flatnonzero(code > 0xFFFF):
        low[i], letter[i] = _fold(int(code[i]))
    total = np.zeros(len(low) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    letters = np.diff(total[start])
    # a text's first character is preceded by a space that its predecessor's end also serves as
    text = np.repeat(np.arange(len(at) - 1), np.diff(start))
    padded = np.full(len(low) + len(at), 32, np.uint32)
    padded[np.arange(len(low)) + text + 1] = low
    edge = start + np.arange(len(at))
    keep = padded != 32
    keep[1:] |= padded[:-1] != 32
    keep[edge] = True
    kept, ends = np.flatnonzero(keep), np.zeros(len(padded), bool)
    ends[edge] = True
    last = kept[:-1][(padded[kept[:-1]] == 32) & ~ends[kept[:-1]] & ends[kept[1:]]]
    keep[last] = False  # a text that ends in spaces ends with its neighbour's
    place = np.zeros(len(padded) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return padded[keep], place[edge], letters


def grams(chars: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram at each place; those of spaces only are in the last bucket, which no text scores."""
    c = chars.astype(np.uint64)
    blank = chars == 32
    h = np.zeros(len(c), np.uint64)
    none = np.ones(len(c), bool)
    for n in range(1, max(SIZES) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]
        none = none[:m] & blank[n - 1 :]
        if n in SIZES:
            x = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out = (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) % (BUCKETS - 1)
            out[none] = BUCKETS - 1
            yield out


def _within(n: int, place: np.ndarray, total: int) -> np.ndarray:
    """Which n-gram starts stay inside one text; neighbours share the space between them."""
    ok = np.ones(max(total - n + 1, 0), bool)
    for k in range(1, n - 1):
        x = place[1:-1] - k
        ok[x[(x >= 0) & (x < len(ok))]] = False
    return ok


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (BUCKETS, languages) float32 log-probabilities; the last row is zero
    prior: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        for first, stop in slices(texts):
            data, at = text_buffer(texts[first:stop])
            chars, place, letters = characters(data, at)
            total = np.tile(self.prior, (stop - first, 1))
            for n, b in zip(SIZES, grams(chars), strict=False):
                b = np.where(_within(n, place, len(chars)), b, BUCKETS - 1)
                sums = np.zeros((len(b) + 1, len(self.langs)))
                np.cumsum(self.weight[b], axis=0, dtype=np.float64, out=sums[1:])
                total += np.diff(sums[np.minimum(place, len(b))], axis=0)
            total -= total.max(axis=1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            known = letters > 0
            names += [self.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            score[first:stop] = np.where(known, p[np.arange(len(best)), best], 0.0)
        return names, score


def fit(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts n-grams of every row of docs (that `where` allows) whose lang is not null; no such row: None.

    A task counts its rows by language and bucket and sends the counts, not the n-grams; the sums that
    reach the driver are BUCKETS numbers a language.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        number: dict[str, float] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for first, stop in slices(b.column(0)):
                own = langs[first:stop]
                for name in dict.fromkeys(own.tolist()):
                    data, at = text_buffer(b.column(0)[first:stop].filter(pa.array(own == name)))
                    chars, place, _ = characters(data, at)
                    total = counts.setdefault(name, np.zeros(BUCKETS))
                    number[name] = number.get(name, 0.0) + len(at) - 1
                    for n, g in zip(SIZES, grams(chars), strict=False):
                        total += np.bincount(g[_within(n, place, len(chars))], minlength=BUCKETS)
        part = TaskContext.get().partitionId()
        for name, x in counts.items():
            x[-1] = 0
            pieces = [(f"{i:05d} {name}", x[i * PIECE : (i + 1) * PIECE].tobytes()) for i in range(BUCKETS // PIECE)]
            pieces.append((f"prior {name}", np.array([number[name]]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.string()), pa.array([part] * len(pieces), pa.int64()), pa.array([v for _, v in pieces], pa.binary())], ["key", "part", "vec"])

    got = {r["key"]: np.frombuffer(bytes(r["vec"]), np.float64) for r in sum_packed(rows.mapInArrow(count, "key string, part long, vec binary")).collect()}
    langs = sorted(k[6:] for k in got if k.startswith("prior "))
    if not langs:
        return None
    counts = np.stack([np.concatenate([got[f"{i:05d} {x}"] for i in range(BUCKETS // PIECE)]) for x in langs], axis=1)
    smooth = counts[:-1] + ALPHA
    weight = np.zeros((BUCKETS, len(langs)), np.float32)
    weight[:-1] = np.log(smooth / smooth.sum(axis=0))
    prior = np.array([got[f"prior {x}"][0] for x in langs])
    return Model(langs, weight, np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, or `und` if text is null or has no letter) and score (its posterior; 0 for `und`).

    Whole texts are scored. Without a model every row is `und`. Columns of these names are replaced; an
    empty table gives no rows. The broadcast matrix has BUCKETS rows and a column a language.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if sent.value is None:
                names, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                names, score = sent.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    from corpusmill.llm.common import fold

    model = fit(docs, fold("doc_id", 4) != 2)
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
