"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of a table, found by hashes of the whole word and of its
first four and five bytes, so that inflected forms of a word share most of it. Scripts without spaces are
cut into characters, each standing for its pair with the next one and for itself. Filters one, two and
three words wide slide over the whole text (each ends at a word; padding after a text keeps filters
inside it); the largest response of each filter over the text feeds a logistic output. The embeddings
start from each row's document-frequency log-odds in the training rows, then everything is trained
together by gradient descent. A threshold for each language is calibrated on rows set aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, byte_table, fold, slices, span_hashes, spans, text_buffer

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PAD_ROW = 3 * BUCKETS
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: At most so many labelled rows of either label are used to train and calibrate.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: A calibration language needs so many rows of either label, else 0.5 stands.
LEAST = 20
EPOCHS = 12
#: letters, digits, and every byte of other scripts
WORD = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

#: First and one past the last code point of scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Han, half-width kana, further Han.
UNSPACED = np.array([0x0E00, 0x0F00, 0x1000, 0x10A0, 0x1780, 0x1800, 0x3040, 0x3130, 0x3400, 0xA000, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B170, 0x20000, 0x40000])


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with runs of UNSPACED cut into characters: starts, ends (a character's are those of its pair), and where its shorter forms end."""
    lead = np.flatnonzero(data >= 0xE0)
    a, b, c = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
    first = data[lead].astype(np.int64)
    code = np.where(first < 0xF0, (first & 15) << 12 | a << 6 | b, (first & 7) << 18 | a << 12 | b << 6 | c)
    own = np.searchsorted(UNSPACED, code, "right") % 2 == 1
    lead, first = lead[own], first[own]
    if not len(lead):
        return start, end, np.minimum(start + 4, end), np.minimum(start + 5, end)
    stop = lead + np.where(first < 0xF0, 3, 4)
    begin = np.unique(np.concatenate([start, lead, stop[stop < end[np.searchsorted(start, lead, "right") - 1]]]))
    run = np.searchsorted(start, begin, "right") - 1
    upto = np.minimum(np.append(begin[1:], len(data)), end[run])
    one = np.isin(begin, lead)
    pair = np.append(one[:-1] & one[1:] & (run[:-1] == run[1:]), False)
    whole = np.where(pair, np.append(upto[1:], 0), upto)
    return begin, whole, np.where(one, upto, np.minimum(begin + 4, upto)), np.where(one, upto, np.minimum(begin + 5, upto))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words, (3, words and padding), and where each text begins; PAD_ROW fills PAD places after each text."""
    data, at = text_buffer(texts)
    low = WORD[data]
    start, *ends = _cut(data, *spans(low > 0, at))
    first = np.append(np.searchsorted(start, at[:-1]), len(start))
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    place = np.arange(len(start)) + PAD * text
    out = np.full((3, len(start) + PAD * (len(at) - 1)), PAD_ROW, np.int32)
    for i, stop in enumerate(ends):
        h = span_hashes(low, start, stop) + np.uint64(i)
        out[i, place] = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + i * BUCKETS
    return out, first + PAD * np.arange(len(at))


@dataclass
class Net:
    embed: np.ndarray  # (3 * BUCKETS + 1, DIM); the last row, for padding, is zero
    kernel: list[np.ndarray]  # for each width (width, DIM, FILTERS); row o looks o words back
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float

    def responses(self, rows: np.ndarray) -> list[np.ndarray]:
        """(places, FILTERS) for each width."""
        e = self.embed[rows[0]]
        e += self.embed[rows[1]]
        e += self.embed[rows[2]]
        out = []
        for k in self.kernel:
            x = e @ k[0]
            for o in range(1, min(len(k), len(e))):
                x[o:] += e[:-o] @ k[o]
            out.append(x)
        return out

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = [np.maximum(np.maximum.reduceat(x, at[:-1], axis=0) + b, 0) for x, b in zip(self.responses(rows), self.bias, strict=True)]
        return np.concatenate(top, axis=1) @ self.out + self.shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, stop in slices(texts):
            out[first:stop] = self.logits(*word_rows(texts[first:stop]))
        return sigmoid(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


class Adam:
    def __init__(self):
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.n = 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows=...) -> None:
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.999 * v[rows] + 0.001 * grad**2
        value[rows] -= rate * (m[rows] / (1 - 0.9**self.n)) / (np.sqrt(v[rows] / (1 - 0.999**self.n)) + 1e-8)


def log_odds(docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How much likelier a toxic document is to hold each row than a clean one, shrunk where counts are small."""
    df = np.zeros((2, 3 * BUCKETS + 1))
    for x, y, w in zip(docs, label, weight, strict=True):
        df[int(y), np.unique(x)] += w
    n = np.array([weight[label == 0].sum(), weight[label == 1].sum()])
    odds = np.log((df[1] + 0.2) / (n[1] + 0.4)) - np.log((df[0] + 0.2) / (n[0] + 0.4))
    doubt = np.sqrt(1 / (df[1] + 0.2) + 1 / (df[0] + 0.2))
    odds = np.clip(odds, -6, 6) * np.clip(np.abs(odds) / (2 * doubt), 0, 1)
    odds[-1] = 0
    return odds


def train(docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Net:
    """Fits the net to documents given as padded rows; weight undoes the sampling of labels."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (3 * BUCKETS + 1, DIM)).astype(np.float32)
    embed[:, 0] = log_odds(docs, label, weight) / 4
    embed[-1] = 0
    kernel, bias = [], []
    for w in WIDTHS:
        k = rng.normal(0, 0.15, (w, DIM, FILTERS))
        k[:, 0] += 0.5 / w
        kernel.append(k.astype(np.float32))
        bias.append(np.full(FILTERS, -0.1, np.float32))
    net = Net(embed, kernel, bias, np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -3.0)
    shift, adam = np.array([net.shift]), Adam()
    for epoch in range(EPOCHS):
        rate = 0.02 * 0.7**epoch
        order = rng.permutation(len(docs))
        for a in range(0, len(order), 64):
            own = order[a : a + 64]
            rows = np.concatenate([docs[i] for i in own], axis=1)
            at = np.cumsum([0, *(docs[i].shape[1] for i in own)])
            y, w = label[own].astype(float), weight[own]
            tops, hidden = [], []
            for x, b in zip(net.responses(rows), net.bias, strict=True):
                top = np.array([x[s:e].argmax(axis=0) + s for s, e in zip(at[:-1], at[1:], strict=True)])
                tops.append(top)
                hidden.append(np.take_along_axis(x, top, axis=0) + b)
            h = np.concatenate(hidden, axis=1)
            act = np.maximum(h, 0)
            d = (sigmoid(act @ net.out + shift[0]) - y) * w / w.sum()
            dh = np.where(h > 0, d[:, None] * net.out, 0).astype(np.float32)
            adam.n += 1
            moved, grads = [], []
            for i, width in enumerate(WIDTHS):
                own_d, gk = dh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(net.kernel[i])
                for o in range(width):
                    r = rows[:, np.maximum(tops[i] - o, 0)]
                    r[:, tops[i] < o] = PAD_ROW
                    gk[o] = np.einsum("nfd,nf->df", net.embed[r].sum(axis=0), own_d)
                    moved.append(r.reshape(3, -1))
                    grads.append((own_d[:, :, None] * net.kernel[i][o].T[None]).reshape(-1, DIM))
                adam.step(f"k{i}", net.kernel[i], gk + 1e-4 * net.kernel[i], rate)
                adam.step(f"b{i}", net.bias[i], own_d.sum(axis=0), rate)
            at_row, back = np.unique(np.concatenate(moved, axis=1).ravel(), return_inverse=True)
            g = np.zeros((len(at_row), DIM), np.float32)
            np.add.at(g, back, np.tile(np.concatenate(grads), (3, 1)))
            real = at_row != PAD_ROW
            adam.step("embed", net.embed, g[real], rate * 0.2, at_row[real])
            adam.step("out", net.out, (act.T @ d + 1e-4 * net.out).astype(np.float32), rate)
            adam.step("shift", shift, np.array([d.sum()]), rate)
    net.shift = float(shift[0])
    return net


@dataclass
class Model:
    net: Net
    threshold: dict[str, float]  # by language; 0.5 for any other


def calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language with enough rows set aside, the threshold of the best F1; among equals that nearest to 0.5."""
    out = {}
    own_langs = np.array([x or "" for x in langs], object)
    for name in sorted({x for x in langs if x}):
        own = own_langs == name
        s, y, w = score[own], label[own], weight[own]
        if min((y == 1).sum(), (y == 0).sum()) < LEAST:
            continue
        best = (-1.0, 0.0, 0.5)
        for t in np.unique(np.append(np.round(np.quantile(s, np.linspace(0, 1, 201)), 4), 0.5)):
            if not 0.2 <= t <= 0.8:
                continue
            hit = (w * (s >= t) * (y == 1)).sum()
            f1 = 2 * hit / max((w * (s >= t)).sum() + (w * (y == 1)).sum(), 1e-9)
            best = max(best, (round(f1, 6), -abs(t - 0.5), float(t)))
        out[name] = best[2]
    return out


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model | None:
    """Trains on a bounded sample of labelled rows (MAX_TOXIC and MAX_CLEAN, by a hash of the id); None if a label is missing.

    A document with several labels counts as toxic if one says so; null labels and labels without a document
    are ignored, and null ids have none. Rows that repeat an id count once, with the smallest lang and words.
    Other columns are not read, whatever their names; an empty table trains nothing. A fifth of
    the sample is set aside to calibrate thresholds by lang, which no score depends on.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    if where is not None:
        marks = labels.where(where).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    held = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not held.get(0) or not held.get(1):
        return None
    pick = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = pick[0].unionByName(pick[1])  # at most MAX_TOXIC + MAX_CLEAN ids

    def ids_of(batches):
        for b in batches:
            out = []
            for first, stop in slices(b.column(3)):
                ids, at = word_rows(b.column(3)[first:stop])
                out += [ids[:, s : e - PAD].astype(np.uint16).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["mark", "y", "lang", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(chosen), "id")
    rows = rows.select(F.xxhash64("id").alias("mark"), "y", "lang", "text").mapInArrow(ids_of, "mark long, y int, lang string, ids binary")
    first = F.min(F.struct("lang", "ids")).alias("first")
    sample = rows.groupBy("mark", "y").agg(first).select("mark", "y", "first.lang", "first.ids").toArrow()  # as many rows as ids were chosen
    got: dict[int, tuple] = {}
    for mark, y, lang, ids in zip(*(sample[c].to_pylist() for c in ("mark", "y", "lang", "ids")), strict=True):
        got[mark] = (y, lang, ids)
    marks_in_order = sorted(got)
    label = np.array([got[k][0] for k in marks_in_order], int)
    if len(set(label.tolist())) < 2:
        return None
    langs = [got[k][1] for k in marks_in_order]
    texts = []
    for k in marks_in_order:  # rows travel without their table and padding
        x = np.frombuffer(got[k][2], np.uint16).reshape(3, -1).astype(np.int32) + np.arange(3, dtype=np.int32)[:, None] * BUCKETS
        texts.append(np.pad(x, ((0, 0), (0, PAD)), constant_values=PAD_ROW))
    del got
    share = np.array([held[0] / max((label == 0).sum(), 1), held[1] / max((label == 1).sum(), 1)])
    weight = share[label] / share[label].mean()
    aside = np.arange(len(label)) % 5 == 4
    net = train([t for t, x in zip(texts, aside, strict=True) if not x], label[~aside], weight[~aside])
    score = np.zeros(len(label))
    for i in np.flatnonzero(aside):
        score[i] = sigmoid(net.logits(texts[i], np.array([0, texts[i].shape[1]])))[0]
    return Model(net, calibrate(score[aside], label[aside], weight[aside], [x for x, a in zip(langs, aside, strict=True) if a]))


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with score (0 to 1), threshold (of its lang, else 0.5) and toxic (score reaches it).

    Whole texts are scored; null counts as empty. Without a model every score is 0. Columns of these
    names are replaced; an empty table gives no rows. The broadcast net has a fixed size.
    """
    docs = docs.drop("score", "threshold", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            score = sent.value.net.scores(b.column(at)) if sent.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    limit = F.lit(0.5)
    for name, t in (model.threshold if model else {}).items():
        limit = F.when(F.col(lang_col) == name, F.lit(t)).otherwise(limit)
    return out.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    model = fit(docs, labels, fold("doc_id", 5) != 0)
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"), "lang")
    out = score_toxicity(rows, model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold", "toxic")
