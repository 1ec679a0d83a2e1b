"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, run once along each text.

A benchmark too large for one automaton in memory is dealt over several, which run over each slice of texts in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, byte_table, slices, text_buffer
from corpusmill.session import cut_lineage, release

WINDOW = 10
#: One automaton holds items of about so many words; a larger benchmark is dealt over several.
MOST_WORDS = 60_000
#: Texts are worked through in batches of about so many bytes; with several automata, in slices of so many.
BATCH_BYTES, SLICE_OF_PARTS = 1 << 20, 16 << 20
NORMAL = bytes(byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, other=32).tolist())
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Matcher:
    """Finds every occurrence of every window of the items in a list of words.

    A word of the items is written as three characters, the first from an alphabet of its own, so that
    matches begin at words; any other word is one character that no window has.
    """

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        self.ids: list[str] = []
        windows: dict[tuple[bytes, ...], list[int]] = {}
        vocabulary: dict[bytes, int] = {}
        for name, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(name)
            for i in range(max(1, len(words) - WINDOW + 1)):
                windows.setdefault(tuple(words[i : i + WINDOW]), []).append(at)
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        self.code = {w: chr(0x400 + (i >> 12)) + chr(0x100 + (i >> 6 & 63)) + chr(0x100 + (i & 63)) for w, i in vocabulary.items()}
        self.automaton = ahocorasick.Automaton() if windows else None
        for w, at in windows.items():
            self.automaton.add_word("".join([self.code[x] for x in w]), (len(w), tuple(dict.fromkeys(at))))
        if windows:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words that a window covers (not merged), and the items whose windows occur."""
        if self.automaton is None or not words:
            return [], set()
        get = self.code.get
        line = [get(w, "\0") for w in words]
        found = list(self.automaton.iter("".join(line)))
        if not found:
            return [], set()
        ends = np.cumsum([len(x) for x in line]) - 1
        last = np.searchsorted(ends, [e for e, _ in found]).tolist()
        return [(i - n + 1, i + 1) for i, (_, (n, _)) in zip(last, found, strict=True)], {self.ids[k] for _, (_, at) in found for k in at}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# a run of hit words: its first word and the word after it, and where those begin and end in the text
PLACES = ("start", "end", "first", "last")
RANGE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in PLACES]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("words_hit", RANGE), T.StructField("items", T.ArrayType(T.StringType()))]
ARROW_RANGE = pa.list_(pa.struct([(n, pa.int64()) for n in PLACES]))


def _places(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as places in the text as it was, in characters."""
    if not ranges:
        return []
    where = np.array([m.span() for m in WORD.finditer(raw)], np.int64)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=chars[1:])
    r = np.array(ranges, np.int64)
    first, last = chars[where[r[:, 0], 0]], chars[where[r[:, 1] - 1, 1]]
    return [dict(zip(PLACES, x, strict=True)) for x in np.stack([r[:, 0], r[:, 1], first, last], axis=1).tolist()]


def _scan(docs: DataFrame, text_col: str, parts: list[Broadcast]) -> DataFrame:
    """docs with what the items of all parts hit. Texts are read once; where there are several parts, a slice of
    texts stays in memory while one part's automaton after another is built and run over it."""
    at = docs.columns.index(text_col)

    def judged(batches: list[pa.RecordBatch], matchers: Iterable[Matcher]) -> Iterator[pa.RecordBatch]:
        raw = [[x.as_py() or b"" for x in b.column(at).cast(pa.large_binary())] for b in batches]
        n = [[0] * len(own) for own in raw]
        ranges: list[list[list]] = [[[] for _ in own] for own in raw]
        names: list[list[set]] = [[set() for _ in own] for own in raw]
        for matcher in matchers:
            for k, own in enumerate(raw):
                for i, text in enumerate(own):
                    words = words_of(text)
                    n[k][i] = len(words)
                    hit, items = matcher.find(words)
                    if hit:
                        ranges[k][i] += merge(hit)
                        names[k][i] |= items
        for k, b in enumerate(batches):
            hit = [_places(text, merge(r)) for text, r in zip(raw[k], ranges[k], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n[k], pa.int64()), pa.array(hit, ARROW_RANGE), pa.array([sorted(x) for x in names[k]], pa.list_(pa.string()))], [*b.schema.names, "n_words", "words_hit", "items"])

    def run(batches):
        if len(parts) == 1:
            matcher = Matcher(parts[0].value)
            for b in batches:
                for first, stop in slices(b.column(at), BATCH_BYTES):
                    yield from judged([b.slice(first, stop - first)], [matcher])
            return
        def each():
            for p in parts:
                yield Matcher(p.value)
                vars(p).pop("_value", None)  # read again for the next slice: one part is in memory at a time

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(text_buffer(b.column(at))[0])
            if size >= SLICE_OF_PARTS:
                yield from judged(held, each())
                held, size = [], 0
        if held:
            yield from judged(held, each())

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *FOUND]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids as text), spans (of the hit words, in characters of the text) and contaminated.

    A null text has no words, an item without words has no window, a null item id reads as empty text,
    and repeated items count once. Texts are scanned once, whatever the benchmark's size: its items are
    collected and sent about `most_words` words at a time (a long item in pieces that overlap by a window
    less a word), and the automata of several parts run over each slice of texts in turn. Columns of docs
    with the new names are replaced.
    """
    new = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated", "words_hit"]
    docs = docs.drop(*new)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    step = max(1, most_words // 4)

    def cut(batches):
        for b in batches:
            ids, pieces = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                words = words_of(text.as_py() or b"")
                for i in range(0, max(1, len(words) - WINDOW + 1), step):
                    ids.append(name)
                    pieces.append(b" ".join(words[i : i + step + WINDOW - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.string())], ["id", "text"])

    items = cut_lineage(items.mapInArrow(cut, "id string, text string").where("text <> ''"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (6 * most_words)))
    own = lambda k: [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()]
    found = _scan(docs, text_col, [docs.sparkSession.sparkContext.broadcast(own(k)) for k in range(parts)])
    release(items)
    hit = F.aggregate("words_hit", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    spans = F.transform("words_hit", lambda x: F.struct(x["first"].alias("start"), x["last"].alias("end")))
    return found.withColumns({"n_hit": hit, "spans": spans, "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0).drop("words_hit")


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = find_contamination(rows, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - {WINDOW - 1}))) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT item, list_slice(ws, k, k + {WINDOW - 1}) AS win FROM i),
n AS (SELECT DISTINCT len(win) AS n FROM w),
p AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM d CROSS JOIN n WHERE len(ws) >= n),
m AS (SELECT p.doc_id, p.k, p.n, w.item FROM p JOIN w ON list_slice(p.ws, p.k, p.k + p.n - 1) = w.win),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS place FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
