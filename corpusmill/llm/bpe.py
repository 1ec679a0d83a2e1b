"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last 48 bytes has certain bits zero, so equal passages are cut
alike wherever they stand. Each chunk is encoded by itself, once, and kept; a chunk met again, in the same
text or another, is not encoded again. By itself a chunk may come out wrong at its ends, where a word is cut
through. Each join is therefore encoded anew by the library, from some words before it to some words after
it, and what comes out must begin with the ids that the left chunk has for the first of these words and end
with those that the right chunk has for the last; if it does not, twice as many words are taken, until both
ends agree or the text is encoded as a whole. The ids between the agreeing words replace those of the chunks.
Chunks of a few words go together with their neighbour, so a passage without white space is one chunk.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, mix, _power, slices, text_buffer

ROLL = 48
#: Chunks are about two to this power bytes on average, and have so many words at least.
CHUNK_BITS, LEAST_WORDS = 9, 4
#: A worker keeps encodings of about so many bytes of chunks and so many words; the oldest go first.
KEEP_BYTES = 24 << 20
BATCH_BYTES = 1 << 20
KEEP_WORDS = 400_000
#: What a kept chunk takes beside its ids and counts, and how many texts the library gets at once.
ENTRY, AT_ONCE = 400, 2048
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    split = json.dumps(spec.get("pre_tokenizer") or {})
    if '"Removed"' not in split or "\\\\s" not in split:
        raise ValueError("chunk joins are repaired at white space: the tokenizer must drop it")
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec)


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where chunks end: the rolling hash of the ROLL bytes before has CHUNK_BITS zero bits, or a text ends. Never inside a character."""
    n = len(data)
    p, q = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64, out=total[1:])
    end = np.arange(ROLL, n)
    h = mix((total[end] - total[end - ROLL]) * q[end - ROLL])
    end = end[(h >> np.uint64(64 - CHUNK_BITS)) == 0]
    end = end[(data[end] & 0xC0) != 0x80]
    text = np.searchsorted(at, end, side="right") - 1
    end = end[end - at[text] >= ROLL]  # the window lies in one text
    return np.unique(np.concatenate([end, at[1:]]))


class Encoder:
    """Exact ids of texts. One to a worker process; its stores are bounded."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: OrderedDict[bytes, tuple[bytes, array]] = OrderedDict()
        self.kept = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [(self.tokenizer.id_to_token(i) or "") for i in range(size)]

    def _ids(self, pieces: list[list[bytes]]) -> list[tuple[bytes, array]]:
        """The ids of each piece, given as its words, and how many ids each word has; words not yet known are encoded in one batch."""
        if len(self.words) > KEEP_WORDS:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        new: dict[bytes, None] = {}
        for piece in pieces:
            for w in piece:
                if w not in words:
                    if (x := older.get(w)) is not None:
                        words[w] = x
                    else:
                        new[w] = None
        for w, ids in zip(new, self._library([*new]), strict=True):
            words[w] = ids
        get, out = words.__getitem__, []
        for piece in pieces:
            found = [*map(get, piece)]
            out.append((b"".join(found), array("I", [len(x) >> 2 for x in found])))
        return out

    def _library(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(texts), AT_ONCE):  # the library's results are many times as large as the ids
            got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[a : a + AT_ONCE]], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in got]
        return out

    @staticmethod
    def _chunks(at: np.ndarray, data: np.ndarray) -> tuple[list[int], list[int], list[int], np.ndarray]:
        """Where chunks begin and end, the text of each, and where words begin; a chunk of few words goes together with its neighbour."""
        end = cuts(data, at)
        start = np.append(0, end[:-1])
        word = ~SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[start] = word[start]
        total = np.append(0, np.cumsum(first))
        n = (total[end] - total[start]).tolist()
        inside = np.zeros(len(start), bool)  # a word is cut through where the chunk begins
        inside[1:] = word[start[1:] - 1] & word[start[1:]]
        inside, text = inside.tolist(), (np.searchsorted(at, start, side="right") - 1).tolist()
        s, e, t, words = [], [], [], 0
        for a, b, own, k, through in zip(start.tolist(), end.tolist(), text, n, inside, strict=True):
            if t and t[-1] == own and (words < LEAST_WORDS or k < LEAST_WORDS):
                e[-1] = b
                words += k - through
            else:
                s.append(a)
                e.append(b)
                t.append(own)
                words = k
        first[start] &= ~np.array(inside)
        first[s] = word[s]
        return s, e, t, np.flatnonzero(first)

    def _by_chunk(self, raw: bytes, start: list[int], end: list[int]) -> list[tuple[bytes, array]]:
        """Each chunk's ids by itself, from the store where it was met before."""
        out: list[tuple[bytes, array] | int] = []
        pieces: list[list[bytes]] = []
        fresh: dict[bytes, int] = {}
        for s, e in zip(start, end, strict=True):
            body = raw[s:e]
            key = xxhash.xxh3_128_digest(body)
            known = self.chunks.get(key)
            if known is not None:
                self.chunks.move_to_end(key)
                out.append(known)
            elif key in fresh:
                out.append(fresh[key])
            else:
                out.append(len(pieces))
                fresh[key] = len(pieces)
                pieces.append(body.split())
        found = self._ids(pieces)
        for key, i in fresh.items():
            self.chunks[key] = found[i]
            self.kept += 4 * len(found[i][1]) + len(found[i][0]) + ENTRY
        while self.kept > KEEP_BYTES and self.chunks:
            _, (ids, counts) = self.chunks.popitem(last=False)
            self.kept -= 4 * len(counts) + len(ids) + ENTRY
        return [x if isinstance(x, tuple) else found[x] for x in out]

    def _joins(self, raw: bytes, joins: list[int], chunks: list[tuple[bytes, array]], begins: np.ndarray, starts: list[int]) -> dict[int, tuple[int, bytes, int]]:
        """For each join (the number of its left chunk): how many bytes of ids go at the left chunk's end, what stands in their
        place, and how many go at the right chunk's start. A join that never agrees is left out."""
        done: dict[int, tuple[int, bytes, int]] = {}
        k = 2
        while joins:
            joins = [i for i in joins if len(chunks[i][1]) >= 2 * k and len(chunks[i + 1][1]) >= 2 * k]
            middle = np.searchsorted(begins, [starts[i + 1] for i in joins])  # the first word that begins in the right chunk
            windows = [raw[a:b] for a, b in zip(begins[middle - k].tolist(), begins[np.minimum(middle + k, len(begins) - 1)].tolist(), strict=True)]
            left = []
            for i, got in zip(joins, self._library(windows), strict=True):
                (ids, counts), (next_ids, next_counts) = chunks[i], chunks[i + 1]
                out, into = 4 * sum(counts[1 - k :]), 4 * sum(next_counts[: k - 1])
                a, b = 4 * counts[-k], 4 * next_counts[k - 1]
                agrees = len(got) >= a + b and got[:a] == ids[len(ids) - out - a : len(ids) - out] and got[len(got) - b :] == next_ids[into : into + b]
                if agrees:
                    done[i] = (out, got[a : len(got) - b], into)
                else:
                    left.append(i)
            joins, k = left, 2 * k
        return done

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (null: none) and where each begins."""
        data, at = text_buffer(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        start, end, text, begins = self._chunks(at, data)
        chunks = self._by_chunk(raw, start, end)
        joins = [i for i in range(len(start) - 1) if text[i] == text[i + 1]]
        repaired = self._joins(raw, joins, chunks, begins, start)
        whole = {text[i] for i in joins if i not in repaired}
        parts: list[bytes] = []
        size = [0] * (len(at) - 1)
        before = 0
        for i, (ids, _) in enumerate(chunks):
            own = text[i]
            if own in whole:
                if i == 0 or text[i - 1] != own:
                    parts += self._library([raw[at[own] : at[own + 1]]])
                    size[own] = len(parts[-1]) >> 2
                continue
            join = repaired.get(i) if i + 1 < len(text) and text[i + 1] == own else None
            if join is None:
                piece = ids[before:] if before else ids
                before = 0
            else:
                piece = ids[before : len(ids) - join[0]] + join[1]
                before = join[2]
            parts.append(piece)
            size[own] += len(piece) >> 2
        return np.frombuffer(b"".join(parts), np.uint32), np.append(0, np.cumsum(np.array(size, np.int64)))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        token = self.token
        return " ".join([token[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = xxhash.xxh3_128_hexdigest(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int) and decoded (the text that the ids decode to).

    Whole texts; null counts as empty and has no ids; an empty table gives no rows. Columns of these
    names are replaced. The tokenizer's file is read on the driver and sent as text of fixed size.
    """
    docs = docs.drop("ids", "decoded")
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    at = docs.columns.index(text_col)

    def run(batches):
        own = encoder(sent.value)
        for b in batches:
            for first, stop in slices(b.column(at), BATCH_BYTES):
                part = b.slice(first, stop - first)
                ids, place = own.encode(part.column(at))
                every = ids.tolist()
                decoded = [own.decode(every[s:e]) for s, e in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
                column = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column, pa.array(decoded, pa.string())], [*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def op5(docs: DataFrame, path: str | None = None) -> DataFrame:
    bound_batches(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return encode(rows, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
