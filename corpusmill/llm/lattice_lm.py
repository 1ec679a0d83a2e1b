"""Language-model scoring: the marginal probability of a text over all its segmentations into subwords.

The vocabulary is that of an existing subword model, with its scores as the first weights. Each word, led
by the vocabulary's word mark, is a lattice of the pieces that it holds, single bytes always among them,
and of one arc for the word as a whole; a forward recursion in log space adds up all paths. The piece
probabilities are fitted to the distinct training words by expectation-maximisation over the same
lattices. A whole-word arc has the word's training count less a discount, and the discounts of all
training words are what the subword paths share, so the sum over all words is one. A text's end is one
more word. Pieces do not cross words, so a text's probability is the product of its words' and the
end's, and each distinct word of the corpus is scored once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, byte_table, mix, _power, slices, span_hashes, sum_packed
from corpusmill.session import cut_lineage

MARK = "▁".encode()
LOWER = bytes(byte_table(lambda b: True).tolist())
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTH = 0.01
ALPHA = 0.1
#: A word with at least this share of all tokens is looked up in a broadcast table, which so has at most 1 / SHARE rows; words over LONGEST bytes stand there by a digest.
SHARE, LONGEST = 1e-6, 64
#: A task sends counts on whenever it holds so many distinct words, or so many bytes of them.
FLUSH, FLUSH_BYTES = 300_000, 32 << 20
#: Looked-up texts are sent on in batches of about so many bytes.
BATCH_BYTES = 1 << 20
#: Longer words are scored one by one, and counted by blocks of so many bytes, so many words of like length at a time.
BATCHED = 128
BLOCK, ABREAST = 1024, 32
LOG10 = math.log(10)
SLOT_BITS = 21


def table_key(word: bytes) -> bytes:
    """What a word is called in the broadcast table: itself, or a digest led by a space, which no word holds."""
    return word if len(word) <= LONGEST else b" " + blake2b(word, digest_size=16).digest()


class Lattice:
    """Pieces by hash, and their log-probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.stop = pieces, logp, math.log(0.3)
        self.longest = max(map(len, pieces))
        end = np.cumsum([len(x) for x in pieces])
        self.hash = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), np.append(0, end[:-1]), end)
        self.levels: list[np.ndarray] = []
        left = np.arange(len(pieces))
        while len(left):
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            slot = (self.hash[left] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            table[slot] = left
            left = left[table[slot] != left]
            self.levels.append(table)
        self.lookup = {x: i for i, x in enumerate(pieces)}

    @classmethod
    def load(cls, path: str) -> Lattice:
        """The pieces and scores of a sentencepiece model, with all 256 bytes as pieces.

        Scores of a unigram model are log-probabilities. A model whose scores are merge ranks gets
        weights by rank (Zipf's law). Control and unused pieces are left out.
        """
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[bytes, float] = {bytes([b]): -math.inf for b in range(256)}
        for i in range(s.get_piece_size()):
            if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i)) and s.get_score(i) > -1e8:
                score[s.id_to_piece(i).encode()] = s.get_score(i)
        known = np.array(list(score.values()))
        finite = known[np.isfinite(known)]
        if len(finite) and finite.min() < -1000:  # ranks
            known = -np.log(10 - known)
        floor = known[np.isfinite(known)].min() - 2
        known = np.where(np.isfinite(known), known, floor)
        return cls(list(score), known - np.logaddexp.reduce(known))

    def spans(self, words: np.ndarray) -> np.ndarray:
        """(n, length, longest): the piece that starts at each byte with each length, or -1. words: (n, length) bytes."""
        n, size = words.shape
        p, q = _power(size + 1)
        total = np.zeros((n, size + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * p[:size], axis=1, dtype=np.uint64, out=total[:, 1:])
        out = np.full((n, size, min(self.longest, size)), -1, np.int32)
        for k in range(1, out.shape[2] + 1):
            h = mix((total[:, k:] - total[:, : size + 1 - k]) * q[: size + 1 - k])
            slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            for table in self.levels:
                got = table[slot]
                ok = np.nonzero(got >= 0)
                found = got[ok]
                same = self.hash[found] == h[ok]
                out[ok[0][same], ok[1][same], k - 1] = found[same]
        return out

    def forward(self, spans: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths to each place; logp has -inf at its end for no piece."""
        n, size, most = spans.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for t in range(1, size + 1):
            s = np.arange(max(0, t - most), t)
            x = logp[spans[:, s, t - s - 1]] + alpha[:, s]
            top = x.max(axis=1)
            alpha[:, t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return alpha

    def backward(self, spans: np.ndarray, logp: np.ndarray) -> np.ndarray:
        n, size, most = spans.shape
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        for s in range(size - 1, -1, -1):
            k = np.arange(0, min(most, size - s))
            x = logp[spans[:, s, k]] + beta[:, s + k + 1]
            top = x.max(axis=1)
            beta[:, s] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return beta

    def _batches(self, words: list[bytes]):
        """(positions, (n, length) bytes) of words of one length; longer ones come alone."""
        size = np.array([len(w) for w in words])
        for k in np.unique(size).tolist():
            where = np.flatnonzero(size == k)
            step = max(1, (1 << 15) // (k + 3)) if k <= BATCHED else 1
            for a in range(0, len(where), step):
                own = where[a : a + step]
                yield own, np.frombuffer(b"".join([MARK + words[i] for i in own.tolist()]), np.uint8).reshape(len(own), k + 3)

    def _long(self, word: bytes) -> float:
        """The forward recursion for one long word; memory grows with the longest piece only."""
        word = MARK + word
        alpha = [0.0]
        for t in range(1, len(word) + 1):
            lo = max(0, t - self.longest)
            x = [alpha[s - t] + self.logp[i] for s in range(lo, t) if (i := self.lookup.get(word[s:t])) is not None]
            top = max(x)
            alpha.append(top + math.log(sum(math.exp(y - top) for y in x)))
            if len(alpha) > self.longest:
                alpha.pop(0)
        return alpha[-1]

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word over all its segmentations, its stop included."""
        logp, out = np.append(self.logp, -np.inf), np.zeros(len(words))
        for own, x in self._batches(words):
            out[own] = self._long(words[own[0]]) if x.shape[1] > BATCHED + 3 else self.forward(self.spans(x), logp)[:, -1]
        return out + self.stop

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words."""
        logp, out = np.append(self.logp, -np.inf), np.zeros(len(self.pieces) + 1)
        for own, x in self._batches(words):
            if x.shape[1] > BATCHED + 3:
                continue  # below, by blocks
            spans = self.spans(x)
            a, b = self.forward(spans, logp), self.backward(spans, logp)
            r, s, k = np.nonzero(spans >= 0)
            i = spans[r, s, k]
            out += np.bincount(i, weights=np.exp(a[r, s] + logp[i] + b[r, s + k + 1] - a[r, -1]) * counts[own][r], minlength=len(out))
        long = sorted((i for i, w in enumerate(words) if len(w) > BATCHED), key=lambda i: len(words[i]))
        for a in range(0, len(long), ABREAST):
            own = long[a : a + ABREAST]
            out += self._expected_long([MARK + words[i] for i in own], counts[own], logp)
        return out[:-1]

    def _expected_long(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The same for long words, block by block: of each block only the forward sums that reach into it are kept,
        and on the way back it is worked through again."""
        n, most, size = len(words), self.longest, np.array([len(w) for w in words])
        width = min(BLOCK, int(size.max()) + 1)
        out, total, rows = np.zeros(len(self.pieces) + 1), np.zeros(n), np.arange(n)

        def block(lo: int, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pieces that start in a block, none beyond its word's end, and the forward sums up to `most` past the block."""
            x = np.frombuffer(b"".join(w[lo : lo + width + most].ljust(width + most, b"\0") for w in words), np.uint8)
            spans = self.spans(x.reshape(n, width + most))[:, :width]
            spans[lo + np.add.outer(np.arange(width), np.arange(1, most + 1)) > size[:, None, None]] = -1
            alpha = np.full((n, width + most), -np.inf)
            alpha[:, :most] = into
            for s in range(width):
                to = alpha[:, s + 1 : s + 1 + most]
                np.logaddexp(to, alpha[:, s, None] + logp[spans[:, s]], out=to)
            return spans, alpha

        into = [np.full((n, most), -np.inf)]
        into[0][:, 0] = 0
        starts = range(0, int(size.max()) + 1, width)
        for lo in starts:
            spans, alpha = block(lo, into[-1])
            into.append(alpha[:, width:].copy())
            ends = rows[(size >= lo) & (size < lo + width)]
            total[ends] = alpha[ends, size[ends] - lo]
        beta = np.full((n, width + most), -np.inf)
        for at in range(len(starts) - 1, -1, -1):
            lo = starts[at]
            if at < len(starts) - 1:
                spans, alpha = block(lo, into[at])
            beta[:, width:] = beta[:, :most].copy()
            for s in range(width - 1, -1, -1):
                beta[:, s] = np.logaddexp.reduce(logp[spans[:, s]] + beta[:, s + 1 : s + 1 + most], axis=1)
                beta[size == lo + s, s] = 0
            r, s, k = np.nonzero(spans >= 0)
            i = spans[r, s, k]
            out += np.bincount(i, weights=np.exp(alpha[r, s] + logp[i] + beta[r, s + k + 1] - total[r]) * counts[r], minlength=len(out))
        return out


def batches_of(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words in lists of at most 50,000 and about BATCH_BYTES bytes."""
    first, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 24
        if size > 2 * BATCH_BYTES or i - first == 50_000:
            yield words[first : i + 1]
            first, size = i + 1, 0
    if first < len(words):
        yield words[first:]


def count_words(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(word binary, n, c): how often each word stands in all texts, and in those of training rows."""

    def run(batches):
        every: Counter[bytes] = Counter()
        own: Counter[bytes] = Counter()
        seen = 0

        def flush():
            found = list(every)
            for words in batches_of(found):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([every[w] for w in words], pa.int64()), pa.array([own.get(w, 0) for w in words], pa.int64())], ["word", "n", "c"])
            every.clear()
            own.clear()

        for b in batches:
            train_row = b.column(1).to_pylist()
            text = b.column(0).cast(pa.large_binary())
            for i, yes in enumerate(train_row):
                words = (text[i].as_py() or b"").translate(LOWER).split()
                every.update(words)
                if yes:
                    own.update(words)
                seen += sum(map(len, words))
                if len(every) > FLUSH or seen > FLUSH_BYTES and sum(map(len, every)) > FLUSH_BYTES:
                    yield from flush()
                if seen > FLUSH_BYTES:
                    seen = 0
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), train.alias("train"))
    return rows.mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(words: DataFrame, lattice: Lattice) -> Lattice:
    """Piece probabilities after ROUNDS of expectation-maximisation over all distinct training words.

    Pieces that begin a word and those that go on are two distributions, the second with the word's stop.
    """
    sc = words.sparkSession.sparkContext
    seen = words.where("c > 0").select("word")
    types = seen.count()
    begins = np.array([x.startswith(MARK) for x in lattice.pieces])
    for _ in range(ROUNDS if types else 0):
        sent = sc.broadcast(lattice)

        def run(batches, sent=sent):
            part, sums = TaskContext.get().partitionId(), None
            for b in batches:
                own = b.column(0).to_pylist()
                for a in range(0, len(own), 20_000):
                    x = sent.value.expected(own[a : a + 20_000], np.ones(len(own[a : a + 20_000])))
                    sums = x if sums is None else sums + x
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(["pieces"]), pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["key", "part", "vec"])

        got = sum_packed(seen.mapInArrow(run, "key string, part long, vec binary")).collect()
        uses = np.frombuffer(bytes(got[0]["vec"]), np.float64) + SMOOTH
        first, on = uses[begins].sum(), uses[~begins].sum()
        lattice = Lattice(lattice.pieces, np.log(np.where(begins, uses / first, uses / (on + types))))
        lattice.stop = math.log(types / (on + types))
    return lattice


def score_texts(docs: DataFrame, vocabulary: str, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Words are runs without white space, lower-cased A-Z, and each text has one end, counted as a token.
    score is the log10 probability of the whole text under the lattice model, base_score that of a
    word model with 0.1 added to each count; both are learned from the rows that `train` marks. Null
    counts as empty text (its end alone); repeated rows each get a row; an empty table gives none.

    Words of any length take the same way. Documents that repeat an id are rows of their own; words that
    tie in frequency need no order, and other columns of docs are not read, whatever their names.

    Frequent words are looked up in a broadcast table with a proven bound; the others, none of which
    has more than SHARE of all tokens, meet their counts in a join on the word, so no key is hot.
    """
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    words = cut_lineage(count_words(docs, text_col, train))
    ends = docs.where(train).count()
    c = F.col("c")
    facts = words.agg(F.sum("n").alias("all"), F.sum("c").alias("n"), F.count_if(c > 0).alias("v"), F.count_if(c == 1).alias("once"), F.count_if(c == 2).alias("twice")).first()
    n, v = (facts["n"] or 0) + ends, facts["v"] + (ends > 0)
    discount = min(max(facts["once"] / max(facts["once"] + 2 * facts["twice"], 1), 0.05), 0.95)
    lattice = fit(words, Lattice.load(vocabulary))
    shared = discount * v if n else 1.0
    sent = spark.sparkContext.broadcast(lattice)
    least = max(1, math.ceil((facts["all"] or 0) * SHARE))

    def lattice_score(batches):
        for b in batches:
            whole = np.log(np.maximum(b.column(2).to_numpy() - discount, 1e-300))
            paths = sent.value.score(b.column(0).to_pylist()) + math.log(shared)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((np.logaddexp(whole, paths) - math.log(max(n, 1))) / LOG10)], ["word", "c", "lp"])

    def by_key(batches):
        for b in lattice_score(batches):
            yield b.set_column(0, "word", pa.array([table_key(w) for w in b.column(0).to_pylist()], pa.binary()))

    frequent = F.col("n") >= least
    # the frequent words are at most 1 / SHARE, each called by at most LONGEST bytes
    top = words.where(frequent).select("word", "n", "c").mapInArrow(by_key, "word binary, c long, lp double").toArrow()
    table = {w: (c, math.log10(c + ALPHA), lp) for w, c, lp in zip(top["word"].to_pylist(), top["c"].to_pylist(), top["lp"].to_pylist(), strict=True)}
    known_words = spark.sparkContext.broadcast(table)
    rest = words.where(~frequent).select("word", "n", "c").mapInArrow(lattice_score, "word binary, c long, lp double")
    end_lp, end_base = math.log10(max(ends - discount, 0.05) / max(n, 1)), math.log10(ends + ALPHA)

    kind = docs.schema[id_col].dataType
    doc = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lp", T.DoubleType()), T.StructField("doc", doc)])

    def look_up(batches):
        own = known_words.value
        for b in batches:
            for first, stop in slices(b.column(2), BATCH_BYTES):
                part = b.slice(first, stop - first)
                text = part.column(2).cast(pa.large_binary())
                uid, word, n_, known, base, lp, at = [], [], [], [], [], [], []
                tokens = []
                ids = part.column(1).to_pylist()
                for i, row in enumerate(ids):
                    words = (text[i].as_py() or b"").translate(LOWER).split()
                    tokens.append(len(words) + 1)
                    k, s, z = int(ends > 0), end_base, end_lp
                    for w, m in Counter(words).items():
                        x = own.get(w if len(w) <= LONGEST else table_key(w))
                        if x is None:
                            uid.append(row)
                            word.append(w)
                            n_.append(m)
                            known.append(0)
                            base.append(0.0)
                            lp.append(0.0)
                            at.append(None)
                        else:
                            k += m * (x[0] > 0)
                            s += m * x[1]
                            z += m * x[2]
                    uid.append(row)
                    word.append(b" %d" % row)  # no word holds a space
                    n_.append(0)
                    known.append(k)
                    base.append(s)
                    lp.append(z)
                    at.append(i)
                at = pa.array(at, pa.int32())
                held = part.column(3).take(at)
                info = pa.StructArray.from_arrays([part.column(0).take(at), held, pa.array(tokens, pa.int64()).take(at)], names=["id", "held_out", "n_tokens"], mask=at.is_null())
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(word, pa.binary()), pa.array(n_, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lp), info], ["uid", "word", "n", "known", "base", "lp", "doc"])

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("string").alias("text"), (~train).alias("held_out")).mapInArrow(look_up, schema)
    met = rows.join(rest.select("word", "c", F.col("lp").alias("own")), "word", "left")
    sums = met.groupBy("uid").agg(
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("base"),
        F.sum(F.col("lp") + F.col("n") * F.coalesce("own", F.lit(0.0))).alias("score"),
        F.first("doc", ignorenulls=True).alias("doc"),
    )
    whole = math.log10(n + ALPHA * (v + 1))
    return sums.select(F.col("doc.id").alias("id"), "doc.held_out", "doc.n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("doc.n_tokens") * whole).alias("base_score"), "score")


def op10(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    bound_batches(docs.sparkSession)
    from corpusmill.llm.common import fold

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return score_texts(docs, vocabulary, fold("doc_id", 10) != 0).withColumnRenamed("id", "doc_id")
