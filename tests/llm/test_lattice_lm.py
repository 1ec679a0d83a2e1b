import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpusmill.llm import lattice_lm as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
LATTICE = L.Lattice.load(PATH)


def every_path(word, lattice):
    """Log-sum over all segmentations, one by one."""
    word = L.MARK + word

    def paths(rest):
        if not rest:
            yield 0.0
        for k in range(1, len(rest) + 1):
            if (i := lattice.lookup.get(rest[:k])) is not None:
                for p in paths(rest[k:]):
                    yield lattice.logp[i] + p

    return np.logaddexp.reduce(list(paths(word))) + lattice.stop


def test_forward_equals_all_segmentations():
    words = [b"a", b"the", b"thing", b"xqz", "é".encode(), b"ca,t."]
    assert np.allclose(LATTICE.score(words), [every_path(w, LATTICE) for w in words], atol=1e-9)


def test_long_words_take_the_other_way_round():
    word = ("thingé" * 40).encode()
    whole = LATTICE.forward(LATTICE.spans(np.frombuffer(L.MARK + word, np.uint8)[None]), np.append(LATTICE.logp, -np.inf))[0, -1]
    assert abs(LATTICE.score([word])[0] - whole - LATTICE.stop) < 1e-6


def test_expected_counts_cover_each_word():
    words = [b"the", b"erble", b"nt"]
    e = LATTICE.expected(words, np.array([2.0, 1.0, 3.0]))
    size = np.array([len(p) for p in LATTICE.pieces])
    assert abs((e * size).sum() - sum(c * (len(w) + 3) for w, c in zip(words, (2, 1, 3), strict=True))) < 1e-6


@pytest.mark.parametrize("block", [1024, 100, 7])
def test_long_words_add_their_expected_counts(monkeypatch, block):
    rng = random.Random(4)
    words = [("thingé的" * 20).encode(), "".join(rng.choice("日本語の文章 https://x.y/"[:16].replace(" ", "")) for _ in range(500)).encode(), b"of", bytes(rng.choices(b"abet", k=1021)), b"x" * 1024]
    counts = np.array([1.0, 2.0, 1.0, 1.0, 3.0])
    logp, want = np.append(LATTICE.logp, -np.inf), np.zeros(len(LATTICE.pieces))
    for w, c in zip(words, counts, strict=True):  # the whole word at once
        spans = LATTICE.spans(np.frombuffer(L.MARK + w, np.uint8)[None])
        a, b = LATTICE.forward(spans, logp)[0], LATTICE.backward(spans, logp)[0]
        _, s, k = np.nonzero(spans >= 0)
        np.add.at(want, spans[0, s, k], c * np.exp(a[s] + logp[spans[0, s, k]] + b[s + k + 1] - a[-1]))
    monkeypatch.setattr(L, "BLOCK", block, raising=False)
    assert np.allclose(LATTICE.expected(words, counts), want, atol=1e-8)


def _docs(spark):
    rng = random.Random(6)
    vocab = ["the", "of", "and", "Thing.", "erble", "nt,", "çà"] + ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 200])]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\x0b \t"), (503, "x" * 5000), (7, "the of the")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_query_equals_brute_force(spark):
    rows, docs = _docs(spark)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for ws, y in zip(tokens, train, strict=True) if y for w in ws)
    ends = sum(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    whole = math.log10(n + 0.1 * (v + 1))
    want = Counter()
    for (i, _), ws in zip(rows, tokens, strict=True):
        base = sum(math.log10(c[w] + 0.1) - whole for w in ws) + math.log10(ends + 0.1) - whole
        want[i, zlib.crc32(str(i).encode()) % 10 == 0, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(base, 6)] += 1
    got = L.op10(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


def plain_score(words, lattice, known, train):
    """Every distinct word's log10 probability, from all segmentations one by one, with the counts of training words."""
    ends, n, v, discount = train
    out = {}
    for w in words:
        text, whole = L.MARK + w, max(known[w] - discount, 1e-300)
        ways = [-math.inf] * len(text) + [0.0]  # from each place to the end
        for s in range(len(text) - 1, -1, -1):
            own = [lattice.logp[lattice.lookup[text[s:t]]] + ways[t] for t in range(s + 1, len(text) + 1) if text[s:t] in lattice.lookup]
            top = max(own)
            ways[s] = top + math.log(sum(math.exp(x - top) for x in own))
        path = math.exp(ways[0] + lattice.stop) * discount * v
        out[w] = math.log10((whole + path) / n) if whole + path > 0 else (ways[0] + lattice.stop + math.log(discount * v / n)) / math.log(10)
    return out


def plain_fit(types, lattice):
    """Expectation-maximisation over distinct words, from forward and backward sums of plain loops."""
    for _ in range(L.ROUNDS):
        uses = [L.SMOOTH] * len(lattice.pieces)
        for w in types:
            text = L.MARK + w
            n = len(text)
            arcs = [(s, t, lattice.lookup[text[s:t]]) for s in range(n) for t in range(s + 1, min(n, s + lattice.longest) + 1) if text[s:t] in lattice.lookup]
            a, b = [-math.inf] * n + [-math.inf], [-math.inf] * n + [0.0]
            a[0] = 0.0
            for s, t, i in arcs:
                a[t] = np.logaddexp(a[t], a[s] + lattice.logp[i])
            for s, t, i in reversed(arcs):
                b[s] = np.logaddexp(b[s], b[t] + lattice.logp[i])
            for s, t, i in arcs:
                uses[i] += math.exp(a[s] + lattice.logp[i] + b[t] - a[n])
        first = sum(u for u, p in zip(uses, lattice.pieces, strict=True) if p.startswith(L.MARK))
        on = sum(u for u, p in zip(uses, lattice.pieces, strict=True) if not p.startswith(L.MARK))
        lattice = L.Lattice(lattice.pieces, np.log([u / first if p.startswith(L.MARK) else u / (on + len(types)) for u, p in zip(uses, lattice.pieces, strict=True)]))
        lattice.stop = math.log(len(types) / (on + len(types)))
    return lattice


def test_score_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = ["the", "of", "Thing.", "nt,", "çà", "語", "u" * 129, "https://a.b/" + "path/" * 20] + ["w%d" % i for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([4, len(vocab)])]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "q" * 300 + " unseen z"), (7, "the of the")]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(L.LOWER)) for _, t in rows]
    known = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(known.values()) + ends, len(known) + 1
    once, twice = sum(c == 1 for c in known.values()), sum(c == 2 for c in known.values())
    discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
    word = plain_score({w for ws in tokens for w in ws}, plain_fit(sorted(known), LATTICE), known, (ends, n, v, discount))
    want = Counter((i, round(sum(word[w] for w in ws) + math.log10(max(ends - discount, 0.05) / n), 5)) for (i, _), ws in zip(rows, tokens, strict=True))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, uid int")
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in L.op10(docs).collect()) == want


def test_frequent_long_words_are_looked_up_too():
    assert L.table_key(b"x" * 64) == b"x" * 64
    assert len(L.table_key(b"x" * 65)) == 17 and L.table_key(b"x" * 65) != L.table_key(b"x" * 66)


def test_words_leave_a_task_in_bounded_batches():
    words = [b"a" * 3, b"b" * (3 << 20), *(b"%d" % i for i in range(60_000))]
    parts = list(L.batches_of(words))
    assert [w for p in parts for w in p] == words
    assert max(map(len, parts)) <= 50_001 and len(parts[0]) == 2


def test_scores_are_probabilities_and_follow_the_corpus(spark):
    rows, docs = _docs(spark)
    got = {r["doc_id"]: r["score"] for r in L.op10(docs).collect()}
    assert 10 ** got[501] == pytest.approx(10 ** got[500])
    unseen = spark.createDataFrame([(900, "the the"), (901, "zqzqzq zqzqzq")], "doc_id long, text string")
    both = {r["doc_id"]: r["score"] for r in L.op10(docs.unionByName(unseen)).collect()}
    assert both[900] > both[901]


def test_the_way_beyond_the_broadcast_table_gives_the_same(spark, monkeypatch):
    _, docs = _docs(spark)
    order = lambda d: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in d.collect())
    a = order(L.op10(docs))
    monkeypatch.setattr(L, "SHARE", 2.0)  # no word is frequent
    assert order(L.op10(docs)) == a


def test_empty_table(spark):
    _, docs = _docs(spark)
    assert L.op10(docs.limit(0)).count() == 0
