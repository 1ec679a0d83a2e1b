import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.tokenizer_json(PATH))


def check(texts):
    ids, at = ENCODER.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        got = ids[at[k] : at[k + 1]].tolist()
        assert got == want
        assert ENCODER.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_odd_texts():
    check([None, "", " ", "x" * 9000, "<|endoftext|> a<|startoftext|>b", "it's I'm we'll", "é é İß 漢字 😀", "a\x1cb\x85c d", "12 3.4!!?", "\n\t" * 50])


def test_joins_are_encoded_until_both_ends_agree(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 5)
    words = ["it's", "don't", "!!!", "we'll", "<|endoftext|>", "e\u0301a", "1234", "漢字", "a"] + ["".join(rng.choice("abcdeé'!1") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    text = " ".join(rng.choice(words) for _ in range(3000))
    own, asked = bpe.Encoder(bpe.tokenizer_json(PATH)), []
    library = own._library
    own._library = lambda texts: asked.append(len(texts)) or library(texts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(pa.array([text]))[0].tolist() == want
    joins = len(own._chunks(np.array([0, len(text.encode())]), np.frombuffer(text.encode(), np.uint8))[0]) - 1
    assert joins > 50 and asked[1:] == [joins]  # every join once: the first window agreed
    # wrong ids near a chunk's ends are found out: the windows grow beyond them, or the text is encoded whole
    real = bpe.Encoder._by_chunk
    for places in ([1], [1, 2], range(1, 60)):

        def wrong(self, raw, start, end, places=places):
            out = []
            for ids, counts in real(self, raw, start, end):
                x, edge = np.frombuffer(ids, np.uint32).copy(), np.append(0, np.cumsum(np.array(counts, int)))
                x[edge[sorted({k for w in places if w < len(counts) for k in (w, len(counts) - 1 - w)})]] ^= 1
                out.append((x.tobytes(), counts))
            return out

        monkeypatch.setattr(bpe.Encoder, "_by_chunk", wrong)
        asked.clear()
        assert own.encode(pa.array([text]))[0].tolist() == want
        assert asked[1] == joins and len(asked) > 2 and asked[2] > 0


def test_chunks_are_shared_and_joins_repaired():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé'!1") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(3000))
    texts = ["".join(rng.choice(words) + " " for _ in range(50)) + passage + " tail" for _ in range(4)]
    own = bpe.Encoder(bpe.tokenizer_json(PATH))
    own.encode(pa.array(texts[:1]))
    before = set(own.chunks)
    own.encode(pa.array(texts[1:]))
    assert len(before) > 20 and len(set(own.chunks) - before) < 4 * 5
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab c\n\t'sté́Ω<|endoftext|>!?12 漢😀"), max_size=400), max_size=6))
def test_any_text_round_trips(texts):
    check(texts)


def test_stores_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 50)
    monkeypatch.setattr(bpe, "KEEP_BYTES", 4000)
    own = bpe.Encoder(bpe.tokenizer_json(PATH))
    rng = random.Random(4)
    for _ in range(20):
        t = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(600))
        ids, _ = own.encode(pa.array([t]))
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
        assert own.kept <= 4000 and len(own.older) <= 50 + 600


def test_query_digests(spark):
    rows = [(1, "Hello, World"), (2, None), (3, ""), (1, "Hello, World")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bpe.op5(docs).collect()
    assert len(got) == 4
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op5(docs.limit(0)).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string").withColumn("decoded", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("n_tokens", F.lit(3))
    out = bpe.encode(docs, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert {(r["doc_id"], len(r["ids"]), r["decoded"]) for r in out.collect()} == {(1, 2, "a</w> b</w>"), (None, 0, "")}
    assert bpe.op5(docs).count() == 2
