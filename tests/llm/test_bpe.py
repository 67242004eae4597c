import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from palisade.llm import bpe
from palisade.llm.queries import LLM_QUERIES
from pyspark.sql import functions as F

from .helpers import documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def odd_texts(rng):
    alphabet = "aeiou   \n\t'sdé  漢字ab12٣½!?<|>_-.日本語한국🙂👩‍👩‍👧́ᣚ\U00018da7՘\U00012550"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += [" " * 3000, "\n" * 1500 + "x", "ab" * 4000, "".join(rng.choice("abcde") for _ in range(3000)),
              "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(800)), "<|endoftext|> it's we'LL I'm", "a" * 1023 + " " + "b" * 1025]
    return texts


def test_encoder_as_the_library(ranks, reference):
    texts = odd_texts(random.Random(4))
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    ids, n = encoder.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == reference.encode_ordinary(text), text[:50]


def test_little_memory_and_matrices(ranks, reference, monkeypatch):
    for name, value in (("MEMORY", 50), ("CELLS", 64), ("WIDEST", 16)):
        monkeypatch.setattr(bpe, name, value)
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    for text in odd_texts(random.Random(5))[:400]:
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_every_code_point(ranks, reference):
    """Each code point beside letters, digits and blanks, so that its class decides where pieces end."""
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 5000):
        text = "\n".join(f"a{c}a  {c}1" for c in points[low : low + 5000])
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_a_very_long_piece(ranks, reference):
    piece = "".join(random.Random(6).choice("etaoin") for _ in range(300_000))
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    assert encoder.encode([piece])[0].tolist() == reference.encode_ordinary(piece)


def test_tables(spark, ranks, reference):
    rows = odd_rows(random.Random(7)) + [(100 + i, t) for i, t in enumerate(odd_texts(random.Random(8))[:200])]
    docs = documents(spark, rows).withColumn("ids", F.lit("x"))
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    back = got.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("bytes")).collect()
    want = sorted(((r[0] is None, r[0] or 0, reference.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows))
    assert sorted((b.doc_id is None, b.doc_id or 0, b.ids, bytes(b.bytes)) for b in back) == want
    assert bpe.encode(documents(spark, []), ranks, public_tokenizers.PATTERN).collect() == []


def test_decode_nulls_and_foreign_ids(spark, ranks):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "k int, ids array<int>")
    got = {r.k: r.b for r in df.select("k", bpe.decode(F.col("ids"), ranks).alias("b")).collect()}
    assert got == {1: None, 2: b"", 3: b"ab"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([10**6],)], "ids array<int>").select(bpe.decode(F.col("ids"), ranks)).collect()


def test_whole_query(spark, reference):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = LLM_QUERIES["op11_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
