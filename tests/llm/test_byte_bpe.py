import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from brindle.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, decoded long"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def expected(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        out.append((d, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    return Counter(out)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    return Counter(map(tuple, B.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()))


def test_real_documents_equal_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows) == expected(library, rows)


def test_edges_equal_the_library(spark, library):
    rnd = random.Random(3)
    odd = ["", None, " ", "  a", "a  b\n\n c \t", "a\x1cb", "it's 'S we'll ''s", "\x00\x01", "<|endoftext|> x", "日本語 テスト 🙂🙂 é", " x  y", "a" * 5000, " " * 3000, "ab" * 40_000 + " end", "x\r\ny z\r"]
    rows = list(enumerate(odd)) + [(3, "  a"), (None, "dup")]
    alphabet = ["a", "B", " ", " ", "\n", "\t", "é", "ß", "9", "'", "s", "-", "　", "🙂", "\x85"]
    rows += [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))) for i in range(300)]
    assert run(spark, rows) == expected(library, rows)


def test_other_columns_are_carried_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], DOCS).drop("ids")
    row = B.encode(docs, PATH, public_tokenizers.PATTERN).first()
    assert row.decoded == 2 and row.text == "a b" and len(row.ids) == 2
    back = B.decode(B.encode(docs.drop("decoded"), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert bytes(back.first().decoded) == b"a b"
    assert run(spark, []) == Counter()


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 5)
    bpe = B.ByteBpe(PATH, public_tokenizers.PATTERN)
    texts = [f"word{i} other{i % 7}, and more" for i in range(200)]
    got = bpe.encode_batch(texts)
    import numpy as np

    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
