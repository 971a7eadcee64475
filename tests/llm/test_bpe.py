import base64
import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe
from quillspark.llm.queries import op12_byte_bpe

from .helpers import odd_documents


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.byte_bpe(bpe.default_ranks(), bpe.default_pattern())


def held(own, library, texts):
    ids, counts = own.encode(texts)
    ends = counts.cumsum()
    assert [ids[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids, counts) == [t.encode() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_texts(own, library, texts):
    held(own, library, texts)


def test_every_character(own, library):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    held(own, library, [" ".join(f"a{c}{c}1 {c}" for c in chars[k : k + 1000]) for k in range(0, len(chars), 1000)])


def test_every_token_as_a_word(own, library):
    held(own, library, [t.decode() for t in own._ranks if t.decode(errors="ignore").encode() == t])


def test_long_words(own, library):
    rng = random.Random(1)
    mixed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    held(own, library, ["a" * 50_001, "ab" * 9000, " " * 5000, " \n" * 3000, "=" * 7777, mixed, "的一是不" * 700, "éè" * 900])
    held(own, library, ["".join(rng.choice("abcde") for _ in range(rng.randint(250, 700))) for _ in range(30)])


def test_memo_and_sections_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "SECTION", 20)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 30)
    rng = random.Random(2)
    held(own, library, [" ".join(rng.choice(["the", "then", "thesis", "über", "12345", "\n\n", "it's"]) + str(rng.random()) for _ in range(rng.randint(0, 60))) for _ in range(40)])


def test_odd_documents_and_round_trip(spark, library):
    docs = odd_documents(spark)
    rows = bpe.encode(docs, decoded=True).collect()
    assert sorted((r["doc_id"] or -1, r["ids"], bytes(r["decoded"])) for r in rows) == sorted((d["doc_id"] or -1, library.encode_ordinary(d["text"] or ""), (d["text"] or "").encode()) for d in docs.collect())
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in back) == sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in rows)
    assert bpe.encode(docs.where("false")).count() == 0
    assert [bytes(r["decoded"]) for r in bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")).collect()] == [b"", b""]


def test_unknown_ids_raise(own):
    import numpy as np

    with pytest.raises(ValueError):
        own.decode(np.array([3, 60_000], np.int32), np.array([2]))


def test_query_against_the_library(spark, sf, library):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in op12_byte_bpe(spark, sf).collect()} == want
