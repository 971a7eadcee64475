import json
from collections import Counter
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing
from quillspark.llm.queries import op1_best_fit_packing
from quillspark.llm.tokens import WordTokenizer, default_tokenizer

from .helpers import odd_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_plans_hold_every_piece_once(lengths):
    plan = packing.bin_completion(Counter(lengths), 60)
    assert all(sum(x * k for x, k in f) <= 60 for _, f in plan)
    held = Counter()
    for n, f in plan:
        for x, k in f:
            held[x] += n * k
    assert held == Counter(lengths)
    bins = sum(n for n, _ in plan)
    assert packing.lower_bound(Counter(lengths), 60) <= bins <= sum(n for n, _ in packing.best_fit(Counter(lengths), 60))


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    best = [len(lengths)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for k in sorted({r: i for i, r in enumerate(rooms) if r >= rest[0]}.values()):
            go(rest[1:], [r - rest[0] * (i == k) for i, r in enumerate(rooms)])
        go(rest[1:], [*rooms, capacity - rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_cases_are_optimal_or_nearly(lengths):
    assert sum(n for n, _ in packing.bin_completion(Counter(lengths), 20)) == fewest(lengths, 20)


def test_every_token_of_the_file_merges_to_itself():
    """What makes merging by rank the same as merging by pairs: each token, cut into bytes and
    merged by the file's pairs, is one piece again."""
    model = json.loads(Path(default_tokenizer()).read_text(encoding="utf-8"))["model"]
    rank = {tuple(m): k for k, m in enumerate(model["merges"])}
    assert len({a + b for a, b in rank}) == len(rank)
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        parts = [*token.removesuffix("</w>")]
        parts[-1] += "</w>" * token.endswith("</w>")
        while len(parts) > 1:
            r, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if r == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [token]


def test_words_give_the_library_ids():
    tok = WordTokenizer(default_tokenizer())
    texts = ["<|STARTOFTEXT|> <|startoftext|>", "É́a Ça ß ½² \xa0 a\xa0b \x85 don't'll 12a3 ''", "x" * 3000, " a  b ", "H\u0331 h\u0331", "", "It's a naïve café's", "a\x1cb", "x\x85y", "中文 テスト", "é ß ſ İ ΑΣ ΣΑΣ.", "<|endoftext|> a<|startoftext|>b", "one two three one", "'s 't ''s !'s 12²3 a b"] * 2
    for text, got in zip(texts, tok.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok._tok.encode(text, add_special_tokens=False).ids


def test_documents_come_back_from_their_sequences(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, capacity=256).collect()
    tok = WordTokenizer(default_tokenizer())
    want = sorted(((r["doc_id"] or -1), tok.encode([r["text"] or ""])[0] + b"\x01\0\0\0") for r in docs.collect())
    pieces = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 256
        pieces.setdefault((r["doc_id"] or -1), []).append((r["piece"], r["start"], bytes(r["ids"])))
    for doc, raw in want:
        if doc == 1:  # the repeated row comes twice
            assert len(pieces[1]) == 2 and all(p[2] == raw for p in pieces[1])
        else:
            assert b"".join(p[2] for p in sorted(pieces[doc])) == raw
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256


def test_query_against_the_library(spark, sf):
    """ids, pieces and places of the whole table, computed again by the tokenizers library."""
    import zlib

    rows = op1_best_fit_packing(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok, want = WordTokenizer(default_tokenizer())._tok, {}
    for doc, text in docs.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[doc, p] = (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()]
    assert len(bins) == packing.lower_bound(Counter(r["length"] for r in rows), 4096)


#: Lengths on which best-fit decreasing needs one bin of 20 more than the least.
BEATEN = [[11, 11, 11, 10, 9, 8, 7, 6, 6, 5, 4, 4, 4, 3], [9, 9, 8, 7, 7, 5, 4, 4, 4, 3], [9, 8, 8, 7, 6, 6, 6, 5, 4]]


def test_bin_completion_beats_best_fit():
    for lengths in BEATEN:
        counts = Counter(lengths)
        bins = sum(n for n, _ in packing.bin_completion(counts, 20))
        assert bins == packing.lower_bound(counts, 20) < sum(n for n, _ in packing.best_fit(counts, 20))


def test_empty_table(spark):
    assert packing.pack_documents(odd_documents(spark).where("false")).count() == 0


def test_pack_keeps_columns_and_replaces_its_own(spark):
    rows = [(k, 1 + k % 7, -1, -1, -1, -1, "x") for k in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, sequence_id long, offset long, _part long, _rank long, note string")
    out = packing.pack(pieces, 10)
    assert out.columns == ["doc_id", "length", "note", "sequence_id", "offset"]
    bins = {}
    for r in out.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, bins.values())) == 50 and len(bins) == packing.lower_bound(Counter(r[1] for r in rows), 10)
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert ends[-1] <= 10 and [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()]
