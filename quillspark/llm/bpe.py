"""Byte-level BPE as recursive DuckDB queries, one small in-memory database per Python worker.

A word is a match of the split pattern.  Its bytes are rows (key, token), the key holding word
and position; a recursive query joins neighbours to the table of merges, contracts the leftmost
pair of the lowest rank of each word, and ends where no word has a pair left.  Ids become bytes
again by a join with the vocabulary and an ordered aggregation.  Spark deals the texts to tasks;
a task's distinct words alone are contracted, each once while the memo holds it.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import gathered, spread

#: Words a worker remembers, bytes that one query contracts, rows that a query over long words keeps.
MEMO_WORDS, QUERY_BYTES, LONG_ROWS = 800_000, 500_000, 4_000_000
#: Words of more bytes are cut where no token can reach across, and contracted by all pairs of a rank at once.
LONG_WORD = 256
#: Matches of a text that are taken at a time, and ids that are decoded at a time.
SECTION = 1_000_000

#: Keys are word << 32 | position.
_LEFTMOST = """
with recursive steps as (
    select key, token, 0 as step from start
    union all
    (with pairs as (
        select p.key, m.rank from steps p join steps q on q.key = p.key + 1 join merges m on m.l = p.token and m.r = q.token),
    best as (
        select key >> 32 as word, arg_min(key, rank::bigint << 32 | (key & 4294967295)) as at, min(rank) as rank from pairs group by 1)
    select s.key - (s.key > b.at)::bigint, case when s.key = b.at then b.rank else s.token end, s.step + 1
    from steps s join best b on b.word = s.key >> 32 where s.key <> b.at + 1)),
ended as (select key >> 32 as word, max(step) as last from steps group by 1)
select s.key, s.token from steps s join ended e on e.word = s.key >> 32 and e.last = s.step order by s.key
"""

#: All pairs of a word's lowest rank that don't overlap, from the left, up to the first whose merged
#: token makes a pair of lower rank with a neighbour: that pair would come before the next of them.
_EQUAL_RANKS = """
with recursive steps as (
    select key, token, 0 as step from start
    union all
    (with rows as (
        select key, token, step, row_number() over w as k, lead(key) over w as next_key, lead(token) over w as next_token,
            lag(token) over w as left_token, lag(key) over w as left_key, lead(token, 2) over w as right_token, lead(key, 2) over w as right_key
        from steps where step < {depth} window w as (order by key)),
    ranked as (
        select r.*, m.rank, min(m.rank) over (partition by r.key >> 32) as best
        from rows r left join merges m on m.l = r.token and m.r = r.next_token and r.next_key >> 32 = r.key >> 32),
    runs as (select *, k - row_number() over (order by k) as run from ranked where rank = best),
    hits as (select * from (select *, row_number() over (partition by run order by k) as in_run from runs) where in_run % 2 = 1),
    checked as (
        select h.k, h.key, h.best, coalesce(a.rank < h.best or b.rank < h.best, false) as last
        from hits h
        left join merges a on a.l = case when h.in_run > 1 then h.best else h.left_token end and a.r = h.best and h.left_key >> 32 = h.key >> 32
        left join merges b on b.l = h.best and b.r = h.right_token and h.right_key >> 32 = h.key >> 32),
    taken as (
        select k, best from (
            select *, count(*) filter (last) over (partition by key >> 32 order by k rows between unbounded preceding and 1 preceding) as lasts from checked)
        where lasts = 0)
    select r.key, coalesce(t.best, r.token), r.step + 1
    from ranked r left join taken t on t.k = r.k left join taken b on b.k = r.k - 1 where r.best is not null and b.k is null)),
ended as (select key >> 32 as word, max(step) as last from steps group by 1)
select s.key, s.token, s.step from steps s join ended e on e.word = s.key >> 32 and e.last = s.step order by s.key
"""

_DECODE = """
select text, section, unhex(array_to_string(list(hex order by position), '')) as bytes, count(*) as known
from ids join vocabulary using (id) group by text, section order by text, section
"""


def default_ranks() -> str:
    """Path of the public 50k byte-level vocabulary; the same path is read on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    """The split pattern of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """The merges and the vocabulary of a rank file (base64 token and rank on each line).

    Every single byte must have a rank.  Ids are the ranks.
    """

    def __init__(self, path: str, pattern: str) -> None:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        ranks = self._ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        # White space is Unicode's property, as in the library that the files are for.
        self._pattern = regex.compile(pattern.replace("[^\\s", "[^\\p{White_Space}").replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}"))
        self._of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(splits, np.int32).reshape(-1, 3).T
        self._db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self._keep("merges", l=left, r=right, rank=rank)
        self._keep("vocabulary", id=pa.array(ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in ranks]))
        spelled = [np.frombuffer(t, np.uint8).astype(np.int64) for t in ranks if len(t) > 1]
        triples = [t[:-2] << 16 | t[1:-1] << 8 | t[2:] for t in spelled]
        self._doubles = np.array(sorted(int(t[0] << 8 | t[1]) for t in spelled if len(t) == 2), np.int64)
        self._triples = np.unique(np.concatenate([np.zeros(0, np.int64), *triples]))
        self._forget()

    def _keep(self, name: str, **columns: object) -> None:
        self._db.register("given", pa.table(columns))
        self._db.execute(f"create table {name} as select * from given")
        self._db.unregister("given")

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _query(self, sql: str, start: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        self._db.register("start", pa.table({"key": start[0], "token": start[1]}))
        found = self._db.sql(sql).to_arrow_table()
        self._db.unregister("start")
        return {name: found.column(name).to_numpy() for name in found.column_names}

    def _pieces(self, word: bytes) -> list[bytes]:
        """A long word cut between bytes that no token holds side by side in this context."""
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        triple = np.isin(b[:-2] << 16 | b[1:-1] << 8 | b[2:], self._triples)
        joined = np.isin(b[:-1] << 8 | b[1:], self._doubles)
        joined[1:] |= triple
        joined[:-1] |= triple
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def _contract(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = (np.repeat(np.arange(len(words)), sizes) << 32) + np.arange(sizes.sum()) - first
        token = self._of_byte[np.frombuffer(b"".join(words), np.uint8)]
        if sql == _LEFTMOST:
            found = self._query(sql, (key, token))
        else:
            depth = reached = max(2, LONG_ROWS // max(1, len(key)))
            while reached == depth:
                found = self._query(sql.format(depth=depth), (key, token))
                key, token, reached = found["key"], found["token"], found["step"].max()
        return found["token"].astype(np.int32), np.bincount(found["key"] >> 32, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """Contract words that the memo doesn't hold."""
        spelled = [w.encode() for w in words]
        # A word that is a token is its id, as in the library; all others are contracted.
        tokens = {s: k for k, s in enumerate(s for s in spelled if s in self._ranks)}
        parts = [[s] if len(s) <= LONG_WORD or s in tokens else self._pieces(s) for s in spelled]
        distinct = [*dict.fromkeys(p for s, held in zip(spelled, parts, strict=True) if s not in tokens for p in held)]
        at: dict[bytes, int] = {}
        ids, counts = [np.array([self._ranks[s] for s in tokens], np.int32)], [np.ones(len(tokens), np.int64)]
        for long, sql in ((False, _LEFTMOST), (True, _EQUAL_RANKS)):
            todo, size = [], 0
            chosen = [p for p in distinct if (len(p) > LONG_WORD) == long]
            for k, piece in enumerate(chosen):
                todo.append(piece)
                size += len(piece)
                if size >= QUERY_BYTES or k == len(chosen) - 1:
                    got, many = self._contract(todo, sql)
                    at.update(zip(todo, range(len(tokens) + len(at), len(tokens) + len(at) + len(todo)), strict=True))
                    ids.append(got)
                    counts.append(many)
                    todo, size = [], 0
        ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)
        flat, many = _gather(np.concatenate(ids), ends, np.array([tokens[s] if s in tokens else at[p] for s, held in zip(spelled, parts, strict=True) for p in held], np.int64))
        of_word = np.add.reduceat(many, np.cumsum([0, *map(len, parts[:-1])])) if parts else np.zeros(0, np.int64)
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words)), strict=True))
        self._ids = np.r_[self._ids, flat]
        self._ends = np.r_[self._ends, self._ends[-1] + np.cumsum(of_word)]

    def _encode_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of successive words, and how many each has."""
        new = [w for w in dict.fromkeys(matches) if w not in self._known]
        if len(self._known) + len(new) > MEMO_WORDS:
            self._forget()
            new = [*dict.fromkeys(matches)]
        if new:
            self._learn(new)
        return _gather(self._ids, self._ends, np.fromiter(map(self._known.__getitem__, matches), np.int64, len(matches)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        ids, totals = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            flat, many = self._encode_matches(held)
            np.add.at(totals, np.repeat([o for o, _ in owners], [n for _, n in owners]).astype(np.int64), many)
            ids.append(flat)
            held.clear()
            owners.clear()

        for row, text in enumerate(texts):
            for matches in self._matches(text):
                held += matches
                owners.append((row, len(matches)))
                if len(held) >= SECTION:
                    flush()
        if held:
            flush()
        return np.concatenate(ids), totals

    def _matches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SECTION:
            yield self._pattern.findall(text)
            return
        found = (m.group() for m in self._pattern.finditer(text))
        while part := [*islice(found, SECTION)]:
            yield part

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids lie one after the other.  Unknown ids raise."""
        out: list[list[bytes]] = [[] for _ in counts]
        text, first = np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts) - counts, counts)
        for s in range(0, len(ids), SECTION):
            part = slice(s, s + SECTION)
            position = np.arange(s, s + len(ids[part]))
            self._db.register("ids", pa.table({"text": text[part], "section": (position - first[part]) // SECTION, "position": position, "id": ids[part]}))
            found = self._db.sql(_DECODE).to_arrow_table()
            for row, raw in zip(found.column("text").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                out[row].append(raw)
            self._db.unregister("ids")
            if sum(found.column("known").to_pylist()) < len(position):
                raise ValueError("ids must be in the vocabulary")
        return [b"".join(parts) for parts in out]


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``flat``, which end at ``ends`` (from 0), one after the other, and their sizes."""
    sizes = ends[at + 1] - ends[at]
    stops = np.cumsum(sizes)
    return flat[np.repeat(ends[at] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)], sizes


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One database per worker process and vocabulary."""
    return ByteBpe(path, pattern)


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids) of ``docs`` (doc_id, text): the ids of each whole text, without special tokens.

    With ``decoded`` a third column holds the bytes that ``decode`` gives for these ids, found in
    the same pass.  Strings of special tokens in a text are ordinary text.  A null text counts as
    empty and has no ids.  Repeated rows and null ids of documents stay; other columns aren't
    read.  The pairs of equal rank of a word go from left to right.
    """
    path, split = ranks_path or default_ranks(), pattern or default_pattern()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, split)
        for part in gathered(batches, "text"):
            ids, counts = bpe.encode([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), _id_lists(ids, counts)]
            if decoded:
                columns.append(pa.array(bpe.decode(ids, counts), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields[: len(columns)]])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, T.StructType(fields if decoded else fields[:2]))


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Rows (doc_id, decoded) of ``encoded`` (doc_id, ids): the bytes that the ids stand for.

    Null or empty lists give no bytes; a null id or one outside the vocabulary raises.
    """
    path, split = ranks_path or default_ranks(), default_pattern()
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, split)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("ids must be in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bpe.decode(flat.to_numpy(zero_copy_only=False), counts), pa.binary())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
