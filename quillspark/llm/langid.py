"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A word's
likelihood is the sum over all ways of cutting it into pieces, by a forward pass; a text's is
the product over its words.  Probabilities are fitted by expectation and maximisation on word
counts of a bounded sample.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, spread

#: Words are runs of letters (Unicode categories L), lower-cased; all else is passed over.
_RUNS = re.compile(r"[^\W\d_]+")
_LONGEST = 16
#: A character that no piece covers has this log probability in every language.
_UNKNOWN = -18.0
_START = "▁"


def letter_words(text: str) -> list[str]:
    """The words of a text.  Runs also hold signs for numbers that aren't digits, such as fractions
    and Roman numerals; in the few texts that have any, these part words like spaces."""
    words = _RUNS.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def default_vocabulary() -> str:
    """Path of the public 32k piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number, and for each length the sorted hashes of the pieces and of the
    beginnings of longer ones, with their piece numbers (-1: a beginning alone)."""

    pieces: tuple[str, ...]
    hashes: tuple[np.ndarray, ...]
    numbers: tuple[np.ndarray, ...]


#: Multiplier of the polynomial hash of strings, modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def index_pieces(pieces: list[str]) -> Vocabulary:
    """A vocabulary of these pieces, numbered in order."""
    number = {p: i for i, p in enumerate(pieces)}
    hashes, numbers = [], []
    for size in range(1, _LONGEST + 1):
        rows = sorted((_hash(b), number.get(b, -1)) for b in {p[:size] for p in pieces if len(p) >= size})
        hashes.append(np.array([h for h, _ in rows], np.uint64))
        numbers.append(np.array([n for _, n in rows], np.int64))
    return Vocabulary(tuple(pieces), tuple(hashes), tuple(numbers))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The file's pieces of letters, lower-cased, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    held = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return index_pieces([*sorted({p.lower() for p in held if len(p) <= _LONGEST and p.removeprefix(_START).isalpha()}), _START])


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log probabilities (pieces x languages), and the vocabulary's path."""

    languages: tuple[str, ...]
    logp: np.ndarray
    path: str


def lattice(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in all words as arrays (word, start, end, piece), positions in the word with
    its start mark.  Characters that are no piece by themselves get piece -1 over themselves.

    Substrings grow by a character at a time, all at once, while they begin some piece.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = np.frombuffer("".join([_START + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    who = np.repeat(np.arange(len(words)), sizes)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - pos
    alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    starts, ends, pieces = [], [], []
    for size, (hashes, numbers) in enumerate(zip(vocab.hashes, vocab.numbers, strict=True), 1):
        fits = left[alive] >= size
        alive, h = alive[fits], h[fits]
        if not len(alive) or not len(hashes):
            break
        h = h * _BASE + codes[alive + size - 1]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        piece = np.where(hit, numbers[at], -1)
        keep = np.ones(len(alive), bool) if size == 1 else piece >= 0
        starts.append(alive[keep])
        ends.append(pos[alive[keep]] + size)
        pieces.append(piece[keep])
        alive, h = alive[hit], h[hit]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return who[start], pos[start], np.concatenate(ends) if ends else start, np.concatenate(pieces) if pieces else start


def forward(words: list[str], pieces: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Log likelihoods (words x languages), summed over all segmentations of each word.

    All words advance together by position; a running scale for each word keeps long words
    within range.
    """
    if not words:
        return np.zeros((0, logp.shape[1]))
    who, start, end, piece = lattice(words, pieces)
    p = np.exp(np.vstack([logp, np.full(logp.shape[1], _UNKNOWN)]))[piece]
    order = np.argsort(end, kind="stable")
    who, start, end, p = who[order], start[order], end[order], p[order]
    size = np.array([len(w) + 1 for w in words])
    longest, langs = int(size.max()), logp.shape[1]
    cuts = np.searchsorted(end, np.arange(1, longest + 2))
    ring = np.zeros((_LONGEST + 1, len(words), langs))
    ring[0] = 1.0
    scale, result = np.zeros(len(words)), np.zeros((len(words), langs))
    for at in range(1, longest + 1):
        lo, hi = cuts[at - 1], cuts[at]
        now = np.zeros((len(words), langs))
        terms = ring[start[lo:hi] % (_LONGEST + 1), who[lo:hi]] * p[lo:hi]
        for k in range(langs):
            now[:, k] = np.bincount(who[lo:hi], terms[:, k], len(words))
        ring[at % (_LONGEST + 1)] = now
        done = size == at
        if done.any():
            result[done] = np.log(np.maximum(now[done], 1e-300)) + scale[done, None]
        if at % 8 == 0:
            top = now.max(axis=1)
            top[top <= 0] = 1.0
            ring /= top[None, :, None]
            scale += np.log(top)
    return result


def _expected(edges: tuple[np.ndarray, ...], words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, for one language.

    Forward times backward over each edge of the lattice; sample words are of ordinary length.
    """
    who, start, end, piece = edges
    p = np.exp(np.r_[logp, _UNKNOWN])[piece]
    size = np.array([len(w) + 1 for w in words])
    longest = int(size.max())
    alpha, beta = np.zeros((len(words), longest + 1)), np.zeros((len(words), longest + 1))
    alpha[:, 0] = 1.0
    beta[np.arange(len(words)), size] = 1.0
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    ends, starts = np.searchsorted(end[by_end], np.arange(longest + 2)), np.searchsorted(start[by_start], np.arange(longest + 2))
    for at in range(1, longest + 1):
        e = by_end[ends[at] : ends[at + 1]]
        alpha[:, at] = np.bincount(who[e], alpha[who[e], start[e]] * p[e], len(words))
    for at in range(longest - 1, -1, -1):
        e = by_start[starts[at] : starts[at + 1]]
        beta[:, at] += np.bincount(who[e], beta[who[e], end[e]] * p[e], len(words))
    total = np.maximum(beta[:, 0], 1e-300)
    share = alpha[who, start] * p * beta[who, end] / total[who] * counts[who]
    return np.bincount(piece[piece >= 0], share[piece >= 0], len(logp))


def fit(docs: DataFrame, vocabulary_path: str | None = None, rows_per_language: int = 400, rounds: int = 4, most_words: int = 20_000) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang).

    A bounded sample is used, about ``rows_per_language`` documents of each language, chosen by
    a hash of their ids; Spark counts the words of their whole texts, of which the
    ``most_words`` most frequent of up to 40 letters of each language serve the fit.  Every
    piece keeps some probability in every language.
    """
    path = vocabulary_path or default_vocabulary()
    pieces = vocabulary(path)
    sample, _ = bounded_sample(docs.select("doc_id", "text").where("text is not null"), docs.where("text is not null"), "lang", rows_per_language)
    words = spread(sample.select("lang", "text")).mapInArrow(_count_words, "lang string, word string, n long")
    totals = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in totals.select("lang").distinct().collect())
    n = len(pieces.pieces)
    logp = np.zeros((n, len(languages)))
    for k, lang in enumerate(languages):
        top = totals.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(most_words).collect()
        held, counts = [r["word"] for r in top], np.array([r["n"] for r in top], float)
        edges = lattice(held, pieces)
        p = np.full(n, 1.0 / n)
        for _ in range(rounds):
            uses = _expected(edges, held, counts, np.log(p))
            p = (uses + 0.01) / (uses.sum() + 0.01 * n)
        logp[:, k] = np.log(p)
    return LanguageModel(tuple(languages), logp, path)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update((lang, w) for w in letter_words(text) if len(w) <= 40)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


class _Scorer:
    """Word likelihoods of one model.  The first ``most`` words stay in a table; later new ones
    are worked out for the texts at hand and given up again."""

    def __init__(self, model: LanguageModel, most: int = 300_000) -> None:
        self.model, self.pieces, self.most = model, vocabulary(model.path), most
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(model.languages)))

    def texts(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """For each text its number of letters and its log likelihoods."""
        split = [letter_words(t) for t in texts]
        index, held = self.index, len(self.index)
        fresh = sorted({w for words in split for w in words if w not in index}, key=len)  # even lengths advance together
        while held + len(fresh) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            self.table[held + at : held + at + len(part)] = forward(part, self.pieces, self.model.logp)
        index.update(zip(fresh, range(held, held + len(fresh)), strict=True))
        found = [(sum(map(len, words)), self.table[[index[w] for w in words]].sum(axis=0) if words else np.zeros(self.table.shape[1])) for words in split]
        if len(index) > self.most:
            for w in fresh:
                del index[w]
        return found


def identify(docs: DataFrame, model: LanguageModel, temper: float = 0.2) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of ``docs``, from whole texts alone.

    ``score`` is the posterior of the predicted language with the likelihood raised to
    ``temper`` over the square root of the number of letters (words are not independent).
    Texts that are null or have no letter get ``und`` and 0, as all do if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, temperature = _Scorer(shared.value), temper
        names = scorer.model.languages
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found, scores = [], []
                texts = [x or "" for x in part.column("text").to_pylist()] if names else []
                found, scores = (found, scores) if names else (["und"] * part.num_rows, [0.0] * part.num_rows)
                for letters, loglik in scorer.texts(texts):
                    if not letters:
                        found.append("und")
                        scores.append(0.0)
                        continue
                    best = int(loglik.argmax())
                    rest = np.exp(np.clip((loglik - loglik[best]) * temperature / np.sqrt(letters), -700, 0))
                    found.append(names[best])
                    scores.append(float(1 / rest.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)
