"""Exact ids of a public word-level BPE tokenizer, for Arrow arrays of whole texts.

The tokenizer drops white space and none of its patterns crosses it, so the ids of a text are
those of its words in turn, and those of a word are those of its runs of letters, digits and
signs.  Words are split, made distinct and cut into runs in Arrow; each distinct word of a batch
is merged once, by ``tiktoken`` over the same file's merges; words of other characters than
ASCII and Latin-1 letters go to the ``tokenizers`` library itself.  Nothing is kept between
batches, so memory doesn't grow with the vocabulary of the corpus.

``tiktoken`` merges the adjacent pieces whose concatenation has the lowest rank, while a BPE
file names pairs.  Both agree if each token of the file, encoded by itself, is that token: pieces
next to each other that make up a token have merged as they would in it alone.  A test holds
this for the whole vocabulary.
"""

from __future__ import annotations

import functools
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words with other characters, with a special token's opening, or very long ones are encoded by themselves.
_ODD_WORD = "[^!-~À-ÖØ-öø-ÿ]|<[|]"
_LONGEST = 200
#: The tokenizer's own split pattern, for lower-cased words of those characters.
_RUN = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+)"
_END = "</w>"


def default_tokenizer() -> str:
    """Path of the public 49k word BPE; the same path is read on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones stand for
    themselves, the others for those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in names.values())}


class WordTokenizer:
    """``encode_array(texts)`` gives the ids of all texts and where each text's begin and end."""

    def __init__(self, path: str) -> None:
        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        names, vocab = _byte_names(), model["vocab"]

        def spelled(token: str) -> bytes:
            """A token's bytes; a space, which no word holds, marks a word's end."""
            ends = token.endswith(_END)
            return bytes(names[c] for c in token.removesuffix(_END)) + b" " * ends

        # A word's last byte and its end are one symbol from the start: those ranks come first.
        order = [c + _END for c in names] + [*names] + ["".join(m) for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for token in order:
            if ranks.setdefault(spelled(token), len(ids)) == len(ids):
                ids.append(vocab[token])
        self._ids = np.array(ids, dtype="<u4")
        self._ends = np.array([b.endswith(b" ") for b in ranks])
        self._bpe = CoreBPE(ranks, {}, "[^ ]+ ")

    def _plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without odd characters, one after the other, and how many each has."""
        marked = pc.replace_substring_regex(pc.utf8_lower(words), _RUN, "\\1 ")
        runs = pc.count_substring(marked, " ").to_numpy(zero_copy_only=False)
        text = b"".join(marked.cast(pa.binary()).to_pylist()).decode()
        ranks = np.frombuffer(self._bpe.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32)
        stops = np.flatnonzero(self._ends[ranks]) + 1
        return self._ids[ranks], np.diff(np.r_[0, stops[np.cumsum(runs) - 1]])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all ``texts``, and the len(texts) + 1 offsets of each text in them.

        Null texts have none, like empty ones.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        # Outer white space leaves empty words; they have no ids.
        coded = split.flatten().dictionary_encode()
        words, uses = coded.dictionary, coded.indices.to_numpy()
        odd = pc.or_(pc.match_substring_regex(words, _ODD_WORD), pc.greater(pc.binary_length(words), _LONGEST)).to_numpy(zero_copy_only=False)
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        counts, parts = np.zeros(len(words), np.int64), []
        plain, rare = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd)
        if len(plain):
            ids, counts[plain] = self._plain_words(words.take(pa.array(plain)))
            parts.append(ids)
        if len(rare):
            held = [np.array(self._tok.encode(w, add_special_tokens=False).ids, np.uint32) for w in words.take(pa.array(rare)).to_pylist()]
            counts[rare] = [len(h) for h in held]
            parts += held
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        # Where each distinct word's ids begin: plain words come first, then the odd ones.
        order = np.r_[plain, rare].astype(np.int64)
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        lengths = counts[uses]
        ends = np.cumsum(lengths)
        at = np.repeat(first[uses] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        bounds = split.offsets.to_numpy()
        return ids[at].astype("<u4"), np.r_[0, ends][bounds - bounds[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and path."""
    return WordTokenizer(path)
