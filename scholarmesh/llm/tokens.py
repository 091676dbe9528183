"""Tokenizer files as encoders that give numpy ids; loaded once per Python worker.

The vocabularies are applied by a byte-pair encoder that takes ranks. Texts for which its result could differ from the
tokenizers library (strings of added tokens, characters outside the verified range) are given to that library itself.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

MARK = "\x01"  # ends a word inside the word encoder; texts that contain it go to the library
LATIN = 0x180  # the word encoder's own splitting is used below this code point


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


@lru_cache(maxsize=4)
def rank_encoder(path: str):
    """Encoder of a .tiktoken file with the public pattern."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(path: str, text: str) -> np.ndarray:
    return np.array(_library(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.added = path, [t["content"] for t in spec["added_tokens"]]
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        merged = [vocab[a + b] for a, b in _pairs(spec["model"])]
        if merged != sorted(merged):  # ids serve as ranks only if they follow the merges
            raise ValueError("the ids of this vocabulary are not in the order of its merges")
        self.encoder = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return library_ids(self.path, text)
        return np.asarray(self.encoder.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)


class WordBpe:
    """Ids of a lower-casing BPE file whose words end in `</w>`.

    A word is its bytes and MARK; byte + MARK merges first, as the library starts from the marked last byte.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.added = path, [t["content"] for t in spec["added_tokens"]]
        letters, vocab, end = byte_alphabet(), spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        mark = MARK.encode()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token.removesuffix(end)) + mark * token.endswith(end)

        ends = [bytes([b]) + mark for b in range(256)]
        merges = [raw(a) + raw(b) for a, b in _pairs(spec["model"])]
        order = [*ends, *merges, *(bytes([b]) for b in range(256))]
        self.to_id = np.zeros(len(order), dtype=np.uint32)
        by_bytes = {raw(t): i for t, i in vocab.items() if t not in self.added}
        for rank, token in enumerate(order):
            self.to_id[rank] = by_bytes.get(token, 0)
        self.encoder = tiktoken.Encoding("word", pat_str=f"[^{MARK}]+{MARK}", special_tokens={},
                                         mergeable_ranks={t: r for r, t in enumerate(order)})
        if len(set(order)) != len(order):
            raise ValueError("two merges of this vocabulary give the same word piece")
        kinds = [0 if c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3)
                 for c in map(chr, range(LATIN))]
        self.kinds = np.array(kinds, dtype=np.uint8)
        self.odd = re.compile(f"[{MARK}\x1c-\x1fİ]|[^\x00-{chr(LATIN - 1)}]")

    def marked(self, text: str) -> str:
        """The lower-cased words, each followed by MARK, for texts below LATIN."""
        low = text.lower()
        code = np.frombuffer(low.encode("utf-16-le"), dtype=np.uint16)
        kind = self.kinds[code]
        end = np.empty(len(kind), dtype=bool)
        if len(kind):
            np.not_equal(kind[:-1], kind[1:], out=end[:-1])
            end[-1] = True
            end |= kind == 2
            end &= kind > 0
        if "'" in low:
            end = self._contractions(low, end)
        word = kind > 0
        place = np.cumsum(word) + np.cumsum(end) - end - 1
        out = np.full(int(word.sum() + end.sum()), ord(MARK), dtype=np.uint16)
        out[place[word]] = code[word]
        return out.tobytes().decode("utf-16-le")

    def _contractions(self, low: str, end: np.ndarray) -> np.ndarray:
        """Around an apostrophe the pattern is applied by itself: to the run without white space that holds it."""
        for run in re.finditer(r"[^\t-\r \x85\xa0]*'[^\t-\r \x85\xa0]*", low):
            end[run.start():run.end()] = False
            at = run.start()
            for m in CONTRACTED.finditer(run[0]):
                end[at + m.end() - 1] = True
        return end

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text) or any(t in text for t in self.added):
            return library_ids(self.path, text)
        return self.to_id[self.encoder.encode_to_numpy(self.marked(text), disallowed_special=())]


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


#: The library's contractions and classes, for code points below LATIN.
CONTRACTED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^\s{_latin('L')}{_latin('N')}]+")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def public_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
