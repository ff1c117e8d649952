"""Token ids of whole texts by a public word-end BPE file, with each distinct word encoded once.

The file's normaliser and pre-tokeniser never look across white space, so a text's ids are those of its words in a
row. Plain words go to a fast byte-pair encoder built from the same vocabulary; every other word goes to the
`tokenizers` library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .words import split

#: Stands for the end of a word in the fast encoder; no UTF-8 text holds this byte.
WORD_END = b"\xff"
CACHE_WORDS = 200_000
LETTERS = re.compile(rb"[a-z]+")
#: Words of printable ASCII and Latin letters, which both libraries treat alike.
PLAIN = re.compile("[\x21-\x7e¡-ɏ]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_chars() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordEncoder(dict):
    """Maps words (bytes, A-Z lower-cased) to places in `ids`; a word's ids are ids[at[i] : at[i + 1]]."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.fast = self._fast(path)
        self.clear()

    @staticmethod
    def _fast(path: str):
        """None where ids don't rise in the order of the merges, as the fast encoder merges the least id first."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars, ranks = model["vocab"], _byte_chars(), {}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or merged[0] < 512:
            return None
        for token, number in vocab.items():
            end = token.endswith("</w>")
            ranks[bytes(chars[c] for c in (token[:-4] if end else token)) + WORD_END * end] = number
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def clear(self) -> None:
        super().clear()
        self.ids, self.at, self.by_hash = array("I"), array("q", [0]), {}

    def encoded(self, word: bytes) -> list[int]:
        if self.fast is not None:
            if LETTERS.fullmatch(word):
                return self.fast.encode_single_piece(word + WORD_END)
            text = word.decode("utf-8", "replace")
            if "<|" not in text and PLAIN.fullmatch(text):
                pieces = PIECES.findall(unicodedata.normalize("NFC", text).lower())
                return [i for p in pieces for i in self.fast.encode_single_piece(p.encode() + WORD_END)]
        return self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        self.ids.extend(self.encoded(word))
        self.at.append(len(self.ids))
        self[word] = n = len(self.at) - 2
        return n

    def chunk(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts (bytes, offsets) in a row (uint32), and each text's first and, last, their number.

        Words are told apart by 64-bit hashes, so that each distinct word of the chunk is looked up once.
        """
        if len(self) > CACHE_WORDS:
            self.clear()
        if b"<|" in body.tobytes():
            return self.texts([body[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)])
        words = split(body, at)
        found, first, same = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = np.fromiter((self.by_hash.get(h, -1) for h in found.tolist()), np.int64, len(found))
        for k in np.flatnonzero(place < 0).tolist():
            place[k] = self.by_hash[int(found[k])] = self[words.word(int(first[k]))]
        return self._joined(place[same], words.counts())

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As `chunk`, word by word."""
        places, counts = [], []
        for text in texts:
            words = (text if b"<|" in text else text.lower()).split()
            places.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        return self._joined(np.concatenate(places) if places else np.zeros(0, np.int64), np.array(counts, np.int64))

    def _joined(self, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, ids = np.array(self.at, np.int64), np.array(self.ids, np.uint32)
        size = at[word + 1] - at[word]
        until = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(at[word] - until[:-1], size) + np.arange(until[-1])]
        return flat, until[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
