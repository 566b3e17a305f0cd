"""Token ids of whole texts by the tokenizers library, with words cached.

The tokenizer drops white space and never joins characters across it, so a text's ids are its words' ids in order.
Words are cut at ASCII white space with A-Z lower-cased, which the tokenizer does itself; a text that holds ``<|`` is
encoded whole, as special tokens are found before lower-casing.
"""

from __future__ import annotations

import re

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
_LETTERS = re.compile(rb"[a-z]+\Z")
_ENDS = ".,;:!?"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def _plain(word: str) -> bool:
    """Letters of Latin scripts only: one pre-token, whose lower-casing and normal form hold no surprise."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Word (bytes) to its ids as little-endian unsigned 32-bit integers; bounded, filled as words come."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        if _LETTERS.match(word):
            ids = [t.id for t in self.model.tokenize(word.decode())]
        else:
            text = word.decode("utf-8", "surrogatepass")
            stem = text.rstrip(_ENDS)
            if stem != text and stem and _plain(stem):
                self[word] = both = self[stem.encode()] + self[text[len(stem) :].encode()]
                return both
            if stem == text and _plain(text):
                ids = [t.id for t in self.model.tokenize("".join([_BYTE_LETTERS[b] for b in text.lower().encode()]))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        got = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text, 4 bytes each."""
        if not text:
            return b""
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept between batches and tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
