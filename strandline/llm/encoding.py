"""Byte-level BPE encoding in executors, by the tokenizers library, with a bounded cache of words.

Byte-level BPE merges only inside a pre-token, and no pre-token reaches across a single space that stands between
two characters other than white space. So a text is cut there, each different piece is encoded once, and a text's ids
are its pieces' ids in a row: the library's own result, tested against it on whole texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable


_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A word of Latin letters, with at most a line feed before it and ASCII marks, but no apostrophe, after it: its
#: pre-tokens are the line feed, the word (with the space before it, where there is one) and all the marks.
_PLAIN = re.compile("(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)").fullmatch


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """A dictionary that makes what it lacks: one look-up for each piece, known or not."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        self[piece] = value = self.make(piece)
        return value


class CachedEncoder:
    """texts -> ids as little-endian unsigned 32-bit integers, in bytes.

    path: a tokenizers JSON file of byte-level BPE without a prefix space. Strings that look like special tokens are
    ordinary text. most: pieces kept, beside those of one call, before the cache
    starts anew (bounds memory to about 200 bytes each; results don't depend on it).
    """

    _open: dict[tuple[str, int], CachedEncoder] = {}

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.known = _Known(self._one)
        # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up in byte order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self._alphabet = {b: 0x100 + i for i, b in enumerate(rest)}
        self._space, self._tokenize = chr(self._alphabet[0x20]), self.tokenizer.model.tokenize
        self._marks = _Known(lambda m: _as_bytes([t.id for t in self._tokenize(m)]) if m else b"")
        self._feed = _as_bytes([self.tokenizer.token_to_id(chr(self._alphabet[0x0A]))])

    def _one(self, piece: str) -> bytes:
        """A word by the library's model itself, without an Encoding; anything else by encode()."""
        if m := _PLAIN(piece):
            feed, word, marks = m.groups()
            word = word if word.isascii() else word.encode().decode("latin-1").translate(self._alphabet)
            ids = [t.id for t in self._tokenize(word if feed else self._space + word)]
            if feed:
                return self._feed + _as_bytes(ids) + self._marks[marks]
            return _as_bytes(ids) + self._marks[marks] if marks else _as_bytes(ids)
        plain = piece[1:] if piece[0] == " " else piece if piece[0] == "\n" else " " + piece
        return _as_bytes(self.tokenizer.encode(plain, add_special_tokens=False).ids)

    @classmethod
    def of(cls, path: str, most: int = 1_000_000) -> CachedEncoder:
        """One encoder for each Python worker and file."""
        if (path, most) not in cls._open:
            cls._open[path, most] = cls(path, most)
        return cls._open[path, most]

    @classmethod
    def forget_words(cls) -> None:
        """Empty the caches of this Python worker's encoders; their vocabularies stay."""
        for encoder in cls._open.values():
            encoder.known.clear()
            encoder._marks.clear()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Keys of the cache: the first starts with a space and stands for itself without it; one that starts with a
        line feed stands for itself; any other stands for itself after a space."""
        if _SPACES.search(text) or text[:1].isspace() or text[-1:].isspace():
            cut = _CUT.split(text)
            # a piece may start with a line feed only where the text does
            return [" " + cut[0], *cut[1:]]
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = " " + cut[0]
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, self.pieces(t))) if t else b"" for t in texts]
