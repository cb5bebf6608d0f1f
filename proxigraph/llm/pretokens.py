"""Token ids of whole texts, exactly as the tokenizers library gives them, at the speed of a regular expression.

Both vocabularies cut a text into pre-tokens by a pattern and encode each
on its own, so a bounded memo of pre-tokens gives the library's ids without
its per-text work. Texts whose characters the memo's patterns don't cover
(beyond Latin Extended-A), or that hold a special token's string, go to the
library whole; the result is the same either way. The memo has two
generations: when the young one is full it becomes the old one, so frequent
pre-tokens stay and memory is bounded.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from struct import pack

import numpy as np

from proxigraph.llm.common import worker_state

#: Pre-tokens in a generation; about 200 bytes each.
MEMO = 400_000
#: Characters whose class, case and normal form the patterns below cover.
COVERED = 0x180


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(COVERED) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), r"\t-\r \x85\xa0"
#: The pre-tokenizers' patterns (fixed by the vocabularies), with classes spelled out for covered characters.
BYTE_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
WORD_PATTERN = rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """pre-token -> value(ids of the pre-token)."""

    def __init__(self, model, value: Callable[[list[int]], object], size: int):
        super().__init__()
        self.model, self.value, self.size, self.old = model, value, size, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                spelled = piece.replace(" ", BYTE_LETTERS[32])
            else:
                spelled = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = self.value([t.id for t in self.model.tokenize(spelled)])
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Encodes whole texts with one of the two vocabularies; path: the tokenizer's file."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None
        self.cut = re.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        # U+0130 has a lower case of two characters, one of them not covered.
        self.covered = re.compile("[\x00-įı-ſ]*" if self.lower else "[\x00-ſ]*").fullmatch
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.by_bytes = Memo(self.library.model, lambda ids: pack(f"<{len(ids)}I", *ids), memo)
        self.by_count = Memo(self.library.model, len, memo)

    def plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # far quicker than the pattern
        except UnicodeEncodeError:
            if self.covered(text) is None:
                return False
        return not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a plain text."""
        return self.cut(text.lower() if self.lower else text)

    def cuts(self, text: str) -> list[str]:
        """Pre-tokens of any text without special tokens' strings: by the pattern where it covers the text, else by the library."""
        if self.plain(text):
            return self.pieces(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens of the library's own."""
        if self.plain(text):
            return b"".join(map(self.by_bytes.__getitem__, self.pieces(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.by_count.__getitem__, pieces))


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for this file; tasks share it. It lives as long as the worker, so pipelines of several stages take a smaller memo."""
    cache = worker_state().__dict__.setdefault("encoders", {})
    if (path, memo) not in cache:
        cache[path, memo] = Encoder(path, memo)
    return cache[path, memo]


def library_ids(path: str, texts: list[str]) -> list[list[int]]:
    """The library's own answer, for tests."""
    return [e.ids for e in encoder(path).library.encode_batch(texts, add_special_tokens=False)]
