"""Token numbers of whole texts by a given lower-casing word tokenizer."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

KEPT = 500_000  # chunks, and words, whose numbers a worker remembers unless told otherwise
KEPT_CHARS = 64  # longer chunks are not remembered

# Chunks of these letters have no other form under NFC and are lower-cased letter by letter.
_FIRST, _LAST = "¡", "ɏ"
_PLAIN = re.compile(rf"[\x21-\x7e{_FIRST}-{_LAST}]+").fullmatch
_LOWERED = "".join({c for i in range(ord(_FIRST), ord(_LAST) + 1) for c in chr(i) + chr(i).lower()})
_LETTERS, _NUMBERS = (rf"{ascii}{''.join(regex.findall(kind, _LOWERED))}" for ascii, kind in (("A-Za-z", r"\p{L}"), ("0-9", r"\p{N}")))
# Fixed value: the pattern by which the tokenizer cuts words, for these letters.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall


class WordTokenizer:
    """``encode`` of the library, text by text, with the numbers of known words remembered.

    White space always ends a word, so a text's numbers are those of its chunks
    put together.  Of chunks of plain letters the words are cut here and only
    merged by the library; others are its own from end to end.
    """

    def __init__(self, path: str, remember: int = KEPT):
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.chunks = _Chunks(self, remember)
        self.words: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Numbers of each text as little-endian unsigned 32-bit integers."""
        known = self.chunks.__getitem__
        return (b"".join(map(known, _split(text))) for text in texts)

    def word(self, word: str) -> bytes:
        """Numbers of a word as the pattern cuts it, lower-cased."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        numbers = [token.id for token in self.merge(letters)]
        return struct.pack(f"<{len(numbers)}I", *numbers)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Chunks(dict):
    """Numbers of each chunk asked for; remembered, but for long ones."""

    def __init__(self, tokenizer: WordTokenizer, remember: int):
        self.tokenizer, self.remember = tokenizer, remember

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one word, which most chunks are
            numbers = self._word(chunk.lower())
        elif (chunk.isprintable() if chunk.isascii() else _PLAIN(chunk)) and "<|" not in chunk:
            numbers = b"".join(map(self._word, _WORDS(chunk.lower())))
        else:
            numbers = self.tokenizer.whole(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= self.remember:
                self.clear()
            self[chunk] = numbers
        return numbers

    def _word(self, word: str) -> bytes:
        words = self.tokenizer.words
        numbers = words.get(word)
        if numbers is None:
            numbers = self.tokenizer.word(word)
            if len(word) <= KEPT_CHARS:
                if len(words) >= self.remember:
                    words.clear()
                words[word] = numbers
        return numbers


def _letters() -> dict[int, int]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest go from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [byte for byte in range(256) if byte not in own]
    return {byte: 256 + i for i, byte in enumerate(rest)}


LETTERS = _letters()


def _split(text: str) -> list[str]:
    if text.isascii() and "<|" not in text:
        text = text.lower()  # fewer different chunks
    for space in "\n\t\r":
        text = text.replace(space, " ")
    return text.split(" ")
