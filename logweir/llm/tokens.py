"""Pre-tokens of the two public byte-level vocabularies, split as their library splits them.

The library's own split is exact and slow. Here many texts are split at a time, from the classes of their
characters (letter, digit, blank, sign; the library's classes are Unicode's general categories). Texts
that hold special strings are cut at them first. A pre-token's tokens depend on it alone, so each is
encoded once and kept.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Encoded pre-tokens that one Python process keeps at the most.
MAX_CACHED = 120_000
BLANK, LETTER, DIGIT, SIGN = range(4)
CLASSES = np.full(128, SIGN, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = BLANK
CLASSES[48:58] = DIGIT
CLASSES[65:91] = CLASSES[97:123] = LETTER


@lru_cache(1)
def all_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.array([kinds.get(unicodedata.category(c)[0], SIGN) for c in map(chr, range(0x110000))], np.uint8)
    out[[i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]] = BLANK
    return out


@lru_cache(4)
def tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, asked for where the file is read."""
    import public_tokenizers

    return public_tokenizers.path(name)


def specials(library) -> tuple[str, ...]:
    return tuple(x.content for x in library.get_added_tokens_decoder().values())


def parts(text: str, special: tuple[str, ...]) -> list[str]:
    """A text cut at special strings; one more part than there are of them."""
    out = [text]
    for x in special:
        if x in text:
            out = [y for part in out for y in part.split(x)]
    return out


def lowered(text: str, special: tuple[str, ...]) -> str | None:
    """The text as the vocabulary of lower case has it; None if that takes the library: special strings, what
    is not composed, and the letter whose lower case depends on its neighbours."""
    if text.isascii():
        return None if any(x in text for x in special) else text.lower()
    if "\u03a3" in text or any(x in text for x in special) or not unicodedata.is_normalized("NFC", text):
        return None
    return text.lower()


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in such vocabularies: itself if it shows, else the next from 256 on."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shows]
    return {b: chr(b) for b in shows} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encode_piece(library, piece: bytes) -> list[int]:
    """Ids of one pre-token, given as UTF-8."""
    return [x.id for x in library.model.tokenize(piece.decode("latin-1").translate(byte_letters()))]


def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """Splits 's 't 'm 'd 're 've 'll off where a quote begins a piece. These endings."""
    quote = at[(data[at] == 39) & (kind[at + 1] == LETTER)]
    one, two = data[quote + 1], data[quote + 2]
    length = np.where(np.isin(one, list(b"stmd")), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    after = quote + length
    start[after[kind[after] == LETTER]] = True


def split(texts: list[str], spaced: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and start, end and row of their pre-tokens in them.

    spaced: a blank belongs to the piece after it, digits stay together and every byte is in a piece;
    else blanks are dropped and every digit is a piece (such texts are lower-cased before).
    """
    offsets = np.cumsum([0, *map(len, texts)])
    joined = "".join(texts)
    size, raw = len(joined), joined.encode()
    codes = np.frombuffer(raw, np.uint8) if size == len(raw) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    data = np.concatenate([codes, np.zeros(3, codes.dtype)])
    kind = (CLASSES if size == len(raw) else all_classes())[data]
    kind[size:] = BLANK
    first = np.zeros(size + 3, bool)
    first[offsets[:-1]] = True
    first[size:] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    if not spaced:
        start |= kind == DIGIT
        start &= kind != BLANK
        # a row's end parts a quote from the next row's letters
        at = np.flatnonzero(start & (kind == SIGN))
        at = at[~first[at + 1]]
        _guarded(data, kind, start, at, first)
        start[size:] = False
        ends = (kind[:-1] != BLANK) & ((kind[1:] == BLANK) | start[1:] | first[1:])
        begin, end = np.flatnonzero(start), np.flatnonzero(ends[:size]) + 1
    else:
        after_blank = start & (kind != BLANK) & ~first
        after_blank[1:] &= kind[:-1] == BLANK
        after_blank[0] = False
        at = np.flatnonzero(after_blank[:size])
        space = at[data[at - 1] == 32]  # the space before a piece is its first byte
        start[at - 1] = True
        start[space] = False
        quotes = np.flatnonzero(start[:size] & (kind[:size] == SIGN))
        quotes = quotes[~first[quotes + 1]]
        _guarded(data, kind, start, quotes, first)
        begin = np.flatnonzero(start[:size])
        end = np.append(begin[1:], size) if len(begin) else begin
    row = np.searchsorted(offsets, begin, "right") - 1
    if size < len(raw):
        place = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])
        begin, end = place[begin], place[end]
    return raw, begin, end, row


def _guarded(data: np.ndarray, kind: np.ndarray, start: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
    """Contractions, but none over the end of a row."""
    whole = at[~first[at + 2]]
    _contractions(data, kind, start, whole)
    rest = at[first[at + 2]]  # a quote and one letter at a row's end
    start[rest[(data[rest] == 39) & np.isin(data[rest + 1], list(b"stmd"))] + 1] = False
