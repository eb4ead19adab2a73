"""Encoding texts with a public tokenizer, one call of the library per distinct piece of text.

A text is cut, on its bytes, before a blank or line end that follows another
character, after a line end between other characters, and before a sign of ASCII
after a letter or digit. Neither tokenizer's splitting rule joins what
stands on the two sides, so the ids of a text are the ids of its pieces one after
another. Ids of pieces are kept by the pieces' 64-bit hashes in a table of bounded size.
"""

from __future__ import annotations

import gc
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from terrane.llm.common import hash_pieces, string_bytes

_BLANK, _LINE, _SIGN, _ALNUM, _SOLID, _HIGH, _LEAD = 1, 2, 4, 8, 16, 32, 64


def _kinds() -> np.ndarray:
    """What each byte is. Solid are those that certainly are no white space; the leads of white space beyond ASCII are not."""
    kind = np.zeros(256, np.uint8)
    kind[ord(" ")], kind[ord("\n")] = _BLANK, _LINE
    kind[0x21:0x7F] = _SOLID
    kind[0x80:] = _SOLID | _HIGH
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = _HIGH | _LEAD
    for c in range(0x21, 0x7F):
        kind[c] |= _ALNUM if chr(c).isalnum() else _SIGN
    return kind


_KIND = _kinds()



def _wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is U+0085, U+00A0, U+1680, U+2000..200A, 2028, 2029, 202F, 205F or 3000."""
    a, b, c = raw[np.maximum(at - 3, 0)], raw[np.maximum(at - 2, 0)], raw[at - 1]
    general = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF))) | (b == 0x81) & (c == 0x9F))
    return general | (b == 0xC2) & np.isin(c, (0x85, 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _latin(raw: np.ndarray) -> np.ndarray:
    """Which bytes end a letter of Latin-1 beyond ASCII: all of U+00C0..00FF but the two signs among them."""
    out = np.zeros(len(raw), bool)
    out[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    return out


def cuts(raw: np.ndarray) -> np.ndarray:
    """For each byte whether a piece may begin there."""
    kind = _KIND[raw]
    after = np.zeros(len(raw), np.uint8)  # the kind of the byte before
    after[1:] = kind[:-1]
    gap = (kind & (_BLANK | _LINE)) != 0
    solid = (after & _SOLID) != 0
    word = (after & _ALNUM) != 0
    word[1:] |= _latin(raw)[:-1]
    begin = gap & solid | ((kind & _SIGN) != 0) & word
    # The character before a blank may be white space beyond ASCII.
    at = np.flatnonzero(gap & ((after & _HIGH) != 0))
    begin[at[_wide_space(raw, at)]] = False
    lines = np.flatnonzero(begin & (kind == _LINE))
    lines = lines[lines + 1 < len(raw)] + 1
    begin[lines[(kind[lines] & _SOLID) != 0]] = True
    return begin


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each Python worker, so that later tasks find its pieces; its size is bounded."""
    return Encoder(path, end_id)


class Encoder:
    """Ids of many texts. keep: how many pieces, and ids six times as many, are remembered at most between calls.

    Special tokens in a text are encoded as the library does, so that none is cut.
    """

    def __init__(self, path: str, end_id: int, keep: int = 1_200_000):
        self.tokenizer, self.end_id, self.keep = tokenizer(path), end_id, keep
        self.special = [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending hashes of pieces, their numbers
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)  # by number

    def __call__(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end id, and the number of ids of each text."""
        strings = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        data, at = string_bytes(strings)
        raw = np.frombuffer(data, np.uint8)
        begin = cuts(raw)
        self._spare_special(bytes(data), begin)
        begin[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begin)
        piece_lengths = np.diff(np.append(starts, len(raw)))
        first = np.searchsorted(starts, at)  # each text's first piece
        if len(self.hashes) > self.keep or len(self.flat) > 6 * self.keep:
            self._reset()
        number = self._numbers(hash_pieces(raw, piece_lengths), starts, piece_lengths, raw)
        lengths = self.lengths[number].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        n_ids = ends[first[1:]] - ends[first[:-1]]
        body = self.flat[np.repeat(self.starts[number] - ends[:-1], lengths) + np.arange(ends[-1])]
        out = np.full(len(body) + len(n_ids), self.end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n_ids + 1) - 1] = False
        out[inner] = body
        return out, n_ids + 1

    def _spare_special(self, data: bytes, begin: np.ndarray) -> None:
        for word in self.special:
            at = data.find(word)
            while at >= 0:
                begin[at + 1 : at + len(word)] = False
                at = data.find(word, at + 1)

    def _numbers(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Each piece's number in the table, into which new pieces are taken."""
        coded = pa.array(hashes).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        number = np.zeros(len(distinct), np.int32)
        number[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            # Codes are given in the order of first occurrence.
            where = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))[new]
            number[new] = self._learn(raw, starts[where], lengths[where])
            order = np.argsort(distinct[new])
            to = np.searchsorted(self.hashes, distinct[new][order])
            self.hashes = np.insert(self.hashes, to, distinct[new][order])
            self.number = np.insert(self.number, to, number[new][order])
        return number[code]

    def _learn(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers under which new pieces are taken into the table."""
        number = np.zeros(len(starts), np.int32)
        for part in np.array_split(np.arange(len(starts)), -(-len(starts) // 20_000)):
            flat, n = self._pieces(raw, starts[part], lengths[part])
            number[part] = np.arange(len(self.lengths), len(self.lengths) + len(part), dtype=np.int32)
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(n) - n).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, n.astype(np.int32)])
            self.flat = np.concatenate([self.flat, flat])
        return number

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [str(raw[a : a + n].tobytes(), "utf-8") for a, n in zip(starts.tolist(), lengths.tolist())]
        gc.disable()  # the many short lists made here are no garbage
        try:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        finally:
            gc.enable()
        n = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(n.sum())), n
