"""Fast batch encoding with a public tokenizer.

The tokenizer's pre-tokenizer cuts a text at white space and between letters, digits and punctuation,
so a text is a sequence of independent units.  Each distinct unit is encoded once by the library and
kept in a per-process table keyed by its 64-bit hash.  White-space chunks that hold anything beyond
plain letters, digits and ASCII punctuation (apostrophes, marks, special tokens, other scripts) are
one unit each, encoded whole by the library.  The result equals ``Tokenizer.encode`` of the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from quarrylight.llm.textbytes import TextSlice, mix, span_hashes

TABLE_LIMIT = 1_500_000  # distinct units kept for each process; beyond it the table starts afresh
LONG_UNIT = 256

SPACE, LETTER, DIGIT, MARK, COMPLEX = 0, 1, 2, 3, 4
_CLASS = np.full(256, COMPLEX, np.uint8)
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[33:127] = MARK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[[39, 60]] = COMPLEX  # contractions and special tokens
_CLASS[0x80:0xC0] = LETTER  # continuation bytes; their lead byte decides
_CLASS[0xC3:0xC6] = LETTER  # U+00C0 to U+017F


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, ids: list[int] | np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, keys: np.ndarray, units: list[str], letters: np.ndarray) -> None:
        """Encode new units.  Plain letter runs go many to a call: each ends with a word-end token."""
        sizes, at = np.zeros(len(units), np.int32), np.zeros(len(units), np.int64)
        plain = np.flatnonzero(letters)
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units[i] for i in part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) if len(ids) else np.zeros(0, np.int64)
            if len(last) != len(part):
                letters[part] = False
                continue
            at[part] = self.used + np.concatenate([[0], last[:-1] + 1])
            sizes[part] = np.diff(last, prepend=-1)
            self._add(ids)
        other = np.flatnonzero(~letters)
        for i, encoded in zip(other, self.tokenizer.encode_batch_fast([units[i] for i in other], add_special_tokens=False)):
            at[i], sizes[i] = self.used, len(encoded.ids)
            self._add(encoded.ids)
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at = np.insert(self.at, where, at[order])
        self.sizes = np.insert(self.sizes, where, sizes[order])

    def encode(self, piece: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and, for each row, where its ids begin (one more at the end)."""
        data, offsets, n = piece.data, piece.offsets, len(piece.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        two = np.flatnonzero(((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) | ((data[:-1] == 0xC4) & (data[1:] == 0xB0)))
        kind[two] = COMPLEX
        odd = np.flatnonzero(kind == COMPLEX)
        if len(odd):
            solid = kind != SPACE
            begin, stop = solid.copy(), solid.copy()
            begin[1:] &= ~solid[:-1]
            stop[:-1] &= ~solid[1:]
            at = offsets[:-1][offsets[:-1] < n]
            begin[at] = solid[at]
            at = offsets[1:][offsets[1:] > 0] - 1
            stop[at] = solid[at]
            begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            for k in np.unique(np.searchsorted(begin, odd, side="right") - 1):
                kind[begin[k] : stop[k]] = COMPLEX
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[offsets[:-1][offsets[:-1] < n]] = True
        bounds = np.append(np.flatnonzero(first), n)
        solid = kind[bounds[:-1]] != SPACE
        starts, stops = bounds[:-1][solid], bounds[1:][solid]
        kinds = kind[starts]
        del kind, first, bounds, solid
        h = span_hashes(data, starts, stops)
        for k in np.flatnonzero((kinds == COMPLEX) | (stops - starts > LONG_UNIT)):  # case counts there, and no algebraic collisions
            h[k] = hash(data[starts[k] : stops[k]].tobytes()) & 0xFFFFFFFFFFFFFFFF
        h = mix(h + kinds.astype(np.uint64))
        keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > TABLE_LIMIT:
            self._clear()
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        if not known.all():
            new = example[~known]
            units = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), stops[new].tolist())]
            self._learn(keys[~known], units, kinds[new] == LETTER)
            slot = np.searchsorted(self.keys, keys)
        sizes, at = self.sizes[slot][inverse].astype(np.int64), self.at[slot][inverse]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        row_first = np.searchsorted(starts, offsets)
        return ids, np.concatenate([[0], ends])[row_first]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each row's ids."""
    rows = len(first) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(first))] = ids
    return out, first + np.arange(rows + 1)
