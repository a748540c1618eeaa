"""Token ids by the tokenizers library, for whole batches of texts at once.

A byte-level BPE never merges across pre-tokens. So a text may be cut wherever a
pre-token is sure to begin, judged by the two bytes at the cut: where white
space follows something else, and between letters, digits and symbols of ASCII
and Latin (apostrophes, other scripts and rare separators are left uncut). The
library encodes each distinct piece once; a hash table in numpy, keyed by all
bytes of the piece, gives the ids of the others. Texts that hold an added token,
and tokenizers of another kind, are encoded whole by the library. Null counts as
empty.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from lodestream.llm import words as W

#: Slots of the table, and entries at which it is begun anew.
SLOTS, MOST = 1 << 21, 1_300_000
#: Pieces of more bytes are kept in a dictionary, which is begun anew at so many.
KEYED, MOST_LONG = 16, 20_000
SPACE, BLANK, LETTER, DIGIT, SYMBOL, APOSTROPHE, OTHER = range(7)
#: One pre-token: a word, a number or symbols, with a space perhaps.
SINGLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def _classes() -> np.ndarray:
    """By byte. 0xC3 to 0xC8 begin the letters from U+00C0 to U+023F."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x21:0x7F] = SYMBOL
    kind[9:14], kind[0x20], kind[0x27] = BLANK, SPACE, APOSTROPHE
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0xC3:0xC9] = LETTER
    return kind


def _cuts() -> np.ndarray:
    """By the classes before and after: a pre-token begins there."""
    cut = np.zeros((7, 7), bool)
    cut[[LETTER, DIGIT, SYMBOL, APOSTROPHE, OTHER], SPACE] = cut[[LETTER, DIGIT, SYMBOL, APOSTROPHE, OTHER], BLANK] = True
    cut[LETTER, [DIGIT, SYMBOL, APOSTROPHE]] = cut[DIGIT, [LETTER, SYMBOL, APOSTROPHE]] = cut[SYMBOL, [LETTER, DIGIT]] = True
    return cut.ravel()


CLASS, CUT = _classes(), _cuts()
KNOWN = np.zeros(256, bool)
KNOWN[[LETTER, DIGIT, SYMBOL, APOSTROPHE]] = True
LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _printable() -> dict[int, str]:
    """Byte values as byte-level vocabularies write them: printable ones as they are, the others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


PRINTABLE = _printable()
_made: dict[str, Encoder] = {}


def cut_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin, ascending: the starts of rows that aren't empty, and places inside."""
    n = len(data)
    kind = CLASS[data]
    wide = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    wide = wide[wide + 1 < n]
    sign = (data[wide] == 0xC3) & ((data[wide + 1] == 0x97) | (data[wide + 1] == 0xB7))  # times, divided by
    kind[wide + 1] = LETTER
    kind[wide[sign]] = kind[wide[sign] + 1] = OTHER
    begins = np.zeros(n + 1, bool)
    begins[1:n] = CUT[kind[:-1] * np.uint8(7) + kind[1:]]
    begins[off] = True
    # white space after a character that might be white space itself
    at = np.flatnonzero(begins[1:n] & (kind[:-1] == OTHER)) + 1
    if len(at):
        last, before, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        doubt = (last < 0x80) | (before == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))
        begins[at[doubt & ~np.isin(at, off)]] = False
    # after a single line break or tab
    alone = np.flatnonzero(begins[: n - 1] & (kind[:-1] == BLANK)) if n else np.zeros(0, np.int64)
    begins[alone[KNOWN[kind[alone + 1]]] + 1] = True
    return np.flatnonzero(begins[:n])


class Table:
    """Ids of pieces of up to KEYED bytes, by open addressing; all bytes of a key are compared."""

    def __init__(self):
        self.rows = np.zeros((SLOTS, 4), np.uint64)  # first eight bytes, last eight, length and count of ids, where they start
        self.count = 0

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (W.mix(a * W.BASE ^ W.mix(b + size)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, start) for each key."""
        slot = self._slot(a, b, size)
        row = self.rows.take(slot, axis=0)
        known = (row[:, 0] == a) & (row[:, 1] == b) & ((row[:, 2] & np.uint64(255)) == size)
        open_ = np.flatnonzero(~known & (row[:, 2] > 0))
        while len(open_):  # the place was another key's
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            got = self.rows[slot[open_]]
            same = (got[:, 0] == a[open_]) & (got[:, 1] == b[open_]) & ((got[:, 2] & np.uint64(255)) == size[open_])
            row[open_[same]], known[open_[same]] = got[same], True
            open_ = open_[~same & (got[:, 2] > 0)]
        return known, (row[:, 2] >> np.uint64(8)).astype(np.int64), row[:, 3].astype(np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, count: np.ndarray, start: np.ndarray) -> None:
        """Keys that differ and aren't in the table."""
        slot, left = self._slot(a, b, size), np.arange(len(a))
        value = np.stack([a, b, size | (count.astype(np.uint64) << np.uint64(8)), start.astype(np.uint64)], 1)
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = first[self.rows[slot[left[first]], 2] == 0]
            self.rows[slot[left[first]]] = value[left[first]]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.count += len(a)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made["normalizer"] is None
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.added = [t["content"].encode() for t in made["added_tokens"]]
        self._clear()

    def _clear(self) -> None:
        self.table, self.long = Table(), {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.rows(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()

    def _piece(self, piece: bytes) -> list[int]:
        if SINGLE.fullmatch(piece):
            shown = piece.decode().replace(" ", PRINTABLE[32]) if piece.isascii() else piece.decode("latin-1").translate(PRINTABLE)
            return [t.id for t in self.model.tokenize(shown)]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def _keep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(count, start) of the ids of each piece, which are put at the end of ``flat``."""
        got = [self._piece(p) for p in pieces]
        count = np.array([len(g) for g in got], np.int64)
        new = np.array([i for g in got for i in g], np.uint32)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(new), np.uint32)])
        start = self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        return count, start

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, start) in ``flat`` for each piece."""
        if self.table.count > MOST or len(self.long) > MOST_LONG:
            self._clear()
        raw = data.tobytes()
        eight = np.ndarray(len(data) + 1, "<u8", raw + bytes(8), strides=(1,))
        size = ends - starts
        short = np.flatnonzero(size <= KEYED)
        s, e, n = starts[short], ends[short], size[short]
        a = eight[s] & LOW[np.minimum(n, 8)]
        b = np.where(n > 8, eight[np.maximum(e - 8, 0)], np.uint64(0))
        n = n.astype(np.uint64)
        known, have, at = self.table.find(a, b, n)
        missing = np.flatnonzero(~known)
        while len(missing):
            _, one = np.unique(W.mix(a[missing] * W.BASE ^ W.mix(b[missing] + n[missing])), return_index=True)
            pick = missing[one]
            self.table.add(a[pick], b[pick], n[pick], *self._keep([raw[i:j] for i, j in zip(s[pick].tolist(), e[pick].tolist(), strict=True)]))
            known, have[missing], at[missing] = self.table.find(a[missing], b[missing], n[missing])
            missing = missing[~known]
        count, start = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        count[short], start[short] = have, at
        longer = np.flatnonzero(size > KEYED)
        pieces = [raw[i:j] for i, j in zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)]
        if fresh := list(dict.fromkeys(p for p in pieces if p not in self.long)):
            self.long.update(zip(fresh, zip(*(x.tolist() for x in self._keep(fresh)), strict=True), strict=True))
        if pieces:
            count[longer], start[longer] = np.array([self.long[p] for p in pieces], np.int64).T
        return count, start

    def rows(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end_id`` if given, and the offsets of rows in them."""
        rows = len(off) - 1
        whole = np.zeros(rows, bool)
        if not self.cuts:
            whole[:] = np.diff(off) > 0
        elif self.added:
            raw = data.tobytes()
            for mark in self.added:
                at = raw.find(mark)
                while at >= 0:
                    whole[np.searchsorted(off, at, "right") - 1] = True
                    at = raw.find(mark, at + 1)
        starts = cut_points(data, off)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(off, starts, "right") - 1
        if whole.any():
            keep = ~whole[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        count, start = self._pieces(data, starts, ends)
        more = int(end_id is not None)
        size = np.bincount(row, count, minlength=rows).astype(np.int64)
        apart = {k: np.frombuffer(self.whole(data[off[k] : off[k + 1]].tobytes().decode()), "<u4") for k in np.flatnonzero(whole).tolist()}
        for k, ids in apart.items():
            size[k] = len(ids)
        at = np.zeros(rows + 1, np.int64)
        np.cumsum(size + more, out=at[1:])
        out = np.zeros(at[-1], np.uint32)
        # pieces follow each other but for end ids and rows that were encoded whole
        first = np.cumsum(count) - count
        ids = self.flat[np.repeat(start - first, count) + np.arange(int(count.sum()))]
        if more or apart:
            taken = np.zeros(len(out), bool)
            if more:
                taken[at[1:] - 1] = True
            for k in apart:
                taken[at[k] : at[k] + size[k]] = True
            out[~taken] = ids
            if more:
                out[at[1:] - 1] = end_id
            for k, ids in apart.items():
                out[at[k] : at[k] + size[k]] = ids
        else:
            out = ids
        return out, at


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
