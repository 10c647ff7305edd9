"""Ids of a tokenizers file whose pieces never span white space, each distinct piece encoded once per worker.

Batches of whole texts are cut into pieces by numpy, Arrow numbers the distinct ones, and the library encodes those not
seen before.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The lead byte of À to ÿ, of which all but the two signs at 0x97 and 0xB7 are letters.
_LATIN = 0xC3
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: How the library's byte-level alphabet writes each byte: printable ones as themselves, the rest from U+0100 on; the line
#: break, which stands between pieces, stays.
_SHOWN = np.arange(256, dtype="<u4")
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SHOWN[_HIDDEN] = np.arange(0x100, 0x100 + len(_HIDDEN))
_SHOWN[0x0A] = 0x0A
#: Longer pieces are encoded each time they occur, so that a table's size is bounded by its number of entries.
LONGEST = 256


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, where each starts and the last ends)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(start of each piece, the pieces in lower case): runs of letters, single digits, runs of other signs, and the
    English contractions that begin with an apostrophe.

    A word with any byte but ASCII and Latin-1 letters is one piece as it stands; only the library knows how to cut it.
    """
    n = len(raw)
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw == _LATIN)
    if len(lead):
        second = raw[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] += np.where(second <= 0x9E, 32, 0).astype(np.uint8)
    first = np.zeros(n + 1, bool)
    first[at] = True
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        bounds = np.union1d(np.flatnonzero(kind == _SPACE), at)
        i = np.unique(np.searchsorted(bounds, odd, "right"))
        a, b = bounds[i - 1], bounds[i]
        a = a + (kind[a] == _SPACE)
        inside = np.zeros(n + 1, np.int8)
        inside[a] += 1
        inside[b] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8).view(bool)
        kind[inside] = _ODD
        low[inside] = raw[inside]
    start = kind == _DIGIT
    start[1:] |= kind[1:] != kind[:-1]
    start |= first[:n]
    start &= kind != _SPACE
    mark = np.flatnonzero((raw == 0x27) & start & (kind == _SIGN))
    if len(mark):
        end = at[np.searchsorted(at, mark, "right")]
        c1, c2 = (np.where(mark + k < end, low[np.minimum(mark + k, n - 1)], 0) for k in (1, 2))
        mark_kind = kind[np.minimum(mark + 1, n - 1)] == _LETTER
        one = mark_kind & ((c1 == ord("s")) | (c1 == ord("t")) | (c1 == ord("m")) | (c1 == ord("d")))
        two = mark_kind & (((c2 == ord("e")) & ((c1 == ord("r")) | (c1 == ord("v")))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for hit, size in ((one, 2), (two, 3)):
            start[mark[hit] + 1] = False
            stop = (mark[hit] + size)[mark[hit] + size < end[hit]]
            start[stop[kind[stop] != _SPACE]] = True
    held = kind != _SPACE
    where = np.flatnonzero(start)
    offsets = np.cumsum(held, dtype=np.int32)[where] - 1
    body = low[held]
    offsets = np.append(offsets, np.int32(len(body))).astype(np.int32)
    return where, pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


class WordEncoder:
    """encode() gives what the library gives for each whole text without special tokens.

    ``cut`` cuts texts where the library's pieces surely end. Pieces that match ``plain`` the library doesn't cut further, so
    its model takes them at once; the others go through all its steps.
    """

    cut = staticmethod(cut)
    plain = staticmethod(_PLAIN)

    def __init__(self, path: str, cached: int = 750_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.cached = cached
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.used = self.size = 0

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def _modelled(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of plain pieces, from the library's model alone."""
        tokenize = self.tokenizer.model.tokenize
        out: list[list[int]] = []
        for at in range(0, len(pieces), 1 << 15):
            shown = _SHOWN[np.frombuffer(b"\n".join(pieces[at : at + (1 << 15)]), np.uint8)].tobytes().decode("utf-32-le")
            out.extend([t.id for t in tokenize(c)] for c in shown.split("\n"))
        return out

    def _room(self, name: str, least: int) -> None:
        held = getattr(self, name)
        if len(held) < least:
            setattr(self, name, np.concatenate([held, np.zeros(max(len(held), least - len(held)), held.dtype)]))

    def _add(self, keys: list[bytes]) -> np.ndarray:
        """Entries of the table for keys; long ones are added but not remembered."""
        plain = np.fromiter((self.plain(k) is not None for k in keys), bool, len(keys))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        keys = [keys[i] for i in order.tolist()]
        n = int(plain.sum())
        made = self._modelled(keys[:n]) + self._library(keys[n:])
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        total = int(sizes.sum())
        self._room("starts", self.used + len(keys))
        self._room("counts", self.used + len(keys))
        self._room("ids", self.size + total)
        entry = np.arange(self.used, self.used + len(keys))
        self.counts[entry] = sizes
        self.starts[entry] = self.size + np.cumsum(sizes) - sizes
        self.ids[self.size : self.size + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.known.update((k, e) for k, e in zip(keys, entry.tolist(), strict=True) if len(k) <= LONGEST)
        self.used, self.size = self.used + len(keys), self.size + total
        out = np.empty(len(keys), np.int64)
        out[order] = entry
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each); null texts count as empty, end_id ends each text."""
        raw, at = _text_bytes(texts)
        data = raw.tobytes()
        if any(s in data for s in self.special):
            return self._with_special(data, at, end_id)
        where, pieces = self.cut(raw, at)
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if self.used > self.cached or self.size > 8 * self.cached:
            self._clear()
        entry = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int32, len(keys))
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._add([keys[i] for i in new.tolist()])
        entry = entry[coded.indices.to_numpy()]
        counts = self.counts[entry]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        shift = self.starts[entry] - ends[:-1].astype(np.int32)
        ids = self.ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift, counts)]
        cuts = ends[np.searchsorted(where, at)]
        sizes = np.diff(cuts)
        if end_id is not None:
            ids, sizes = np.insert(ids, cuts[1:], np.uint32(end_id)), sizes + 1
        return ids, sizes

    def _with_special(self, data: bytes, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As encode(): texts with the string of a special token go to the library whole."""
        out, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = data[a:b]
            if any(s in text for s in self.special):
                ids = np.array(self._library([text])[0], np.uint32)
                out.append(ids if end_id is None else np.append(ids, np.uint32(end_id)))
                sizes.append(np.array([len(out[-1])]))
            else:
                ids, n = self.encode(pa.array([text], pa.binary()), end_id)
                out.append(ids)
                sizes.append(n)
        return np.concatenate(out), np.concatenate(sizes)


#: Last bytes of white space that isn't ASCII; after a byte 0xC3 they end a letter.
_UNSURE = np.zeros(256, bool)
_UNSURE[[*range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def cut_bytes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(start of each piece, the pieces), all bytes kept: cut before white space, behind a single line break or tab, and
    between letters, digits and what follows them, letters being those of ASCII and Latin-1.

    For a byte-level tokenizer that joins one space to the word behind it and lets an apostrophe join letters behind it.
    Where white space may go on before the cut, in other characters, nothing is cut.
    """
    kind = _KIND[raw]
    lead = np.flatnonzero(raw == _LATIN)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    start = np.zeros(len(raw) + 1, bool)
    here, before = kind[1:], kind[:-1]
    start[1:-1] = ((before == _LETTER) | (before == _DIGIT)) & (here != before) & (here != _ODD)
    # a single white-space character but the space stands alone
    start[2:-1] |= (before[1:] == _SPACE) & (raw[1:-1] != 0x20) & (here[1:] < _ODD) & (here[1:] != _SPACE) & (before[:-1] < _ODD) & (before[:-1] != _SPACE)
    space = np.flatnonzero((here == _SPACE) & (before != _SPACE)) + 1
    sure = ~_UNSURE[raw[space - 1]] | ((raw[space - 1] >= 0x80) & (raw[np.maximum(space - 2, 0)] == _LATIN))
    start[space] = sure
    start[at] = True
    where = np.flatnonzero(start[:-1])
    offsets = np.append(where, len(raw)).astype(np.int32)
    return where, pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


class ByteEncoder(WordEncoder):
    """The same for byte-level files, whose pieces keep their case and the space before them."""

    cut = staticmethod(cut_bytes)
    plain = staticmethod(re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~])").fullmatch)


@lru_cache(maxsize=4)
def encoder(path: str, kind: type[WordEncoder] = WordEncoder) -> WordEncoder:
    """One per Python worker, so its table outlives a task."""
    return kind(path)
