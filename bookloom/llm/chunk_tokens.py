"""Ids of a public tokenizer for whole columns: numpy finds the words, a table knows their ids.

The tokenizer (``word_bpe``) drops white space, lowers case and cuts texts into words
before it merges pieces, so a text's ids are those of its segments in order. A segment
is a run of plain letters (ASCII and Latin-1, which need no composing) or a run of other
ASCII signs; a blank-free chunk that holds anything else (an apostrophe, other
characters, a special token's opening) is one segment as it stands. Segments of up to 16
bytes are looked up in a direct-mapped table that holds these bytes themselves, longer ones
in a dictionary; those in neither are encoded by the library, once for each batch. Both
are bounded memories and never change a result.
"""

from __future__ import annotations

import os

import numpy as np

from bookloom.llm.textkit import lanes, low_bytes, mix

_BLANK, _LETTER, _SIGN, _ODD = 0, 1, 2, 3
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KINDS[0x21:0x7F] = _SIGN
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KINDS[ord("'")] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of a segment that the table holds.
_HELD = 16


class Segments:
    """Segments of a slice of rows: ``starts``, ``ends`` in ``data``, ``odd`` ones, and ``first`` of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        raw = raw[base : int(offsets[-1])]
        offsets = offsets.astype(np.int64) - base
        n = len(raw)
        kind, data = _KINDS[raw], _LOWER[raw]
        if n > 1:
            lead = np.flatnonzero(raw[:-1] == 0xC3)
            after = raw[lead + 1]
            lead = lead[(after != 0x97) & (after != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
            upper = lead[raw[lead + 1] <= 0x9E] + 1
            data[upper] += 0x20
            opening = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
            kind[opening] = _ODD
        solid = kind != _BLANK
        fresh = np.ones(n, bool)  # the byte before belongs to another chunk
        fresh[1:] = ~solid[:-1]
        cuts = offsets[:-1]
        fresh[cuts[cuts < n]] = True
        chunk_starts = np.flatnonzero(solid & fresh)
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        begin = solid & (fresh | change)
        odd_at = np.flatnonzero(kind == _ODD)
        odd = np.zeros(0, np.int64)
        if len(odd_at):
            odd = np.unique(np.searchsorted(chunk_starts, odd_at, side="right") - 1)
            closes = np.append(chunk_starts[1:], n)
            for a, b in zip(chunk_starts[odd].tolist(), closes[odd].tolist()):
                begin[a + 1 : b] = False
                data[a:b] = raw[a:b]
        self.starts = np.flatnonzero(begin)
        # A segment ends where the next one begins or at the first blank.
        stop = np.append(self.starts[1:], n)
        blanks = np.flatnonzero(~solid)
        at = np.searchsorted(blanks, self.starts)
        blank = np.append(blanks, n)[at]
        rows_end = offsets[np.searchsorted(offsets, self.starts, side="right")]
        self.ends = np.minimum(np.minimum(stop, blank), rows_end)
        self.odd = np.zeros(len(self.starts), bool)
        if len(odd):
            self.odd[np.searchsorted(self.starts, chunk_starts[odd])] = True
        self.data = data
        self.first = np.searchsorted(self.starts, offsets)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each segment's first 16 bytes as two numbers, and its length and kind; 0 for longer ones."""
        at, length = lanes(self.data), self.ends - self.starts
        low = low_bytes(at[self.starts], length)
        high = low_bytes(at[np.minimum(self.starts + 8, len(self.data))], np.maximum(length - 8, 0))
        kind = np.where(length <= _HELD, length + 32 * self.odd, 0).astype(np.uint8)
        return low, high, kind


class ChunkTokenizer:
    def __init__(self, path: str, slot_bits: int = 21, most_ids: int = 6_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.slot_bits, self.most_ids = slot_bits, most_ids
        self._forget()

    def _forget(self) -> None:
        slots = 1 << self.slot_bits
        self.low, self.high, self.kind = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
        self.at, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.long: dict[tuple[bytes, bool], tuple[int, int]] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows one after the other, and where each row begins (one more at the end)."""
        segments = Segments(raw, offsets)
        if not len(segments.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > self.most_ids:
            self._forget()
        low, high, kind = segments.keys()
        slot = (mix(low ^ mix(high + kind)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        known = (kind > 0) & (self.low[slot] == low) & (self.high[slot] == high) & (self.kind[slot] == kind)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        if len(missing):
            places = self._learn(segments, missing)
            at[missing], size[missing] = places[:, 0], places[:, 1]
            # The first to come keeps its slot: common segments come early.
            _, first = np.unique(slot[missing], return_index=True)
            first = missing[first]
            first = first[(kind[first] > 0) & (self.kind[slot[first]] == 0)]
            place = slot[first]
            self.low[place], self.high[place], self.kind[place] = low[first], high[first], kind[first]
            self.at[place], self.size[place] = at[first], size[first]
        ends = np.cumsum(size)
        full = size > 0
        begin, length = at[full], size[full]
        if not len(begin):
            return np.zeros(0, np.uint32), np.concatenate([[0], ends])[segments.first]
        step = np.ones(int(ends[-1]), np.int64)
        heads = np.cumsum(length) - length
        step[heads[0]] = begin[0]
        step[heads[1:]] = begin[1:] - (begin[:-1] + length[:-1] - 1)
        ids = self.pool[np.cumsum(step)]
        return ids, np.concatenate([[0], ends])[segments.first]

    def _learn(self, segments: Segments, which: np.ndarray) -> np.ndarray:
        """Where the ids of some segments are in the pool, and how many."""
        blob = segments.data.tobytes()
        spans = (x[which].tolist() for x in (segments.starts, segments.ends, segments.odd))
        texts = [(blob[a:b], odd) for a, b, odd in zip(*spans)]
        new = {t: i for t, i in zip(texts[::-1], which[::-1].tolist()) if t not in self.long}
        places = {}
        if new:
            ids, sizes = self._encode(segments, np.array(list(new.values())))
            begins = self.used + np.cumsum(sizes) - sizes
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            places = dict(zip(new, zip(begins.tolist(), sizes.tolist())))
            self.long.update((t, p) for t, p in places.items() if len(t[0]) > _HELD)
        return np.array([places.get(t) or self.long[t] for t in texts], np.int64)

    def _encode(self, segments: Segments, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for some segments."""
        data = segments.data.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(segments.starts[which].tolist(), segments.ends[which].tolist())]
        plain = np.array([not o and t[0].isalpha() for o, t in zip(segments.odd[which].tolist(), texts)], bool)
        out, sizes = [], np.zeros(len(texts), np.int64)
        letters = np.flatnonzero(plain)
        if len(letters):
            # One text of all words: a word's last id is the only one that closes a word.
            joined = " ".join([texts[i] for i in letters.tolist()])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters):
                out.append(ids)
                sizes[letters] = np.diff(ends, prepend=0)
            else:
                letters, plain[:] = letters[:0], False
        rest = np.flatnonzero(~plain)
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)
        for i, one in zip(rest.tolist(), found):
            out.append(np.array(one.ids, np.uint32))
            sizes[i] = len(one.ids)
        # From the order of encoding to the order of the segments.
        order = np.concatenate([letters, rest])
        begins = np.zeros(len(texts), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return ids[at], sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        ids, begin = self.encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
