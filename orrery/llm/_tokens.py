"""Token ids of whole texts through the tokenizers library, each distinct stretch of text encoded once per worker.

Both pre-tokenizers never join across the stretches used here, so ids of a text are those of its stretches in
order. "spaced" (byte-level BPE): a stretch is a run of other characters with the one space before it, or a single
white-space byte; a text with two white-space characters in a row, or with white space outside ASCII, goes to the
library whole. "words" (white space dropped): a stretch is a run without ASCII white space.

Stretches of at most 32 bytes are remembered. They are found by a 64-bit hash, and a hit must agree in length and every
byte. Longer ones go to the library each time.
"""

from __future__ import annotations

import os

import numpy as np

from orrery.llm._text import FIRST, SPACE, U, combine, eights, word_bounds

#: Distinct stretches remembered per worker; the memory is emptied when it is full.
REMEMBER = 1_000_000
#: A special token that splits any text, used to encode many new stretches in one call.
BETWEEN = {"spaced": "<|endoftext|>", "words": "<|startoftext|>"}


def _blocks(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches x 4: the first 32 bytes of each, eight to an integer, zeros beyond its end."""
    at8, out = eights(buf), np.zeros((len(starts), 4), U)
    for j in range(4):
        live = np.flatnonzero(size > 8 * j)
        out[live, j] = at8[starts[live] + 8 * j] & FIRST[np.minimum(size[live] - 8 * j, 8)]
    return out


class Encoder:
    """Maps a flat buffer of texts to ids and row offsets."""

    def __init__(self, path: str, kind: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.remember = Tokenizer.from_file(path), kind, remember
        self.between = self.tokenizer.token_to_id(BETWEEN[kind])
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)  # sorted
        self.slot = np.zeros(0, np.int32)  # by key
        self.size, self.blocks, self.at = np.zeros(0, np.int32), np.zeros((0, 4), U), np.zeros(1, np.int64)  # by slot
        self.ids = np.zeros(1 << 16, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new stretches, and how many each has."""
        special = np.array(["<|" in t for t in texts], dtype=bool)
        plain = [t for t, x in zip(texts, special.tolist(), strict=True) if not x]
        ids, counts = [], np.zeros(len(texts), np.int64)
        sizes = []
        for i in range(0, len(plain), 64):
            got = np.array(self._library([BETWEEN[self.kind].join(plain[i : i + 64])])[0], dtype=np.uint32)
            cut = np.flatnonzero(got == self.between)
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
            ids.append(np.delete(got, cut))
        if plain:
            counts[~special] = np.concatenate(sizes)
        if special.any():  # their strings are special tokens themselves
            k = np.flatnonzero(special)
            own = [np.array(x, dtype=np.uint32) for x in self._library([texts[i] for i in k])]
            counts[k] = [len(x) for x in own]
            parts = iter(own)
            at = np.concatenate([[0], np.cumsum(np.where(special, 0, counts))])
            joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            edges = [0, *at[k].tolist()]
            ids = []
            for a, b in zip(edges, edges[1:], strict=False):
                ids += [joined[a:b], next(parts)]
            ids.append(joined[edges[-1] :])
        return np.concatenate(ids), counts

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, blocks: np.ndarray) -> None:
        data = buf.tobytes()
        ids, counts = self._stretches([data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        n = self.at[-1]
        while n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[n : n + len(ids)] = ids
        slots = len(self.size) + np.arange(len(starts), dtype=np.int32)
        self.size, self.blocks = np.concatenate([self.size, (ends - starts).astype(np.int32)]), np.concatenate([self.blocks, blocks])
        self.at = np.concatenate([self.at, n + np.cumsum(counts)])
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.slot = np.insert(self.keys, place, hashes), np.insert(self.slot, place, slots)

    def _cut(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of stretches in order, and which of them are whole rows for the library."""
        starts, ends, _ = word_bounds(buf, off)
        if self.kind == "words":
            return starts, ends, np.zeros(len(starts), bool)
        rows = np.arange(len(off) - 1)
        space = SPACE[buf]
        inner = np.zeros(len(buf) + 1, bool)
        inner[off] = True  # a row begins here
        odd = np.flatnonzero(space[1:] & space[:-1] & ~inner[1 : len(buf)])
        lead = np.isin(buf[:-1], (0xC2, 0xE1, 0xE2, 0xE3))
        then = buf[1:]
        wide = np.flatnonzero(lead & (((buf[:-1] == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((buf[:-1] == 0xE1) & (then == 0x9A)) | ((buf[:-1] == 0xE2) & ((then == 0x80) | (then == 0x81))) | ((buf[:-1] == 0xE3) & (then == 0x80))))
        whole = np.zeros(len(rows), bool)
        whole[np.searchsorted(off, np.concatenate([odd, wide]), side="right") - 1] = True
        joined = np.zeros(len(starts), bool)
        has = starts > 0
        joined[has] = (buf[starts[has] - 1] == 0x20) & ~inner[starts[has]]
        alone = space.copy()
        alone[starts[joined] - 1] = False
        alone = np.flatnonzero(alone)
        starts, ends = np.concatenate([starts - joined, alone]), np.concatenate([ends, alone + 1])
        if whole.any():
            keep = ~whole[np.searchsorted(off, starts, side="right") - 1]
            starts, ends = np.concatenate([starts[keep], off[:-1][whole]]), np.concatenate([ends[keep], off[1:][whole]])
        flag = np.zeros(len(starts), bool)
        flag[len(starts) - int(whole.sum()) :] = True
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], flag[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a flat buffer, and offsets of rows into them."""
        starts, ends, whole = self._cut(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.keys) > self.remember:
            self._clear()
        size = ends - starts
        whole |= size > 32
        blocks = _blocks(buf, starts, size)
        h = size.astype(U)
        for j in range(4):
            h = combine(h, blocks[:, j])
        slot = np.full(len(h), -1, np.int64)
        if len(self.keys):
            p = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            slot = np.where(self.keys[p] == h, self.slot[p], -1)
        new = np.flatnonzero((slot < 0) & ~whole)
        if len(new):
            _, first, same = np.unique(h[new], return_index=True, return_inverse=True)
            k = new[first]
            slot[new] = len(self.size) + same  # slots are given in this order
            self._learn(buf, starts[k], ends[k], h[k], blocks[k])
        bad = whole.copy()
        known = np.flatnonzero(~whole)
        bad[known] = (self.size[slot[known]] != size[known]) | (self.blocks[slot[known]] != blocks[known]).any(axis=1)
        begin, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        good = ~bad
        begin[good], count[good] = self.at[slot[good]], self.at[slot[good] + 1] - self.at[slot[good]]
        pool = self.ids
        if bad.any():
            data, k = buf.tobytes(), np.flatnonzero(bad)
            more = self._library([data[a:b].decode() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
            sizes = np.array([len(x) for x in more], dtype=np.int64)
            n = self.at[-1]
            begin[k], count[k] = n + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([self.ids[:n], np.concatenate([np.array(x, dtype=np.uint32) for x in more])])
        stop = np.cumsum(count)
        ids = pool[np.repeat(begin - (stop - count), count) + np.arange(stop[-1])]
        upto = np.concatenate([[0], stop])
        return ids, upto[np.searchsorted(starts, off, side="left")]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker, path and kind."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def with_end(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with id end appended to each."""
    out_off = off + np.arange(len(off))
    out = np.full(out_off[-1], end, dtype=np.uint32)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out[np.arange(len(ids)) + row] = ids
    return out, out_off
