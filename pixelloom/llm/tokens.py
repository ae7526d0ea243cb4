"""Token ids of whole texts with a public tokenizer.

BPE never merges across the places where a tokenizer's own pattern cuts a text, so a text is cut there
with numpy, each distinct chunk is encoded once by the tokenizers library, and the ids are gathered from a
table by the chunks' hashes (64 bits; chunks of more than SHORT bytes are compared whole). Texts in which such a cut is not
certain are encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pixelloom.llm.common import ranged_hashes, utf8, word_ranges

#: White space beyond ASCII, for RE2.
WIDE = r"\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts that are encoded whole: blanks in a row or at the end, control signs, special tokens.
UNSURE = {
    "space": rf"[ \n][\s{WIDE}]| \z|[\x{{00}}-\x{{08}}\x{{0E}}-\x{{1F}}]|<\|",
    "blank": r"[\x{00}-\x{08}\x{0E}-\x{1F}]|<\|",
}
#: Signs that are cut off a word's end: none of them joins a letter or digit in either tokenizer's pattern.
TAIL = b".,;:!?"
#: What stands between chunks that are encoded in one call: a piece of its own in either tokenizer's pattern, with one id.
BETWEEN = {"space": "\n", "blank": " ~ "}
SHORT = 64
BARE = np.uint64(0x5851F42D4C957F2D)
_encoders: dict = {}


def encoder(path: str, cut: str) -> ChunkEncoder:
    """The encoder of this Python worker, kept between tasks. A task has one core, so the library starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, cut) not in _encoders:
        _encoders[path, cut] = ChunkEncoder(path, cut)
    return _encoders[path, cut]


def id_type(path: str, end_id: int) -> str:
    """The narrowest little-endian type that holds all of a tokenizer's ids."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


class Table:
    """A growing map of 64-bit keys to places, by arrays: open addressing by the keys' upper bits."""

    def __init__(self, bits: int = 12):
        self.bits, self.n, self.steps = bits, 0, 1
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if unknown. Keys are not 0."""
        slot = self._slot(keys, 0)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.places[slot], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            slot = self._slot(keys[left], step)
            seen = self.keys[slot]
            hit = seen == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            left = left[~hit & (seen != 0)]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old, at = self.keys, np.flatnonzero(self.keys)
            keys, places = np.concatenate([old[at], keys]), np.concatenate([self.places[at], places])
            self.__init__(max(self.bits + 1, (2 * len(keys)).bit_length()))
        self.n += len(keys)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.places[slot[won]] = places[left[won]]
            left, step = left[~won], step + 1
        self.steps = max(self.steps, step)


class ChunkEncoder:
    """cut: "space" for byte-level BPE that keeps white space and joins one space to the next word; "blank" for tokenizers that drop it.

    Keeps about `limit` chunks at most; then it starts anew.
    """

    def __init__(self, path: str, cut: str, limit: int = 1_000_000):
        self.tokenizer, self.cut, self.limit = Tokenizer.from_file(path), cut, limit
        self.between = BETWEEN[cut]
        (self.mark,) = self._ids([self.between])[0]
        self._forget()

    def _forget(self) -> None:
        self.table, self.begin, self.length, self.flat, self.used = Table(), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array("I", e.ids)) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has: in one call with marks between."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lead = " " if spaced else ""
        between = self.between + lead
        ids = self._ids([lead + between.encode().join(chunks).decode()])[0]
        at = np.flatnonzero(ids == self.mark)
        if len(at) == len(chunks) - 1:
            return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        return self._alone(chunks, spaced)

    def _alone(self, chunks: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        parts = self._ids([(" " if spaced else "") + c.decode() for c in chunks])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def _learn(self, data: bytes, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks, their ids in it and the number of each one's ids."""
        flag = np.concatenate([[0], np.cumsum(self._odd(raw))])
        odd = flag[end] > flag[begin]
        order, ids, sizes = [], [], []
        for one_by_one in (False, True):
            for spaced in (False, True):
                some = np.flatnonzero((odd == one_by_one) & (bare != spaced))
                chunks = [data[i:j] for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                found = (self._alone if one_by_one else self._encode)(chunks, spaced)
                order.append(some), ids.append(found[0]), sizes.append(found[1])
        return np.concatenate(order), np.concatenate(ids), np.concatenate(sizes)

    def _odd(self, raw: np.ndarray) -> np.ndarray:
        """Bytes of white space within chunks, and of marks: chunks with them are encoded one by one."""
        if self.cut == "blank":
            return raw == 126
        out = (raw >= 9) & (raw <= 13)
        high = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
        if len(high):
            three = np.concatenate([raw, np.zeros(2, np.uint8)])
            a, b, c = (three[high + k].astype(np.int64) for k in range(3))
            wide = (a << 16 | b << 8 | c)
            blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (wide >= 0xE28080) & (wide <= 0xE2808A) | np.isin(wide, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
            out[high[blank]] = True
        return out

    @staticmethod
    def _without_tails(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The end of each chunk before up to three signs of TAIL that follow an ASCII letter or digit: both patterns cut there."""
        cut = end.copy()
        signs, letters = np.zeros(256, bool), np.zeros(256, bool)
        signs[list(TAIL)] = True
        letters[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        for _ in range(3):
            back = (cut - 1 > begin) & signs[raw[cut - 1]]
            if not back.any():
                break
            cut -= back
        return np.where(letters[raw[cut - 1]], cut, end) if len(cut) else cut

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each chunk in the bytes, and whether no space belongs to it."""
        if self.cut == "blank":
            begin, end, _ = word_ranges(raw, starts)
            bare, line = np.ones(len(begin), bool), np.zeros(0, np.int64)
        else:
            line = raw == 10
            begin, end, _ = word_ranges(np.where(line | (raw == 32), np.uint8(32), np.uint8(97)), starts)
            fresh = np.zeros(len(raw) + 1, bool)
            fresh[starts] = True
            bare = fresh[begin] | line[begin - 1] if len(begin) else np.zeros(0, bool)
            line = np.flatnonzero(line)
        cut = self._without_tails(raw, begin, end)
        tail = np.flatnonzero(cut < end)
        places = np.concatenate([begin, cut[tail], line])
        order = np.argsort(places, kind="stable")
        return places[order], np.concatenate([cut, end[tail], line + 1])[order], np.concatenate([bare, np.ones(len(tail) + len(line), bool)])[order]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's start, with the total at the end."""
        if self.table.n > self.limit:
            self._forget()
        unsure = pc.match_substring_regex(texts, UNSURE[self.cut]).to_numpy(zero_copy_only=False).astype(bool)
        raw, starts = utf8(pc.if_else(pa.array(unsure), pa.scalar("", pa.large_string()), texts) if unsure.any() else texts)
        begin, end, bare = self._cuts(raw, starts)
        keys = (ranged_hashes(raw.astype(np.uint64) + np.uint64(1), begin, end) + np.where(bare, BARE, np.uint64(0))) | np.uint64(1)
        place = self.table.get(keys).astype(np.int64)
        data, base = raw.tobytes(), self.table.n
        new = np.flatnonzero((place < 0) & (end - begin <= SHORT))
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            some = new[first]
            order, ids, sizes = self._learn(data, raw, begin[some], end[some], bare[some])
            self._keep(ids, sizes)
            self.table.add(fresh[order], (base + np.arange(len(fresh))).astype(np.int32))
            rank = np.empty(len(fresh), np.int64)
            rank[order] = np.arange(len(fresh))
            place[new] = base + rank[back]
        at, size = self.begin[place], self.length[place].astype(np.int64)
        extra, more = [], self.used
        long = np.flatnonzero(end - begin > SHORT)
        known: dict = {}
        for i in long.tolist():
            said = (data[begin[i] : end[i]], not bare[i])
            if said not in known:
                ids, _ = self._alone([said[0]], said[1])
                known[said] = (more, len(ids))
                extra.append(ids)
                more += len(ids)
            at[i], size[i] = known[said]
        bounds = np.searchsorted(begin, starts)
        if unsure.any():  # each of them as one more chunk
            whole = self._ids(texts.filter(pa.array(unsure)).to_pylist())
            sizes = np.array([len(x) for x in whole], np.int64)
            to = bounds[:-1][unsure]
            at, size = np.insert(at, to, more + np.cumsum(sizes) - sizes), np.insert(size, to, sizes)
            extra += whole
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) + unsure)])
        flat = np.concatenate([self.flat[: self.used], *extra]) if extra else self.flat
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[bounds]

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Puts the ids of new chunks at the end of what is kept."""
        n, begin = self.table.n, self.used + np.cumsum(sizes) - sizes
        while len(self.begin) < n + len(sizes):
            self.begin, self.length = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.length, np.zeros_like(self.length)])
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[n : n + len(sizes)], self.length[n : n + len(sizes)] = begin, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    return np.insert(ids, starts[1:], np.uint32(end)), starts + np.arange(len(starts))
