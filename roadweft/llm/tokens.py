"""Token ids with the public vocabulary files, encoded piece by piece.

Before anything is merged, both vocabularies split a text at the step from a character that is not white space to
one that is, and between plain letters, digits and marks. So the pieces between such steps can be encoded alone, and
each distinct piece seldom more than once per worker: a table from piece hashes to ids is kept between batches, and
texts are put together from it with array operations. A text with white space that libraries class differently, or
with a special token's opening, is encoded whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from roadweft.llm import hashing
from roadweft.llm.common import chunks, worker_tables

#: Pieces that a worker keeps; beyond that it drops those that one batch alone has used.
KEPT = 1_000_000
#: Bytes of text in a batch.
BATCH = 2_000_000
#: White space and format characters outside the plain six, and the opening of special tokens.
ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\|")
#: Bytes without which a text can hold none of those characters.
HINT = np.zeros(256, bool)
HINT[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Kinds of bytes: plain letters (with Latin ones of two bytes), digits, marks, and others, which are not told apart.
LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = MARK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[hashing.SPACE] = 0
LATIN, NO_LETTERS, APOSTROPHE = 0xC3, (0x97, 0xB7), 0x27


def kinds(a: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    out = KIND[a]
    lead = np.flatnonzero(a == LATIN)
    lead = lead[~np.isin(a[lead + 1], NO_LETTERS)]
    out[lead] = out[lead + 1] = LETTER
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Places inside words where one kind ends and another begins; not after an apostrophe, which may belong to the letters."""
    k = kinds(a)
    p, q = k[:-1], k[1:]
    return np.flatnonzero((p != q) & (p != 0) & (q != 0) & (p != OTHER) & (q != OTHER) & ((q != LETTER) | (a[:-1] != APOSTROPHE))) + 1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Encodes texts to unsigned 32-bit ids as the library does, without adding special tokens.

    Strings of special tokens in a text become their ids, as the library has it, or ordinary text on demand.
    """

    def __init__(self, path: str, keeps_space: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, pieces: list[str], needed: np.ndarray) -> None:
        if len(self.keys) + len(keys) > KEPT:
            keep = self.again.copy()
            if int(keep.sum()) + len(keys) > KEPT:
                keep[:] = False
            keep[needed] = True
            keep = np.flatnonzero(keep)
            self.pool = self.pool[spread(self.start[keep], self.size[keep])]
            self.keys, self.size, self.again = self.keys[keep], self.size[keep], np.zeros(len(keep), bool)
            self.start = np.cumsum(self.size) - self.size
        found = self.whole(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.keys, keys)  # new keys come sorted
        self.again = np.insert(self.again, at, False)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, starts), np.insert(self.size, at, sizes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts in a row, and how many each has."""
        raw = b" ".join(texts) + b" "
        a = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], hashing.SPACE[a]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        inner = steps(a)
        at = np.searchsorted(starts, inner)
        starts, ends = np.insert(starts, at, inner), np.insert(ends, at - 1, inner)
        owner = np.searchsorted(bounds, starts, side="right") - 1
        if self.keeps_space:  # a piece begins where the one before it ends; what trails a text is a piece of its own
            first = np.ones(len(starts), bool)
            first[1:] = owner[1:] != owner[:-1]
            last = np.ones(len(starts), bool)
            last[:-1] = first[1:]
            begin = np.where(first, bounds[owner], np.concatenate([[0], ends[:-1]]))
            tail = bounds[:-1].copy()
            tail[owner[last]] = ends[last]
            trailing = np.flatnonzero(tail < bounds[1:] - 1)
            begin = np.concatenate([begin, tail[trailing]])
            ends = np.concatenate([ends, bounds[1:][trailing] - 1])
            order = np.argsort(begin, kind="stable")
            starts, ends, owner = begin[order], ends[order], np.concatenate([owner, trailing])[order]
        up, down = hashing.BYTES.get(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(hashing.TABLE[a] * up[: len(a)], out=sums[1:])
        keys, where, back = np.unique(hashing.fmix((sums[ends] - sums[starts]) * down[starts]), return_index=True, return_inverse=True)
        at, known = self.find(keys)
        self.again[at[known]] = True
        if not known.all():
            new = where[~known]
            self.learn(keys[~known], [raw[i:j].decode() for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], np.sort(at[known]))
            at, _ = self.find(keys)
        at = at[back]
        sizes = self.size[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return self.pool[spread(self.start[at], sizes)], np.diff(total[cuts])

    def odd(self, texts: list[bytes]) -> list[int]:
        """Texts that can't be cut into pieces."""
        raw = b" ".join(texts)
        if not (HINT[np.frombuffer(raw, np.uint8)].any() or b"<|" in raw or any(x in raw for x in self.added)):
            return []
        return [i for i, x in enumerate(texts) if ODD.search(x.decode()) or any(t in x for t in self.added)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for lo, hi in chunks(texts, BATCH):
            part = texts[lo:hi]
            odd = set(self.odd(part))
            plain = [x for i, x in enumerate(part) if i not in odd]
            ids, sizes = self.batch(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            parts = iter(np.split(ids, np.cumsum(sizes)[:-1]) if plain else [])
            special = iter(self.whole([part[i].decode() for i in sorted(odd)]))
            out += [np.asarray(next(special), np.uint32) if i in odd else next(parts) for i in range(len(part))]
        return out


_encoders: dict[tuple[str, bool, bool], Encoder] = worker_tables()


def encoder(path: str, keeps_space: bool, special_as_text: bool = False) -> Encoder:
    """One encoder for each file, way and worker process; it goes when a lean kernel of another operator begins there."""
    key = (path, keeps_space, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
