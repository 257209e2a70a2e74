"""Token ids of a public byte-level BPE vocabulary, one merge run per distinct word."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Callable

import numpy as np
import regex

from .words import U64, _Powers, mix

#: The strings that the vocabulary's tokenizer file takes for one token wherever they stand.
SPECIAL = "<|endoftext|>"
#: Slots of a worker's memory of pieces (14 bytes each), and ids it holds before it starts afresh.
CACHE_SLOTS, CACHE_IDS = 1 << 18, 1 << 20

_POWERS = _Powers(0xC2B2AE3D27D4EB4F)
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of each code point."""
    size = 0x110000
    kinds = np.zeros(size, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, size)]))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, size)])
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[at[m.start() : m.end()]] = kind
    return kinds, mix(np.arange(1, size + 1, dtype=U64))


class Pieces:
    """Splits texts as the byte-level pattern does and remembers the ids of each distinct piece.

    The split follows the published pattern: contractions, then runs of letters, of
    numbers and of other signs, each with one space before it, then white space, of
    which the last sign before a word stands apart.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path = json_path
        self.kinds, self.values = _tables()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merges = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.flat = np.zeros(CACHE_IDS, np.uint32)
        self.names = np.zeros(CACHE_SLOTS, U64)  # the piece whose ids a slot holds
        self.first = np.zeros(CACHE_SLOTS, np.int32)
        self.sizes = np.zeros(CACHE_SLOTS, np.uint16)  # 0: empty
        self.used = 0

    @functools.cached_property
    def whole(self):
        """The tokenizer itself; only texts with the special string need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def _look_up(self, hashes: np.ndarray, piece: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size) of distinct pieces: remembered ones from their slots, the others merged and put there."""
        slot = (hashes & U64(CACHE_SLOTS - 1)).astype(np.int64)
        known = (self.sizes[slot] > 0) & (self.names[slot] == hashes)
        new = np.flatnonzero(~known).tolist()
        merged = [self.merges._encode_single_piece(piece(k)) for k in new]
        n = np.fromiter(map(len, merged), np.int64, len(merged))
        fresh = np.fromiter(itertools.chain.from_iterable(merged), np.uint32, int(n.sum()))
        first, size = self.first[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
        first[new] = self.used + np.cumsum(n) - n
        size[new] = n
        ids = np.concatenate([self.flat[: self.used], fresh])
        if self.used + len(fresh) > CACHE_IDS:
            self.sizes[:], self.used = 0, 0
        elif len(new):
            self.flat[self.used : self.used + len(fresh)] = fresh
            keep = np.asarray(new)[n < 1 << 16]
            self.names[slot[keep]], self.first[slot[keep]], self.sizes[slot[keep]] = hashes[keep], first[keep], size[keep]
            self.used += len(fresh)
        return ids, first, size

    def starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Positions at which pieces begin; bounds: where texts begin and end."""
        n = len(points)
        kind = self.kinds[points]
        head = np.zeros(n + 1, bool)
        head[bounds] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        run = change | head[:n]
        start = np.zeros(n + 1, bool)
        start[:n] = run
        start[n] = True
        space = kind == _SPACE
        # the last sign of white space before another sign
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        marks = np.flatnonzero((points == 39) & start[:n])
        for p in marks.tolist():
            if not start[p]:
                continue
            tail = points[p + 1 : p + 3].tolist()
            one = chr(tail[0]) if tail and not head[p + 1] else ""
            two = one + chr(tail[1]) if len(tail) == 2 and one and not head[p + 2] else ""
            size = 1 if one and one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size:
                start[p + 1 : p + 1 + size] = False
                after = p + 1 + size
                # a space after it opens the next piece already
                if after < n and not head[after]:
                    start[after] = True
        return np.flatnonzero(start[:n])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer file gives them without added tokens."""
        odd = {i: np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if SPECIAL in t}
        joined = "".join(t for i, t in enumerate(texts) if i not in odd)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = [0 if i in odd else len(t) for i, t in enumerate(texts)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return [odd.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        begin = self.starts(points, bounds)
        end = np.concatenate([begin[1:], [len(points)]])
        up, down = _POWERS.get(len(points) + 1)
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(self.values[points] * up[: len(points)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0x9FB21C651E98DF25))
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known, before, sizes_of = self._look_up(distinct, lambda k: joined[begin[where[k]] : end[where[k]]])
        size = sizes_of[inverse]
        stop = np.cumsum(size)
        ids = known[np.repeat(before[inverse] - (stop - size), size) + np.arange(stop[-1])]
        cut = np.concatenate([[0], stop])[np.searchsorted(begin, bounds)]
        return [odd.get(i, ids[cut[i] : cut[i + 1]]) for i in range(len(texts))]
