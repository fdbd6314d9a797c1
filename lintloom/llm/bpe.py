"""Byte-level BPE: pre-tokens are merged as rows of length-bucketed padded numpy matrices.

Each round, every row of a matrix merges its leftmost pair of minimum rank, found by a hashed pair lookup, and is
compacted by one place; rows without a mergeable pair leave the matrix. A row beyond ``MAX_MATRIX`` bytes is a matrix of
its own, in which a round merges all pairs of minimum rank from the left, as far as no merge makes a pair of lower
rank: the same merges in the same order, in as many rounds as there are ranks instead of merges.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import regex

#: Words and pre-tokens kept with their ids during a task; a store is emptied when it is full.
MEMO_WORDS, MEMO_TOKENS = 200_000, 100_000
#: Bytes of a pre-token up to which it is kept.
MEMO_BYTES = 40
#: Bytes of a pre-token up to which it is merged in a matrix.
MAX_MATRIX = 1024
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a place within a matrix of narrow rows, where a rank and a place share 32 bits, and of wide ones.
NARROW_BITS, WIDE_BITS = 7, 11
#: Stands for "no such pair", above all ranks.
NO_RANK = np.int32((1 << 24) - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, as an open-addressing hash table in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None:
                    b = get(token[cut:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        left_over, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left_over):
            self.probes += 1
            at = slot[left_over]
            free = self.values[at] == NO_RANK
            first = np.unique(at[free], return_index=True)[1]
            put = left_over[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left_over = np.setdiff1d(left_over, put, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NO_RANK where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NO_RANK)
        # a key that isn't in its first place can only be further on where that place is taken
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] != NO_RANK))
        at, keys = slot.ravel()[open_], keys.ravel()[open_]
        flat = out.ravel()
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys
            flat[open_[hit]] = self.values[at[hit]]
            go = ~hit & (self.values[at] != NO_RANK)
            open_, at, keys = open_[go], at[go], keys[go]
        return flat.reshape(out.shape)

    def rank(self, left: int, right: int) -> int:
        return int(self.ranks(np.array([left]), np.array([right]))[0])


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal: list[bytes] = [str(i).encode() for i in range(len(self.tokens))]
        #: Words after a space, and pre-tokens, with their ids. None: the word ends with white space.
        self.words: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length bucket, merged together.

        The matrices hold a piece in a column, a place in a row, so that each step runs along contiguous cells. As
        every piece that is left merges one pair a round, its length is the first length less the rounds.
        """
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int32, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw.T]
        padded = lengths.min() < width
        if padded:
            ids[np.arange(width)[:, None] >= lengths] = -1
        out, rows = [b""] * n, np.arange(n)
        bits, kind = (NARROW_BITS, np.int32) if width <= 1 << NARROW_BITS else (WIDE_BITS, np.int64)
        rank = np.full((0, n), NO_RANK, np.int32)
        if width > 1:
            rank = self.pairs.ranks(ids[:-1], ids[1:])
            if padded:
                rank[ids[1:] < 0] = NO_RANK
        while True:
            if len(rank):
                key = (rank.astype(kind, copy=False) << bits) + np.arange(len(rank), dtype=kind)[:, None]
                least = key.min(axis=0)  # the least rank, and of equal ones the leftmost
                merged, best = (least >> bits).astype(np.int32, copy=False), least & (1 << bits) - 1
                over = merged == NO_RANK
            else:
                over = np.ones(len(rows), bool)
            if over.any():
                cells = np.ascontiguousarray(ids[:, over].T).astype("<u4")
                flat, row_bytes = cells.tobytes(), cells.shape[1] * 4
                for k, (i, size) in enumerate(zip(rows[over].tolist(), (lengths[over] * 4).tolist(), strict=True)):
                    out[i] = flat[k * row_bytes : k * row_bytes + size]
                keep = ~over
                rows = rows[keep]
                if not len(rows):
                    return out
                ids, rank, lengths, best, merged = ids[:, keep], rank[:, keep], lengths[keep], best[keep], merged[keep]
            # compaction: what stands right of the merged pair moves one place to the left
            place, each = np.arange(len(ids) - 1, dtype=np.int32)[:, None], np.arange(len(rows))
            right = place > best
            ids = np.where(right, ids[1:], ids[:-1])
            ids[best, each] = merged
            rank = np.where(right[:-1], rank[1:], rank[:-1])
            lengths = lengths - 1
            # only the pairs that hold the merged token have a new rank
            has = best < lengths - 1
            at, col = best[has], each[has]
            rank[at, col] = self.pairs.ranks(ids[at, col], ids[at + 1, col])
            if padded and len(rank):
                end = ~has & (best < len(rank))
                rank[best[end], each[end]] = NO_RANK
            has = best > 0
            at, col = best[has], each[has]
            rank[at - 1, col] = self.pairs.ranks(ids[at - 1, col], ids[at, col])

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.ranks(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NO_RANK:
            at = np.flatnonzero(rank == low)
            # of pairs that overlap, every second one from the left is merged
            run = np.cumsum(np.diff(at, prepend=-2) > 1)
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # the pairs that a merge makes, when those left of it are merged and those right of it aren't yet
            before = np.where(np.diff(at, prepend=-3) == 2, low, ids[at - 1])
            left = np.where(at > 0, self.pairs.ranks(before, np.full(len(at), low, np.int32)), NO_RANK)
            ended = at + 2 >= len(ids)
            right = np.where(ended, NO_RANK, self.pairs.ranks(np.full(len(at), low, np.int32), ids[np.where(ended, 0, at + 2)]))
            lower = np.flatnonzero((left < low) | (right < low))
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep)[at] - 1
            ids = ids[keep]
            rank = rank[keep[1:]] if len(keep) > 1 else rank[:0]
            # the pairs on either side of a merged token have new ranks
            near = np.unique(np.concatenate([place - 1, place]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            rank[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        whole = self.ranks.get
        for i, piece in enumerate(pieces):
            rank = whole(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else 16 + (n + 7) // 8 if n <= 128 else 128 + (n + 63) // 64 if n <= MAX_MATRIX else 0, []).append(i)
        for i in buckets.pop(0, ()):
            out[i] = self._long(pieces[i]).astype("<u4").tobytes()
        for members in buckets.values():
            step = max(1, MATRIX_CELLS // max(len(pieces[i]) for i in members))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token."""
        memo = self.pieces
        missing = list(set(pieces).difference(memo))
        if not missing:
            return list(map(memo.__getitem__, pieces))
        if len(memo) + len(missing) > MEMO_TOKENS:
            memo.clear()
            missing = list(set(pieces))
        extra: dict[str, bytes] = {}
        for p, ids in zip(missing, self.encode_pieces([p.encode() for p in missing]), strict=True):
            (memo if len(p) <= MEMO_BYTES and len(memo) < MEMO_TOKENS else extra)[p] = ids
        return [extra[p] if p in extra else memo[p] for p in pieces] if extra else list(map(memo.__getitem__, pieces))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. No word is empty, holds a space or ends with white space."""
        if not words:
            return []
        pieces = self.find(" " + " ".join(words))
        ids = self._ids(pieces)
        ends = list(accumulate(map(len, ids), initial=0))
        starts = [ends[i] for i, p in enumerate(pieces) if p[0] == " "]
        flat = b"".join(ids)
        return [flat[a:b] for a, b in zip(starts, [*starts[1:], len(flat)], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32 arrays.

        The pattern always cuts before a space that follows a character other than white space, and what stands
        between two such cuts is cut alike alone. So the ids of space-separated words are kept; texts in which a
        space follows white space go through the pattern whole.
        """
        memo = self.words
        split = [t.split(" ") for t in texts]
        if len(memo) > MEMO_WORDS:
            memo.clear()
        missing = set().union(*[words[1:] for words in split]).difference(memo)
        sound = []
        for w in missing:
            if not w or w[-1].isspace():
                memo[w] = None
            else:
                sound.append(w)
        memo.update(zip(sound, self._words(sound), strict=True))
        get = memo.__getitem__
        found = [list(map(get, words[1:])) for words in split]
        for w in [w for w in missing if len(w) > MEMO_BYTES]:
            del memo[w]
        # by the pattern: first words, and texts in which a space follows white space
        cut = []
        for i, words in enumerate(split):
            if None in found[i] or words[0][-1:].isspace():
                cut.append(self.find(texts[i]))
                found[i] = []
            else:
                cut.append(self.find(words[0]))
        ids, at, out = self._ids(list(chain.from_iterable(cut))), 0, []
        for pieces, rest in zip(cut, found, strict=True):
            out.append(np.frombuffer(b"".join(ids[at : at + len(pieces)] + rest), "<u4"))
            at += len(pieces)
        return out

    def reset(self) -> None:
        """Empties the stores."""
        self.words, self.pieces = {}, {}

    def digits(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def read_ranks(file: str) -> dict[bytes, int]:
    """Tokens with their ranks, from lines of a base64 token and its rank."""
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _load(file: str, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    """The encoder of a rank file."""
    return Bpe(read_ranks(file), pattern)


def load(file: str, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    """The encoder of a rank file, with empty stores. A worker reads a file once."""
    coder = _load(file, pattern)
    coder.reset()
    return coder
