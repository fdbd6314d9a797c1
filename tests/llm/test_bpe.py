"""Long pieces: wide matrices and rows of their own against the library and against one merge at a time."""

import random

import numpy as np
import pytest
import tiktoken

from lintloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def slow(ranks, piece):
    """One merge at a time: of the pairs of least rank the leftmost."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def coder():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_any_ranks_give_the_merges_one_at_a_time():
    """Vocabularies in no order of training, where a merge can make a pair of lower rank."""
    rng = random.Random(1)
    for _ in range(150):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 12:
            a, b = rng.choice([t for t in tokens if set(t) <= set(b"abc")] ), rng.choice([t for t in tokens if set(t) <= set(b"abc")])
            tokens.add(a + b)
        more = [t for t in tokens if len(t) > 1]
        rng.shuffle(more)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(more)}
        own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
        for n in (2, 3, 40, 200):
            piece = bytes(rng.choices(b"abc", k=n))
            want = slow(ranks, piece)
            assert own._long(piece).tolist() == want
            assert np.frombuffer(own._matrix([piece, piece[: n // 2 + 1]])[0], "<u4").tolist() == want


def test_long_pieces_are_the_library_s(coder):
    rng = random.Random(2)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    some = ["".join(rng.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aé日本語", "aab") for n in (100, 127, 128, 129, 700, 1023, 1024, 1025, 5000)]
    some += ["a" * n for n in (128, 1024, 1025, 60_000)] + ["=" * 3000, "日本語" * 4000, "".join(map(chr, rng.choices(range(0x4E00, 0x9FFF), k=20_000)))]
    for text, ids in zip(some, coder.encode(some), strict=True):
        assert theirs.encode_ordinary(text) == ids.tolist() and coder.decode(ids) == text.encode()
