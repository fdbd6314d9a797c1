"""Brute-force versions that several tests hold results against."""

import itertools

BLANKS = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def components(rows):
    """doc_id -> (size of its shingle set, smallest id it is connected to), by comparing all pairs."""

    def shingles(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(BLANKS).split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_pieces(rows, lengths, capacity=1024):
    """Each token lies in one piece, sequences have no gaps and fit; returns the share of padding."""
    covered, sequences = {}, {}
    for r in rows:
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    for doc, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= parts[0][2] <= capacity
        padding += parts[0][2] - at
    return padding / sum(lengths.values())
