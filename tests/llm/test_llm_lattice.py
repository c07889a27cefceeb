"""Tries and lattices of segment sampling."""

import random

import numpy as np

from turnscope.llm import lattice
from turnscope.llm.lattice import Lattice, Trie, Vocabulary


def test_a_place_is_left_where_no_piece_goes_on():
    rng = random.Random(4)
    pieces = sorted({bytes(rng.choice(b" abc\xe2\x96") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    body = bytes(rng.choice(b"abc \xe2\x96d\n") for _ in range(3000)) + b"\n"
    found = Trie.of(pieces, list(range(len(pieces)))).find(np.frombuffer(body, np.uint8))
    got = {(p, n, pieces[i]) for n, (places, ids) in enumerate(found, 1) for p, i in zip(places.tolist(), ids.tolist(), strict=True)}
    assert got == {(p, n, body[p : p + n]) for p in range(len(body)) for n in range(1, 8) if body[p : p + n] in set(pieces)}

    class Counted(np.ndarray):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += len(key)
            return super().__getitem__(key)

    trie = Trie.of([b"aaaaaaaaaaaaaaaa", *(bytes([c]) for c in b"abc")], [0, 1, 2, 3])
    trie.parent = trie.parent.view(Counted)
    plain = np.frombuffer(b"bc" * 500 + b"\n", np.uint8)
    trie.find(plain)
    assert Counted.asked <= 2 * len(plain)  # not once for each of 16 lengths


def completions(chunk: bytes, edges: dict[int, list[tuple[int, float]]]) -> list[float]:
    below = [0.0] * (len(chunk) + 1)
    for at in range(len(chunk) - 1, -1, -1):
        values = [w + below[end] for end, w in edges.get(at, [])]
        below[at] = float(np.logaddexp.reduce(values)) if values else 0.0
    return below


def test_near_and_far_completions_agree():
    letters = b"ab "
    pieces = [bytes([c]) for c in letters] + [b"ab", b"ba", b"aba", b" a"]
    ids = list(range(256, 256 + len(pieces)))
    weights = np.concatenate((np.full(256, -12.0), -np.linspace(1.5, 9.0, len(pieces))))
    surfaces = [bytes([i]) for i in range(256)] + pieces
    vocabulary = Vocabulary(surfaces, Trie.of(pieces, ids), weights, np.arange(256, dtype=np.int32), frozenset("ab "))
    chunks = [b" ab", b"a", b"\n", b" " + b"aba" * 300, " é".encode(), b"b" * 75]
    made = Lattice(chunks, vocabulary)
    near = lattice.NEAR / 12.0
    assert 3 < near < 75
    for i, chunk in enumerate(chunks):
        a, b = int(made.starts[i]), int(made.ends[i])
        assert b - a == len(chunk)
        edges = {p - a: [(int(made.end[e]) - a, weights[made.piece[e]]) for e in range(made.first[p], made.first[p + 1])] for p in range(a, b)}
        below = completions(chunk, edges)
        for p in range(a, b):
            own = range(made.first[p], made.first[p + 1])
            spelled = [surfaces[made.piece[e]] for e in own]
            assert all(chunk[p - a :].startswith(s) for s in spelled)
            assert [len(s) for s in spelled] == sorted((len(s) for s in spelled), reverse=True)
            if len(own) == 1:
                assert made.logp[own[0]] == 0.0
            elif own:
                for e in own:
                    expected = weights[made.piece[e]] + below[int(made.end[e]) - a] - below[p - a]
                    assert abs(made.logp[e] - min(expected, 0.0)) < 1e-9
        assert made.first[b] == made.first[b + 1]  # no edge starts at an end
