"""Lattices of subword pieces over many texts at once, in arrays.

A text is cut into chunks that no piece crosses (a run of blanks and the letters after it; a newline), and equal chunks
share one lattice. Work is done on bytes; a blank stands for the vocabulary's word mark. Characters that are no
piece are spelled in byte pieces, also the word mark itself where a text contains it, so every text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import sentencepiece

from turnscope.llm import hashing as H

MARK = "\N{LOWER ONE EIGHTH BLOCK}"
NEAR = 650.0  # a product of weights down to exp(-NEAR) is a normal double


@dataclass
class Trie:
    """The pieces by their bytes. A node is a place in the arrays: a byte leads from ``node`` to ``step[node] + byte``
    if ``parent`` names the node there. ``ids`` holds the piece that ends at a node, or -1."""

    step: np.ndarray
    parent: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, surfaces: list[bytes], ids: list[int]) -> Trie:
        ends = dict(zip(surfaces, ids, strict=True))
        below: dict[bytes, set[int]] = {b"": set()}
        for surface in surfaces:
            for n in range(len(surface), 0, -1):
                known = surface[: n - 1] in below
                below.setdefault(surface[: n - 1], set()).add(surface[n - 1])
                if known:
                    break
        # nodes of many bytes are placed first, all over a table that stays two thirds empty, so few tries are needed
        room = 3 * sum(map(len, below.values())) + 512
        taken, steps = bytearray(room), {}
        taken[0] = 1
        for turn, prefix in enumerate(sorted(below, key=lambda x: (-len(below[x]), x))):
            base = turn * 0x9E3779B1 % (room - 512)
            while any(taken[base + byte] for byte in below[prefix]):
                base = (base + 1) % (room - 256)
            steps[prefix] = base
            for byte in below[prefix]:
                taken[base + byte] = 1
        step, parent, found = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        place = {b"": 0}
        for prefix in sorted(below, key=len):
            node, base = place[prefix], steps[prefix]
            step[node] = base
            for byte in below[prefix]:
                child = prefix + bytes([byte])
                parent[base + byte], found[base + byte] = node, ends.get(child, -1)
                place[child] = base + byte
        return cls(step, parent, found)

    def find(self, body: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every length from 1 on, the places where a piece of it begins, and the pieces. A newline is in no piece and
        ends the body."""
        out, places, node = [], np.arange(len(body)), np.zeros(len(body), np.int32)
        length = 0
        while len(places):
            after = self.step[node] + body[places + length]
            on = np.flatnonzero(self.parent[after] == node)
            places, node = places[on], after[on]
            piece = self.ids[node]
            hit = np.flatnonzero(piece >= 0)
            out.append((places[hit], piece[hit]))
            length += 1
        return out


@dataclass
class Vocabulary:
    """Surface bytes of every id and the log weight of the ids that may be used, with a trie of those."""

    surfaces: list[bytes]
    trie: Trie
    weights: np.ndarray
    byte_ids: np.ndarray
    letters: frozenset[str]  # characters that are pieces

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; ids without a surface spell nothing."""
        sizes, begin, body = self.layout
        n = sizes[ids]
        return body[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    @cached_property
    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in self.surfaces])
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.surfaces), np.uint8)

    @classmethod
    def load(cls, path: str, smoothing: float = 1.0) -> Vocabulary:
        """Reads a model. Its scores rank the pieces; the weight of a rank is its share under Zipf's law, to the power
        of ``smoothing``, so that weights are log probabilities of pieces."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        rank = np.full(n, float(n))
        rank[usable] = np.argsort(np.argsort([-model.get_score(i) for i in usable], kind="stable")) + 1.0
        weights = -smoothing * np.log(rank)
        weights -= np.log(np.exp(weights).sum())
        byte_ids = np.zeros(256, np.int32)
        surfaces = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                byte_ids[value], surfaces[i] = i, bytes([value])
        for i in usable:
            surfaces[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        bad = [i for i in usable if b" " in surfaces[i].lstrip(b" ") or b"\n" in surfaces[i]]
        if bad:
            raise ValueError("pieces may not span words or lines")
        trie = Trie.of([surfaces[i] for i in usable], usable)
        letters = frozenset(x for i in usable if len(x := surfaces[i].decode()) == 1)
        return cls(surfaces, trie, weights, byte_ids, letters)


def chunks_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different chunks of a block of texts, the number of each chunk of the block, and where those of each text
    begin (one more at the end). A text stands behind a leading blank; an empty one has no chunks."""
    behind = [b" " + t if t else b"" for t in texts]
    body = np.frombuffer(b"".join(behind), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in behind])))
    line, blank = body == 0x0A, body == 0x20
    begins = line | blank
    begins[1:] &= ~(blank[1:] & blank[:-1])
    begins[1:] |= line[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(body))[: len(starts)]
    _, at, kind = np.unique(H.range_hashes(H.BYTE_VALUES[body], starts, ends), return_index=True, return_inverse=True)
    whole = body.tobytes()
    chunks = [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return chunks, kind, np.searchsorted(starts, offsets)


class Lattice:
    """All edges of the lattices of different chunks, grouped by the position where they start, longest first.

    ``first[p]`` and ``first[p + 1]`` bound the edges of position ``p``; ``choice`` holds the running sums of the
    probabilities of a position's edges, given all completions to the end of the chunk.
    """

    def __init__(self, chunks: list[bytes], vocabulary: Vocabulary):
        # a newline behind every chunk stands for its end; no edge starts there
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        body = np.frombuffer(b"\n".join(chunks) + b"\n", np.uint8)
        degree = self._edges(body, chunks, vocabulary)
        weight = vocabulary.weights[self.piece]
        below = self._completions(weight, degree, sizes)
        logp = weight + below[self.end]
        logp -= np.repeat(below[:-1], degree)
        np.minimum(logp, 0.0, out=logp)
        logp[self.first[:-1][degree == 1]] = 0.0
        self.logp = logp
        running = np.cumsum(np.exp(logp))
        base = np.concatenate(([0.0], running))[self.first[:-1]]
        running -= np.repeat(base, degree)
        self.choice = running.astype(np.float32)
        self.choice[self.first[1:][degree > 0] - 1] = np.inf  # the last edge takes what rounding leaves

    def _edges(self, body: np.ndarray, chunks: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
        """Finds the edges, and returns their number for each position."""
        spelled = self._spelled(body, chunks, vocabulary)
        found = [(spelled, vocabulary.byte_ids[body[spelled]], 1)]
        found += [(places, piece, n) for n, (places, piece) in enumerate(vocabulary.trie.find(body), 1)]
        degree = np.zeros(len(body), np.int64)
        for places, _, _ in found:
            degree[places] += 1
        self.first = np.zeros(len(body) + 1, np.int64)
        np.cumsum(degree, out=self.first[1:])
        self.start = np.repeat(np.arange(len(body), dtype=np.int32), degree)
        self.end, self.piece = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32)
        free = self.first[:-1].copy()
        for places, piece, length in reversed(found):
            slot = free[places]
            self.end[slot], self.piece[slot] = places + length, piece
            free[places] = slot + 1
        return degree

    def _spelled(self, body: np.ndarray, chunks: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
        """Positions of the bytes of characters that are no pieces."""
        places = []
        plain = np.array([chr(b) in vocabulary.letters for b in range(128)] + [False] * 128)
        fine = plain[body]
        fine[self.ends] = True
        doubtful = np.flatnonzero(~np.logical_and.reduceat(fine, self.starts)) if len(chunks) else ()
        for i in doubtful:
            text, at = chunks[i].decode(), int(self.starts[i])
            if vocabulary.letters.issuperset(text):
                continue
            for letter in text:
                size = len(letter.encode())
                if letter not in vocabulary.letters:
                    places.extend(range(at, at + size))
                at += size
        return np.array(places, np.int32)

    def _completions(self, weight: np.ndarray, degree: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all paths from each position to the end of its chunk; 0 at that end.

        Positions are taken by their distance from that end, so each step needs only earlier ones. Near it the sums
        themselves are in the range of doubles, so no logarithms are taken on the way.
        """
        distance = np.repeat(self.ends, sizes + 1) - np.arange(len(degree))
        distance[degree == 0] = 0  # an end, or no piece starts inside a character
        small = distance.astype(np.uint16) if distance.max(initial=0) < 65536 else distance
        places = np.argsort(small, kind="stable")
        turns = np.append(np.flatnonzero(np.diff(distance[places])) + 1, len(places))
        count = degree[places]
        behind = np.cumsum(count)
        begins = behind - count
        edges = np.repeat(self.first[places] - begins, count) + np.arange(len(weight))
        end, weight = self.end[edges], weight[edges]
        share = np.exp(weight)
        mass = np.zeros(len(degree) + 1)
        mass[self.ends] = 1.0
        near = NEAR / max(1.0, -float(weight.min(initial=0.0)))
        below = None
        for a, b in zip(turns[:-1], turns[1:], strict=True):
            some, low, high = places[a:b], begins[a], behind[b - 1]
            of_place = begins[a:b] - low
            if distance[some[0]] <= near:
                mass[some] = np.add.reduceat(share[low:high] * mass[end[low:high]], of_place)
                continue
            if below is None:
                below = np.log(mass, out=np.zeros_like(mass), where=mass > 0)
            value = weight[low:high] + below[end[low:high]]
            most = np.maximum.reduceat(value, of_place)
            below[some] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, count[a:b])), of_place))
        return np.log(mass, out=np.zeros_like(mass), where=mass > 0) if below is None else below

    def walk(self, position: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a path from each position to its stop; edges of all paths one after the other, and their numbers."""
        active, steps = np.flatnonzero(position < stop), []
        at, step = position[active], 0
        while len(active):
            u = uniform(key[active], step)
            edge = self.first[at]
            on = np.flatnonzero(u > self.choice[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] > self.choice[edge[on]]]
            steps.append((active, edge))
            at = self.end[edge]
            more = at < stop[active]
            active, at, step = active[more], at[more], step + 1
        counts = np.zeros(len(position), np.int64)
        for a, _ in steps:
            counts[a] += 1
        offsets = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for step, (a, edge) in enumerate(steps):
            edges[offsets[a] + step] = edge
        return edges, counts


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the key and the step."""
    bits = H.mixed(key + np.uint64((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF), 11) >> np.uint64(11)
    return (bits.astype(np.float64) + 0.5) * 2.0**-53
