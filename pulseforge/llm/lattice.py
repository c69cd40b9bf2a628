"""Piece lattices of words over the fixed vocabulary of a public SentencePiece model.

A lattice has an edge for each piece at each place of a word; a character that no piece covers alone has an edge of its own
(number -1), which stands for its bytes. Words are worked on many at a time in numpy.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

from .common import ragged

SPACE = "▁"
#: Characters up to which words are worked on together, in arrays; longer ones go one by one, to the same results.
SHORT = 48


class Pieces:
    """The vocabulary: ids of pieces and of what pieces begin with (-1), scores, and the bytes that each id stands for."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.score = np.array([sp.get_score(i) for i in range(self.size)], np.float64)
        self.prefixes: dict[str, int] = {}
        self.spelled, self.byte_ids = [b""] * self.size, [0] * 256
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.spelled[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelled[i] = piece.replace(SPACE, " ").encode()
                for n in range(1, len(piece)):
                    self.prefixes.setdefault(piece[:n], -1)
                self.prefixes[piece] = i
        #: Score of a byte: below every piece's.
        self.byte_score = float(self.score.min()) - 10.0
        self.plant()

    def plant(self) -> None:
        """The prefixes as a trie in arrays: a node per prefix, node * chars + char leads to a child, and a node's piece or -1."""
        number = {p: k + 1 for k, p in enumerate(self.prefixes)}
        self.chars = np.array(sorted({ord(c) for p in self.prefixes for c in p}), np.uint32)
        self.node_piece = np.array([-1, *self.prefixes.values()], np.int64)
        code = {chr(c): k for k, c in enumerate(self.chars)}
        self.first = np.zeros(len(self.chars) + 1, np.int64)
        keys, children = [], []
        for p, k in number.items():
            if len(p) == 1:
                self.first[code[p]] = k
            else:
                keys.append(number[p[:-1]] * len(self.chars) + code[p[-1]])
                children.append(k)
        order = np.argsort(keys)
        self.keys, self.children = np.array(keys, np.int64)[order], np.array(children, np.int64)[order]

    def all_edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of all the edges of words; of those that end together, the longest first."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = ragged(sizes)
        room = np.repeat(sizes, sizes) - place
        at = np.minimum(np.searchsorted(self.chars, text), len(self.chars) - 1)
        code = np.where(self.chars[at] == text, at, len(self.chars))
        here = np.arange(len(text))
        node = self.first[code]
        alone = np.flatnonzero((node == 0) | (self.node_piece[node] < 0))
        found = [(alone, 1, np.full(len(alone), -1))]
        depth = 1
        here, node = here[node > 0], node[node > 0]
        while len(here):
            piece = self.node_piece[node]
            full = piece >= 0
            found.append((here[full], depth, piece[full]))
            more = room[here] > depth
            here, node = here[more], node[more]
            following = code[here + depth]
            known = following < len(self.chars)
            here, key = here[known], node[known] * len(self.chars) + following[known]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            here, node = here[hit], self.children[at[hit]]
            depth += 1
        found.reverse()
        where = np.concatenate([f[0] for f in found])
        end = place[where] + np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        return word[where], place[where], end, np.concatenate([f[2] for f in found])

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, id) by start."""
        get, out, size = self.prefixes.get, [], len(word)
        for a in range(size):
            alone = True
            for b in range(a + 1, size + 1):
                p = get(word[a:b])
                if p is None:
                    break
                if p >= 0:
                    out.append((a, b, p))
                    alone = alone and b > a + 1
            if alone:
                out.append((a, a + 1, -1))
        return out

    def spell(self, word: str, edge: tuple[int, int, int]) -> list[int]:
        return [edge[2]] if edge[2] >= 0 else [self.byte_ids[x] for x in word[edge[0] : edge[1]].encode("utf-8", "replace")]

    def edge_score(self, word: str, edge: tuple[int, int, int]) -> float:
        return float(self.score[edge[2]]) if edge[2] >= 0 else self.byte_score * len(word[edge[0] : edge[1]].encode("utf-8", "replace"))


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


class Lattices:
    """Edges of many short words: word, start, end and piece of each, ordered by end; ends[e] is the slice of those that end at e."""

    def __init__(self, vocabulary: Pieces, words: list[str]):
        word, start, end, piece = vocabulary.all_edges(words)
        order = np.argsort(end.astype(np.int16), kind="stable")
        self.words, self.count = words, len(words)
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]
        self.length = np.array([len(w) for w in words], np.int64)
        self.longest = int(self.length.max(initial=0))
        bounds = np.searchsorted(self.end, np.arange(self.longest + 2))
        self.ends = [slice(bounds[e], bounds[e + 1]) for e in range(self.longest + 1)]

    def forward_sums(self, prob: np.ndarray) -> np.ndarray:
        """Sums over all segmentations: [place, column, word] of the prefix up to each place. prob: [edge, column]."""
        alpha = np.zeros((self.longest + 1, prob.shape[1], self.count))
        alpha[0] = 1.0
        for e in range(1, self.longest + 1):
            s = self.ends[e]
            w, a = self.word[s], self.start[s]
            for c in range(prob.shape[1]):
                alpha[e, c] = np.bincount(w, weights=alpha[a, c, w] * prob[s, c], minlength=self.count)
        return alpha

    def backward_sums(self, prob: np.ndarray) -> np.ndarray:
        """The same of the suffix from each place."""
        beta = np.zeros((self.longest + 1, prob.shape[1], self.count))
        beta[self.length, :, np.arange(self.count)] = 1.0
        for e in range(self.longest, 0, -1):
            s = self.ends[e]
            w, a = self.word[s], self.start[s]
            for c in range(prob.shape[1]):
                np.add.at(beta[:, c], (a, w), beta[e, c, w] * prob[s, c])
        return beta

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the best score, the second best (-inf if there is none), and the edges of the best path: [word, step], -1 after the end, last step first."""
        rows = np.arange(self.count)
        front = np.full((self.longest + 1, self.count), -np.inf)
        front[0] = 0.0
        via = np.full((self.longest + 1, self.count), -1)
        for e in range(1, self.longest + 1):
            s = self.ends[e]
            w, value = self.word[s], front[self.start[s], self.word[s]] + score[s]
            np.maximum.at(front[e], w, value)
            good = np.flatnonzero(value == front[e, w])[::-1]  # of equals the longest piece, which comes first, is written last
            via[e, w[good]] = good + s.start
        back = np.full((self.longest + 1, self.count), -np.inf)
        back[self.length, rows] = 0.0
        for e in range(self.longest, 0, -1):
            s = self.ends[e]
            np.maximum.at(back, (self.start[s], self.word[s]), back[e, self.word[s]] + score[s])
        paths, place, used = [], self.length.copy(), np.zeros(len(self.word), bool)
        while (place > 0).any():
            edge = np.where(place > 0, via[place, rows], -1)
            used[edge[edge >= 0]] = True
            paths.append(edge)
            place = np.where(edge >= 0, self.start[edge], 0)
        # The second best path leaves the best one somewhere, by an edge whose best path it is.
        through = np.where(used, -np.inf, front[self.start, self.word] + score + back[self.end, self.word])
        second = np.full(self.count, -np.inf)
        np.maximum.at(second, self.word, through)
        return front[self.length, rows], second, np.array(paths).T.reshape(self.count, -1) if paths else np.empty((self.count, 0), np.int64)


def scaled_sums(vocabulary: Pieces, word: str, probs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of a word of any length, by column of probs[piece, column].

    Sums of long words leave the range of floats: what is known of the last places is scaled by a common factor as it shrinks.
    """
    edges = vocabulary.edges(word)
    reach = max(b - a for a, b, _ in edges)
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for a, b, piece in edges:
        ends[b].append((a, piece))
    recent, logs = np.zeros((reach, probs.shape[1])), np.zeros(probs.shape[1])  # recent: a ring of the last places' sums
    recent[0] = 1.0
    for place in range(1, len(word) + 1):
        starts, pieces = zip(*ends[place], strict=True) if ends[place] else ((), ())
        here = (recent[np.array(starts, np.int64) % reach] * probs[np.array(pieces, np.int64)]).sum(axis=0)
        recent[place % reach] = here
        if place % 8 == 0:
            scale = np.maximum(recent.max(axis=0), 1e-300)
            recent /= scale
            logs += np.log(scale)
    return np.log(np.maximum(recent[len(word) % reach], 1e-300)) + logs


def n_best(vocabulary: Pieces, word: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of word, best first: (score, ids), all of them different.

    The forward Viterbi score of a place is exactly the best that the rest of a path can bring when it is built from the end
    to the beginning; with it as heuristic, A-star pops whole paths in the order of their scores. The first is Viterbi's own
    path, which of equal ones takes the longest last piece at each place (as Lattices.best does).
    """
    by_end: list[list] = [[] for _ in range(len(word) + 1)]
    front, via = [-np.inf] * (len(word) + 1), [None] * (len(word) + 1)
    front[0] = 0.0
    for edge in vocabulary.edges(word):  # by start: of the edges to one place, the longest comes first
        cost = vocabulary.edge_score(word, edge)
        by_end[edge[1]].append((edge, cost))
        if front[edge[0]] + cost > front[edge[1]]:
            front[edge[1]], via[edge[1]] = front[edge[0]] + cost, edge
    steps, place = [], len(word)
    while place:
        steps.append(via[place])
        place = via[place][0]
    best = [i for edge in reversed(steps) for i in vocabulary.spell(word, edge)]
    if n == 1:
        return [(front[-1], best)]
    agenda: list = [(-front[-1], 0, len(word), 0.0, None)]
    found, ticket = [], 0
    while agenda and len(found) < n:
        _, _, place, so_far, path = heapq.heappop(agenda)
        if place == 0:
            ids: list[int] = []
            while path:
                ids += vocabulary.spell(word, path[0])
                path = path[1]
            found.append((so_far, ids))
            continue
        for edge, cost in by_end[place]:
            ticket -= 1  # among equals the latest: a path is followed to its end before another is begun
            heapq.heappush(agenda, (-(so_far + cost + front[edge[0]]), ticket, edge[0], so_far + cost, (edge, path)))
    return [(front[-1], best), *(x for x in found if x[1] != best)][:n]
