"""A linear-chain conditional random field over words, in numpy.

A word's score for each label is the sum of its features' weights: affixes,
letter n-grams and, for words frequent in training, the word itself. Scores are
computed once per word and looked up. Forward-backward runs over segments of all
texts side by side: the product of a segment's transitions carries its left and
right context across, so a text of any length is labelled exactly, in as many
steps as a segment has words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np

TABLE = 1 << 16
SEGMENT = 128
#: Words whose scores are kept; bounds a worker's memory.
CACHE_WORDS = 300_000


def letters_of(token: str) -> str:
    """The token without what is no letter."""
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _places(grams: np.ndarray, kind: int) -> np.ndarray:
    """Table places of letter groups (n, width), told apart by kind."""
    mixed = (grams * _MIX[: grams.shape[1]]).sum(axis=1, dtype=np.uint64) + np.uint64(kind * 0x2545F4914F6CDD1D % 2**64)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % (TABLE - 2)


def features(words: Sequence[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all features of some words, and the word each belongs to.

    Letter pairs and triples, prefixes up to three letters, suffixes up to four,
    with marks for begin and end; the word itself if the lexicon has it; and a
    bias, the last place but one of the table.
    """
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts, numbers = ends - sizes, np.arange(len(words))
    owner = np.repeat(numbers, sizes)
    places, owners = [np.full(len(words), TABLE - 2)], [numbers]
    for width in (2, 3):
        inside = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        places.append(_places(np.stack([codes[inside + j] for j in range(width)], axis=1), width))
        owners.append(owner[inside])
    for width in (2, 3, 4, 5):
        able = numbers[sizes >= width]
        if width < 5:
            places.append(_places(np.stack([codes[starts[able] + j] for j in range(width)], axis=1), 10 + width))
            owners.append(able)
        places.append(_places(np.stack([codes[ends[able] - width + j] for j in range(width)], axis=1), 20 + width))
        owners.append(able)
    listed = [i for i, w in enumerate(words) if w in lexicon]
    places.append(np.array([zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % (TABLE - 2) for i in listed], np.int64))
    owners.append(np.array(listed, np.int64))
    return np.concatenate(places), np.concatenate(owners)


class WordCrf:
    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.weights = np.zeros((TABLE, len(self.labels)))
        self.step = np.zeros((len(self.labels), len(self.labels)))
        self.lexicon: frozenset[str] = frozenset()

    # --- learning ------------------------------------------------------------

    def fit(
        self, samples: Sequence[tuple[list[str], int]], sequences: int = 2500, length: int = 24, epochs: int = 4,
        batch: int = 50, rate: float = 0.25, decay: float = 1e-5, seed: int = 11,
    ) -> None:
        """Learn from word lists of one label each.

        Training sequences are cut from them; half join the words of two texts
        at a random place, so that transitions between labels are learned too.
        """
        rng, k = np.random.default_rng(seed), len(self.labels)
        samples = [(w, y) for w, y in samples if w]
        if not samples:
            return
        seen = Counter(w for words, _ in samples for w in set(words))
        self.lexicon = frozenset(w for w, n in seen.items() if n >= 3)
        by_label = [[words for words, y in samples if y == i] for i in range(k)]
        present = [i for i in range(k) if by_label[i]]

        def cut(label, n):
            words = by_label[label][int(rng.integers(len(by_label[label])))]
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            return words[at : at + n]
        numbers: dict[str, int] = {}
        xs, ys = np.zeros((sequences, length), np.int64), np.full((sequences, length), -1, np.int64)
        for row in range(sequences):
            a = present[int(rng.integers(len(present)))]
            first = int(rng.integers(4, length - 3)) if row % 2 else length
            parts = [(w, a) for w in cut(a, first)]
            if first < length:
                b = present[int(rng.integers(len(present)))]
                parts += [(w, b) for w in cut(b, length - len(parts))]
            for t, (w, y) in enumerate(parts[:length]):
                xs[row, t], ys[row, t] = numbers.setdefault(w, len(numbers)), y
        flat, owner = features(list(numbers), self.lexicon)
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=len(numbers))
        width = int(sizes.max())
        places = np.full((len(numbers), width), TABLE - 1, np.int64)  # the last place pads and stays zero
        places[np.arange(width)[None] < sizes[:, None]] = flat[order]
        squares, step_squares = np.full_like(self.weights, 1e-2), np.full_like(self.step, 1e-2)
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(sequences), max(1, sequences // batch)):
                y, real = ys[pick], ys[pick] >= 0
                at = places[xs[pick]]
                emit = np.where(real[:, :, None], self.weights[at].sum(axis=2), 0.0)
                gamma, pairs = self._expected(emit, real)
                d_emit = gamma
                rows, cols = np.nonzero(real)
                d_emit[rows, cols, y[rows, cols]] -= 1
                d_emit[~real] = 0
                both = real[:, 1:] & real[:, :-1]
                np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), -1)
                grad = np.zeros_like(self.weights)
                for j in range(width):
                    for label in range(k):
                        grad[:, label] += np.bincount(at[:, :, j].ravel(), d_emit[:, :, label].ravel(), TABLE)
                grad[TABLE - 1] = 0
                grad = grad / len(pick) + decay * self.weights
                pairs = pairs / len(pick) + decay * self.step
                squares += grad * grad
                step_squares += pairs * pairs
                self.weights -= rate * grad / np.sqrt(squares)
                self.step -= rate * pairs / np.sqrt(step_squares)

    def _expected(self, emit: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each label at each place, and expected transitions."""
        n, steps, k = emit.shape
        p, a = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(self.step)
        ahead, back = np.empty_like(p), np.ones_like(p)
        ahead[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            now = np.where(real[:, t, None], (ahead[:, t - 1] @ a) * p[:, t], ahead[:, t - 1])
            ahead[:, t] = now / now.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(steps - 2, -1, -1):
            tail = p[:, t + 1] * back[:, t + 1]
            both = ahead[:, t, :, None] * a[None] * tail[:, None, :]
            both = both / both.sum(axis=(1, 2), keepdims=True)
            pairs += both[real[:, t + 1]].sum(axis=0)
            now = np.where(real[:, t + 1, None], tail @ a.T, back[:, t + 1])
            back[:, t] = now / now.sum(axis=1, keepdims=True)
        gamma = ahead * back
        return gamma / gamma.sum(axis=2, keepdims=True), pairs

    # --- labelling -----------------------------------------------------------

    def potentials(self, words: Sequence[str]) -> np.ndarray:
        """Relative weight of each label for each word; its largest is 1."""
        flat, owner = features(words, self.lexicon)
        emit = np.stack([
            np.bincount(owner, self.weights[flat, label], len(words)) for label in range(len(self.labels))
        ], axis=1)
        return np.maximum(np.exp(emit - emit.max(axis=1, keepdims=True)), 1e-30)

    def posteriors(self, potentials: np.ndarray, lengths: Sequence[int]) -> list[np.ndarray]:
        """Label probabilities of every word; texts follow each other in ``potentials``, none is empty."""
        k, a = len(self.labels), np.exp(self.step - self.step.max())
        starts, sizes, first = [], [], []
        at = 0
        for n in lengths:
            first.append(len(starts))
            for s in range(0, n, SEGMENT):
                starts.append(at + s)
                sizes.append(min(SEGMENT, n - s))
            at += n
        count = len(starts)
        order = np.argsort(-np.array(sizes), kind="stable")
        size, start = np.array(sizes)[order], np.array(starts)[order]
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        active = [int(np.searchsorted(-size, -t, "right")) for t in range(1, SEGMENT + 1)]  # segments with at least t words

        is_first = np.zeros(count, bool)
        is_first[place[np.array(first)]] = True

        carry = np.broadcast_to(np.eye(k), (count, k, k)).copy()
        for t, n in enumerate(active):
            if not n:
                break
            moved = carry[:n] @ a if t else np.where(is_first[:, None, None], carry, carry @ a)
            now = moved * potentials[start[:n] + t][:, None, :]
            carry[:n] = now / now.max(axis=(1, 2), keepdims=True)
        into, out_of = np.ones((count, k)), np.ones((count, k))  # context before and after each segment
        last = [*first[1:], count]
        multi = [(f, e) for f, e in zip(first, last) if e - f > 1]
        for f, e in multi:
            for j in range(f + 1, e):
                v = into[place[j - 1]] @ carry[place[j - 1]]
                into[place[j]] = v / v.sum()
            for j in range(e - 2, f - 1, -1):
                v = carry[place[j + 1]] @ out_of[place[j + 1]]
                out_of[place[j]] = v / v.sum()
        ahead, result = [], np.empty((at, k))
        state = into
        for t, n in enumerate(active):
            if not n:
                break
            moved = state[:n] @ a if t else np.where(is_first[:n, None], state[:n], state[:n] @ a)
            now = moved * potentials[start[:n] + t]
            state = now / now.sum(axis=1, keepdims=True)
            ahead.append(state)
        back = out_of.copy()
        for t in range(len(ahead) - 1, -1, -1):
            n = len(ahead[t])
            both = ahead[t] * back[:n]
            result[start[:n] + t] = both / both.sum(axis=1, keepdims=True)
            now = (potentials[start[:n] + t] * back[:n]) @ a.T
            back[:n] = now / now.sum(axis=1, keepdims=True)
        edges = np.cumsum([0, *lengths])
        return [result[i:j] for i, j in zip(edges[:-1], edges[1:])]
