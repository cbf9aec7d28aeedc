"""Linear-chain conditional random field with two tags, over many sequences at a
time.

With two tags, forward and backward messages are one number each: the odds of tag
1 against tag 0. All sequences advance together, one position per step, longest
first, so a step is a handful of array operations on the sequences still open.

Very long sequences are cut into parts that advance together too. Over a part the
message goes through a 2 x 2 matrix, the product of the steps in it; first all parts
work out their matrices, then the ends of parts are passed along each sequence, then
all parts are filled in from their ends. So a sequence of n positions takes some
3 * sqrt(n) steps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_CLIP = 30.0
#: Sequences up to so many positions are not cut.
LONG = 4096


@dataclass
class Chain:
    """``start`` is the log odds of tag 1 at the first position, ``moves[i, j]`` the
    log weight of going from tag i to tag j."""

    weights: np.ndarray
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


class Sequences:
    """Flat positions of sequences of given lengths, and the order to walk them."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, dtype=np.int64)
        self.lengths, self.total = lengths, int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.order = order = order[lengths[order] > 0]
        self.begin, self.long = begin[order], lengths[order]
        self.steps = int(self.long[0]) if len(order) else 0
        self.open = np.searchsorted(-self.long, -np.arange(self.steps), side="left")

    def firsts(self) -> np.ndarray:
        return self.begin

    def follows(self) -> np.ndarray:
        """Positions that have one before them in their sequence."""
        mask = np.ones(self.total, dtype=bool)
        mask[self.begin] = False
        return np.flatnonzero(mask)


def _products(parts: Sequences, psi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Of each part, longest first, the product of the steps after its first position,
    scaled."""
    m = np.tile(np.eye(2), (len(parts.begin), 1, 1))
    for t in range(1, parts.steps):
        n = parts.open[t]
        step = m[:n] @ a
        step[:, :, 1] *= psi[parts.begin[:n] + t, None]
        m[:n] = step / step.max(axis=(1, 2), keepdims=True)
    return m


def _cut(seqs: Sequences, psi: np.ndarray, a: np.ndarray, start: float) -> tuple[Sequences, np.ndarray, np.ndarray]:
    """The sequences in parts, with the forward message at the first position of each
    part and the backward message at its last."""
    size = int(np.ceil(np.sqrt(seqs.steps)))
    counts = -(-seqs.lengths // size)
    lengths = np.full(int(counts.sum()), size, dtype=np.int64)
    ends = np.cumsum(counts)
    full = seqs.lengths > 0
    lengths[ends[full] - 1] = seqs.lengths[full] - size * (counts[full] - 1)
    parts = Sequences(lengths)
    m = np.empty((len(lengths), 2, 2))
    m[parts.order] = _products(parts, psi, a)
    begin = np.cumsum(lengths) - lengths
    first, last = np.empty(len(lengths)), np.ones(len(lengths))
    head, n_parts = (ends - counts)[full], counts[full]
    by_size = np.argsort(-n_parts, kind="stable")
    head, n_parts = head[by_size], n_parts[by_size]
    first[head] = psi[begin[head]] * np.exp(start)
    for k in range(1, int(n_parts[0])):
        at = head[: np.searchsorted(-n_parts, -k, side="left")] + k
        r, before = first[at - 1], m[at - 1]
        r = (before[:, 0, 1] + r * before[:, 1, 1]) / (before[:, 0, 0] + r * before[:, 1, 0])
        first[at] = psi[begin[at]] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
    for k in range(int(n_parts[0]) - 2, -1, -1):
        at = head[: np.searchsorted(-n_parts, -(k + 1), side="left")] + k
        b, after = last[at + 1], m[at + 1]
        x = psi[begin[at + 1]] * (after[:, 1, 0] + after[:, 1, 1] * b) / (after[:, 0, 0] + after[:, 0, 1] * b)
        last[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return parts, first[parts.order], last[parts.order]


def marginals(seqs: Sequences, emission: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of tag 1 at each position, and the forward odds and the backward
    odds times the emission, from which pair marginals follow."""
    psi = np.exp(np.clip(emission, -_CLIP, _CLIP))
    a = np.exp(chain.moves)
    forward, back = np.empty(seqs.total), np.ones(seqs.total)
    if seqs.steps:
        if seqs.steps > LONG:
            seqs, r, b = _cut(seqs, psi, a, chain.start)
        else:
            r, b = psi[seqs.begin] * np.exp(chain.start), np.ones(len(seqs.begin))
        forward[seqs.begin] = r
        for t in range(1, seqs.steps):
            n = seqs.open[t]
            at, r = seqs.begin[:n] + t, r[:n]
            r = psi[at] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
            forward[at] = r
        back[seqs.begin + seqs.long - 1] = b
        for t in range(seqs.steps - 2, -1, -1):
            n = seqs.open[t + 1]
            at = seqs.begin[:n] + t
            x = psi[at + 1] * back[at + 1]
            back[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    ahead = psi * back
    odds = forward * back
    return odds / (1 + odds), forward, ahead


def train(features, tags: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Likelihood ascent (Adam on the whole sample). ``features.scores(w)`` gives
    the emission of every position, ``features.pull(g, n)`` the gradient of the
    weights; ``features.size`` is the number of weights."""
    seqs = Sequences(lengths)
    chain = Chain(np.zeros(features.size))
    if not seqs.total:
        return chain
    first, later = seqs.firsts(), seqs.follows()
    counts = np.zeros((2, 2))
    np.add.at(counts, (tags[later - 1], tags[later]), 1)
    state = [np.zeros(features.size + 5) for _ in range(2)]
    for step in range(1, rounds + 1):
        p, forward, ahead = marginals(seqs, features.scores(chain.weights), chain)
        a = np.exp(chain.moves)
        r, x = forward[later - 1], ahead[later]
        parts = np.stack([np.full(len(r), a[0, 0]), a[0, 1] * x, a[1, 0] * r, a[1, 1] * r * x])
        expected = (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)
        slope = np.concatenate([
            features.pull(tags - p) / seqs.total - ridge * chain.weights,
            [(tags[first] - p[first]).mean()], ((counts - expected) / max(1, len(later))).ravel(),
        ])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope * slope
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-7)
        chain.weights = chain.weights + move[: features.size]
        chain.start = float(np.clip(chain.start + move[features.size], -8, 8))
        chain.moves = np.clip(chain.moves + move[features.size + 1 :].reshape(2, 2), -8, 8)
    return chain
