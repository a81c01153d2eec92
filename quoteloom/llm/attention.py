"""A causal self-attention model of token classes, in numpy.

A token is its class, given the classes before it, and then the token within the
class: the class is predicted by one layer of masked self-attention over a
window, the token by its share of its class in the corpus, after the class just
before it.  A softmax over a few dozen classes instead of a whole vocabulary
keeps a pass over the corpus cheap.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .tokens import ragged

WIDTH, WINDOW, STRIDE = 16, 32, 26


@dataclass
class Classes:
    """Class of each token and natural-log share of it in its class; the token past the last one ends a text.

    Class 0 is the end; ``count`` classes in all.  As input, class ``count``
    stands before a text.  ``log_after``, once counted, has the shares after
    each class (rows).
    """

    of: np.ndarray
    log_share: np.ndarray
    count: int
    log_prior: np.ndarray
    log_after: np.ndarray | None = None

    def before(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The class before each token of texts laid end to end."""
        kinds = np.empty(len(tokens), np.int64)
        kinds[1:] = self.of[tokens[:-1]]
        kinds[np.cumsum(counts) - counts] = self.count
        return kinds

    def with_pairs(self, pairs: np.ndarray, weight: float = 5.0) -> "Classes":
        """With shares after each class, from counts by (class before, token), smoothed towards the shares alone."""
        of = self.of.astype(np.int64)
        total = np.zeros((self.count + 1, self.count))
        for row in range(self.count + 1):
            total[row] = np.bincount(of, weights=pairs[row], minlength=self.count)
        share = np.exp(self.log_share.astype(np.float64))
        after = np.empty(pairs.shape, np.float32)
        for row in range(self.count + 1):
            after[row] = np.log((pairs[row] + weight * share) / (total[row][of] + weight))
        return replace(self, log_after=after)


def spherical_means(vectors: np.ndarray, weights: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Cluster of each unit vector; starts from the heaviest vectors, so that the result is fixed."""
    centre = vectors[np.argsort(-weights, kind="stable")[:k]].copy()
    for _ in range(rounds):
        label = np.argmax(vectors @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, label, vectors * weights[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return np.argmax(vectors @ centre.T, axis=1)


def make_classes(counts: np.ndarray, context: np.ndarray, classes: int = 64, single: int = 24, clustered: int = 8192, rare: int = 3) -> Classes:
    """Classes from token counts (the last is the end) and each token's counts of hashed neighbours.

    The most frequent tokens are classes of their own; others that occur often
    enough are clustered by neighbours; the rest share ``rare`` classes by rank.
    """
    n = len(counts)
    of = np.zeros(n, np.int64)
    order = np.argsort(-counts[:-1], kind="stable")
    of[order[:single]] = 1 + np.arange(min(single, n - 1))
    middle = order[single:clustered]
    middle = middle[counts[middle] >= 20]
    groups = classes - 1 - single - rare
    if len(middle) > groups:
        share = context[middle] / np.maximum(context[middle].sum(1, keepdims=True), 1)
        base = context.sum(0) / max(1, context.sum())
        vectors = np.sqrt(share) - np.sqrt(base)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        of[middle] = 1 + single + spherical_means(vectors, counts[middle].astype(float), groups)
    else:
        of[middle] = 1 + single + np.arange(len(middle))
    rest = np.setdiff1d(order[single:], middle, assume_unique=True)
    rest = rest[np.argsort(-counts[rest], kind="stable")]
    of[rest] = 1 + single + groups + np.minimum(np.arange(len(rest)) * rare // max(1, len(rest)), rare - 1)
    smooth = counts + 0.1
    total = np.bincount(of, weights=smooth, minlength=classes)
    prior = np.log((total + 1e-3) / (total + 1e-3).sum())
    return Classes(of.astype(np.uint8), np.log(smooth / total[of]).astype(np.float32), classes, prior.astype(np.float32))


def _small(total: np.ndarray) -> bool:
    """Whether sums of exponentials are such that these needed no shift by their rows' largest."""
    return bool(total.size) and bool(total.max() < 1e15) and bool(total.min() > 1e-15)


class Attention:
    """Parameters and passes of the class model."""

    NAMES = ("embed", "place", "query", "key", "value", "out", "unembed", "bias")

    def __init__(self, classes: int, log_prior: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, s = WIDTH, 0.3
        shapes = [(classes + 1, d), (WINDOW, d), (d, d), (d, d), (d, d), (d, d), (d, classes)]
        self.params = [(rng.standard_normal(x) * s / np.sqrt(d if i > 1 else 1)).astype(np.float32) for i, x in enumerate(shapes)]
        self.params.append(log_prior.astype(np.float32).copy())
        self.mask = np.tri(WINDOW, dtype=np.float32)
        self.scale = np.float32(1 / np.sqrt(d))
        self.cells = np.arange(self.params[0].size).reshape(-1, d)  # of the embedding laid flat

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.params])

    def load(self, flat: np.ndarray) -> "Attention":
        at = 0
        for i, p in enumerate(self.params):
            self.params[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32, copy=False)
            at += p.size
        return self

    def _mixed(self) -> tuple[np.ndarray, np.ndarray]:
        """Query by key, and value by output: as only these products count, half the columns are multiplied."""
        _, _, wq, wk, wv, wo = self.params[:6]
        return (wq * self.scale) @ wk.T, wv @ wo

    def hidden(self, inputs: np.ndarray, keep: bool = False, least: int = 0):
        """Hidden states of windows of input classes, from the place ``least`` on."""
        x = self.params[0].take(inputs, 0)
        x += self.params[1]
        mixed = self._mixed()
        # one product over all windows, as a stack of windows would be one each; halves of one matrix would be copied by every product
        flat = x.reshape(-1, WIDTH)
        t, y = (flat @ mixed[0]).reshape(x.shape)[:, least:], (flat @ mixed[1]).reshape(x.shape)
        keys, mask = x.transpose(0, 2, 1), self.mask[least:]
        ones = np.ones(WINDOW, x.dtype)
        with np.errstate(over="ignore", invalid="ignore"):
            a = t @ keys
            np.exp(a, out=a)
            a *= mask
            total = a.reshape(-1, WINDOW) @ ones
        if not _small(total):
            a = t @ keys
            a += np.where(mask > 0, np.float32(0), np.float32(-1e9))
            a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            total = a.reshape(-1, WINDOW) @ ones
        total = total.reshape(*a.shape[:2], 1)
        o = a @ y
        o /= total
        h = x[:, least:] + o
        return (h, x, t, y, a, total, o, mixed) if keep else h

    def _odds(self, h: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Odds of the classes: (p, by class what p is to be multiplied by, each row's total, logarithms at ``at`` of p laid flat if asked for)."""
        u, b = self.params[6:]
        with np.errstate(over="ignore", invalid="ignore"):
            p = h @ u
            chosen = None if at is None else p.reshape(-1).take(at) + b.take(at % len(b))
            np.exp(p, out=p)
            factor = np.exp(b)
            total = p @ factor
        if not (_small(total) and factor.min() > 1e-15):
            p = h @ u
            p += b
            p -= p.max(-1, keepdims=True)
            chosen = None if at is None else p.reshape(-1).take(at)
            np.exp(p, out=p)
            factor = np.ones_like(b)
            total = p @ factor
        return p, factor, total, chosen

    def step(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean negative log likelihood of the live targets."""
        least = int(live.any(0).argmax())  # nothing is asked of earlier places
        h, x, t, y, a, total, o, mixed = self.hidden(inputs, True, least)
        _, _, wq, wk, wv, wo, u, _ = self.params
        some = np.flatnonzero(live[:, least:])
        hs = h.reshape(-1, WIDTH).take(some, 0)
        hit = targets[:, least:].reshape(-1).take(some)
        at = np.arange(0, len(hit) * len(u.T), len(u.T)) + hit
        p, factor, odds, _ = self._odds(hs)
        p.reshape(-1)[at] -= odds / factor.take(hit)
        weight = 1 / (max(1, len(some)) * odds)
        dh = np.zeros_like(h)
        ds = p @ (u * factor).T
        ds *= weight[:, None]
        dh.reshape(-1, WIDTH)[some] = ds
        hs *= weight[:, None]
        do = dh / total  # as ``a`` is not divided by its sums
        da = do @ y.transpose(0, 2, 1)
        o *= do
        da -= (o.reshape(-1, WIDTH) @ np.ones(WIDTH, o.dtype)).reshape(*total.shape)
        da *= a
        dt = np.zeros_like(x)
        np.matmul(da, x, out=dt[:, least:])
        dy = a.transpose(0, 2, 1) @ do
        flat, dt_flat, dy_flat = (z.reshape(-1, WIDTH) for z in (x, dt, dy))
        dx = (dt_flat @ mixed[0].T).reshape(x.shape)
        dx += (dy_flat @ mixed[1].T).reshape(x.shape)
        dx += da.transpose(0, 2, 1) @ t
        dx[:, least:] += dh
        dqk, dvo = self.scale * (flat.T @ dt_flat), flat.T @ dy_flat
        cell = self.cells.take(inputs.reshape(-1), 0)
        return [
            np.bincount(cell.reshape(-1), dx.reshape(-1), self.params[0].size).reshape(-1, WIDTH).astype(x.dtype),
            dx.sum(0),
            dqk @ wk,
            dqk.T @ wq,
            dvo @ wo.T,
            wv.T @ dvo,
            (hs.T @ p) * factor,
            (weight @ p) * factor,
        ]

    def train(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, rate: float = 0.02, batch: int = 64) -> None:
        """One pass over windows, by Adam."""
        flat = self.flat()
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        for t, at in enumerate(range(0, len(inputs), batch), 1):
            self.load(flat)
            grad = np.concatenate([g.reshape(-1) for g in self.step(inputs[at : at + batch], targets[at : at + batch], live[at : at + batch])])
            first += 0.1 * (grad - first)
            grad *= grad
            second += 0.01 * (grad - second)
            size = np.sqrt(second / (1 - 0.99**t))
            size += 1e-8
            flat -= (rate / (1 - 0.9**t)) * first / size
        self.load(flat)

    def log_classes(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Natural-log probability of the live targets, in order."""
        least = int(live.any(0).argmax()) if live.size else 0
        some = np.flatnonzero(live[:, least:])
        h = self.hidden(inputs, least=least).reshape(-1, WIDTH).take(some, 0)
        at = np.arange(0, len(h) * len(self.params[7]), len(self.params[7])) + targets[:, least:].reshape(-1).take(some)
        _, _, total, chosen = self._odds(h, at)
        return chosen - np.log(total)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in its text, text, scored from) of the overlapping windows that score each token of each text once."""
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    many[counts == 0] = 0
    text = np.repeat(np.arange(len(counts)), many)
    which = ragged(np.zeros(len(counts), np.int64), many)
    return which * STRIDE, text, np.where(which > 0, WINDOW - STRIDE, 0)


def gathered(classes: np.ndarray, counts: np.ndarray, before: int, some: slice | None = None, plan=None):
    """Inputs, targets and which of them are scored, of windows over texts' classes laid end to end."""
    start, text, scored = plan if plan is not None else windows(counts)
    if some is not None:
        start, text, scored = start[some], text[some], scored[some]
    first = (np.cumsum(counts) - counts)[text]
    place = start[:, None] + np.arange(WINDOW)
    live = (place < counts[text][:, None]) & (np.arange(WINDOW) >= scored[:, None])
    at = np.minimum(first[:, None] + place, len(classes) - 1)
    targets = classes[at].astype(np.int64)
    inputs = np.where(place == 0, before, classes[np.maximum(at - 1, 0)]).astype(np.int64)
    return inputs, targets, live, at


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values, each summed for itself; of no values, zero."""
    out = np.zeros(len(counts), values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def log_probabilities(model: Attention, classes: Classes, tokens: np.ndarray, counts: np.ndarray, at_once: int = 64) -> np.ndarray:
    """log10 probability of each text, of token ids laid end to end."""
    kinds = classes.of[tokens]
    plan = windows(counts)
    # windows that begin a text apart, as of the others the first places are not asked for
    order = np.argsort(plan[2], kind="stable")
    plan = tuple(x[order] for x in plan)
    score = np.zeros(len(tokens), np.float64)
    for a in range(0, len(plan[0]), 64 * at_once):
        inputs, targets, live, at = gathered(kinds, counts, classes.count, slice(a, a + 64 * at_once), plan)
        found = [model.log_classes(*(x[b : b + at_once] for x in (inputs, targets, live))) for b in range(0, len(inputs), at_once)]
        score[at[live]] = np.concatenate(found)
    if classes.log_after is None:
        score += classes.log_share[tokens]
    else:
        score += classes.log_after.reshape(-1)[classes.before(tokens, counts) * len(classes.of) + tokens]
    return sums_of(score, counts) / np.log(10)
