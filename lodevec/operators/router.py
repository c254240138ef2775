"""Training and use of the k-means router on a bounded sample of rotated vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LCG_MASK = 0xFFFFFFFF
SPREAD_WEIGHT, VARIATION_WEIGHT = 0.25, 0.15


def lcg(state: int) -> int:
    """One step of the linear congruential sequence; its constants are fixed values."""
    return (state * 1664525 + 1013904223) & LCG_MASK


def sample_places(rows: int, wanted: int, seed: int) -> list[int]:
    """Places of a sample without replacement in a table ordered by id: the head of a seeded shuffle.

    Only moved places are kept, so the memory is that of the sample.
    """
    state, moved, out = seed & LCG_MASK, {}, []
    for i in range(min(rows, wanted)):
        state = lcg(state)
        j = i + state % (rows - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T, 0)


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest list of each vector, of equals the lowest."""
    return squared_distances(x, centroids).argmin(1)


def _spread_start(sample: np.ndarray, lists: int, seed: int) -> tuple[np.ndarray, int]:
    """First centroids: one by the seed, others by chance in proportion to their squared distance."""
    state = seed & LCG_MASK
    chosen = [state % len(sample)]
    nearest = squared_distances(sample, sample[chosen]).ravel()
    while len(chosen) < lists:
        state = lcg(state)
        running = np.cumsum(nearest)
        pick = int(np.searchsorted(running, state / LCG_MASK * running[-1])) if running[-1] > 0 else len(chosen) % len(sample)
        chosen.append(min(pick, len(sample) - 1))
        nearest = np.minimum(nearest, squared_distances(sample, sample[chosen[-1:]]).ravel())
    return sample[chosen].copy(), state


def lloyd(sample: np.ndarray, centroids: np.ndarray, iterations: int) -> np.ndarray:
    before = None
    for _ in range(iterations):
        distances = squared_distances(sample, centroids)
        owner = distances.argmin(1)
        if before is not None and (owner == before).all():
            break
        before = owner
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        own = distances[np.arange(len(sample)), owner]
        for empty in np.flatnonzero(counts == 0):  # an empty list moves to the sample farthest from its centroid
            far = int(own.argmax())
            centroids[empty], own[far] = sample[far], -1
    return centroids


@dataclass(frozen=True)
class Objective:
    distortion: float
    max_over_avg: float
    variation: float

    @property
    def penalty(self) -> float:
        return SPREAD_WEIGHT * max(0.0, self.max_over_avg - 1) + VARIATION_WEIGHT * self.variation

    @property
    def score(self) -> float:
        return self.distortion * (1 + self.penalty)


def objective(distortion_sum: float, counts: np.ndarray) -> Objective:
    """How tight and even an assignment is; from a sum and counts that may have been aggregated elsewhere."""
    rows, mean = counts.sum(), counts.mean() if len(counts) else 0
    if not rows:
        return Objective(0.0, 1.0, 0.0)
    return Objective(distortion_sum / rows, float(counts.max() / mean), float(counts.std() / mean))


def candidates(sample: np.ndarray, lists: int, seed: int, restarts: int, iterations: int) -> list[np.ndarray]:
    """Trained centroids of each restart; a restart begins as many steps further in the sequence as its number."""
    out, state = [], seed & LCG_MASK
    for _ in range(restarts):
        start, _ = _spread_start(sample, lists, state)
        out.append(lloyd(sample, start, iterations))
        state = lcg(state)
    return out


def best(objectives: list[Objective]) -> int:
    """The restart of the least score, then penalty, then distortion, as far as they differ by a millionth."""
    chosen = 0
    for i, o in enumerate(objectives[1:], 1):
        old = objectives[chosen]
        for mine, other in ((o.score, old.score), (o.penalty, old.penalty), (o.distortion, old.distortion)):
            if abs(mine - other) > 1e-6:
                chosen = i if mine < other else chosen
                break
    return chosen


def first_rows(sample: np.ndarray, lists: int) -> np.ndarray:
    """The simplest router, for comparison: the first rows are the centroids."""
    return sample[np.arange(lists) % len(sample)].copy()


def rank_lists(query: np.ndarray, centroids: np.ndarray) -> list[tuple[int, float]]:
    """Lists by distance to a rotated query, then by number; with scores that fall with distance."""
    distances = squared_distances(query[None, :], centroids)[0]
    order = np.lexsort((np.arange(len(centroids)), distances))
    return [(int(i), float(-distances[i])) for i in order]


def first_probes(query: np.ndarray, centroids: np.ndarray, probes: int) -> list[int]:
    return [i for i, _ in rank_lists(query, centroids)[:probes]]
