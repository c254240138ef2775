"""Seeded structured rotation: sign flips, a permutation and a normalised Hadamard transform, as one matrix."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1
TRANSFORM_SEED = 0
SKETCH_MIX = 0x9E3779B97F4A7C15


def padded_dimension(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def splitmix(seed: int):
    """The SplitMix64 sequence of a seed; its three constants are fixed values."""
    state = seed & MASK
    while True:
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        yield z ^ z >> 31


@lru_cache
def signs_and_places(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A sign for each coordinate and the place it goes to."""
    draw = splitmix(seed)
    signs = np.asarray([1.0 if next(draw) & 1 else -1.0 for _ in range(size)])
    places = np.arange(size)
    for last in range(size, 1, -1):
        other = next(draw) % last
        places[[last - 1, other]] = places[[other, last - 1]]
    return signs, places


@lru_cache
def matrix(size: int, seed: int = TRANSFORM_SEED) -> np.ndarray:
    """Orthonormal; rows of vectors rotate by ``x @ matrix`` and back by its transpose."""
    signs, places = signs_and_places(size, seed)
    hadamard = np.ones((1, 1))
    while len(hadamard) < size:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    return signs[:, None] * hadamard[places] / np.sqrt(size)


def rotate(x: np.ndarray, seed: int = TRANSFORM_SEED) -> np.ndarray:
    """Rows padded with zeros to a power of two, and rotated."""
    size = padded_dimension(x.shape[1])
    return x @ matrix(size, seed)[: x.shape[1]]


def rotate_back(y: np.ndarray, size: int, seed: int = TRANSFORM_SEED) -> np.ndarray:
    return (y @ matrix(y.shape[1], seed).T)[:, :size]
