"""Compact vector codes: Lloyd-Max scalar codes of rotated coordinates, a one-bit sketch of the residual and its norm.

All functions work on whole batches; the inner products are matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

from lodevec.operators import rotation

GRID, LLOYD_ROUNDS, LLOYD_SHIFT = 8192, 64, 1e-6
#: Mean absolute coordinate of a random unit vector, times the root of its dimensions. Back through an orthonormal sketch, signs times this
#: over that root and the residual norm give the residual with the least error. The reference divides sqrt(pi / 2) by the width of the sketch, which suits a sketch
#: whose rows have the length of that root; as its rows have length one too, it takes back an eighth of what it should in 64 dimensions.
SKETCH_SCALE = np.sqrt(2 / np.pi)


def coordinate_density(x: np.ndarray, size: int) -> np.ndarray:
    """Density of a coordinate of a random unit vector, up to its scale."""
    inside = np.clip(1 - x * x, 0, None)
    shape = inside ** ((size - 3) / 2) if size > 3 else np.ones_like(x)
    return np.where(np.abs(x) < 1, shape, 0.0)


@lru_cache
def codebook(size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the inner boundaries between them, for ``bits``-bit codes of ``size`` dimensions.

    Centroids are float32 values to nine decimals, as tables of them are written; a boundary is the middle of these, not of the values before rounding.
    """
    cells = (np.arange(GRID) + 0.5) * 2 / GRID - 1
    mass = coordinate_density(cells, size)
    count = 1 << bits
    total = np.concatenate(([0.0], np.cumsum(mass)))
    moment = np.concatenate(([0.0], np.cumsum(mass * cells)))

    def means(edges: np.ndarray, fallback: np.ndarray) -> np.ndarray:
        weight = total[edges[1:]] - total[edges[:-1]]
        first = moment[edges[1:]] - moment[edges[:-1]]
        return np.where(weight > 0, first / np.where(weight > 0, weight, 1), fallback)

    targets = total[-1] * np.arange(1, count) / count
    edges = np.concatenate(([0], np.searchsorted(total[1:], targets, side="left") + 1, [GRID]))
    centroids = means(edges, np.linspace(-1, 1, count))
    for _ in range(LLOYD_ROUNDS):
        middle = (centroids[1:] + centroids[:-1]) / 2
        edges = np.concatenate(([0], np.searchsorted(cells, middle, side="left"), [GRID]))
        moved = means(edges, centroids)
        shift = np.abs(moved - centroids).max()
        centroids = moved
        if shift < LLOYD_SHIFT:
            break
    billionths = np.rint(centroids.astype(np.float32).astype(np.float64) * 1e9)
    return billionths / 1e9, (billionths[1:] + billionths[:-1]) / 2e9


@dataclass(frozen=True)
class Codec:
    """Codes of unit vectors of ``dimension``; ``bits`` counts the sketch bit."""

    dimension: int
    bits: int = 4
    sketch_dim: int = 0
    seed: int = rotation.TRANSFORM_SEED

    @cached_property
    def size(self) -> int:
        return rotation.padded_dimension(self.dimension)

    @cached_property
    def sketch(self) -> int:
        if self.sketch_dim > self.size:
            raise ValueError("the sketch can't be wider than the rotated vector")
        return self.sketch_dim or self.size

    @cached_property
    def _book(self) -> tuple[np.ndarray, np.ndarray]:
        return codebook(self.size, self.bits - 1)

    @property
    def _sketch_seed(self) -> int:
        return self.seed ^ rotation.SKETCH_MIX

    @property
    def code_bytes(self) -> int:
        return -(-self.size * (self.bits - 1) // 8) + -(-self.sketch // 8) + 4

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return rotation.rotate(np.asarray(x, np.float64), self.seed)

    def encode(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, size) of 0.., signs (n, sketch) as booleans, and residual norms (n,), which an index stores in float32."""
        centroids, boundaries = self._book
        cut = np.clip(rotated, -1, 1)
        codes = np.searchsorted(boundaries, cut, side="right").astype(np.uint8)
        residual = cut - centroids[codes]
        gamma = np.sqrt((residual**2).sum(1))
        signs = (residual @ rotation.matrix(self.size, self._sketch_seed))[:, : self.sketch] >= 0
        return codes, signs & (gamma > 0)[:, None], gamma

    def pack(self, codes: np.ndarray, signs: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Bits of each row, lowest first."""
        width = self.bits - 1
        bits = (codes[:, :, None] >> np.arange(width, dtype=np.uint8)) & 1
        packed = np.packbits(bits.reshape(len(codes), -1), axis=1, bitorder="little")
        return [r.tobytes() for r in packed], [r.tobytes() for r in np.packbits(signs, axis=1, bitorder="little")]

    def unpack(self, idx: list[bytes], sgn: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        width = self.bits - 1
        raw = np.frombuffer(b"".join(idx), np.uint8).reshape(len(idx), -1)
        bits = np.unpackbits(raw, axis=1, count=self.size * width, bitorder="little").reshape(len(idx), self.size, width)
        codes = (bits << np.arange(width, dtype=np.uint8)).sum(2).astype(np.uint8)
        raw = np.frombuffer(b"".join(sgn), np.uint8).reshape(len(sgn), -1)
        return codes, np.unpackbits(raw, axis=1, count=self.sketch, bitorder="little").astype(bool)

    def decode(self, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Rotated vectors whose inner products are the estimator's."""
        spread = np.zeros((len(codes), self.size))
        spread[:, : self.sketch] = np.where(signs, 1.0, -1.0)
        back = spread @ rotation.matrix(self.size, self._sketch_seed).T
        return self._book[0][codes] + (SKETCH_SCALE / np.sqrt(self.size)) * gamma.astype(np.float64)[:, None] * back

    def estimate(self, query: np.ndarray, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the inner product of one rotated query with each code: of the centroids, and of the sketch."""
        sketched = (query @ rotation.matrix(self.size, self._sketch_seed))[: self.sketch] * (SKETCH_SCALE / np.sqrt(self.size))
        return self._book[0][codes] @ query, gamma * (np.where(signs, 1.0, -1.0) @ sketched)

    def most(self, query: np.ndarray, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """What the inner product of a rotated query with each encoded unit vector can be at most: the vector lies gamma from its centroids."""
        return self._book[0][codes] @ query + gamma.astype(np.float64) * np.sqrt((query**2).sum())

    def weight_norm(self, query: np.ndarray) -> float:
        """Length of a query's weights on codes and sketch together, which bounds how scores change over a page."""
        sketched = (query @ rotation.matrix(self.size, self._sketch_seed))[: self.sketch] * (SKETCH_SCALE / np.sqrt(self.size))
        return float(np.sqrt((query**2).sum() + (sketched**2).sum()))


#: Companding strengths by bits.
COMPANDING = {2: 0.5, 3: 1.5, 4: 2.5, 5: 3.5, 6: 4.5, 7: 5.5, 8: 6.5}


def compand_encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each row between its least and greatest value, finer near the middle; with those two values."""
    low, high = x.min(1), x.max(1)
    span = np.where(high > low, high - low, 1)
    centred = 2 * (x - low[:, None]) / span[:, None] - 1
    strength = COMPANDING[bits]
    bent = np.sign(centred) * np.log1p(strength * np.abs(centred)) / np.log1p(strength)
    return np.rint((bent + 1) / 2 * ((1 << bits) - 1)).astype(np.uint8), low, high


def compand_decode(codes: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    bent = 2 * codes.astype(np.float64) / ((1 << bits) - 1) - 1
    strength = COMPANDING[bits]
    centred = np.sign(bent) * np.expm1(np.abs(bent) * np.log1p(strength)) / strength
    return low[:, None] + (centred + 1) / 2 * (high - low)[:, None]


class CompandingCodec(Codec):
    """Codes between the least and the greatest coordinate of each vector, with all bits; these two take the place of signs and residual norm."""

    @property
    def code_bytes(self) -> int:
        return -(-self.size * self.bits // 8) + 8

    def encode(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, size), least and greatest coordinates (n,) in float32."""
        codes, low, high = compand_encode(np.asarray(rotated, np.float32).astype(np.float64), self.bits)
        return codes, low.astype(np.float32), high.astype(np.float32)

    def pack(self, codes: np.ndarray, signs: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        bits = (codes[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        packed = np.packbits(bits.reshape(len(codes), -1), axis=1, bitorder="little")
        return [r.tobytes() for r in packed], [v.tobytes() for v in signs.astype("<f4")]

    def unpack(self, idx: list[bytes], sgn: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(idx), np.uint8).reshape(len(idx), -1)
        bits = np.unpackbits(raw, axis=1, count=self.size * self.bits, bitorder="little").reshape(len(idx), self.size, self.bits)
        return (bits << np.arange(self.bits, dtype=np.uint8)).sum(2).astype(np.uint8), np.frombuffer(b"".join(sgn), "<f4")

    def decode(self, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        return compand_decode(codes, signs.astype(np.float64), np.asarray(gamma, np.float64), self.bits)

    def estimate(self, query: np.ndarray, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.decode(codes, signs, gamma) @ query, np.zeros(len(codes))

    def most(self, query: np.ndarray, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """A coordinate lies within half a step of its code to either side."""
        low, high = signs.astype(np.float64), np.asarray(gamma, np.float64)
        middle, under, above = (compand_decode(codes + step, low, high, self.bits) for step in (0.0, -0.5, 0.5))
        error = np.sqrt((np.maximum(middle - under, above - middle) ** 2).sum(1))
        return middle @ query + error * np.sqrt((query**2).sum())

    def weight_norm(self, query: np.ndarray) -> float:
        return float(np.sqrt((query**2).sum()))


CODECS = {"lloyd": Codec, "companding": CompandingCodec}
