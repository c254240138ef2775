"""Codes and residual norms of vectors that lie where the last digits of the codebook decide."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lodevec import queries as core
from lodevec.operators import codec, rotation

CENTROIDS = np.asarray(core.CENTROIDS)
BOUNDARIES = (CENTROIDS[1:] + CENTROIDS[:-1]) / 2


def norms(turned):
    """Residual norms by the fixed centroids."""
    return np.sqrt(((turned - CENTROIDS[np.searchsorted(BOUNDARIES, turned, side="right")]) ** 2).sum(1))


def beside_boundaries(rng, n):
    """Rotated unit vectors with one coordinate on a boundary."""
    turned = rng.standard_normal((n, 64))
    turned[:, 5] = 0
    border = BOUNDARIES[np.arange(n) % len(BOUNDARIES)]
    turned *= (np.sqrt(1 - border**2) / np.linalg.norm(turned, axis=1))[:, None]
    turned[:, 5] = border
    return turned


def beside_halves(rng, n):
    """Rotated unit vectors whose residual norm is half way between two values of three decimals."""
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, n, 64)))
    wanted = np.floor(norms(a) * 1000) / 1000 + 0.0005
    low, high = np.zeros(n), np.full(n, 0.2)

    def between(t):
        x = a + t[:, None] * (b - a)
        return x / np.linalg.norm(x, axis=1)[:, None]

    begins = norms(a) > wanted
    for _ in range(60):
        middle = (low + high) / 2
        same = (norms(between(middle)) > wanted) == begins
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    found = between(low)
    return found[np.abs(norms(found) - wanted) < 1e-9]


def test_codebook_has_the_fixed_values():
    centroids, boundaries = codec.codebook(64, 3)
    sums = [int(round(a * 1e9)) + int(round(b * 1e9)) for a, b in zip(core.CENTROIDS, core.CENTROIDS[1:], strict=False)]
    assert centroids.tolist() == core.CENTROIDS and boundaries.tolist() == [s / 2e9 for s in sums] and boundaries[3] == 0


def test_codes_agree_with_sql_where_last_digits_decide(spark, tmp_path):
    """Boundaries came from centroids before rounding, and residual norms were rounded twice: some rows in a million differed."""
    rng = np.random.default_rng(5)
    x = rotation.rotate_back(np.concatenate([beside_boundaries(rng, 140), beside_halves(rng, 140)]), 64).astype(np.float32)
    assert len(x) > 200
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    got = core.QUERIES["C04_codes"](spark, str(tmp_path)).select("vec_id", "codes", "gamma").orderBy("vec_id").collect()
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = tables.execute(f"SELECT vec_id, codes, gamma FROM ({core.ORACLE_SQL['C04_codes']}) ORDER BY vec_id").fetchall()
    differ = [(w, tuple(g)) for w, g in zip(want, got, strict=True) if w != tuple(g)]
    assert not differ, f"{len(differ)} of {len(want)} rows"
