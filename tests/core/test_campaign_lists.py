import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.operators import campaign, router
from lodevec.operators.index import VectorIndex
from lodevec.plans.options import IndexOptions, QueryKnobs


def test_float_lists_probe_lists_of_plain_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    built = VectorIndex.build(rows, f"file://{tmp_path}/index", IndexOptions(bits=2, lists=6))
    asked = rows.where("id % 30 = 0").select(F.col("id").alias("qid"), "embedding")
    centroids, rotated = built.centroids(), built.codec.rotate(x.astype(np.float64))
    owner = router.assign(rotated, centroids)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    for probes in (1, 2, 6):
        got = {r.qid: list(r.retrieved) for r in campaign.retrieve(built, asked, 10, "float_lists_approx", knobs=QueryKnobs(probes=probes)).collect()}
        for q in range(0, 300, 30):
            inside = np.flatnonzero(np.isin(owner, router.first_probes(rotated[q], centroids, probes)))
            order = np.lexsort((inside, np.round(1 - unit[inside] @ unit[q], 6)))
            assert got[q] == [str(i) for i in inside[order][:10]]
    flat = VectorIndex.build(rows, f"file://{tmp_path}/flat", IndexOptions(bits=2))
    with pytest.raises(ValueError):
        campaign.check_request(flat, "cosine", "float_lists_approx", 5, 5)
