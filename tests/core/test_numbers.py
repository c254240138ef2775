import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.operators import codec, rotation, router
from lodevec.plans import budget
from lodevec.plans.options import IndexOptions, MaintenanceKnobs, QueryKnobs, lane_count


@pytest.mark.parametrize("size", [1, 2, 5, 8, 64, 100])
def test_rotation_keeps_lengths_and_turns_back(size):
    x = np.random.default_rng(size).standard_normal((20, size))
    y = rotation.rotate(x, 3)
    assert y.shape[1] == rotation.padded_dimension(size) and np.allclose((y**2).sum(1), (x**2).sum(1))
    assert np.allclose(rotation.rotate_back(y, size, 3), x)
    m = rotation.matrix(rotation.padded_dimension(size), 3)
    assert np.allclose(m @ m.T, np.eye(len(m)))


def test_splitmix_first_values():
    draw = rotation.splitmix(0)
    assert [next(draw) for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]


@pytest.mark.parametrize("bits", [2, 3, 4, 6, 8])
def test_codes(bits):
    x = np.random.default_rng(bits).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = codec.Codec(64, bits)
    rotated = c.rotate(x)
    codes, signs, gamma = c.encode(rotated)
    idx, sgn = c.pack(codes, signs)
    assert len(idx[0]) + len(sgn[0]) + 4 == c.code_bytes
    back = c.unpack(idx, sgn)
    assert (back[0] == codes).all() and (back[1] == signs).all()
    decoded = c.decode(codes, signs, gamma)
    estimate = np.stack([sum(c.estimate(q, codes, signs, gamma)) for q in rotated[:40]])
    assert np.allclose(estimate, rotated[:40] @ decoded.T)
    error = estimate - rotated[:40] @ rotated.T
    assert abs(error.mean()) < 0.004 and error.std() < {2: 0.08, 3: 0.045, 4: 0.025, 6: 0.008, 8: 0.003}[bits]


def test_codebook_is_symmetric_and_sorted():
    for bits in range(1, 8):
        centroids, edges = codec.codebook(64, bits)
        assert len(centroids) == 1 << bits and (np.diff(centroids) > 0).all() and np.allclose(centroids, -centroids[::-1], atol=2e-3)
        assert ((edges > centroids[:-1]) & (edges < centroids[1:])).all()


def test_companding_error_falls_with_bits():
    x = np.random.default_rng(1).standard_normal((50, 32))
    errors = []
    for bits in sorted(codec.COMPANDING):
        codes, low, high = codec.compand_encode(x, bits)
        errors.append(np.abs(codec.compand_decode(codes, low, high, bits) - x).mean())
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.05


def test_router_separates_clusters():
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:4]
    x = centres[np.arange(400) % 4] + rng.normal(0, 0.02, (400, 8))
    runs = router.candidates(x[:256], 4, 20260327, 3, 8)
    judged = [router.objective(router.squared_distances(x, c).min(1).sum(), np.bincount(router.assign(x, c), minlength=4)) for c in runs]
    chosen = runs[router.best(judged)]
    assert sorted(np.bincount(router.assign(x, chosen), minlength=4)) == [100] * 4
    assert [i for i, _ in router.rank_lists(chosen[2], chosen)][0] == 2 and router.first_probes(chosen[1], chosen, 1) == [1]


def test_more_lists_than_rows():
    x = np.asarray([[0.0, 1.0], [1.0, 0.0]])
    (c,) = router.candidates(x, 5, 1, 1, 4)
    assert c.shape == (5, 2) and len(router.first_rows(x, 3)) == 3


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 500), st.integers(1, 600), st.integers(0, 2**31 - 1))
def test_sample_has_no_repeats(rows, wanted, seed):
    places = router.sample_places(rows, wanted, seed)
    assert len(places) == len(set(places)) == min(rows, wanted) and all(0 <= p < rows for p in places)


def test_knobs():
    assert budget.resolve_knobs(24, 10) == {"probes": 3, "oversample_factor": 8, "max_visited_codes": 192, "max_visited_pages": 0}
    assert budget.resolve_knobs(24, 10, probes=4)["oversample_factor"] == 6
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            budget.resolve_knobs(*bad)
    assert [budget.effective_limit(32, 100, 4, 16), budget.effective_limit(32, 100, 4, 0), budget.effective_limit(1024, 100, 4)] == [116, 100, 1536]
    assert budget.candidate_capacity(8, 8) == 64 and budget.candidate_capacity(8, 8, 10) == 10


def test_advice_widens():
    meta = {"list_count": 64, "page_count": 640, "live_count": 100_000, "list_distribution": {"max_list_over_avg": 4.0}}
    plain, narrow = budget.recommend_knobs(100, 10, meta), budget.recommend_knobs(100, 10, meta, selectivity=0.1)
    hit = budget.recommend_knobs(100, 10, meta, last={"mode": "ivf", "max_visited_codes": 500, "visited_code_count": 500})
    assert plain["probes"] >= budget.resolve_knobs(100, 10)["probes"] and narrow["probes"] > plain["probes"]
    assert hit["max_visited_codes"] >= 1000 and all(v["max_visited_pages"] <= 640 for v in (plain, narrow, hit))
    with pytest.raises(ValueError):
        budget.recommend_knobs(10, 5, meta, selectivity=0)


def ranked(*sizes):
    return [budget.ListStats(i, -float(i), live, pages) for i, (live, pages) in enumerate(sizes)]


def test_probe_choice():
    lists = ranked((100, 10), (10, 1), (0, 0), (20, 2), (500, 50))
    assert budget.cost_aware_probes(lists, 3) == [0, 1, 3]
    assert budget.cost_aware_probes(lists, 5, max_codes=40) == [1, 3]
    assert len(budget.cost_aware_probes(ranked((100, 1), (90, 1)), 2, max_codes=5)) == 1
    assert budget.prefix_probes(lists, 5, max_codes=105) == [0] and budget.prefix_probes(lists, 2) == [0, 1]
    assert budget.filtered_live(100, 10, 3) == 30 and budget.filtered_live(5, 10, 9) == 5


def test_crossover_is_at_seven_tenths():
    assert budget.near_exhaustive(70, 100, 0, 0) and not budget.near_exhaustive(69, 100, 0, 0)
    assert budget.near_exhaustive(0, 100, 7, 10)


def test_costs_prefer_lists_for_large_tables():
    assert budget.cheaper_plan(1_000_000, 60_000, 1000, 8, 8) == "lists" and budget.cheaper_plan(50, 4, 64, 64, 8) == "flat"
    one, two = (budget.estimate_cost(10_000, 600, 100, p, 8) for p in (4, 8))
    assert one.total < two.total and one.probes == 4


def test_upkeep():
    k = MaintenanceKnobs()
    act = budget.maintenance_action
    assert act(1000, 0, 0, 0, 0, k) == "healthy" and act(1000, 5, 1, 0, 0, k) == "observe" and act(1000, 300, 1, 0, 0, k) == "merge_delta"
    assert act(1000, 0, 0, 200, 0, k) == "compact" and act(1000, 300, 1, 200, 0, k) == "merge_delta_and_compact"


def test_options_are_checked():
    for bad in ({"bits": 1}, {"bits": 9}, {"lists": -1}, {"metric": "l1"}, {"transform": "dense"}, {"lanes": "8"}, {"router_restarts": 9}, {"attributes": tuple("abcdefghi")}):
        with pytest.raises(ValueError):
            IndexOptions(**bad)
    for bad in ({"oversample_factor": 0}, {"iterative_scan": "on"}, {"decode_rescore_factor": 65}):
        with pytest.raises(ValueError):
            QueryKnobs(**bad)
    assert IndexOptions.from_dict(IndexOptions(lists=3, attributes=("a",)).as_dict()) == IndexOptions(lists=3, attributes=("a",))
    assert lane_count(36, 0) == 16 and lane_count(2000, 2) == 2
