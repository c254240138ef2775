"""Index options and query knobs, checked when made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from lodevec.functions.vectors import METRICS

PAGE_BYTES = 8192
PAGE_OVERHEAD = 24 + 16 + 128
MOST_ATTRIBUTES = 8
MOST_ANY_VALUES = 16
ATTRIBUTE_TYPES = ("boolean", "smallint", "int", "bigint", "date", "timestamp", "string")
FORMAT_VERSION = 2


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class IndexOptions:
    """How an index is built. ``lists`` 0 is a flat index, more is as many k-means lists."""

    metric: str = "cosine"
    bits: int = 4
    lists: int = 0
    router_samples: int = 256
    router_iterations: int = 8
    router_restarts: int = 3
    router_seed: int = 20260327
    sketch_dim: int = 0
    normalized: bool = True
    transform: str = "hadamard"
    lanes: str = "auto"
    input_kind: str = "vector"
    codec: str = "lloyd"
    attributes: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unsupported metric {self.metric!r}")
        _within("bits", self.bits, 2, 8)
        _within("lists", self.lists, 0, 2**31 - 1)
        _within("router_samples", self.router_samples, 1, 65536)
        _within("router_iterations", self.router_iterations, 1, 64)
        _within("router_restarts", self.router_restarts, 1, 8)
        _within("router_seed", self.router_seed, 0, 2**31 - 1)
        _within("sketch_dim", self.sketch_dim, 0, 65536)
        if self.transform != "hadamard":
            raise ValueError("the only transform is hadamard")
        if self.lanes != "auto":
            raise ValueError("lanes can only be auto")
        if self.input_kind not in ("vector", "halfvec"):
            raise ValueError("input_kind is vector or halfvec")
        if self.codec not in ("lloyd", "companding"):
            raise ValueError("codec is lloyd or companding")
        if len(self.attributes) > MOST_ATTRIBUTES:
            raise ValueError(f"at most {MOST_ATTRIBUTES} attributes can be stored")

    def as_dict(self) -> dict:
        return asdict(self) | {"attributes": list(self.attributes)}

    @classmethod
    def from_dict(cls, data: dict) -> IndexOptions:
        return cls(**(data | {"attributes": tuple(data.get("attributes", ()))}))


@dataclass(frozen=True)
class QueryKnobs:
    """How a search spends its work; passed with each call."""

    probes: int = 8
    oversample_factor: int = 8
    max_visited_codes: int = 0
    max_visited_pages: int = 0
    iterative_scan: str = "off"
    min_rows_after_filter: int = 0
    decode_rescore_factor: int = 1
    decode_rescore_extra_candidates: int = -1
    enable_summary_bounds: bool = True
    shadow_decode_diagnostics: bool = False
    force_decode_score_diagnostics: bool = False

    def __post_init__(self) -> None:
        _within("probes", self.probes, 1, 2**31 - 1)
        _within("oversample_factor", self.oversample_factor, 1, 1024)
        _within("max_visited_codes", self.max_visited_codes, 0, 2**31 - 1)
        _within("max_visited_pages", self.max_visited_pages, 0, 2**31 - 1)
        _within("min_rows_after_filter", self.min_rows_after_filter, 0, 2**31 - 1)
        _within("decode_rescore_factor", self.decode_rescore_factor, 1, 64)
        _within("decode_rescore_extra_candidates", self.decode_rescore_extra_candidates, -1, 2**31 - 1)
        if self.iterative_scan not in ("off", "strict_order", "relaxed_order"):
            raise ValueError("iterative_scan is off, strict_order or relaxed_order")


@dataclass(frozen=True)
class MaintenanceKnobs:
    """When a mutable index asks for work."""

    delta_live_count: int = 256
    delta_page_count: int = 8
    delta_live_percent: int = 10
    dead_tuple_percent: int = 10
    reclaimable_pages: int = 4


def lane_count(code_bytes: int, attributes: int) -> int:
    """Rows of a logical page: the most of 16, 8, 4, 2, 1 whose codes, ids, attributes and key references fit."""
    row = code_bytes + 6 + 2 + 16 * attributes + 10
    return next((n for n in (16, 8, 4, 2) if n * row <= PAGE_BYTES - PAGE_OVERHEAD), 1)
