"""Retrieval settings as tables of arms, checked when they are built.

An arm is a table of chunks with the encoder of its vectors; an arm without an encoder searches words.
A setting names its arms and says how their ranks are added up; one arm without fusion is a
setting without ``k``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

#: Dense tables of an encoder start with this name, so an arm can't read vectors of another encoder.
TABLE_PREFIX = {"qwen": "chunks_qwen", "bge-m3": "chunks_bge_m3"}
TOP_K_RANGE = (1, 50)
#: What a source of candidates for the labelling pool can't do without, by type.
SOURCE_NEEDS = {"pgvector": ("table", "embedder"), "fts": ("table",), "static": ("chunks_file",), "remote": ("index_id",)}


def checked_top_k(top_k: int) -> int:
    low, high = TOP_K_RANGE
    if not low <= top_k <= high:
        raise ValueError(f"top_k must be from {low} to {high}, not {top_k}")
    return top_k


@dataclass(frozen=True)
class Arm:
    """A table that gives candidates, by vectors of an encoder or by words, and how many of them count."""

    table: str
    encoder: str | None = None
    depth: int = 50

    def checked(self, name: str) -> Arm:
        if self.encoder is not None:
            if self.encoder not in TABLE_PREFIX:
                raise ValueError(f"arm {name!r}: unknown encoder {self.encoder!r}; known: {sorted(TABLE_PREFIX)}")
            if not self.table.startswith(TABLE_PREFIX[self.encoder]):
                raise ValueError(f"arm {name!r}: encoder {self.encoder!r} can't read table {self.table!r}")
        return self


@dataclass(frozen=True)
class Setting:
    """Arms by name; ``k`` of reciprocal rank fusion, or None for a single arm's own ranking; weights of arms, 1 where absent."""

    arms: Mapping[str, Arm]
    k: int | None = None
    weights: Mapping[str, float] = field(default_factory=dict)
    top_k: int = 10
    gains: str = "exponential"

    def __post_init__(self):
        for name, arm in self.arms.items():
            arm.checked(name)
        if not self.arms or self.k is None and len(self.arms) != 1:
            raise ValueError("a setting without fusion takes exactly one arm")
        checked_top_k(self.top_k)


def setting_from(spec: Mapping) -> Setting:
    """A setting from a mapping as a settings file has it: arms (name, kind, table, embedder, depth), fusion, rrf_k, weights, top_k."""
    arms = {}
    for a in spec["arms"]:
        name, kind = a["name"], a["kind"]
        if kind not in ("dense", "lexical"):
            raise ValueError(f"arm {name!r}: unknown kind {kind!r}")
        if kind == "dense" and not a.get("embedder"):
            raise ValueError(f"dense arm {name!r} needs an embedder")
        arms[name] = Arm(a["table"], a["embedder"] if kind == "dense" else None, a.get("depth", 50))
    fusion = spec.get("fusion", "single")
    if fusion not in ("single", "rrf"):
        raise ValueError(f"unknown fusion {fusion!r}")
    return Setting(arms, spec.get("rrf_k", 60) if fusion == "rrf" else None, dict(spec.get("weights") or {}), spec.get("top_k", 10))


def pool_sources(specs: list[Mapping]) -> dict[str, Mapping]:
    """Specs (name, type, and what the type needs) of sources for the labelling pool, by name; a repeated name is an error."""
    out: dict[str, Mapping] = {}
    for spec in specs:
        name, kind = spec["name"], spec.get("type")
        if name in out:
            raise ValueError(f"duplicate source name {name!r}")
        if kind not in SOURCE_NEEDS:
            raise ValueError(f"source {name!r}: unknown type {kind!r}")
        if lacking := [n for n in SOURCE_NEEDS[kind] if not spec.get(n)]:
            raise ValueError(f"source {name!r} of type {kind!r} needs {', '.join(lacking)}")
        out[name] = spec
    return out


# The published arms, and the experiments' names and settings.
ARMS = {"qwen": Arm("chunks_qwen", "qwen"), "bge-m3": Arm("chunks_bge_m3", "bge-m3"), "qwen-title": Arm("chunks_qwen_title", "qwen"), "fts": Arm("chunks_fts")}
SHIPPED = Setting({n: ARMS[n] for n in ("qwen", "bge-m3", "fts")}, k=5)


def _published(names: str, k: int | None = 60, depth: int = 50, **weights: float) -> Setting:
    return Setting({n: replace(ARMS[n], depth=depth) for n in names.split()}, k, {n.replace("_", "-"): w for n, w in weights.items()})


_ALL = "qwen bge-m3 fts"
EXPERIMENTS = {
    "baseline-qwen": _published("qwen", None, 10),
    "baseline-bge-m3": _published("bge-m3", None, 10),
    "baseline-fts": _published("fts", None, 10),
    "baseline-qwen-title": _published("qwen-title", None, 10),
    "rrf-qwen-bge": _published("qwen bge-m3"),
    "rrf-qwen-fts": _published("qwen fts"),
    "rrf-bge-fts": _published("bge-m3 fts"),
    "rrf-qwen-bge-fts": _published(_ALL),
    "rrf-3arm-d20": _published(_ALL, depth=20),
    "rrf-3arm-d100": _published(_ALL, depth=100),
    "rrf-3arm-k30": _published(_ALL, 30),
    "rrf-3arm-k10": _published(_ALL, 10),
    "rrf-3arm-k5": _published(_ALL, 5),
    "rrf-3arm-k2": _published(_ALL, 2),
    "rrf-3arm-k1": _published(_ALL, 1),
    "rrf-3arm-k10-d20": _published(_ALL, 10, 20),
    "rrf-3arm-k10-title": _published("qwen-title bge-m3 fts", 10),
    "rrf-3arm-dense-heavy": _published(_ALL, qwen=1.0, bge_m3=1.0, fts=0.5),
    "rrf-3arm-lexical-heavy": _published(_ALL, qwen=1.0, bge_m3=1.0, fts=2.0),
}


@dataclass
class Registry:
    """Named callables: adding a name twice, or asking for an unknown one, is an error."""

    entries: dict = field(default_factory=dict)

    def add(self, name: str, entry) -> None:
        if name in self.entries:
            raise ValueError(f"{name!r} is registered already")
        self.entries[name] = entry

    def get(self, name: str):
        if name not in self.entries:
            raise KeyError(f"{name!r} is not registered")
        return self.entries[name]

    def remove(self, name: str) -> None:
        self.entries.pop(name, None)
