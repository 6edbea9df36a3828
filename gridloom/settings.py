"""Options of a run, with their defaults, and the names they take."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Format(str, Enum):
    AUTO = "auto"
    METIS = "metis"
    BINARY = "binary"
    EDGELIST = "edgelist"
    EDGELIST_BINARY = "edgelist_binary"
    EDGELIST_DISTRIBUTED = "edgelist_distributed"
    MATRIXMARKET = "matrixmarket"
    ADCIRC = "adcirc"
    TEEC = "teec"
    OFF = "off"
    ALYA = "alya"
    QUADTREE = "quadtree"


class Tool(str, Enum):
    """Partitioners; parse() accepts any case and the short names."""

    SFC = "geosfc"
    KMEANS = "geokmeans"
    HIER_KMEANS = "geohierkm"
    HIER_REPART = "geohierrepart"
    KMEANS_BALANCE = "geokmeansbalance"
    MULTISECTION = "geoms"
    PIXEL = "pixel"
    SPECTRAL = "spectral"
    RCB = "rcb"
    REPART = "repart"
    NONE = "none"

    @classmethod
    def parse(cls, name: str) -> str:
        """The canonical name; names of registered partitioners pass through lower-cased."""
        short = {"geohierkmeans": cls.HIER_KMEANS, "sfc": cls.SFC, "kmeans": cls.KMEANS, "zoltanrcb": cls.RCB, "multisection": cls.MULTISECTION}
        name = str(getattr(name, "value", name)).lower().replace("_", "")
        if name in EXTERNAL:
            raise ValueError(f"{name} is an external program; register a partitioner of that name to use it")
        return short[name].value if name in short else name


#: Names of external tools, which are accepted only if a partitioner is registered for them.
EXTERNAL = frozenset("parmetisgeom parmetisgraph parmetissfc parmetisrefine zoltanrib zoltanmj zoltanxpulp zoltansfc parhipfastmesh parhipultrafastmesh parhipecomesh parhipfastsocial parhipultrafastsocial parhipecosocial".split())


@dataclass
class Settings:
    num_blocks: int = 2
    epsilon: float = 0.03
    epsilons: list[float] | None = None
    tool: str = "geokmeans"
    dimensions: int = 3
    num_node_weights: int = 1
    sfc_resolution: int = 9
    min_sampling_nodes: int = 100
    influence_exponent: float | None = None
    influence_change_cap: float = 0.1
    balance_iterations: int = 20
    max_kmeans_iterations: int = 50
    tighten_bounds: bool = False
    freeze_balanced_influence: bool = False
    erode_influence: bool = False
    keep_most_balanced: bool = False
    hier_levels: list[int] = field(default_factory=list)
    no_refinement: bool = True
    multilevel_rounds: int = 3
    coarsening_steps: int = 3
    min_gain: float = 1.0
    min_border_nodes: int = 1
    stop_after_no_gain: int = 0
    use_diffusion_tie_break: bool = False
    use_geometric_tie_break: bool = False
    gain_over_balance: bool = False
    pixel_side: int = 10
    bisect: bool = False
    cuts_per_dim: list[int] = field(default_factory=list)
    renumber: bool = False
    metrics_level: str = "easy"
    balance_method: str = "repart"
    repeat: int = 1
    seed: int = 0

    def exponent(self, dims: int) -> float:
        return self.influence_exponent if self.influence_exponent is not None else 1.0 / dims

    def check(self) -> Settings:
        """Raise on options that contradict each other."""
        if self.num_blocks < 1:
            raise ValueError("num_blocks must be positive")
        if self.epsilon < 0 or any(e < 0 for e in self.epsilons or ()):
            raise ValueError("epsilon must not be negative")
        if self.epsilons and len(self.epsilons) != self.num_node_weights:
            raise ValueError("one epsilon for each node weight")
        if self.balance_method not in ("repart", "reb_lex", "reb_sqimba"):
            raise ValueError(f"unknown balance method {self.balance_method}")
        if self.hier_levels:
            k = 1
            for x in self.hier_levels:
                k *= x
            if k != self.num_blocks:
                raise ValueError("the product of hier_levels must be num_blocks")
        if Tool.parse(self.tool) == Tool.MULTISECTION.value and self.num_node_weights > 1:
            raise ValueError("multisection takes one node weight")
        return self
