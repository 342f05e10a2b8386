"""Job settings and the argument rules that guard them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrefixConfig:
    """How an event log becomes (prefix -> next activity) rows.

    base / gap: anchors are the 0-based event positions base, base+gap, ... up to n-2;
    the prefix of anchor i holds events 0..i and its label is event i+1.
    m: the last m events of a prefix carry their attribute values (0 = activities only).
    """

    base: int = 1
    gap: int = 3
    m: int = 1
    test_share: float = 0.3
    split_mode: str = "trace"          # "trace" (temporal) or "row" (seeded sample)
    cross_dedup: bool = False          # trace split only: drop test keys seen in retrieval
    key_order: str = "reference"       # "reference": events <= base keep column order; "sorted"
    block_size: int = 4096             # events per assembly block (bounds every group)
    row_split_seed: int = 42
    dedup_sep: str = ""                # separator inside the dedup key (reference: none)
    zero_test_means_all: bool = False  # reference quirk: int(N*p)=0 selects every trace
    lifecycle_filter: bool = True      # keep complete/completed events when a lifecycle exists

    @property
    def block_events(self) -> int:
        """Events of a block: a value window and its label reach into one more block at most."""
        return max(self.block_size, max(self.m, 1) + 1)

    def validate(self) -> "PrefixConfig":
        if self.base < 0:
            raise ValueError("base must be >= 0")
        if self.gap < 1:
            raise ValueError("gap must be >= 1")
        if self.m < 0:
            raise ValueError("m must be >= 0")
        if not 0.0 <= self.test_share <= 1.0:
            raise ValueError("test_share must be within [0, 1]")
        if self.split_mode not in {"trace", "row"}:
            raise ValueError(f"split_mode is {self.split_mode!r}; it takes 'trace' or 'row'")
        if self.key_order not in {"reference", "sorted"}:
            raise ValueError(f"Unsupported key_order: {self.key_order}")
        if self.block_size < 2:
            raise ValueError("block_size must be >= 2")
        return self


@dataclass(frozen=True)
class EvalConfig:
    """One evaluation setup (dataset variant x encoder x predictor)."""

    top_k: int = 3
    max_rows: int | None = None
    encoder: str = "hashing"
    reranker: str | None = None
    rerank_pool_k: int | None = None
    predictor: str = "neighbour_vote"
    prompt_variant: str | None = None
    boundaries: tuple[int, ...] = (5, 10, 20, 30)
    shuffle_seed: int = 7
    keep_individual_predictions: bool = False
    approx: bool = False               # search an index of residual codes instead of all points
    approx_recall: float = 0.95        # share of true neighbours its probed cells must hold

    def validate(self, known_encoders=None, known_rerankers=None) -> "EvalConfig":
        if self.top_k < 1:
            raise ValueError("top_k must be >= 1")
        if self.reranker and self.rerank_pool_k is None:
            raise ValueError("a reranker needs the size of its pool: set rerank_pool_k")
        if self.rerank_pool_k is not None and not self.reranker:
            raise ValueError("rerank_pool_k has no effect without a reranker")
        if self.rerank_pool_k is not None and self.rerank_pool_k <= 0:
            raise ValueError("rerank_pool_k must be > 0")
        if self.rerank_pool_k is not None and self.rerank_pool_k < self.top_k:
            raise ValueError("the rerank pool cannot be smaller than top_k")
        if not 0.0 < self.approx_recall <= 1.0:
            raise ValueError("approx_recall must be within (0, 1]")
        if self.max_rows is not None and self.max_rows < 0:
            raise ValueError("max_rows must be >= 0")
        if list(self.boundaries) != sorted(set(self.boundaries)):
            raise ValueError("bucket boundaries must be strictly ascending")
        if known_encoders is not None and self.encoder not in known_encoders:
            raise ValueError(f"Unsupported encoder: {self.encoder}")
        if known_rerankers is not None and self.reranker is not None \
                and self.reranker not in known_rerankers:
            raise ValueError(f"Unsupported reranker: {self.reranker}")
        return self

    @property
    def candidate_limit(self) -> int:
        """First-stage size: over-fetch to the pool only when a reranker will run."""
        if self.reranker and self.rerank_pool_k is not None:
            return max(self.top_k, self.rerank_pool_k)
        return self.top_k


@dataclass(frozen=True)
class EventLogSpec:
    """Column mapping from a tabular table onto the canonical event log."""

    case_col: str
    activity_col: str
    ts_col: str | None
    pos_col: str
    attr_cols: tuple[str, ...] | None = None     # None: every column but case/activity
    lifecycle_col: str | None = None
    activity_cols: tuple[str, ...] = ()          # extra columns joined into the label with '+'
    extra_excluded: tuple[str, ...] = field(default=())
