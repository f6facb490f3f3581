"""Study options: one immutable object handed to every operator.

A study derives a changed copy with :meth:`Options.but`; nothing is ever
mutated, so one study's settings cannot leak into the next.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

# Stage order, source columns and chain edges of the data model.
STAGES = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
STAGE_COLUMNS = (
    ("title", "summary_title"),
    ("hypothesis", "research_question_hypothesis"),
    ("method", "methodological_details"),
    ("experiment", "procedures_architectures"),
    ("result", "key_results"),
    ("conclusion", "interpretation_implications"),
)
CHAIN_EDGES = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 4))
LONG_RANGE_EDGE = (2, 4)

# Fixed values up to max_stage_chars: settings that decide what a built dataset contains, hence its signature.
_CONTENT_SETTINGS = (
    "dataset", "stage_columns", "year_column", "citation_column", "field_column",
    "id_column", "train_cutoff_year", "test_year", "random_split_test_frac",
    "max_train_examples", "max_test_examples", "max_papers_per_field", "max_stage_chars",
    "fallback_year_column", "seq_column",
)


@dataclass(frozen=True)
class Options:
    # source columns
    dataset: str = "papers"
    stage_columns: tuple = STAGE_COLUMNS
    year_column: str = "oa_year"
    fallback_year_column: str = "source_year"
    citation_column: str = "oa_cited_by_count"
    field_column: str = "field_subfield"
    id_column: str = "paper_id"
    seq_column: str = "seq"          # unique arrival number; replaces stream order

    # splitting and limits; all data and whole texts unless the caller sets a limit
    train_cutoff_year: int = 2024
    test_year: int = 2025
    random_split_test_frac: float = 0.1
    max_stage_chars: int | None = None
    max_papers_per_field: int = 0    # 0 means "no cap"
    max_train_examples: int | None = None
    max_test_examples: int | None = None
    shard_rows: int = 2_000
    shuffle_buffer: int = 2_000
    num_workers: int = 2
    batch_size: int = 4

    # edge pairs and their loss
    chain_edges: tuple = CHAIN_EDGES
    use_long_range_edge: bool = True
    use_trivial_edge_filter: bool = True
    trivial_edge_cosine_threshold: float = 0.95
    edge_loss_type: str = "cosine"   # or "mse"
    edge_loss_enabled: bool = True
    edge_loss_weight: float = 1.0
    loss_dropout: float = 0.125
    use_pred_tokens: bool = True
    num_pred_tokens: int = 4
    max_stage_tokens: int = 64       # of truncate_tokens and prediction_prompt
    encoder_dim: int = 64

    # evaluation; None means "the whole test split"
    eval_perplexity: bool = True
    n_distractors: int = 4
    use_log_citations: bool = True
    label_strategy: str = "field_quartile"
    top_quantile: float = 0.75
    perplexity_eval_examples: int | None = None
    collapse_eval_examples: int | None = None
    smoothing: float = 1.0
    seed: int = 0

    def but(self, **changes) -> "Options":
        return replace(self, **changes)

    @property
    def context_tokens(self) -> int:
        return 5 * self.max_stage_tokens

    @property
    def full_text_tokens(self) -> int:
        return 6 * self.max_stage_tokens

    def signature(self) -> str:
        """Ten hex digits that change when a setting changes the dataset's rows."""
        settings = {name: getattr(self, name) for name in _CONTENT_SETTINGS}
        settings["stage_columns"] = dict(self.stage_columns)
        text = json.dumps(settings, sort_keys=True)
        return hashlib.md5(text.encode("utf-8")).hexdigest()[:10]
