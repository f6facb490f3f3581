"""Raw papers to the capped, split chain dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stagecraft.config import Options
from stagecraft.operators.caps import (
    field_cuts, split_caps, split_condition, within_field_cap,
)
from stagecraft.operators.chains import assign_split, build_chains
from stagecraft.scratch import materialise


def split_chains(papers: DataFrame, opts: Options) -> DataFrame:
    return assign_split(build_chains(papers, opts), opts)


def dataset_rows(papers: DataFrame, opts: Options) -> DataFrame:
    """Field cap first, then split caps, both by arrival order."""
    return capped(split_chains(papers, opts), opts)


def capped(chains: DataFrame, opts: Options, used_fields: DataFrame | None = None,
           used_splits: dict[str, int] | None = None) -> DataFrame:
    """Apply both caps, less what earlier batches used up.

    One pass over the papers writes the narrow keys of the complete chains; the caps are
    worked out on those. A second pass reads the papers again and only filters.
    """
    cap = opts.max_papers_per_field
    used = used_splits or {}
    rooms = {split: None if n is None else n - used.get(split, 0)
             for split, n in split_caps(opts).items()}
    if cap <= 0 and all(room is None for room in rooms.values()):
        return chains
    keys = materialise(chains.select("seq", "split", "field"), "keys")
    cuts = None
    if cap > 0:
        cuts = materialise(field_cuts(keys, cap, used_fields), "cuts")
        keys = within_field_cap(keys, cuts)
    kept = split_condition(keys, rooms)
    rows = chains if kept is None else chains.where(kept)
    return rows if cuts is None else within_field_cap(rows, cuts)
