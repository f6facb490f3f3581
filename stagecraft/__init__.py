"""Staged-document experiments as Spark DataFrame jobs."""

from stagecraft.config import CHAIN_EDGES, STAGES, Options

__all__ = ["CHAIN_EDGES", "STAGES", "Options"]
