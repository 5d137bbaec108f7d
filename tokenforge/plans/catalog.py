"""Imports every plan module so that the registry is complete."""

from __future__ import annotations

from . import (chat_queries, combine_queries, corpus_queries, document_queries,  # noqa: F401
               infer_queries, loop_queries, loss_queries, metrics_queries)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
