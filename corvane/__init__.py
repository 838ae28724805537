"""A Spark engine for code and text retrieval: index a corpus, rank its chunks for a task, pack what fits a budget."""

from __future__ import annotations

from typing import Any

_API = {
    "build_index": "corvane.plans.index",
    "rank": "corvane.plans.ranking",
    "rank_tasks": "corvane.plans.ranking",
    "pack": "corvane.plans.pack",
    "outline_repo": "corvane.operators.outline",
    "outline_file": "corvane.operators.outline",
    "query": "corvane.engine",
    "load_index": "corvane.sources.store",
    "save_index": "corvane.sources.store",
    "scan_tree": "corvane.sources.scan",
    "Engine": "corvane.engine",
}
__all__ = list(_API)


def __getattr__(name: str) -> Any:
    if name not in _API:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(_API[name]), name)
