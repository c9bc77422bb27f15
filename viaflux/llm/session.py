"""Shared storage for cut lineage."""

from ..session import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir"]
