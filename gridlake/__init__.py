"""Tiled-raster and vector analytics as Spark jobs."""

from .session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
