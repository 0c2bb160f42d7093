"""Queries over the provided tables, one module for each part of the library."""

from . import annotations, clean, corridors, evaluate, features, geom, graph, labels, manifest, refine, routing  # noqa: F401
