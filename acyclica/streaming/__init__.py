"""Edges that arrive: the engine's queries are batch queries, and a stream of edges feeds them by micro-batch."""
from acyclica.streaming.arrivals import degree_stream, fold_edges

__all__ = ["degree_stream", "fold_edges"]
