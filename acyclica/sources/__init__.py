"""Graphs from text, tables and literals; solutions and reports to files."""
from acyclica.sources.adjacency import literal_edges, read_adjacency, read_lines
from acyclica.sources.scores import read_standings, write_report
from acyclica.sources.sinks import solution_summary, write_solution
from acyclica.sources.tables import edges_from_columns, edges_from_sequence, ordered_lead

__all__ = ["edges_from_columns", "edges_from_sequence", "literal_edges", "ordered_lead", "read_adjacency", "read_lines", "read_standings", "solution_summary", "write_report", "write_solution"]
