"""All driver queries of the graph library, and their SQL."""

from . import queries_formats, queries_graph, queries_models

QUERIES = queries_graph.QUERIES | queries_models.QUERIES | queries_formats.QUERIES
ORACLES = queries_graph.ORACLES | queries_models.ORACLES | queries_formats.ORACLES
