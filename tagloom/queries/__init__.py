"""Queries of the core by name, and the SQL that states them."""

from tagloom.queries import evaluation, graph, recommend, roles, service, text, training, trends, vocabulary

PARTS = (graph, roles, trends, text, recommend, vocabulary, evaluation, training, service)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in PARTS for k, s in p.ORACLE.items()}
