"""Registered queries: each operator run over the shared tables, with its SQL check."""

from . import registry
from . import cleaning, evaluation, features, joins, models, runs, sampling, sources, streams  # noqa: F401

QUERIES = registry.QUERIES
SQL = registry.SQL
COVERS = registry.COVERS
