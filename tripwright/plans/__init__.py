"""Queries over the driver's tables, by topic, each registered with its oracle."""

from tripwright.plans import ablation, dataset, evaluation, identities, places, publishing, queries, ranker, schemas, scope, studies, training
from tripwright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "ablation", "dataset", "evaluation", "identities", "places", "publishing", "queries", "ranker", "schemas", "scope", "studies", "training"]
