"""Operators: joins, aggregations, scores, clusters and graph loops over claim and event tables."""
