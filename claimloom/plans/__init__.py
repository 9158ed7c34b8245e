"""Registered queries: operators applied to the supplied tables, each with its SQL."""
