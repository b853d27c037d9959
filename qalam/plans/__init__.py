"""Registered queries, one module per operator family; see ``qalam.plans.catalog``."""
