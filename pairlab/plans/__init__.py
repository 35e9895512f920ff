"""Bindings of the operators to tables: each module registers its queries."""

from pairlab.plans import curation, features, outcomes, quality, records, rewards, sampling, scans, text  # noqa: F401
