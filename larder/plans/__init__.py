"""Registered queries: each operator applied to the standard tables."""

from larder.plans import (  # noqa: F401
    catalogue, grouping, ingesting, logbook, merges, nutrients, ordering, plates, publishing, requests, searches, streams, texts,
)
