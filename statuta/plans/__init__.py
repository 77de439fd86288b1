"""The registered queries, by area."""

from . import answers, entities, lifecycle, matching, origins, pages, passages, records, rollups, rules, serving, sourcing, stated, streams, summaries, syncs, verification  # noqa: F401
