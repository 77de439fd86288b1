"""Agents as plug-ins: functions from a passage, or from a whole bill, to facts, and hooks behind them (inventory 2.15.2-2.15.5).

An agent is a Column function, so Catalyst sees through it; an agent that needs Python brings its own pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: (text, context) -> array of facts.
Extract = Callable[[Column, Column], Column]
#: (fact, text) -> fact, or null to drop it.
Hook = Callable[[Column, Column], Column]


class Agents:
    """A registry of agents by name; each may have a hook."""

    def __init__(self):
        self.extract: dict[str, Extract] = {}
        self.hook: dict[str, Hook] = {}

    def add(self, name: str, extract: Extract, hook: Hook | None = None) -> None:
        if name in self.extract:
            raise ValueError(f"agent {name} is there already")
        self.extract[name] = extract
        if hook:
            self.hook[name] = hook

    def facts(self, passages: DataFrame, id_col: str, text_col: str, context_col: str) -> DataFrame:
        """id, agent, place, fact: one row for each fact that an agent finds and its hook keeps. All agents read a passage in one
        pass; facts must have one type."""
        text, context = F.col(text_col), F.col(context_col)

        def of(name: str, extract: Extract) -> Column:
            found, hook = extract(text, context), self.hook.get(name)
            kept = F.filter(F.transform(found, lambda x: hook(x, text)), lambda x: x.isNotNull()) if hook else found
            return F.transform(kept, lambda x, k: F.struct(F.lit(name).alias("agent"), k.alias("place"), x.alias("fact")))

        return passages.select(id_col, F.inline(F.concat(*[of(n, e) for n, e in self.extract.items()])))

    def bill_facts(self, bills: DataFrame, id_col: str, text_col: str, context_col: str) -> DataFrame:
        """The same over whole bills, one fact an agent: the first."""
        return self.facts(bills, id_col, text_col, context_col).filter("place = 0").drop("place")
