"""What kind of conflict with other law a signal asserts, and whether it can support it (inventory 2.9.57, 2.14.7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .citations import STATES
from .rules import _first
from .text import bound, strip, WHITE

# The context of each conflict; those that need an authority outside; what a model says when it sees no conflict;
# citations that are such an authority; authorities that only repeat a prompt.
CONTEXTS = {
    "federal_preemption": "true_preemption", "dormant_commerce_clause": "true_preemption", "first_amendment": "constitutional_limit",
    "interstate_commerce": "interstate_conflict", "cross_state_conflict": "interstate_conflict", "agency_jurisdiction": "agency_jurisdiction", "other": "unclassified",
}
ASSERTING = ("cross_state_conflict", "federal_preemption", "interstate_commerce", "dormant_commerce_clause")
SELF_NEGATION = r"\b(?:does\s+not|do\s+not|doesn't|will\s+not|would\s+not)\s+(?:appear\s+to\s+)?(?:conflict|preempt|implicate)|\bno\s+(?:apparent\s+|direct\s+|actual\s+)?(?:conflict|preemption)\b|\bunlikely\s+to\s+(?:conflict|be\s+preempted)|\bincorporates\s+federal\s+law\b|\bconsistent\s+with\s+federal\s+law\b"
FEDERAL = r"\b[0-9]+\s*u\.?\s?s\.?\s?c\.?\b|\b[0-9]+\s*c\.?\s?f\.?\s?r\.?\b|\bpublic\s+law\s+[0-9]|\bpub\.?\s?l\.?\s+[0-9]|\bsection\s+230\b|\bcommunications\s+decency\s+act\b|\bfirst\s+amendment\b|\bfourteenth\s+amendment\b|\bhipaa\b|\bcoppa\b|\bfcra\b|\bgina\b|\badea\b|\bamericans\s+with\s+disabilities\b|\bcivil\s+rights\s+act\b|\bage\s+discrimination\s+in\s+employment\b|\btitle\s+vii\b|\bexecutive\s+order\s+(?:no\.?\s*)?[0-9]|\bsupremacy\s+clause\b"
EXAMPLES = ("dec 2025 federal eo on ai", "us constitution art. i § 8", "eu ai act art. 6")
#: States that may be named; territories are no states.
NAMES = {code: name for name, code in STATES.items() if code != "PR"}


def legal_context(conflict: Column, clause: Column, description: Column, authority: Column, refs: Column, jurisdiction: Column) -> Column:
    """struct(context, credible, reason, display). A quoted clause carries a signal by itself; a description that sees no conflict
    sinks it; a conflict with other law must name a federal citation or another state than its own. `refs`: array of names."""
    said = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    kind, some = F.lower(strip(F.coalesce(conflict, F.lit("")))), F.coalesce(F.size(refs), F.lit(0)) > 0
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])[kind], F.lit("unclassified"))
    context = F.when((known == "unclassified") & some & ~said(clause) & ~said(authority), "cross_law_reference").otherwise(known)
    joined = F.lower(F.concat_ws(" | ", F.coalesce(authority, F.lit("")), F.coalesce(description, F.lit("")), F.array_join(F.coalesce(refs, F.array().cast("array<string>")), " | ")))
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), EXAMPLES, F.regexp_replace(F.replace(joined, F.lit("â§"), F.lit("§")), WHITE, " "))
    own = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.upper(strip(jurisdiction))]

    def judged(hay: Column) -> Column:
        other = F.exists(F.array(*map(F.lit, NAMES.values())), lambda n: (n != own) & F.contains(hay, n) & F.regexp_like(hay, F.concat(F.lit(r"\b"), n, F.lit(r"\b"))))
        return hay.rlike(FEDERAL) | F.coalesce(own.isNotNull() & other, F.lit(False))

    reason = F.when(said(clause), F.lit(None)).when(F.lower(F.coalesce(description, F.lit(""))).rlike(SELF_NEGATION), "self_negating_description").when(kind.isin(*ASSERTING) & ~bound(plain, judged), "no_external_authority")
    return bound(F.struct(context.alias("c"), reason.alias("r")), lambda x: F.struct(x["c"].alias("context"), x["r"].isNull().alias("credible"), x["r"].alias("reason"), ((x["c"] != "unclassified") & x["r"].isNull()).alias("display")))
