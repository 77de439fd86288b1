"""Facts that a tracker states in words: penalties, who is covered, dates, and thresholds as comparable triggers
(inventory 2.11.11, 2.11.12, 2.11.14-2.11.17). Each rule's values are fixed; `*_sql` says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .rules import _first, normal_date, normal_date_sql
from .text import bound, strip

# Patterns over lower-case text with what they show, the first that fits unless all are asked for.
MONEY = r"\$\s*([0-9,]+(?:\.[0-9]+)?)\s*(million|m\b|billion|b\b|thousand|k\b)?"
BODIES = {
    r"\battorney\s+general\b": "Attorney General",
    r"\bdepartment\s+of\s+commerce\b": "Department of Commerce",
    r"\bdepartment\s+of\s+justice\b": "Department of Justice",
    r"\bftc\b|federal\s+trade\s+commission": "FTC",
    r"\bcppa\b|california\s+privacy\s+protection\s+agency": "CPPA",
    r"\bdepartment\s+of\s+labor\b": "Department of Labor",
    r"\bstate\s+attorney\s+general\b": "State Attorney General",
    r"\bsuperintendent\b": "Superintendent",
    r"\bcommissioner\b": "Commissioner",
    r"\bdivision\s+of\s+consumer\s+protection\b": "Division of Consumer Protection",
}
PENALTY_PER = {r"per\s+day\b|per-day\b": "day", r"per\s+violation\b|per-violation\b": "violation", r"per\s+occurrence\b|per-occurrence\b": "occurrence"}
PRIVATE_RIGHT = {r"no\s+private\s+right\s+of\s+action": False, r"private\s+right\s+of\s+action": True}
CRIMINAL_PENALTY = {r"no\s+criminal\s+penalt": False, r"criminal\s+penalt|class\s+[a-z]\s+(?:felony|misdemeanor)|imprisonment|jail": True}
CURE = (r"([0-9]+)[-\s]?day(?:s)?\s+(?:cure|notice|opportunity\s+to\s+cure|to\s+cure)\b", r"cure\s+period\s+of\s+([0-9]+)\s+days?")
ENTITIES = {
    r"\bdeveloper[s]?\b": "developer", r"\bdeployer[s]?\b": "deployer", r"\bprovider[s]?\b": "provider", r"\boperator[s]?\b": "operator",
    r"\bemployer[s]?\b": "employer", r"\bcontractor[s]?\b": "contractor", r"\bstate\s+agenc(?:y|ies)\b": "state_agency",
}
SECTORS = {
    r"\bemployment\b": "employment",
    r"\bhousing\b": "housing",
    r"\bcredit\b|\blending\b|\bloan[s]?\b": "credit",
    r"\beducation\b|\bschool[s]?\b|\buniversit(?:y|ies)\b": "education",
    r"\bhealthcare\b|\bhealth\s+care\b|\bmedical\b|\bhospital[s]?\b": "healthcare",
    r"\binsurance\b": "insurance",
    r"\bcriminal\s+justice\b|\blaw\s+enforcement\b|\bpolic(?:e|ing)\b": "criminal_justice",
    r"\bfinancial\s+services\b|\bbanking\b|\bfintech\b": "financial_services",
    r"\bgovernment\s+services\b|\bpublic\s+services\b": "government_services",
}
EMPLOYEES = r"([0-9][0-9,]*)\s*(?:or\s+more|[+]|and\s+over)?\s*(?:full[- ]time\s+)?employee[s]?"
CONSUMERS = r"([0-9][0-9,]*)\s*(?:or\s+more\s+)?(?:consumers?|individuals?|residents?|users?)"
REVENUE_AFTER = MONEY + r"(?:[^.;]{0,40}?(?:revenue|receipts))"
REVENUE_BEFORE = r"(?:revenue|receipts)[^$0-9]{0,20}" + MONEY
GOVERNMENT_ONLY = {
    r"\bgovernment\s+only\b|\bonly\s+(?:applies?\s+to\s+)?(?:government|public\s+sector)": True,
    r"\bprivate\s+sector\b|\bprivate\s+entit(?:y|ies)\b|\bcommercial\b": False,
}
UPON_ENACTMENT = r"effective\s+upon\s+(?:enactment|passage|signing|approval)"
EFFECTIVE = r"(?:effective|takes?\s+effect|effective\s+date[:\s]+)\s*(?:on\s+|upon\s+)?([^\n.;]{5,60})"
ENFORCED_FROM = r"(?:enforcement\s+(?:begins?|starts?|commences?|effective)|compliance\s+(?:required|deadline)[:\s]+)\s*([^\n.;]{5,60})"
RESPONSE_DAYS = r"([0-9]+)\s*(?:calendar\s+|business\s+)?days?\s+(?:to\s+)?(?:respond|response|comply|complete)"
YEARLY = r"(?:annual|annually|(?:every|each)\s+year|yearly)"
EXCERPT = 300
# Phrases of a comparison, in order of precedence, and words of what is compared.
OPERATORS = {
    "greater than or equal": "gte", "no fewer than": "gte", "no less than": "gte", "at least": "gte", "or more": "gte", "or greater": "gte", "minimum of": "gte",
    "less than or equal": "lte", "no more than": "lte", "at most": "lte", "or fewer": "lte", "or less": "lte", "up to": "lte", "maximum of": "lte",
    "more than": "gt", "greater than": "gt", "exceeds": "gt", "exceeding": "gt", "over": "gt", "above": "gt",
    "fewer than": "lt", "less than": "lt", "under": "lt", "below": "lt", "equal to": "eq", "exactly": "eq",
}
TRIGGERS = {
    "employee": "employee_count", "worker": "employee_count", "staff": "employee_count",
    "revenue": "revenue", "gross receipt": "revenue", "annual income": "revenue", "turnover": "revenue",
    "consumer": "consumer_count", "resident": "consumer_count", "data subject": "consumer_count", "household": "consumer_count", "record": "consumer_count",
    "flop": "compute", "compute": "compute", "sector": "sector", "use case": "ai_use_case", "use_case": "ai_use_case",
}
FACTORS = {"billion": 1e9, "million": 1e6, "thousand": 1e3}
CARET, NUMBER = r"([0-9]+(?:\.[0-9]+)?)\s*\^\s*([0-9]+)", r"-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?"


def _shown(low: Column, cases: Mapping, otherwise=None) -> Column:
    return _first([(low.rlike(p), F.lit(v)) for p, v in cases.items()], F.lit(otherwise))


def _all_shown(low: Column, cases: Mapping[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(v)) for p, v in cases.items()]))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _scale(unit: Column) -> Column:
    return F.when(unit.startswith("m"), 1e6).when(unit.startswith("b"), 1e9).when(unit.startswith("t") | (unit == "k"), 1e3).otherwise(1.0)


def _numbers(low: Column, pattern: str) -> Column:
    """The positive numbers that a pattern's first group finds."""
    return F.filter(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), _number), lambda x: x > 0)


def _days(low: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.regexp_extract(low, p, 1).try_cast("int") for p in patterns])


def enforcement_facts(c: Column) -> Column:
    """struct of what a note says about enforcement; `covered`: enough for no model to be asked."""

    def facts(x: Column) -> Column:
        low = x["low"]
        zipped = F.arrays_zip(F.regexp_extract_all(low, F.lit(MONEY), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(MONEY), F.lit(2)).alias("u"))
        most = F.when(F.contains(low, F.lit("$")), F.array_max(F.transform(zipped, lambda x: F.floor(_number(x["n"]) * _scale(x["u"])))).cast("long"))
        said = (most.alias("max_penalty"), _shown(low, PENALTY_PER).alias("penalty_per"), _days(low, *CURE).alias("cure_days"), _shown(low, BODIES).alias("body"), _shown(low, PRIVATE_RIGHT).alias("private_right"), _shown(low, CRIMINAL_PENALTY).alias("criminal"))
        return F.struct(*said, F.when(x["said"] != "", F.substring(x["said"], 1, EXCERPT)).alias("excerpt"))

    def judged(f: Column) -> Column:
        covered = f["max_penalty"].isNotNull() | f["body"].isNotNull() | f["private_right"].isNotNull()
        return F.struct(*[f[k].alias(k) for k in ("max_penalty", "penalty_per", "cure_days", "body", "private_right", "criminal")], covered.alias("covered"), f["excerpt"].alias("excerpt"))

    # each fact is looked for once, whatever reads it
    return bound(bound(F.struct(F.lower(F.coalesce(c, F.lit(""))).alias("low"), c.alias("said")), facts), judged)


def applicability_facts(c: Column) -> Column:
    """struct of who a note says is covered: kinds, sectors, the least thresholds, and whether government alone."""

    def facts(low: Column) -> Column:
        least = lambda p: F.array_min(_numbers(low, p)).cast("long")
        stated = lambda p: _number(F.nullif(F.regexp_extract(low, p, 1), F.lit(""))) * _scale(F.regexp_extract(low, p, 2))
        # of an amount before the word and one after it, the one that begins first
        place = lambda p: F.regexp_instr(low, F.lit(p))
        after, before = place(REVENUE_AFTER), place(REVENUE_BEFORE)
        revenue = F.when((after > 0) & ((before == 0) | (after <= before)), stated(REVENUE_AFTER)).when(before > 0, stated(REVENUE_BEFORE))
        kinds, employees, consumers = _all_shown(low, ENTITIES), least(EMPLOYEES), least(CONSUMERS)
        covered = (F.size(kinds) > 0) | employees.isNotNull() | revenue.isNotNull() | consumers.isNotNull()
        return F.struct(kinds.alias("kinds"), _all_shown(low, SECTORS).alias("sectors"), employees.alias("employees"), F.floor(revenue).cast("long").alias("revenue"), consumers.alias("consumers"), _shown(low, GOVERNMENT_ONLY).alias("government_only"), covered.alias("covered"))

    return bound(F.lower(F.coalesce(c, F.lit(""))), facts)


def timeline_facts(requirements: Column, enforcement: Column) -> Column:
    """struct of a law's dates and periods, from two notes read as one."""

    def facts(low: Column) -> Column:
        day = lambda p: bound(F.nullif(F.regexp_extract(low, p, 1), F.lit("")), normal_date)
        effective = F.when(low.rlike(UPON_ENACTMENT), "upon_enactment").otherwise(day(EFFECTIVE))
        return F.struct(effective.alias("effective"), day(ENFORCED_FROM).alias("enforced_from"), _days(low, RESPONSE_DAYS).alias("response_days"), _days(low, *CURE).alias("cure_days"), F.when(low.rlike(YEARLY), 12).alias("assessment_months"))

    def judged(f: Column) -> Column:
        return F.struct(*[f[k].alias(k) for k in ("effective", "enforced_from", "response_days", "cure_days", "assessment_months")], f["effective"].isNotNull().alias("covered"))

    return bound(bound(F.lower(F.concat_ws(" ", F.coalesce(requirements, F.lit("")), F.coalesce(enforcement, F.lit("")))), facts), judged)


def trigger_value(c: Column) -> Column:
    """The number that a threshold states: with its word, as a power, or plain; null where there is none."""
    low = F.lower(strip(c))
    factor, bare = F.lit(1.0), low
    for word, f in reversed(FACTORS.items()):
        factor = F.when(F.contains(low, F.lit(word)), f).otherwise(factor)
        bare = F.when(F.contains(low, F.lit(word)), F.replace(low, F.lit(word), F.lit(" "))).otherwise(bare)
    power = F.pow(F.regexp_extract(bare, CARET, 1).try_cast("double"), F.regexp_extract(bare, CARET, 2).try_cast("double"))
    plain = F.nullif(F.regexp_extract(F.regexp_replace(bare, "[$,%]", ""), NUMBER, 0), F.lit("")).try_cast("double") * factor
    return F.when(bare.rlike(CARET), power).otherwise(plain)


def trigger(kind: Column, unit: Column, condition: Column, value: Column, flops: Column, sectors: Column) -> Column:
    """struct(type, operator, value) of a threshold; null where nothing is stated. Without a phrase a value is a least one."""
    words = F.lower(F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(unit, F.lit("")), F.coalesce(condition, F.lit(""))))
    read = F.struct(F.coalesce(trigger_value(value), flops).alias("value"), words.alias("words"), F.lower(F.coalesce(condition, F.lit(""))).alias("said"))

    def made(x: Column) -> Column:
        named = _first([(F.contains(x["words"], F.lit(w)), F.lit(t)) for w, t in TRIGGERS.items()], F.nullif(strip(kind), F.lit("")))
        what = F.when(flops.isNotNull(), "compute").when(F.coalesce(sectors, F.lit("")) != "", "sector").otherwise(named)
        known = x["value"].isNotNull() | (F.coalesce(strip(value), F.lit("")) != "")
        operator = _first([(F.contains(x["said"], F.lit(w)), F.lit(o)) for w, o in OPERATORS.items()], F.when(known, "gte").otherwise("any"))
        return F.struct(what.alias("type"), operator.alias("operator"), x["value"].alias("value"), known.alias("known"))

    return bound(bound(read, made), lambda t: F.when(t["type"].isNotNull() | t["known"], F.struct(t["type"].alias("type"), t["operator"].alias("operator"), t["value"].alias("value"))))


# The same for DuckDB.


def shown_sql(low: str, cases: Mapping, otherwise: str = "NULL") -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v).upper()
    return f"CASE {' '.join(f'''WHEN regexp_matches({low}, '{p}') THEN {literal(v)}''' for p, v in cases.items())} ELSE {otherwise} END"


def all_shown_sql(low: str, cases: Mapping[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '{p}') THEN '{v}' END" for p, v in cases.items()) + "], lambda x: x IS NOT NULL), ',')"


def days_sql(low: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(regexp_extract({low}, '{p}', 1) AS INT)" for p in patterns) + ", NULL)"


def day_sql(low: str, pattern: str) -> str:
    return normal_date_sql(f"trim(nullif(regexp_extract({low}, '{pattern}', 1), ''))")
