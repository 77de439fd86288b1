"""Ordered rules as Column expressions: dates in words, status, authority, penalties, priority, routing, text damage
(inventory 2.9-2.11). Each rule's values are fixed; `*_sql` says the same for DuckDB where a query compares them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import bound, collapse, strip, strip_sql, WHITE, WHITE_SIGNS

# Month names, and what a date may look like.
MONTHS = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.?\s+"
DAY_AND_YEAR, YEAR_ONLY = MONTHS + r"([0-9]{1,2}),?\s+(20[0-9]{2})\b", MONTHS + r"(20[0-9]{2})\b"
SLASHED, ANY_YEAR = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})$", r"\b(20[0-9]{2})\b"
MONTH_NUMBER = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}


def normal_date(c: Column) -> Column:
    """yyyy-MM-dd from a date in ISO form, in part of it, with slashes, with a month's name, or from a year alone; else null."""
    t = strip(c)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    two = lambda x: F.lpad(x, 2, "0")
    numbers = F.create_map(*[F.lit(x) for pair in MONTH_NUMBER.items() for x in pair])
    month = lambda pattern: numbers[F.substring(F.lower(part(pattern, 1)), 1, 3)]
    slashed_year = F.when(F.length(part(SLASHED, 3)) == 2, F.concat(F.lit("20"), part(SLASHED, 3))).otherwise(part(SLASHED, 3))
    return (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t)
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01")))
        .when(t.rlike(SLASHED), F.concat_ws("-", slashed_year, two(part(SLASHED, 1)), two(part(SLASHED, 2))))
        .when(t.rlike(DAY_AND_YEAR), F.concat_ws("-", part(DAY_AND_YEAR, 3), month(DAY_AND_YEAR), two(part(DAY_AND_YEAR, 2))))
        .when(t.rlike(YEAR_ONLY), F.concat_ws("-", part(YEAR_ONLY, 2), month(YEAR_ONLY), F.lit("01")))
        .when(t.rlike(ANY_YEAR), F.concat(part(ANY_YEAR, 1), F.lit("-01-01")))
    )


def normal_date_sql(t: str) -> str:
    part = lambda pattern, k: f"regexp_extract({t}, '{pattern}', {k})"
    two = lambda x: f"lpad({x}, 2, '0')"
    month = lambda p: f"CASE lower({part(p, 1)})[1:3] {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in MONTH_NUMBER.items())} END"
    year = f"CASE WHEN length({part(SLASHED, 3)}) = 2 THEN '20' || {part(SLASHED, 3)} ELSE {part(SLASHED, 3)} END"
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {t} WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}$') THEN {t} || '-01'
WHEN regexp_matches({t}, '{SLASHED}') THEN concat_ws('-', {year}, {two(part(SLASHED, 1))}, {two(part(SLASHED, 2))}) WHEN regexp_matches({t}, '{DAY_AND_YEAR}') THEN concat_ws('-', {part(DAY_AND_YEAR, 3)}, {month(DAY_AND_YEAR)}, {two(part(DAY_AND_YEAR, 2))})
WHEN regexp_matches({t}, '{YEAR_ONLY}') THEN concat_ws('-', {part(YEAR_ONLY, 2)}, {month(YEAR_ONLY)}, '01') WHEN regexp_matches({t}, '{ANY_YEAR}') THEN {part(ANY_YEAR, 1)} || '-01-01' END"""


# The whole text of a status, then parts of it in order of precedence.
STATUS_WHOLE = {"passed one chamber": "passed_one_chamber", "stalled": "dead", "carried over": "pending"}
STATUS_PART = {
    "veto": "vetoed", "dead": "dead", "failed": "dead", "died": "dead", "withdrawn": "withdrawn", "tabled": "dead",
    "signed": "enacted", "enacted": "enacted", "approved": "enacted", "chaptered": "enacted", "effective": "active", "in effect": "active",
    "passed house": "passed_one_chamber", "passed senate": "passed_one_chamber", "passed assembly": "passed_one_chamber",
    "crossed": "passed_one_chamber", "engrossed": "passed_one_chamber", "enrolled": "passed_one_chamber",
    "committee": "pending", "referred": "pending", "introduced": "introduced", "pending": "pending",
}


def _first(cases: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(list(cases)), otherwise)


def status_of(c: Column) -> Column:
    low = F.lower(strip(c))
    whole = [(low == k, F.lit(v)) for k, v in STATUS_WHOLE.items()]
    return _first(whole + [(F.contains(low, F.lit(k)), F.lit(v)) for k, v in STATUS_PART.items()], F.lit("pending"))


def status_sql(c: str) -> str:
    low = f"lower({strip_sql(c)})"
    cases = [f"WHEN {low} = '{k}' THEN '{v}'" for k, v in STATUS_WHOLE.items()] + [f"WHEN contains({low}, '{k}') THEN '{v}'" for k, v in STATUS_PART.items()]
    return f"CASE {' '.join(cases)} ELSE 'pending' END"


# Words of a title, with the type, effect and certainty that they show, in order of precedence.
AUTHORITY = (
    (("executive order",), "executive_order", "binding", "high"),
    (("guidance", "guidelines", "advisory", "best practices", "recommendation", "faq", "frequently asked"), "guidance", "non_binding", "high"),
    (("ordinance",), "ordinance", "binding", "high"),
    (("consent order", "enforcement action", "settlement", "cease and desist"), "enforcement_action", "binding", "medium"),
    (("rulemaking", "regulation", "final rule", "proposed rule"), "regulation", "binding", "high"),
    (("opinion",), "court_opinion", "binding", "medium"),
    (("act", "law", "statute", "bill", "code"), "statute", "binding", "high"),
)
BILL_NUMBER = r"(?i)^\s*(sb|hb|ab|sf|hf|ld|hr|sr|sjr|hjr|scr|hcr|sm|hm|s|h|a)\s*\.?\s*-?\s*[0-9]+"
PARTIES, LEGISLATIVE_HOSTS = r"\bv\.?\s+[a-z0-9_]", ("legislature", "capitol", "leg.state", "/bills/", "legis.")
REGISTER_HOST = "federalregister.gov"


def authority_cases() -> list[tuple[str, str, str, str]]:
    """(SQL condition over lower-case title, bill, url; type; effect; certainty), the first that holds counts. Both engines read it."""
    has = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
    cases = [(f"(regexp_like(title, '{PARTIES}') AND NOT contains(title, 'act'))", "court_opinion", "binding", "medium")]
    for words, kind, effect, sure in AUTHORITY[:-1]:
        if effect == "binding":
            cases.append((f"{has('title', words)} AND contains(title, 'proposed')", kind, "proposed", sure))
        cases.append((has("title", words), kind, effect, sure))
    words, kind, effect, sure = AUTHORITY[-1]
    cases.append((f"regexp_like(bill, '{BILL_NUMBER}')", kind, effect, "high"))
    cases += [(f"{has('title', words)} AND contains(title, 'proposed')", kind, "proposed", sure), (has("title", words), kind, effect, sure)]
    cases += [(f"{has('url', [REGISTER_HOST])} AND contains(url, 'proposed')", "regulation", "proposed", "medium"), (has("url", [REGISTER_HOST]), "regulation", "binding", "medium")]
    return [*cases, (has("url", LEGISLATIVE_HOSTS), "statute", "binding", "medium"), ("TRUE", "unknown", "unknown", "low")]


def authority_sql(part: int, regexp: str = "regexp_matches") -> str:
    cases = (f"WHEN {c[0].replace('regexp_like', regexp)} THEN '{c[part]}'" for c in authority_cases())
    return f"CASE {' '.join(cases)} END"


def authority(part: int) -> Column:
    """Type (1), effect (2) or certainty (3), from columns title, bill and url in lower case; none of them null."""
    return F.expr(authority_sql(part, "rlike").replace("\\", "\\\\"))


# Weights of penalties, risks and deadlines, and the lowest scores of priorities P0 and P1.
PENALTY_WEIGHT = {"criminal": 2.5, "over_1m": 2.0, "100k_to_1m": 1.5, "10k_to_100k": 1.2, "under_10k": 1.0, "unspecified": 1.0, "none": 0.8}
RISK_WEIGHT = {"critical": 2.5, "high": 1.6, "medium": 1.0, "low": 0.6}
URGENCY_WEIGHT = {"now": 2.0, "soon": 1.4, "future": 1.0, "unknown": 1.0}
P0_LEAST, P1_LEAST, RELEVANCE_LEAST = 4.0, 2.0, 2
DOLLARS = r"\$\s?([0-9,]+(?:\.[0-9]+)?)\s*(million|mil\b|m\b|thousand|k\b)?"
CRIMINAL, UNDECIDED = r"\bcriminal\b|imprisonment|felony|misdemeanor", r"\btbd\b"
NO_PENALTY = r"no (civil |monetary |statutory )?(penalt(y|ies)|fine)\b"


def largest_dollars(c: Column) -> Column:
    """The largest dollar amount that a text names, with its million or thousand."""
    low = F.lower(c)
    zipped = F.arrays_zip(F.regexp_extract_all(low, F.lit(DOLLARS), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(DOLLARS), F.lit(2)).alias("u"))
    scale = lambda u: F.when(u.startswith("m"), 1e6).when(u.startswith("t") | (u == "k"), 1e3).otherwise(1.0)
    return F.array_max(F.transform(zipped, lambda x: F.replace(x["n"], F.lit(","), F.lit("")).try_cast("double") * scale(x["u"])))


def penalty_severity(c: Column) -> Column:
    """The band of a note's penalty; null without a note."""
    low, most = F.lower(c), largest_dollars(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit(None))
        .when(low.rlike(UNDECIDED), "unspecified")
        .when(low.rlike(CRIMINAL), "criminal")
        .when(most >= 1e6, "over_1m")
        .when(most >= 1e5, "100k_to_1m")
        .when(most >= 1e4, "10k_to_100k")
        .when(most.isNotNull(), "under_10k")
        .when(low.rlike(NO_PENALTY), "none")
        .otherwise("unspecified")
    )


def _weight(c: Column, weights: dict[str, float]) -> Column:
    return _first([(c == k, F.lit(w)) for k, w in weights.items()], F.lit(1.0))


def priority(standing: Column, relevance: Column, risk: Column, penalty: Column, urgency: Column) -> Column:
    """struct(tier, score): standing is enacted, open (not enacted yet), closed or, unknown, null. What is not enacted waits (P3),
    thin records are not ranked, and an unknown standing never reaches P0."""
    score = _weight(risk, RISK_WEIGHT) * _weight(penalty, PENALTY_WEIGHT) * _weight(urgency, URGENCY_WEIGHT)
    waits, thin = standing.isin("open", "closed"), relevance < RELEVANCE_LEAST
    tier = F.when(waits, "P3").when(thin, F.lit(None)).when((score >= P0_LEAST) & (standing == "enacted"), "P0").when(score >= P1_LEAST, "P1").otherwise("P2")
    return F.struct(tier.alias("tier"), F.when(waits, 0.0).when(thin, F.lit(None)).otherwise(score).alias("score"))


# Structural lines, short clauses, and the signals of each reader of a passage.
STRUCTURE = r"(?i)^(table\s+of\s+contents|chapter\s+[0-9]+|part\s+[0-9]+\s*[-—]|article\s+[0-9]+|_{5,}|\.{5,}|page\s+[0-9]+)$"
ENACTING = r"(?i)^(be\s+it\s+enacted|the\s+people\s+of\s+the\s+state\s+of|this\s+act\s+(shall\s+be\s+known\s+as|may\s+be\s+cited\s+as)|approved\s+(by\s+the\s+governor|on)|signed\s+(by\s+the\s+governor|into\s+law)|effective\s+immediately)\b"
DEFINITIONS_HEAD = r"(?i)^(definitions|as\s+used\s+in\s+this\s+(act|section|chapter|article|part))\s*[:.]?$"
ENACTING_BELOW = 300
#: By name, as a route lists them in this order. Texts are in lower case.
SIGNALS = {
    "compliance_mechanism": r"\b(?:enforc\w*|penalt\w*|fine[sd]?|violation[s]?|compliance|audit[s]?|inspection[s]?|reporting|register|certif\w*|oversight|attorney general|commission|agency)\b",
    "definition_actor": r"\b(?:defin(?:e[sd]?|ition|ing)|means\b|as used in|for (?:the )?purposes? of)\b",
    "obligation": r"\b(?:shall|must|require[sd]?|obligat|mandate[sd]?|prohibit|may not|responsible for|duty to|ensure that|is the policy|it is the policy)\b",
    "preemption": r"\b(?:preempt|pre-empt|supersede|federal|supremacy|state law|local (?:law|ordinance)|uniform|notwithstanding any (?:other|state|local))\b",
    "rights_protection": r"\b(?:right to|entitled|opt[- ]?out|notice to|consent|appeal|recourse|due process|grievance|redress)\b",
    "threshold_exception": r"\b(?:threshold[s]?|exception[s]?|exempt(?:ion[s]?|ed)?|exclusion[s]?|waiver[s]?|does not apply|not subject to|carve[- ]?out[s]?|fewer than|more than|exceed[s]?|minimum|maximum)\b",
}
#: Letters beyond ASCII become x, so that engines agree on the ends of words.
LETTERS = r"[\x{C0}-\x{24F}\x{370}-\x{1FFF}]"


#: How a passage must begin to be structure, an enacting clause or the head of definitions.
ROUTED_HEAD = rf"(?i)^[{WHITE_SIGNS}]*(?:table|chapter|part|article|_|\.|page|be|the|this|approved|signed|effective|definitions|as)"


def signals_in(c: Column) -> Column:
    """Names of the signals. Only letters beyond ASCII have to be changed, so other texts are read as they are."""
    low = F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.lower(c), LETTERS, "x")).otherwise(F.lower(c))
    return bound(low, lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in SIGNALS.items()])))


def route(c: Column) -> Column:
    """Sorted names of those who read the passage: nobody for structure, all where signals are none, or nearly all."""
    everyone = F.array(*map(F.lit, SIGNALS))

    def headed(text: Column) -> Column:
        structure = text.rlike(STRUCTURE) | (text.rlike(ENACTING) & (F.length(text) < ENACTING_BELOW))
        return F.when(structure, F.array().cast("array<string>")).when(text.rlike(DEFINITIONS_HEAD), F.array(F.lit("definition_actor")))

    by_head = lambda c: F.when(c.rlike(ROUTED_HEAD), bound(collapse(c), headed))
    by_signals = lambda c: bound(signals_in(c), lambda found: F.when((F.size(found) == 0) | (F.size(found) >= len(SIGNALS) - 1), everyone).otherwise(found))
    return bound(c, lambda c: F.coalesce(by_head(c), by_signals(c)))


def sampled(id_col: Column, rate: float) -> Column:
    """The same rows each time: the head of a hash against the rate."""
    return F.substring(F.md5(id_col.cast("string")), 1, 6) < f"{int(rate * 16**6):06x}"


# Signs of damage in a text; each costs up to so much, at so much a share of the text.
GARBLED = "□■▯▮◊♦♣♠♥★☆○●◎◑◒◓◔⊕⊗⊘⊙⊚⊛⊜⊝"
DAMAGE = {"encoding_errors": (10, 0.5), "garbled_chars": (8, 0.4), "control_chars": (10, 0.3), "high_non_ascii": (3, 0.3)}
JUNK_COST, SPARSE_COST, WORDS_LEAST, NON_ASCII_MOST = 0.2, 0.3, 0.4, 0.1


def text_damage(c: Column) -> Column:
    """struct(score, flags): 1 for clean text, less for each sign of bad recognition or encoding, 0 for an empty one."""
    # four of the signs are none of the printed ASCII characters: they are counted in what is left without these
    counted = F.struct(
        F.nullif(F.length(c), F.lit(0)).cast("double").alias("n"),
        F.regexp_replace(c, r"[\x20-\x7e\t\n\r]+", "").alias("rest"),
        (F.regexp_count(c, F.lit(r"(.)\1{5,}")) > 2).alias("junk"),
        F.length(F.regexp_replace(c, r"(?<![a-zA-Z])[a-zA-Z](?![a-zA-Z])|[^a-zA-Z]+", "")).alias("letters"),
        (~F.coalesce(c.rlike(f"[^{WHITE_SIGNS}]"), F.lit(False))).alias("empty"),
    )

    def rest_counted(x: Column) -> Column:
        count = lambda p: F.regexp_count(x["rest"], F.lit(p))
        own = [count("�").alias("broken"), count(f"[{GARBLED}]").alias("garbled"), count(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]").alias("control"), count(r"[^\x00-\x7f\p{L}]").alias("odd")]
        return F.struct(*own, *[x[k].alias(k) for k in ("n", "junk", "letters", "empty")])

    def judged(x: Column) -> Column:
        n = x["n"]
        cost = lambda name, k: F.least(k / n * DAMAGE[name][0], F.lit(DAMAGE[name][1]))
        signs = {
            "encoding_errors": (x["broken"] > 0, cost("encoding_errors", x["broken"])),
            "garbled_chars": (x["garbled"] > 2, cost("garbled_chars", x["garbled"])),
            "control_chars": (x["control"] > 0, cost("control_chars", x["control"])),
            "repeated_junk": (x["junk"], F.lit(JUNK_COST)),
            "low_word_density": (x["letters"] / n < WORDS_LEAST, F.lit(SPARSE_COST)),
            "high_non_ascii": (x["odd"] / n > NON_ASCII_MOST, cost("high_non_ascii", x["odd"])),
        }
        lost = reduce(lambda a, s: a + F.when(s[0], s[1]).otherwise(0.0), signs.values(), F.lit(0.0))
        flags = F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, (hit, _) in signs.items()]))
        score = F.floor(F.greatest(F.lit(0.0), 1 - lost) * 1000 + 0.5) / 1000
        return F.struct(F.when(x["empty"], 0.0).otherwise(score).alias("score"), F.when(x["empty"], F.array(F.lit("empty_passage"))).otherwise(flags).alias("flags"))

    return bound(bound(counted, rest_counted), judged)


# Long forms of bill numbers, the first that fits; words of a summary with their category, in order of precedence.
BILL_FORMS = {
    "senate bill": "sb", "house bill": "hb", "assembly bill": "ab", "senate joint resolution": "sjr", "house joint resolution": "hjr",
    "assembly joint resolution": "ajr", "senate concurrent resolution": "scr", "house concurrent resolution": "hcr", "senate resolution": "sr",
    "house resolution": "hr", "assembly resolution": "ar", "house file": "hf", "senate file": "sf", "legislative bill": "lb", "general assembly": "ga",
}
CATEGORIES = {
    "synthetic_content": ("intimate image", "csam", "deepfake", "synthetic content", "likeness", "pornograph", "nonconsensual"),
    "political_advertising": ("political", "election", "campaign", "ballot"),
    "automated_decision": ("automated decision", "algorithmic", "automated-decision", "automated making", "admt"),
    "data_privacy": ("consumer privacy", "data privacy", "personal data", "ccpa", "gdpr"),
    "government_ai": ("government", "public sector", "state agency", "law enforcement"),
    "employment": ("employment", "workplace", "worker", "hiring", "employer"),
    "healthcare": ("healthcare", "health care", "medical", "clinical", "patient"),
    "education": ("education", "student", "school", "academic"),
    "frontier_models": ("frontier", "foundation model", "general purpose", "large language"),
    "social_media": ("social media", "social network", "platform"),
    "insurance": ("insurance",),
    "comprehensive_ai": ("comprehensive", "all ai", "general ai"),
    "transparency": ("transparency", "disclosure", "notice"),
}
NO_CATEGORY = "general_ai"


def plain_name(c: Column) -> Column:
    """Lower-case letters, digits and single spaces; other signs go without leaving a space."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), f"[^a-z0-9{WHITE_SIGNS}]", ""), WHITE, " ")


def plain_name_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({strip_sql(f'lower({c})')}, '[^a-z0-9{WHITE_SIGNS}]', '', 'g'), '{WHITE}', ' ', 'g')"


def bill_id(c: Column) -> Column:
    """A bill's number with the short form of its kind."""
    n = plain_name(c)
    return _first([(F.startswith(n, F.lit(f"{long} ")), F.concat(F.lit(f"{short} "), F.substring(n, len(long) + 2, 1 << 30))) for long, short in BILL_FORMS.items()], n)


def bill_id_sql(c: str) -> str:
    n = plain_name_sql(c)
    return f"CASE {' '.join(f'''WHEN starts_with({n}, '{long} ') THEN '{short} ' || substr({n}, {len(long) + 2})''' for long, short in BILL_FORMS.items())} ELSE {n} END"


def category(c: Column) -> Column:
    low = F.lower(c)
    return _first([(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in CATEGORIES.items()], F.lit(NO_CATEGORY))


def category_sql(c: str) -> str:
    hit = lambda words: " OR ".join(f"contains(lower({c}), '{w}')" for w in words)
    return f"CASE {' '.join(f'''WHEN {hit(w)} THEN '{k}' ''' for k, w in CATEGORIES.items())} ELSE '{NO_CATEGORY}' END"
