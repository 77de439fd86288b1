"""Citations in one form, and names and addresses of places (inventory 2.9.38, 2.9.41, 2.9.46, 2.9.48, 2.9.53, 2.9.59)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .rules import _first
from .text import WHITE, any_script, strip, strip_sql

# By jurisdiction, what stands for the sign of a section, whatever its case; then what does anywhere.
CITED = {
    "CO": ((r"C\.R\.S\.?\s*§\s*", "§ "), (r"Colo(?:rado)?\.?\s+Rev\.?\s+Stat\.?\s*§?\s*", "§ ")),
    "CA": ((r"Cal(?:ifornia)?\.?\s+\w[\w\s&\.]*\s+Code\s*§\s*", "§ "), (r"Cal(?:ifornia)?\.?\s+Code\s+Regs\.?\s+tit\.?\s*\d+[,\s]*§\s*", "§ ")),
    "NY": ((r"N\.Y\.?\s+[\w\s\.&]+Law\s*§\s*", "§ "), (r"New\s+York\s+Laws\s+", "Section ")),
    "TX": ((r"Tex(?:as)?\.?\s+[\w\s&\.]+\s+Code\s*(?:Ann\.?)?\s*§\s*", "§ "), (r"V\.T\.C\.A\.?\s+[\w\s&\.]*§\s*", "§ ")),
    "CT": ((r"C\.G\.S\.?\s*§\s*", "§ "), (r"Conn(?:ecticut)?\.?\s+Gen\.?\s+Stat\.?\s*§?\s*", "§ ")),
    "IL": ((r"\d+\s+ILCS\s+[\d/\.\-]*/([\d\.\-]*)", "§ {1}"), (r"(\d+\s+ILCS\s+[\d\.\-]+)", "§ {1}"), (r"\d+\s+Ill\.?\s+Comp\.?\s+Stat\.?\s*[\d/]*\s*§?\s*", "§ ")),
    "UT": ((r"Utah\s+Code\s+(?:Ann\.?)?\s*§?\s*", "§ "),),
    "US": ((r"\d+\s+U\.S\.C\.?\s*§\s*", "§ "),),
}
CITED_ANYWHERE = ((r"^(?:Sec(?:tion)?|Sec\.)\s+", "§ "), (r"^Subsection\s+", "§ "), (r"&#167;|&sect;", "§ "), (r"\s{2,}", " "))
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "puerto rico": "PR",
}
#: Titles that tell a state's statutes, over lower-case text; each counts three times.
STATE_TITLES = {
    "CT": r"(?:connecticut general statutes|conn\.?\s*gen\.?\s*stat|§\s*13b-116)",
    "NY": r"(?:new york .{0,30} law|n\.?y\.?\s+[a-z]\.?\s+law)",
    "SC": r"(?:south carolina code|s\.?c\.?\s+code\s+ann|§\s*40-57)",
    "CO": r"(?:colorado revised statutes|c\.?r\.?s\.?\s+§)",
    "CA": r"(?:california civil code|cal\.?\s+civ\.?\s+code|ccpa)",
}
TITLE_WEIGHT, SIGNAL_LEAST = 3, 2
PLACEHOLDER, WRAPPER = "TMP-", "https://r.jina.ai/"
GOVERNMENT, PERSON = ("regulator", "government_agency"), "individual"


def normal_citation(c: Column, jurisdiction: Column) -> Column:
    """A citation as the sign of a section and its number, as section paths have it; empty for none."""
    swap = lambda x, rule: F.regexp_replace(x, "(?i)" + any_script(rule[0]), rule[1].replace("{1}", "$1"))
    code = F.upper(F.coalesce(jurisdiction, F.lit("")))
    bare = strip(F.coalesce(c, F.lit("")))
    own = _first([(code == k, reduce(swap, rules, bare)) for k, rules in CITED.items()], bare)
    return strip(reduce(swap, CITED_ANYWHERE, own))


def normal_citation_sql(c: str, jurisdiction: str) -> str:
    swap = lambda x, rule: f"regexp_replace({x}, '{any_script(rule[0])}', '{rule[1].replace('{1}', chr(92) + '1')}', 'gi')"
    bare = strip_sql(f"coalesce({c}, '')")
    own = f"CASE upper(coalesce({jurisdiction}, '')) {' '.join(f'''WHEN '{k}' THEN {reduce(swap, rules, bare)}''' for k, rules in CITED.items())} ELSE {bare} END"
    return strip_sql(reduce(swap, CITED_ANYWHERE, own))


#: What a citation may begin with instead of the word: a fixed value.
SECTION_SIGN = r"^(section|sec\.?|§|&#167;)\s*"


def plain_citation(c: Column) -> Column:
    """A citation in lower case, with the word for its sign and single spaces."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), any_script(SECTION_SIGN), "section "), WHITE, " ")


def state_code(c: Column) -> Column:
    """The code that a text is, or that belongs to the name that it is, or to the first name that it holds; empty for none."""
    bare = strip(c)
    codes = F.upper(bare).isin(*STATES.values())
    held = _first([(F.contains(F.lower(bare), F.lit(name)), F.lit(code)) for name, code in STATES.items()], F.lit(""))
    return F.when((F.length(bare) == 2) & codes, F.upper(bare)).otherwise(F.coalesce(_first([(F.lower(bare) == name, F.lit(code)) for name, code in STATES.items()], F.lit(None)), held))


def state_code_sql(c: str) -> str:
    bare = strip_sql(c)
    cases = [f"WHEN length({bare}) = 2 AND upper({bare}) IN ({', '.join(f'{chr(39)}{x}{chr(39)}' for x in STATES.values())}) THEN upper({bare})"]
    cases += [f"WHEN lower({bare}) = '{n}' THEN '{x}'" for n, x in STATES.items()] + [f"WHEN contains(lower({c}), '{n}') THEN '{x}'" for n, x in STATES.items()]
    return f"CASE {' '.join(cases)} ELSE '' END"


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit(PLACEHOLDER)), F.lit(False))


def placeholder_name(c: Column, bill: Column, jurisdiction: Column) -> Column:
    """What a placeholder id may be called until its own is known: jurisdiction and bill, or the bill; null for other ids."""
    number, place = F.nullif(strip(bill), F.lit("")), F.nullif(F.upper(jurisdiction), F.lit(""))
    return F.when(is_placeholder(c), F.coalesce(F.concat(place, F.lit(" "), number), number))


def source_url(c: Column) -> Column:
    """Without the address of a proxy before it."""
    return F.when(F.startswith(c, F.lit(WRAPPER)), F.substring(c, len(WRAPPER) + 1, 1 << 20)).otherwise(c)


def actor_role(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(None)).when(code.isin(*GOVERNMENT), "government").when(code == PERSON, "individual").otherwise("regulated_entity")
