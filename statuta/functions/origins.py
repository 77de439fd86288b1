"""Which state a law is of, by its title and address, and what kind of address it has (inventory 2.9.59, 2.9.60)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .citations import STATES
from .rules import _first
from .text import strip, strip_sql

# Parts of addresses and the state they belong to; the first that an address holds decides.
SITES = {
    "alison.legislature.state.al.us": "alabama", "azleg.gov": "arizona", "arkleg.state.ar.us": "arkansas", "leginfo.legislature.ca.gov": "california",
    "cppa.ca.gov": "california", "calcivilrights.ca.gov": "california", "leg.colorado.gov": "colorado", "cga.ct.gov": "connecticut",
    "delcode.delaware.gov": "delaware", "flrules.org": "florida", "myfloridahouse.gov": "florida", "capitol.hawaii.gov": "hawaii",
    "data.capitol.hawaii.gov": "hawaii", "legislature.idaho.gov": "idaho", "ilga.gov": "illinois", "legis.iowa.gov": "iowa",
    "kslegislature.gov": "kansas", "apps.legislature.ky.gov": "kentucky", "legis.la.gov": "louisiana", "legislature.maine.gov": "maine",
    "mgaleg.maryland.gov": "maryland", "malegislature.gov": "massachusetts", "legislature.mi.gov": "michigan", "revisor.mn.gov": "minnesota",
    "billstatus.ls.state.ms.us": "mississippi", "revisor.mo.gov": "missouri", "docs.legmt.gov": "montana", "bills.legmt.gov": "montana",
    "nebraskalegislature.gov": "nebraska", "leg.state.nv.us": "nevada", "gc.nh.gov": "new hampshire", "legiscan.com/NH": "new hampshire",
    "njoag.gov": "new jersey", "nmlegis.gov": "new mexico", "nysenate.gov": "new york", "ndlegis.gov": "north dakota",
    "oklegislature.gov": "oklahoma", "olis.oregonlegislature.gov": "oregon", "legis.state.pa.us": "pennsylvania", "status.rilegislature.gov": "rhode island",
    "scstatehouse.gov": "south carolina", "mylrc.sdlegislature.gov": "south dakota", "capitol.tn.gov": "tennessee", "capitol.texas.gov": "texas",
    "le.utah.gov": "utah", "legislature.vermont.gov": "vermont", "lis.virginia.gov": "virginia", "legacylis.virginia.gov": "virginia",
    "law.lis.virginia.gov": "virginia", "lis.blob.core.windows.net": "virginia", "lawfilesext.leg.wa.gov": "washington", "app.leg.wa.gov": "washington",
    "wvlegislature.gov": "west virginia", "docs.legis.wisconsin.gov": "wisconsin",
}
# How titles cite a state's statutes; the first that a title holds decides.
STATUTES = {
    r"C\.R\.S\.": "colorado", r"Conn\. Gen\. Stat": "connecticut", r"Del\. Code": "delaware", r"Ga\. Code": "georgia", r"Ind\. Code": "indiana",
    r"Iowa Code": "iowa", r"KRS\b": "kentucky", r"La\. Rev\. Stat": "louisiana", r"MRSA\b": "maine", r"Md\. Code": "maryland", r"Minn\. Stat": "minnesota",
    r"R\.S\.Mo": "missouri", r"MCA\b": "montana", r"Nev\. Rev\. Stat": "nevada", r"N\.H\. Rev\. Stat": "new hampshire", r"N\.J\.": "new jersey",
    r"N\.M\. Stat": "new mexico", r"N\.Y\.": "new york", r"N\.D\. Cent\. Code": "north dakota", r"Tex\.": "texas", r"Utah Code": "utah",
    r"Va\. Code": "virginia", r"Wash\. Rev\. Code": "washington", r"W\. Va\. Code": "west virginia", r"Wis\. Stat": "wisconsin", r"Wy\. Code": "wyoming",
}
#: What tells the city whose rules count as its state's.
CITY, CITY_STATE = ("nyc", "local law 144"), "new york"
# Parts of addresses that stand for no text, of official ones, and of texts that a tracker keeps.
STUBS = ("orrick.com/ai", "(iapp tracker pdf)", "iapp tracker")
OFFICIAL = (".gov", ".us/", "legislature.", "legis.", "capitol.", "lis.", "leg.", "legiscan.com", "cppa.ca.gov", "njoag.gov", "calcivilrights.ca.gov")
KEPT, KEPT_FILES = "infobytes.orrick.com", "orrick.com"
REFERENCE = "https://ai-law-center.orrick.com"

#: The fifty states by name; longer names are asked first, since some hold others.
FIFTY = {n: c for n, c in STATES.items() if c not in ("DC", "PR")}
_LONGEST_FIRST = sorted(FIFTY, key=len, reverse=True)
NO_WORD = r"[^\p{L}\p{N}_]"


def word_end(pattern: str) -> str:
    """A word's end in any script, in a form that both engines read."""
    return pattern.replace(r"\b", rf"(?:\z|{NO_WORD})")


def _holds_any(low: Column, parts) -> Column:
    held = F.lit(False)
    for p in parts:
        held = held | F.contains(low, F.lit(p))
    return held


def inferred_state(title: Column, url: Column) -> Column:
    """The name of the state that the address belongs to, else that title or address names, else the first of the title's words in
    two capitals that is a state's code, else the state whose statutes the title cites; null for none. Null texts count as empty."""
    title, url = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    low, both = F.lower(url), F.lower(F.concat(title, F.lit(" "), url))
    codes = F.filter(F.split(title, f"{NO_WORD}+"), lambda w: w.isin(*FIFTY.values()))
    by_code = F.create_map(*[F.lit(x) for n, c in FIFTY.items() for x in (c, n)])
    nothing = F.lit(None).cast("string")
    return F.coalesce(
        _first([(F.contains(low, F.lit(part.lower())), F.lit(state)) for part, state in SITES.items()], nothing),
        _first([(F.contains(both, F.lit(name)), F.lit(name)) for name in _LONGEST_FIRST], nothing),
        F.try_element_at(by_code, F.get(codes, 0)),
        _first([(F.regexp_like(title, F.lit(word_end(p))), F.lit(state)) for p, state in STATUTES.items()], nothing),
        F.when(_holds_any(both, CITY), CITY_STATE),
    )


def url_class(url: Column) -> Column:
    """stub, official, kept (a tracker's copy of the text), other, or none where nothing is an address."""
    bare = strip(F.lower(F.coalesce(url, F.lit(""))))
    kept = F.contains(bare, F.lit(KEPT)) | (F.contains(bare, F.lit(KEPT_FILES)) & F.endswith(bare, F.lit(".pdf")))
    return F.when(_holds_any(bare, STUBS), "stub").when(_holds_any(bare, OFFICIAL), "official").when(kept, "kept").when(F.contains(bare, F.lit("http")), "other").otherwise("none")


def primary_url(url: Column) -> Column:
    """The address of the law's own text; null for stubs and for what is no address, so that a text is still to be looked for."""
    return F.when(~url_class(url).isin("stub", "none"), strip(url))


def reference_url(state: Column) -> Column:
    """The reference's page about a state; null without one."""
    return F.concat(F.lit(REFERENCE + "/"), F.replace(F.lower(state), F.lit(" "), F.lit("-")), F.lit("/"))


def inferred_state_sql(key: str, rows: str) -> str:
    """The same as a query over `rows` (key, title, url), by lists that are joined and ranked: key, state."""
    listed = lambda pairs: ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    return f"""SELECT {key}, arg_min(state, (tier, place)) AS state FROM (
SELECT {key}, 1 AS tier, place, state FROM {rows}, (VALUES {listed((p.lower(), s) for p, s in SITES.items())}) s(place, part, state) WHERE contains(lower(url), part)
UNION ALL SELECT {key}, 2, place, state FROM {rows}, (VALUES {listed((n, n) for n in _LONGEST_FIRST)}) s(place, part, state) WHERE contains(lower(title || ' ' || url), part)
UNION ALL SELECT {key}, 3, list_position(string_split_regex(title, '{NO_WORD}+'), code), state FROM {rows}, (VALUES {listed((c, n) for n, c in FIFTY.items())}) s(place, code, state) WHERE list_contains(string_split_regex(title, '{NO_WORD}+'), code)
UNION ALL SELECT {key}, 4, place, state FROM {rows}, (VALUES {listed((word_end(p), s) for p, s in STATUTES.items())}) s(place, part, state) WHERE regexp_matches(title, part)
UNION ALL SELECT {key}, 5, 0, '{CITY_STATE}' FROM {rows} WHERE regexp_matches(lower(title || ' ' || url), '{'|'.join(CITY)}')) GROUP BY 1"""


def url_class_sql(url: str) -> str:
    bare = strip_sql(f"lower(coalesce({url}, ''))")
    held = lambda parts: " OR ".join(f"contains({bare}, '{p}')" for p in parts)
    return f"CASE WHEN {held(STUBS)} THEN 'stub' WHEN {held(OFFICIAL)} THEN 'official' WHEN contains({bare}, '{KEPT}') OR (contains({bare}, '{KEPT_FILES}') AND ends_with({bare}, '.pdf')) THEN 'kept' WHEN contains({bare}, 'http') THEN 'other' ELSE 'none' END"
