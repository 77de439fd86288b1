"""Text functions as Column expressions (inventory 2.9)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Curly quotes, dashes and hard spaces, and what they become; a soft hyphen goes. The wider table, for answers
# of models, knows more dashes, quotes and spaces, and leaves soft hyphens.
FOLD = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " ", "\u00ad": ""}
WIDE_FOLD = {
    "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201a": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00a0": " ", "\u202f": " ", "\u2009": " ",
}
#: Both tables at once: what the first one gives, the second one leaves.
BOTH_FOLDS = WIDE_FOLD | FOLD
LOOSE_LEAST, STRIPPED_LEAST = 15, 25
#: White space of any script, in a form that both engines read.
WHITE_SIGNS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE = f"[{WHITE_SIGNS}]+"
#: Runs of white space that are not one plain space already: what collapsing has to change. Few places of a text, where WHITE is at
#: every word.
UNEVEN = f" *[{WHITE_SIGNS.replace('-' + chr(92) + 'x20', '-' + chr(92) + 'x1F')}][{WHITE_SIGNS}]*| {{2,}}"
UNEVEN_SIGNS = r" *[^\p{L}\p{N} ][^\p{L}\p{N}]*| {2,}"
# Words that mark statutes, and phrases that mark the frame of a web page.
LEGAL_MARKERS = (
    "section", "whereas", "enacted", "shall", "provided", "pursuant", "herein", "thereof", "notwithstanding", "jurisdiction",
    "obligation", "penalty", "enforcement", "compliance", "regulation", "statute", "subsection", "paragraph", "§",
)
PAGE_CHROME = (
    "skip to content", "quick search", "bill number", "bill keyword", "bill information", "bill search", "my subscriptions",
    "my favorites", "accessibility", "table of contents", "site map", "privacy policy", "terms of use", "cookie policy", "log in",
    "sign in", "sign up", "register now", "subscribe", "newsletter", "follow us", "share this", "print this page", "back to top",
    "copyright ©", "all rights reserved",
)
# Words of three letters or more that say nothing about likeness.
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "shall", "must", "may", "not", "any", "all", "such", "from", "under", "upon", "into",
    "each", "but", "are", "has", "have", "been", "will", "who", "which", "than", "its", "also", "other", "more", "when", "where", "does",
    "can", "would", "should", "could", "about", "their", "them", "they", "what", "section", "subsection", "paragraph", "provision",
)


def _letters(table: dict[str, str]) -> tuple[str, str]:
    """The two arguments of translate: letters without a counterpart, which go, come last."""
    kept = [k for k in table if table[k]]
    return "".join(kept + [k for k in table if not table[k]]), "".join(table[k] for k in kept)


def fold(c: Column, table: dict[str, str] = FOLD) -> Column:
    return F.translate(c, *_letters(table))


def fold_sql(c: str, table: dict[str, str] = FOLD) -> str:
    few, become = _letters(table)
    return "translate({}, '{}', '{}')".format(c, few.replace("'", "''"), become.replace("'", "''"))


def bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def any_script(pattern: str) -> str:
    """A pattern whose white space, word signs and digits are those of any script, in a form that both engines read."""
    signs, out, inside, at = {"s": WHITE_SIGNS, "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}, [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[:1] == "\\":
            found = signs.get(two[1:])
            out.append(two if found is None else found if inside else f"[{found}]")
            at += 2
            continue
        inside = two[:1] == "[" or (inside and two[:1] != "]")
        out.append(two[:1])
        at += 1
    return "".join(out)


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"^{WHITE}|{WHITE}\z", "")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{WHITE}|{WHITE}\z', '', 'g')"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN, " "))


def loose(c: Column) -> Column:
    """Lower-case letters and digits, with single spaces between runs of them."""
    return F.trim(F.regexp_replace(F.lower(c), UNEVEN_SIGNS, " "))


def tokens(c: Column, least: int = 3, stop: Sequence[str] = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# A word parted at the end of a line, numbers in the margin, and a glyph that was read as a letter.
HYPHEN_BREAK, MARGIN_NUMBER, SECTION_GLYPH = r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", r"(^|\n)[ \t]*[0-9]{1,4}(?:\.[0-9]{1,3})?[ \t]+", r"(?i)\b(SECTION)[A-Z]([0-9])"


def unprinted(c: Column) -> Column:
    """Without the traces of a printed page. Lines must still be there, so this goes before `collapse`."""
    whole = F.regexp_replace(F.regexp_replace(c, HYPHEN_BREAK, "$1$2"), MARGIN_NUMBER, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(whole, SECTION_GLYPH, "$1 $2"), "[ \t]{2,}", " "))


def span_tier(passage: Column, span: Column) -> Column:
    """1 exact, 2 but for case, 3 loosely (15 characters or more), 4 loosely without traces of print (25 or more), null: not found.

    Passage and span are folded by both tables. A span that is in the passage as it stands is in it folded too, so most spans need
    no other form; further forms are worked out once each, and those of a later tier only for spans that no earlier one has found."""
    both = lambda c: fold(c, BOTH_FOLDS)
    pair = lambda f, x: F.struct(f(x["t"]).alias("t"), f(x["q"]).alias("q"))
    found = lambda x: F.contains(x["t"], x["q"])
    raw = F.when(F.contains(passage, span) & (strip(both(span)) != ""), 1)

    def folded(x: Column) -> Column:
        last = bound(pair(lambda c: loose(unprinted(c)), x), lambda y: F.when((F.length(y["q"]) >= STRIPPED_LEAST) & found(y), 4))
        third = bound(pair(loose, x), lambda y: F.when((F.length(y["q"]) >= LOOSE_LEAST) & found(y), 3))
        first = bound(pair(collapse, x), lambda y: F.when(F.length(y["q"]) == 0, 0).when(found(y), 1).when(F.contains(F.lower(y["t"]), F.lower(y["q"])), 2))
        return F.coalesce(first, third, last)

    return F.nullif(F.coalesce(raw, bound(F.struct(both(passage).alias("t"), both(span).alias("q")), folded)), F.lit(0))


def phrases_in(c: Column, phrases: Sequence[str]) -> Column:
    """Those of the given lower-case phrases that the text holds, in order."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def any_word(words: Sequence[str]) -> str:
    """A pattern that matches any of the words, in lower case."""
    return rf"\b(?:{'|'.join(words)})\b"


# Share of replacement characters, and markers in 1000 characters, that settle a text's quality.
BROKEN_MOST, MARKERS_ENOUGH = 0.05, 5.0


def parse_quality(c: Column, markers: str) -> Column:
    """0.6 for text free of replacement characters, 0.4 for markers; nothing for an empty text."""
    n = F.length(c).cast("double")
    broken = (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / n
    density = F.regexp_count(F.lower(c), F.lit(markers)) / n * 1000
    whole = F.greatest(F.lit(0.0), 1 - broken / BROKEN_MOST) * 0.6 + F.least(F.lit(1.0), density / MARKERS_ENOUGH) * 0.4
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0.0).otherwise(F.floor(whole * 10000 + 0.5) / 10000)


# Patterns of references, from the closest to the loosest.
SUBDIVIDED, NESTED = r"§\s*[A-Za-z0-9_-]+(?:\.[0-9]+)*\s*[(\[]", r"(?i)\(\s*[0-9]+\s*\)\s*\(\s*[a-z]\s*\)"
NUMBERED, NAMED = r"(?i)\b[0-9]{1,4}[a-z]?(?:\.[0-9]+)+\b", r"(?i)\b(?:section|part|article|subsection|paragraph)\b"


def section_specificity(c: Column) -> Column:
    """How closely a reference names its place: with subdivision, section, part, anything, nothing."""
    return (
        F.when(c.isNull() | (collapse(c) == ""), 0.0)
        .when(c.rlike(SUBDIVIDED) | c.rlike(NESTED), 1.0)
        .when(F.contains(c, F.lit("§")) | c.rlike(NUMBERED), 0.6)
        .when(c.rlike(NAMED), 0.3)
        .otherwise(0.2)
    )


def excerpt(c: Column, budget: int, tail: int) -> Column:
    """The whole text if it fits, else its head and its tail."""
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.substring(c, 1, budget - tail), F.lit(" [...] "), F.right(c, F.lit(tail))))


def content_key(c: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def cascade(quality: Column, chrome: Column, hits: Column) -> Column:
    """struct(decision, method, confidence): poor text, site chrome, keywords, else uncertain."""
    made = lambda d, m, x: F.struct(F.lit(d).alias("decision"), F.lit(m).alias("method"), x.alias("confidence"))
    return (
        F.when(quality < 0.3, made("reject", "quality", F.lit(0.9)))
        .when(chrome >= 3, made("reject", "chrome", F.lit(0.95)))
        .when(hits > 0, made("accept", "keyword", F.round(F.least(F.lit(0.95), 0.7 + 0.05 * hits), 4)))
        .otherwise(made("uncertain", "none", F.lit(0.5)))
    )
