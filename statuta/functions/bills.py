"""Which passages of a bill define, set its scope or enforce it, and what of a bill a reader gets (inventory 2.9.34, 2.9.36, 2.9.40,
2.9.49, 2.9.51, 2.9.62)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import any_script, strip

# Patterns over a passage's lower-case opening, and over its section path.
OPENING = 500
DEFINES = r"\b(?:definition[s]?|as used in this (?:section|chapter|act|article|title|part)|for (?:the )?purpose[s]? of this (?:section|chapter|act|article|title|part)|the following terms (?:shall )?have the (?:following )?meaning|(?:shall |the term |as used herein[,]? )[\"“].+?[\"”] means)"
SCOPE = r"\b(?:scope|applicab(?:ility|le)|purpose[s]? (?:and scope|of this)|this (?:act|chapter|article|section|title|part) (?:shall )?appl(?:y|ies)|(?:shall|does) not apply|(?:are |is |be )?exempt(?:ion[s]?|ed)?|short title|legislative (?:findings?|intent|purpose)|findings? and (?:purpose|declaration))"
ENFORCES = r"\b(?:penalt(?:y|ies)|civil (?:penalty|action|fine|liability|remedy|remedies)|criminal (?:penalty|penalties|offense)|enforcement|violation[s]?|liable? (?:for|to)|fine[s]? (?:of|not to exceed|up to)|right of action|private right|attorney general|cause[s]? of action|injunctive relief|cure period|notice and cure)"
DEFINES_PATH, SCOPE_PATH, ENFORCES_PATH = r"definition|meaning|interpretation|term[s]?", r"scope|applicab|purpose|finding|intent|short.title|exempt", r"penalt|enforc|violation|remedy|remedies|sanction|fine|liability|action"
KINDS = {"definitions": (DEFINES, DEFINES_PATH, 30_000), "scope": (SCOPE, SCOPE_PATH, 20_000), "enforcement": (ENFORCES, ENFORCES_PATH, 10_000)}
# What parts passages, what it takes of the budget, marks of what was left out, the outline's budget, and quoted
# terms that are defined.
BETWEEN, JOINT, CUT, LEFT_OUT = "\n---\n", 4, " [...]", "[... truncated ...]"
OUTLINE, OUTLINE_CUT = 5_000, "  ..."
TERM = r"[\"“]([^\"”]{2,80})[\"”]\s+(?:means?|refers? to|shall mean|is defined as|has the meaning)"
NO_ACTORS = (
    "contract", "document", "website", "program", "operat", "socia", "legal_claim", "procurement_process", "request", "report", "content",
    "legislative provision", "software_tool", "distribution_platform", "automated decision-making system",
)
PENALTY_LABELS = {
    "civil_penalty": "Civil penalty", "criminal_penalty": "Criminal penalty", "private_right_of_action": "Private right of action", "ag_enforcement": "AG enforcement",
    "regulatory_enforcement": "Regulatory enforcement", "administrative_action": "Administrative action", "injunctive_relief": "Injunctive relief", "restitution": "Restitution / disgorgement",
}


def is_kind(kind: str, text: Column, path: Column) -> Column:
    """By the path of the passage's section or by its first OPENING characters, as the reference has it."""
    words, places, _ = KINDS[kind]
    return F.lower(F.coalesce(path, F.lit(""))).rlike(places) | F.lower(F.substring(F.coalesce(text, F.lit("")), 1, OPENING)).rlike(words)


def _upto(rows: DataFrame, bill: str, order: str, size: Column) -> DataFrame:
    """Rows with `_upto`, the sizes of the bill's rows up to this one. The window sorts narrow rows; texts are not among them."""
    before = Window.partitionBy(bill).orderBy(order, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_size", size).withColumn("_upto", F.sum("_size").over(before)).withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(bill)))


def _in_order(c: str, order: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "_row", F.col(c).alias("t")))), lambda x: x["t"])


def bill_context(passages: DataFrame, bill: str, order: str, text: str, path: str) -> DataFrame:
    """One row a bill: definitions, scope, enforcement (passages that define are no part of it), structure (the outline of its
    section paths), defined_terms (each once, in order), and how many passages there are of each kind.

    Passages are stripped, blank ones left out, and joined in order while each fits the budget with four characters for what
    parts it from the next. Of a first passage above the budget its head stays, marked " [...]"; where passages are left out,
    a mark stands for them. Passages of equal order follow by a hash of their text."""
    rows = passages.select(bill, F.col(order).alias("_order"), F.coalesce(path, F.lit("")).alias("_path"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.select("*", F.xxhash64("_text", "_path").alias("_row"), strip(F.col("_text")).alias("_bare"), *[is_kind(k, F.col("_text"), F.col("_path")).alias(f"_{k}") for k in KINDS])
    rows = rows.withColumn("_enforcement", F.col("_enforcement") & ~F.col("_definitions"))
    counts = [F.count_if(f"_{k}").alias(f"{k}_passages") for k in KINDS]
    out = rows.groupBy(bill).agg(*counts, F.count(F.lit(1)).alias("total_passages"))
    for kind, (_, _, budget) in KINDS.items():
        own = rows.filter(F.col(f"_{kind}") & (F.col("_bare") != ""))
        narrow = _upto(own.select(bill, "_order", "_row", F.length("_bare").alias("_n")), bill, "_order", F.col("_n") + JOINT)
        kept = narrow.filter((F.col("_upto") <= budget) | (F.col("_upto") == F.col("_size"))).distinct()
        texts = kept.join(own.select(bill, "_order", "_row", "_bare").distinct(), [bill, "_order", "_row"])
        cut = F.when(F.col("_upto") > budget, F.concat(F.substring("_bare", 1, budget - JOINT), F.lit(CUT))).otherwise(F.col("_bare"))
        parts = texts.withColumn("_part", cut).groupBy(bill).agg(_in_order("_part", "_order").alias("_parts"), F.max(F.col("_upto") > budget).alias("_cut"), F.max("_total").alias("_total"))
        joined = F.array_join(F.when(F.col("_cut") | (F.size("_parts") == F.col("_total")), F.col("_parts")).otherwise(F.array_append("_parts", F.lit(LEFT_OUT))), BETWEEN)
        out = out.join(parts.select(bill, joined.alias(kind)), bill, "left").withColumn(kind, F.coalesce(kind, F.lit("")))
    lines = rows.filter("_path <> ''").select(bill, "_order", "_row", F.concat(F.lit("  "), F.col("_path")).alias("_line"))
    lines = _upto(lines, bill, "_order", F.length("_line") + 1)
    outline = lines.groupBy(bill).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_upto") <= OUTLINE, F.struct(F.col("_order").alias("o"), "_row", F.col("_line").alias("t"))))), lambda x: x["t"]).alias("_lines"), F.max("_total").alias("_total"))
    told = F.array_join(F.when(F.size("_lines") == F.col("_total"), F.col("_lines")).otherwise(F.array_append("_lines", F.lit(OUTLINE_CUT))), "\n")
    found = F.transform(F.regexp_extract_all("_text", F.lit(any_script(TERM)), F.lit(1)), strip)
    terms = rows.filter("_definitions").select(bill, "_order", "_row", F.posexplode(found).alias("_at", "_term"))
    terms = terms.groupBy(bill, F.lower("_term")).agg(F.min(F.struct("_order", "_row", "_at", "_term")).alias("_first"))
    terms = terms.groupBy(bill).agg(F.transform(F.sort_array(F.collect_list("_first")), lambda x: x["_term"]).alias("defined_terms"))
    out = out.join(outline.select(bill, told.alias("structure")), bill, "left").join(terms, bill, "left")
    return out.withColumn("structure", F.coalesce("structure", F.lit(""))).withColumn("defined_terms", F.coalesce("defined_terms", F.array().cast("array<string>")))


def bill_excerpt(text: Column, matched: Column, window: int) -> Column:
    """The whole text if two windows hold it, else its matched sections, its head and its tail."""
    head, tail = F.substring(text, 1, window), F.right(text, F.lit(window))
    found = F.when(F.coalesce(matched, F.lit("")) != "", F.concat(F.lit("MATCHED SECTIONS:\n"), matched, F.lit("\n\n"))).otherwise("")
    return F.when(F.length(text) <= 2 * window, text).otherwise(F.concat(found, F.lit("OPENING OF BILL:\n"), head, F.lit("\n\nEND OF BILL:\n"), tail))


def clean_actor(c: Column) -> Column:
    """An actor's name, null where it names none or is garbled: very short, or with runs of white space."""
    bare = strip(c)
    return F.when((bare != "") & (F.length(bare) > 3) & ~F.lower(bare).isin(*NO_ACTORS) & ~bare.rlike(r"\s{2,}|\t"), bare)


def reconciled_actor(raw: Column, named: Column, raw_code: Column, named_code: Column) -> Column:
    """The named actor if the raw words hold it or both have one code in the alias table, else the code of the raw words; the codes are
    joined in by the caller, null where the table lacks a name."""
    clean, said = clean_actor(named), F.coalesce(strip(raw), F.lit(""))
    holds = F.contains(F.lower(said), F.lower(clean)) | (raw_code == F.coalesce(named_code, F.lower(clean)))
    return F.when(said == "", clean).when(clean.isNotNull() & F.coalesce(holds, F.lit(False)), clean).otherwise(raw_code)


def penalty_label(code: Column) -> Column:
    """A code in words; unknown ones pass as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTY_LABELS.items() for x in kv])[code], code)
