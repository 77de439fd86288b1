"""The domain's word lists and crosswalks as plain values; each can be replaced by rows of a CSV file (inventory 2.9.22, 2.9.23, 2.9.52,
2.9.54, 2.9.55)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import any_script, strip

# Words that make a passage relevant wherever they occur in it, whatever their case.
KEYWORDS = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "generative ai", "generative artificial intelligence",
    "large language model", "foundation model", "algorithmic", "algorithm", "automated decision", "automated decision-making",
    "automated decision making", "automated employment decision", "automated system", "autonomous system", "predictive analytics",
    "predictive model", "natural language processing", "computer vision", "facial recognition", "biometric", "high-risk ai", "high risk ai",
    "ai system", "ai governance", "ai audit", "ai impact assessment", "algorithmic impact assessment", "algorithmic accountability",
    "algorithmic discrimination", "algorithmic bias", "ai transparency", "ai deployer", "ai developer", "deployer", "automated final decision",
    "consequential decision", "deepfake", "deep fake", "synthetic media", "synthetic content", "digital replica", "synthetic performer",
    "ai-generated", "ai generated", "automated profiling", "algorithmic profiling", "profiling system", "automated risk assessment",
    "automated risk scoring", "score-based decision", "social scoring", "companion chatbot", "ai companion", "conversational ai",
    "algorithmic pricing", "surveillance pricing", "price optimization algorithm", "artificial intelligence act", "ai bill of rights",
)
# Patterns that do so too, one hit for both.
KEY_PATTERNS = (r"\b(?:a\.?i\.?)\s+(?:system|model|tool|application|technology)", r"\bautomat(?:ed|ic)\s+(?:decision|system|process|tool)")
# Words of a law's summaries that are asked for in its passages.
REQUIREMENT_WORDS = (
    "deployer", "deployers", "developer", "developers", "audit", "audits", "assessment", "assessments", "transparency", "disclosure", "notice",
    "consent", "discrimination", "bias", "fairness", "accountability", "profiling", "surveillance", "biometric", "biometrics", "automated",
    "algorithmic", "algorithm",
)
ENFORCEMENT_WORDS = ("penalty", "penalties", "fine", "fines", "violation", "enforcement", "attorney", "commissioner", "injunction", "damages", "liability", "compliance")
TOPIC_LEAST = 3
# Terms of an action and the family they name, in the order of their file; of several the longest decides.
FAMILY_TERMS = (
    ("disclosure", "disclosure_to_user"), ("impact_assessment", "impact_assessment"), ("notification", "labeling_watermarking"),
    ("record_keeping", "record_keeping"), ("reporting", "reporting_to_regulator"), ("registration", "registration"), ("bias_audit", "bias_testing"),
    ("certification", "certification"), ("assessment", "impact_assessment"), ("third_party_audit", "third_party_audit"),
    ("self_certification", "certification"), ("bias_audit (audit_type)", "bias_testing"), ("risk_assessment", "impact_assessment"),
    ("program and documentation", "documentation"), ("assessments", "impact_assessment"), ("training", "training_mandate"),
    ("responsible individual", "human_review"), ("general notice", "disclosure_to_user"), ("labeling/notification", "labeling_watermarking"),
    ("explanation/incident reporting", "incident_reporting"), ("developer documentation", "documentation"), ("registration", "registration"),
    ("third-party review", "third_party_audit"), ("opt out/appeal", "opt_out_right"), ("nondiscrimination", "prohibition"),
    ("prohibited (modality)", "prohibition"),
)
NO_FAMILY = "obligation_general"
# The coarser type of a family; none for those that name no type.
FAMILY_TYPES = {
    "documentation": "documentation", "registration": "registration", "impact_assessment": "assessment", "bias_testing": "assessment",
    "red_teaming": "risk_management", "third_party_audit": "assessment", "incident_reporting": "reporting", "record_keeping": "retention",
    "disclosure_to_user": "disclosure", "labeling_watermarking": "disclosure", "human_review": "human_oversight", "opt_out_right": "opt_out",
    "explanation_right": "disclosure", "training_mandate": "training", "certification": "documentation", "reporting_to_regulator": "reporting",
    "prohibition": "prohibition", "consent_mechanism": "consent", "data_governance": "data_governance", "security_measures": "risk_management",
    "risk_management": "risk_management",
}
# The role of an actor's code, and words of the raw term that say a finer role, in the order of their file.
ACTOR_ROLES = {
    "developer": "developer", "provider": "provider", "deployer": "deployer", "operator": "deployer", "distributor": "provider",
    "compute_provider": "provider", "controller": "deployer", "processor": "provider", "data_broker": "deployer",
    "government_agency": "government_agency", "regulated_entity": "deployer",
}
ROLE_TERMS = (("employer", "employer"), ("vendor", "vendor"), ("integrator", "integrator"), ("system integrator", "integrator"))
NO_ACTOR_CODE = "regulated_entity"


def key_pattern(text: Column) -> Column:
    """Whether one of the patterns is in a text."""
    return text.rlike("(?i)" + "|".join(f"(?:{any_script(p)})" for p in KEY_PATTERNS))


def law_terms(topics: Column, requirements: Column, enforcement: Column) -> Column:
    """The terms to ask for in a law's passages: its topics (a list of texts, each parted by commas, semicolons and slashes) of
    three characters or more, and those words of its summaries that the lists know. Each once, in no order."""
    words = lambda c, known: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)), lambda w: w.isin(*known))
    parts = F.flatten(F.transform(F.array_compact(topics), lambda t: F.split(t, "[;,/]")))
    own = F.filter(F.transform(parts, lambda t: F.lower(strip(t))), lambda t: F.length(t) >= TOPIC_LEAST)
    return F.array_distinct(F.concat(own, words(requirements, REQUIREMENT_WORDS), words(enforcement, ENFORCEMENT_WORDS)))


def crosswalk(code: Column, table: dict[str, str]) -> Column:
    """What a code becomes; null for codes that the table lacks."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code]
