"""Vocabularies and mappings that results depend on."""

from __future__ import annotations

# The eight biological operations.
OPERATIONS = (
    "Reception", "Transduction", "Conduction", "Regulation",
    "Synthesis", "Defense", "Restoration", "Elimination",
)

# Predicate types and the direction each one implies.
CAUSAL_TYPES = ("activates", "inhibits", "upregulates", "downregulates", "induces", "blocks", "rescues")
MECHANISTIC_TYPES = ("is_upstream_of", "is_downstream_of", "requires", "compensates_for")
ASSOCIATIVE_TYPES = ("correlates_with", "is_biomarker_for", "predicts")
PREDICATE_TYPES = CAUSAL_TYPES + MECHANISTIC_TYPES + ASSOCIATIVE_TYPES

# Predicate type of each raw verb; every other verb is an association.
VERB_TYPES = {
    "activates": "activates",
    "releases": "activates",
    "recruits": "activates",
    "stabilizes": "activates",
    "promotes": "activates",
    "enables": "activates",
    "transcribes": "activates",
    "translates": "activates",
    "phosphorylates": "activates",
    "upregulates": "upregulates",
    "increases": "upregulates",
    "enhances": "upregulates",
    "induces": "induces",
    "triggers": "induces",
    "causes": "induces",
    "produces": "induces",
    "inhibits": "inhibits",
    "disrupts": "inhibits",
    "impairs": "inhibits",
    "damages": "inhibits",
    "suppresses": "inhibits",
    "sequesters": "inhibits",
    "degrades": "inhibits",
    "cleaves": "inhibits",
    "blocks": "blocks",
    "downregulates": "downregulates",
    "reduces": "downregulates",
    "decreases": "downregulates",
    "ubiquitinates": "downregulates",
    "rescues": "rescues",
    "restores": "rescues",
    "compensates_for": "compensates_for",
    "compensates": "compensates_for",
    "is_biomarker_for": "is_biomarker_for",
    "predicts": "predicts",
    "requires": "requires",
    "depends_on": "requires",
    "is_upstream_of": "is_upstream_of",
    "is_downstream_of": "is_downstream_of",
}
DEFAULT_PREDICATE_TYPE = "correlates_with"

# Pathway edge type -> predicate type, and edge types that are causal / mechanistic.
PATHWAY_PREDICATES = {
    "activates": "activates", "inhibits": "inhibits", "upregulates": "upregulates",
    "downregulates": "downregulates", "induces": "induces", "blocks": "blocks",
    "rescues": "rescues", "requires": "requires", "converts_to": "is_upstream_of",
    "transports": "requires", "secretes": "is_upstream_of", "binds": "correlates_with",
    "degrades": "inhibits",
}
PATHWAY_CAUSAL = CAUSAL_TYPES
PATHWAY_MECHANISTIC = ("converts_to", "transports", "is_upstream_of", "is_downstream_of", "requires")

# Strings that mean "no value" in extracted fields.
NULL_WORDS = ("null", "none", "n/a", "unknown")

# Context keywords, tested as plain substrings (cell types as suffixes).
DISEASE_WORDS = (
    "disease", "disorder", "syndrome", "cancer", "tumor", "tumour", "carcinoma", "adenoma",
    "diabetes", "diabetic", "alzheimer", "parkinson", "sclerosis", "fibrosis", "ischemia",
    "infarct", "stroke", "sepsis", "hypertension", "atherosclerosis", "nephropathy",
    "retinopathy", "neuropathy", "obesity", "inflammation", "inflammatory", "infection",
    "autoimmune",
)
CELL_SUFFIXES = (
    "cyte", "blast", "cell", "cells", "neuron", "neurons", "macrophage", "lymphocyte",
    "lymphocytes", "hepatocyte", "hepatocytes", "osteoblast", "osteoclast", "fibroblast",
    "myocyte", "astrocyte", "microglia",
)
TISSUE_WORDS = (
    "brain", "liver", "kidney", "heart", "lung", "muscle", "gut", "intestine", "colon",
    "stomach", "bone", "skin", "blood", "tissue", "organ", "adipose", "pancreas", "spleen",
    "thymus", "lymph", "nerve", "retina", "cornea", "vasculature", "artery", "vein",
    "endothelium", "epithelium", "mucosa",
)
CONDITION_WORDS = (
    "stress", "hypoxia", "starvation", "fasting", "exercise", "aging", "aged", "young",
    "pregnancy", "sleep", "wake", "cold", "heat",
)
ORGANISM_WORDS = (
    "human", "mouse", "mice", "rat", "rats", "zebrafish", "c. elegans", "drosophila",
    "primate", "monkey", "pig", "sheep", "dog", "cat",
)

# Study design -> evidence type (key lower case, blanks and hyphens as underscores).
EVIDENCE_TYPES = {
    "rct": "RCT", "randomized_controlled_trial": "RCT", "cohort": "cohort",
    "case_control": "case_control", "in_vitro": "in_vitro", "invitro": "in_vitro",
    "computational": "mechanistic", "animal": "animal", "review": "review",
    "systematic_review": "review", "meta_analysis": "meta_analysis",
    "mechanistic": "mechanistic",
}

# Section-title patterns in the order they are tried.
SECTION_PATTERNS = (
    ("intro", "introduction"),
    ("background", "introduction"),
    ("method|material|protocol|procedure", "methods"),
    ("result", "results"),
    ("finding", "results"),
    ("discussion|interpret", "discussion"),
    ("conclusion|summary|closing", "conclusion"),
    ("abstract", "abstract"),
    ("supplement", "supplementary"),
    ("acknowledge", "acknowledgements"),
    ("reference|bibliograph", "references_section"),
    ("funding|financ", "funding"),
    ("conflict|compet", "conflict_of_interest"),
)

# Study designs and spelling variants of them.
STUDY_DESIGNS = (
    "rct", "cohort", "case_control", "cross_sectional", "meta_analysis", "systematic_review",
    "case_report", "case_series", "in_vitro", "animal", "computational", "review", "editorial",
    "unknown",
)
STUDY_DESIGN_VARIANTS = {
    "randomized controlled trial": "rct", "randomized": "rct",
    "systematic review": "systematic_review", "meta-analysis": "meta_analysis",
    "case-control": "case_control", "case control": "case_control",
    "cross-sectional": "cross_sectional", "in vitro": "in_vitro",
}

# Claim type -> operation, evidence strength -> density of knowledge-base rows.
CLAIM_OPERATIONS = {
    "causal": "Conduction", "mechanistic": "Transduction", "associative": "Reception",
    "null": "Synthesis", "correlative": "Reception", "descriptive": "Synthesis",
}
STRENGTH_DENSITY = {"strong": "body", "moderate": "soul", "weak": "spirit"}
SOURCE_AUTHORITY = 0.55

# USD per million input / output tokens, by model.
TOKEN_PRICES = {
    "claude-opus-4-6": (15.00, 75.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-haiku-4-5-20251001": (0.80, 4.00),
    "claude-3-5-sonnet-20241022": (3.00, 15.00),
    "claude-3-5-haiku-20241022": (0.80, 4.00),
    "claude-3-opus-20240229": (15.00, 75.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "o1": (15.00, 60.00),
    "o1-mini": (3.00, 12.00),
}
DEFAULT_TOKEN_PRICE = (3.00, 15.00)

# Predicate type as a phrase, and the types that count as positive / negative.
PREDICATE_PHRASES = {
    "activates": "activates", "inhibits": "inhibits",
    "upregulates": "upregulates expression of", "downregulates": "downregulates expression of",
    "induces": "induces", "blocks": "blocks", "rescues": "rescues", "requires": "requires",
    "is_upstream_of": "is upstream of", "is_downstream_of": "is downstream of",
    "compensates_for": "compensates for", "correlates_with": "correlates with",
    "is_biomarker_for": "serves as a biomarker for", "predicts": "predicts",
}
POSITIVE_TYPES = ("activates", "upregulates", "induces", "is_upstream_of")
NEGATIVE_TYPES = ("inhibits", "blocks", "downregulates", "is_downstream_of")

# Evidence-strength wording -> epistemic class, in the order tested.
EPISTEMIC_CLASSES = (
    ("strong|high|direct", "fact"),
    ("moderate|medium", "interpretation"),
    ("weak|low|indirect", "hypothesis"),
    ("convergent|replicate", "convergence"),
    ("contradict", "contradiction"),
)

# Preprint categories kept by the category filter.
PREPRINT_CATEGORIES = (
    "biochemistry", "bioinformatics", "biology", "biophysics", "cancer-biology", "cell-biology",
    "developmental-biology", "evolutionary-biology", "genetics", "genomics", "immunology",
    "microbiology", "molecular-biology", "neuroscience", "pharmacology", "physiology",
    "plant-biology", "scientific-communication", "systems-biology", "synthetic-biology",
    "aging", "cardiovascular", "endocrinology", "gastroenterology", "geriatric",
    "infectious-diseases", "metabolism", "neurology", "oncology", "ophthalmology",
    "pediatrics", "psychiatry", "respiratory", "rheumatology",
)

# Bridging thresholds on (confidence, novelty).
THRESHOLD_STANDARD = (0.70, 0.30)
THRESHOLD_HIGH = (0.80, 0.50)
THRESHOLD_SIGNAL = (0.70, 0.75)
THRESHOLD_IMMEDIATE = 0.90

# E-mail address pattern.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# Outreach states, all reported even when empty.
OUTREACH_STATUSES = (
    "pending_draft", "drafted", "gmail_draft_created", "sent", "skipped", "failed",
)

# Pathway node type -> canonical entity type; other node types become "process".
NODE_ENTITY_TYPES = {
    "gene": "gene", "protein": "protein", "metabolite": "metabolite", "receptor": "receptor",
    "complex": "protein", "process": "process", "drug": "drug", "disease": "disease",
    "tissue": "tissue", "cell_type": "cell_type", "pathway": "pathway",
}
