"""Fixed values that results depend on, kept as plain text."""

# --- numeric defaults -------------------------------------------------------
DAMPING = 0.85
TIME_BIAS = 5.0
DEFAULT_QUALITY = 0.3
DEFAULT_YEAR = 2020
ETA_AUTHOR = 1.0
ETA_TEAM = 1.0
ETA_INSTITUTION = 1.0
NEGATIVE_SENTIMENT_WEIGHT = 0.01
LOW_CONFIDENCE = 0.5
PRICE_DIVISOR = 2.0
MAX_ROUNDS = 200
TOLERANCE = 1e-10

# --- section weights, searched by substring in this order --------------------
SECTION_WEIGHTS = [
    ("methodology", 1.0),
    ("method", 1.0),
    ("results", 1.0),
    ("result", 1.0),
    ("discussion", 0.7),
    ("conclusion", 0.5),
    ("conclusions", 0.5),
    ("introduction", 0.4),
    ("background", 0.4),
    ("other", 0.2),
    ("unknown", 0.2),
]
SECTION_FALLBACK = 0.2

# --- weights of the six normalised section labels ----------------------------
LABEL_WEIGHTS = [
    ("Introduction", 0.4),
    ("Methodology", 1.0),
    ("Result", 1.0),
    ("Discussion", 0.7),
    ("Conclusion", 0.5),
    ("Other", 0.2),
]

# --- section label rules: first hit wins -------------------------------------
SECTION_LABEL_RULES = [
    ("Methodology", ["method"]),
    ("Result", ["result"]),
    ("Discussion", ["discussion"]),
    ("Conclusion", ["conclusion"]),
    ("Introduction", ["introduction", "related", "background"]),
]
STRICT_SECTION_LABEL_RULES = SECTION_LABEL_RULES[:4] + [("Introduction", ["introduction"])]

TRUE_WORDS = ["true", "1", "yes", "y"]
SENTIMENT_LABELS = ["positive", "neutral", "negative"]

# --- bucket edges (right-closed) ---------------------------------------------
RELEVANCE_EDGES = [-0.01, 0.4, 0.7, 1.01]
QUALITY_EDGES = [-0.01, 0.08, 0.22, 1.01]
BUCKET_LABELS = ["low", "mid", "high"]

# --- controlled vocabularies --------------------------------------------------
ALIGNED_STATUSES = ["exact", "high_confidence", "grouped", "range"]
SCORABLE_STATUSES = ["high_confidence", "grouped", "range"]
KEPT_STATUSES = ["exact", "high_confidence"]
UNRESOLVED_STATUSES = ["ambiguous", "failed"]
REVIEW_STATUSES = ["correct", "ambiguous", "wrong"]
FAILURE_REASONS = [
    "missing_pdf_or_text",
    "reference_section_not_found",
    "target_reference_entry_not_matched",
    "citation_marker_not_found",
    "author_year_format_not_supported",
    "title_fuzzy_match_failed",
    "grouped_or_range_uncertain",
    "poor_pdf_text_extraction",
    "unknown",
]
MENTION_SEPARATOR = "\n\n... [another target-aligned mention] ...\n\n"

# --- cue lists of the rule scorer ---------------------------------------------
NEGATIVE_CUES = [
    "however", "limitation", "limitations", "problem", "drawback", "challenge",
    "insufficient", "fails", "failed", "suffers",
]
POSITIVE_CUES = [
    "propose", "proposed", "use", "used", "adopt", "adopted", "extend", "follow",
    "based on", "framework", "method", "model", "pricing mechanism",
]
SECTION_CUES = [
    ("Conclusion", ["conclusion", "concluding", "in summary", "we conclude"]),
    ("Discussion", ["discussion", "implication", "limitation", "future work"]),
    ("Result", ["experiment", "evaluation", "result", "results", "performance", "compare", "comparison"]),
    ("Methodology", ["algorithm", "mechanism", "model", "framework", "query", "method"]),
    ("Introduction", ["background", "related work", "survey", "introduction"]),
]
RELEVANCE_CUES = ["compare", "baseline", "using", "based on"]
SECTION_RELEVANCE = [
    ("Methodology", 0.82),
    ("Result", 0.76),
    ("Discussion", 0.62),
    ("Introduction", 0.38),
    ("Conclusion", 0.48),
]
STATUS_CONFIDENCE = [("high_confidence", 0.82), ("grouped", 0.68), ("range", 0.63)]

# --- cue words that mark a hard case ------------------------------------------
HARD_CASE_CUES = [
    "however", "limitation", "limited", "fail", "fails", "failed", "unlike",
    "drawback", "problem", "cannot", "insufficient", "challenge", "although",
    "but", "weakness", "shortcoming",
]

# --- words ignored when title tokens are compared ------------------------------
TITLE_STOP_WORDS = [
    "a", "an", "and", "the", "of", "for", "on", "in", "to", "from", "with", "by",
    "based", "using", "under", "towards", "toward", "study", "survey", "analysis",
]

# --- words the similarity stop list has beyond Spark's own English list --------
EXTRA_STOP_WORDS = ["much", "beyond", "system", "two", "towards", "first"]

# --- price scenarios: name, alpha, beta ----------------------------------------
PRICE_SCENARIOS = [
    ("Conservative", 1.0, 5.0),
    ("Base Case", 1.0, 10.0),
    ("Aggressive", 1.0, 15.0),
    ("Quality Priority", 1.5, 8.0),
    ("Similarity Priority", 0.5, 12.0),
]

# --- text patterns ---------------------------------------------------------------
REFERENCE_HEADINGS = [r"\nreferences\b", r"\nbibliography\b", r"\nreference\s*\n"]
BRACKET_ENTRY = r"(?:^|\n)\s*\[(\d{1,9})\]\s*(.*?)(?=(?:\n\s*\[\d{1,9}\]\s)|\z)"
DOTTED_ENTRY = r"(?:^|\n)\s*(\d{1,9})\.\s*(.*?)(?=(?:\n\s*\d{1,9}\.\s)|\z)"
AUTHOR_YEAR_ENTRY = (
    r"(?:^|\n)([A-Z][^\n]{0,200}?(?:19|20)\d{2}\..*?)"
    r"(?=(?:\n[A-Z][^\n]{0,200}?(?:19|20)\d{2}\.)|\z)"
)
DOI = r"10\.\d{4,9}/[-._;()/:a-z0-9]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n{2,}"
YEAR = r"(?:19|20)\d{2}"
WORD = r"[\p{L}\p{N}_]{2,}"
