"""Patterns, tiers and limits that decide results."""

from __future__ import annotations

# Financial-metric phrases that make a chunk a candidate.
COVENANT_KEYWORDS = (
    "leverage ratio",
    "fixed charge coverage",
    "debt service coverage",
    "interest coverage ratio",
    "minimum liquidity",
    "consolidated liquidity",
    "financial covenants?",
)
REFERENCE_QUERIES = (
    "Financial covenant: Consolidated Leverage Ratio shall not exceed a maximum ratio",
    "Financial covenant: minimum liquidity or Fixed Charge Coverage Ratio requirement",
)
KEYWORD_BONUS = 1.0
LEAST_SCORE = 0.4
MAX_CANDIDATES = 5
MAX_CANDIDATES_TFIDF = 10
# Common English words that TF-IDF leaves out.
STOP_WORDS = tuple(
    "about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does"
    " doing down due during each either else etc ever every few for from further had has have having he her here hereby herein hers him his how however if in"
    " into is it its itself may me might more most much must my no nor not of off on once only or other others our out over own per same shall she should"
    " since so some such than that the their them then there thereby therefore therein thereof these they this those through thus to together too under until"
    " up upon us very was we were what when where whereas whether which while who whom whose why will with within without would yet you your".split()
)

# Headings, definitions and references between them (Java syntax).
SECTION_LABEL = r"^((?:(?i:section)[\s ]+)?\d+\.\d+(?:\.\d+)*)\.?[\s ]+[A-Z]"
ARTICLE_LABEL = r"^((?i:article)[\s ]+\d+[a-z]?)\.?\z"
DEFINITIONS_HEADING = r"(?iU)\bdefinitions\b"
MEANS = r"(?:means|shall\s+mean)"
OPENER = '["“]\\s*[A-Z][^"“”]{0,80}["”]?\\s*' + MEANS + r"\b"
QUALIFIER = '(?:for\\s+[^,"“”]{1,40},\\s*)?'
TITLE_PHRASE = r"(?U)(?:[A-Z][a-zA-Z]*\s+){1,6}[A-Z][a-zA-Z]*"
CARVE_OUT = r"(?idU)\b(?:provided(?:,)?\s+(?:however,\s+)?that|excluding|other than|except(?:\s+for)?)\b.{0,300}"
#: Prefixes that later mentions of a term drop.
DROPPED_PREFIXES = ("Consolidated ", "Applicable ")
MAX_HOPS = 2
MAX_TERMS = 8
MAX_DEPTH = 2
COMPARISONS = ("not_to_exceed", "not_less_than")
COVENANT_TYPES = ("maintenance", "incurrence_condition")
CROSS_REFERENCE = r'(?iU)"([A-Z][^"]{0,80})"\s+has\s+the\s+meaning\s+(?:set\s+forth|specified)\s+in\s+Section\s+([\d.()a-zA-Z]+)'

# Thresholds and baskets.
RATIO = r"(\d+(?:\.\d+)?)\s*(?::|to)\s*1(?:\.0+)?"
DOLLARS = r"\$\s*([\d,]+(?:\.\d+)?)"
UPPER_LIMIT = r"(?i)\b(exceed|greater than)\b"
LOWER_LIMIT = r"(?i)\b(less than|not less than)\b"
BASKET_DOLLARS = r"(?i)\$([\d,]+(?:\.\d+)?)\s*(million|mm|thousand|k)?"
BASKET_PERCENT = r"(\d+(?:\.\d+)?)\s*%"
BASKET_BASE = r"(?i)%\s*of\s+([A-Za-z][A-Za-z0-9 \-’']*?)(?:\s+for|\s*[\.,;)]|$)"
MULTIPLIERS = {"million": 1_000_000, "mm": 1_000_000, "thousand": 1_000, "k": 1_000}

# Priority tiers of the six loan attributes, in the order in which they choose chunks.
DOLLAR_AHEAD = r"(?=[^.]{0,80}\$)"
LOAN_TIERS = {
    "interest_rate": (r"\b(applicable margin|applicable rate|term sofr)\b", r"\b(interest rate|base rate|libor|per annum)\b"),
    "maturity": (r"\b(maturity date|termination date)\b", r"\b(final maturity|scheduled maturity|stated maturity|expiration date)\b"),
    "start_date": (r"\bdated as of\b", r"\b(closing date|effective date)\b"),
    "repayment": (
        r"\b(repayment of (?:the )?(?:loans?|principal)|principal (?:installment|payment|amortization)s?|amortization (?:schedule|of (?:the )?(?:term )?loans?)|scheduled (?:repayments?|installments?)|quarterly installments? of)\b",
    ),
    "loan_type": (
        r"\b(senior secured|senior unsecured|secured|unsecured)\s+(?:revolving\s+(?:credit\s+)?(?:facility|loan)s?|term\s+loan(?:\s+facility)?|credit\s+facility)\b",
        r"\b(revolving credit facility|term loan facility|revolving loan|term loan|credit facility)\b",
    ),
    "loan_amount": (
        r"\b(aggregate (?:principal )?(?:amount|commitments?)|(?:maximum|total) (?:revolving )?(?:credit|loan|facility) (?:amount|commitments?))\b" + DOLLAR_AHEAD,
        r"\b(not to exceed \$|up to \$|principal amount of \$|(?:maximum|original) principal amount" + DOLLAR_AHEAD + r")\b",
    ),
}
#: The six attributes are fields of the loan terms.
LOAN_FIELDS = ("loan_type", "loan_amount", "interest_rate", "start_date", "end_date", "principal_repayment_terms")
LOAN_LABELS = {
    "loan_type": "loan type",
    "loan_amount": "loan amount",
    "interest_rate": "interest rate",
    "start_date": "start date",
    "end_date": "maturity date",
    "principal_repayment_terms": "principal repayment terms",
}
#: Fields whose value may be the name of a defined term.
CHAINED_FIELDS = ("loan_amount", "interest_rate", "end_date")
PREAMBLE_CHARS = 3000
SHORT_BLOCK = 40
