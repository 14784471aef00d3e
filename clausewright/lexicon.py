"""Taxonomy, words, patterns and weights whose wording decides results."""

# Category codes and names.
CATEGORIES = {
    "C01": "Added Requirement",
    "C02": "Removed Requirement",
    "C03": "Modified Requirement",
    "C04": "Threshold / Limit Change",
    "C05": "Timeline Change",
    "C06": "Eligibility Change",
    "C07": "Compliance Requirement",
    "C08": "Reporting Requirement",
    "C09": "Documentation Requirement",
    "C10": "Penalty / Consequence",
    "C11": "Scope Change",
    "C12": "Definition Change",
    "C13": "Exception / Exemption Change",
    "C14": "Procedural Change",
    "C15": "Reference / Cross-Reference Change",
    "C16": "Clarification",
    "C17": "Editorial Change",
}

# The dashboard's shorter names.
UI_LABELS = {
    "C01": "Added Requirement",
    "C02": "Removed Requirement",
    "C03": "Modified Requirement",
    "C04": "Threshold / Limit",
    "C05": "Timeline Change",
    "C06": "Eligibility",
    "C07": "Compliance",
    "C08": "Reporting",
    "C09": "Documentation",
    "C10": "Penalty / Consequence",
    "C11": "Scope Change",
    "C12": "Definition",
    "C13": "Exception / Exemption",
    "C14": "Procedural",
    "C15": "Reference",
    "C16": "Clarification",
    "C17": "Editorial",
}

# Impact levels from the highest, and each category's base score.
IMPACTS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]
BASE_IMPACT = {"C01": 3, "C02": 3, "C03": 2, "C04": 3, "C05": 3, "C06": 3, "C07": 4, "C08": 3, "C09": 2, "C10": 4, "C11": 3, "C12": 2, "C13": 3, "C14": 2, "C15": 1, "C16": 1, "C17": 0}

CHANGE_TYPES = ["ADDED", "REMOVED", "MODIFIED", "RELOCATED", "SPLIT", "MERGED", "REWORDED", "UNCHANGED"]
REVIEW_STATUSES = ["PENDING", "ACCEPTED", "REJECTED", "EDITED", "FLAGGED"]

# Obligation terms in the order they are reported, with their strength.
OBLIGATIONS = {
    "shall not": 5, "must not": 5, "not permitted": 5, "not allowed": 0,
    "shall": 5, "must": 5, "required": 5, "mandatory": 5, "obligatory": 5,
    "prohibited": 5, "forbidden": 5,
    "should": 4, "expected": 4, "necessary": 4,
    "recommended": 3,
    "may": 2, "can": 2, "permitted": 2, "allowed": 2, "optional": 1,
}

# Conditional phrases; any white space may stand between the words.
CONDITIONALS = ["provided that", "subject to", "unless otherwise", "except where", "in case of", "notwithstanding"]

# Words that make a small change substantive, tested as substrings.
INDICATORS = [
    "shall", "must", "required", "mandatory", "prohibited", "not permitted", "may", "should", "permitted",
    "within", "days", "months", "years", "percent", "%", "lakh", "crore", "lakhs", "crores",
    "penalty", "fine", "action", "revoke", "cancel", "eligible", "exemption", "exception", "applicable",
    "report", "submit", "furnish", "file", "effective", "deadline", "date", "period",
    "minimum", "maximum", "limit", "threshold",
]

# Keyword groups by category, in the order that breaks ties; a group counts once.  Words have boundaries on
# both sides and any case, but for the first group of C04; "?" makes the letter before it optional, "." fits any character.
CATEGORY_GROUPS = {
    "C04": [r"(?:₹|Rs\.?|INR|crore|lakh|percent|%)", r"\b(?:threshold|limit|ceiling|floor|cap)\b"],
    "C05": [r"\b(?:within|deadline|due date|effective date|commencement)\b", r"\b\d+\s*(?:days?|months?|years?|weeks?)\b", r"\b(?:period|timeline|time.?frame|time.?limit)\b"],
    "C06": [r"\b(?:eligible|eligibility|qualify|qualification|ineligible)\b", r"\b(?:entitled|entitlement|disqualified)\b"],
    "C07": [r"\b(?:comply|compliance|non.?compliance|adherence)\b", r"\b(?:obligation|binding|compulsory)\b"],
    "C08": [r"\b(?:report|reporting|returns?|statement|submission|submit|furnish)\b", r"\b(?:FIU|STR|CTR|suspicious transaction)\b"],
    "C09": [r"\b(?:document|documentation|records?|certificate|proof|evidence)\b", r"\b(?:maintain|retention|preserve|keep)\b"],
    "C10": [r"\b(?:penalty|penalt|fine|sanction|action|punish|revoke|cancel)\b", r"\b(?:suspension|restriction|debarment|prohibition)\b"],
    "C11": [r"\b(?:scope|applicability|applicable|coverage|extend|expand)\b", r"\b(?:include|exclude|exempt|apply to)\b"],
    "C12": [r"\b(?:means?|defined|definition|shall include|refers? to)\b", r'"[^"]+"'],
    "C13": [r"\b(?:except|exception|exempt|exemption|waiver|relaxation)\b", r"\b(?:provided that|notwithstanding|unless)\b"],
    "C14": [r"\b(?:procedure|process|method|mechanism|manner|mode)\b", r"\b(?:steps?|stage|workflow|verification|validation)\b"],
    "C15": [r"\b(?:circular|direction|notification|regulation|act|rule|section)\b", r"\b(?:refer|reference|pursuant|accordance|vide)\b", r"RBI/\w+/\d+"],
}

# Multipliers of amounts.
MULTIPLIERS = {"crores": 1e7, "crore": 1e7, "lakhs": 1e5, "lakh": 1e5, "thousand": 1e3, "million": 1e6, "billion": 1e9}

# Patterns of amounts, percentages, durations, dates and limits (any case).
_NUM = r"(\d+(?:,\d+)*(?:\.\d+)?)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_CURRENCY = r"(?:₹|Rs\.?|INR)"
MONEY = [rf"(?:₹|Rs\.?|INR|Rupees)\s*{_NUM}\s*(crore|crores|lakh|lakhs|thousand|million|billion)?", rf"{_NUM}\s*(crore|crores|lakh|lakhs)\b"]
PERCENT = [r"(\d+(?:\.\d+)?)\s*(?:per\s*cent|percent|%)", r"(\d+(?:\.\d+)?)\s*p\.c\."]
DURATION = [r"(?:within\s+)?(\d+)\s*(days?|months?|years?|weeks?|hours?)", r"(\d+)\s*(?:calendar|working|business)\s*(days?|months?)", r"(?:period\s+of\s+)(\d+)\s*(days?|months?|years?)"]
DATES = [rf"(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})", rf"({_MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})", r"(\d{2})[./](\d{2})[./](\d{4})", r"(\d{4})-(\d{2})-(\d{2})"]
LIMITS = [rf"(?:minimum|min\.?)\s+(?:of\s+)?{_CURRENCY}?\s*{_NUM}", rf"(?:maximum|max\.?)\s+(?:of\s+)?{_CURRENCY}?\s*{_NUM}", rf"(?:not\s+(?:exceeding|exceed|more\s+than))\s+{_CURRENCY}?\s*{_NUM}", rf"(?:at\s+least|not\s+less\s+than)\s+{_CURRENCY}?\s*{_NUM}"]

# Characters that extraction garbles, and what they stand for; an empty value deletes.
ARTIFACTS = {
    "\x92": "'", "\x93": '"', "\x94": '"', "\x96": "-", "\x97": "-", "\ufffd": "", "\uf0b7": "\u2022", "\uf0a7": "\u00a7",
    "\u00a0": " ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-",
}

# Currency spellings in the order they are replaced.
CURRENCIES = {"₹": "INR ", "Rs.": "INR ", "Rs ": "INR ", "Rupees ": "INR "}

# Lines that are page furniture (any case).
FURNITURE = [r"^\s*\d+\s*$", r"^\s*Page\s+\d+\s+of\s+\d+\s*$", r"^\s*-\s*\d+\s*-\s*$"]

# Abbreviations whose full stop doesn't end a sentence (any case).
ABBREVIATIONS = ["Dr|Mr|Mrs|Ms|Prof|Sr|Jr|vs|etc|viz|i\\.e|e\\.g", "No|nos|Sl|Ref|Sec|Ch|Art|Cl|Para|Sub", "RBI|SEBI|NABARD|IRDAI|NHB|PFRDA"]

# Block patterns on the first line.
CHAPTER = r"(?i)^chapter\s*[-–]?\s*([IVXLCDM]+|\d+)\b"
ANNEXURE = r"(?i)^(?:annexure|annex|appendix|schedule)\s*(.*)"
PART = r"(?i)^part\s*[-–]?\s*([IVXLCDM]+|\d+)\b\s*[-–:]?\s*(.*)"
DEFINITION = r"""(?i)^["']([^"']+)["']?\s+(?:means|refers to|shall mean|includes)"""
