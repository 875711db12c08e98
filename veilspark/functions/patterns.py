r"""The patterns and word lists that define what is detected, stated in the order in which they apply.

Java syntax. (?Ud) gives \s, \d, \w and \b their Unicode meaning and lets only \n end a line.
"""

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

EMAIL = r"(?Ud)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

# A separator is one white space or hyphen, or nothing.
_TAIL = r"(?:\d{3,4}[\s-]?\d{3,4}|\d{6,8})"
PHONE = (
    r"(?Ud)(?<!\d)(?:"
    r"(?:\+?\s*91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}"  # mobile
    r"|\+?\s*91[\s-]?\d{2,4}[\s-]?" + _TAIL +  # landline with country code
    r"|0\d{2,4}[\s-]?" + _TAIL +  # landline with leading 0
    r"|\(0\d{2,4}\)[\s-]?" + _TAIL +  # the same in parentheses
    r")(?!\d)"
)
IPV4 = r"(?Ud)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
IPV4_VALID = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"
CARD = r"(?Ud)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
SSN = r"(?Ud)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"

ROLES = (
    "contact person", "company secretary", "compliance officer", "managing director", "whole time director", "whole-time director", "executive director",
    "independent director", "non executive director", "non-executive director", "director", "promoter", "chief financial officer", "chief executive officer",
    "chief operating officer", "authorized signatory", "authorised signatory", "designated person",
)
NAME_AFTER_COLON = r"(?Ud)(:\s*)([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,4})"

COMPANY = (
    r"(?Ud)(?<![A-Za-z])(?:[A-Z][A-Za-z0-9&.,'()/-]*(?:\s+|$)){1,10}"
    r"(?:Limited|Private\s+Limited|Pvt\.?\s+Ltd\.?|Ltd\.?|LLP|Inc\.?|Corporation|Corp\.?|Industries|Enterprises|Technologies|Solutions|Services|Holdings)\b"
)
COMPANY_FRAGMENTS = (
    "private limited", "private\nlimited", "co llp", "co. llp", "india limited", "india) limited", "pandit llp", "pandit, llp", "advisory private limited",
)
COMPANY_PHRASES = ("working capital", "senior management", "book running lead managers", "anchor investors", "registrar of companies")
COMPANY_WORD = r"[A-Za-z][A-Za-z0-9&'-]*"

DATE = rf"(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
DOB = r"(?iUd)(\b(?:date\s+of\s+birth|dob|birth\s+date)\b\s*(?:[:\-–]\s*|\bis\s+)?)(" + DATE + ")"
DATE_ONLY = r"(?iUd)^" + DATE + r"\z"

PIN = r"(?Ud)\b\d{3}\s?\d{3}\b"
ADDRESS_LABELLED = (
    r"(?iUd)((?:Registered\s+Office|Corporate\s+Office|Correspondence\s+Address|Registered\s+Address|Corporate\s+Address|Office\s+Address|Address)"
    r"\s*(?:at|is|:|-|–)?\s*)([^.;\n]{5,300}?\b\d{3}\s?\d{3}\b(?:[^.;\n]{0,80})?)"
)
ADDRESS_START = (
    r"(?iUd)(?:Plot(?:\s+No\.?)?|Flat(?:\s+No\.?)?|House|Office|Shop|Building|Floor|Survey(?:\s+No\.?)?|S\.?\s*No\.?|Village|Road|Lane|Society|Apartment"
    r"|Taluka|Nagar|Colony|Marg|Sector|Phase|Industrial\s+Park|Industrial\s+Estate|Tower|Centre|Center|Complex|Plaza)"
)
ADDRESS_PREMISE = r"(?Ud)(\b\d+[/A-Za-z0-9,\-–\s]*(?:and\s+\d+[/A-Za-z0-9,\-–\s]*)?)\s*$"
ADDRESS_REGION = (
    r"(?iUd)^((?:[\s,–-]*(?:Maharashtra|Rajasthan|Karnataka|Delhi|Gujarat|Tamil\s+Nadu|Telangana|Uttar\s+Pradesh|West\s+Bengal|Madhya\s+Pradesh|India))+)"
)
ADDRESS_PREFIX = r"(?iUd)^(?:Office|Address)\s*:\s*"
ADDRESS_MARKERS = (
    "road", "lane", "street", "society", "apartment", "flat", "floor", "building", "village", "taluka", "plot", "nagar", "colony", "marg", "sector", "phase",
    "industrial park", "industrial estate", "district", "tower", "centre", "center", "complex", "plaza", "farms", "heights", "bhavan", "enclave", "avenue",
    "drive", "house", "survey", "office", "pune", "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "hyderabad", "ahmedabad", "kolkata",
)

ORG_BLACKLIST = (
    "red herring", "anchor investors", "book running lead managers", "book running lead manager", "registrar of companies", "the registrar of companies",
    "working capital", "senior management", "operations", "maximum", "offer", "qib", "upi", "challan", "specialized", "state insurance", "provident fund",
    "goods and services tax", "llp", "chartered accountants", "5th floor",
)
PERSON_BLACKLIST = ("scrr", "challan", "unpai", "senior management", "working capital", "operations", "maximum", "offer")
SUFFIX_WORDS = ("private", "limited", "pvt", "ltd", "llp", "inc", "corp", "corporation", "co", "the", "and")
COMPANY_EVIDENCE = (
    r"(?iUd)\b(?:limited|private limited|pvt\.?\s*ltd\.?|ltd\.?|llp|inc\.?|corporation|corp\.?|industries|enterprises|technologies|solutions|services|holdings)\b"
)
SUSPICIOUS_ORGS = ("advisory private limited", "pandit llp", "working capital", "anchor investors", "book running lead managers", "registrar of companies", "upi")
SUSPICIOUS_ADDRESSES = ("corporate office at", "registered office at", "phase ii", "located at")

#: Confidence by rule, priority by source. Sources that are not listed, `context` among them, have priority 0.
CONFIDENCE = {"regex": 1.0, "person": 0.95, "company": 0.97, "dob": 0.99, "address_label": 0.99, "address_pin": 0.97}
PRIORITY = {"regex": 3, "presidio": 2, "spacy": 1}
DEFAULT_SEED = 20260926
