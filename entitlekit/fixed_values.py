"""Word lists, patterns and labels that results depend on.

Everything here is a constant of the domain, stated as plain text. Larger
reference data (schemes, FAQs, dictionaries, proper nouns, messages) is always
a table argument.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
NATIONAL = "All India"
ALL = "all"
MATCH_SCORE = 100

# FAQ scoring
STOP_WORDS = [
    "what", "is", "the", "how", "to", "for", "a", "an", "in", "of", "and", "are", "can", "do", "i",
    "my", "me", "please", "tell", "about", "which", "give", "show", "list", "know", "want", "need",
    "get",
]
EXTRA_BOOSTERS = [
    "kanya", "sumangala", "vatsalya", "sukanya", "samriddhi", "jan", "dhan", "pmegp", "svanidhi",
    "vishwakarma", "diksha", "nipun", "samagra", "shreyas", "karmayogi", "agnipath", "suraksha",
    "bima", "jyoti",
]
FAQ_THRESHOLD = 0.3
BOOSTER_POINTS = 0.3
CONTAINMENT_POINTS = 0.4

# Intent routing
GREETINGS = [
    "hi", "hello", "hey", "hii", "hiii", "hey there", "namaste", "pranam", "vanakkam", "vanakam",
    "namaskara", "adaab", "satsriakal", "good morning", "good evening", "good afternoon", "gm",
    "ge", "ga", "help", "support", "greet", "start", "नमस्ते", "नमस्कार", "हैलो", "हाय",
    "வணக்கம்", "నమస్కారం", "ನಮಸ್ಕಾರ", "നമസ്കാരം", "നമസ്തേ", "નમસ્તે", "নমস্কার",
    "main menu", "menu", "go back", "back", "home", "start over",
]
GREETING_PREFIXES = ["hi", "hello"]  # followed by the assistant's own name
GREETING_PHRASES = ["who are you", "what are you", "help me"]
THANKS = [
    "thanks", "thank you", "thank u", "thx", "thnk u", "shukriya", "dhanyawad", "dhanyavaad",
    "nandri", "dhanyavadagalu", "धन्यवाद", "शुक्रिया", "நன்றி", "ಧನ್ಯವಾದಗಳು", "ಧನ್ಯವಾದ",
    "ధన్యవాదాలు", "നന്ദി", "આભાર", "ধন্যবাদ",
]
SMALL_TALK = [
    "how are you", "how r u", "kaise ho", "how do you do", "who created you", "who made you",
    "what is your name", "who are you",
]
LIST_ALL_PHRASES = [
    "all schemes", "list schemes", "show schemes", "schemes list", "available schemes",
    "list all schemes", "सभी योजनाएं", "सभी योजनाओं",
]
STATE_PHRASES = ["which state", "my state", "state list"]
STATE_OPTIONS = [
    "Maharashtra", "Karnataka", "Tamil Nadu", "Uttar Pradesh", "West Bengal", "Gujarat",
    "Rajasthan", "Kerala", "Punjab",
]
SPECIFIC_KEYWORDS = [
    "ayushman", "pm kisan", "mudra", "awas", "jan dhan", "sukanya", "suraksha", "ujjwala",
]
MENU_LABEL = "Main Menu"
LIST_LABEL = "List All Schemes"

# Scheme card
REQUIRED_DOCUMENTS = ["Aadhaar Card", "Identity Proof", "Income Certificate", "Bank Details"]
CARD_HEADINGS = [
    "ELIGIBILITY CRITERIA", "REQUIRED DOCUMENTS", "HOW TO APPLY", "BENEFITS", "OFFICIAL WEBSITE",
]
DEFAULT_STEPS = "Apply via official portal."

# Name validity
ADDRESS_WORDS = [
    "VILLAGE", "TALUK", "BLOCK", "DISTRICT", "POST", "TEHSIL", "MANDAL", "ROAD", "STREET", "LANE",
    "GALI", "OPPOSITION", "JHARKHAND", "ODISHA", "WEST BENGAL", "MAHARASHTRA", "PUNJAB", "HARYANA",
    "UTTARPRADESH", "ADDRESS", "NEAR", "OPP", "PIN", "LOC", "HOUSE", "FLAT", "APARTMENT",
    "SECTOR", "PHASE", "COLONY", "MENT", "NDT",
]

# Document text
HEADER_WORDS = ["INDIA", "UIDAI", "AADHAAR", "SARKAR", "GOVERNMENT"]
ADDRESS_LINE_WORDS = [
    "VLG", "BIA", "PHT", "VILL", "POST", "DIST", "TALUK", "VILLAGE", "BLOCK", "GALI",
]
NOISE_WORDS = [
    "GOVERNMENT", "INDIA", "UIDAI", "FATHER", "NAME", "DOB", "YEAR", "BIRTH", "MALE", "FEMALE",
    "GENDER", "ADDRESS", "AADHAAR", "RNMENT", "NDT", "GOVT", "TAP", "ZOOM", "MERA", "PEHCHAAN",
]
DOC_IDENTITY = "Aadhaar Card"
DOC_INCOME = "Income Certificate"
DOC_CASTE = "Caste Certificate"
DOC_UNKNOWN = "Unknown"
IDENTITY_MARKS = ["GOVERNMENT OF INDIA", "AADHAAR", "UNIQUE IDENTIFICATION"]
INCOME_MARKS = ["INCOME CERTIFICATE", "ANNUAL INCOME"]
CASTE_MARKS = ["CASTE", "OBC", "SCHEDULED"]
CATEGORY_ORDER = ["OBC", "SC", "ST", "GENERAL"]
INCOME_PATTERN = r"(?i)(?:Rs\.?|INR|Total|Annual|Income|Amount|Salary)[:\s]*([\d,]+)"
PAYLOAD_ROOT = "<PrintLetterBarcodeData"
ADDRESS_PARTS = ["house", "street", "lm", "loc", "vtc", "dist", "state", "pc"]
FULL_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
SCAN_DATE = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})"
PLAIN_NAME = r"(?iU)Name:?\s*([\w\s\.]+?)(?:\n|DOB|Gender|$)"
PLAIN_DOB = r"(?iU)DOB:?\s*([\d/-]+)"
PLAIN_GENDER = r"(?iU)Gender:?\s*(Male|Female|M|F)"
CORRUPT_NAME_MARKS = ["NDT", "RNMENT"]

# Languages
SCRIPT_RANGES = [
    ("hi", r"[\x{0900}-\x{097F}]"), ("bn", r"[\x{0980}-\x{09FF}]"),
    ("ta", r"[\x{0B80}-\x{0BFF}]"), ("te", r"[\x{0C00}-\x{0C7F}]"),
    ("kn", r"[\x{0C80}-\x{0CFF}]"), ("ml", r"[\x{0D00}-\x{0D7F}]"),
    ("gu", r"[\x{0A80}-\x{0AFF}]"),
]
TITLE_PREFIXES = ["शीर्षक", "தலைப்பு", "title", "மகுடம்", "제목", "नाव", "नाम"]
COMPOUND_LENGTH = 100
GROUP_SIZE = 10
SHORT_WORDS = 5
ERROR_MARKS = ["Error 500", "Server Error"]
