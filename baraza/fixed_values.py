"""Word lists, labels, thresholds and texts that results must agree on."""

# ---- Fixed values: enum domains --------------------------------------------------------------
GOVERNMENT_ARMS = ["executive", "assembly", "consolidated", "revenue"]
REPORT_TYPES = ["audit_report", "birr", "exchequer", "cbrop", "programme_budget"]
INGESTION_STATUSES = ["pending", "in_progress", "completed", "failed"]
DISPUTE_STATUSES = ["pending_review", "under_review", "resolved_valid", "resolved_invalid", "escalated"]
REGISTERS = ["formal_swahili", "sheng", "english", "mixed"]

# ---- Fixed values: moderation transitions ----------------------------------------------------
DISPUTE_TRANSITIONS = {
    "pending_review": ["under_review"],
    "under_review": ["resolved_valid", "resolved_invalid", "escalated"],
    "resolved_valid": [],
    "resolved_invalid": [],
    "escalated": ["resolved_valid", "resolved_invalid"],
}
RESOLVED_STATUSES = ["resolved_valid", "resolved_invalid"]

# ---- Fixed values: slang -> standard Swahili -------------------------------------------------
SLANG_TO_SWAHILI = {
    "doo": "pesa", "ganji": "pesa", "chapaa": "pesa", "mkwanja": "pesa", "munde": "pesa",
    "gava": "serikali", "gavaa": "serikali",
    "prao": "mradi", "proja": "mradi", "job": "kazi",
    "hosi": "hospitali", "barabra": "barabara", "rodi": "barabara",
    "aje": "vipi", "mangapi": "ngapi",
    "county": "kaunti",
}

# ---- Fixed values: Swahili -> English (empty = dropped function word) ------------------------
SWAHILI_TO_ENGLISH = {
    "nini": "what", "nani": "who", "wapi": "where", "lini": "when", "gani": "which",
    "ngapi": "how much", "kulipwa": "paid", "gharimu": "cost", "uligharimu": "cost",
    "iligharimu": "cost",
    "hiyo": "", "hii": "", "ya": "", "za": "", "kwa": "", "ilikuwa": "",
    "hospitali": "hospital", "pesa": "money cost", "gharama": "cost", "bei": "price",
    "mradi": "project", "miradi": "projects", "kaunti": "county", "barabara": "road",
    "shule": "school", "maji": "water", "umeme": "electricity", "mkataba": "contract",
    "mwaka": "year", "miaka": "years", "serikali": "government", "kiasi": "amount",
    "malipo": "payments", "bajeti": "budget", "makadirio": "estimates",
    "matumizi": "expenditure", "mapato": "revenue", "madeni": "debts", "kazi": "work",
    "ujenzi": "construction", "afya": "health", "elimu": "education", "huduma": "services",
    "ripoti": "report", "ukaguzi": "audit",
}

# ---- Fixed values: Swahili marker words ------------------------------------------------------
SWAHILI_MARKERS = [
    "na", "ya", "za", "wa", "ni", "kwa", "katika", "kwamba", "kuhusu",
    "ambayo", "ambao", "ambacho", "ime", "zime", "hii", "hili", "huu",
    "haya", "hizo", "hivyo", "vile", "vya", "cha", "kila", "kuwa", "kama",
    "bila", "kutoka", "hadi", "zaidi", "pia", "sasa", "tayari", "jibu",
    "swali", "asante", "tafadhali", "sana", "hakuna", "sina", "samahani",
    "taarifa", "pesa", "mradi", "miradi", "kaunti", "serikali", "ripoti",
    "ukaguzi", "msimamizi", "mapato", "matumizi", "mgao", "mwaka", "watu",
    "ujenzi", "hospitali", "barabara", "mkataba", "kazi", "elimu", "afya",
    "maji", "umeme", "uchunguzi",
]
AMBIGUOUS_MARKERS = ["na", "wa", "ni"]
REPLY_MARKER_HITS = 2

# ---- Fixed values: lexical stop words --------------------------------------------------------
LEXICAL_STOP_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "for", "to", "and", "or",
    "is", "are", "was", "were", "be", "been", "did", "does", "do", "has",
    "have", "had", "what", "which", "who", "how", "when", "where", "why",
    "much", "many", "this", "that", "these", "those", "it", "its", "about",
    "with", "from", "their", "there", "they", "you", "your", "not", "no",
    "status", "can", "could", "would", "should", "will", "all", "any",
    "na", "ya", "za", "kwa", "cha", "hiyo", "hii", "ili", "kuhusu", "ngapi",
    "nini", "gani", "je",
]

# ---- Fixed values: routing words and thresholds ----------------------------------------------
REPORT_KEYWORDS = ["si sahihi", "sio sahihi", "si kweli", "sio kweli", "ripoti", "report"]
VALUE_FOR_MONEY_TRIGGERS = ["worth", "reasonable", "value for money", "gharama", "thamani", "bei"]
FOLLOWUP_MAX_WORDS = 5
HISTORY_LIMIT = 6
WEAK_SIMILARITY = 0.32
CLARIFY_MAX_WORDS = 10
RRF_CONSTANT = 60
TOP_K = 8
VARIANT_TOP_K_CAP = 50
MIN_PAGE_CHARS = 20
TEXT_LAYER_PAGES = 5
MAX_HEADING_WORDS = 7
CHUNK_WORDS = 250
CHUNK_OVERLAP = 50
MAX_DOCUMENT_BYTES = 100 * 1024 * 1024
MAX_ERROR_CHARS = 500
RATE_LIMIT = 10
RATE_WINDOW_SECONDS = 60
REPORT_SPACING_SECONDS = 30
FLAG_THRESHOLD = 3
MESSAGE_RETENTION_DAYS = 90
DISPUTE_RETENTION_DAYS = 365

# ---- Fixed values: link scoring --------------------------------------------------------------
ARM_KEYWORDS = {
    "executive": ["executive", "executives"],
    "assembly": ["assembly", "assemblies"],
}
REPORT_TYPE_KEYWORDS = {
    "audit_report": ["audit"],
    "birr": ["budget implementation", "birr", "implementation review"],
    "exchequer": ["exchequer"],
    "cbrop": ["budget review", "outlook", "cbrop"],
    "programme_budget": ["programme", "budget estimates", "approved budget"],
}
EDITION_KEYWORDS = ["first quarter", "q1", "half year", "first half", "nine months", "annual"]

# ---- Fixed values: IPv4 networks a document URL may not point to -----------------------------
BLOCKED_NETWORKS = [
    ("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12),
    ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 8),
]

# ---- Fixed values: county names --------------------------------------------------------------
COUNTIES = [
    "Baringo", "Bomet", "Bungoma", "Busia", "Elgeyo Marakwet", "Embu",
    "Garissa", "Homa Bay", "Isiolo", "Kajiado", "Kakamega", "Kericho",
    "Kiambu", "Kilifi", "Kirinyaga", "Kisii", "Kisumu", "Kitui", "Kwale",
    "Laikipia", "Lamu", "Machakos", "Makueni", "Mandera", "Marsabit",
    "Meru", "Migori", "Mombasa", "Murang'a", "Nairobi City", "Nairobi",
    "Nakuru", "Nandi", "Narok", "Nyamira", "Nyandarua", "Nyeri", "Samburu",
    "Siaya", "Taita Taveta", "Tana River", "Tharaka Nithi", "Trans Nzoia",
    "Turkana", "Uasin Gishu", "Vihiga", "Wajir", "West Pokot",
]

# ---- Fixed values: reply texts ---------------------------------------------------------------
NO_ANSWER_TEXT = {
    "en": "I'm sorry, I don't have the answer to this yet. My knowledge is currently limited to a few "
          "official county reports, but we are working on adding more documents soon!",
    "sw": "Samahani, sina jibu la swali hili kwa sasa. Taarifa nilizonazo zinatokana na ripoti chache "
          "rasmi za kaunti, lakini tunazidi kuongeza nyaraka zaidi hivi karibuni!",
}
SYSTEM_ERROR_TEXT = {
    "en": "Sorry, I'm having a little trouble right now. Please try again later!",
    "sw": "Samahani, mtandao wangu una shida kidogo kwa sasa. Tafadhali jaribu tena baadaye!",
}
REPORT_REPLY_TEXT = {
    "flagged": (
        "Thank you. This answer has been reported by several people and will now be prioritized for "
        "review by a moderator.",
        "Asante. Jibu hili limeripotiwa na watu kadhaa na sasa litapewa kipaumbele cha ukaguzi na msimamizi.",
    ),
    "created": (
        "Thank you for reporting. We will update you on the status of this report.",
        "Asante kwa kuripoti. Tutakufahamisha kuhusu hali ya ripoti hii.",
    ),
    "duplicate": (
        "You have already reported this answer. Thank you.",
        "Tayari ulisharipoti jibu hili. Asante kwa msaada wako.",
    ),
    "rate_limited": (
        "Please wait %d seconds before reporting again.",
        "Tafadhali subiri sekunde %d kabla ya kuripoti tena.",
    ),
    "no_recent": (
        "You have no recent answer to report. Please ask a question first.",
        "Hakuna jibu la hivi karibuni la kuripoti. Uliza swali kwanza.",
    ),
}
REPLY_SUFFIX = " \U0001F64F"
CITATION_ICON = "\U0001F4C4"
NOT_VAGUE = "NOT_VAGUE"
NOT_AVAILABLE = "N/A"

# What a link's score adds up, and by what a page that only scripts fill in is told.
LINK_WEIGHTS = {"title_word": 2, "arm": 15, "report_type": 4, "edition": 3}
REPOSITORY_SHELL_TAG = "<ds-app"
REPOSITORY_SHELL_TITLE = "<title>DSpace</title>"
# Phrases that stand before a translation and are no part of it.
TRANSLATION_FILLERS = ["sure", "here is the translation", "the translation", "translation", "in english"]
# The words of a county heading, and the line formats an answer text carries.
HEADING_WORDS = ["COUNTY", "(?:EXECUTIVE|ASSEMBLY|GOVERNMENT)", "OF"]
MARKER_LINE = r"^\s*USED_CHUNK:\s*(\d+(?:\s*,\s*\d+)*|none)\s*$"
CITATION_LINE = r"^\s*(?:chanzo|source|rejea)\s*:.*$"
