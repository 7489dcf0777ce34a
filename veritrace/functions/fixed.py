"""Categories, weights, thresholds, word and host lists. They must hold as they are for right results."""

CATEGORIES = ["FINANCIAL", "LEGAL", "REGULATORY", "REPUTATIONAL", "OPERATIONAL", "CYBERSECURITY", "ESG"]
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4, "INFO": 0.2}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
SUFFICIENCY_RANK = {"SPARSE": 0, "LIMITED": 1, "ADEQUATE": 2, "RICH": 3}
#: tier, least documents, least distinct source types; the first that holds
SUFFICIENCY = [("RICH", 15, 4), ("ADEQUATE", 8, 3), ("LIMITED", 4, 2)]
TIER_WEIGHT = {"PRIMARY": 1.0, "ESTABLISHED": 0.85, "GENERAL": 0.6, "LOW": 0.35}
PRIMARY_TYPES = ["SEC_FILING", "COMPANY_REGISTRY", "COURT_RECORD", "SANCTIONS_LIST"]
OWN_TYPES = ["COMPANY_WEBSITE", "INTERNAL"]
TWO_LEVEL_TLDS = [
    "co.uk", "gov.uk", "org.uk", "ac.uk", "com.au", "co.in", "co.jp", "com.br",
    "co.za", "com.sg", "com.hk", "co.nz",
]
ESTABLISHED_DOMAINS = [
    "reuters.com", "bloomberg.com", "wsj.com", "ft.com", "nytimes.com",
    "washingtonpost.com", "apnews.com", "theguardian.com", "bbc.com", "bbc.co.uk",
    "cnbc.com", "forbes.com", "economist.com", "politico.com", "axios.com",
    "npr.org", "latimes.com", "marketwatch.com", "barrons.com", "fortune.com",
    "businessinsider.com", "theverge.com", "techcrunch.com", "arstechnica.com",
    "wired.com", "nature.com", "sciencemag.org", "propublica.org", "law360.com",
    "courthousenews.com", "thetimes.co.uk", "telegraph.co.uk", "nikkei.com",
    "scmp.com", "aljazeera.com", "cnn.com", "nbcnews.com", "cbsnews.com",
    "abcnews.go.com", "usatoday.com", "theinformation.com", "ap.org",
]
LOW_DOMAINS = [
    "prnewswire.com", "businesswire.com", "globenewswire.com", "prweb.com",
    "newswire.com", "einnews.com", "openpr.com", "accesswire.com", "issuewire.com",
    "medium.com", "substack.com", "blogspot.com", "wordpress.com", "wix.com",
    "weebly.com", "blogger.com", "tumblr.com", "reddit.com", "quora.com",
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com",
    "tiktok.com", "youtube.com",
]
STOP_WORDS = (
    "the a an of for and or to in on at by with from is are was were be as that this it "
    "its has have had will not boeing company since due also their than over into out"
).split()
CORPORATE_SUFFIX = r"(?i)[\s,]*(Inc\.?|LLC\.?|Ltd\.?|Corp\.?|Co\.?|L\.?P\.?|LLP|PLC|Limited|Incorporated|Corporation|Holdings|Group|S\.?A\.?)[\s,]*$"
TEMPORAL_DEFAULT, TEMPORAL_FLOOR, TEMPORAL_LOSS, DAYS_A_YEAR = 0.7, 0.3, 0.15, 365.25
PASS, FLAG, FLAG_FACTOR = 85.0, 70.0, 0.5
DEDUP_COSINE, CONTRADICTION_COSINE, MATCH_COSINE, MATCH_LEXICAL = 0.85, 0.5, 0.45, 55.0
REVIEW_FLOOR, INFLATION, MAX_PAIRS = 0.6, 0.10, 5
MAX_CALLS, MAX_COST, MAX_SECONDS, DOCS_A_SOURCE, SIGNALS_A_DOC, RESERVED_CALLS = 50, 1.0, 600.0, 10, 7, 8
TEXT_CAP, CHUNK_WORDS = 50_000, 200
#: node, status, percent
STAGES = [
    ("entity_resolution", "researching", 15), ("research", "researching", 35), ("data_sufficiency_check", "extracting", 45),
    ("extraction", "analyzing", 65), ("risk_analysis", "analyzing", 78), ("hitl_gate", "synthesizing", 84),
    ("synthesis", "synthesizing", 94), ("presentation", "synthesizing", 98),
]
#: model, price of a prompt token, of a completion token
PRICES = [("gemini-2.5-flash-lite", 0.10e-6, 0.40e-6), ("gemini-2.5-flash", 0.075e-6, 0.30e-6), ("gemini-2.5-pro", 1.25e-6, 10.0e-6)]
FALLBACK_PRICE = (0.075e-6, 0.30e-6)
VERDICTS = {"c": "CONFIRMED", "confirm": "CONFIRMED", "d": "DISMISSED", "dismiss": "DISMISSED", "i": "NEEDS_INVESTIGATION", "investigate": "NEEDS_INVESTIGATION"}
PRIORITIES = ["IMMEDIATE", "SHORT_TERM", "MONITOR"]

#: What an error that passes names: codes and conditions of an overloaded service.
PASSING = "429|500|502|503|504|UNAVAILABLE|RESOURCE_EXHAUSTED|INTERNAL|DEADLINE|OVERLOADED"

#: Steps of a run's states as shown; the failed state stands before all.
STEPS = {"queued": 0, "researching": 1, "extracting": 2, "analyzing": 3, "reviewing": 4, "synthesizing": 5, "complete": 6, "error": -1}
