"""Fixed values that results depend on."""

# Evidence tiers by publishers' domains.
OFFICIAL_DOMAINS = (
    "whitehouse.gov", "archives.gov", "congress.gov", "govinfo.gov", "sec.gov", "bls.gov", "bea.gov", "treasury.gov", "who.int", "un.org",
    "state.gov", "defense.gov", "judiciary.gov", "supremecourt.gov", "ecb.europa.eu", "imf.org", "worldbank.org",
)
WIRE_DOMAINS = ("reuters.com", "apnews.com", "afp.com", "upi.com")
REFERENCE_DOMAINS = ("wikipedia.org", "britannica.com", "snopes.com", "politifact.com", "factcheck.org")
MAINSTREAM_DOMAINS = (
    "bbc.com", "bbc.co.uk", "npr.org", "cnn.com", "nytimes.com", "washingtonpost.com", "theguardian.com", "wsj.com", "ft.com",
    "thehill.com", "politico.com", "aljazeera.com", "foxnews.com", "nbcnews.com", "cbsnews.com", "abcnews.go.com", "usatoday.com",
    "latimes.com", "bloomberg.com", "economist.com", "time.com", "theatlantic.com", "jacobin.com", "thenation.com", "nationalreview.com",
    "reason.com", "motherjones.com", "dailywire.com", "breitbart.com",
)

# Words that scope overlap passes over.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "by", "as", "at", "from",
    "is", "are", "was", "were", "be", "been", "being", "it", "that", "this", "these", "those",
    "they", "he", "she", "we", "you", "i", "their", "his", "her", "has", "have", "had", "not",
)

# Claim risk, first match wins.
CRITICAL_RISK = (
    r"\b(killed|assassinated|died|dead|death)\b.*\b(president|prime minister|supreme leader|head of state|king|queen|pope|chancellor)\b",
    r"\b(president|prime minister|supreme leader|head of state|king|queen|pope|chancellor)\b.*\b(killed|assassinated|died|dead|death)\b",
    r"\b(nuclear|chemical|biological)\s+(attack|strike|weapon|bomb|warhead)\b",
    r"\b(declaration\s+of\s+war|declared\s+war|war\s+declared)\b",
    r"\b(coup\s+d'[eé]tat|military\s+coup|government\s+overthrown)\b",
    r"\b(martial\s+law\s+declared|state\s+of\s+emergency)\b",
)
HIGH_RISK = (
    r"\b(terrorist|terror)\s+(attack|incident|bombing|shooting)\b", r"\b(mass\s+(shooting|casualty|casualties|killing))\b",
    r"\b(genocide|ethnic\s+cleansing|war\s+crime)\b", r"\b(invasion|invaded|invading)\b.*\b(country|nation|territory)\b",
    r"\b(sanctions|embargo)\s+(imposed|announced|declared)\b", r"\b(arrested|indicted|convicted)\b.*\b(president|minister|senator|governor|ceo)\b",
    r"\b(president|minister|senator|governor|ceo)\b.*\b(arrested|indicted|convicted)\b",
    r"\b(market\s+crash|economic\s+collapse|bank\s+failure)\b", r"\b(pandemic|epidemic)\s+(declared|announced)\b",
)
MEDIUM_RISK = (
    r"\b(illegal|unlawful|prohibited|banned)\b", r"\b(statute|regulation|law\s+requires|legally\s+required)\b",
    r"\b(under\s+investigation|being\s+investigated|probe)\b", r"\b(millions|billions|trillions)\s+(of\s+)?(dollars|euros|pounds)\b",
    r"\b\$\d{1,3}(,\d{3})*\s*(million|billion|trillion)\b",
)
ATTRIBUTION = (
    r"\b(?:said|stated|wrote|tweeted|posted|announced|declared|claimed|told|testified)\b", r"\baccording\s+to\b",
    r"\b(?:in\s+a\s+(?:statement|tweet|post|speech|interview|press\s+conference))\b", r"\b(?:quoted\s+as\s+saying)\b",
)
#: Of each pattern above words, or parts of some, in small letters, one of which any match holds.
NEEDED_WORDS = dict(zip((*CRITICAL_RISK, *HIGH_RISK, *MEDIUM_RISK, *ATTRIBUTION), (
    "killed assassinated died dead death", "killed assassinated died dead death", "nuclear chemical biological", "war", "coup government", "martial emergency",
    "terror", "mass", "genocide ethnic war", "invasion invaded invading", "sanctions embargo", "arrested indicted convicted", "arrested indicted convicted",
    "market economic bank", "pandemic epidemic", "illegal unlawful prohibited banned", "statute regulation requires required", "investigat probe", "illions", "illion",
    "said stated wrote tweeted posted announced declared claimed told testified", "according", "statement tweet post speech interview conference", "quoted",
), strict=True))
# Claims about law and about events.
LEGAL_CLAIM = r"\billegal\b|\blaw\b|\bprohibit(ed|s)?\b|\bban(ned|s)?\b|\bpermitted\b|\ballowed\b|\bregulated\b"
EVENT_CLAIM = r"\b(bomb(ed|ing|s)?|strike[sd]?|airstrike[sd]?|attack(ed|s)?|shelling|missile[sd]?|invasion|offensive|raid(ed|s)?|shell(ed|ing)?)\b"
PROPER_NOUN = r"\b[A-Z][a-z]+\b"

# Names under which entities and places are counted. Names with dots, apostrophes or brackets, which cleaning
# removes before the lookup, have no entry.
ENTITY_ALIASES = {
    "us": "united states", "usa": "united states", "america": "united states", "uk": "united kingdom", "britain": "united kingdom",
    "great britain": "united kingdom", "uae": "united arab emirates", "eu": "european union", "prc": "china", "peoples republic of china": "china",
    "dprk": "north korea", "rok": "south korea", "ksa": "saudi arabia", "biden": "joe biden", "joseph biden": "joe biden",
    "president biden": "joe biden", "trump": "donald trump", "president trump": "donald trump",
    "netanyahu": "benjamin netanyahu", "bibi": "benjamin netanyahu", "pm netanyahu": "benjamin netanyahu", "putin": "vladimir putin",
    "xi": "xi jinping", "xi jinping": "xi jinping", "zelensky": "volodymyr zelensky", "zelenskyy": "volodymyr zelensky",
    "macron": "emmanuel macron", "starmer": "keir starmer", "scholz": "olaf scholz", "modi": "narendra modi",
    "pentagon": "us department of defense", "dod": "us department of defense", "state department": "us department of state",
    "state dept": "us department of state", "white house": "white house", "scotus": "supreme court of the united states",
    "supreme court": "supreme court of the united states", "fed": "federal reserve", "the fed": "federal reserve",
    "federal reserve": "federal reserve", "nato": "nato", "un": "united nations", "who": "world health organization",
    "imf": "international monetary fund", "icc": "international criminal court", "centcom": "us central command",
    "epa": "environmental protection agency", "fbi": "federal bureau of investigation", "cia": "central intelligence agency",
    "nsa": "national security agency", "dhs": "department of homeland security",
}
GEO_CODES = {
    "united states": "US", "usa": "US", "us": "US", "america": "US", "washington": "US-DC", "washington dc": "US-DC", "new york": "US-NY",
    "california": "US-CA", "florida": "US-FL", "texas": "US-TX", "united kingdom": "GB", "uk": "GB", "london": "GB-LDN", "france": "FR",
    "paris": "FR-PAR", "germany": "DE", "berlin": "DE-BER", "china": "CN", "beijing": "CN-BEI", "shanghai": "CN-SHA", "russia": "RU",
    "moscow": "RU-MOW", "ukraine": "UA", "kyiv": "UA-KYV", "israel": "IL", "jerusalem": "IL-JER", "tel aviv": "IL-TLV", "iran": "IR",
    "tehran": "IR-THR", "iraq": "IQ", "baghdad": "IQ-BGD", "syria": "SY", "damascus": "SY-DAM", "lebanon": "LB", "beirut": "LB-BEY",
    "saudi arabia": "SA", "riyadh": "SA-RUH", "turkey": "TR", "ankara": "TR-ANK", "istanbul": "TR-IST", "india": "IN", "new delhi": "IN-DEL",
    "mumbai": "IN-BOM", "japan": "JP", "tokyo": "JP-TYO", "south korea": "KR", "seoul": "KR-SEL", "north korea": "KP", "taiwan": "TW",
    "taipei": "TW-TPE", "australia": "AU", "canada": "CA", "mexico": "MX", "brazil": "BR", "egypt": "EG", "cairo": "EG-CAI", "gaza": "PS-GZA",
    "west bank": "PS-WBK", "palestine": "PS", "middle east": "MENA", "european union": "EU", "global": "GLOBAL", "worldwide": "GLOBAL",
    "nationwide": "US",
}
# Policy domains named in a classification, first match wins, and their dimensions.
POLICY_WORDS = (
    ("immigration", ("immigration",)), ("fiscal_policy", ("fiscal", "tax", "budget")), ("regulation", ("regulation", "regulatory")),
    ("social_policy", ("social", "abortion", "lgbtq")), ("criminal_justice", ("criminal", "police", "crime")),
    ("foreign_policy", ("foreign", "military", "defense")), ("labor", ("labor", "worker", "union")),
    ("environment", ("environment", "climate", "energy")), ("executive_power", ("executive", "president")),
    ("corporate_governance", ("corporate", "antitrust")),
)
DIMENSIONS = {
    "immigration": "social", "fiscal_policy": "economic", "regulation": "economic", "social_policy": "social", "criminal_justice": "social",
    "foreign_policy": "foreign", "labor": "economic", "environment": "economic", "executive_power": "executive", "corporate_governance": "economic",
}

# The event types.
EVENT_TYPES = (
    "MILITARY_ACTION", "ARMED_CONFLICT", "TERRORIST_ATTACK", "ELECTION", "LEGISLATION", "INDICTMENT", "DIPLOMACY", "ECONOMIC_EVENT", "NATURAL_DISASTER",
    "PUBLIC_HEALTH", "POLICY_CHANGE", "PROTEST", "APPOINTMENT", "INVESTIGATION", "INFRASTRUCTURE", "SCIENCE_TECH", "ENVIRONMENTAL", "SOCIAL_CULTURAL", "ANALYSIS", "OTHER",
)

# Labels, weights and thresholds.
LABELS = ("SUPPORTED", "CONTRADICTED", "MIXED", "UNKNOWN", "NOT_CHECKABLE", "OPINION", "NEUTRAL", "OTHER")
TIER_WEIGHT = {"T1": 1.0, "T2": 0.85, "T3": 0.70, "T4": 0.45, "T5": 0.20}
EVIDENCE_SIM, EVIDENCE_KEEP, EVIDENCE_FETCH, NEAR_DUPLICATE = 0.25, 5, 8, 0.92
SCOPE_JACCARD, SCOPE_SIM, SCOPE_LEGAL, SCOPE_EVENT, SCOPE_FAIL_CAP = 0.12, 0.55, 0.18, 0.15, 0.55
MIXED_MIN, MIXED_DELTA, CONTRADICT_MIN, SUPPORT_MIN, LOW_TIER_CAP, LOW_TIER_RANK = 0.50, 0.25, 0.55, 0.50, 0.60, 4
CRITICAL_RANK, CRITICAL_CONF, HIGH_RANK, HIGH_CONF = 2, 0.30, 3, 0.40
VOTE_SUPPORT, VOTE_CONTRADICT, VOTE_MIXED, MIXED_MASS, VOTE_CUT = 1.0, 1.2, 0.1, 0.9, 0.6
INTEGRITY_CONTRADICT, INTEGRITY_MIXED, MIN_SCORED, MIN_EVIDENCE = 1.2, 0.25, 3, 3
IRT_STEPS, IRT_TOL, IRT_MAX_STEP, IRT_FLOOR, IRT_MIN_STANCES, DOMAIN_CAP = 10, 0.001, 2.0, -0.01, 2, 0.40
STANCE_LEAST, STANCE_CLEAR, SEED_ROWS = 0.30, 0.50, 50
PROP_TOP, PROP_SIM_KEYWORD, PROP_SIM_PLAIN, CROSS_DOMAIN, KEYWORD_BOOST, PROP_SEGMENTS, STANCE_MIN_TOKENS = 6, 0.32, 0.35, 0.05, 0.03, 8, 20
EVENT_SIM, EVENT_JACCARD, EVENT_GEO, EVENT_TYPE, EVENT_ACCEPT, EVENT_MIN_JACCARD, EVENT_HOURS, EVENT_KNN, EVENT_KNN_SIM = 0.55, 0.30, 0.10, 0.05, 0.55, 0.10, 72, 50, 0.4
CLUSTER_SIM, CLUSTER_MIN, CLUSTER_MAX, CLUSTER_DENSITY, CLUSTER_DOCS, CLUSTER_HOURS, CLUSTER_SEGMENTS = 0.60, 2, 15, 0.35, 200, 72, 3
CHUNK_MAX, CHUNK_MIN_FLUSH, CHUNK_SMALL, CHUNK_JOIN_BELOW, CHUNK_DROP, TOKENS_A_WORD = 200, 80, 50, 180, 30, 1.33
STATUS_STAGE = {"normalizing": "NORMALIZE", "pending": "INDEX", "classifying": "CLASSIFY", "extracting": "EXTRACT", "verifying": "EVIDENCE", "aggregated": "AGGREGATE", "enriching": "ENRICH"}
STATUS_FANOUT = {"verifying": ("EVIDENCE", "VERACITY"), "aggregated": ("AGGREGATE", "SENTIMENT", "SYNTHESIS", "IDEOLOGY", "ENRICH")}
RETRIES = {"NORMALIZE": 2, "INDEX": 3, "CLASSIFY": 3, "EXTRACT": 3, "EVIDENCE": 3, "VERACITY": 5, "AGGREGATE": 3, "SENTIMENT": 2, "SYNTHESIS": 2, "IDEOLOGY": 2, "ENRICH": 4}
BREAKER_STREAK, BREAKER_SECONDS, POISON_ATTEMPTS = 5, 300, 10
