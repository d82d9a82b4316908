"""Fixed values.

Word lists, lookup tables, thresholds, patterns and label texts that results
depend on. They are data, not logic: every rule that uses them lives elsewhere.
"""

# --- feed layouts: zero-based ordinal -> column ------------------------------
EVENT_FEED_WIDTH = 61
EVENT_FEED_COLUMNS = {
    0: "EVENT_ID",
    1: "DATE",
    6: "MAIN_ACTOR",
    7: "ACTOR_COUNTRY_CODE",
    29: "EVENT_CATEGORY_CODE",
    30: "IMPACT_SCORE",
    31: "ARTICLE_COUNT",
    34: "SENTIMENT_SCORE",
    60: "NEWS_LINK",
}
GKG_FEED_WIDTH = 27
GKG_FEED_COLUMNS = {
    0: "GKG_ID",
    1: "DATE",
    3: "SOURCE",
    7: "THEMES",
    11: "PERSONS",
    12: "ORGS",
    15: "TONE",
    17: "GCAM",
}
EVENT_SLOT_SUFFIX = ".export.CSV.zip"
GKG_SLOT_SUFFIX = ".gkg.csv.zip"

# --- emotion dictionary codes -> emotion name --------------------------------
GCAM_EMOTIONS = {
    "c9.1": "fear",
    "c9.2": "anger",
    "c9.3": "sadness",
    "c9.4": "joy",
    "c9.5": "disgust",
    "c9.6": "surprise",
    "c9.7": "trust",
    "c9.8": "anticipation",
    "c18.1": "anxiety",
    "c18.2": "hostility",
    "c18.3": "depression",
}
# order in which equal top scores are resolved
BASIC_EMOTIONS = [
    "fear", "anger", "sadness", "joy", "disgust", "surprise", "trust", "anticipation",
]
# emotions averaged per day (disgust and surprise are left out)
DAILY_EMOTIONS = [
    "fear", "anger", "sadness", "joy", "trust", "anticipation",
    "anxiety", "hostility", "depression",
]
RADAR_EMOTIONS = ["fear", "anger", "sadness", "joy", "trust", "anxiety", "anticipation"]

# --- theme code -> label, in matching order ----------------------------------
THEME_LABELS = {
    "TAX_FNCACT": "Finance",
    "EPU_POLICY": "Policy",
    "TAX_ETHNICITY": "Ethnicity",
    "TAX_WORLDLANGUAGES": "Languages",
    "CRISISLEX_CRISISLEXREC": "Crisis",
    "UNGP_FORESTS_RIVERS": "Environment",
    "USPEC_POLITICS_GENERAL1": "Politics",
    "TAX_ECON_PRICE": "Economy",
    "GENERAL_GOVERNMENT": "Government",
    "MANMADE_DISASTER_IMPLIED": "Disaster",
    "EPU_ECONOMY_HISTORIC": "History",
    "EDUCATION": "Education",
    "SOC_POINTSOFINTEREST": "Society",
    "GENERAL_HEALTH": "Health",
    "LEADER": "Leadership",
    "TERROR": "Security",
    "PROTEST": "Protests",
    "MILITARY": "Military",
    "ARREST": "Law",
    "KILL": "Conflict",
}
# prefixes dropped from a title-cased theme, in this order
THEME_PREFIXES = ["Tax ", "Epu ", "Soc ", "Wb ", "Ungp ", "Uspec ", "Crisislex "]

# --- headline rules ----------------------------------------------------------
TRUSTED_DOMAINS = [
    "reuters.com", "bbc.com", "apnews.com", "nytimes.com", "wsj.com",
    "theguardian.com", "bloomberg.com", "ft.com", "economist.com",
    "washingtonpost.com", "cnn.com", "npr.org", "aljazeera.com",
]
SKIP_SEGMENTS = [
    "index", "home", "page", "article", "news", "post", "featured",
    "content", "story", "read", "view", "watch", "amp", "mobile",
]
GENERIC_OPENINGS = [
    "business online", "full list", "read more", "click here",
    "view gallery", "photo gallery", "see also", "related",
    "breaking news", "just in", "developing story",
]
TICKER_OPENINGS = ["live updates", "live blog", "breaking:", "watch live", "as it happened"]
SMALL_WORDS = [
    "a", "an", "the", "and", "but", "or", "for", "nor", "on", "at",
    "to", "by", "in", "of", "up", "as", "is", "it", "so", "be",
]
# a URL segment matching any of these (ignoring case) holds no headline
SEGMENT_REJECTS = [
    r"^[a-f0-9]{8}[-][a-f0-9]{4}",
    r"^[a-f0-9\-]{20,}$",
    r"^(article|post|item|id)[-_]?[a-f0-9]{6,}",
    r"^\d{10,}$",
    r"^\d+$",
    r"^[A-Z]{2,5}\s*\d{5,}",
]
SEGMENT_EXTENSION = r"\.(html?|php|aspx?|jsp|shtml|amp)$"
SEGMENT_LEADING = [
    r"^\d{8}[-_]?",
    r"^\d{4}[-/]\d{2}[-/]\d{2}[-_]?",
    r"^\d{4}[-_]",
    r"^[a-f0-9]{6,8}[-_]",
]
SEGMENT_TRAILING_NUMBER = r"\s+\d{5,}$"
SEGMENT_TRAILING_HEX = r"\s+[a-f0-9]{8,}$"
SEGMENT_TRAILING_SHORT_NUMBER = r"\s+\d{1,8}$"
EDGE_PUNCTUATION = r"""[.,;:'"!?\-_\s]"""
HEADLINE_LONG_DIGITS = r"\d{8,}"
HEADLINE_TRAILING = [
    r"[A-Za-z]?\d{6,}[A-Za-z]*$",
    r"\d+[A-Za-z]?$",
    r"\s+\d+$",
]
TRUNCATED_PREPOSITION = r"\s+(for|on|in|to|of|with)\s+\w{1,4}$"
TRUNCATED_AUXILIARY = (
    r"\s+(could|would|should|will|shall|may|might|must|can|has|have|had"
    r"|was|were|are|did|does|set)$"
)
CONSONANTS = "bcdfghjklmnpqrstvwxz"
HEADLINE_MAX_CHARS = 100
HEADLINE_MIN_CHARS = 25
HEADLINE_MIN_WORDS = 5

# --- search ------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.20
PREFILTER_LIMIT = 2000
MIN_ARTICLES_FOR_SEARCH = 2
MAX_KEYWORDS = 8
SEARCH_STOP_WORDS = [
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "about", "tell", "me",
    "show", "find", "get", "give", "any", "some", "all", "most", "many",
    "much", "more", "than", "that", "this", "these", "those", "there",
    "here", "between", "during", "recent", "latest", "events", "news",
    "happening", "going", "related",
]

# --- embedding job -----------------------------------------------------------
EMBED_BATCH = 50
EMBED_PER_RUN = 500
EMBED_MIN_ARTICLES = 3
EMBED_MAX_CHARS = 512
EMBED_MIN_CHARS_STORED = 15
EMBED_MIN_CHARS_QUERY = 10

# --- regional codes -> name --------------------------------------------------
REGIONAL_CODES = {
    "AFR": "Africa", "EUR": "Europe", "SAS": "South Asia",
    "EAS": "East Asia", "MDE": "Middle East", "OCE": "Oceania",
    "NAF": "North Africa", "WAF": "West Africa", "SAF": "Southern Africa",
    "EAF": "East Africa", "CAF": "Central Africa", "NAM": "North America",
    "SAM": "South America", "CAM": "Central America", "CAR": "Caribbean",
    "SEA": "Southeast Asia", "CAS": "Central Asia", "WEU": "Western Europe",
    "EEU": "Eastern Europe", "NEU": "Northern Europe", "SEU": "Southern Europe",
}

# --- region name -> member countries -----------------------------------------
_MIDDLE_EAST = ["ISR", "SAU", "IRN", "IRQ", "SYR", "JOR", "LBN", "ARE", "KWT", "QAT",
                "BHR", "OMN", "YEM", "PSE"]
REGION_MEMBERS = {
    "middle east": _MIDDLE_EAST,
    "mideast": _MIDDLE_EAST,
    "gulf": ["SAU", "ARE", "KWT", "QAT", "BHR", "OMN"],
    "europe": ["DEU", "FRA", "GBR", "ITA", "ESP", "NLD", "BEL", "POL", "SWE", "NOR", "DNK",
               "FIN", "AUT", "CHE", "GRC", "PRT"],
    "asia": ["CHN", "JPN", "KOR", "IND", "IDN", "THA", "VNM", "MYS", "SGP", "PHL", "PAK", "BGD"],
    "africa": ["NGA", "ZAF", "EGY", "KEN", "ETH", "GHA", "MAR", "DZA"],
}

# --- country name or nationality -> three-letter code ------------------------
COUNTRY_ALIASES = {
    "usa": "USA", "us": "USA", "america": "USA", "united states": "USA",
    "u.s.": "USA", "u.s.a.": "USA", "american": "USA", "americans": "USA",
    "uk": "GBR", "britain": "GBR", "british": "GBR", "england": "GBR",
    "great britain": "GBR", "united kingdom": "GBR",
    "russia": "RUS", "russian": "RUS", "russians": "RUS",
    "korea": "KOR", "korean": "KOR", "south korea": "KOR",
    "north korea": "PRK", "dprk": "PRK",
    "iran": "IRN", "iranian": "IRN", "persia": "IRN",
    "china": "CHN", "chinese": "CHN", "prc": "CHN",
    "uae": "ARE", "emirates": "ARE",
    "saudi": "SAU", "saudi arabia": "SAU",
    "germany": "DEU", "german": "DEU",
    "france": "FRA", "french": "FRA",
    "japan": "JPN", "japanese": "JPN",
    "india": "IND", "indian": "IND",
    "brazil": "BRA", "brazilian": "BRA",
    "canada": "CAN", "canadian": "CAN",
    "australia": "AUS", "australian": "AUS",
    "mexico": "MEX", "mexican": "MEX",
    "israel": "ISR", "israeli": "ISR",
    "palestine": "PSE", "palestinian": "PSE",
    "ukraine": "UKR", "ukrainian": "UKR",
    "taiwan": "TWN", "taiwanese": "TWN",
    "syria": "SYR", "syrian": "SYR",
    "iraq": "IRQ", "iraqi": "IRQ",
    "lebanon": "LBN", "lebanese": "LBN",
    "jordan": "JOR", "jordanian": "JOR",
    "egypt": "EGY", "egyptian": "EGY",
    "turkey": "TUR", "turkish": "TUR",
    "greece": "GRC", "greek": "GRC",
    "poland": "POL", "polish": "POL",
    "spain": "ESP", "spanish": "ESP",
    "italy": "ITA", "italian": "ITA",
    "netherlands": "NLD", "dutch": "NLD", "holland": "NLD",
    "belgium": "BEL", "belgian": "BEL",
    "sweden": "SWE", "swedish": "SWE",
    "norway": "NOR", "norwegian": "NOR",
    "finland": "FIN", "finnish": "FIN",
    "denmark": "DNK", "danish": "DNK",
    "switzerland": "CHE", "swiss": "CHE",
    "austria": "AUT", "austrian": "AUT",
    "portugal": "PRT", "portuguese": "PRT",
    "argentina": "ARG", "argentine": "ARG", "argentinian": "ARG",
    "colombia": "COL", "colombian": "COL",
    "chile": "CHL", "chilean": "CHL",
    "peru": "PER", "peruvian": "PER",
    "venezuela": "VEN", "venezuelan": "VEN",
    "cuba": "CUB", "cuban": "CUB",
    "philippines": "PHL", "filipino": "PHL",
    "indonesia": "IDN", "indonesian": "IDN",
    "malaysia": "MYS", "malaysian": "MYS",
    "singapore": "SGP", "singaporean": "SGP",
    "thailand": "THA", "thai": "THA",
    "vietnam": "VNM", "vietnamese": "VNM",
    "pakistan": "PAK", "pakistani": "PAK",
    "bangladesh": "BGD", "bangladeshi": "BGD",
    "nigeria": "NGA", "nigerian": "NGA",
    "kenya": "KEN", "kenyan": "KEN",
    "south africa": "ZAF",
    "morocco": "MAR", "moroccan": "MAR",
    "algeria": "DZA", "algerian": "DZA",
    "ethiopia": "ETH", "ethiopian": "ETH",
    "ghana": "GHA", "ghanaian": "GHA",
}

# --- score bands: (upper bound, label), last entry is the open band ----------
# inclusive bounds are compared with <=, exclusive ones with <
IMPACT_BANDS = [
    (-8, True, "🔴 Severe Crisis"),
    (-5, True, "🔴 Major Conflict"),
    (-3, True, "🟠 Rising Tensions"),
    (-1, True, "🟡 Minor Dispute"),
    (1, False, "⚪ Neutral"),
    (3, False, "🟢 Cooperation"),
    (5, False, "🟢 Partnership"),
    (None, None, "✨ Major Agreement"),
]
IMPACT_UNKNOWN = "Neutral"
INTENSITY_BANDS = [
    (-8, True, "⚔️ Armed Conflict"),
    (-6, True, "🔴 Major Crisis"),
    (-4, True, "🟠 Serious Tension"),
    (-2, True, "🟡 Verbal Dispute"),
    (2, False, "⚪ Neutral Event"),
    (4, False, "🟢 Diplomatic Talk"),
    (6, False, "🤝 Active Partnership"),
    (None, None, "✨ Peace Agreement"),
]
INTENSITY_UNKNOWN = "⚪ Neutral Event"
SENTIMENT_BANDS = [
    (-5, False, "Very Negative"),
    (-2, False, "Negative"),
    (2, False, "Neutral"),
    (5, False, "Positive"),
    (None, None, "Very Positive"),
]
TONE_HISTOGRAM_BANDS = [
    (-5, False, "Crisis"),
    (-2, False, "Negative"),
    (2, False, "Neutral"),
    (5, False, "Positive"),
    (None, None, "Very Positive"),
]
WEEKLY_STATUS_BANDS = [
    (-2, False, "ELEVATED"),
    (0, False, "MODERATE"),
    (2, False, "STABLE"),
    (None, None, "POSITIVE"),
]
MOOD_BANDS = [
    (-3, False, "Very Negative"),
    (-1, False, "Negative"),
    (1, False, "Neutral"),
    (3, False, "Positive"),
    (None, None, "Very Positive"),
]
TONE_RED, TONE_AMBER, TONE_GREEN, TONE_WHITE = "🔴", "🟡", "🟢", "⚪"
