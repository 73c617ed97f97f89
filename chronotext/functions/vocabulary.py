"""Vocabularies and feature names.

The word lists, period names, year ranges and column names below are FIXED
VALUES: results only agree with earlier feature tables if they stay as they are.
"""

from __future__ import annotations

# --- fixed values: target words per language -------------------------------
TARGET_WORDS = {
    "english": [
        "the", "a", "an", "of", "to", "and", "in", "that", "it", "is", "was", "for", "on", "with", "as",
        "by", "at",
    ],
    "french": [
        "le", "la", "les", "un", "une", "et", "dans", "que", "il", "elle", "est", "était", "pour", "sur",
        "avec", "comme", "par", "à",
    ],
    "german": [
        "der", "die", "das", "ein", "eine", "und", "in", "dass", "es", "war", "ist", "für", "auf", "mit",
        "als", "von", "bei",
    ],
    "spanish": [
        "el", "la", "los", "un", "una", "y", "en", "que", "es", "fue", "para", "sobre", "con", "como", "por",
        "a",
    ],
    "italian": [
        "il", "la", "i", "un", "una", "e", "in", "che", "è", "era", "per", "su", "con", "come", "da", "a",
    ],
    "portuguese": [
        "o", "a", "os", "um", "uma", "e", "em", "que", "é", "foi", "para", "sobre", "com", "como", "por",
        "a",
    ],
}

# --- fixed values: neologism terms per period ------------------------------
NEOLOGISMS = {
    "early_modern": [
        "telescope", "microscope", "thermometer", "electricity", "gravity", "atmosphere", "barometer",
        "pendulum", "optics", "newspaper", "insurance", "dividend", "mortgage", "coffee house",
        "bank account",
    ],
    "industrial": [
        "steam engine", "factory", "railway", "steamboat", "locomotive", "omnibus", "spinning jenny",
        "cotton gin", "manufacturing", "industrial", "machinery", "working class", "middle class",
        "capitalism", "socialism",
    ],
    "late_industrial": [
        "telephone", "electric light", "photograph", "telegraph", "typewriter", "phonograph", "incandescent",
        "generator", "bicycle", "automobile", "bacteria", "vaccine", "antiseptic", "kindergarten",
        "department store",
    ],
    "early_20th": [
        "radio", "television", "computer", "airplane", "aviation", "airport", "broadcasting", "movie",
        "cinema", "jazz", "teenager", "lifestyle", "celebrity", "vitamin", "hormone",
    ],
    "post_war": [
        "transistor", "satellite", "laser", "television series", "supermarket", "fast food", "highway",
        "antibiotic", "rock and roll", "civil rights", "feminism", "ecology", "space program",
        "nuclear power", "computer programming",
    ],
    "late_modern": [
        "personal computer", "software", "microwave", "video cassette", "compact disc", "cable television",
        "atm", "fax machine", "yuppie", "aerobics", "environmentalism", "franchise",
        "multinational corporation", "brand loyalty", "walkman",
    ],
    "digital_dawn": [
        "internet", "website", "email", "world wide web", "online", "download", "virtual reality", "gps",
        "cell phone", "laptop", "cd-rom", "dot-com", "millennium bug", "search engine", "browser",
    ],
    "digital_native": [
        "blog", "podcast", "tweet", "smartphone", "app", "tablet", "social media", "streaming", "viral",
        "cloud computing", "artificial intelligence", "cryptocurrency", "bitcoin", "facebook", "youtube",
    ],
}

# --- fixed values: years covered by each period, and the two period groups --
NEOLOGISM_PERIODS = {
    "early_modern": (1600, 1749),
    "industrial": (1750, 1849),
    "late_industrial": (1850, 1899),
    "early_20th": (1900, 1949),
    "post_war": (1950, 1974),
    "late_modern": (1975, 1989),
    "digital_dawn": (1990, 2004),
    "digital_native": (2005, 2024),
}
MODERN_PERIODS = ["late_modern", "digital_dawn", "digital_native"]
HISTORICAL_PERIODS = ["early_modern", "industrial", "late_industrial"]

# --- fixed values: feature column names -------------------------------------
METADATA_COLUMNS = ["file_name", "year", "decade", "century"]
COMPRESSION_FEATURES = [
    "Compression_Ratio_Order_1", "NRC_Order_1", "Entropy_Ratio_Order_1", "Shannon_Entropy",
    "Compression_Ratio_Order_2", "NRC_Order_2", "Entropy_Ratio_Order_2",
]
LEXICAL_FEATURES = [
    "Avg_Word_Length", "Lexical_Richness", "Avg_Sentence_Length", "Punctuation_Density",
    "Syllable_Per_Word", "Digit_Ratio",
]
READABILITY_FEATURES = ["Flesch_Readability", "Stopword_Ratio"]
DISTANCE_FEATURES = TARGET_WORDS["english"]
NEOLOGISM_FEATURES = [f"contains_{p}_words" for p in NEOLOGISM_PERIODS] + [
    "contains_modern_vocabulary", "contains_historical_vocabulary", "vocabulary_modernity_score",
]
DEPRECATED_FEATURES = [
    "Special_Character_Ratio", "max_anachronism_gap_years", "anachronism_word_count",
    "anachronism_density",
]
OPTIMAL_FEATURES = [
    "NRC_Order_2", "Lexical_Richness", "Avg_Sentence_Length", "Punctuation_Density",
    "Syllable_Per_Word", "Digit_Ratio", "on", "by",
    "contains_late_industrial_words", "contains_historical_vocabulary",
]

ALL_FEATURES = (
    COMPRESSION_FEATURES + LEXICAL_FEATURES + READABILITY_FEATURES
    + DISTANCE_FEATURES + NEOLOGISM_FEATURES
)

# A subset is described by the columns it keeps; what it drops follows from that.
SUBSET_FEATURES = {
    "compression": COMPRESSION_FEATURES,
    "lexical_structure": LEXICAL_FEATURES,
    "readability": READABILITY_FEATURES,
    "distance": DISTANCE_FEATURES,
    "neologism": NEOLOGISM_FEATURES,
    "final_model": ALL_FEATURES,
    "optimal": OPTIMAL_FEATURES,
}


def subset_drop_columns(subset: str) -> list[str]:
    """Columns a named subset drops. Anything not listed stays an input."""
    if subset not in SUBSET_FEATURES:
        raise ValueError(f"Unknown feature subset: {subset}. Available: {list(SUBSET_FEATURES)}")
    kept = set(SUBSET_FEATURES[subset])
    retired = [] if subset == "optimal" else ["Special_Character_Ratio"]
    return METADATA_COLUMNS + retired + [f for f in ALL_FEATURES if f not in kept]

# --- fixed values: English stop words, as the public Spark ML list has them ---
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]
