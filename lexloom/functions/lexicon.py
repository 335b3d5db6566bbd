"""Fixed word lists, maps and texts of the code-mixed domain."""

from __future__ import annotations

# Tokens that are Hinglish whatever the context.
HINGLISH_OVERRIDE = (
    "hai", "to", "ke", "ki", "se", "ka", "ho", "ko", "aur", "bhai",
    "kar", "kya", "ek", "toh", "ab", "koi", "na", "aap", "ne", "tha",
    "tu", "thi", "jab", "hue", "band", "ni", "ham", "bt", "kr", "bal", "rh",
    "milenge", "andhere", "banwana", "karwate", "sanskriti", "sadharan",
    "sahaara", "sultani", "madrasi", "congressi", "bastiyon", "wicketo",
    "stadiumi", "hospitalo", "pakistaniyo", "pakistanio", "pakistano",
    "karaoge",
)

# Tokens whose language depends on context.
AMBIGUOUS_OVERRIDE = ("main", "maine", "me", "the")

# The starter map from Roman spellings to Devanagari forms, in lookup order.
CANONICAL_MAP = (
    ("bht", "बहुत"),
    ("bohot", "बहुत"),
    ("bahut", "बहुत"),
    ("namaste", "नमस्ते"),
    ("namaskar", "नमस्कार"),
    ("dhanyavad", "धन्यवाद"),
    ("dhanyawad", "धन्यवाद"),
    ("khabar", "खबर"),
    ("khabr", "खबर"),
    ("kya", "क्या"),
    ("hal", "हाल"),
    ("haall", "हाल"),
    ("kaise", "कैसे"),
    ("ho", "हो"),
    ("aap", "आप"),
)

# Units that may follow a number in one token.
NUMBER_UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "hr", "hrs", "min", "mins", "sec", "secs", "am", "pm", "x", "k", "rs", "inr", "usd", r"\$", "%")

# Cost classes of the weighted edit distance.
VOWELS = "aeiou"
CLOSE_PAIRS = (("v", "w"), ("z", "j"))
CLOSE_COST, VOWEL_COST, OTHER_COST = 0.1, 0.2, 1.0

# The five labels of the rules cascade and the three of an adjudicator.
LABELS = ("NON_LINGUISTIC", "AMBIGUOUS", "HINGLISH", "ENGLISH", "UNCERTAIN_NEEDS_LLM")
VERDICTS = ("ENGLISH", "HINGLISH", "AMBIGUOUS")

# The adjudicator's prompt, before and after the numbered examples.
PROMPT_HEAD = (
    "You are a language classifier for Romanized Hindi/English code-mixed text.",
    'Token: "{token}"',
    "Example sentences containing it:",
)
PROMPT_TAIL = (
    "Classify the token as exactly one of: ENGLISH, HINGLISH, AMBIGUOUS.",
    "- ENGLISH: standard English word in this context.",
    "- HINGLISH: Romanized Hindi/Hinglish word.",
    "- AMBIGUOUS: meaning/language genuinely depends on context and shifts between examples.",
    'Respond with only JSON: {"label": "...", "reason": "one line"}',
)

# Labelled tokens of the classifier's self-test.
KNOWN_HINGLISH = ("thi", "jab", "hue", "band", "ni", "kr", "bal", "rh", "bt")
KNOWN_ENGLISH = ("kiwi", "dah", "wong", "salt", "mps", "oral", "crib", "flu")

# Demonstration queries of the normaliser.
DEMO_QUERIES = ("bht dhanyawad aapka", "bohot khabr achi h", "namaste kaise ho", "swagat hai aapka", "mra laptop bht lag kr rh h")
