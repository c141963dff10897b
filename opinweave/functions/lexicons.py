"""Fixed word lists and lookup tables used by the labellers."""

from __future__ import annotations

# Keyword -> weight. A keyword with a space is a phrase.
POSITIVE_KEYWORDS = {
    "good": 2, "best": 3, "fast": 2, "great": 3, "good service": 4, "friendly": 2,
    "user friendly": 4, "excellent": 4, "love": 3, "fast delivery": 4, "recommend": 3,
    "service good": 4, "best food": 4, "amazing": 4, "satisfied": 3, "awesome": 4,
    "good food": 4, "recommended": 3, "good app": 4, "quick": 2, "delicious": 3,
    "app good": 4, "helpful": 2, "highly recommend": 5, "delivery fast": 4, "faster": 2,
    "good experience": 4, "happy": 3, "excellent service": 5, "quick easy": 4,
    "super fast": 4, "fresh": 2, "delivery good": 4, "great service": 4, "really good": 4,
    "good delivery": 4, "best service": 5, "loved": 3, "love app": 4, "food good": 4,
    "great app": 4, "highly recommended": 5, "best wishes": 2, "best app": 4,
    "best luck": 2, "friendly interface": 4, "quickly": 2, "satisfied service": 4,
    "easy delicious": 4, "best delivery": 4, "perfect": 4, "outstanding": 4,
    "fantastic": 4, "wonderful": 4, "smooth": 3, "reliable": 3, "convenient": 3,
    "efficient": 3, "responsive": 3, "professional": 3,
}

# Keyword -> weight.
NEGATIVE_KEYWORDS = {
    "worst": 4, "bad": 3, "worst app": 5, "poor": 3, "late": 3, "worst food": 5,
    "wrong": 3, "bad experience": 4, "worst experience": 5, "problem": 3,
    "bad service": 4, "worst service": 5, "poor service": 4, "scam": 5,
    "disappointed": 3, "service bad": 4, "fake": 4, "bad app": 4, "cold": 3,
    "late delivery": 4, "delay": 3, "worst customer": 5, "worst delivery": 5, "later": 2,
    "missing": 3, "fraud": 5, "bad food": 4, "late night": 2, "error": 3, "app worst": 5,
    "service worst": 5, "problems": 3, "bad delivery": 4, "crashes": 4, "app bad": 4,
    "problem problem": 4, "service poor": 4, "poor app": 4, "bad customer": 4,
    "delayed": 3, "rude": 3, "wrong order": 4, "went wrong": 4, "cold food": 4,
    "poor delivery": 4, "poor customer": 4, "minutes later": 2, "late hours": 2,
    "time late": 2, "wrong delivery": 4, "terrible": 4, "horrible": 4, "awful": 4,
    "disgusting": 4, "useless": 4, "waste": 4, "never again": 5, "avoid": 4,
    "unprofessional": 4, "slow": 3, "not working": 4,
}

# Emoji that count for a polarity, and their weight.
NEGATIVE_EMOJI = ["😡", "🤬", "💩", "😠", "😤", "😞", "😢", "😭", "👎", "💔", "😒", "😩"]
POSITIVE_EMOJI = [
    "😍", "🥰", "🤩", "😊", "👍", "❤️", "🔥", "⭐", "🌟", "✅", "🎉", "😎", "🙌", "💫",
]
EMOJI_WEIGHT = 4

# Fixed values: (theme, subtheme) in rank order; ties go to the earlier row.
THEME_PAIRS = [
    ("Reliability & Technical Performance", "Bugs & Glitches"),
    ("Reliability & Technical Performance", "Frequent App Crashes"),
    ("Reliability & Technical Performance", "OTP Failures"),
    ("Reliability & Technical Performance", "Slow/Laggy"),
    ("Reliability & Technical Performance", "Payment & Server Errors"),
    ("App Usability & UX", "Beautiful App Design"),
    ("App Usability & UX", "Poor Design & Layout"),
    ("App Usability & UX", "Complex Navigation"),
    ("Delivery Service", "Quick Delivery"),
    ("Delivery Service", "Extreme Delays"),
    ("Delivery Service", "No Live Tracking"),
    ("Delivery Service", "Limited Delivery Zones"),
    ("Customer Service", "Ineffective Helpline"),
    ("Customer Service", "Unhelpful Staff"),
    ("Customer Service", "Ignored Complaints"),
    ("Pricing & Value", "Hidden Costs"),
    ("Pricing & Value", "Fake Discounts"),
    ("Pricing & Value", "Perceived Overpricing"),
    ("Food Quality & Availability", "Good Food"),
    ("Food Quality & Availability", "Poor Taste"),
    ("Food Quality & Availability", "Cold Food"),
    ("Food Quality & Availability", "Small Portions"),
    ("Food Quality & Availability", "Food or Restaurant Unavailable"),
    ("Trust & Ethics", "Scams & Frauds"),
    ("Trust & Ethics", "Fake Promotions"),
    ("Trust & Ethics", "Mistrust in Transactions"),
    ("Trust & Ethics", "Ethical Breaches."),
]

# The usual English stop-words (the public NLTK list without its
# apostrophe forms, which letter-only tokens can never equal).
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just
don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn
mustn needn shan shouldn wasn weren won wouldn
""".split()

# Words dropped besides the English stop-words in every term report.
REVIEW_STOPWORDS = """
app application food order delivery service restaurant review reviews rating ratings
star stars really much also would could may might one two three first second last time
times day days week weeks month months year years today yesterday tomorrow get got go
come came see saw know knew think thought take took give gave make made use used try
tried want wanted need needed like liked love loved say said tell told ask asked work
worked call called calling phone number email address please thank thanks sorry ok okay
yes yeah yep nope maybe sure fine well oh ah um uh hmm haha lol lmao rofl omg wtf
""".split()

# Words dropped only when terms are reported by theme.
THEME_REPORT_STOPWORDS = """
good bad great excellent poor worst best fuck shit damn hell crap stupid idiot moron ass
asshole bitch bastard fucking shitty damned hellish stupidly idiotically moronically
assholish bitchy bastardly
""".split()

# Words that the word tokeniser splits in two.
SPLIT_WORDS = {
    "cannot": ("can", "not"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "gimme": ("gim", "me"),
    "lemme": ("lem", "me"),
    "wanna": ("wan", "na"),
}

# Cells that a review file may hold in place of a missing text.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Sentiment codes.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
SENTIMENT_NAMES = {0: "Negative", 1: "Neutral", 2: "Positive"}

# Class index -> sentiment code, per family of class scorer.
FIVE_STAR_CLASSES = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
THREE_CLASSES = {0: 0, 1: 1, 2: 2}
TWO_CLASSES = {0: 0, 1: 2}

# Emotion labels in rank order with their chart colours.
EMOTION_COLOURS = {
    "joy": "#90EE90", "love": "#FFB6C1", "surprise": "#FFD700", "anger": "#FF6347",
    "sadness": "#87CEEB", "fear": "#DDA0DD", "optimism": "#98FB98", "disgust": "#FFA07A",
    "neutral": "#D3D3D3",
}
OTHER_COLOUR = "#808080"
EMOTIONS = list(EMOTION_COLOURS)

# Default emotion keywords; any table of this shape can take their place.
EMOTION_KEYWORDS = {
    "joy": {"happy": 2.0, "enjoy": 2.0, "delicious": 1.5, "good": 1.0, "nice": 1.0},
    "love": {"love": 2.0, "loved": 2.0, "favorite": 1.5, "best": 1.0},
    "surprise": {"surprised": 2.0, "wow": 2.0, "unexpected": 1.5, "suddenly": 1.0},
    "anger": {"angry": 2.0, "worst": 2.0, "rude": 1.5, "useless": 1.5, "scam": 1.5},
    "sadness": {"sad": 2.0, "disappointed": 2.0, "sorry": 1.0, "missing": 1.0},
    "fear": {"afraid": 2.0, "worried": 2.0, "unsafe": 1.5, "fraud": 1.0},
    "optimism": {"hope": 2.0, "improve": 1.5, "hopefully": 2.0, "better": 1.0},
    "disgust": {"disgusting": 2.0, "awful": 1.5, "horrible": 1.5, "dirty": 1.5},
    "neutral": {},
}

# Seed words for naming clusters, and stand-in positive phrases.
NEGATIVE_SEEDS = ["bad", "worst", "terrible", "awful", "poor", "disappointed", "hate"]
POSITIVE_SEEDS = ["good", "great", "excellent", "amazing", "love", "best", "wonderful"]
POSITIVE_PHRASES = [
    "this is great", "excellent service", "very good", "amazing experience", "love it",
]
SEED_SIMILARITY = 0.3

# Right-closed toxicity bins.
TOXICITY_BINS = [(0.3, "Low"), (0.7, "Medium"), (1.0, "High")]


def stopwords(by: str = "sentiment") -> set[str]:
    """Stop-words for a term report by ``sentiment`` or by ``theme``."""
    if by not in ("sentiment", "theme"):
        raise ValueError(f"no stop-word list for {by!r}")
    words = set(ENGLISH_STOPWORDS) | set(REVIEW_STOPWORDS)
    return words | set(THEME_REPORT_STOPWORDS) if by == "theme" else words
