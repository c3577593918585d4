"""Fixed values. Results depend on every entry here, so none may be changed, added or dropped.

Word lists, valences, patterns and thresholds are data, kept as plain text in their natural order.
Regular expressions use the usual escapes (``\\b``, ``\\s``, ``\\d``) with Unicode meaning;
``functions.text.unicode_regex`` turns them into the explicit classes that Java needs.
"""

from datetime import date

# --- study defaults -------------------------------------------------------------------------
CUTOFF = date(2022, 10, 27)
PERIODS = ("pre", "post")
SEED = 7
POSTS_PER_PERIOD = 20000
TOPICS = 8
BOOTSTRAP_DRAWS = 500
COPIES_PER_AUTHOR = 3
Z_95 = 1.96

# --- sentiment labels -----------------------------------------------------------------------
SENTIMENTS = ("negative", "neutral", "positive")
SOURCE_LABELS = {"0": "negative", "2": "neutral", "4": "positive"}
MODEL_LABELS = {"label_0": "negative", "label_1": "neutral", "label_2": "positive"}
LABEL_THRESHOLD = 0.05

# --- post schema ----------------------------------------------------------------------------
POST_COLUMNS = ("post_id", "text", "created_at", "source", "author_hash")
USER_COLUMNS = ("username_encoded", "username", "user")

# --- masking and text views -----------------------------------------------------------------
HANDLE_PATTERN = r"(?<![\w@])@\w{1,30}"
LINK_PATTERN = r"(?:https?://|www\.)\S+"
TOPIC_TOKEN_PATTERN = r"[a-z][a-z']{2,}"
STOP_WORDS = tuple(
    """
a about above after again all also am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers him his how i
if in into is it its itself just me more most my no nor not of off on once only or other our out over own same she
should so some such than that the their them then there these they this those through to too under until up very was
we were what when where which while who whom why will with would you your yours rt amp http user im dont cant get got
one like
""".split()
)

# --- quality rules --------------------------------------------------------------------------
ENGLISH_HINTS = (
    "the", "a", "an", "is", "are", "was", "to", "and", "of", "in", "it", "i", "you", "this", "that",
    "my", "for", "on", "with", "not", "be", "have", "just", "so", "me", "we", "they", "what", "no",
)
SPAM_PATTERNS = (
    r"\b(?:free|win)\b.{0,30}\b(?:crypto|bitcoin|nft|airdrop|giveaway|followers)\b",
    r"\bfollow\s+(?:me|back)\b.{0,40}\b(?:follow|dm|retweet)\b",
    r"\b(?:dm|click)\b.{0,20}\b(?:link|bio)\b.{0,30}\b(?:earn|profit|\$\d+)",
)
SPAM_HASHTAGS = 6
SPAM_LINKS = 3

# --- lexicon scorer -------------------------------------------------------------------------
VALENCE = {
    "good": 1.9, "great": 3.1, "excellent": 3.2, "amazing": 2.8, "awesome": 3.1, "love": 3.2, "loved": 2.9,
    "like": 1.5, "nice": 1.8, "happy": 2.7, "glad": 2.0, "fun": 2.3, "best": 3.2, "better": 1.9, "fair": 1.3,
    "win": 2.8, "won": 2.7, "fixed": 1.2, "helpful": 1.8, "useful": 1.9, "fantastic": 2.6, "enjoy": 2.2,
    "thanks": 1.9, "thank": 1.5, "beautiful": 2.9, "free": 1.0, "safe": 1.9, "improved": 1.9, "accurate": 1.6,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "hated": -3.2, "worst": -3.1, "worse": -2.1,
    "sad": -2.1, "angry": -2.3, "broken": -1.9, "unfair": -2.1, "lost": -1.3, "lose": -1.7, "boring": -1.3,
    "annoying": -1.8, "dead": -3.3, "scary": -2.2, "toxic": -2.4, "fake": -2.1, "wrong": -2.1, "ugly": -2.3,
    "suspended": -1.5, "banned": -1.8, "censored": -1.9, "censorship": -1.6, "abuse": -3.2, "harassment": -2.6,
    "spam": -1.5, "scam": -2.5, "lies": -1.8, "misinformation": -1.6, "disappointed": -1.9, "disappointing": -2.2,
    "mess": -1.5, "chaos": -1.9, "fail": -2.5, "failed": -2.3, "slow": -1.0, "crashed": -1.7, "missing": -1.2,
}
NEGATORS = (
    "not", "no", "never", "nothing", "nobody", "none", "neither", "nor", "without", "cannot",
    "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "can't", "won't", "ain't",
    "dont", "doesnt", "didnt", "isnt", "cant", "wont",
)
INTENSIFIERS = ("very", "so", "really", "extremely", "totally", "super", "absolutely", "incredibly", "too")
CAPITALS_FACTOR = 1.5
INTENSIFIER_FACTOR = 1.3
NEGATION_FACTOR = -0.74
NEGATION_REACH = 3
AFTER_BUT_FACTOR = 1.5
BEFORE_BUT_FACTOR = 0.5
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 3
COMPOUND_NORM = 15.0

# --- moderation talk ------------------------------------------------------------------------
PATTERN_CATEGORIES = {
    "account_action": (
        r"suspend(?:ed|s|ing)?", r"suspensions?", r"shadow[- ]?bann?(?:ed|ing|s)?", r"bann?(?:ed|ing|s)?",
        r"deplatform(?:ed|ing|s)?", r"reinstat(?:ed|e|ing)",
        r"(?:account|profile)s? (?:was |got |is )?(?:locked|restricted|limited|suspended)",
    ),
    "content_action": (
        r"community notes?", r"fact[- ]?check(?:ed|s|ing|ers?)?", r"(?:labell?ed|flagged) as (?:misleading|false)",
        r"(?:tweet|post|reply|thread|account)s? (?:was |were |got |has been )?(?:removed|deleted|taken down|hidden)",
        r"content warnings?",
    ),
    "policy_and_speech": (
        r"free speech", r"freedom of speech", r"censor(?:ship|ed|ing|s)?", r"content moderation",
        r"moderation (?:rules?|polic(?:y|ies)|team|reports?)",
        r"moderat(?:ors?|ion team)", r"hate speech", r"(?:mis|dis)information", r"trust and safety",
        r"terms of service", r"community guidelines",
    ),
    "verification": (r"blue (?:checks?|ticks?|checkmarks?)", r"verification", r"paid verification"),
}
BASELINE_TERMS = (
    "ban", "suspend", "censor", "kill", "rape", "sex", "removed", "deleted", "illegal", "moderation",
    "free speech", "fact check", "misinformation", "hate", "verified", "blue check",
)

# --- topic vocabulary -----------------------------------------------------------------------
MIN_DOCUMENTS = 2
MAX_DOCUMENT_SHARE = 0.5
