"""Fixed values of the rule set: weights, thresholds, word lists, brands and seeds."""

# --- fixed values: score weights -------------------------------------------------
WEIGHTS = {
    "homograph": 40,
    "mixed_script": 25,
    "brand_spoof": 45,
    "behavioral_threshold": 40,
    "behavioral_low": 15,
    "ip_url": 45,
    "suspicious_tld": 20,
    "url_shortener": 15,
    "multiple_urls": 10,
    "domain_blacklist": 60,
    "header_spoof": 40,
    "cyrillic_url": 50,
    "obfuscation": 35,
}

# --- fixed values: cut-offs, each used by a different consumer --------------------
LEVEL_HIGH = 75  # above: HIGH RISK
LEVEL_SUSPICIOUS = 30  # above: SUSPICIOUS
RULE_SPAM = 75  # at or above
RULE_OVERRIDE = 75  # above
DECISION_OVERRIDE = 80  # above
ALERT_WARNING = 75  # at or above
ALERT_CRITICAL = 90  # at or above
INBOX_RISK = 70  # above
BEHAVIOUR_FLAG = 50  # above
DL_CONFIDENCE = 0.7
NEIGHBOUR_DISTANCE = 0.5
NEIGHBOUR_MIN_SPAM = 2
MAX_TEXT_LENGTH = 50_000
RETENTION_DAYS = 30
DEFAULT_MODEL = "naive_bayes"

# --- fixed values: protected brands and their known variants ----------------------
BRANDS = {
    "paypal": ["paypa1", "pypal", "pay-pal", "pay.pal"],
    "google": ["g00gle", "goog1e", "googl-e"],
    "microsoft": ["mircosoft", "micros0ft", "ms-office"],
    "amazon": ["amaz0n", "amzn-service", "amazon-support"],
    "apple": ["app1e", "apple-id", "support-apple"],
    "netflix": ["netf1ix", "net-flix"],
    "binance": ["b1nance", "binance-support"],
    "metamask": ["metamask-support", "mextamask"],
}

# --- fixed values: URL rules ------------------------------------------------------
SUSPICIOUS_TLDS = [".xyz", ".top", ".click", ".gq", ".tk", ".ml", ".ga", ".cf", ".bid", ".men"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly"]
LINK_TLDS = ["com", "net", "org", "edu", "gov", "io", "biz", "info",
             "xyz", "top", "click", "gq", "tk", "ml", "ga", "cf"]

# --- fixed values: behaviour phrases ----------------------------------------------
URGENCY_WORDS = [
    "urgent", "action required", "suspended", "immediately", "act now",
    "locked", "security alert", "unauthorized", "expired", "final notice",
]
REWARD_WORDS = [
    "winner", "prize", "gift card", "reward", "lottery", "cash",
    "congratulations", "won", "free", "discount",
]

# --- fixed values: blocklist seeds ------------------------------------------------
BLOCKLIST_SEEDS = [
    ("earn-money.xyz", "Phishing TLD variation"),
    ("login-verification.top", "Credential harvesting"),
    ("gift-card-claim.click", "Reward bait domain"),
]

# --- fixed values: column aliases accepted by the loader --------------------------
TEXT_ALIASES = ["message", "email", "body", "content", "subject", "v2"]
LABEL_ALIASES = ["spam", "category", "class", "type", "v1", "target", "sentiment"]

# --- fixed values: drift thresholds -----------------------------------------------
DRIFT_SPAM_RATIO = 0.15
DRIFT_SPAM_RATIO_CRITICAL = 0.3
DRIFT_LENGTH = 0.30
DRIFT_VOCAB = 0.40
BASELINE_VOCAB = 5000

# --- fixed values: retraining thresholds ------------------------------------------
RETRAIN_LEARNER = 50
RETRAIN_SCHEDULER = 100

# --- fixed values: the customary English stop-word list ---------------------------
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't
wouldn wouldn't
""".split()
