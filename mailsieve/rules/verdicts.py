"""Fixed values of the aggregator and the text classifier."""

# Base weight and flagging line per layer, in adding order.
LAYER_WEIGHTS = {
    "text": 0.20, "url": 0.20, "headers": 0.15, "links": 0.15, "visual": 0.15,
    "crawl": 0.10, "sender": 0.05,
}
LAYER_FLAG_AT = {
    "url": 0.35, "headers": 0.25, "links": 0.30, "visual": 0.40, "crawl": 0.40,
    "sender": 0.30,
}
AI_PHISHING_BOOST = 0.08
TWO_LAYERS_BOOST = 0.10
THREE_LAYERS_BOOST = 0.15
PHISHING_AT = 0.65
SUSPICIOUS_AT = 0.30

# Two-layer combination.
TEXT_SHARE = 0.6
URL_SHARE = 0.4
TWO_LAYER_PHISHING_AT = 0.70
TWO_LAYER_SUSPICIOUS_AT = 0.35

# Risk levels of the text classifier and its phishing classes.
HIGH_RISK_AT = 0.85
MEDIUM_RISK_AT = 0.50
CLASS_NAMES = ["legitimate_email", "phishing_url", "legitimate_url", "phishing_url_alt"]
PHISHING_CLASSES = [1, 3]

# Rows taken per corpus (source, label, quota).
QUOTAS = [
    ("enron", 0, 3000), ("spamassasin", 0, 1000), ("llm", 0, 1000), ("nazario", 1, 1000),
    ("nigerian_fraud", 1, 1000), ("phishing_email", 1, 1500), ("llm", 1, 1000),
    ("human", 1, 500),
]
# Rows per source and label of the corpus's first version.
FIRST_QUOTAS = [
    ("enron", 0, 1500), ("spamassasin", 0, 500), ("llm", 0, 1000), ("nazario", 1, 500), ("nigerian_fraud", 1, 500),
    ("phishing_email", 1, 500), ("llm", 1, 1000), ("human", 1, 1000),
]
MIN_TEXT_LENGTH = 50
