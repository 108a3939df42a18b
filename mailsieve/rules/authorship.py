"""Fixed values of the authorship statistics."""

# Phrases and weights that results are compared on.
CONNECTORS = [
    "furthermore", "moreover", "however", "therefore", "consequently", "additionally",
    "nevertheless", "nonetheless", "subsequently", "accordingly", "henceforth", "hereby",
    "in conclusion", "to summarize", "in summary", "it is important", "please note",
    "kindly", "do not hesitate", "should you have", "rest assured", "as per",
    "at your earliest convenience", "we regret to inform", "we are pleased to inform",
    "we wish to bring", "your immediate attention", "dear valued", "sincerely yours",
]

# Urgency phrases.
URGENCY = [
    "act now", "immediately", "within 24 hours", "within 48 hours",
    "account will be suspended", "account has been compromised", "verify your account",
    "confirm your identity", "click here to", "limited time", "expires soon",
    "urgent action required",
]

WEIGHTS = {
    "burstiness": 0.30, "perplexity": 0.25, "vocabulary": 0.15, "repetition": 0.15,
    "formality": 0.15,
}
WRITTEN_BY_AI_AT = 0.55
MIN_WORDS = 10
