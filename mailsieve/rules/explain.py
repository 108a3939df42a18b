"""Fixed values of the explanation layer."""

# Risk families in order, each with its patterns. \b is a word edge,
# \w a letter, digit or underscore, \S anything but white space, \d a digit.
FAMILIES = {
    "urgency": [
        r"\burgent\b", r"\bimmediately\b", r"\bact now\b", r"\bwithin \d+ hours?\b",
        r"\bexpires?\b", r"\bdeadline\b", r"\bas soon as possible\b", r"\basap\b",
        r"\blimited time\b", r"\blast chance\b", r"\bfinal (notice|warning|reminder)\b",
    ],
    "credential_request": [
        r"\bverify\b", r"\bconfirm\b", r"\bvalidate\b", r"\bupdate (your )?account\b",
        r"\bclick here\b", r"\bsign in\b", r"\blog in\b", r"\bpassword\b", r"\bpin\b",
        r"\bcredentials?\b", r"\bsecurity code\b", r"\botp\b", r"\bsocial security\b",
        r"\bcredit card\b",
    ],
    "threat": [
        r"\bsuspended?\b", r"\bterminated?\b", r"\bblocked?\b", r"\bcompromised?\b",
        r"\bunauthorized\b", r"\bfraud\b", r"\bbreached?\b", r"\bdetected\b",
        r"\bviolat\w+\b", r"\bsuspicious activity\b", r"\baccount (will be|has been)\b",
    ],
    "reward": [
        r"\bwon\b", r"\bwinner\b", r"\bcongratulations?\b", r"\bprize\b", r"\breward\b",
        r"\bgift\b", r"\bfree\b", r"\bunclaimed\b", r"\bcash\b", r"\blottery\b",
        r"\bselected\b",
    ],
    "brand_impersonation": [
        r"\bpaypal\b", r"\bamazon\b", r"\bnetflix\b", r"\bapple\b", r"\bmicrosoft\b",
        r"\bgoogle\b", r"\bfacebook\b", r"\binstagram\b", r"\btwitter\b", r"\bchase\b",
        r"\bbank of america\b", r"\bwells fargo\b", r"\bciti\b", r"\bbarclays\b",
        r"\bdhl\b", r"\bfedex\b", r"\bups\b", r"\blinkedin\b", r"\bdropbox\b",
    ],
    "suspicious_url": [
        r"https?://\S+", r"\bclick\b.*\blink\b", r"\bbelow\b.*\blink\b",
        r"\bfollowing link\b", r"\bbutton below\b",
    ],
}
# The families whose patterns score single words.
WORD_FAMILIES = ["urgency", "credential_request", "threat", "reward", "brand_impersonation"]

# Label and sentence of each family.
LABELS = {
    "urgency": "urgency / time pressure",
    "credential_request": "credential / account request",
    "threat": "threat / account suspension",
    "reward": "reward / prize lure",
    "brand_impersonation": "brand impersonation",
    "suspicious_url": "suspicious URL / link",
}

EXPLANATIONS = {
    "urgency": "• Urgency / time-pressure language detected — a hallmark of phishing emails designed to rush the recipient.",
    "credential_request": "• Credential or account-action request found — phishing emails frequently ask recipients to verify, confirm, or log in.",
    "threat": "• Threat / account-suspension language detected — fear-based manipulation is a common social engineering tactic.",
    "reward": "• Reward / prize lure present — unexpected winnings are a classic phishing hook.",
    "brand_impersonation": "• Known brand name detected — phishing emails commonly impersonate trusted brands to gain credibility.",
    "suspicious_url": "• Suspicious link or click-through instruction present — phishing relies on directing victims to fraudulent pages.",
}

WORD_SCORE = 0.85
PHRASE_SCORE = 0.75
BASE_SCORE = 0.05
HIGHLIGHT_AT = 0.55
TOP_TOKENS = 10
