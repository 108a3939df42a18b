"""Fixed values of the URL layer."""

# Suffixes, brands, domains and messages that results are compared on.
SUSPICIOUS_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".buzz", ".club", ".work",
    ".click", ".link", ".info", ".online", ".site", ".website", ".space", ".pw", ".cc",
]

IMPERSONATED_BRANDS = [
    "google", "microsoft", "apple", "amazon", "paypal", "netflix", "facebook",
    "instagram", "whatsapp", "linkedin", "dropbox", "chase", "wellsfargo",
    "bankofamerica", "citibank", "outlook", "office365", "icloud", "yahoo", "twitter",
]

LEGITIMATE_DOMAINS = {
    "google": ["google.com", "google.co.in", "googleapis.com"],
    "microsoft": ["microsoft.com", "live.com", "outlook.com"],
    "apple": ["apple.com", "icloud.com"],
    "amazon": ["amazon.com", "amazon.in", "amazonaws.com"],
    "paypal": ["paypal.com"],
    "facebook": ["facebook.com", "fb.com"],
    "instagram": ["instagram.com"],
}

LOOKALIKE_DIGITS = {"0": "o", "1": "l", "3": "e", "5": "s"}

LONG_URL = 200
MANY_DOTS = 3
NEW_DOMAIN_DAYS = 30
YOUNG_DOMAIN_DAYS = 180
CERTIFICATE_WARNING_DAYS = 7

# Points are hundredths of the risk score.
POINTS = {
    "ip": 20, "tld": 15, "brand": 25, "dots": 10, "long": 5, "at": 15, "slashes": 5,
    "digit": 15, "http": 10, "new_domain": 25, "young_domain": 10, "bad_tls": 20,
    "per_vendor": 5, "vendors_max": 30,
}
SUSPICIOUS_AT = 30
