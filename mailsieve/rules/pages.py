"""Fixed values of the page layer."""

# Page signatures per brand as (title phrases, text phrases, own domains).
BRAND_PAGES = {
    "google": (["sign in", "google accounts", "gmail"],
               ["google", "gmail", "@gmail.com"],
               ["google.com", "accounts.google.com", "gmail.com"]),
    "microsoft": (["sign in", "microsoft", "outlook", "office 365"],
                  ["microsoft", "outlook", "office", "@outlook.com", "@hotmail.com"],
                  ["microsoft.com", "live.com", "outlook.com", "office.com"]),
    "apple": (["apple id", "sign in", "icloud"],
              ["apple id", "icloud", "@icloud.com"],
              ["apple.com", "icloud.com"]),
    "paypal": (["log in", "paypal"], ["paypal", "payment", "wallet"], ["paypal.com"]),
    "amazon": (["sign in", "amazon"], ["amazon", "prime", "aws"],
               ["amazon.com", "amazon.in", "aws.amazon.com"]),
    "facebook": (["log in", "facebook", "meta"], ["facebook", "meta", "fb"],
                 ["facebook.com", "fb.com", "meta.com"]),
    "netflix": (["sign in", "netflix"], ["netflix", "streaming"], ["netflix.com"]),
    "linkedin": (["sign in", "linkedin"], ["linkedin", "professional"], ["linkedin.com"]),
    "instagram": (["log in", "instagram"], ["instagram", "insta"], ["instagram.com"]),
    "twitter": (["log in", "x", "twitter"], ["twitter", "tweet", "x.com"],
                ["twitter.com", "x.com"]),
    "chase": (["sign in", "chase"], ["chase", "jpmorgan", "banking"], ["chase.com"]),
    "wellsfargo": (["sign on", "wells fargo"], ["wells fargo", "banking"], ["wellsfargo.com"]),
}

URGENCY_PHRASES = [
    "verify your", "confirm your identity", "account suspended", "unusual activity",
    "security alert", "action required", "expires in", "within 24 hours", "immediately",
    "unauthorized access", "account will be locked",
]

SENSITIVE_PHRASES = [
    "social security", "ssn", "credit card", "card number", "cvv", "expiry date",
    "bank account", "routing number", "mother's maiden", "date of birth",
]

CREDENTIAL_FIELD_WORDS = [
    "password", "pass", "pwd", "email", "user", "login", "ssn", "card", "credit",
]
LOGIN_FIELD_WORDS = ["email", "username", "user", "login", "signin"]

MAX_HOPS = 3

# Points are hundredths of the risk score.
POINTS = {
    "any_brand": 35, "login_and_password": 20, "password_only": 10, "brand_flag": 15,
    "foreign_form": 15, "credential_fields": 15, "urgency": 10, "sensitive": 15,
    "other_domain": 10, "many_hops": 5,
}
FAKE_LOGIN_AT = 40
CRAWL_POINTS = {"password": 70, "login": 50, "redirect": 30}
