"""Fixed values of the sender layer."""

# Providers, brands and look-alike replacements that results are compared on.
FREE_PROVIDERS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "outlook.com",
    "hotmail.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "mac.com",
    "protonmail.com", "proton.me", "zoho.com", "yandex.com", "mail.com", "gmx.com",
    "tutanota.com", "rediffmail.com", "fastmail.com",
]

BRANDS = [
    "paypal", "amazon", "apple", "microsoft", "google", "facebook", "netflix",
    "instagram", "whatsapp", "twitter", "linkedin", "chase", "wellsfargo",
    "bankofamerica", "citibank", "hsbc", "dropbox", "adobe", "dhl", "fedex", "ups",
    "usps", "spotify", "zoom", "slack", "github", "stripe",
]

# Replacements, applied one after the other.
LOOKALIKE_STEPS = [
    ("0", "o"), ("o", "0"), ("1", "l"), ("l", "i"), ("i", "l"), ("rn", "m"), ("vv", "w"),
    ("5", "s"), ("s", "5"),
]

# Points are hundredths of the risk score.
POINTS = {
    "mailed_by": 35, "signed_by": 25, "unsigned": 15, "weak_security": 15,
    "no_security": 10, "brand_on_free": 40, "address_in_name": 30, "free": 5,
    "lookalike": 40, "no_domain": 30,
}
SUSPICIOUS_AT = 25
