"""Fixed values of the header layer."""

# Brands in the order they are tried, with the domains they send from.
BRAND_DOMAINS = {
    "paypal": ["paypal.com"],
    "amazon": ["amazon.com", "amazon.co.uk", "amazon.in"],
    "apple": ["apple.com", "icloud.com"],
    "microsoft": ["microsoft.com", "outlook.com", "live.com", "hotmail.com"],
    "google": ["google.com", "gmail.com", "googlemail.com"],
    "netflix": ["netflix.com"],
    "facebook": ["facebook.com", "fb.com", "meta.com"],
    "instagram": ["instagram.com"],
    "twitter": ["twitter.com", "x.com"],
    "chase": ["chase.com", "jpmchase.com"],
    "wellsfargo": ["wellsfargo.com"],
    "bankofamerica": ["bankofamerica.com"],
    "citibank": ["citibank.com", "citi.com"],
    "barclays": ["barclays.com", "barclays.co.uk"],
    "dhl": ["dhl.com", "dhl.de"],
    "fedex": ["fedex.com"],
    "ups": ["ups.com"],
    "linkedin": ["linkedin.com", "e.linkedin.com"],
    "dropbox": ["dropbox.com"],
    "ebay": ["ebay.com"],
    "docusign": ["docusign.com", "docusign.net"],
}

# Patterns of mass mailers.
SUSPICIOUS_MAILERS = [
    "phpmailer", "swiftmailer", "sendmail.*modified", "mass ?mailer", "bulk ?mail",
    "turbomail", "interspire", "emailjet.*beta", "unknown", "python-requests", "curl",
]

# Free and throwaway mail domains.
FREE_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "protonmail.com",
    "tutanota.com", "guerrillamail.com", "tempmail.com", "mailinator.com", "yopmail.com",
    "dispostable.com", "throwam.com", "10minutemail.com", "sharklasers.com",
    "guerrillamailblock.com",
]

MAX_HOPS = 7
MAX_DAYS_AHEAD = 7
MAX_DAYS_BACK = 90

# Points are hundredths of the risk score.
POINTS = {
    "spf_fail": 30, "spf_softfail": 15, "dkim_fail": 25, "dmarc_fail": 20, "no_auth": 10,
    "reply_to": 25, "return_path": 15, "spoof": 35, "many_hops": 10, "no_hops": 10,
    "mailer": 15, "date": 10, "free_domain": 5,
}
SUSPICIOUS_AT = 25
