"""Fixed values of the redirect layer."""

# Link shorteners and endings that results are compared on.
SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "rb.gy", "is.gd", "shorturl.at", "tiny.cc",
]
FINAL_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".buzz"]
MAX_REDIRECTS = 3
