"""Authorship cuts the words of a text once and counts them by number."""

import re

from mailsieve.operators import authorship as A
from tests.test_growth import plan_of

TEXTS = [
    "One two. Two three! No. A bc? ab1 c_d é ef-gh. Ends here", "Hi. Ab cd ab cd ab cd.", "", None, " \n. x. yy　zz.　Yy zz yy",
    "the end. the end. the end.",
]


def test_words_are_cut_once(spark):
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(TEXTS)], "email_id int, subject string, text string")
    found = A.with_word_columns(df)
    plan = plan_of(found)
    assert plan.count("regexp_extract_all(") == 1 and "array_distinct(zip_with(" in plan and "lambdafunction(concat(" not in plan
    for r in found.collect():
        words = lambda t: re.findall(r"(?<!\w)[a-z]{2,}(?!\w)", t.lower())
        whole = (r.text or "").strip()
        own = words(whole)
        assert (r._n, sorted(r._counts or [])) == (len(own), sorted(own.count(w) for w in set(own)))
        assert r._pairs == len(set(zip(own, own[1:])))
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", whole)]
        assert r._lengths == [len(words(s)) for s in parts if len(s) > 5]
