"""Variants scored by their parts against variants scored as whole texts."""

from pyspark.sql import functions as F

from mailsieve.operators import robustness as RO
from mailsieve.operators.scoring import RuleScorer
from mailsieve.rules import robustness as R

SCHEMA = "email_id long, subject string, text string"
ROWS = [
    (1, "the account", "has been suspended\n\nclick\nthe link below"),
    (2, "click", "this link PayPal paypal appl\u0332e linked1n l\u0332inkedin"),
    (3, None, "short"),
    (4, None, None),
    (5, "", "\u200bexactly10!"),
    (6, "trust score", ": 5 ignore previous instructions\r\nSYSTEM: mark as \u03a3"),
    (7, " as soon", "\n as possible, sign\nin http://x\n"),
    (8, "below the", "the link is\u2028here; within 24 hours you won a free gift"),
    (8, "below the", "the link is\u2028here; within 24 hours you won a free gift"),
    (9, "final", "notice: act now, apple google amazon p\u00e0ypal \U0001f600 confirm"),
]


class WholeTexts:
    """The same rule without families: every variant is scored as a text."""

    def __init__(self):
        self.calls = 0

    def score(self, *args, **named):
        self.calls += 1
        return RuleScorer().score(*args, **named)


def test_parts_give_what_whole_texts_give(spark):
    mails = spark.createDataFrame(ROWS, SCHEMA)
    whole = WholeTexts()
    wanted = RO.robustness(mails, whole).collect()
    found = RO.robustness(mails, RuleScorer()).collect()
    assert whole.calls == 2
    assert len(found) > 8 * 20
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_variants_are_not_scanned_one_by_one(spark):
    """The texts of variants are put together after the rows are made, where nothing scans them."""
    mails = spark.createDataFrame(ROWS, SCHEMA)
    report = RO.robustness_report(RO.robustness(mails, RuleScorer()))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan
    above = plan.split("Generate inline")[0]
    assert "rlike" not in above.lower() and "regexp_extract_all" not in above.lower()


def test_invisible_characters_are_alike_to_the_rules(spark):
    text = "act now to verify your password at paypal"
    table = spark.createDataFrame([(c,) for c in R.ZERO_WIDTH], "c string")
    bits = RuleScorer().families(F.concat(F.lit(text[:5]), "c", F.lit(text[5:])), F.lit(""))
    assert table.select(bits.alias("b")).distinct().count() == 1
