"""Parsing of emails: sender, HTML, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import urls as U


def parse_emails(df: DataFrame) -> DataFrame:
    """Add sender, has_html and urls: URLs of the body, then those of the subject.

    A URL in both places is listed twice, as in single-mail parsing.
    """
    none = F.array().cast("array<string>")
    subject_urls = F.coalesce(U.extract_urls(F.col("subject")), none)
    return df.withColumns(
        {
            "sender": U.extract_sender(F.col("text")),
            "has_html": U.has_html(F.col("text")),
            "urls": F.concat(U.extract_urls(F.col("text")), subject_urls),
        }
    )


def merge_html_urls(df: DataFrame) -> DataFrame:
    """Append the URLs of email_html that the text does not have."""
    extra = F.array_except(U.extract_urls(F.col("email_html")), F.col("urls"))
    return df.withColumn("urls", F.concat("urls", extra))
