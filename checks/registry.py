"""All queries and their check SQL by name."""

from checks import curation, mail, streams, urls, verdicts

QUERIES = {}
ORACLE = {}
for part in (curation, urls, mail, verdicts, streams):
    QUERIES.update(part.QUERIES)
    ORACLE.update(part.ORACLE)
