"""Word pieces at the same place, without place or token, and the plan that joins them."""

from mailsieve.operators import explain as X
from tests.test_plans import exchanges, nodes, physical

SCHEMA = "email_id long, pos long, token string, score double"
ROWS = [
    (1, 0, "ve", 0.1), (1, 1, "##ri", 0.9), (2, 5, "##x", 0.3), (1, 2, "##fy", None), (1, 3, "now", 0.2),
    (3, 1, "a", 0.1), (3, 1, "b", 0.2), (3, 1, "##c", 0.3), (3, 2, "##d", 0.4), (3, 9, "##", None),
    (4, None, "no", 0.5), (4, 1, "##where", 0.6), (4, 2, None, 0.7), (None, 1, "un", 0.1), (None, 2, "##known", 0.2),
]
WORDS = {
    (1, 1, 0, "verify", 0.9), (1, 2, 3, "now", 0.2), (2, 0, 5, "x", 0.3), (3, 2, 1, "abcd", 0.4),
    (4, 1, 1, "nowhere", 0.6), (None, 1, 1, "unknown", 0.2),
}


def test_pieces_with_ties_and_nulls(spark):
    for parts in (1, 5):
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
        found = X.merge_wordpieces(df).select("email_id", "word_no", "pos", "token", "score").collect()
        assert len(found) == len(WORDS)
        assert {tuple(r) for r in found} == WORDS


def test_pieces_travel_packed(spark):
    merged = X.merge_wordpieces(spark.createDataFrame(ROWS, SCHEMA))
    assert "Window" not in {node.nodeName() for node in nodes(physical(merged))}
    assert exchanges(merged) == [["email_id", "pos", "continues", "t", "score"]]
    packed = spark.range(40).selectExpr("id div 10 AS k", "id", "string(id) AS t").coalesce(1).mapInArrow(
        X.pack_neighbours(), "k long, id array<long>, t array<string>"
    )
    assert [(r.k, r.id[0], len(r.id), r.t[9]) for r in packed.collect()] == [(k, 10 * k, 10, str(10 * k + 9)) for k in range(4)]
