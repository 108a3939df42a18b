"""Shape of the plans: no Python in rule layers, few exchanges, no text in a shuffle."""

from checks import verdicts as V
from mailsieve.operators import curation as C
from mailsieve.operators import robustness as RO
from mailsieve.operators.scoring import RuleScorer
from mailsieve.plans.deep_analysis import Evidence, deep_analyze, mail_layers, url_rows
from mailsieve.sources.derived import AS_OF


def nodes(plan):
    """All physical operators of a plan."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def physical(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName().startswith("Adaptive") else plan


def exchanges(df):
    found = []
    for node in nodes(physical(df)):
        if node.nodeName() in ("Exchange", "BroadcastExchange"):
            out = node.output()
            found.append([out.apply(i).name() for i in range(out.size())])
    return found


def mails(spark, tmp_path):
    rows = [(1, "hi", "see http://a.com/x", "From: a@b.c", "n", "n@a.com", None, None, None, "<a href='http://b.com'>")]
    schema = """email_id long, subject string, text string, raw_headers string, from_name string, from_email string,
    mailed_by string, signed_by string, security string, email_html string"""
    path = str(tmp_path / "mails")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_mail_layers_do_not_shuffle(spark, tmp_path):
    df = mails(spark, tmp_path)
    for plan in (mail_layers(df, RuleScorer(), AS_OF), url_rows(df), RO.robustness(df, RuleScorer())):
        assert exchanges(plan) == []


def test_rule_layers_hold_no_python(spark, tmp_path):
    df = mails(spark, tmp_path)
    for plan in (deep_analyze(df, as_of=AS_OF), RO.robustness(df, RuleScorer())):
        names = " ".join(n.nodeName() for n in nodes(physical(plan)))
        assert "Python" not in names and "Arrow" not in names and "Pandas" not in names


def test_texts_stay_out_of_shuffles(spark, small, tmp_path):
    df = mails(spark, tmp_path)
    found = exchanges(deep_analyze(df, V.evidence(spark, small), as_of=AS_OF))
    moved = {name for names in found for name in names}
    # html appears only where the single-split test table is spread over the cores
    assert not moved & {"text", "email_html", "raw_headers", "page_text", "subject"}


def test_url_path_shuffles_once_without_evidence(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(deep_analyze(mails(spark, tmp_path), Evidence(), as_of=AS_OF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 2  # URL roll up by email, compact mail columns by email


def test_split_does_not_move_texts(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id", "id % 2 AS label", "repeat('x', 50) AS text").write.parquet(path)
    found = exchanges(C.stratified_split(spark.read.parquet(path), 1, "id"))
    assert all("text" not in names for names in found)


def test_scan_reads_only_needed_columns(spark, small):
    from mailsieve.sources.derived import load_table

    plan = C.sample_n(load_table(spark, small, "documents").select("doc_id", "source"), 5, 1, "doc_id")
    text = physical(plan).toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_overlap_has_no_self_join_on_runs(spark, small):
    from mailsieve.sources.derived import load_table

    plan = C.shingle_overlap(load_table(spark, small, "documents"), "doc_id")
    joins = [n for n in nodes(physical(plan)) if "Join" in n.nodeName()]
    assert len(joins) == 1  # credited counts back to the rows, by row key
    assert not any("Cartesian" in n.nodeName() or "NestedLoop" in n.nodeName() for n in joins)


def test_overlap_moves_no_row_per_run(spark, small):
    from mailsieve.sources.derived import load_table

    found = exchanges(C.shingle_overlap(load_table(spark, small, "documents"), "doc_id"))
    assert not any(name.startswith("_run") for names in found for name in names)
    assert any(set(names) == {"part", "blob"} for names in found)
