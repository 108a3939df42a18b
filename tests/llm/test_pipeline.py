"""The stages on their own input, against plain code."""

import sentencepiece

import corpus_pipeline as P
from mailsieve.llm import mixing, quality_rules
from mailsieve.llm.queries import PIECE_MODEL
from mailsieve.session import written
from tests.llm.brute import near_classes, near_lines


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], small), f"test-{name}"))
        assert seen[-1].columns[: len(docs.columns)] == docs.columns
    raw, good, cut, unique, mixed, last = (x.collect() for x in seen)
    ledger = quality_rules.ledger(docs).filter(~quality_rules.failed(quality_rules.PRODUCTION))
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in ledger.collect())
    gone = near_lines([(r.doc_id, r.text) for r in good])
    texts = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in good}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut} == {i: (t, len(t)) for i, t in texts.items()}
    classes = near_classes([(r.doc_id, r.text) for r in cut])
    assert sorted(r.doc_id for r in unique) == sorted(set(classes.values()))
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3], mixing.letter_share(seen[3]["text"])).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    before = {r.doc_id: r.text for r in mixed}
    assert all(r.text == before[r.doc_id] and list(r.piece_ids) == model.encode(r.text) and r.n_pieces == len(r.piece_ids) for r in last)
    assert len(last) == len(mixed) <= 3 * len(raw)


def test_run_and_empty_table(spark, small, tmp_path):
    assert P.run(spark, small).count() > 100
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
