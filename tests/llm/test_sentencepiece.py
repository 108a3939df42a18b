"""Piece ids against the library, round trips and edges."""

import random

import pytest
import sentencepiece

from mailsieve.llm import sentencepiece as S
from mailsieve.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def pieces():
    return S.load(PIECE_MODEL)


def texts():
    rng = random.Random(5)
    out = [
        "", " ", "  a  b", "a▁b", "\n\n x\ty", "日本語 🎉🎉 héllo", "a" * 1000, "-" * 700 + " " * 50 + "=" * 300, "\x00", "\r\n\r\n",
        "aaaa" * 100 + "b", "the the  the   the", "http://www.example.com/a?b=c",
    ]
    for _ in range(400):
        out.append("".join(rng.choice("abcdeéñ  ▁\n\t.,'-_=*日本語 the an ing ß🎉()0123456789<>/") for _ in range(rng.randint(0, 80))))
    for _ in range(30):
        out.append("".join(rng.choice("eatinosr") for _ in range(rng.randint(250, 900))))
    return out


def test_ids_are_the_librarys(spark, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = [(i, t) for i, t in enumerate(texts())]
    out = S.encode(spark.createDataFrame(rows, "doc_id long, text string"), pieces).collect()
    assert {r.doc_id: list(r.piece_ids) for r in out} == {i: model.encode(t) for i, t in rows}


def test_round_trip(spark, small, pieces):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    back = S.decode(S.encode(docs, pieces, decoded="one_pass"), pieces)
    assert back.filter("NOT (decoded <=> text) OR NOT (one_pass <=> text)").count() == 0
    rows = [(i, t) for i, t in enumerate(texts())]
    out = S.decode(S.encode(spark.createDataFrame(rows, "doc_id long, text string"), pieces), pieces).collect()
    assert {r.doc_id: r.decoded for r in out} == {i: t.replace("▁", " ") for i, t in rows}


def test_null_clash_and_empty_table(spark, pieces):
    df = spark.createDataFrame([(1, None, "x"), (1, "a", None), (1, "a", None)], "doc_id long, text string, piece_ids string")
    out = S.decode(S.encode(df, pieces), pieces, name="text")
    assert out.count() == 3 and out.filter("text IS NULL AND piece_ids IS NULL").count() == 1
    assert S.encode(df.limit(0), pieces).count() == 0


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "x.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        S.load(str(path))
