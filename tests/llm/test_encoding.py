import random

import public_tokenizers
import pytest

from loomwave.llm import encoding

PATH = public_tokenizers.path("byte_bpe_50k.json")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return encoding.Vocabulary.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n \t", "Hello world", "don't WE'LL 12345 ...!?", "naïve café — “quoted” ſtrange þing", "<|endoftext|> is text", "日本語 テキスト", "\U0001f600\U0001f601 x", "a" * 5000, "ab" * 3000, "-=" * 700, "fam-\niliar line‐\nends\r\n", "\x00\x01"]


def test_texts(vocabulary, reference):
    encoder = encoding.Encoder(vocabulary)
    ids, counts = encoder.encode(TEXTS)
    at = 0
    for text, n in zip(TEXTS, counts):
        assert ids[at : at + n].tolist() == reference(text), text[:30]
        at += n
        assert encoding.decode(reference(text), PATH) == text


def test_matrix_and_single_merges_agree(vocabulary, reference):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("theaniornesß ") for _ in range(rng.randint(1, 60))).strip() or "x" for _ in range(800)]
    merger = encoding.Merger(vocabulary)
    for piece, ids in zip(pieces, merger.merge([p.encode() for p in pieces])):
        assert ids == merger.merge_one(piece.encode())


def test_table_of_pieces_is_bounded(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_PIECES", 20)
    encoder = encoding.Encoder(vocabulary)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randint(0, 99)}"]) for _ in range(6)) for _ in range(2)]
        ids, counts = encoder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in reference(t)]
        assert len(encoder.known) <= 40


def test_corpus(spark, vocabulary, reference):
    rows = [(1, "Hello world", "old"), (2, None, "old"), (3, "", "old"), (4, "  ", None), (5, "very long " * 40_000, "x"), (1, "Hello world", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encoding.encode_corpus(df, vocabulary)
    assert out.columns == ["doc_id", "text", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    assert sorted(got) == sorted((i, reference(t or "")) for i, t, _ in rows)
    assert encoding.encode_corpus(df.where("false"), vocabulary).count() == 0
    report = {r["doc_id"]: r["n_tokens"] for r in encoding.token_report(out, "doc_id").collect()}
    assert report[1] == 4 and report[2] == 0
