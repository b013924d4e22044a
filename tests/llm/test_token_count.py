import random

import public_tokenizers
from sentencepiece import SentencePieceProcessor

from corvane.llm.token_count import count_tokens, load_model, split_text

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_lengths_are_those_of_the_library_for_whole_texts(spark):
    long_text = "the quick  brown fox\n jumps ▁ over <s> naïve 日本語 " * 900
    texts = ["", " ", "a b", "<s> x </s>", "x" * 5000, long_text, None, "a b", "  lead", "trail  ", "\n\n"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    model = SentencePieceProcessor(model_file=PATH)
    for split in (50, 200_000):
        got = {r.doc_id: r for r in count_tokens(df, PATH, split_bytes=split, batch_bytes=100).collect()}
        for i, t in enumerate(texts):
            n = len(model.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_parts_lose_only_the_spaces_at_cuts():
    text = "ab cd  ef ▁ gh " * 20
    assert " ".join(p for p, _ in split_text(text, 7)) == text
    assert split_text("x" * 100, 7) == [("x" * 100, 0)]


def test_texts_without_spaces_are_split(spark):
    model, safe, pairs = load_model(PATH)
    assert safe and pairs
    rng = random.Random(2)
    texts = ["".join(rng.choices("日本語中文字漢字かなカナ、。", k=3000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)), "".join(rng.choices("กขคงจฉชซ", k=3000)), "words and " * 50 + "無" * 2000 + " then more words" * 40]
    for t in texts:
        parts = split_text(t, 200, pairs)
        assert sum(len(model.encode(p)) - n for p, n in parts) == len(model.encode(t))
    assert all(len(split_text(t, 200, pairs)) > 5 for t in texts[:3])
