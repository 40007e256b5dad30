import random

import pytest

from prematch.llm.tokens import _counter, count_tokens, parts

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"
TEXTS = [
    None, "", " ", "\n\n", "plain words, don't they're 12,345", "<|endoftext|> inside<|endoftext|>", "é ü ﬁ 猫犬 🙂🙂  x y",
    "a" * 3000, "tab\tand  two blanks   three", "\r\n x", "x \x1c y", "<s> </s> <unk> <|startoftext|>",
]


def told(name, texts):
    """What the library itself counts, each text on its own."""
    path = public.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        engine = SentencePieceProcessor(model_file=path)
        return [len(engine.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(path)
    return [len(engine.encode(t or "", add_special_tokens=False).ids) for t in texts]


def mixed(rnd, n):
    bits = ["the", "don't", "x9", "É", "猫", " ", "  ", "\n", "\t", ".", "(a)", "<|endoftext|>", "naïve", "12", "🙂", "'s", "ﬁ", "́", "A", "-"]
    return "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_equals_library(spark, name):
    rnd = random.Random(5)
    texts = TEXTS + [mixed(rnd, rnd.randrange(400)) for _ in range(40)]
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[5], "x", 1)] * 2
    want = sorted(zip([r[0] for r in rows], [len((t[1] or "").encode()) for t in rows], told(name, [r[1] for r in rows])), key=repr)
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (1 << 17, 60):  # long texts are split, batches are small
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df, public.path(name), part=size, batch=size * 3).collect()), key=repr)
        assert got == want


def test_very_long_texts(spark):
    rnd = random.Random(6)
    texts = [mixed(rnd, 60_000), "word " * 80_000, "x" * 300_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = [r.n_tokens for r in count_tokens(df, public.path("byte_bpe_50k.json")).orderBy("doc_id").collect()]
    assert got == told("byte_bpe_50k.json", texts)


def test_parts_give_the_text():
    lead = _counter(public.path("byte_bpe_50k.json"))[1]
    assert lead == " "
    text = "one two  three four" * 9
    cut = list(parts(text, lead, 10))
    assert "".join(cut) == text and len(cut) > 5
    assert list(parts(text, None, 10)) == [text]


def test_empty_table(spark):
    out = count_tokens(spark.createDataFrame([], SCHEMA), public.path("byte_bpe_50k.json"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens"] and out.collect() == []
