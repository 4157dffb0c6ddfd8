import random

import numpy as np
import pytest

from pagewright.llm import bpe
from pagewright.llm.lexicon import Lexicon, compile_lexicon

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        return tokenizers.Tokenizer.from_file(path), bpe.Tokenizer(f.read())


TEXTS = [
    None, "", " \n", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ", "é fi ﬁ ½²³ Ⅷ x²", "\x1c\x1d\x85\xa0　a​b", "it's I'LL o'clock 'ſ", "漢字かな 123 ۱۲", "😀👍🏽 z̀́",
    "a" * 3000, "ab" * 5000, "hello world " * 5000,
]


def test_equals_the_library(spark, both):
    lib, tok = both
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x1F600, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x3000]]
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, ids string")
    for r in bpe.encode(df, bpe.default_tokenizer()).collect():
        want = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_lexicon_is_a_minimal_map():
    words = sorted({f"{a}{b}{c}ing".encode() for a in "abc" for b in "xyz" for c in ("", "1", "22")} | {b"a", b"ab", "é".encode()})
    data = compile_lexicon((w, [i, i * 2][: 1 + i % 2]) for i, w in enumerate(words))
    lex = Lexicon(data)
    for i, w in enumerate(words):
        assert np.frombuffer(lex.get(w), "<u4").tolist() == [i, i * 2][: 1 + i % 2]
    assert all(lex.get(w) is None for w in (b"", b"b", b"axin", b"axingg", b"zz"))
    assert lex.n_words == len(words) and lex.n_states < 40
    assert Lexicon(compile_lexicon([])).get(b"a") is None


def test_merging_abreast_equals_merging_one_by_one(both):
    _, tok = both
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeinorstéñ漢", k=rng.randint(1, 45))).encode() for _ in range(3000)] + [b"", b"a", b"a" * 32, b"a" * 33, b"ab" * 400]
    assert tok.merge_all(words) == [bpe._bytes(tok.merge(w)) if w else b"" for w in words]
    assert tok.merge_all([]) == []


def test_bounds_of_what_is_kept_change_nothing(spark, both, monkeypatch):
    lib, tok = both
    lexicon = Lexicon(compile_lexicon((w, memoryview(x).cast("I").tolist()) for w, x in zip([b"the", b"word"], tok.merge_all([b"the", b"word"]))))
    texts = [f"the word number{i} is w{i * 7} and <|endoftext|> " + "long" * (i * 5) for i in range(60)] + [None, ""]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kept, together in ((5, 3), (1000, 100)):
        monkeypatch.setattr(bpe, "MAX_KEPT", kept)
        ids, got = bpe.Ids(tok, lexicon), []
        for at in range(0, len(texts), together):
            got += bpe.encode_texts(texts[at : at + together], ids)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, in_0 string, pagewright_text int")
    row = bpe.encode(df, bpe.default_tokenizer()).first()
    assert (row["doc_id"], row["in_0"], row["pagewright_text"], len(row["ids"])) == (1, "x", 2, 8)


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), bpe.default_tokenizer()).count() == 0
