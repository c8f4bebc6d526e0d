import os

import pytest

from glossa.llm.tokens import TOKENIZER_DIR, Encoder, encode_corpus, load_vocabulary

FILE = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")

TEXTS = ["", "a", "aaaa aaaaaaa", "<|endoftext|> x", "a" * 20_001, "  \n\n x  ", "I'll we're '", "naïve 中文テスト ไทย हिन्दी", "\u0000�\U0001f600", "1234567 v1.2.3"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_replay_equals_the_library():
    e = Encoder(*load_vocabulary(FILE))
    assert e.encode(TEXTS) == reference(TEXTS)
    assert e.encode(TEXTS) == reference(TEXTS)  # from memory


def test_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = Encoder(*load_vocabulary(FILE))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
    def run(t):
        assert e.encode([t]) == reference([t])

    run()


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello world", "z"), (3, "Hello world", "z"), (None, "a", "q")], "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()]
    want = {3: reference(["Hello world"])[0], 1: [], 2: [], None: reference(["a"])[0]}
    assert len(got) == 5 and all(want[i] == x for i, x in got)
    assert encode_corpus(df.where("doc_id = 9")).count() == 0
