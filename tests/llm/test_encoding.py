"""Problem 6: ids against the installed tokenizer, appends and edits."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import text_encoding  # noqa: E402
from millrace.llm.encoding_ops import EditableText, encode_corpus, token_lengths  # noqa: E402
from millrace.llm.prefix_bpe import PrefixEncoder  # noqa: E402
from millrace.llm.text_encoding import TextEncoder  # noqa: E402
from millrace.llm.vocabulary import Vocabulary, default_path, vocabulary  # noqa: E402

TEXTS = [
    None, "", " ", "  \n ", "a", "Hello, world's best!", "I'll've don't 'tis ''s 's'", "\n's \t't", "naïve café café", "日本語のテキスト、漢字。", "한국어 문장", "🙂👩‍👩‍👧 ok", "<|endoftext|><|startoftext|>", "\x00\x1c\x1f\x85​﻿ x",
    "x" * 3000, "ab " * 2000, "=" * 1000 + " " * 1000, "12345 ²³ Ⅷ ٣", "SELECT * FROM t WHERE a<>'b';\r\n\r\n", "　全角 空白　", "aaaaaaaab" * 50,
]


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(default_path())


def ids(encoder, texts):
    return [x for _, lists in encoder.encode(pa.array(texts, pa.string())) for x in lists.to_pylist()]


def test_known_texts(truth, encoder):
    assert ids(encoder, TEXTS) == truth(TEXTS)
    assert encoder.lengths(pa.array(TEXTS, pa.string())).tolist() == [len(x) for x in truth(TEXTS)]
    assert ids(encoder, []) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), st.text(" 'strevmld\n\tABab日1.", max_size=60)), max_size=8))
def test_random_texts(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_random_texts, "t") else test_random_texts.t
    t.encode_special_tokens = True
    test_random_texts.t = t
    e = text_encoding.text_encoder(default_path())
    assert ids(e, texts) == [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_small_chunks_and_forgetting(truth, encoder, monkeypatch):
    monkeypatch.setattr(text_encoding, "CHUNK_BYTES", 64)
    monkeypatch.setattr(text_encoding, "MAX_REMEMBERED", 50)
    assert ids(encoder, TEXTS * 2) == truth(TEXTS * 2)


def test_sliced_column(truth, encoder):
    column = pa.array(TEXTS, pa.string()).slice(5, 9)
    assert [x for _, lists in encoder.encode(column) for x in lists.to_pylist()] == truth(TEXTS[5:14])


def test_ranks_file_gives_the_same_vocabulary():
    a, b = vocabulary(default_path()), Vocabulary.load(P.path("byte_bpe_50k.tiktoken"))
    n = len(b.tokens)
    assert a.tokens[:n] == b.tokens and (a.left[:n] == b.left).all() and (a.right[:n] == b.right).all()


def test_other_vocabulary():
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids(TextEncoder(path), TEXTS) == [e.encode_ordinary(x or "") for x in TEXTS]


def test_prefixes_have_one_last_token(truth):
    """The stored token of every prefix is the last of that prefix's own encoding."""
    encoder = PrefixEncoder(vocabulary(default_path()))
    data = b"unbelievably"
    last: list[int] = []
    encoder.extend(data, last)
    assert last == [truth([data[: i + 1].decode()])[0][-1] for i in range(len(data))]
    assert encoder.walk(last) == truth(["unbelievably"])[0]


def test_appends_and_edits(truth):
    rng = random.Random(5)
    encoder = PrefixEncoder(vocabulary(default_path()))
    t = EditableText(vocabulary(default_path()), "", encoder)
    parts = ["a", "'", "s", " ", "  ", "\n", "ll", "word", "日本", "12", "!", "é", "🙂", " the", "ing"]
    for _ in range(250):
        if rng.random() < 0.4:
            t.append(rng.choice(parts))
        else:
            low = rng.randrange(len(t.text) + 1)
            t.replace(low, min(len(t.text), low + rng.randrange(4)), "".join(rng.choices(parts, k=rng.randrange(3))))
        assert t.ids() == truth([t.text])[0], t.text


def test_edit_touches_few_bytes(truth):
    text = "The quick brown fox jumps over the lazy dog. " * 500
    t = EditableText(vocabulary(default_path()), text)
    before = t.encoded_bytes
    t.replace(10_000, 10_003, "XYZ")
    t.append(" end")
    assert t.encoded_bytes - before < 100 and t.ids() == truth([t.text])[0]
    with pytest.raises(ValueError):
        t.replace(5, 10**9, "")


def test_operator(spark, truth):
    df = spark.createDataFrame([(i if i else None, x, "ids", 5) for i, x in enumerate(TEXTS)] * 2, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)
    got = encode_corpus(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    want = sorted(((i or None, x) for i, x in enumerate(truth(TEXTS))), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == sorted(want * 2, key=repr)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_lengths(df).collect()) == sorted([(i, len(x)) for i, x in enumerate(truth(TEXTS))] * 2)
    assert encode_corpus(df.limit(0)).count() == 0
    assert encode_corpus(df.selectExpr("doc_id AS k", "text AS body"), key="k", text="body").columns == ["k", "ids"]


def thue_morse(size, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(size))


def test_pieces_with_equal_hashes(truth):
    """Complementary Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base: they are told apart."""
    import numpy as np

    words = [thue_morse(1 << k, *pair) for k in range(10, 14) for pair in ("ab", "ba", "xy", "yx")]
    for w, v in zip(words[::2], words[1::2]):
        data = np.frombuffer((w + v).encode(), np.uint8)
        low, high = text_encoding.span_hashes(text_encoding._byte_values()[data], np.array([0, len(w)]), np.array([len(w), 2 * len(w)]))
        assert low == high
    want = truth(words)
    assert want[0] != want[1]
    e = TextEncoder(default_path())
    assert ids(e, words) == want and e.clashing
    assert ids(e, words[::-1]) == want[::-1]  # known ones
    e = TextEncoder(default_path())
    for w, x in zip(words, want):  # over several batches
        assert ids(e, [w, f"{w} and {w}"])[0] == x
    mixed = [" ".join(words[i : i + 3]) + "." for i in range(10)] + TEXTS
    assert ids(e, mixed) == truth(mixed)


def test_decoding(spark):
    from pyspark.sql import functions as F

    from millrace.llm.encoding_ops import decode_corpus
    from tests.conftest import rows

    df = spark.createDataFrame([(i if i % 5 else None, t, 3) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int").repartition(3)
    back = decode_corpus(encode_corpus(df.drop("ids")))
    assert rows(back) == sorted([(i if i % 5 else None, t or "") for i, t in enumerate(TEXTS)], key=repr)
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>").withColumn("text", F.lit("x"))
    assert rows(decode_corpus(odd)) == [(1, ""), (2, "")] and decode_corpus(odd.limit(0)).count() == 0
