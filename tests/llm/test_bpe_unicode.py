"""Tokens of every code point, and of marks in wrong order, as the tokenizers library gives them."""

import random
import unicodedata

import public_tokenizers
import pytest
import tokenizers
from test_text_operators import docs_of

from auditloom.llm.bpe import Encoder, bpe_encode, library_unicode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return Encoder(f.read(), library_unicode()), library


def test_every_code_point(both):
    ours, library = both
    texts = [f"a{chr(c)}b{chr(c)}1{chr(c)}." for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ours.encode(t) != e.ids]
    assert wrong == []


def test_marks_in_any_order_and_pairs(both):
    ours, library = both
    rnd = random.Random(7)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    pairs = ["".join(chr(int(x, 16)) for x in d.split()) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<"]
    letters = [chr(c) for c in range(0x41, 0x1F000) if chr(c).lower() != chr(c)]
    texts = ["".join(rnd.choice(rnd.choice((marks, marks, pairs, letters, "aeΣ 1."))) for _ in range(rnd.randint(1, 9))) for _ in range(30_000)] + ["̯৾", *pairs]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ours.encode(t) != e.ids]
    assert wrong == []


def test_the_query_uses_the_library_unicode(spark, both):
    _, library = both
    texts = ["a՘b", "Ᲊx", "̯৾", "plain", "", None, "\U00010940 y"]
    got = {r.doc_id: r.ids for r in bpe_encode(docs_of(spark, list(enumerate(texts))), PATH).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
