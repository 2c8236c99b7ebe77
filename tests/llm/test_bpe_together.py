"""Texts encoded together: the library's ids and tokens, whatever is remembered, and no piece but long ones taken singly."""

import random

import public_tokenizers
import pytest
import tokenizers

from auditloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def made() -> bpe.Encoder:
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read(), bpe.library_unicode())


def expected(library, texts):
    every = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return [(" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)) for ids in every]


def test_every_code_point_together(library):
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}.{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # texts with the blanks that need the pattern, and those without, are cut in different ways
    for part in ([t for t in texts if not set(t) & set(bpe.NO_BLANKS)], [t for t in texts if set(t) & set(bpe.NO_BLANKS)]):
        ids = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        encoder = made()
        got = [x for i in range(0, len(part), 50_000) for x in encoder.texts_of(part[i : i + 50_000])]
        assert [t for t, (found, _), e in zip(part, got, ids, strict=True) if found != " ".join(map(str, e))] == []


@pytest.mark.parametrize("remembered", [0, 50, 300_000])
def test_words_known_and_forgotten(library, monkeypatch, remembered):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    rnd = random.Random(5)
    letters = "aAbBeEnstS'é.,!1٣Σς日本 \n\t\u0085 \x1c"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    words += ["ab" * 40, "x" * 65, "né" * 200, "<|endoftext|>", "a<|startoftext|>b", "", " ", " "]
    encoder = made()
    for _ in range(6):
        texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(50)] + ["", "  \n", "<|endoftext|>"]
        assert encoder.texts_of(texts) == expected(library, texts)
        plain = [t for t in texts if not any(x in t for x in ("\x1c", "<|"))]
        assert encoder.texts_of(plain) == expected(library, plain)
    assert not any(len(w) > bpe.LONGEST for w in encoder.known)
    assert encoder.texts_of([]) == []


def test_only_long_pieces_are_taken_singly(library, monkeypatch):
    encoder, single = made(), []
    one = encoder.piece_ids
    monkeypatch.setattr(encoder, "piece_ids", lambda piece: single.append(piece) or one(piece))
    texts = [" ".join(f"invented{i}words, don't {'lo' * (i % 50)}ng" for i in range(k, k + 30)) for k in range(20)]
    assert encoder.texts_of(texts) == expected(library, texts)
    assert single and all(len(p) > bpe.SHORT for p in single)
