"""Byte-pair encoding and decoding with a public tokenizer's vocabulary.

Reads a tokenizers JSON file of this shape: NFC, white space to a blank and lower case; pieces by a pattern; bytes as
letters; BPE with a word-end suffix; no decoder. The file is read by the driver and broadcast (its size is that of the
vocabulary, whatever the data). No piece and no normal form reaches across white space, so texts are cut into words there,
and a worker remembers words as they are written. The pieces of new words are encoded together, some megabytes of text at a
time: each round merges the leftmost pair of the lowest rank in every piece. A long piece is taken singly, with a segment
tree over the ranks of adjacent pairs: the root gives the pair, a merge updates three leaves, and the walk ends when the root
holds no pair.

A file of another shape is refused: it would be read wrongly.

What a letter, a number, a lower case and a combining mark are depends on the version of Unicode. The tokenizers library
is asked once, by the driver, for every code point on which it differs from the modules used here; texts that hold such
code points take its answers.

Defined cases: null text is empty, an empty text has no tokens; a piece of any length costs n log n; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import text_of

# Fixed values of the file format: the pieces, and what counts as white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_PAIR, NO_RANK = 1 << 62, 1 << 30
#: Distinct words that a Python worker remembers, beside those of the texts in hand; longer words are forgotten at once.
REMEMBERED, LONGEST = 300_000, 100
#: Characters of the texts that are encoded together.
TOGETHER = 4_000_000
#: Bytes of a piece up to which it is merged together with others.
SHORT = 64
#: What splitting takes for white space and the pattern does not.
NO_BLANKS = "\x1c\x1d\x1e\x1f"


def _class(points: list[int]) -> str:
    """Code points as the inside of a character class, by ranges."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache
def library_unicode() -> dict[str, str]:
    """Character classes of code points on which the tokenizers library differs: more and fewer letters and numbers, other lower case (and which), marks without order or composition."""
    from tokenizers import Regex, normalizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    lines = lambda normalizer, texts: normalizer.normalize_str("\n".join(texts)).split("\n")
    out = {}
    for kind in "LN":
        theirs, ours = set(normalizers.Replace(Regex(rf"[^\p{{{kind}}}]"), "").normalize_str(every)), set(regex.findall(rf"\p{{{kind}}}", every))
        out[kind], out[f"not {kind}"] = _class([ord(c) for c in theirs - ours]), _class([ord(c) for c in ours - theirs])
    letters = [chr(c) for c in points if unicodedata.category(chr(c)) in ("Lu", "Lt", "Cn", "So", "Nl") and chr(c) != "Σ"]
    other = {c: low for c, low in zip(letters, lines(normalizers.Lowercase(), letters), strict=True) if low != c.lower()}
    out["case"], out["lower"] = _class(list(map(ord, other))), json.dumps(other)
    nfc = normalizers.NFC()
    # a mark that has an order changes places with one of a lower or a higher order
    marks = [chr(c) for c in points if unicodedata.combining(chr(c))]
    tries = [c + "\u0334" if unicodedata.combining(c) > 1 else "\u0345" + c for c in marks]
    loose = [c for c, text, found in zip(marks, tries, lines(nfc, tries), strict=True) if unicodedata.normalize("NFC", text) != found]
    pairs = ["".join(chr(int(x, 16)) for x in d.split()) for c in points if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d]
    loose += [text[1] for text, found in zip(pairs, lines(nfc, pairs), strict=True) if unicodedata.normalize("NFC", text) != found]
    out["marks"] = _class([ord(c) for c in loose])
    return out


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def readable(data: dict) -> None:
    """Raises ValueError if a tokenizer's file asks for a step that Encoder does not take."""
    model, normal, cut = data["model"], data.get("normalizer") or {}, data.get("pre_tokenizer") or {}
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in normal.get("normalizers", [])]
    cuts = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert"), c.get("add_prefix_space"), c.get("use_regex")) for c in cut.get("pretokenizers", [])]
    checks = {
        "model": model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "normalizer": steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)],
        "pre_tokenizer": cuts == [("Split", {"Regex": PIECES}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)],
        "decoder": data.get("decoder") is None,
        "added_tokens": not any(t.get(k) for t in data.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if wrong := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"cannot read a tokenizer with such a {', '.join(wrong)}")


def _joined(parts: pa.Array, bounds: np.ndarray) -> list[str]:
    """Stretches of parts, each joined by blanks."""
    return pc.binary_join(pa.LargeListArray.from_arrays(bounds, parts), pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """spec: the tokenizer's file. differs: library_unicode(); without it, the modules' own Unicode is used."""

    def __init__(self, spec: str, differs: dict[str, str] | None = None):
        data = json.loads(spec)
        readable(data)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = self.odd_pieces = regex.compile(PIECES)
        self.odd = self.apart = None
        differs = {k: v for k, v in (differs or {}).items() if v}
        self.lower: dict[str, str] = json.loads(differs.pop("lower", "{}"))
        if differs:
            classes = {k: "[" + rf"\p{{{k}}}" + (differs.get(k) or "") + (f"--[{differs[f'not {k}']}]" if f"not {k}" in differs else "") + "]" for k in "LN"}
            self.odd_pieces = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{classes['L']}+|{classes['N']}|(?:(?!\s|{classes['L']}|{classes['N']})[\s\S])+")
            self.odd = re.compile("[" + "".join(differs.values()) + "]")
            apart = differs.get("case", "") + differs.get("marks", "")
            self.apart = re.compile(f"([{apart}])") if apart else None
        self.inner = [self.vocab.get(x) for x in byte_letters()]
        self.last = [self.vocab.get(x + self.suffix) for x in byte_letters()]
        self.blanks = regex.compile(r"\s+")
        #: An added token is a word of its own.
        self.known = {w: (str(i), w) for w, i in added.items()}
        self.letter_ids = np.array([[-1 if i is None else i for i in ids] for ids in (self.inner, self.last)])
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(self.ranks.items()), strict=True))
        self.pair_made = np.array(self.made, np.int64)
        numbers = range(max(self.tokens) + 1)
        self.names = [pa.array(x, pa.large_string()) for x in (map(str, numbers), [self.tokens.get(i, "") for i in numbers])]

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one piece. Leaf i of the tree holds rank * n + i for the pair that begins at symbol i, so its root is the leftmost pair of the lowest rank."""
        letters = piece.encode()
        ids = [self.inner[b] for b in letters[:-1]]
        ids.append(self.last[letters[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.ranks.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [NO_PAIR] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) != NO_PAIR:
            r, i = divmod(low, n)
            j = after[i]
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            pairs = [(i, NO_PAIR)]
            if k < n:
                before[k] = i
                r = rank(ids[i] << 32 | ids[k])
                if r is not None:
                    pairs = [(i, r * n + i)]
                pairs.append((j, NO_PAIR))
            elif j < n - 1:
                pairs.append((j, NO_PAIR))
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << 32 | ids[i])
                pairs.append((h, NO_PAIR if r is None else r * n + h))
            for at, key in pairs:
                k = size + at
                tree[k] = key
                while k > 1:
                    other = tree[k ^ 1]
                    if other < key:
                        key = other
                    k >>= 1
                    if tree[k] == key:
                        break
                    tree[k] = key
        return [i for i in ids if i >= 0]

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces, one after the other, and the places where each begins and ends. A round takes one merge in every piece that has any left."""
        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        done = [(np.full(len(ids), k), np.array(ids, np.int64)) for k in np.flatnonzero(sizes > SHORT).tolist() for ids in [self.piece_ids(pieces[k])]]
        letters = np.frombuffer(b"".join(c for c in coded if len(c) <= SHORT), np.uint8)
        kept = np.flatnonzero(sizes <= SHORT)
        piece = np.repeat(kept, sizes[kept])
        ids = self.letter_ids[(np.diff(piece, append=-1) != 0).astype(int), letters]
        piece, ids = piece[ids >= 0], ids[ids >= 0]

        def ranks_at(i: np.ndarray) -> np.ndarray:
            j = np.minimum(i + 1, len(ids) - 1)
            keys = ids[i] << 32 | ids[j]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            return np.where((self.pair_keys[at] == keys) & (piece[i] == piece[j]) & (i < j), self.pair_ranks[at], NO_RANK)

        ranks = ranks_at(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            low = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), first)
            more = low >> 32 < NO_RANK
            stay = np.repeat(more, np.diff(first, append=len(ids)))
            done.append((piece[~stay], ids[~stay]))
            at = low[more] & 0xFFFFFFFF
            ids[at] = self.pair_made[low[more] >> 32]
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            piece, ids, ranks = piece[stay], ids[stay], ranks[stay]
            for i in (at, at[at > 0] - 1):
                ranks[i] = ranks_at(i)
        piece, ids = (np.concatenate([piece if k == 0 else ids, *(d[k] for d in done)]) for k in range(2))
        return ids[np.argsort(piece, kind="stable")], np.append(0, np.cumsum(np.bincount(piece, minlength=len(pieces))))

    def pieces_of(self, word: str) -> list[str]:
        """The pieces of a word; a piece reaches over no white space."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        odd = self.odd is not None and not word.isascii() and self.odd.search(word) is not None
        return (self.odd_pieces if odd else self.pieces).findall(self.normal(word, odd))

    def learn(self, words: list[str]) -> None:
        """Encodes new words and remembers their decimal ids and decoded tokens, joined by blanks."""
        cut = [self.pieces_of(w) for w in words]
        pieces = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        ids, ends = self.merged(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        of = pieces.indices.to_numpy()
        counts = ends[of + 1] - ends[of]
        after = np.append(0, np.cumsum(counts))
        # the ids of the words' pieces, one after the other
        ids = ids[np.repeat(ends[of] - after[:-1], counts) + np.arange(after[-1])]
        bounds = after[np.append(0, np.cumsum([len(c) for c in cut], dtype=np.int64))]
        texts = (_joined(names.take(pa.array(ids)), bounds) for names in self.names)
        self.known.update(zip(words, zip(*texts, strict=True), strict=True))

    def normal(self, text: str, odd: bool = False) -> str:
        """NFC and lower case; a capital sigma is lowered without regard to its place. In an odd text, code points with another lower case, and marks that the library leaves where they are, stand apart from what is around them."""
        if odd and self.apart:
            return "".join(self.lower.get(part, part) if k % 2 else self.normal(part) for k, part in enumerate(self.apart.split(text)))
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """The text cut at white space; added tokens are found before anything else."""
        if any(token in text for token in self.added):
            return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self.words(part))]
        return list(filter(None, self.blanks.split(text)))

    def texts_of(self, texts: list[str]) -> list[tuple[str, str]]:
        """The decimal ids of each text, and its decoded tokens, both joined by blanks."""
        if any(token in text for text in texts for token in (*self.added, *NO_BLANKS)):
            cut = pa.array([self.words(t) for t in texts], pa.list_(pa.large_string()))
        else:
            cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        words = cut.flatten().dictionary_encode()
        every = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in every if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: (str(i), w) for w, i in self.added.items()}
            new = [w for w in every if w not in self.known]
        self.learn(new)
        found = [self.known[w] for w in every]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        at = words.indices.to_numpy()
        has = np.array([f[0] != "" for f in found], bool)[at]
        bounds = np.append(0, np.cumsum(has))[cut.offsets.to_numpy()]
        columns = (pa.array([f[k] for f in found], pa.large_string()).take(pa.array(at[has])) for k in range(2))
        return list(zip(*(_joined(c, bounds) for c in columns), strict=True))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in ([self.added[w]] if w in self.added else chain.from_iterable(map(self.piece_ids, self.pieces_of(w))))]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a blank, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str, differs: dict[str, str]) -> Encoder:
    """One encoder per Python worker and specification."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(spec, differs)
    return ENCODERS[key]


def _together(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in runs of about TOGETHER characters."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= TOGETHER:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _per_text(docs: DataFrame, tokenizer_path: str, id_column: str, text_column: str, fields: list[tuple[str, str, pa.DataType]], row: Callable[[str, str], tuple]) -> DataFrame:
    """row: the fields of a text from its decimal ids and its decoded tokens, both joined by blanks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    readable(json.loads(content))
    spec = docs.sparkSession.sparkContext.broadcast((content, library_unicode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(*spec.value)
        for batch in batches:
            rows = [row(*t) for texts in _together(batch.column(1)) for t in bpe.texts_of(texts)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f[2]) for x, f in zip(columns, fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    schema = "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind, _ in fields)
    return docs.select(docs[id_column].cast("long").alias("doc_id"), text_of(docs, text_column).alias("text")).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (string)."""
    return _per_text(docs, tokenizer_path, id_column, text_column, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())], lambda ids, decoded: ([int(i) for i in ids.split()], decoded))


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """bpe_encode with the digests of its outputs in place of the outputs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _per_text(docs, tokenizer_path, id_column, text_column, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], lambda ids, decoded: (ids.count(" ") + 1 if ids else 0, sha(ids), sha(decoded)))
