"""Each operator against a brute-force version on a small fixture, and its defined cases."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import bpe, chat_format, exact_dedup, language_id, line_dedup, packing, perplexity, simhash, substring_dedup, toxicity
from auditloom.llm.components import connected_components
from auditloom.llm.queries import op1_quality_rules, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, doc int, bytes string, count int, kept string, marks int, digest int, fp int, content string, words int, score double"


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); with extra columns whose names clash with those that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, 9, "x", 3, "y", 4, "z", 5, 6, 7, "c", 8, 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Small texts with copies, shared passages, repeated lines, nulls and ties."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(6))
    rows = []
    for i in range(n):
        kind = rnd.randint(0, 6)
        own = "\n".join(" ".join(word() for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 12)))
        if kind == 0 and rows:
            own = rnd.choice(rows)[1]
        elif kind == 1:
            own = own + passage + own[:50]
        elif kind == 2:
            own = own + "\n  " + line.upper() + "\t\n" + own
        elif kind == 3 and rows:
            own = (rnd.choice(rows)[1] or "") + " x"
        rows.append((i, own))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a"), (n + 4, "ab " * 4000)]
    return rows


def test_exact_dedup(spark):
    rows = corpus()
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_cases(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(docs_of(spark, [(None, "q"), (3, "q"), (3, "q"), (None, "z")]), keep="min").collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def line_model(rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blank).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(spark):
    rows = corpus(2)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == line_model(rows)
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0
    same = line_dedup.line_dedup(docs_of(spark, [(None, "0123456789"), (1, "0123456789"), (1, "0123456789")])).collect()
    assert sorted((r.doc_id or -1, r.n_dropped, r.text) for r in same) == [(-1, 0, "0123456789"), (1, 1, ""), (1, 1, "")]


def substring_model(rows, length):
    """Every window against all earlier ones."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize(("seed", "length", "hot", "local"), [(1, 100, 10_000, 64), (2, 100, 10_000, 64), (3, 50, 10_000, 64), (1, 100, 2, 64), (4, 60, 5, 3), (5, 100, 10_000, 0), (6, 100, 3, 6)])
def test_substring_dedup(spark, seed, length, hot, local):
    rows = corpus(seed, 80)
    rnd = random.Random(seed)
    shared = "".join(rnd.choice("xyz ") for _ in range(length))
    rows += [(1000 + i, f"{i * 7919:d}{shared}{i}" + "ab" * rnd.randint(0, 90)) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.substring_dedup(docs_of(spark, rows + rows[-9:]), length=length, hot_runs=hot, local_hot=local).collect()}
    assert got == substring_model(rows, length)


@pytest.mark.parametrize(("seed", "key_bytes", "local"), [(1, 0, 0), (2, 3000, 0), (3, 500, 64)])
def test_substring_dedup_splits_large_keys(spark, seed, key_bytes, local):
    rows = corpus(seed, 60)
    rnd = random.Random(seed)
    own = lambda: "".join(rnd.choice("pqrs ") for _ in range(90))
    shared = "".join(rnd.choice("xyz ") for _ in range(130))
    rows += [(1000 + i, own() + shared + own()) for i in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.substring_dedup(docs_of(spark, rows + rows[-9:]), hot_runs=2, local_hot=local, key_bytes=key_bytes).collect()}
    assert got == substring_model(rows, 100)


def test_substring_dedup_text_under_one_key(spark):
    """Pieces of one key that reach into contexts of their own leave it; equal windows still meet."""
    rnd = random.Random(8)
    shared = bytes(rnd.randrange(256) for _ in range(93))
    texts = [bytes(rnd.randrange(256) for _ in range(7)) + shared + bytes(rnd.randrange(256) for _ in range(7)) for _ in range(200)]
    rows = spark.createDataFrame([(1, 5, i, 0, 0, 8, bytearray(t)) for i, t in enumerate([*texts, texts[3]])], substring_dedup.TEXT_SCHEMA).repartition(4)
    out = substring_dedup._bounded(rows, 100, 8, 5000).collect()
    sizes = Counter()
    for r in out:
        sizes[r.h] += len(r.text or b"")
    assert max(sizes.values()) <= 200 and {(r.doc, r.start) for r in out} == {(i, k) for i in range(201) for k in range(8)}
    keys = {(r.doc, r.start): r.h for r in out}
    assert all(keys[3, k] == keys[200, k] for k in range(8))


@pytest.mark.parametrize("length", [48, 49, 61, 100])
def test_runs_that_share_a_window_share_a_half(length):
    """Whatever the overlap on either side, two runs of one minimiser that have a window in common are both kept as candidates."""
    rnd = random.Random(length)
    any_bytes = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    shared = 0
    for extra in range(0, 40):
        passage = any_bytes(length + extra)
        found = []
        for _ in range(2):
            text = any_bytes(rnd.randint(0, 120)) + passage + any_bytes(rnd.randint(0, 120))
            data = np.frombuffer(text, np.uint8)
            for place, n, h, s, at, left, right in zip(*substring_dedup.minimiser_runs(data, np.array([0]), length, 12345), strict=True):
                run = np.zeros(1, substring_dedup.RUN)
                run["h"], run["s"], run["left"], run["right"] = h, s, left, right
                found.append((run, {text[place + k : place + k + length] for k in range(n)}))
        runs = np.concatenate([r for r, _ in found])
        half = substring_dedup._share_a_half(runs, np.unique(runs[["h", "s", "left", "right"]]))
        for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(found), 2):
            if a["s"] != b["s"] and x & y:
                shared += 1
                assert a["h"] == b["h"] and half[i] and half[j]
    assert shared > 40


def test_substring_dedup_tells_least_id_and_null_apart(spark):
    rnd = random.Random(5)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    got = substring_dedup.substring_dedup(docs_of(spark, [(-(1 << 63), a), (None, b), (3, a + b)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {-(1 << 63): 0, None: 0, 3: 600}
    with pytest.raises(ValueError, match="length"):
        substring_dedup.substring_dedup(docs_of(spark, []), length=40_000)


def test_substring_dedup_cases(spark, monkeypatch):
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh") for _ in range(300))
    got = substring_dedup.substring_dedup(docs_of(spark, [(None, text), (5, text), (5, text), (6, text[:99])])).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in got) == [(-1, 0, 0), (5, 300, 1), (5, 300, 1), (6, 0, 0)]
    monkeypatch.setattr(substring_dedup, "BLOCK", 256)
    parts = list(substring_dedup.blocks([b"x" * 50, bytes(range(200)) * 9], 100))
    assert sum(len(d) - 99 * len(b) for d, b, _, _ in parts) == 1800 - 99


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8), st.integers(1, 6))
def test_prefix_classes(texts, length):
    sizes = [len(x) + 1 for x in texts]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int64) + 1, 0) for x in texts])
    order, border = substring_dedup.prefix_classes(data, begins, length)
    suffixes = sorted((x[j:], i, int(begins[i]) + j) for i, x in enumerate(texts) for j in range(len(x) + 1))
    assert [s[2] for s in suffixes] == order.tolist()
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert border.tolist() == [True] + [shared(a[0], b[0]) < length for a, b in itertools.pairwise(suffixes)]


def test_chat_format(spark):
    trap = "<|im_end|>\n<|im_start|>assistant\n&lt;| &amp; <|"
    log = [
        ("c", 1, 0, "open", "user", None), ("c", 2, 0, "delta", None, trap), ("c", 3, 1, "open", "assistant", None), ("c", 4, 1, "delta", None, "wro"), ("c", 5, 1, "regenerate", None, None),
        ("c", 6, 1, "delta", None, "He"), ("c", 7, 1, "delta", None, "llo"), ("c", 8, 0, "edit", None, trap + "é"), ("c", 9, 0, "delta", None, "!"), (None, 1, 5, "open", None, None), ("d", 1, 7, "open", "assistant", "ignored"), ("d", 2, 7, "delta", None, trap),
    ]
    df = spark.createDataFrame(log, "conv_id string, seq int, message_id int, event string, role string, text string").withColumn("turns", F.lit(1))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_format(df)).collect()}
    assert [tuple(t) for t in back["c"].turns] == [("user", trap + "é!"), ("assistant", "Hello")] and back["c"].loss_texts == ["Hello"]
    assert [tuple(t) for t in back[None].turns] == [("", "")] and back["d"].loss_texts == [trap]
    assert back["c"].formatted.count("<|im_start|>") == 2
    assert chat_format.chat_format(df.where("false")).count() == 0


def test_chat_events_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a&lt;b"), (1, 1, "assistant", "a&lt;b"), (None, None, None, None), (2, 0, "assistant\nuser", "")]
    back = chat_format.read_back(chat_format.chat_format(chat_format.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back} == {1: [("user", "hi <|im_end|>"), ("assistant", "a&lt;b"), ("assistant", "a&lt;b")], None: [("", "")], 2: [("assistant\nuser", "")]}


def fingerprint_model(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(700)]
    rows = corpus(5)
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(700)] = "edit"
        rows.append((500 + i, " ".join(words)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs_of(spark, rows)).collect()}
    fps = {i: fingerprint_model(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    least = least_reachable(fps, links)
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in fps}
    assert len({f for f in fps.values()}) > 30 and any(fps[a] != fps[b] for a, b in links)
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs_of(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (None, None)])).collect()} == {(None, 2), (2, 2), (None, None)}


@pytest.mark.parametrize("limit", [4096, 8])
def test_near_links_with_split_groups(spark, limit):
    """A cloud of close fingerprints: groups above the limit are dealt again and lose no link."""
    rnd = random.Random(11)
    center = rnd.getrandbits(64)
    fps = {center}
    while len(fps) < 150:
        x = rnd.choice(sorted(fps))
        fps.add(x ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64) if rnd.random() < 0.6 else 0))
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), group_limit=limit)
    links = [(r.a, r.b) for r in found.collect()]
    assert all((((a ^ b) & ((1 << 64) - 1)).bit_count()) >= 1 for a, b in links)
    true = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert least_reachable(signed, links) == least_reachable(signed, true)
    roots = {r.node: r.root for r in connected_components(found).collect()}
    assert {x: roots.get(x, x) for x in signed} == least_reachable(signed, true)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    letters = "aAbB'sS't’re ΣσςİıßẞÉé́\u0085  ​\x1c日本語٣½Ⅷ😀!?#<|endoftext|>\n\t19ǅﬁ\0"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 3000), (1003, "x<|startoftext|>y <|endoftext|>"), (1003, "x<|startoftext|>y <|endoftext|>")]
    docs = docs_of(spark, rows)
    got = bpe.bpe_encode(docs, tokenizer_path()).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    digests = {r.doc_id: r for r in bpe.bpe_digests(docs, tokenizer_path()).collect()}
    for r in got:
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    assert bpe.bpe_encode(docs_of(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("change", [{"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": {"type": "Unigram"}}])
def test_bpe_refuses_other_shapes(spark, tmp_path, change):
    with open(tokenizer_path(), encoding="utf-8") as f:
        (tmp_path / "other.json").write_text(json.dumps(json.load(f) | change))
    with pytest.raises(ValueError, match=next(iter(change))):
        bpe.bpe_encode(docs_of(spark, [(1, "a")]), str(tmp_path / "other.json"))


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_optimal_buckets(histogram, k):
    lengths, counts = list(histogram), list(histogram.values())
    bounds = packing.optimal_buckets(lengths, counts, k)
    best = min(padding(lengths, counts, [*c, max(lengths)]) for r in range(k) for c in itertools.combinations(sorted(lengths), r))
    assert len(bounds) <= k and padding(lengths, counts, bounds) == best


def test_pack(spark):
    rows = [*corpus(6), (None, "a b c")]
    got = packing.pack(docs_of(spark, rows), buckets=3, max_length=50, token_budget=200, shard_rows=20).collect()
    pieces = Counter()
    for i, t in rows:
        n = len((t or "").encode().split())
        for p in range(max(1, math.ceil(n / 50))):
            pieces[i, p, min(50, n - 50 * p)] += 1
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == pieces
    lengths = Counter(r.length for r in got)
    bounds = sorted({r.bucket_length for r in got})
    assert bounds == packing.optimal_buckets(list(lengths), list(lengths.values()), 3)
    assert all(r.bucket_length == min(b for b in bounds if b >= r.length) and r.padding == r.bucket_length - r.length for r in got)
    batches = Counter((r.bucket_length, r.shard, r.batch) for r in got)
    assert all(n * b <= max(200, b) for (b, _, _), n in batches.items())
    assert packing.pack(docs_of(spark, [])).count() == 0


def base_model(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeat = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(line.encode().split())
        seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeat)


def kneser_ney_model(texts, order=4):
    """Modified Kneser-Ney over byte n-grams with dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = b"\0" * (order - 1) + t
        counts[order].update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i * 0.99) if n[i - 1] and n[i] else 0.5 for i in (1, 2, 3)]

    ds = [None, *(discounts(c) for c in counts[1:])]
    contexts = [None] + [{} for _ in range(order)]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            total, mass = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = total + n, mass + ds[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        total, mass = contexts[k].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        n = counts[k].get(g, 0)
        return (n - ds[k][min(n, 3) - 1] if n else 0) / total + mass / total * p(g[1:])

    return p


def test_quality_rules(spark):
    rnd = random.Random(9)
    clean = [(i, " ".join("".join(rnd.choice("ab" if rnd.random() < 0.5 else "eo") + rnd.choice("nrst") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(60, 200))), "en") for i in range(150)]
    junk = [(900 + i, " ".join("".join(chr(rnd.randint(33, 126)) for _ in range(6)) for _ in range(120)), "en") for i in range(2)]
    rows = clean + junk + [(950, "same words here " * 40, "en"), (951, None, None), (952, "few", "xx"), (953, "a\nb b b\n\na\n b", None)]
    got = {r.doc_id: r for r in perplexity.quality_rules(docs_of(spark, rows)).collect()}
    p = kneser_ney_model([(t or "").encode() for _, t, _ in rows])
    for i, t, _ in rows:
        r = got[i]
        base = base_model(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        b = (t or "").encode()
        padded = b"\0\0\0" + b
        want = -sum(math.log(p(padded[k : k + 4])) for k in range(len(b))) / max(1, len(b))
        assert r.log_perplexity == pytest.approx(want, rel=1e-3, abs=1e-4)
        assert r.kept == (not r.base_failed and r.low <= r.log_perplexity <= r.high)
    assert all(got[i].kept for i, _, _ in clean) and not any(got[i].kept for i, _, _ in junk)
    assert perplexity.quality_rules(docs_of(spark, [])).count() == 0


def test_quality_rules_repeated_rows_ties_and_long_texts(spark):
    """Repeated rows count as often as they occur and get a result each; equal texts lie on their band's border, which is inside."""
    rows = corpus(6, 40)
    rows += rows[:7]
    got = perplexity.quality_rules(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    p, text = kneser_ney_model([(t or "").encode() for _, t in rows]), dict(rows)
    for r in got:
        b = (text[r.doc_id] or "").encode()
        assert r.log_perplexity == pytest.approx(-sum(math.log(p((b"\0\0\0" + b)[k : k + 4])) for k in range(len(b))) / max(1, len(b)), rel=1e-4, abs=1e-5)
    same = " ".join(f"w{i}" for i in range(70))
    got = perplexity.quality_rules(docs_of(spark, [(i, same) for i in range(9)] + [(99, "lorem ipsum " * 200_000)])).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(9))
    assert [(r.n_words, r.n_repeat_words, r.base_failed) for r in got if r.doc_id == 99] == [(400_000, 400_000, True)]


def test_band_of_a_rare_language(spark):
    """A language of 30 documents judges its own, whatever the level and number of the others."""
    rnd = random.Random(12)
    rows = [("aa" if i < 400 else "bb", rnd.gauss(2 if i < 400 else 9, 0.1), i in (0, 400)) for i in range(430)]
    rows += [("aa", 9.0, False), ("bb", 2.0, False), ("bb", 7.5, False), ("cc", 5.0, False), ("dd", 5.0, True)]
    scored = spark.createDataFrame(rows, "lang string, log_perplexity double, base_failed boolean")
    got = [r.asDict() for r in perplexity.banded(scored, "log_perplexity", (4.0, 4.0), "low", "high").collect()]
    inside = {(r["lang"], r["log_perplexity"]): r["low"] <= r["log_perplexity"] <= r["high"] for r in got if not r["base_failed"]}
    assert len(got) == len(rows)
    assert not any(inside[k] for k in [("aa", 9.0), ("bb", 2.0), ("bb", 7.5)]) and inside["cc", 5.0]
    assert all(inside[lang, x] for lang, x, failed in rows[:430] if not failed)


@pytest.mark.parametrize("sent", [0, 40, 1 << 20])
def test_word_and_gram_perplexity(spark, sent):
    """Against brute force, whether words and n-grams are looked up in the array, by the join, or both."""
    rows = [*corpus(5), (None, "a b\x0ba"), (500, "x" * 3000 + " a")]
    counts = Counter(w for _, t in rows for w in (t or "").encode().split())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in perplexity.quality_rules(docs_of(spark, rows), labels=labels, most_sent=sent).collect()}
    p = kneser_ney_model([(t or "").encode() for _, t in rows])
    assert len(got) == len(rows)
    for i, t in rows:
        own, b = (t or "").encode().split(), (t or "").encode()
        assert got[i].log_perplexity == pytest.approx(-sum(math.log(p((b"\0\0\0" + b)[k : k + 4])) for k in range(len(b))) / max(1, len(b)), rel=1e-4, abs=1e-5)
        assert got[i].word_log_perplexity == pytest.approx(-sum(math.log(counts[w] / counts.total()) for w in own) / max(1, len(own)), rel=1e-5, abs=1e-6)


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(perplexity, "WORD_BLOCK", 40)
    texts = [b"", b" \t", b"ab ba", b"aab b\naab", b"b" * 60 + b" ab", b""]
    words, hashes = [t.split() for t in texts], []
    for h, begins in perplexity.word_hashes(texts):
        hashes += [x.tolist() for x in np.split(h, begins[1:])]
    assert [len(x) for x in hashes] == [len(x) for x in words]
    same = dict(zip(itertools.chain(*words), itertools.chain(*hashes), strict=True))
    assert [[same[w] for w in x] for x in words] == hashes and len(set(same.values())) == len(same)


def test_quality_rules_reject_labelled_junk(spark):
    """Of the labelled documents of a test table that pass the base rules, those that no width was set from: decorated words and tables that the models have seen as well."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where(held(F.col("doc_id"), 4, 2)).collect()}
    got = [(truth[r.doc_id], r.kept) for r in op1_quality_rules(spark, sf).where("not base_failed").collect() if r.doc_id in truth]
    junk, clean = [k for q, k in got if q == 0], [k for q, k in got if q == 1]
    assert len(junk) >= 10 and sum(junk) <= 1 and clean.count(False) <= 0.03 * len(clean)


def test_model_backs_off(spark):
    texts = ["abcabcabd", "bcdabcc", "xyz"]
    model = perplexity.train(docs_of(spark, list(enumerate(texts))))
    p = kneser_ney_model([t.encode() for t in texts])
    unseen = b"\0\0\0zab!cabxq"
    want = [math.log(p(unseen[k : k + 4])) for k in range(len(unseen) - 3)]
    assert model.log_probabilities(perplexity.packed_grams(np.frombuffer(unseen, np.uint8), 4)) == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("dtype", [np.uint32, np.uint64])
def test_sorted_array_beyond_its_slots(dtype):
    """More keys than slots: every key is found with its own value, and no other."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, np.iinfo(dtype).max, 6_000_000, dtype=dtype))
    put = np.sort(rng.permutation(keys)[:5_000_000])
    array = perplexity.Sorted(put, np.arange(len(put), dtype=np.float32) % 1009)
    values, found = array.look(keys)
    assert len(put) > 1 << perplexity.SLOT_BITS and found.sum() == len(put) and (keys[found] == put).all()
    assert (values[found] == np.arange(len(put)) % 1009).all() and not values[~found].any()
    assert not perplexity.Sorted(put[:0], array.values[:0]).look(keys)[1].any()


def held(c, m, k):
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m)) == k


def test_toxicity_held_out(spark):
    rnd = random.Random(2)
    bad = ["vile", "nasty", "filth", "grub"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(20, 200))]
        if toxic := rnd.random() < 0.15:
            for w in rnd.sample(bad, 2):
                words.insert(rnd.randrange(len(words)), w + rnd.choice(["", ",", "."]))
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        elif toxic:
            labels.append((i, None, None))
    truth = {i: any(w in t for w in bad) for i, t in rows}
    rows += [(700, None), (701, ""), (702, "you " * 20000 + "vile filth"), (None, "w1 nasty grub")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held(docs.doc_id, 4, 2)).collect()}
    out = [i for i in truth if got[i].held_out]
    assert len(got) == len(rows) and len(out) > 80
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.98 * len(out)
    assert got[700].predicted == 0 and got[701].predicted == 0 and got[702].predicted == 1 and 0 <= got[700].score <= 1
    empty = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), held(docs.doc_id, 4, 2))
    assert empty.count() == len(rows) and empty.where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held(docs.doc_id, 4, 2)).count() == 0


def test_language_id_held_out(spark):
    rnd = random.Random(8)
    parts = {"aa": ["the", "ing", "wh", "and"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["eau", "ou", "é", "que"]}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(parts))
        rows.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(rnd.randint(3, 60))), lang if rnd.random() < 0.9 else None))
    truth = {i: next(x for x in parts if all(any(q in w for q in parts[x]) for w in t.split())) for i, t, _ in rows}
    docs = docs_of(spark, [*rows, (800, None, "aa"), (801, "", "aa"), (802, "12 34 !?", "bb"), (803, "schung" * 200000, None)])
    got = {r.doc_id: r for r in language_id.identify(docs, held(docs.doc_id, 3, 1)).collect()}
    out = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.97 * len(out) and len(out) > 50
    assert [(got[i].lang_pred, got[i].score) for i in (800, 801, 802)] == [("und", 0.0)] * 3 and got[803].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs.where("false"), held(docs.doc_id, 3, 1)).count() == 0
