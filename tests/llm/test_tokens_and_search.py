"""Byte-level merges, alignment and lexical search, against libraries and plain Python."""

from __future__ import annotations

import base64
import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from seriata.llm import alignment, byte_bpe, lexical, workers
from seriata.llm.common import table
from seriata.session import settle

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    " \t\n  two  spaces \r\n",
    "one two three four",
    "one two three four",
    "<|endoftext|><s></s><unk><0x41>it's we'll 12,5",
    "é ñ ß 日本 😀👩‍👩‍👧 ▁ a▁b \x00\x1c\x85 　x",
    "x" * 30_000 + " " + "word " * 5_000 + "-" * 3_000,
]


@pytest.fixture
def odd(spark):
    rows = [(None if i == 4 else i, t, "mine", "theirs") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, `row` string")


def _library(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


# ---------------------------------------------------------------- byte-level merges


def test_ids_are_the_librarys_and_decode_to_the_text(spark, odd):
    encode = _library(byte_bpe.read_ranks(RANKS))
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect():
        assert _numbers(r.ids) == encode(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_other_columns_pass_through_and_nulls_are_defined(spark, odd):
    found = byte_bpe.encode(odd, RANKS)
    assert sorted(found.columns) == ["doc_id", "ids", "row", "text"] and dict(found.dtypes)["ids"] == "binary"
    assert found.count() == len(TEXTS) and found.where("row = 'theirs'").count() == len(TEXTS)
    assert found.where("text IS NULL OR text = ''").select(F.sum(F.length("ids"))).first()[0] == 0
    none = byte_bpe.decode(byte_bpe.encode(odd.limit(0), RANKS), RANKS)
    assert none.isEmpty() and "decoded" in none.columns
    lost = byte_bpe.decode(odd.select(F.lit(None).cast("binary").alias("ids")), RANKS)
    assert lost.where("decoded IS NOT NULL").isEmpty()


def test_long_chunks_and_small_memories(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    encoder, encode, rng = byte_bpe.Encoder(RANKS), _library(byte_bpe.read_ranks(RANKS)), random.Random(3)
    for letters in ("ab", "aeiou", "the in", "-=", " \n", "éñ日"):
        for n in (1, 5, 30, 300):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert _numbers(encoder.encode(text)) == encode(text), text


def test_tables_of_ranks_in_which_tokens_cannot_be_reached(tmp_path):
    """Random tables: some tokens have no halves of lower rank, some ranks are out of order."""
    rng = random.Random(5)
    for case in range(30):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(12)}
        path = tmp_path / f"{case}.ranks"
        ranks = {t: i for i, t in enumerate([bytes([c]) for c in range(256)] + rng.sample(sorted(words), len(words)))}
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
        encoder = byte_bpe.Encoder(str(path), r"[\s\S]+")
        for _ in range(40):
            raw = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode()
            whole = [ranks[raw]] if raw in ranks else [ranks[p] for p in byte_bpe.merged(raw, ranks)]
            assert encoder.encode_chunk(raw) == whole, (sorted(ranks.items(), key=lambda x: x[1])[256:], raw)


def test_a_worker_keeps_one_thing():
    assert workers.kept("a", list) is workers.kept("a", list)
    first = workers.kept("a", list)
    workers.kept("b", list)
    assert workers.kept("a", list) is not first


def test_words_of_a_batch_are_encoded_once_however_few_are_remembered(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    rng = random.Random(5)
    words = ["".join(rng.choice("abc DEé日,.'1\n") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)] + [None, "", " ", "a  b", "\nx y", words[0] * 300]
    encoder, library, met = byte_bpe.Encoder(RANKS), _library(byte_bpe.read_ranks(RANKS)), collections.Counter()
    chunks = encoder.chunks
    monkeypatch.setattr(encoder, "chunks", lambda text: met.update([text]) or chunks(text))
    for text, got in zip(texts, encoder.encode_all(pa.array(texts)).to_pylist()):
        assert _numbers(got) == library(text or ""), repr(text)
    assert max(n for text, n in met.items() if text.startswith(" ") and text != " ") == 1


# ---------------------------------------------------------------- alignment


def test_words_of_a_batch_are_aligned_once(monkeypatch):
    monkeypatch.setattr(alignment, "TEXT_CHARS", 60)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcDEé日,.'1￼ﬁ▁") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words += [f"plain{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words[60:], k=90)) for _ in range(40)] + [" ".join(rng.choices(words, k=2)) for _ in range(200)]
    texts += [None, "", " ", "a  b", "\nx y"]
    pair = alignment.Pair(A, B)
    want = [pair.of_text(t or "") for t in texts]
    asked, tokens = [], pair._tokens
    monkeypatch.setattr(pair, "_tokens", lambda text: asked.append(text) or tokens(text))
    assert list(zip(*(c.to_pylist() for c in pair.columns(pa.array(texts))))) == want
    assert alignment.NOTHING in want[40:-5] and sum(text.split(" ").count("plain7") for text in asked if text not in texts) <= 3


def _plain_alignment(texts):
    pair = alignment.Pair(A, B)
    rows, count = [], collections.Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or "")
        ends = [{sum(len(known[t]) for t in ids[: i + 1]): i for i in range(len(ids))} for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b))] if len(raw) < 500 else None
        if ends is None:  # the same by running sums
            ends = []
            for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)):
                at, own = 0, {}
                for i, t in enumerate(ids):
                    at += len(known[t])
                    own[at] = i
                ends.append(own)
        whole = all(b"".join(known[t] for t in ids) == raw for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)))
        if not text or not whole:
            rows.append((0, 0, 0, [], ""))
            continue
        parts, links, last = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][end], ends[1][end]
            parts.append(",".join(map(str, a[last[0] : i + 1])) + "|" + ",".join(map(str, b[last[1] : j + 1])))
            links.append((a[i], b[j]))
            last = i + 1, j + 1
        count.update(links)
        rows.append((len(a), len(b), len(links), links, ";".join(parts)))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(na, nb, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), t) for na, nb, g, x, t in rows]


@pytest.mark.parametrize("common", [1, alignment.COMMON])
def test_groups_and_counts_are_those_of_plain_python(spark, odd, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    docs = table(spark, FOLDER, "documents").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    groups = settle(alignment.align(docs, A, B))
    counts = alignment.count(groups, *alignment.vocabularies(A, B))
    assert counts.plain.sum() > 0 and counts.pairs.count() > len(counts.common) * (common == 1)
    rows = alignment.score(groups, counts).join(alignment.texts(groups), "row").collect()
    found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows]
    texts = [r.text for r in docs.collect()]
    want = [(r.doc_id, *x) for r, x in zip(docs.collect(), _plain_alignment(texts))]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sum(not n for _, n, *_ in found) >= 3  # NULL, empty, and the letter that stands for a space


def test_alignment_of_nothing(spark, odd):
    for docs in (odd.limit(0), odd.where("text IS NULL")):
        groups = settle(alignment.align(docs, A, B))
        rows = alignment.score(groups, alignment.count(groups, *alignment.vocabularies(A, B)))
        assert rows.count() == docs.count() and rows.where("count_sum <> 0 OR n_links <> 0").isEmpty()


def test_alike_is_about_bytes():
    pair = alignment.Pair(A, B)
    for a, b in enumerate(pair.alike):
        assert b < 0 or pair.bytes_a[a] == pair.bytes_b[b]
    assert (pair.alike >= 0).sum() > 10_000


# ---------------------------------------------------------------- lexical search


def _plain_search(docs, items, k):
    def cut(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    held = [(i, cut(t)) for i, t in docs]
    size, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, words in held for t in set(words))
    rows = []
    for item, text in set(items):
        scored = []
        for i, words in held:
            tf, score = collections.Counter(words), 0
            for term in cut(text):
                if tf[term]:
                    m = 25 + 75 * len(words) * size // length
                    score += math.floor(1000 * math.log((2 * size + 2) / (2 * df[term] + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        rows += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_search_is_that_of_plain_python(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_TERMS", 9), ("DOCS", 3), ("ITEMS", 2), ("COLUMNS", 4), ("PART", 5), ("_LIMB", 12)):
            monkeypatch.setattr(lexical, name, value)
    rng = random.Random(2)
    words = ["Ab", "aB", "x1", "é", "É", "日本", "c", "d", "e_f", "g-h", "long" * 50]
    docs = [(i % 50, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(None, "ab ab x1"), (None, "ab ab x1"), (7, None), (8, ""), (9, "...")] + [(i, "c d e f") for i in range(100, 130)]
    items = [(1, "ab c c e_f"), (1, "ab c c e_f"), (1, "d"), (2, None), (3, ""), (4, "nobody"), (None, "é x1"), (5, "ab " * 5000 + "日本")]
    items += [(6 + i, " ".join(rng.choices(words, k=4))) for i in range(9)]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x")).repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(left, right, 7).collect()]
    assert sorted(found, key=repr) == sorted(_plain_search(docs, items, 7), key=repr)


def test_weights_too_large_for_one_product():
    """A term repeated so often that its weight times an impact leaves the whole numbers of a double."""
    block = lexical.Block(np.array([0]), {b"a": 0, b"b": 1}, np.array([0, 0]), np.array([0, 1]), np.array([10**9 + 7, 3]))
    scores = np.zeros((1, 1), np.int64)
    for tile in lexical.tiles(block, np.array([901, 7])):
        tile.add(scores, np.array([0, 0]), np.array([0, 1]), np.array([99_991, 12_345]))
    assert scores[0, 0] == (10**9 + 7) * 901 * 99_991 + 3 * 7 * 12_345


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 5"), items)):
        assert lexical.search(left, right, 3).isEmpty()
