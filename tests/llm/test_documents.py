"""Operators on texts, against brute force on small tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriata.llm import components, language, packing, pieces, pii, queries, simhash, tokens, toxicity
from seriata.llm.common import table

FOLDER = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three four"),
    (4, "one two three four"),
    (None, "one two three four"),
    (5, "x" * 5000 + " " + "word " * 20_000),
    (6, "é ñ ß 日本 😀 1.2.3.4 A B C"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return table(spark, FOLDER, "documents")


# ---------------------------------------------------------------- SimHash


def _plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _plain_components(fps, budget=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def _check_classes(found, docs):
    fps = [_plain_fingerprint(t) for _, t in docs]
    group = _plain_components(fps)
    least = {}
    for (doc, _), g in zip(docs, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    want = sorted(((d, f"{fp:016x}", least.get(g)) for (d, _), fp, g in zip(docs, fps, group)), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_near_duplicates(spark, odd, none):
    docs = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    _check_classes(queries.QUERIES["op1_simhash"](spark, FOLDER), docs)
    _check_classes(simhash.near_duplicates(odd.withColumn("fp", F.lit(1)).withColumn("fingerprint", F.lit(2))), ODD)
    assert simhash.near_duplicates(none).isEmpty()


def test_trie_walk_finds_all_pairs():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    near = np.concatenate([values, *(values ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a, b in ((3, 3), (60, 1), (7, 9)))])
    near = np.unique(near)
    got = {tuple(sorted(p)) for i, j in simhash.walk(near, np.array([0]), 2, 0) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for j in range(len(near)) for i in range(j) if (int(near[i]) ^ int(near[j])).bit_count() <= 2}
    assert got == want


def test_a_large_group_is_cut_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for _ in range(300)})
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    links = simhash.trie_links(spark.createDataFrame(signed, "fp long, first long"))
    found = {r["node"]["first"]: r["root"]["first"] for r in components.components(links).collect()}
    group = _plain_components(fps)
    assert len({found.get(i, i) for i in range(len(fps))}) == len(set(group))


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7), (None, 3), (60, 100)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# ---------------------------------------------------------------- toxicity


def _judged(spark, n=400):
    rng = random.Random(4)
    names = ["the", "house", "is", "green", "and", "stable", "moral", "looser", "thing", "water", "stone"]
    bad = ["moron", "idiot", "loser"]
    out = []
    for i in range(n):
        words = [rng.choice(names) + rng.choice(["", "s", "er"]) for _ in range(30)]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(30), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_texts(spark, odd, none):
    rows = _judged(spark)
    machine = toxicity.train_machine([t for _, t, y in rows[:200]], [bool(y) for *_, y in rows[:200]])
    judge = toxicity.Judge(machine)
    predicted = judge.scores([t for _, t, _ in rows[200:]]) >= toxicity.THRESHOLD
    assert predicted.tolist() == [bool(y) for *_, y in rows[200:]]
    gapped = "the house is i-d-i-o-t and m.o.r.o.n green", "the l o s e r and the i d i o t"
    assert (judge.scores(list(gapped)) >= toxicity.THRESHOLD).all()
    assert (judge.scores(["", "the green house"]) < toxicity.THRESHOLD).all()
    found = toxicity.score(odd.withColumn("score", F.lit("x")), machine)
    assert found.columns == ["doc_id", "text", "score"] and found.count() == len(ODD)
    assert found.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert toxicity.score(none, machine).isEmpty()


def test_toxicity_learns_from_labels_only_once(spark, none):
    docs = spark.createDataFrame([(i, t) for i, t, _ in _judged(spark, 80)], SCHEMA)
    labels = [(i, y) for i, _, y in _judged(spark, 80)]
    labels = spark.createDataFrame([*labels, *labels, (1, None), (None, 1)], "doc_id long, toxic int")
    sample = toxicity.sample(docs.unionByName(docs), labels)
    assert sorted(map(tuple, sample.collect())) == sorted((t, bool(y)) for _, t, y in _judged(spark, 80))
    machine = toxicity.train(none, labels)
    assert toxicity.Judge(machine).scores(["moron"])[0] < toxicity.THRESHOLD


def test_the_kernel_is_that_of_subsequences():
    def kernel(s, t):
        def count(text):
            symbols, out = [toxicity._BEGIN, *(toxicity._SYMBOL[ord(c)] for c in text)], {}
            n = len(symbols)
            for i in range(n):
                for j in range(i + 1, n):
                    for k in range(j + 1, n):
                        if symbols[i] and symbols[j] and symbols[k]:
                            key = symbols[i], symbols[j], symbols[k]
                            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return out

        a, b = count(s), count(t)
        size = lambda x: sum(v * v for v in x.values()) ** 0.5
        return sum(v * b.get(c, 0) for c, v in a.items()) / (size(a) * size(b))

    words = ["idiot", "id.iot", "banana", "ñandú"]
    base, codes = toxicity.features(words)
    column = np.zeros(toxicity._LETTERS**3, np.int32)
    column[codes] = np.arange(len(codes))
    got = toxicity.weighted(words, base, column=column)
    assert np.allclose(got, [[kernel(s, t) for t in words] for s in words])


# ---------------------------------------------------------------- language


def test_code_lengths_are_those_of_a_plain_coder():
    import math

    def plain(words_by_language, word):
        out = []
        for words in words_by_language.values():
            trees = {}
            for w in words:
                text = b" " + w + b" "
                for i in range(1, len(text)):
                    for k in range(min(i, language.ORDER) + 1):
                        node = trees.setdefault(text[i - k : i], {})
                        node[text[i]] = node.get(text[i], 0) + 1
            bits, text = 0.0, b" " + word + b" "
            for i in range(1, len(text)):
                for k in range(min(i, language.ORDER), -1, -1):
                    node = trees.get(text[i - k : i])
                    if node is None:
                        continue
                    whole = sum(node.values()) + len(node)
                    if text[i] in node:
                        bits -= math.log2(node[text[i]] / whole)
                        break
                    bits -= math.log2(len(node) / whole)
                else:
                    bits += 8.0
            out.append(bits)
        return out

    texts = {"a": [b"banana", b"bandana", b"an"], "b": [b"stone", b"tonne", b"on"]}
    counts = {}
    for name, words in texts.items():
        strings = np.concatenate([v[e] for v, e in language.grams_of(words)])
        counts[name] = np.unique(strings, return_counts=True)
    model = language.learn(counts)
    probes = [b"banana", b"ton", b"zebra", b"b", b"\xc3\xa9"]
    assert np.allclose(language.code_lengths(model, probes), [plain(texts, w) for w in probes])


def test_language_on_held_out_documents(spark, odd, none):
    found = queries.QUERIES["op9_language"](spark, FOLDER).where("held_out")
    joined = found.join(documents(spark).select("doc_id", "lang"), "doc_id")
    right, n = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert n > 20 and right > 0.95
    model = language.train(documents(spark))
    got = language.identify(odd.withColumn("lang_pred", F.lit(1)), model).select("doc_id", "lang_pred", "score").collect()
    assert len(got) == len(ODD)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    empty = language.train(none.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, model).isEmpty()


# ---------------------------------------------------------------- personal data

# The patterns, as plain searches.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def test_patterns_equal_plain_searches():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab.@-+_ 0123456789()%é") for _ in range(60)) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "@@a@b..c", "x@y.z._%q@r.s", "+1 (980) 555-6268)"]
    for text in texts:
        assert pii.base_spans(text) == _plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


def test_the_field_carries_what_is_known_to_repeats():
    known = "call +1 (988) 555-2485 now"
    train = [f"{known} or {i} times at 10.0.0.{i}, item {i * 37}" for i in range(100, 160)]
    field = pii.learn(train)
    text = "later 555-2485 again. Call +1 (988) 555-2485 now, 7 times."
    spans = pii.further_spans(field, [text], [pii.base_spans(text)])[0]
    assert [text[s:e] for s, k, e in spans] == ["555-2485"] and spans[0][1] == pii.KINDS.index("phone")


def test_pii_table(spark, odd, none):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_pii"](spark, FOLDER).collect()}
    for doc in documents(spark).collect():
        spans = _plain_spans(doc["text"])
        for i, kind in enumerate(PATTERNS):
            assert got[doc["doc_id"]][f"n_{kind}"] == sum(k == i for _, k, _ in spans)
    field = pii.train(none)
    found = pii.find(odd.withColumn("spans", F.lit(1)).withColumn("kind", F.lit(2)), field)
    assert found.columns == ["doc_id", "text", "kind", "spans"] and found.count() == len(ODD)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(odd, field).collect()}
    assert masked[1] is None and masked[2] == "" and masked[6] == "é ñ ß 日本 😀 <ip> A B C" and masked[5] == ODD[6][1]
    assert pii.redact(none, field).isEmpty()


# ---------------------------------------------------------------- packing


def _check_packed(rows, docs, length):
    tokenizer, want = Tokenizer.from_file(WORD_BPE), []
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_packing(spark, odd, none):
    docs = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    rows = queries.QUERIES["op5_packing"](spark, FOLDER).collect()
    n = _check_packed(rows, docs, 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    cut = packing.pieces(odd.withColumn("ids", F.lit(1)).withColumn("piece", F.lit("x")), WORD_BPE, 512)
    packed = packing.pack(cut, 512, group=5)
    _check_packed(packed.collect(), ODD, 512)
    assert packing.pack(packing.pieces(none, WORD_BPE)).isEmpty()
    whole = packing.sequences(packing.pieces(odd, WORD_BPE, 512, keep_ids=True), packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in packed.collect())


def test_sizes_go_where_the_squares_get_smallest():
    number, offset = packing.place(np.array([6, 6, 4, 4, 3]), 10)
    assert number.tolist() == [0, 1, 1, 0, 2] and offset.tolist() == [0, 0, 6, 6, 0]


@pytest.mark.parametrize("seed", range(5))
def test_placement_follows_the_rule(seed):
    sizes = np.random.default_rng(seed).integers(1, 21, 120)
    number, offset = packing.place(sizes, 20)
    filled: dict[int, int] = {}

    def squares(after):
        gaps = [20 - f for f in after.values() if f < 20]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for size, own, at in zip(sizes.tolist(), number.tolist(), offset.tolist()):
        fits = [b for b, f in filled.items() if f + size <= 20]
        if fits:
            best = min(fits, key=lambda b: (squares(filled | {b: filled[b] + size}), 20 - filled[b]))
            assert filled[own] == filled[best]  # sequences with equal gaps are alike
        else:
            assert own not in filled
        assert at == filled.get(own, 0)
        filled[own] = at + size


def test_equal_pieces_spread_over_the_groups(spark):
    same = "CAST(NULL AS LONG) doc_id", "0 piece", "0L start", "700L length", "5L ids_crc32"
    packed = packing.pack(spark.range(0, 100_000, 1, 8).selectExpr(*same), 2048, group=4096)
    groups = packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 100_000 and len(groups) >= 20 and max(r["count"] for r in groups) < 5000
    sequences = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("at"))
    shapes = {tuple(r["at"]): r["count"] for r in sequences.groupBy("at").count().collect()}
    assert set(shapes) <= {(0,), (0, 700)} and shapes.get((0,), 0) <= 25


def test_tokens_equal_the_library():
    rng = random.Random(8)
    letters = "abc DEF'sté ñ\n\t\r\x0b\x85\u3000日😀Σσ²½İ!?#<|endoftext|>0123\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(50)) for _ in range(400)] + ["", "<|startoftext|> a", "ΟΔΟΣ"]
    library = Tokenizer.from_file(WORD_BPE)
    for text, got in zip(texts, tokens.WordTokenizer(WORD_BPE).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_of_all_letters_equal_the_library_and_only_few_are_remembered():
    library = Tokenizer.from_file(WORD_BPE)
    chars = [chr(i) for i in range(0x3000) if chr(i) not in "\ud800"]
    texts = ["".join(f"a{c}B{c}{c} {c}x's{c} H{c}\u0331 " for c in chars[i : i + 16]) for i in range(0, len(chars), 16)]
    texts += ["<|STARTOFTEXT|> <|endoftext|>X", "K\x1cL\x0bM it'S 'LL", "Long" * 50_000 + ", " + "no" * 40]
    few = tokens.WordTokenizer(WORD_BPE, 100)
    for text, got in zip(texts, few.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:99])
        assert len(few.chunks) <= 100 and len(few.words) <= 100
    assert all(len(c) <= tokens.KEPT_CHARS for c in [*few.chunks, *few.words])


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(spark, odd, none):
    rng = random.Random(9)
    short = [(i, t) for i, t in ODD if i != 5] + [(5, "word " * 3000), (7, "aaaaaaaaaaaaa" * 9), (8, "  a   b  ")]
    short += [(100 + i, "".join(rng.choice("the ing\n▁éß日😀0a") for _ in range(40))) for i in range(40)]
    known = pieces.piece_table(spark, PIECE_BPE)
    docs = spark.createDataFrame(short, SCHEMA).withColumn("ids", F.lit(1)).withColumn("word", F.lit("x"))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = pieces.encode(docs, known).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in got) == sorted(repr((i, library.encode(t or ""))) for i, t in short)
    assert all(r.spelled for r in got)
    again = pieces.decode(pieces.encode(docs, known), known).collect()
    assert sorted(repr(tuple(r)) for r in again) == sorted(repr((i, (t or "").replace("▁", " "))) for i, t in short)
    assert pieces.encode(none, known).isEmpty()
    odd_ids = spark.createDataFrame([(1, None), (None, []), (None, [1, 5])], "doc_id long, ids array<int>")
    assert sorted(map(repr, pieces.decode(odd_ids, known).collect())) == sorted(map(repr, [
        Row(doc_id=1, decoded=""), Row(doc_id=None, decoded=""), Row(doc_id=None, decoded="")]))


def test_pieces_take_no_shuffle(spark, odd):
    known = pieces.piece_table(spark, PIECE_BPE)
    plan = pieces.encode(odd, known)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Aggregate|Sort", plan), plan


def test_pieces_of_long_words_equal_the_library(spark):
    letters = random.Random(4)
    long = ["ab" * 50_000, "日本" * 30_000 + " x", "▁" * 15 + "aaa ", "".join(letters.choice("etaoin日😀") for _ in range(100_000))]
    docs = spark.createDataFrame(list(enumerate([*long, "the  end"])), SCHEMA)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = {r.doc_id: (r.ids, r.spelled) for r in pieces.encode(docs, pieces.piece_table(spark, PIECE_BPE)).collect()}
    assert got == {i: (library.encode(text), True) for i, text in enumerate([*long, "the  end"])}


def _plain_pieces(word, table):
    """Every substring tried, all edges in one list, a text of cuts."""
    known = {piece: (-score, i) for i, piece, score, _ in table if score is not None}
    edges = [(a, b) for a in range(len(word)) for b in range(a + 2, len(word) + 1) if word[a:b] in known]
    cuts = [True] * (len(word) + 1)
    for a, b in sorted(edges, key=lambda e: (known[word[e[0] : e[1]]][0], e)):
        if cuts[a] and cuts[b] and sum(cuts[a + 1 : b]) == 1:
            cuts[a + 1 : b] = [False] * (b - a - 1)
    at = [i for i, cut in enumerate(cuts) if cut]
    parts = [word[a:b] for a, b in zip(at, at[1:])]
    return [i for p in parts for i in ([known[p][1]] if p in known else [b + pieces.FIRST_BYTE for b in p.encode()])]


@pytest.mark.parametrize("seed", range(4))
def test_edges_are_folded_by_rank(spark, monkeypatch, seed):
    rng = random.Random(seed)
    spelt = sorted({"".join(rng.choice("ab▁cé") for _ in range(rng.randrange(1, 5))).replace("▁", "") for _ in range(40)} - {""})
    table = [(i, f"<{i}>", None, f"{i - 3:02X}" if i > 2 else "") for i in range(259)]
    # equal scores, and pieces whose bytes are not theirs
    table += [(260 + i, p, float(rng.randrange(-6, 0)), (p if i % 5 else "?").encode().hex()) for i, p in enumerate(spelt)]
    known = spark.createDataFrame(table, "id int, piece string, score double, bytes string")
    texts = ["".join(rng.choice("aabc édx\u2581") for _ in range(rng.randrange(40))) for _ in range(300)] + [None]
    spells = {i: bytes.fromhex(digits) for i, _, _, digits in table}
    want = []
    for text in texts:
        marked = "▁" + text.replace(" ", "▁") if text else ""
        split = re.split("(?<=[^▁])(?=▁)", marked) if marked else []
        ids = [_plain_pieces(word, table) for word in split]
        right = [b"".join(map(spells.__getitem__, own)) == word.encode() for own, word in zip(ids, split)]
        want.append((sum(ids, []), all(right)))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = sorted(pieces.encode(docs, known).collect(), key=lambda r: r.doc_id)
    assert [(r.ids, r.spelled) for r in got] == want and {r.spelled for r in got} == {True, False}
    lattice = pieces.Lattice(known.toArrow())
    for together, letters in ((1, 7), (10**9, 50)):  # all words together, and word by word
        monkeypatch.setattr(pieces, "TOGETHER", together)
        monkeypatch.setattr(pieces, "LETTERS", letters)
        ids, spelled = lattice.encode(pieces.words(docs.select("text").toArrow()["text"].combine_chunks()))
        assert list(zip(ids.to_pylist(), spelled.to_pylist())) == want
