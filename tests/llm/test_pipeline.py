"""The stages, one by one, on documents with planted cases."""

from __future__ import annotations

import random

import __spark_entry__ as driver
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seriata.llm import copies, language, simhash, toxicity
from seriata.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    docs = table(spark, FOLDER, "documents")
    text = docs.where("length(text) > 500").orderBy("doc_id").first()["text"]
    rows = [
        (10**6, text, "en", None, 1),
        (10**6, text, "en", None, 1),
        (10**6 + 1, text, "en", "s", None),
        (None, text, None, None, None),
        (None, "nobody else has these words, mail me at a.b@c.org", None, None, None),
        (10**6 + 2, None, "en", "s", 0),
        (10**6 + 3, "", "en", "s", 0),
        (10**6 + 4, "12 34 -- ..", "en", "s", 0),
        (10**6 + 5, "call +1 (980) 555-6268 for the answer", "en", "s", 0),
    ]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_registered():
    names = driver.queries()
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert {"op3_warc", "op6_topk", "op8_url_filter", "op13_lexical"} <= set(driver.oracle_sql())


def test_stages_keep_the_columns_and_pass_on_what_they_keep(spark, planted):
    docs = planted
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == planted.columns and dict(docs.dtypes) == dict(planted.dtypes)
    empty = planted.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).isEmpty()


def test_toxic_documents_go(spark, planted):
    kept = corpus_pipeline.not_toxic(spark, planted, FOLDER)
    machine = toxicity.train(planted.where(corpus_pipeline.doc_crc() % 4 != 2), table(spark, FOLDER, "labels"))
    scored = toxicity.score(planted, machine)
    assert kept.count() == scored.where(F.col("score") < toxicity.THRESHOLD).count()


def test_documents_without_letters_go(spark, planted):
    kept = corpus_pipeline.in_a_language(spark, planted, FOLDER)
    gone = {r.doc_id for r in planted.exceptAll(kept).collect()}
    assert gone == {10**6 + 2, 10**6 + 3, 10**6 + 4}
    assert language.UNKNOWN == "und"


def _plain_classes(texts):
    """Classes of texts by the Jaccard similarity of all pairs of sets of five words in a row."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if 9 * both >= 4 * (len(one) + len(sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_one_document_of_each_class_stays(spark, planted):
    docs = planted.select("doc_id", "text").collect()
    classes = {}
    for r, c in zip(docs, _plain_classes([r.text for r in docs])):
        classes.setdefault(c, []).append((r.doc_id is None, r.doc_id or 0, r.text or ""))
    kept = corpus_pipeline.without_near_duplicates(spark, planted, FOLDER).select("doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(c)[:2] for c in classes.values())
    assert len(kept) < len(docs) - 4


def test_columns_of_any_name_pass_through(spark, planted):
    """Names that the operators use themselves."""
    names = ["spans", "root", "class", "score", "lang_pred", "bits", "__class", "__rank", "__rest", "a b", "row", "node"]
    docs = planted.select("doc_id", "text", "lang", *[F.concat(F.lit(f"{n} of "), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        named = out.where("doc_id IS NOT NULL")
        assert named.count() > 100
        for n in names:
            assert named.where(F.col(f"`{n}`") != F.concat(F.lit(f"{n} of "), F.col("doc_id"))).isEmpty()


def test_language_stage_without_a_language_to_learn(spark, planted):
    docs = planted.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.in_a_language(spark, docs, FOLDER)
    gone = {r.doc_id for r in docs.exceptAll(kept).collect()}
    assert gone == {10**6 + 2, 10**6 + 3, 10**6 + 4}


def test_language_stage_judges_by_code_length(spark, planted):
    noise = random.Random(1)
    text = " ".join("".join(chr(noise.randrange(0x4E00, 0x9FA0)) for _ in range(5)) for _ in range(200))
    docs = planted.unionByName(spark.createDataFrame([(77777777, text, None, "s", 1)], planted.schema))
    kept = {r.doc_id for r in corpus_pipeline.in_a_language(spark, docs, FOLDER).select("doc_id").collect()}
    scored = language.identify(docs, language.train(docs.where(corpus_pipeline.doc_crc() % 5 != 0)))
    bits = {r.doc_id: r.bits for r in scored.collect()}
    assert kept == {i for i, b in bits.items() if b is not None and b < corpus_pipeline.FOREIGN}
    assert 77777777 not in kept and max(b for b in bits.values() if b) > 15
    assert sorted(b for b in bits.values() if b)[-2] < 9  # all others stay with room to spare


def _alike(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.lower().split() for t in (a, b)))
    return len(a & b) / len(a | b) >= 0.8


def _changed(rng, words, at_most):
    """The words with a few of them changed, next to one another or not."""
    words = list(words)
    for _ in range(rng.randint(1, at_most)):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 100, 160]))] + common[: rng.choice([0, 30, 60])]
        texts += [" ".join(base), " ".join(base).upper()] + [_changed(rng, base, 5) for _ in range(12)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    changed = 0
    for i in range(len(texts)):
        for j in range(i):
            if _alike(texts[i], texts[j]):
                changed += texts[i].lower() != texts[j].lower()
                parent[find(i)] = find(j)
    assert changed > 100
    want = {frozenset(j for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaders in (copies.LEADERS, (1, 1)):
        monkeypatch.setattr(copies, "LEADERS", leaders)
        found = {}
        for r in copies.with_class(docs).collect():
            found.setdefault(r["class"], set()).add(r.doc_id)
        assert {frozenset(c) for c in found.values()} == want


def test_one_row_of_each_class_stays_whatever_its_number(spark, planted):
    one, other, third = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    near = third.replace("c50", "changed")
    rows = [(7, one), (7, other), (8, other), (9, other), (None, third), (None, near), (7, one)]
    docs = spark.createDataFrame([(i, t, "en", None, n) for n, (i, t) in enumerate(rows)], planted.schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, docs, FOLDER).collect()]
    assert len(kept) == 3 and {(7, one), (7, other)} < set(kept)
    assert [i for i, t in kept if t in (third, near)] == [None]


def test_near_copies_by_fingerprint_go_too(spark, planted):
    """Texts that the trie links though few of their sets of five words are shared."""
    chorus = "chorus " * 2000
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    texts = [chorus + one, chorus + other, third, third.replace("c20", "changed")]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.BUDGET < (prints[0] ^ prints[2]).bit_count()
    assert not _alike(texts[0], texts[1])
    rows = [(n, t, "en", None, n) for n, t in enumerate([*texts, texts[1], None])]
    kept = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, planted.schema), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5]


def test_personal_data_is_masked(spark, planted):
    masked = corpus_pipeline.without_personal_data(spark, planted, FOLDER)
    texts = [r.text for r in masked.collect() if r.text]
    assert "call <phone> for the answer" in texts and any("mail me at <email>" in t for t in texts)
    assert masked.where("n_chars <> length(text)").isEmpty() and masked.count() == planted.count()


def test_the_pipeline_runs_from_end_to_end(spark):
    rows = driver.queries()["pipeline"](spark, FOLDER)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < rows.select("doc_id").distinct().count() < table(spark, FOLDER, "documents").count()
