"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm import alignment, byte_bpe, fixity, language, lexical, neighbours, pii, topk, toxicity
from seriata.llm import pieces as sentencepieces
from seriata.llm.common import doc_crc, table
from seriata.llm.packing import pack, pieces
from seriata.llm.simhash import near_duplicates
from seriata.llm.urls import judge
from seriata.session import settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: three-word shingles, at most two bits apart."""
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector of ``embeddings``."""
    rows = table(spark, folder, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 20 = 0"), 20)


# Damage that the query does to a replica: records lost, a character changed, a character added, a record twice.
_LOST, _FLIPPED, _LONGER, _TWICE = "page_id % 211 = 7", "page_id % 97 = 5", "page_id % 131 = 3", "page_id % 307 = 11"

_RECORD = r"""
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"""


@query(f"""
    WITH damaged AS (
        SELECT page_id, url, CASE WHEN {_FLIPPED} THEN '#' || substr(html, 2)
                                  WHEN {_LONGER} THEN html || ' ' ELSE html END AS html,
               CASE WHEN {_TWICE} THEN 2 ELSE 1 END AS copies
        FROM pages WHERE NOT ({_LOST})
    ),
    one AS (SELECT page_id, strlen({_RECORD}) AS length, md5({_RECORD}) AS hash, 1 AS copies FROM pages),
    two AS (SELECT page_id, strlen({_RECORD}) AS length, md5({_RECORD}) AS hash, copies FROM damaged),
    one_at AS (SELECT *, page_id // 1024 AS file, coalesce(sum(length * copies) OVER (PARTITION BY page_id // 1024
               ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM one),
    two_at AS (SELECT *, page_id // 1024 AS file, coalesce(sum(length * copies) OVER (PARTITION BY page_id // 1024
               ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM two)
    SELECT a.page_id AS number, CASE WHEN b.page_id IS NULL THEN 'lost' ELSE 'changed' END AS state,
           CAST(a.file AS BIGINT) AS file, CAST(a.place AS BIGINT) AS "offset",
           CAST(a.length * a.copies AS BIGINT) AS length, CAST(b.place AS BIGINT) AS offset_2,
           CAST(b.length * b.copies AS BIGINT) AS length_2
    FROM one_at a LEFT JOIN two_at b ON a.page_id = b.page_id
    WHERE b.page_id IS NULL OR a.hash <> b.hash OR a.copies <> b.copies""")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Where the archive of ``pages`` differs from a replica of it that was damaged on purpose."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    html = F.when(F.expr(_FLIPPED), F.concat(F.lit("#"), F.substring("html", 2, 2147483647)))
    html = html.when(F.expr(_LONGER), F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    times = F.when(F.expr(_TWICE), 2).otherwise(1)
    damaged = pages.where(f"NOT ({_LOST})").withColumn("html", html)
    damaged = damaged.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return fixity.audit(fixity.archive(pages), fixity.archive(damaged))


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from those whose crc32 modulo 4 is not 2."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long"), "text")
    machine = toxicity.train(docs.where(doc_crc() % 4 != 2), table(spark, folder, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id",
        (doc_crc() % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(table(spark, folder, "documents"), tokenizer))


@query("""
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
        FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
           vec_id, score
    FROM scored QUALIFY rank <= 10""")
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 largest inner products of every hundredth vector of ``embeddings``."""
    rows = table(spark, folder, "embeddings")
    return topk.search(rows, rows.where("vec_id % 100 = 0"), 10)


@query()
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document; the counts and the hash are those of the patterns."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii.find(docs, pii.train(docs)).select(
        F.col("doc_id").cast("long"),
        *map(count, pii.KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


# The rules of the query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_RULE_ROWS = ", ".join(f"({h!r}, {p!r}, {v!r})" for h, p, v in URL_RULES)


@query(f"""
    WITH listed(h, p, v) AS (VALUES {_RULE_ROWS}),
    cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    named AS (
        SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
               translate(regexp_extract(rest, '^[^/?#]*'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
        FROM cut
    ),
    found AS (
        SELECT *, (SELECT max_by(h || p, length(h || p)) FROM listed
                   WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)) AS rule
        FROM named
    )
    SELECT page_id, host, path, rule,
           coalesce((SELECT v FROM listed WHERE h || p = rule), 'allow') AS verdict
    FROM found""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every URL of ``pages``."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 modulo 5 is not 0."""
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(doc_crc() % 5 != 0))
    found = language.identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("doc_id", (doc_crc() % 5 == 0).alias("held_out"), "lang_pred", "score")


@query()
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The piece numbers of every document, and whether they spell its words."""
    known = sentencepieces.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, folder, "documents")
    found = sentencepieces.encode(docs, known)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "spelled")


@query()
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The byte-level token numbers of every document, and the bytes they stand for."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long"), "text")
    found = byte_bpe.decode(byte_bpe.encode(docs, ranks).drop("text"), ranks)
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Where the tokens of two tokenizers meet in every document, and how common these meetings are."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    groups = settle(alignment.align(table(spark, folder, "documents"), a, b))
    scored = alignment.score(groups, alignment.count(groups, *alignment.vocabularies(a, b)))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    texts = alignment.texts(groups).select("row", digest)
    return scored.join(texts, "row").drop("row")


@query(r"""
    WITH cut AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ),
    lengths AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
    held AS (SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY doc_id, term),
    weighed AS (
        SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM held GROUP BY term
    ),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
               // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) AS BIGINT) AS score
        FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN lengths USING (doc_id), total
        GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10""")
def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 documents that score highest for each item of ``benchmark``."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)
