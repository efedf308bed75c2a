"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cindergrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# All pairs and the closure of their links: what the near-duplicate operators must equal.
ORACLES["op6_minhash"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
             ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b
      ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

ORACLES["op8_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v
      WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
      ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


ORACLES["op11_topk"] = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(64 * e)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES["op13_phrases"] = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM w),
g AS (SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)),
             lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM s),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
x AS (SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, k.k,
             CAST(CAST(2000000 AS HUGEINT) * k.a // (l.a + r.a) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, size, a, w, unnest(range(2, size)) AS part FROM c WHERE size > 2),
v AS (SELECT lang, part, a, w, unnest(range(1, size - part + 2)) AS pos FROM u),
y AS (SELECT lang, array_to_string(w[pos:pos + part - 1], ' ') AS phrase, max(a) AS longer FROM v GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase
      WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * b.a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000"""

@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text under the multilingual rank file."""
    import public_tokenizers

    from cindergrid.llm.bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of equal weight; grown_shard is the row's shard among 17."""
    from cindergrid.llm.sharding import shard_rows
    return shard_rows(table(spark, sf_dir, "documents"), [1.0] * 16)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, 256 length classes."""
    import public_tokenizers

    from cindergrid.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-hash fingerprints of every text and its edited form."""
    from cindergrid.llm.fingerprints import fingerprint_documents
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 2-word shingles at 0.8."""
    from cindergrid.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by rules learnt from the labelled rows that aren't held out."""
    from cindergrid.llm.quality import fit_quality, score_quality
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of at least 0.9 among all rows of embeddings."""
    from cindergrid.llm.vectors import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model is fitted on labelled documents."""
    from cindergrid.llm.language import fit_text_model, identify_pages
    model = fit_text_model(table(spark, sf_dir, "documents"))
    return identify_pages(table(spark, sf_dir, "pages"), model)


@query
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines and passages that a smaller doc_id has."""
    from cindergrid.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    from cindergrid.llm.license_texts import NOTICES
    from cindergrid.llm.licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"), NOTICES)


@query
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector against all others."""
    from cindergrid.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language over all documents."""
    from cindergrid.llm.phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every document, aligned and linked."""
    import public_tokenizers

    from cindergrid.llm.alignment import align_tokens
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
