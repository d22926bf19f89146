"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelworks.llm import (
    bpe,
    decontaminate,
    fingerprints,
    hmm_lm,
    html_text,
    line_dedup,
    ngram_join,
    packing,
    pii,
    prefix_trie,
    repair,
    secrets,
    toxicity,
)
from panelworks.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


@query("op1_hmm_scores")
def hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.scores(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_bpe")
def byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.document_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


NGRAM_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS w FROM documents),
t AS (SELECT doc_id, string_split(w, ' ') AS l FROM d WHERE w <> ''),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i : i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.c + y.c - k)
  UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.w = '' AND y.w = '' AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS doc, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc),
c AS (SELECT doc AS doc_id, min(root) AS class_id FROM r GROUP BY 1),
k AS (SELECT class_id, count(*) AS class_size FROM c GROUP BY 1),
f AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links, class_size FROM c JOIN k USING (class_id) LEFT JOIN f USING (doc_id)"""

LINES_SQL = r"""WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, lower(trim(raw)) AS line FROM o WHERE regexp_matches(lower(trim(raw)), '\S')),
u AS (SELECT line, length(line) AS n, CASE WHEN regexp_matches(line, '^\S+(\s+\S+){4}') THEN 2 ELSE least(2, length(line) // 10) END AS own, row_number() OVER (ORDER BY line) AS id FROM l GROUP BY line),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id <> b.id WHERE least(a.own, b.own) > 0 AND levenshtein(a.line, b.line) <= least(a.own, b.own)),
r AS (SELECT id, id AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS class FROM r GROUP BY 1),
m AS (SELECT doc_id, line_no, class FROM l JOIN u USING (line) JOIN c USING (id)),
k AS (SELECT class, min(row(doc_id, line_no)) AS keep, count(*) AS class_size FROM m GROUP BY 1)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, struct_extract_at(keep, 1) AS class_doc_id, CAST(struct_extract_at(keep, 2) AS INTEGER) AS class_line_no, class_size, row(doc_id, line_no) = keep AS stays
FROM m JOIN k USING (class) WHERE class_size > 1"""


@query("op6_ngram_join", NGRAM_SQL)
def ngram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", LINES_SQL)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), every_line=True)


@query("op8_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query("op9_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


# the crc32 of an id is folded bit by bit over its digits, as DuckDB has no such function
TRIE_SQL = r"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
  lambda s, y: list_reduce(list_prepend(xor(s, y), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
l AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
f AS (SELECT i.c, t.p AS d, x, g FROM i JOIN t ON t.c = i.b AND t.p <= i.h
  UNION ALL SELECT i.c, t.p - i.h + least(i.h, coalesce(l.n, 0)), x, g FROM i JOIN t ON t.c = i.c AND t.p > i.h LEFT JOIN l ON l.c = i.b),
q AS (SELECT c, d, length(x) AS z, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM f UNION ALL SELECT c, 0, 0, '' FROM i),
n AS (SELECT d, k, min(c) AS v, count(*) AS m, max(z) AS z FROM q GROUP BY 1, 2),
w AS (SELECT q.c, q.d, n.v FROM q JOIN n USING (d, k)),
u AS (SELECT n.d, n.v, n.m, (n.m - 1) * n.z AS own, p.v AS up FROM n LEFT JOIN w p ON p.c = n.v AND p.d = n.d - 1),
s AS (SELECT a.v, a.d, sum(b.own) AS saved FROM u b JOIN w a ON a.c = b.v AND a.d <= b.d GROUP BY 1, 2),
h AS (SELECT up AS v, d - 1 AS d, count(*) AS n FROM u WHERE up IS NOT NULL GROUP BY 1, 2),
e AS (SELECT w.v, w.d, string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c) AS ids FROM w JOIN (SELECT c, max(d) AS d FROM w GROUP BY 1) USING (c, d) GROUP BY 1, 2),
b AS (SELECT a.v, a.d, count(*) AS leaves FROM u b LEFT JOIN h ON h.v = b.v AND h.d = b.d JOIN w a ON a.c = b.v AND a.d <= b.d WHERE h.n IS NULL GROUP BY 1, 2)
SELECT u.v AS conv_id, CAST(u.d AS BIGINT) AS depth, u.up AS parent_conv_id, u.m AS n_convs, coalesce(h.n, 0) AS n_children, b.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN s USING (v, d) JOIN b USING (v, d) LEFT JOIN h USING (v, d) LEFT JOIN e USING (v, d)"""


@query("op11_prefix_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_structure_repair")
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
