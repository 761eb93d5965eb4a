"""The registered queries of the numbered operators, and SQL for those it can express.

Each query hands a whole given table to its operator and derives the digest columns
of its contract from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .embeddings import embedding_groups
from .exact_dedup import exact_duplicates
from .html_text import extract_main_text
from .langid import label_languages
from .langid import train as learn_languages
from .mixing import mix_sources
from .packing import pack_documents
from .pii import KINDS, SECRET, find_personal_data, spans_text
from .simhash import simhash_groups
from .quality import judge_documents
from .tokens import count_tokens
from .toxicity import score_toxicity
from .toxicity import train as learn_toxicity
from .trie import conversation_trie
from .vectorcodes import vector_codes


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose remainder is not 2."""
    docs = common.table(spark, sf_dir, "documents")
    model = learn_languages(docs, learn_from=remainder("doc_id", 4) != 2)
    return label_languages(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learnt from labels whose remainder is not 0."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    machine = learn_toxicity(docs, labels, learn_from=remainder("doc_id", 5) != 0)
    return score_toxicity(docs, machine).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing over all documents: words taken from each."""
    return mix_sources(common.table(spark, sf_dir, "documents")).drop("_row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 token ids; one row per piece."""
    pieces = pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents, by chunk recipes."""
    return exact_duplicates(common.table(spark, sf_dir, "documents")).drop("_row")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label at cosine 0.93 or more."""
    return embedding_groups(common.table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the fixed patterns' spans, all spans of their
    kinds, and the spans of secrets."""
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.sort_array(F.concat("base", F.filter("added", lambda s: s["kind"] != SECRET)))).alias("spans"),
                        spans_text(F.sort_array(F.filter("added", lambda s: s["kind"] == SECRET))).alias("secrets"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by composite text density."""
    return extract_main_text(common.table(spark, sf_dir, "pages"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components within three bits."""
    return simhash_groups(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text by the whole-token shortcut."""
    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all usable embeddings after six rounds of codebook learning."""
    return vector_codes(common.table(spark, sf_dir, "embeddings")).drop("label")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie(common.table(spark, sf_dir, "conversations"))


def _vector_codes_sql(rounds: int = 6) -> str:
    """Six rounds over components as rows: distances, nearest entries, floored means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT vec_id, part, entry, sum((p.val - c.val) * (p.val - c.val))::BIGINT AS d2
  FROM p JOIN c{r} c USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, part, (min(d2 * 16 + entry) % 16)::BIGINT AS entry, min(d2)::BIGINT AS d2 FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT part, pos, entry, coalesce(m.val, c.val) AS val FROM c{r} c LEFT JOIN (
  SELECT part, pos, entry, floor(sum(val)::DOUBLE / count(*))::BIGINT AS val FROM p JOIN a{r} USING (vec_id, part) GROUP BY ALL
  ) m USING (part, pos, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, len(embedding) // 8 AS d, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM v),
p AS MATERIALIZED (SELECT vec_id, k // d AS part, k % d AS pos, floor(4096 * x::DOUBLE)::BIGINT AS val FROM u),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
c0 AS MATERIALIZED (SELECT part, pos, entry, val FROM p JOIN f USING (vec_id) WHERE entry < 16),{','.join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d2)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM e JOIN v USING (vec_id), h
"""


#: crc32 of a decimal number's text: eight shifts a byte.
_CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv::VARCHAR, ''),
  lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM t GROUP BY conv),
b AS (SELECT s.conv, s.own, coalesce(o.own, []) AS base, {_CRC32_SQL.replace('conv::', 's.conv::')} % 4 AS h
  FROM s LEFT JOIN s o ON o.conv = s.conv - s.conv % 20),
q AS (SELECT conv, list_concat(base[1:h], own[h + 1:]) AS seq FROM b),
m AS (SELECT conv, seq, unnest(range(len(seq) + 1)) AS depth FROM q),
k AS MATERIALIZED (SELECT conv, depth, seq[1:depth] AS prefix, depth = len(seq) AS ends,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(seq[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM m),
n AS MATERIALIZED (SELECT prefix, depth, min(conv) AS conv, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '') AS ends FROM k GROUP BY prefix, depth),
c AS (SELECT n.*, up.conv AS parent, (SELECT count(*) FROM n d WHERE d.depth = n.depth + 1 AND d.prefix[1:n.depth] = n.prefix) AS n_children
  FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]),
g AS (SELECT prefix[1:a] AS prefix, a AS depth, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM c)),
w AS (SELECT prefix, depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM g GROUP BY prefix, depth)
SELECT c.conv AS conv_id, c.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM c JOIN w ON c.depth = w.depth AND c.prefix = w.prefix
"""

def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands of all documents."""
    return judge_documents(common.table(spark, sf_dir, "documents")).drop("lang")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_source_mix, op3_toxicity, op4_packing, op5_exact_dedup, op6_embedding_dedup, op7_token_counts,
                                   op8_personal_data, op9_simhash_dedup, op10_main_text, op11_vector_codes, op12_conversation_trie, op13_quality_rules)}

ORACLE = {
    "op11_vector_codes": _vector_codes_sql(),
    "op12_conversation_trie": _TRIE_SQL,
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
""",
    "op2_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || doc_id::VARCHAR) AS shuffled
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS spent, coalesce(sum(weight) OVER before, 0) AS gone,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c AS (SELECT *, (total - spent)::DOUBLE / (weights - gone) AS level FROM o),
l AS (SELECT max(level) FILTER (weight * level <= 3 * source_size) AS level FROM c),
t AS (
  SELECT c.source, source_size, total,
         CASE WHEN weight * c.level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * l.level END AS target
  FROM c, l
),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.total,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY shuffled, d.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS up_to
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
f AS (SELECT q.*, copy, (copy * source_size + up_to)::DOUBLE / target AS finish
      FROM q, range(3) r(copy) WHERE size > 0),
a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, doc_id, copy
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM f),
k AS (SELECT doc_id, sum(least(size, total - ahead))::BIGINT AS taken FROM a WHERE ahead < total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
""",
}
