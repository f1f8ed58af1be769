"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE_JSON, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every embedding whose id is divisible by 20, among all."""
    from tablewright.llm.topk_codes import search, sign_codes

    codes = sign_codes(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 64)
    return search(codes, codes.where("id % 20 = 0"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best license notice of every document, and how many it has."""
    from tablewright.llm.license_scan import scan_licenses

    best = F.col("licenses")[0]
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("best", F.when(F.size("licenses") > 0, best))
    return found.select("doc_id", F.col("best.license").alias("license"), F.round("best.coverage", 6).alias("coverage"), F.col("best.first_word").alias("first_word"), F.col("best.end_word").alias("end_word"), F.size("licenses").cast("long").alias("n_licenses"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a similarity of 0.8 over 5-word shingles."""
    from tablewright.llm.jaccard_join import shingle_components

    return shingle_components(_table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a budget of as many words as there are takes, sources half way to even entropy, in passes."""
    from tablewright.llm.mixing import count_words, mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", count_words().alias("n_tokens"))
    return mix(docs).select("doc_id", "source", "n_tokens", F.col("pass_no").cast("long").alias("pass_no"), "from_token", F.round("weight", 9).alias("weight"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a class bigram model of those whose id's crc32 modulo 7 is not 2."""
    from tablewright.llm.brown_lm import score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 != 2).alias("training"))
    return score_texts(docs).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items, and the verdict."""
    from tablewright.llm.decontam import contamination, find_benchmark

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(find_benchmark(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from those whose id's crc32 modulo 4 is not 2."""
    from tablewright.llm.langid import fit, predict, remainder

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder() != 2))
    return predict(docs.select("doc_id", (remainder() == 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from tablewright.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE_JSON))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in 20-word windows that also start earlier, and a digest of the others."""
    from tablewright.llm.substring_dedup import digest, remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", digest().alias("kept_sha256"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into rows of 2048."""
    from tablewright.llm.packing import pack_tokens

    return pack_tokens(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE_RANKS))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for every benchmark item."""
    from tablewright.llm.impact_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest edits and a digest of what they leave."""
    from tablewright.llm.conversation_repair import damage, repair, summarise

    return summarise(repair(damage(_table(spark, sf_dir, "conversations"))))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses to that and to the next document."""
    from tablewright.llm.order_minhash import edited_pairs

    pairs = edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk_codes,
        op2_license_scan,
        op3_ngram_jaccard_join,
        op4_temperature_mixing,
        op5_brown_lm,
        op6_benchmark_decontamination,
        op7_language_id,
        op8_token_counts,
        op9_substring_dedup,
        op10_token_packing,
        op11_impact_search,
        op12_conversation_repair,
        op13_order_minhash,
        pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

_OP1 = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings WHERE len(embedding) = 64),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.b[i] - c.b[i]))) AS INTEGER) AS distance
  FROM c q, c WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
),
s AS MATERIALIZED (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d WHERE n_tokens > 0 GROUP BY source),
t AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS k FROM s),
p AS MATERIALIZED (SELECT tokens / total AS p, CAST(tokens AS DOUBLE) AS tokens, total, k FROM s, t),
g AS (SELECT -sum(p * ln(p)) + 0.5 * (ln(any_value(k)) + sum(p * ln(p))) AS goal FROM p),
ends AS (SELECT ln(any_value(k)) <= (SELECT goal FROM g) + 1e-12 AS even, max(total / k / tokens) <= 4 AS few FROM p),
be(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN fits THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fits THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) FROM p) <= (SELECT goal FROM g) + 1e-12 AS fits FROM be WHERE i < 50)
),
br(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN fits THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fits THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2) / tokens) * any_value(total) / sum(pow(p, (lo + hi) / 2)) FROM p) <= 4 AS fits FROM br WHERE i < 50)
),
a AS (
  SELECT greatest(CASE WHEN (SELECT even FROM ends) THEN 0 ELSE (SELECT hi FROM be WHERE i = 50) END,
                  CASE WHEN (SELECT few FROM ends) THEN 0 ELSE (SELECT hi FROM br WHERE i = 50) END) AS alpha
),
q AS MATERIALIZED (
  SELECT source, tokens, pow(tokens / total, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a) AS weight,
         CAST(floor(pow(tokens / total, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a) * total) AS BIGINT) AS quota
  FROM s, t, a
),
e AS (
  SELECT d.*, q.tokens, q.weight, q.quota, unnest(range(0, CAST(ceil(quota / tokens) AS BIGINT))) AS pass_no
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE n_tokens > 0
),
o AS (
  SELECT *, pass_no * tokens - n_tokens
    + sum(n_tokens) OVER (PARTITION BY source, pass_no ORDER BY md5('mix:' || pass_no || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS from_token FROM e
)
SELECT doc_id, source, n_tokens, pass_no, CAST(from_token AS BIGINT) AS from_token, round(weight, 9) AS weight FROM o WHERE from_token + n_tokens <= quota
"""

_OP6 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM k) WHERE len(w) >= size),
h AS (SELECT DISTINCT p.doc_id, p.i, p.size, k.item_id FROM p JOIN k ON k.size = p.size AND k.s = array_to_string(p.w[p.i : p.i + p.size - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

_OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS x FROM m),
l AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM w),
k AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n FROM l ANTI JOIN c ON c.doc_id = l.doc_id AND c.x = l.x GROUP BY l.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


_OP11 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
r AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""


def _edit(key: str, cost: str, letter: str) -> str:
    """A key of 10 digits of cost and the edits so far, after one more edit."""
    return f"(lpad(CAST(CAST(left({key}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({key}, 11) || '{letter}')"


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


# The least of (cost, edits) by row and state (b: nothing yet, s, u, a: after that role), row after row.
_OP12 = rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
),
c AS (
  SELECT k.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT)), lambda c, b: xor(t.t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) % 20 AS kind FROM k, t
),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE kind <> 0
),
o AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest, left(role, 1) AS ini
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
),
f AS MATERIALIZED (
  SELECT *, CASE WHEN rest = '' THEN 'b' WHEN again THEN 'd' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o
),
n AS MATERIALIZED (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
),
r(conv_id, i, b, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '0000000000', CAST(NULL AS VARCHAR), '0000000005I', '0000000010II' FROM n
  UNION ALL
  SELECT conv_id, i, b, s, u, least(a, {_edit("u", "5", "I")}) FROM (
    SELECT conv_id, i, b, s, least(u, {_edit("b", "5", "I")}, {_edit("s", "5", "I")}, {_edit("a", "5", "I")}) AS u, a FROM (
      SELECT r.conv_id, f.i, {_edit("r.b", "2", "D")} AS b,
        least({_edit("r.s", "2", "D")}, {_if("ok AND ini = 's'", _edit("r.b", "more", "K"))}) AS s,
        least({_edit("r.u", "2", "D")}, {", ".join(_if("ok AND ini = 'u'", _edit(f"r.{x}", "more", "K")) + ", " + _if("ok", _edit(f"r.{x}", "1 + more", "R")) for x in "bsa")}) AS u,
        least({_edit("r.a", "2", "D")}, {_if("ok AND ini = 'a'", _edit("r.u", "more", "K"))}, {_if("ok", _edit("r.u", "1 + more", "R"))}) AS a
      FROM r JOIN (SELECT conv_id, i, ini, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more FROM f) f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1
    )
  )
),
e AS MATERIALIZED (SELECT r.conv_id, CAST(left(least(b, a), 10) AS BIGINT) AS cost, substr(least(b, a), 11) AS audit FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = n.n),
p AS (SELECT conv_id, x, substr(audit, x, 1) AS l FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS x FROM e)),
q AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS y FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY x)),
v AS (
  SELECT q.conv_id, q.x, q.y, l, f.role, f.text, max(CASE WHEN q.y = 1 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS system
  FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i WHERE l <> 'D'
),
g AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (y - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY x) AS body
  FROM v GROUP BY conv_id
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLE = {
    "op1_exact_topk_codes": _OP1,
    "op3_ngram_jaccard_join": _OP3,
    "op4_temperature_mixing": _OP4,
    "op6_benchmark_decontamination": _OP6,
    "op9_substring_dedup": _OP9,
    "op11_impact_search": _OP11,
    "op12_conversation_repair": _OP12,
}
