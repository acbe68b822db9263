"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.chat import op9_chat_formatting
from sparkloom.llm.common import reach_workers
from sparkloom.llm.decontaminate import op7_benchmark_decontamination
from sparkloom.llm.language import op6_language_id
from sparkloom.llm.mixing import op5_source_mixing
from sparkloom.llm.order_minhash import op10_order_minhash
from sparkloom.llm.quality import op8_quality_classifier
from sparkloom.llm.simhash import op1_simhash_near_dedup
from sparkloom.llm.suffix_bwt import op2_suffix_array_dedup
from sparkloom.llm.suffix_tree import op4_substring_dedup
from sparkloom.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _importable(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_order_minhash": op10_order_minhash,
}
QUERIES = {name: _importable(query) for name, query in QUERIES.items()}
SQL: dict[str, str] = {
    # every 200-byte window that starts twice, runs of those that overlap or touch, and the bytes between the runs
    "op2_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        s AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
        h AS (SELECT doc_id, i, md5(b[i:i + 199]) AS k FROM s),
        w AS (SELECT doc_id, i FROM h SEMI JOIN (SELECT k FROM h GROUP BY k HAVING count(*) > 1) r ON h.k = r.k),
        n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM w),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
        p AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, run),
        o AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS x, a - 1 AS y FROM p UNION ALL SELECT doc_id, max(z) + 1, 2147483647 FROM p GROUP BY doc_id),
        k AS (SELECT doc_id, string_agg(CASE WHEN y >= x THEN hex(b[x:y]) ELSE '' END, '' ORDER BY x) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id),
        t AS (SELECT doc_id, sum(z - a + 1) AS gone, count(*) AS runs FROM p GROUP BY doc_id)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)""",
    # every 50-word window with the least doc_id that it starts in, then the words that windows of later documents cover
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
        m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (k) WHERE least < doc_id),
        a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        k AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY a.p) AS kept FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        f AS (SELECT *, length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 14 AS n,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM t),
        p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix FROM f)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(prefix) FILTER (role = 'assistant' OR k = total)::BIGINT AS formatted_chars FROM p GROUP BY conv_id""",
}
