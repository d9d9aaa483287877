"""The subpackage's queries for the driver, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import fingerprint, lm, mixing, nearest, packing, quality, sharding, simhash, substring, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_packing": packing.op3_packing,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_nearest": nearest.op5_nearest,
        "op6_lm": lm.op6_lm,
        "op7_mixing": mixing.op7_mixing,
        "op8_warc": warc.op8_warc,
        "op9_sharding": sharding.op9_sharding,
        "op10_substring": substring.op10_substring,
    }


#: Largest page of equal payloads is the response. Base32 of a SHA-1: eight groups of five hexadecimal digits, four letters each.
_WARC = """WITH p AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
 g AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY x) AS last, list_transform(range(8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::BIGINT) AS parts FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g"""

#: A word goes where a run of 35 words that starts anywhere else too covers it.
_SUBSTRING = r"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 i AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d), s AS MATERIALIZED (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM i),
 t AS (SELECT r, i FROM s SEMI JOIN (SELECT s FROM s GROUP BY s HAVING count(*) > 1) USING (s)), c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM t),
 x AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d), k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": _WARC, "op10_substring": _SUBSTRING}
