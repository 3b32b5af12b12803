"""The registered queries of this subpackage: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    license_scan,
    line_dedup,
    merkle,
    one_bit_search,
    packing,
    quality,
    simhash,
    suffix_dedup,
    template_removal,
    toxicity,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_removal(spark, sf_dir):
    return template_removal.main_text(_table(spark, sf_dir, "pages"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("row_key")


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_retrieval_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op6_line_dedup(spark, sf_dir):
    return line_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_weak_quality(spark, sf_dir):
    return quality.assess(_table(spark, sf_dir, "documents"))


def op8_one_bit_search(spark, sf_dir):
    return one_bit_search.search(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.report(_table(spark, sf_dir, "documents"))


# Words as in common.alnum_words; {text} is a column. Only A-Z are lowered.
_WORDS = (
    "regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text="text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def _op3_sql() -> str:
    wanted = ", ".join(
        f"('{label}', {sorted(w.decode() for w in words)})" for label, words in license_scan.template_words() if words
    )
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS place, '{label}' AS label FROM spots WHERE w[i:i + {len(p.split()) - 1}] = {p.split()}"
        for p, label in license_scan.PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
spots AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
places AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                list_sort(list_distinct(list(label))) AS base FROM places GROUP BY rid),
blocks AS (SELECT rid, unnest(string_split(text, chr(10))) AS block FROM d
           UNION ALL
           SELECT rid, p FROM (SELECT rid, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS p FROM d) WHERE contains(trim(p, chr(10)), chr(10))),
bw AS (SELECT rid, list_distinct({_WORDS.format(text="block")}) AS w FROM blocks),
t(label, words) AS (VALUES {wanted}),
met AS (SELECT rid, label, max(share) AS share
        FROM (SELECT rid, label, len(list_intersect(bw.w, words)) / len(words) AS share, len(list_intersect(bw.w, words)) AS n,
                     ceil(0.8 * len(words) - 1e-9) AS need FROM bw, t) WHERE n >= need GROUP BY rid, label),
m AS (SELECT rid, list(label) AS labels, max(share) AS share FROM met GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, array_to_string(coalesce(base, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)
"""


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT rid, i, md5(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT rid, b, unnest(range(0, n - 199)) AS i FROM s WHERE n >= 200)),
r AS (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS before
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT rid, i, sum(CASE WHEN i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM r),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY rid, run),
kept AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS k, a, z FROM spans),
texts AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS gone, string_agg(hex(array_slice(b, k + 1, a)), '' ORDER BY a) AS head, max(z) AS last
          FROM kept JOIN s USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(head || hex(array_slice(b, last + 1, n)))) END AS kept_sha256
FROM s LEFT JOIN texts USING (rid)
"""

# Steps of a proof: at each level the sibling, if any, and whether it stands on the left.
OP13_SQL = """
WITH RECURSIVE
f AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
      concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
             CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
             CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
      CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 7 END AS chosen
      FROM documents),
l AS (SELECT rid, doc_id, lang,
      sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
      sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + CASE WHEN chosen = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':'
             || (n_chars + CASE WHEN chosen = 0 THEN 1 ELSE 0 END) END || tail) AS audited FROM f),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, count(*) OVER (PARTITION BY lang) AS n,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
t AS (SELECT g, 0 AS lvl, idx, n, leaf AS h FROM p
      UNION ALL
      SELECT g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, lvl, idx // 2, n),
top AS (SELECT g, lvl, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, g - 1 AS idx, (SELECT count(*) FROM top) AS n, h FROM top
      UNION ALL
      SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (SELECT rid, t.lvl AS k, (p.idx >> t.lvl) & 1 AS side, max(CASE WHEN t.idx = xor(p.idx >> t.lvl, 1::BIGINT) THEN t.h END) AS other
          FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.idx // 2 = (p.idx >> t.lvl) // 2 GROUP BY ALL
          UNION ALL
          SELECT rid, 1000 + u.lvl, ((p.g - 1) >> u.lvl) & 1, max(CASE WHEN u.idx = xor((p.g - 1) >> u.lvl, 1::BIGINT) THEN u.h END)
          FROM p JOIN u ON u.n > 1 AND u.idx // 2 = ((p.g - 1) >> u.lvl) // 2 GROUP BY ALL),
s AS (SELECT rid, side, other, row_number() OVER (PARTITION BY rid ORDER BY k) AS k FROM steps),
a AS (SELECT rid, 0::BIGINT AS k, audited AS h FROM p
      UNION ALL
      SELECT a.rid, s.k, sha256(CASE WHEN other IS NULL THEN a.h WHEN side = 1 THEN other || a.h ELSE a.h || other END)
      FROM a JOIN s ON s.rid = a.rid AND s.k = a.k + 1),
folded AS (SELECT rid, arg_max(h, k) AS folded_root FROM a GROUP BY rid),
proofs AS (SELECT rid, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof FROM s GROUP BY rid),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, top.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN top USING (g) JOIN folded USING (rid) LEFT JOIN proofs USING (rid), r
"""

CATALOG = {
    "op1_template_removal": (op1_template_removal, None),
    "op2_simhash": (op2_simhash, None),
    "op3_license_scan": (op3_license_scan, _op3_sql()),
    "op4_decontaminate": (op4_decontaminate, OP4_SQL),
    "op5_retrieval_packing": (op5_retrieval_packing, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_weak_quality": (op7_weak_quality, None),
    "op8_one_bit_search": (op8_one_bit_search, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op11_suffix_dedup": (op11_suffix_dedup, OP11_SQL),
    "op12_whitening": (op12_whitening, None),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
