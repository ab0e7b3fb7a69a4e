"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    found = components(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, scores

    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), span=200).drop("kept")


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .idfiles import read, write

    path = scratch(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(spark, path)


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), weights=[1.0] * 24)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8, width=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest

    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multi_index_ann, op2_best_fit_packing, op3_simhash_dedup, op4_secret_scan, op5_toxicity, op6_suffix_dedup, op7_token_id_files, op8_rendezvous_sharding, op9_html_extraction, op10_decontamination, op11_merkle_manifest, op12_url_filter, op13_importance_resampling)}

_CONTAINMENT = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS width, unnest(list_distinct([array_to_string(w[k : k + least(5, len(w)) - 1], ' ') FOR k IN range(1, len(w) - least(5, len(w)) + 2)])) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM i),
s AS (SELECT doc_id, width, unnest(list_distinct([array_to_string(w[k : k + width - 1], ' ') FOR k IN range(1, len(w) - width + 2)])) AS s FROM d, widths WHERE len(w) >= width)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles, count(*) / any_value(n_shingles)::DOUBLE AS containment
FROM s JOIN i USING (width, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)"""

# the table of CRC-32, a row for each byte, and its checksum of a text
_CRC = """RECURSIVE cs(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM cs WHERE k < 8),
ct AS (SELECT list(c ORDER BY b) AS tab FROM cs WHERE k = 8)"""
_CRC_OF = "xor(list_reduce(list_transform(range(1, octet_length(encode({0})) + 1), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 1), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MANIFEST = f"""WITH {_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC_OF.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOW.format("text"))} END AS tampered FROM documents, ct),
g AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up(level, tree, pos, n, h) AS (SELECT 0, tree, pos, n, leaf FROM g UNION ALL SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, tree, pos // 8, (n + 7) // 8),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, n, h) AS (SELECT 0, pos, n, h FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, (n + 7) // 8),
runs AS (SELECT level, tree, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL), tops AS (SELECT level, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
w(r, tree, level, pos, n, node, met) AS (SELECT r, tree, 0, pos, n, coalesce(tampered, leaf), '' FROM g UNION ALL SELECT r, w.tree, w.level + 1, pos // 8, (n + 7) // 8, sha256(hs[1 : pos % 8 * 64] || node || hs[pos % 8 * 64 + 65 :]), met || hs[1 : pos % 8 * 64] || hs[pos % 8 * 64 + 65 :] FROM w JOIN runs ON runs.tree = w.tree AND runs.level = w.level AND runs.run = w.pos // 8 WHERE n > 1),
v(r, level, pos, n, node, met) AS (SELECT w.r, 0, s.pos, s.n, node, met FROM w JOIN s USING (tree) WHERE w.n = 1 UNION ALL SELECT r, v.level + 1, pos // 8, (n + 7) // 8, sha256(hs[1 : pos % 8 * 64] || node || hs[pos % 8 * 64 + 65 :]), met || hs[1 : pos % 8 * 64] || hs[pos % 8 * 64 + 65 :] FROM v JOIN tops ON tops.level = v.level AND tops.run = v.pos // 8 WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(v.met) AS proof_sha256, v.node AS folded_root, v.node = top.h AS verified FROM g JOIN s USING (tree) JOIN v ON v.r = g.r AND v.n = 1 JOIN top ON top.n = 1"""


def _urls_sql() -> str:
    from .urls import RULES, Vocabulary

    words = Vocabulary()
    terms = ", ".join(f"('{t}', {w})" for t, w in words.weights.items())
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lone = lambda at: f"coalesce(NOT regexp_matches(nullif(substr(low, {at}, 1), ''), '[\\p{{L}}\\p{{N}}]'), true)"
    alone = f"len(list_filter(range(1, len(low) + 1), lambda i: substr(low, i, len(term)) = term AND (i = 1 OR {lone('i - 1')}) AND {lone('i + len(term)')}))"
    return f"""WITH t(term, weight) AS (VALUES {terms}), ru(says, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, {_LOW.format(r"regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {_LOW.format("url_decode(coalesce(url, ''))")} AS low FROM pages),
c AS (SELECT r, weight, {alone} AS k FROM u, t), f AS (SELECT r, sum(weight) FILTER (k > 0) AS total, coalesce(sum(k) FILTER (weight >= {words.limit}), 0)::BIGINT AS n_strict, coalesce(sum(k) FILTER (weight < {words.limit}), 0)::BIGINT AS n_soft, count(*) FILTER (k > 0 AND weight < {words.limit}) AS n_soft_terms FROM c GROUP BY r),
b AS (SELECT r, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(says, len(rhost || rpath)) AS says FROM u JOIN ru ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN total >= {words.limit} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, n_soft_terms FROM u JOIN f USING (r) LEFT JOIN b USING (r)"""


def _features_sql(name: str, table: str) -> str:
    words = rf"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""{name}_w AS (SELECT row_number() OVER () AS r, *, {words} AS w FROM {table}), {name}_f AS (SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS f FROM {name}_w)"""


_RESAMPLED = f"""WITH {_CRC}, {_features_sql("d", "documents")}, {_features_sql("b", "benchmark")},
each AS (SELECT f FROM d_f UNION SELECT f FROM b_f), k AS MATERIALIZED (SELECT f, {_CRC_OF.format("f")} % 10000 AS bucket FROM each, ct),
s AS (SELECT bucket, count(*) AS s FROM d_f JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b_f JOIN k USING (f) GROUP BY bucket), sums AS (SELECT (SELECT sum(s) FROM s)::DOUBLE + 10000 AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000 AS tt),
gain AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ss) / ((s + 1)::DOUBLE * tt)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
wt AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM d_f JOIN k USING (f) JOIN gain USING (bucket) GROUP BY r),
hx AS (SELECT r, doc_id, len(w) >= 20 AS able, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1), lambda a, b: a * 16 + b) AS h FROM d_w LEFT JOIN wt USING (r)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM hx), rk AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (able) OVER () AS total FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * total // 100 THEN place END AS rank FROM rk"""

#: DuckDB SQL where it can express the operator on whole tables.
ORACLE: dict[str, str] = {"op10_decontamination": _CONTAINMENT, "op11_merkle_manifest": _MANIFEST, "op12_url_filter": _urls_sql(), "op13_importance_resampling": _RESAMPLED}
