"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, licenses, line_dedup, manifest, packing, page_text, pii, piece_codec, quality, simhash, suffix_dedup, token_counts, topk
from .textops import documents


def vocabulary_path(name: str) -> str:
    """A public tokenizer's file; its folder is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "n_notices", "licenses", F.round("best_coverage", 6).alias("best_coverage"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "leaf_index", "tampered")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_suffix_dedup, op3_piece_codec, op4_license_scan, op5_personal_data, op6_quality_rules, op7_exact_top_k, op8_line_dedup, op9_packing, op10_simhash, op11_page_text, op12_merkle_manifest, op13_filter_audit)
}

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
_SIBLINGS = "coalesce(string_agg(hash, '') OVER (PARTITION BY grp, level, number // 16 ORDER BY number ROWS BETWEEN {0}), '')"

ORACLES: dict[str, str] = {
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, {_LEAF.format(text="text")} AS leaf,
                 CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
        leaves AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
        nodes AS (
          SELECT grp, 0 AS level, idx AS number, leaf AS hash, n FROM leaves
          UNION ALL
          SELECT grp, level + 1, number // 16, sha256(string_agg(hash, '' ORDER BY number)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY grp, level, number // 16, n),
        subroots AS (SELECT grp, level AS height, hash AS subroot, row_number() OVER (ORDER BY grp) - 1 AS g FROM nodes WHERE n = 1),
        top AS (
          SELECT '' AS grp, 0 AS level, g AS number, subroot AS hash, (SELECT count(*) FROM subroots) AS n FROM subroots
          UNION ALL
          SELECT grp, level + 1, number // 16, sha256(string_agg(hash, '' ORDER BY number)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY grp, level, number // 16, n),
        sib AS (SELECT *, {_SIBLINGS.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {_SIBLINGS.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM nodes WHERE n > 1),
        top_sib AS (SELECT *, {_SIBLINGS.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {_SIBLINGS.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM top WHERE n > 1),
        path AS (
          SELECT x.rid, s.level AS step, s.l, s.r FROM leaves x JOIN sib s ON s.grp = x.grp AND s.number = x.idx >> (4 * s.level)
          UNION ALL
          SELECT x.rid, u.height + s.level, s.l, s.r FROM leaves x JOIN subroots u ON u.grp = x.grp JOIN top_sib s ON s.number = u.g >> (4 * s.level)),
        fold AS (
          SELECT rid, 0 AS step, coalesce(other, leaf) AS hash FROM leaves
          UNION ALL
          SELECT f.rid, f.step + 1, sha256(p.l || f.hash || p.r) FROM fold f JOIN path p ON p.rid = f.rid AND p.step = f.step),
        proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY rid),
        roots AS (SELECT hash AS root FROM top WHERE n = 1),
        folded AS (SELECT rid, arg_max(hash, step) AS folded_root FROM fold GROUP BY rid)
        SELECT x.doc_id, x.leaf, u.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified, x.source, x.idx AS leaf_index, x.other IS NOT NULL AS tampered
        FROM leaves x JOIN subroots u ON u.grp = x.grp JOIN folded f ON f.rid = x.rid LEFT JOIN proofs p ON p.rid = x.rid, roots r""",
    "op7_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op13_filter_audit": r"""
        WITH docs AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        bits AS (
          SELECT d.part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
                 [len(words) < 50, 100 * list_unique(words) < 65 * len(words),
                  100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text), regexp_matches(d.text, '[#$%&*|]'),
                  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY d.text), false)] AS fails
          FROM docs d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS quality, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
        masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM bits GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        orders AS (
          SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        steps AS (
          SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS letter,
                 list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before
          FROM orders, range(1, 6) r(step)),
        each AS (
          SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS fails_here,
                 len(list_filter(before, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS one_only
          FROM masks, steps),
        sums AS (
          SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS BIGINT) AS kept,
                 CAST(sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS BIGINT) AS removed,
                 CAST(sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS BIGINT) AS redundant,
                 CAST(sum(CASE WHEN fails_here AND one_only THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                 CAST(sum(CASE WHEN NOT gone AND fails_here AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
                 CAST(sum(CASE WHEN NOT gone AND fails_here AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
          FROM each GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM sums""",
}
