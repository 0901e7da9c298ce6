"""Queries that answer for whole tables: copies, proofs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bisector_clusters, hash_index, merkle_manifest
from .queries import query, table

CLUSTERS = bisector_clusters.ClusterParams()


def cluster_sql(p: bisector_clusters.ClusterParams) -> str:
    """All rounds written out; every vector meets every centroid."""
    away = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS v
     FROM embeddings WHERE len(embedding) = {p.size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {p.size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k QUALIFY c < {p.clusters})"""
    for i in range(p.rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d)::BIGINT AS d FROM (SELECT k.r, c.c, {away} AS d FROM k, c{i} c) GROUP BY r)"""
        if i < p.rounds:
            sql += f""",
m{i} AS (SELECT a.c, j, sum(k.v[j])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN k USING (r), range(1, {p.size + 1}) t(j) GROUP BY a.c, j),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN n{i} n USING (c))"""
    n = p.rounds
    return sql + f"""
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM k JOIN a{n} a USING (r) JOIN c{n} c ON c.c = a.c"""


@query("op13_centroid_clusters", cluster_sql(CLUSTERS))
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisector_clusters.clustered(table(spark, folder, "embeddings"), CLUSTERS)


MERKLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
f AS (SELECT r, doc_id, lang, n_chars, unnest([0, 1]) AS forged,
             coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
             coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM d),
h AS (SELECT r, doc_id, lang, forged, sha256(a || coalesce(length((n_chars + forged)::VARCHAR) || ':' || (n_chars + forged), '-') || z) AS leaf FROM f),
-- zlib's checksum of the id, one bit at a time over its digits.
bits AS (SELECT r, doc_id, 0 AS i, 4294967295::BIGINT AS c FROM d UNION ALL
         SELECT r, doc_id, i + 1, list_reduce([CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, 1 + i // 8, 1))) ELSE c END, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)::BIGINT
         FROM bits WHERE i < 8 * length(doc_id::VARCHAR)),
crc AS (SELECT r, arg_max(xor(c, 4294967295), i) AS crc FROM bits GROUP BY r),
p AS (SELECT r, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h WHERE forged = 0),
t AS (SELECT lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM p GROUP BY lang),
q AS (SELECT r, leaf, pos, tree FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang),
up AS (SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM q UNION ALL
       SELECT tree, lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
       FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY pos) AS nxt FROM up) WHERE n > 1 AND pos % 2 = 0),
s AS (SELECT tree, lvl, h AS subroot FROM up WHERE n = 1),
roof AS (SELECT 0 AS lvl, tree AS pos, subroot AS h, count(*) OVER () AS n FROM s UNION ALL
         SELECT lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
         FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS nxt FROM roof) WHERE n > 1 AND pos % 2 = 0),
-- All nodes: a group's tree first, the tree over the groups on top of it.
node AS (SELECT tree, lvl, pos, h FROM up UNION ALL SELECT -1, lvl, pos, h FROM roof),
high AS (SELECT max(lvl) AS top FROM roof),
step AS (SELECT q.r, l.l AS stp, CASE WHEN l.l < s.lvl THEN q.tree ELSE -1 END AS tree, CASE WHEN l.l < s.lvl THEN l.l ELSE l.l - s.lvl END AS lvl,
                CASE WHEN l.l < s.lvl THEN q.pos >> l.l::INT ELSE q.tree >> (l.l - s.lvl)::INT END AS pos
         FROM q JOIN s USING (tree), high, range(0, 64) l(l) WHERE l.l < s.lvl + high.top),
sib AS (SELECT r, stp, step.pos % 2 AS odd, node.h AS h FROM step LEFT JOIN node ON node.tree = step.tree AND node.lvl = step.lvl AND node.pos = xor(step.pos, 1)),
fold AS (SELECT q.r, 0::BIGINT AS stp, CASE WHEN crc.crc % 7 = 0 THEN f.leaf ELSE q.leaf END AS h FROM q LEFT JOIN crc USING (r) JOIN h f ON f.r = q.r AND f.forged = 1 UNION ALL
         SELECT r, stp + 1, CASE WHEN odd = 1 THEN sha256(coalesce(sib.h, '') || fold.h) ELSE sha256(fold.h || coalesce(sib.h, '')) END FROM fold JOIN sib USING (r, stp)),
done AS (SELECT r, arg_max(h, stp) AS folded_root FROM fold GROUP BY r),
listed AS (SELECT r, string_agg(h, '' ORDER BY stp) AS x FROM sib GROUP BY r),
top AS (SELECT h AS root FROM roof WHERE n = 1)
SELECT d.doc_id, q.leaf, s.subroot, top.root, sha256(coalesce(listed.x, '')) AS proof_sha256, done.folded_root, done.folded_root = top.root AS verified
FROM d JOIN q USING (r) JOIN s USING (tree) JOIN done USING (r) LEFT JOIN listed USING (r), top
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.proofs(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


COPIES_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
g AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t
      WINDOW w AS (PARTITION BY x ORDER BY size DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(x) AS text_sha256 FROM g
"""


@query("op11_exact_dedup", COPIES_SQL)
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hash_index.groups(table(spark, folder, "documents"))
