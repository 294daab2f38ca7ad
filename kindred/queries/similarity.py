"""Queries of the near-duplicate scan, with SQL where DuckDB can say it."""

from __future__ import annotations

import pyspark.sql.functions as F

from kindred.catalog import table
from kindred.operators import bounds, clustering, hamming, hashing, merge
from kindred.plans import scan as scans
from kindred.storage import materialise

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _hash_sql(name: str, part: int) -> str:
    """A word hash of each document as CTE ``name`` (doc_id, h)."""
    return f"""{name} AS (
  SELECT doc_id, coalesce(sum(CASE WHEN 63 * c > t THEN 1::HUGEINT << (63 - b) ELSE 0 END), 0)::BIGINT AS h FROM (
    SELECT doc_id, b, count(w) AS c, sum(count(w)) OVER (PARTITION BY doc_id) AS t FROM (
      SELECT doc_id, w, ('0x' || md5(w)[{2 * part + 1}:{2 * part + 2}])::INT % 64 AS b
      FROM (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS w FROM documents) a) z
    WHERE b > 0 GROUP BY doc_id, b) y GROUP BY doc_id)"""


H0, H1 = _hash_sql("h0", 0), _hash_sql("h1", 1)
_ALL0 = "a0 AS (SELECT d.doc_id, coalesce(h0.h, 0) AS h FROM documents d LEFT JOIN h0 ON h0.doc_id = d.doc_id)"
_ALL1 = "a1 AS (SELECT d.doc_id, coalesce(h1.h, 0) AS h FROM documents d LEFT JOIN h1 ON h1.doc_id = d.doc_id)"


def _group_sql(k: int, distance: int) -> str:
    """Single-link groups of hash table a{k} as g{k} (id, label)."""
    return f"""c{k} AS (SELECT h, min(doc_id) AS rep FROM a{k} GROUP BY h),
e{k} AS (SELECT x.rep AS a, y.rep AS b FROM c{k} x JOIN c{k} y ON x.rep <> y.rep AND bit_count(xor(x.h, y.h)) <= {distance}),
r{k} AS (SELECT rep AS id, rep AS label FROM c{k} UNION SELECT e{k}.b, r{k}.label FROM r{k} JOIN e{k} ON e{k}.a = r{k}.id WHERE r{k}.label < e{k}.b),
m{k} AS (SELECT id, min(label) AS label FROM r{k} GROUP BY id),
g{k} AS (SELECT a{k}.doc_id AS id, m{k}.label FROM a{k} JOIN c{k} ON c{k}.h = a{k}.h JOIN m{k} ON m{k}.id = c{k}.rep)"""


BASE0, BASE01 = f"WITH RECURSIVE {H0}, {_ALL0}", f"WITH RECURSIVE {H0}, {_ALL0}, {H1}, {_ALL1}"


def _hashed(spark, sf, parts=(0, 1)):
    return hashing.text_hashes(table(spark, sf, "documents"), "doc_id", "text", parts)


@query(f"{BASE01} SELECT a0.doc_id, a0.h AS h0, a1.h AS h1, lpad(to_hex(a0.h), 16, '0') AS hex0 FROM a0 JOIN a1 ON a0.doc_id = a1.doc_id".replace("to_hex", "printf('%x', ").replace("printf('%x', (a0.h)", "printf('%x', a0.h)"))
def text_hash(spark, sf):
    return _hashed(spark, sf).select("doc_id", "h0", "h1", hashing.hex_hash(F.col("h0")).alias("hex0"))


@query(f"{BASE0} SELECT h, min(doc_id) AS rep, count(*) AS members FROM a0 GROUP BY h")
def exact_hash_classes(spark, sf):
    return hamming.hash_classes(_hashed(spark, sf, (0,)), "doc_id", "h0")


def _pairs_sql(t: int) -> str:
    return f"{BASE0}, c AS (SELECT h, min(doc_id) AS rep FROM a0 GROUP BY h) SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.h, y.h))::INT AS dist FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.h, y.h)) <= {t}"


def _classes(spark, sf):
    return materialise(hamming.hash_classes(_hashed(spark, sf, (0,)), "doc_id", "h0"), "classes")


@query(_pairs_sql(8))
def hamming_pairs_t8(spark, sf):
    return hamming.class_pairs(_classes(spark, sf), 8)


@query(_pairs_sql(4))
def hamming_pairs_t4(spark, sf):
    return hamming.class_pairs(_classes(spark, sf), 4)


@query(f"{BASE0}, {_group_sql(0, 8)} SELECT * FROM g0")
def components_phash(spark, sf):
    return hamming.hash_groups(_stored(spark, sf, (0,)), "doc_id", "h0", 8)


def _stored(spark, sf, parts=(0, 1)):
    return materialise(_hashed(spark, sf, parts), "hashes")


@query(f"{BASE01}, {_group_sql(0, 8)}, {_group_sql(1, 8)}, e AS (SELECT id AS a, label AS b FROM g0 UNION SELECT id, label FROM g1 UNION SELECT label, id FROM g0 UNION SELECT label, id FROM g1), v AS (SELECT id, id AS label FROM g0 UNION SELECT e.b, v.label FROM v JOIN e ON e.a = v.id WHERE v.label < e.b), u AS (SELECT id, min(label) AS label FROM v GROUP BY id) SELECT id, label FROM u WHERE label IN (SELECT label FROM u GROUP BY label HAVING count(*) >= 2)")
def merge_union(spark, sf):
    hashed = _stored(spark, sf)
    return merge.merge_edges([hamming.hash_edges(hashed, "doc_id", h, 8) for h in ("h0", "h1")])


@query(f"{BASE01}, {_group_sql(0, 8)}, {_group_sql(1, 8)} SELECT id, label FROM (SELECT g0.id, min(g0.id) OVER w AS label, count(*) OVER w AS n FROM g0 JOIN g1 ON g0.id = g1.id WINDOW w AS (PARTITION BY g0.label, g1.label)) x WHERE n >= 2")
def merge_intersection(spark, sf):
    return merge.merge_groups(hamming.hash_groups_of(_stored(spark, sf), "doc_id", {"h0": 8, "h1": 8}), "intersection")


@query(f"""{BASE0}, {_group_sql(0, 8)}, q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
x AS (SELECT g0.label, g0.id, d.n_chars, coalesce(q.quality, 0) AS quality FROM g0 JOIN documents d ON d.doc_id = g0.id LEFT JOIN q ON q.doc_id = g0.id)
SELECT label AS group_id, count(*) AS file_count, sum(n_chars)::BIGINT AS total_size, arg_max(id, quality * 1000000000 - id) AS master_id, max(quality)::INT AS master_quality FROM x GROUP BY label HAVING count(*) >= 2""")
def scan_doc_neardup_groups(spark, sf):
    return scans.document_groups(table(spark, sf, "documents"), table(spark, sf, "labels"))


_GREY = "grey AS (SELECT vec_id AS seq, vec_id // 8 AS group_id, list_transform(embedding, lambda x: least(255, greatest(0, floor(x::DOUBLE * 64 + 128)))::INT) AS g FROM embeddings)"


def _grey(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.floor(F.col("vec_id") / 8).cast("long").alias("group_id"), hashing.raster(F.col("embedding")).alias("grey"))


@query(f"WITH {_GREY} SELECT seq, list_sum([CASE WHEN g[r * 8 + c + 1] < g[r * 8 + c + 2] THEN 1::HUGEINT << (55 - r * 7 - c) ELSE 0 END FOR r IN range(8) FOR c IN range(7)])::BIGINT AS h FROM grey".replace("FOR r IN range(8) FOR c IN range(7)", "FOR k IN range(56)").replace("r * 8 + c", "(k // 7) * 8 + k % 7").replace("55 - r * 7 - c", "55 - k"))
def dhash_8x8(spark, sf):
    return _grey(spark, sf).select("seq", hashing.difference_hash(F.col("grey")).alias("h"))


_DCT = f"""{_GREY}, p AS (SELECT seq, k, g[k + 1] AS v FROM grey, range(64) t(k)),
w AS (SELECT u * 8 + v AS f, x * 8 + y AS k, 0.25 * (CASE WHEN u = 0 THEN 1 / sqrt(2) ELSE 1 END) * (CASE WHEN v = 0 THEN 1 / sqrt(2) ELSE 1 END) * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v * pi() / 16) AS m FROM range(8) a(u), range(8) b(v), range(8) c(x), range(8) d(y)),
co AS (SELECT seq, f, sum(v * m) AS c FROM p JOIN w USING (k) GROUP BY seq, f)"""


@query(f"WITH {_DCT} SELECT seq, f::INT AS f, round(round(c, 6), 3) + 0.0 AS c FROM co WHERE f < 4")
def dct_8x8_low(spark, sf):
    rows = _grey(spark, sf).select("seq", F.posexplode(hashing.dct_coefficients("grey")).alias("f", "c")).where(F.col("f") < 4)
    return rows.select("seq", "f", (F.round("c", 3) + 0.0).alias("c"))


@query(f"WITH {_DCT} SELECT seq, f::INT AS f, round(round(c, 6), 3) + 0.0 AS c FROM co")
def dct_8x8(spark, sf):
    rows = _grey(spark, sf).select("seq", F.posexplode(hashing.dct_coefficients("grey")).alias("f", "c"))
    return rows.select("seq", "f", (F.round("c", 3) + 0.0).alias("c"))


@query(f"WITH {_DCT}, m AS (SELECT *, avg(c) FILTER (f > 0) OVER (PARTITION BY seq) AS mean FROM co) SELECT seq, coalesce(sum(CASE WHEN f > 0 AND c > mean THEN 1::HUGEINT << (63 - f) ELSE 0 END), 0)::BIGINT AS h FROM m GROUP BY seq")
def phash_8x8(spark, sf):
    return _grey(spark, sf).select("seq", hashing.perceptual_hash("grey").alias("h"))


@query(f"""WITH {_GREY}, l AS (SELECT seq, unnest([g[k - 8 + 1] + g[k + 8 + 1] + g[k] + g[k + 2] - 4 * g[k + 1] FOR k IN [r * 8 + c FOR r IN range(1, 7) FOR c IN range(1, 7)]]) AS v FROM grey)
SELECT seq, round(100 * (1 - exp(-((36 * sum(v * v) - sum(v) * sum(v)) / 1296.0) / 500.0)), 2) AS quality FROM l GROUP BY seq""".replace("[r * 8 + c FOR r IN range(1, 7) FOR c IN range(1, 7)]", "[(i // 6 + 1) * 8 + i % 6 + 1 FOR i IN range(36)]"))
def laplacian_quality(spark, sf):
    return _grey(spark, sf).select("seq", hashing.quality(F.col("grey")).alias("quality"))


_PAIR = f"WITH {_GREY}, pr AS (SELECT a.group_id, a.seq AS i, b.seq AS j, a.g AS x, b.g AS y FROM grey a JOIN grey b ON a.group_id = b.group_id AND a.seq < b.seq)"


@query(f"{_PAIR} SELECT group_id, i, j, round(list_sum([(x[k + 1] - y[k + 1]) * (x[k + 1] - y[k + 1]) FOR k IN range(64)]) / (64 * 65025.0), 6) AS score FROM pr")
def verify_nmse_pairs(spark, sf):
    return clustering.group_pairs(_grey(spark, sf), hashing.nmse, ["group_id"]).withColumn("score", F.round("score", 6))


@query(f"""{_PAIR}, s AS (SELECT group_id, i, j, list_sum(x) / 64.0 AS ma, list_sum(y) / 64.0 AS mb, list_sum([v * v FOR v IN x]) / 64.0 AS qa, list_sum([v * v FOR v IN y]) / 64.0 AS qb, list_sum([x[k + 1] * y[k + 1] FOR k IN range(64)]) / 64.0 AS ab FROM pr)
SELECT group_id, i, j, round(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (qa - ma * ma + qb - mb * mb + 58.5225)), 6) AS score FROM s""")
def verify_ssim_pairs(spark, sf):
    return clustering.group_pairs(_grey(spark, sf), hashing.ssim, ["group_id"]).withColumn("score", F.round("score", 6))


def _first_fit_sql(name: str, items: str, links: str) -> str:
    """First fit of ``items`` (g, seq) over ``links`` (g, i, j) as CTE ``name`` (g, seq, cluster)."""
    return f"""{name}_n AS (SELECT g, seq, row_number() OVER (PARTITION BY g ORDER BY seq) AS k FROM {items}),
{name}_b AS (SELECT n.g, n.seq, n.k, coalesce(list(l.i) FILTER (l.i IS NOT NULL), []) AS before FROM {name}_n n LEFT JOIN {links} l ON l.g = n.g AND l.j = n.seq GROUP BY ALL),
{name}_f AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[][] AS c FROM {items}
  UNION ALL SELECT g, k, CASE WHEN spot IS NULL THEN list_append(c, [seq]) ELSE list_transform(c, lambda x, i: CASE WHEN i = spot THEN list_append(x, seq) ELSE x END) END
  FROM (SELECT f.g, b.k, f.c, b.seq, list_position(list_transform(f.c, lambda x: list_has_all(b.before, x)), true) AS spot FROM {name}_f f JOIN {name}_b b ON b.g = f.g AND b.k = f.k + 1) s),
{name}_e AS (SELECT g, arg_max(c, k) AS c FROM {name}_f GROUP BY g),
{name} AS (SELECT g, unnest(x) AS seq, cluster FROM (SELECT g, unnest(c) AS x, (generate_subscripts(c, 1) - 1)::INT AS cluster FROM {name}_e) u)"""


_SSIM = "SELECT group_id AS g, i, j, ((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (qa - ma * ma + qb - mb * mb + 58.5225)) AS score FROM (SELECT group_id, i, j, list_sum(x) / 64.0 AS ma, list_sum(y) / 64.0 AS mb, list_sum([v * v FOR v IN x]) / 64.0 AS qa, list_sum([v * v FOR v IN y]) / 64.0 AS qb, list_sum([x[k + 1] * y[k + 1] FOR k IN range(64)]) / 64.0 AS ab FROM pr) s"
_RECURSIVE = _PAIR.replace("WITH", "WITH RECURSIVE", 1)


@query(f"{_RECURSIVE}, l AS (SELECT g, i, j FROM ({_SSIM}) z WHERE score >= 0.05), m AS (SELECT group_id AS g, seq FROM grey), {_first_fit_sql('f', 'm', 'l')} SELECT g AS group_id, seq, cluster FROM f")
def greedy_ssim_clusters(spark, sf):
    return clustering.clustered(_grey(spark, sf), bounds.ssim_verifier(0.05), ["group_id"])


@query(f"""{_RECURSIVE}, l AS (SELECT g, i, j FROM ({_SSIM}) z WHERE score >= 0.0), m AS (SELECT group_id AS g, seq FROM grey), {_first_fit_sql('f', 'm', 'l')},
n AS (SELECT g AS h, seq, cluster AS c0, g * 1000 + cluster AS g FROM f QUALIFY count(*) OVER (PARTITION BY g, cluster) >= 2),
o AS (SELECT a.g, i, j FROM pr JOIN n a ON a.seq = i JOIN n b ON b.seq = j AND b.g = a.g WHERE list_sum([(x[k + 1] - y[k + 1]) * (x[k + 1] - y[k + 1]) FOR k IN range(64)]) / (64 * 65025.0) <= 0.013), {_first_fit_sql('e', 'n', 'o')}
SELECT n.h AS group_id, n.seq, n.c0, e.cluster AS c1 FROM n JOIN e ON e.seq = n.seq QUALIFY count(*) OVER (PARTITION BY n.g, e.cluster) >= 2""")
def verify_chain_ssim_nmse(spark, sf):
    chain = [bounds.ssim_verifier(0.0), bounds.nmse_verifier(0.013)]
    return clustering.verify(_grey(spark, sf), chain).select("group_id", "seq", "c0", "c1")


@query()
def scan_rasters_balanced(spark, sf):
    """The whole image scan on embedding rasters; thresholds suit random rasters."""
    preset = scans.Preset(("phash", "dhash"), {"phash": 14, "dhash": 14}, "union", ("ssim",), {"ssim": 0.1})
    return scans.scan(_grey(spark, sf), preset)
