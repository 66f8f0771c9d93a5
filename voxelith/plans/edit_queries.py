"""Queries of edits, of what describes a world, and of its checks, each with SQL that another engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import address, scalar
from ..operators import edits as ed, rules, voxel as op
from ..sources.tables import REGISTRY, edits, materials, registry, table, voxels
from .queries import _AT, _BASE, _CHUNK, _LAST, _SIZES, _SUMMARY, G, _at, q_chunk_summary, query

CHUNK = (0, 0, 0, 1, 0, 1)
KEYS = [i * 7 % 5 for i in range(512)]


def fnv_sql(hexed: str) -> str:
    """SQL for FNV-1a, as 16 hex digits, of bytes given as hex digits."""
    codes = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST(CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS INTEGER) AS HUGEINT))"
    return f"lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {codes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0')"


@query(f"SELECT page_id, {fnv_sql('x')} AS hash FROM (SELECT page_id, lower(hex(encode(url))) AS x FROM pages)")
def q_fnv1a64(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.fnv1a64(F.col("url").cast("binary")).alias("hash"))


_LITTLE = "printf('%02x%02x%02x%02x', key & 255, key >> 8 & 255, key >> 16 & 255, key >> 24 & 255)"


@query(_AT + f""", cell AS (SELECT c.*, coalesce(key, 0) AS key FROM (SELECT DISTINCT {_CHUNK}, li FROM (SELECT DISTINCT {_CHUNK} FROM v), range(512) t(li)) c LEFT JOIN v USING ({_CHUNK}, li)),
t AS (SELECT {_CHUNK}, string_agg({_LITTLE}, '' ORDER BY li) AS x FROM cell GROUP BY {_CHUNK})
SELECT {_CHUNK}, {fnv_sql('x')} AS hash FROM t""")
def q_chunk_content_hash(spark, d):
    return ed.content_hashes(voxels(spark, d), G)


@query(_BASE + "one AS (SELECT 1) SELECT * FROM voxel")
def q_collect_region(spark, d):
    return ed.sparse_cells(ed.dense_chunks(voxels(spark, d), G), G)


_GONE = "rx = 0 AND ry = 0 AND rz = 0 AND cx = 1 AND cy = 0 AND cz = 1"


@query(_AT + f" SELECT x, y, z, key FROM v WHERE NOT ({_GONE})")
def q_remove_chunk(spark, d):
    return ed.remove_chunk(voxels(spark, d), G, CHUNK)


@query(_AT + f" SELECT x, y, z, key FROM v WHERE NOT ({_GONE}) UNION ALL SELECT 8 + i % 8, i // 8 % 8, 8 + i // 64, i * 7 % 5 FROM range(512) t(i) WHERE i * 7 % 5 <> 0")
def q_set_chunk(spark, d):
    return ed.set_chunk(voxels(spark, d), G, CHUNK, KEYS)


def _chunks(spark, d) -> DataFrame:
    return op.located(voxels(spark, d), G).groupBy(*op.CHUNK).agg(F.count("*").alias("non_air")).withColumn("flags", F.lit(ed.PRESENT | ed.HAS_VOXELS))


_CHUNKS = _AT + f", chunk AS (SELECT {_CHUNK}, count(*) AS non_air, 5 AS flags FROM v GROUP BY {_CHUNK})"


@query(_CHUNKS + f" SELECT {_CHUNK}, CASE WHEN {_GONE} THEN 0 ELSE non_air END AS non_air, CASE WHEN {_GONE} THEN 3 ELSE flags END AS flags FROM chunk")
def q_clear_chunk(spark, d):
    return ed.clear_chunk(_chunks(spark, d), CHUNK)


def _payloads(spark, d) -> DataFrame:
    """A payload for each chunk, and a second one, of a section by its place, for every other chunk."""
    c = _chunks(spark, d).select(*op.CHUNK, "non_air")
    section = F.when((F.col("non_air") % 2) == 0, 2).otherwise(3 + F.pmod(F.col("non_air"), F.lit(4))).cast("int")
    return c.select(*op.CHUNK, section.alias("section"), F.lit(1).alias("codec"), F.lit(0).alias("entry_flags"), F.encode(F.col("non_air").cast("string"), "utf-8").alias("bytes"))


_PAYLOADS = _CHUNKS + f", payload AS (SELECT {_CHUNK}, CASE WHEN non_air % 2 = 0 THEN 2 ELSE 3 + non_air % 4 END AS section, 1 AS codec, 0 AS entry_flags, CAST(non_air AS VARCHAR) AS text FROM chunk)"
_NEW = f"change AS (SELECT {_CHUNK}, CASE WHEN lx % 2 = 0 THEN 2 ELSE 4 END AS section, arg_max(li, li) AS codec, max(li) AS seq FROM v WHERE key = 3 GROUP BY ALL)"


@query(_PAYLOADS + f", {_NEW} SELECT {_CHUNK}, section, CAST(codec AS INTEGER) AS codec, 7 AS entry_flags, 'n' || seq AS text FROM change UNION ALL SELECT * FROM payload p WHERE NOT EXISTS (SELECT 1 FROM change c WHERE " + " AND ".join(f"c.{k} = p.{k}" for k in (*op.CHUNK, "section")) + ")")
def q_set_payload(spark, d):
    v = op.located(voxels(spark, d), G).where("key = 3")
    new = v.select(*op.CHUNK, F.when(F.col("lx") % 2 == 0, 2).otherwise(4).alias("section"), F.col("li").alias("seq"), F.col("li").cast("int").alias("codec"), F.lit(7).alias("entry_flags"), F.encode(F.concat(F.lit("n"), F.col("li").cast("string")), "utf-8").alias("bytes"))
    return ed.set_payload(_payloads(spark, d), new).select(*op.CHUNK, "section", "codec", "entry_flags", F.decode("bytes", "utf-8").alias("text"))


@query(_PAYLOADS + f" SELECT {_CHUNK}, non_air, 1 | CASE section WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 16 WHEN 5 THEN 32 ELSE 64 END AS flags FROM chunk JOIN payload USING ({_CHUNK}) WHERE NOT ({_GONE}) UNION ALL SELECT {_CHUNK}, non_air, 1 FROM chunk WHERE {_GONE}")
def q_chunk_flags(spark, d):
    kept = ed.without_chunk(_payloads(spark, d), CHUNK)
    return ed.chunk_flags(_chunks(spark, d), kept).select(*op.CHUNK, "non_air", "flags")


_REGIONS = _CHUNKS + ", " + _at("edit", "e") + ", region AS (SELECT DISTINCT rx, ry, rz FROM v UNION SELECT DISTINCT rx, ry, rz FROM e)"


def _regions(spark, d) -> DataFrame:
    """The regions of the world and of its edits: some hold no voxel yet."""
    return op.located(voxels(spark, d), G).select(*op.REGION).union(op.located(edits(spark, d), G).select(*op.REGION)).distinct()


@query(_REGIONS + " SELECT * FROM region WHERE (rx, ry, rz) IN (SELECT (rx, ry, rz) FROM chunk WHERE non_air > 0)")
def q_prune_empty_regions(spark, d):
    return ed.prune_empty_regions(_regions(spark, d), _chunks(spark, d))


@query(_REGIONS + " SELECT * FROM region WHERE NOT (rx = 0 AND ry = 0 AND rz = 0) UNION ALL SELECT 100000, 0, 0")
def q_add_remove_region(spark, d):
    return ed.add_region(ed.remove_region(_regions(spark, d), (0, 0, 0)), (100000, 0, 0))


@query(_REGIONS + " SELECT true AS explicit, min(rx) AS min_rx, min(ry) AS min_ry, min(rz) AS min_rz, max(rx) AS max_rx, max(ry) AS max_ry, max(rz) AS max_rz FROM region")
def q_rebuild_bounds(spark, d):
    return ed.rebuild_bounds(_regions(spark, d))


@query(_REGIONS + " SELECT * FROM region WHERE rx BETWEEN -1 AND 2 AND ry BETWEEN -1 AND 0 AND rz BETWEEN 0 AND 0")
def q_regions_in_bounds(spark, d):
    return ed.in_bounds(_regions(spark, d), (-1, -1, 0), (2, 0, 0))


@query(_CHUNKS + " SELECT rx, ry, rz, cx + non_air % 2 AS cx, cy, cz, non_air FROM chunk WHERE cx + non_air % 2 < 2")
def q_chunks_in_region(spark, d):
    c = _chunks(spark, d).select(*op.REGION, (F.col("cx") + F.col("non_air") % 2).alias("cx"), "cy", "cz", "non_air")
    return ed.inside_region(c, G)


@query(_REGIONS + " SELECT 'r_' || rx || '_' || ry || '_' || rz || '.bvx' AS path FROM region WHERE (rx, ry, rz) NOT IN (SELECT (rx, ry, rz) FROM v)")
def q_orphans(spark, d):
    def paths(r: DataFrame) -> DataFrame:
        return r.select(F.concat(F.lit("r_"), F.concat_ws("_", *op.REGION), F.lit(".bvx")).alias("path"))

    return ed.orphans(paths(_regions(spark, d)), paths(op.located(voxels(spark, d), G).select(*op.REGION).distinct()))


@query(_REGIONS + """, m AS (SELECT rx, ry, rz, 'r_' || rx || '_' || ry || '_' || rz AS path, (abs(rx) + 2 * abs(ry)) % 3 AS hash, CASE WHEN rx % 5 = 2 THEN rx + 1 ELSE rx END AS frx, (abs(rx) + 2 * abs(rz)) % 3 AS file_hash FROM region)
SELECT path, rx <> frx AS moved, hash <> 0 AND file_hash <> 0 AND hash <> file_hash AS other_hash FROM m WHERE rx <> frx OR (hash <> 0 AND file_hash <> 0 AND hash <> file_hash)""")
def q_hash_mismatch(spark, d):
    r = _regions(spark, d).withColumn("path", F.concat_ws("_", F.lit("r"), *op.REGION))
    manifest = r.withColumn("hash", (F.abs("rx") + 2 * F.abs("ry")) % 3)
    files = r.select("path", F.when(F.col("rx") % 5 == 2, F.col("rx") + 1).otherwise(F.col("rx")).alias("frx"), F.col("ry").alias("fry"), F.col("rz").alias("frz"), ((F.abs("rx") + 2 * F.abs("rz")) % 3).alias("file_hash"))
    return ed.hash_mismatches(manifest, files)


@query(_SUMMARY + f" SELECT {_CHUNK}, non_air, min_x, max_x, macro_lo, face_nx FROM s WHERE face_nx = 2")
def q_chunk_scan_meta(spark, d):
    return q_chunk_summary(spark, d).where("face_nx = 2").select(*op.CHUNK, "non_air", "min_x", "max_x", "macro_lo", "face_nx")


@query(_CHUNKS + " SELECT rx, ry, rz, 88 + 40 + count(*) * 88 AS resident FROM chunk GROUP BY 1, 2, 3")
def q_resident_bytes(spark, d):
    return ed.resident_bytes(_chunks(spark, d))


_TURNED = _BASE + "turned AS (SELECT x, -z - 1 AS y, y AS z, key FROM voxel), " + _at("turned", "v")


@query(_TURNED + f" SELECT {_CHUNK}, count(*) AS non_air, min(lx) AS min_x, max(lz) AS max_z FROM v GROUP BY {_CHUNK}")
def q_convert_chunks(spark, d):
    _, chunks, _ = ed.converted(voxels(spark, d), registry(spark), G, address.Y_UP, address.Z_UP)
    return chunks.select(*op.CHUNK, "non_air", "min_x", "max_z")


@query(_BASE + "one AS (SELECT 1) SELECT count(*) AS moved FROM voxel")
def q_convert_moved(spark, d):
    return ed.converted(voxels(spark, d), registry(spark), G, address.Y_UP, address.Z_UP)[2]


@query(_LAST.replace("FROM edit GROUP", "FROM edit WHERE seq % 97 = 0 GROUP") + """, after AS (SELECT x, y, z, coalesce(l.key, v.key) AS key FROM voxel v FULL JOIN lw l USING (x, y, z) WHERE coalesce(l.key, v.key) <> 0),
diff AS ((SELECT * FROM voxel EXCEPT SELECT * FROM after) UNION ALL (SELECT * FROM after EXCEPT SELECT * FROM voxel)), """ + _at("diff", "f") + " SELECT DISTINCT rx, ry, rz FROM f")
def q_dirty_regions(spark, d):
    v = voxels(spark, d)
    return ed.dirty_regions(v, op.set_voxels(v, edits(spark, d).where("seq % 97 = 0"), G), G)


_CHANGE = "change AS (SELECT event_id AS seq, event_id % 11 + 1 AS key, user_id AS material_id, CAST(event_id % 16 AS INTEGER) AS flags FROM events)"
_ORDERED = "reg AS (SELECT row_number() OVER () - 1 AS ordinal, * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}, {c}::BIGINT, {e}::BIGINT)" for a, b, c, e in REGISTRY) + ") t(key, flags, rgba, material_id))"


def _upsert_sql(change: str) -> str:
    """The registry's rows with new numbers, then new keys in the order of their first change."""
    return f"""WITH {_ORDERED}, {change},
last AS (SELECT key, arg_max(material_id, seq) AS m, arg_max(flags, seq) AS f, min(seq) AS seq FROM change GROUP BY key)
SELECT CAST(ordinal AS INTEGER) AS ordinal, key, coalesce(f, flags) AS flags, rgba, coalesce(m, material_id) AS material_id FROM reg LEFT JOIN last USING (key)
UNION ALL SELECT CAST({len(REGISTRY)} + row_number() OVER (ORDER BY seq, key) - 1 AS INTEGER), key, f, NULL, m FROM last WHERE key NOT IN (SELECT key FROM reg)"""


@query(_upsert_sql(_CHANGE))
def q_registry_upsert(spark, d):
    i = F.col("event_id")
    changes = table(spark, d, "events").select(i.alias("seq"), (i % 11 + 1).alias("key"), F.col("user_id").alias("material_id"), (i % 16).cast("int").alias("flags"))
    return ed.registry_upsert(registry(spark), changes)


_MIRROR = "mirror AS (SELECT p_partkey AS ordinal, p_partkey % 13 AS key, CAST(p_size AS BIGINT) AS material_id, CAST(p_partkey % 4 AS INTEGER) AS flags FROM part), change AS (SELECT min(ordinal) AS seq, key, arg_min(material_id, ordinal) AS material_id, arg_min(flags, ordinal) AS flags FROM mirror WHERE key <> 0 GROUP BY key)"


@query(_upsert_sql(_MIRROR))
def q_push_registry(spark, d):
    i = F.col("p_partkey")
    mirror = table(spark, d, "part").select(i.alias("ordinal"), (i % 13).alias("key"), F.col("p_size").cast("bigint").alias("material_id"), (i % 4).cast("int").alias("flags"))
    return ed.push_registry(registry(spark), mirror)


@query(_BASE + "gone AS (SELECT DISTINCT event_id % 4 AS key FROM events) SELECT key, rgba FROM registry WHERE key NOT IN (SELECT key FROM gone)")
def q_registry_remove(spark, d):
    keys = table(spark, d, "events").select((F.col("event_id") % 4).alias("key")).distinct()
    return ed.registry_remove(registry(spark), keys).select("key", "rgba")


@query(_BASE + f"change AS (SELECT event_id % 5 + 1 AS key, arg_max(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, event_id) AS name FROM events GROUP BY 1), j AS (SELECT key, c.key IS NOT NULL AS named, name, lower(hex(encode(name))) AS x FROM registry LEFT JOIN change c USING (key)) SELECT key, nullif(coalesce(name, 'old'), '') AS name, CASE WHEN coalesce(name, '') <> '' THEN {fnv_sql('x')} END AS name_hash FROM j")
def q_registry_names(spark, d):
    named = registry(spark).withColumn("name", F.lit("old")).withColumn("name_hash", F.lit(None).cast("string"))
    names = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 5 + 1).alias("key"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type")).alias("name"))
    return ed.set_names(named, names).select("key", "name", "name_hash")


@query(_BASE + "change AS (SELECT event_id % 9 AS key, arg_max(CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END, event_id) AS new FROM events GROUP BY 1) SELECT key, coalesce(new, rgba) AS rgba FROM registry FULL JOIN change USING (key) WHERE coalesce(new, rgba) <> 0")
def q_registry_colours(spark, d):
    changes = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 9).alias("key"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("user_id")).alias("rgba"))
    return ed.set_colours(registry(spark).select("key", "rgba"), changes)


_META = """WITH meta AS (SELECT DISTINCT p_partkey % 3 AS scope, 'k' || (p_partkey % 40) AS key, 'v' || (p_partkey % 40) AS value FROM part),
change AS (SELECT event_id % 4 AS scope, 'k' || (user_id % 50) AS key, arg_max(row(CASE WHEN event_id % 5 <> 0 THEN 'e' || event_id END), event_id) AS s FROM events GROUP BY 1, 2)
SELECT scope, key, CASE WHEN s IS NOT NULL THEN s[1] ELSE value END AS value FROM meta FULL JOIN change USING (scope, key) WHERE CASE WHEN s IS NOT NULL THEN s[1] ELSE value END IS NOT NULL"""


@query(_META)
def q_metadata_merge(spark, d):
    i, u = F.col("p_partkey"), F.col("event_id")
    meta = table(spark, d, "part").select((i % 3).alias("scope"), F.concat(F.lit("k"), i % 40).alias("key"), F.concat(F.lit("v"), i % 40).alias("value")).distinct()
    changes = table(spark, d, "events").select(u.alias("seq"), (u % 4).alias("scope"), F.concat(F.lit("k"), F.col("user_id") % 50).alias("key"), F.when(u % 5 != 0, F.concat(F.lit("e"), u)).alias("value"))
    return ed.merge_metadata(meta, changes)


@query(_BASE + "one AS (SELECT 1) SELECT r.key, r.material_id, m.tint FROM registry r JOIN material m USING (material_id)")
def q_registry_material(spark, d):
    return registry(spark).join(op.first_rows(materials(spark, d), "material_id"), "material_id").select("key", "material_id", "tint")


#: A world in which every rule but the geometry's is broken: repeated keys and regions, air registered, a region without chunks.
_FAULTY = _SUMMARY + f""", faulty(ordinal, key, material_id) AS (SELECT row_number() OVER () - 1, * FROM (VALUES (1::BIGINT, 11::BIGINT), (2, 12), (0, 5), (4, 99999999), (2, 13), (2, 14), (0, 6))),
region AS (SELECT row_number() OVER (ORDER BY rx, ry, rz, n) - 1 AS ordinal, rx, ry, rz, n FROM (SELECT DISTINCT rx, ry, rz, 0 AS n FROM s UNION ALL SELECT DISTINCT rx, ry, rz, 1 FROM s WHERE rx = 0 UNION ALL SELECT 99999, 0, 0, 0)),
placed AS (SELECT region.ordinal AS region, row_number() OVER (PARTITION BY region.ordinal ORDER BY cx, cy, cz) - 1 AS ordinal, rx, ry, rz, cx + CASE WHEN cx = 1 AND cy = 1 AND cz = 1 THEN 1 ELSE 0 END AS cx, cy, cz, top_key_0, top_key_1, top_key_2, top_key_3, cx AS ox FROM s JOIN top USING ({_CHUNK}) JOIN region USING (rx, ry, rz) WHERE n = 0),
texture(ordinal, path, problem) AS (VALUES (0, 'a.btx', NULL), (1, repeat('long', 40), 'no mip levels'))
"""
_RULES = """SELECT 7 AS code, 1 AS severity, -1::BIGINT AS region, -1::BIGINT AS chunk, 0::BIGINT AS key FROM faulty WHERE key = 0
UNION ALL SELECT 6, 2, -1, -1, key FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS r FROM faulty) WHERE r > 1
UNION ALL SELECT 15, 0, -1, -1, 0
UNION ALL SELECT 8, 2, -1, -1, 0 FROM texture WHERE length(path) > 127
UNION ALL SELECT 9, 2, -1, -1, 0 FROM texture WHERE problem IS NOT NULL
UNION ALL SELECT 2, 1, -1, -1, key FROM faulty WHERE key <> 0 AND material_id NOT IN (SELECT material_id FROM material)
UNION ALL SELECT 5, 2, ordinal, -1, 0 FROM (SELECT ordinal, row_number() OVER (PARTITION BY rx, ry, rz ORDER BY ordinal) AS r FROM region) WHERE r > 1
UNION ALL SELECT 3, 1, ordinal, -1, 0 FROM region WHERE NOT (rx BETWEEN -1 AND 1000 AND ry BETWEEN -2 AND 1 AND rz BETWEEN -1 AND 0)
UNION ALL SELECT 12, 0, ordinal, -1, 0 FROM region WHERE ordinal NOT IN (SELECT region FROM placed)
UNION ALL SELECT 4, 2, region, ordinal, 0 FROM placed WHERE cx >= 2 OR cy >= 2 OR cz >= 2
"""


def _faulty(spark, d) -> rules.World:
    from pyspark.sql import Window

    s = q_chunk_summary(spark, d)
    real = s.select(*op.REGION).distinct()
    more = real.select("*", F.lit(0).alias("n")).union(real.where("rx = 0").select("*", F.lit(1).alias("n"))).union(spark.createDataFrame([(99999, 0, 0, 0)], "rx bigint, ry bigint, rz bigint, n int"))
    regions = more.withColumn("ordinal", (F.row_number().over(Window.orderBy(*op.REGION, "n")) - 1).cast("bigint"))
    beyond = F.when((F.col("cx") == 1) & (F.col("cy") == 1) & (F.col("cz") == 1), 1).otherwise(0)
    chunks = s.join(regions.where("n = 0").withColumnRenamed("ordinal", "region"), op.REGION).select("region", (F.row_number().over(Window.partitionBy("region").orderBy("cx", "cy", "cz")) - 1).cast("bigint").alias("ordinal"), (F.col("cx") + beyond).alias("cx"), "cy", "cz", *(f"top_key_{i}" for i in range(4)))
    reg = spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate([(1, 11), (2, 12), (0, 5), (4, 99999999), (2, 13), (2, 14), (0, 6)])], "ordinal int, key bigint, material_id bigint")
    textures = spark.createDataFrame([(0, "a.btx", None), (1, "long" * 40, "no mip levels")], "ordinal int, path string, problem string")
    return rules.World(G.chunk, G.region, reg, textures, materials(spark, d).select("material_id"), regions, chunks, voxels(spark, d), ((-1, -2, -1), (1000, 1, 0)))


@query(_FAULTY + _RULES + " UNION ALL SELECT DISTINCT 1, 1, region, ordinal, k FROM (SELECT region, ordinal, unnest([top_key_0, top_key_1, top_key_2, top_key_3]) AS k FROM placed) WHERE k <> 0 AND k NOT IN (SELECT key FROM faulty)")
def q_validate_shallow(spark, d):
    return rules.validate(_faulty(spark, d))


@query(_FAULTY + _RULES + " UNION ALL SELECT DISTINCT 1, 1, p.region, p.ordinal, k.key FROM placed p JOIN k ON k.rx = p.rx AND k.ry = p.ry AND k.rz = p.rz AND k.cx = p.cx AND k.cy = p.cy AND k.cz = p.cz WHERE k.key NOT IN (SELECT key FROM faulty)")
def q_validate_deep(spark, d):
    return rules.validate(_faulty(spark, d), deep=True)


@query(_SIZES + f" SELECT {_CHUNK}, raw - payload AS saved, codec FROM size WHERE codec <> 6")
def q_codec_saving(spark, d):
    return op.codec_sizes(voxels(spark, d), G).where(F.col("codec") != op.RAW).select(*op.CHUNK, (F.col("raw") - F.col("payload")).alias("saved"), "codec")
