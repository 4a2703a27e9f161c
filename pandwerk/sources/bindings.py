"""Register tables derived by Spark from the supplied order tables.

Orders play buildings, lineitems play dwelling units, nations play municipalities and regions
play label suppliers (regions 0-3 are the training sources, region 4 the case study), so every
row of the supplied tables is used. A flat binding is one SELECT that both Spark and the SQL check
understand; ``{name}`` marks a supplied table or another binding. Geometry columns are added by
the DataFrame functions below.

Buildings are laid out in tiles of 15,000 keys, so building density stays constant as the
tables grow, as it does when more towns are added to a register.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

FLAT = {
    "pand": """
        SELECT fid, nation, region, tile, gm_code,
               gm_code || lpad(cast(fid AS string), 12, '0') AS identificatie,
               CASE WHEN fid % 97 = 0 THEN 1005
                    ELSE cast(order_year - (fid % 90) AS int) END AS bouwjaar,
               CASE WHEN status = 'F' THEN 'Pand in gebruik'
                    WHEN status = 'O' THEN 'Pand in gebruik (niet ingemeten)'
                    WHEN fid % 3 = 0 THEN 'Bouw gestart'
                    ELSE 'Pand in gebruik' END AS pandstatus,
               CASE WHEN fid % 53 = 0 THEN order_date END AS einddatumtijdvakgeldigheid,
               cast((fid * 7919) % 2003 AS double) + cast(20000 * nation AS double) AS x0,
               cast((fid * 104729) % 2011 AS double) + cast(3000 AS double) * tile AS y0,
               cast(5 + fid % 11 AS double) AS w,
               cast(6 + fid % 13 AS double) AS d,
               cast(CASE WHEN fid % 101 = 0 THEN 18 + fid % 20
                         WHEN fid % 211 = 0 THEN 0
                         WHEN fid % 223 = 0 THEN 50
                         ELSE 1 + fid % 6 END AS int) AS floors,
               status
        FROM (SELECT o.o_orderkey AS fid, c.c_nationkey AS nation, n.n_regionkey AS region,
                     cast(floor(cast(o.o_orderkey AS double) / 15000) AS bigint) AS tile,
                     lpad(cast(c.c_nationkey AS string), 4, '0') AS gm_code,
                     year(o.o_orderdate) AS order_year, o.o_orderdate AS order_date,
                     o.o_orderstatus AS status
              FROM {orders} o
              JOIN {customer} c ON o.o_custkey = c.c_custkey
              JOIN {nation} n ON c.c_nationkey = n.n_nationkey) k
    """,
    "adres": """
        SELECT p.identificatie AS pandid,
               l.l_orderkey * 100 + l.l_linenumber AS adresseerbaarobject,
               l.l_quantity * cast(6 AS double) AS oppervlakteverblijfsobject,
               CASE WHEN l.l_orderkey % 41 = 0 THEN NULL
                    WHEN l.l_orderkey % 5 = 0 THEN
                        CASE l.l_returnflag WHEN 'A' THEN 'kantoorfunctie'
                                            WHEN 'R' THEN 'winkelfunctie'
                                            ELSE 'overige gebruiksfunctie' END
                    WHEN l.l_returnflag = 'A' AND l.l_orderkey % 4 = 0
                        THEN 'woonfunctie, kantoorfunctie'
                    ELSE 'woonfunctie' END AS verblijfsobjectgebruiksdoel,
               CASE WHEN l.l_linestatus = 'F' AND l.l_orderkey % 7 = 0
                        THEN 'Verblijfsobject ingetrokken'
                    WHEN l.l_linestatus = 'F' THEN 'Verblijfsobject gevormd'
                    ELSE 'Verblijfsobject in gebruik' END AS verblijfsobjectstatus
        FROM {lineitem} l JOIN {pand} p ON p.fid = l.l_orderkey
    """,
    "geo": """
        SELECT *, floors * (cast(22 AS double) / 10 + cast(fid % 17 AS double) / 16)
                  * CASE WHEN fid % 37 = 0 THEN cast(3 AS double)
                         WHEN fid % 43 = 0 THEN cast(4 AS double) / 10
                         WHEN floors >= 5 THEN cast(1 AS double) + t * t * t * t * cast(1.5 AS double)
                         ELSE cast(1 AS double) END AS h,
               CASE WHEN fid % 20 = 3 THEN 'unknown'
                    WHEN fid % 4 = 1 THEN 'multiple horizontal'
                    WHEN fid % 4 = 2 THEN 'single horizontal'
                    ELSE 'slanted' END AS dak_type
        FROM (SELECT *, cast(fid % 50 AS double) / 10 AS g, cast(fid % 23 AS double) / 23 AS t
              FROM {pand}) p
    """,
    "bag3d": """
        SELECT 'NL.IMBAG.Pand.' || identificatie AS identificatie, fid, pandstatus AS status,
               einddatumtijdvakgeldigheid AS eindgeldigheid, dak_type, g AS h_maaiveld
        FROM {geo} WHERE fid % 31 <> 0
    """,
    "lod12_2d": """
        SELECT fid, g + cast(0.5 AS double) * h AS h_dak_min, g + cast(0.9 AS double) * h AS h_dak_50p,
               g + h AS h_dak_70p, g + cast(1.1 AS double) * h AS h_dak_max
        FROM {geo} WHERE fid % 31 <> 0
    """,
    "esri": """
        SELECT identificatie,
               CASE fid % 6 WHEN 0 THEN 'vrijstaande woning' WHEN 1 THEN 'twee-onder-een-kap'
                            WHEN 2 THEN 'hoekwoning' WHEN 3 THEN 'tussenwoning/geschakeld'
                            WHEN 4 THEN 'appartement' ELSE 'onbekend' END AS woningtypering
        FROM {pand}
    """,
    "buurten": """
        SELECT 'GM' || gm_code AS gemeentecode,
               'BU' || gm_code || lpad(cast(tile AS string), 8, '0')
                    || lpad(cast(i * 10 + j AS string), 4, '0') AS buurtcode,
               cast(20000 * nation + i * 501 AS double) AS xmin,
               cast(20000 * nation + (i + 1) * 501 AS double) AS xmax,
               cast(3000 * tile + j * 503 AS double) AS ymin,
               cast(3000 * tile + (j + 1) * 503 AS double) AS ymax,
               cast(500 + (nation * 37 + i * 11 + j * 7) % 4000 AS int) AS bevolkingsdichtheid,
               cast((nation * 13 + i * 17 + j * 29) % 100 AS int) AS percentage_meergezinswoning,
               cast((nation + i * 3 + j * 5) % 40 AS double) / 8 AS afstand_winkels,
               cast((nation + i * 7 + j * 2) % 40 AS double) / 8 AS afstand_supermarkt,
               cast((nation + i * 2 + j * 9) % 40 AS double) / 8 AS afstand_cafe,
               cast((nation * 3 + i * 5 + j) % 60 AS double) / 4 AS aantal_winkels_1km,
               cast((nation * 5 + i + j * 3) % 60 AS double) / 4 AS aantal_supermarkt_1km,
               cast((nation * 7 + i * 2 + j * 4) % 60 AS double) / 4 AS aantal_cafe_1km
        FROM (SELECT DISTINCT gm_code, nation, tile FROM {pand}) m
        CROSS JOIN (VALUES (0), (1), (2), (3), (4)) a(i)
        CROSS JOIN (VALUES (0), (1), (2), (3), (4)) b(j)
    """,
    "gemeenten": """
        SELECT 'GM' || gm_code AS gemeentecode, tile, half,
               cast(20000 * nation AS double) AS xmin, cast(20000 * nation + 2505 AS double) AS xmax,
               cast(3000 * tile + half * 1257 AS double) AS ymin,
               cast(3000 * tile + 1257 + half * 1258 AS double) AS ymax
        FROM (SELECT DISTINCT gm_code, nation, tile FROM {pand}) m
        CROSS JOIN (VALUES (0), (1)) a(half)
    """,
    "label_c1": """
        SELECT fid, cast(identificatie AS bigint) AS identificatie,
               CASE WHEN fid % 8 = 1 THEN NULL
                    ELSE CASE WHEN fid % 3 = 0 THEN -1 ELSE 0 END END AS laagstebouwlaag,
               CASE WHEN fid % 8 = 1 OR fid % 8 = 2 THEN NULL
                    WHEN fid % 8 = 3 THEN CASE WHEN fid % 3 = 0 THEN -1 ELSE 0 END
                    ELSE floors - 1 END AS hoogstebouwlaag,
               floors + CASE WHEN fid % 3 = 0 THEN 1 ELSE 0 END AS aantalbouwlagen,
               CASE WHEN fid % 10 = 0 THEN NULL WHEN fid % 2 = 0 THEN 'hoek' ELSE 'tussen' END AS ligging,
               CASE WHEN fid % 9 = 0 THEN NULL WHEN fid % 5 < 2 THEN 'meergezins' ELSE 'eengezins' END AS typewoonobject
        FROM {pand} WHERE region = 0
    """,
    "label_c2": """
        SELECT cast(identificatie AS bigint) AS pand_id,
               CASE WHEN fid % 71 = 0 THEN NULL ELSE floors END AS floors
        FROM {pand} WHERE region = 1
    """,
    "label_c3_flats": """
        SELECT cast(identificatie AS bigint) AS pand_id, floors AS hoogste_bouwlaag,
               CASE WHEN fid % 4 < 2 THEN 'ET' ELSE 'WL' END AS et_wl
        FROM {pand} WHERE region = 2 AND status <> 'O'
    """,
    "label_c3_houses": """
        SELECT cast(identificatie AS bigint) AS pand_id, floors AS aantalbouwlagen_pand,
               CASE WHEN fid % 4 < 2 THEN 'ET' ELSE 'WL' END AS et_wl,
               CASE WHEN fid % 3 = 0 THEN 'J' ELSE 'N' END AS kelder_j_n,
               CASE WHEN fid % 7 = 0 THEN 'J' ELSE 'N' END AS vliering_j_n
        FROM {pand} WHERE region = 2 AND status = 'O'
    """,
    "label_c4": """
        SELECT cast(p.identificatie AS bigint) AS pnd_id_bag,
               CASE WHEN l.l_orderkey % 13 = 0 AND l.l_linenumber = 1 THEN ''
                    ELSE cast(l.l_linenumber - 1 AS string) END AS object_etageniveau
        FROM {lineitem} l JOIN {pand} p ON p.fid = l.l_orderkey
        WHERE p.region = 3
    """,
    "manual": """
        SELECT identificatie AS bag_id, floors AS td_floors,
               CASE WHEN fid % 2 = 0 THEN 'y' ELSE 'n' END AS is_clean, floors - 1 AS actual_floors
        FROM {pand} WHERE floors > 17
    """,
    "stock": """
        SELECT identificatie AS bag_id, fid, nation, region,
               CASE WHEN region = 0 THEN 'c1_ams' WHEN region = 1 THEN 'c2_rot'
                    WHEN region = 2 THEN 'c3_dhg' WHEN region = 3 THEN 'c4_rho'
                    WHEN nation < 10 THEN 'c5_dft' WHEN nation < 20 THEN 'c6_dwt'
                    ELSE 'c7_rhn' END AS data_source,
               floors AS no_floors,
               nullif(bouwjaar, 1005) AS bag_construction_year,
               CASE WHEN fid % 9 = 0 THEN 'Mixed-residential' ELSE 'Residential' END AS bag_function,
               w * d * floors * (cast(fid % 9 AS double) / 20 + cast(0.55 AS double)) AS bag_net_internal_area,
               cast(1 + floors * (fid % 3) AS int) AS bag_no_units,
               CASE fid % 6 WHEN 0 THEN 'detached' WHEN 1 THEN 'semi-detached' WHEN 2 THEN 'terraced'
                            WHEN 3 THEN 'terraced' WHEN 4 THEN 'apartment' END AS esri_building_type,
               cast(500 + (nation * 37 + (fid % 25) * 11) % 4000 AS int) AS cbs_pop_per_km2,
               cast((nation * 13 + (fid % 29) * 17) % 100 AS int) AS cbs_percent_multihousehold,
               cast(fid % 41 AS double) / 3 AS cbs_cafe_avg_1km,
               w * d AS footprint_area, cast(2 AS double) * (w + d) AS footprint_perim,
               cast(5 + fid % 4 AS double) AS footprint_no_vertices,
               cast(fid % 4 AS int) AS footprint_no_adjacent,
               cast(fid % 37 AS int) AS footprint_no_neighbours_100m,
               CASE WHEN fid % 31 <> 0 THEN dak_type END AS bag3d_roof_type,
               CASE WHEN fid % 31 <> 0 THEN g END AS bag3d_h_ground,
               CASE WHEN fid % 31 <> 0 THEN cast(0.5 AS double) * h END AS h_min,
               CASE WHEN fid % 31 <> 0 THEN cast(0.9 AS double) * h END AS h_50p,
               CASE WHEN fid % 31 <> 0 THEN h END AS h_70p,
               CASE WHEN fid % 31 <> 0 THEN cast(1.1 AS double) * h END AS h_max,
               CASE WHEN fid % 19 <> 0 AND fid % 31 <> 0 THEN
                    CASE WHEN dak_type = 'slanted' THEN cast(0.3 AS double) * h ELSE cast(0 AS double) END
                    END AS lod22_href_diff,
               CASE WHEN fid % 19 <> 0 THEN cast(2 AS double) * (w + d) * h END AS lod12_area_walls,
               CASE WHEN fid % 19 <> 0 THEN w * d END AS lod12_area_roof,
               CASE WHEN fid % 19 <> 0 THEN
                    CASE WHEN fid % 59 = 0 THEN cast('NaN' AS double) ELSE w * d * h END
                    END AS lod12_volume,
               CASE WHEN fid % 19 <> 0 THEN
                    CASE WHEN dak_type = 'slanted'
                         THEN cast(1.4 AS double) * (w + d) * h + cast(0.3 AS double) * d * h
                         ELSE cast(2 AS double) * (w + d) * h END END AS lod22_area_walls,
               CASE WHEN fid % 19 <> 0 THEN
                    CASE WHEN dak_type = 'slanted'
                         THEN cast(2 AS double) * w * sqrt(d * d / 4 + cast(0.09 AS double) * h * h)
                         ELSE w * d END END AS lod22_area_roof,
               CASE WHEN fid % 19 <> 0 THEN
                    CASE WHEN fid % 59 = 0 THEN cast('NaN' AS double)
                         WHEN dak_type = 'slanted' THEN cast(0.85 AS double) * w * d * h
                         ELSE w * d * h END END AS lod22_volume
        FROM {geo}
        WHERE pandstatus LIKE 'Pand in gebruik%' AND einddatumtijdvakgeldigheid IS NULL
    """,
    "train": """
        SELECT * FROM {stock} WHERE region < 4 AND no_floors BETWEEN 1 AND 48
    """,
    "case_study": """
        SELECT * FROM {stock} WHERE region = 4
    """,
    "pred": """
        SELECT t.bag_id, t.data_source, t.no_floors AS clean_floors, t.h_70p, t.bag_net_internal_area,
               t.footprint_area, v.model, v.algorithm, v.tuning_description,
               t.no_floors + (cast(t.fid % 9 AS double) - 4) / 4 + cast(v.shift AS double) / 8 AS pred_value,
               CASE WHEN t.fid % 5 = 0 THEN 'test' ELSE 'train' END AS split
        FROM {train} t
        CROSS JOIN (VALUES ('model_1', 'rfr', 'default', 0), ('model_1.4', 'gbr', 'tuned', 2),
                           ('model_1.5', 'svr', 'tuned', -4)) v(model, algorithm, tuning_description, shift)
    """,
}


def references(name: str) -> list[str]:
    """Tables and bindings a flat binding reads, in order of appearance."""
    seen = [f for _, f, _, _ in string.Formatter().parse(FLAT[name]) if f]
    return list(dict.fromkeys(seen))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FRAMES: dict[tuple, DataFrame] = {}


def flat(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A flat binding as a DataFrame; nothing is read until an action runs.

    The same plan object is handed out again, so Spark can reuse its exchanges. Bindings in ``given`` are taken from there.
    """
    if given:
        if name in given or name in BASE_TABLES:
            return given[name] if name in given else flat(spark, sf_dir, name)
        return spark.sql(FLAT[name], **{ref: flat(spark, sf_dir, ref, given) for ref in references(name)})
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _FRAMES:
        if name in BASE_TABLES:
            _FRAMES[key] = table(spark, sf_dir, name)
        else:
            inputs = {ref: flat(spark, sf_dir, ref) for ref in references(name)}
            _FRAMES[key] = spark.sql(FLAT[name], **inputs)
    return _FRAMES[key]


def rectangle(xmin, ymin, xmax, ymax) -> Column:
    """Footprint of one closed ring from corner columns."""
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (xmin, ymin, xmax, ymax))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def pand(spark, sf_dir, given=None) -> DataFrame:
    df = flat(spark, sf_dir, "pand", given)
    return df.withColumn(
        "geom", rectangle("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("d")))


def buurten(spark, sf_dir, given=None) -> DataFrame:
    return flat(spark, sf_dir, "buurten", given).withColumn("geom", rectangle("xmin", "ymin", "xmax", "ymax"))


def gemeenten(spark, sf_dir) -> DataFrame:
    return flat(spark, sf_dir, "gemeenten").withColumn("geom", rectangle("xmin", "ymin", "xmax", "ymax"))


def _face(sem: int, *corners) -> Column:
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in corners])
    return F.struct(F.lit(sem).alias("sem"), ring.alias("ring"))


def _quad(sem: int, a, b, c, d) -> list[Column]:
    return [_face(sem, a, b, c, a), _face(sem, a, c, d, a)]


def _box_faces(x0, y0, x1, y1, z0, z1) -> list[Column]:
    lo = [(x0, y0, z0), (x1, y0, z0), (x1, y1, z0), (x0, y1, z0)]
    hi = [(x, y, z1) for x, y, _ in lo]
    faces = _quad(0, lo[0], lo[3], lo[2], lo[1]) + _quad(1, *hi)
    for i in range(4):
        j = (i + 1) % 4
        faces += _quad(2, lo[i], lo[j], hi[j], hi[i])
    return faces


def _gable_faces(x0, y0, x1, y1, z0, ze, zr) -> list[Column]:
    ym = (y0 + y1) / 2
    lo = [(x0, y0, z0), (x1, y0, z0), (x1, y1, z0), (x0, y1, z0)]
    ev = [(x, y, ze) for x, y, _ in lo]
    r0, r1 = (x0, ym, zr), (x1, ym, zr)
    faces = _quad(0, lo[0], lo[3], lo[2], lo[1])
    faces += _quad(1, ev[0], ev[1], r1, r0) + _quad(1, ev[2], ev[3], r0, r1)
    for i in range(4):
        j = (i + 1) % 4
        faces += _quad(2, lo[i], lo[j], ev[j], ev[i])
    return faces + [_face(2, ev[1], ev[2], r1, ev[1]), _face(2, ev[3], ev[0], r0, ev[3])]


def _mesh_table(spark, sf_dir, faces: Column, given=None) -> DataFrame:
    """Every 29th mesh loses its last face, so open meshes occur."""
    kept = F.when(F.expr("fid % 29 = 0"), F.slice("faces", 1, F.size("faces") - 1)).otherwise(F.col("faces"))
    return (flat(spark, sf_dir, "geo", given).where("fid % 19 <> 0").select("fid", faces.alias("faces"))
            .select("fid", kept.alias("faces"), F.array().cast("array<int>").alias("val3dity_codes")))


def _extent():
    x0, y0 = F.col("x0"), F.col("y0")
    return x0, y0, x0 + F.col("w"), y0 + F.col("d"), F.col("g")


def lod12_3d(spark, sf_dir, given=None) -> DataFrame:
    x0, y0, x1, y1, g = _extent()
    return _mesh_table(spark, sf_dir, F.array(*_box_faces(x0, y0, x1, y1, g, g + F.col("h"))), given)


def lod22_3d(spark, sf_dir, given=None) -> DataFrame:
    x0, y0, x1, y1, g = _extent()
    h = F.col("h")
    gable = F.array(*_gable_faces(x0, y0, x1, y1, g, g + F.lit(0.7) * h, g + h))
    box = F.array(*_box_faces(x0, y0, x1, y1, g, g + h))
    return _mesh_table(spark, sf_dir, F.when(F.col("dak_type") == "slanted", gable).otherwise(box), given)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
