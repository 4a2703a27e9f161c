"""SQL equivalents of the registered queries, over the same supplied tables."""

from __future__ import annotations

from oracles.ctes import sql, view

ORACLES: dict[str, str] = {}


def check(name: str, text: str) -> None:
    ORACLES[name] = sql(text)


# --- shared intermediate selects -------------------------------------------------------------

view("units", """SELECT * FROM {adres} WHERE verblijfsobjectstatus IN
    ('Verblijfsobject in gebruik', 'Verblijfsobject in gebruik (niet ingemeten)', 'Verblijfsobject gevormd')""")
view("unit_uses", """SELECT pandid, unnest(string_split(verblijfsobjectgebruiksdoel, ', ')) AS use
    FROM {units} WHERE verblijfsobjectgebruiksdoel IS NOT NULL""")
view("use_sets", """SELECT pandid, list_sort(list(DISTINCT use)) AS uses,
    cast(sum(CASE WHEN use = 'woonfunctie' THEN 1 ELSE 0 END) AS int) AS residential_uses
    FROM {unit_uses} GROUP BY pandid""")
view("unit_stats", """SELECT u.pandid AS bag_id, u.area AS bag_net_internal_area, u.n AS bag_no_units,
    coalesce(s.uses, []) AS uses, s.residential_uses
    FROM (SELECT pandid, sum(oppervlakteverblijfsobject) AS area, cast(count(adresseerbaarobject) AS int) AS n
          FROM {units} GROUP BY pandid) u LEFT JOIN {use_sets} s ON u.pandid = s.pandid""")
view("classes", """SELECT p.identificatie AS bag_id, s.bag_net_internal_area, s.bag_no_units, s.residential_uses,
    CASE WHEN s.uses = ['woonfunctie'] THEN 'Residential'
         WHEN s.uses <> ['woonfunctie'] AND list_contains(s.uses, 'woonfunctie') THEN 'Mixed-residential'
         WHEN len(s.uses) = 1 AND s.uses <> ['overige gebruiksfunctie'] THEN 'Non-residential (single-function)'
         WHEN len(s.uses) > 1 THEN 'Non-residential (multi-function)'
         WHEN s.uses = ['overige gebruiksfunctie'] THEN 'Others'
         WHEN s.uses IS NULL THEN 'Unknown' END AS bag_function
    FROM {pand} p LEFT JOIN {unit_stats} s ON s.bag_id = p.identificatie""")
view("residential", """SELECT * FROM {classes}
    WHERE NOT coalesce(bag_function <> 'Residential' AND bag_function <> 'Mixed-residential', false)""")
view("register3d", """SELECT substring(identificatie, 15) AS bag_id, dak_type AS bag3d_roof_type, fid AS bag3d_id,
    h_maaiveld AS bag3d_h_ground FROM {bag3d}
    WHERE status LIKE 'Pand in gebruik%' AND eindgeldigheid IS NULL""")
view("around", """SELECT c.bag_id, c.bag_function, p.x0, p.y0, p.x0 + p.w AS x1, p.y0 + p.d AS y1,
    p.x0 + p.w / 2 AS x, p.y0 + p.d / 2 AS y
    FROM {pand} p JOIN {classes} c ON c.bag_id = p.identificatie
    WHERE p.pandstatus LIKE '%Pand in gebruik%' AND p.einddatumtijdvakgeldigheid IS NULL""")
view("around_targets", """SELECT *, coalesce(bag_function <> 'Others' AND bag_function <> 'Unknown', false) AS counts
    FROM {around} WHERE NOT coalesce(bag_function <> 'Residential' AND bag_function <> 'Mixed-residential', false)""")
view("around_counted", "SELECT * FROM {around} WHERE bag_function <> 'Others' AND bag_function <> 'Unknown'")
# The storeys below ground are those down to the lowest end recorded; a range of two ends must hold as many
# storeys above ground as the highest end says, and its ends must differ.
view("storey_ends", """SELECT *, aantalbouwlagen - abs(CASE WHEN hoogstebouwlaag IS NULL THEN least(coalesce(laagstebouwlaag, 0), 0)
      ELSE least(hoogstebouwlaag, laagstebouwlaag) END) AS above_ground,
    hoogstebouwlaag <> laagstebouwlaag AND aantalbouwlagen - abs(laagstebouwlaag) - hoogstebouwlaag = 1 AS ends_agree
    FROM {label_c1}""")
view("c1", """SELECT lpad(cast(identificatie AS varchar), 16, '0') AS bag_id, cast(CASE
      WHEN ends_agree OR (hoogstebouwlaag IS NULL AND above_ground >= 0) THEN above_ground END AS int) AS no_floors,
    concat(ligging, '; ', typewoonobject) AS notes FROM {storey_ends}""")
view("c2", """SELECT lpad(cast(pand_id AS varchar), 16, '0') AS bag_id, floors AS no_floors,
    cast(NULL AS varchar) AS notes FROM {label_c2}""")
view("c3", """SELECT lpad(cast(pand_id AS varchar), 16, '0') AS bag_id, hoogste_bouwlaag AS no_floors,
    concat('galerijflat; etage or woonlaag: ', et_wl) AS notes FROM {label_c3_flats}
    UNION ALL SELECT lpad(cast(pand_id AS varchar), 16, '0'), aantalbouwlagen_pand,
    concat('woonhuis; etage or woonlaag: ', et_wl, '; basement: ', kelder_j_n, '; loft: ', vliering_j_n)
    FROM {label_c3_houses}""")
view("c4", """SELECT lpad(cast(pnd_id_bag AS varchar), 16, '0') AS bag_id,
    cast(max(cast(object_etageniveau AS int)) + 1 AS int) AS no_floors, cast(NULL AS varchar) AS notes
    FROM {label_c4} WHERE object_etageniveau <> '' GROUP BY pnd_id_bag""")
view("labelled", """SELECT *, 'c1_ams' AS data_source FROM {c1} UNION ALL SELECT *, 'c2_rot' FROM {c2}
    UNION ALL SELECT *, 'c3_dhg' FROM {c3} UNION ALL SELECT *, 'c4_rho' FROM {c4}""")
view("ref", """SELECT *, coalesce(floors_height_based, floors_area_based) AS ref_model,
    coalesce(floors_height_based_unrounded, floors_area_based_unrounded) AS ref_model_unrounded
    FROM (SELECT bag_id, cast(round_even(h_70p / 2.65::DOUBLE, 0) AS int) AS floors_height_based,
          cast(round_even(bag_net_internal_area / nullif(footprint_area, 0) + 0.4::DOUBLE, 0) AS int) AS floors_area_based,
          h_70p / 2.65::DOUBLE AS floors_height_based_unrounded,
          bag_net_internal_area / nullif(footprint_area, 0) AS floors_area_based_unrounded FROM {stock}) r""")
view("errors", "SELECT *, round_even(pred_value, 0) AS p, abs(clean_floors - round_even(pred_value, 0)) AS e FROM {pred}")
view("imported", """SELECT *, CASE WHEN no_floors % 7 <> 0 THEN 'y' END AS is_clean,
    CASE WHEN no_floors % 7 <> 0 THEN no_floors END AS clean_floors FROM {train}""")
HIGH = "no_floors > 17 AND (h_70p / clean_floors > 4.5 OR h_70p / clean_floors < 2)"
VOLUME = ("is_clean IS NOT NULL AND (footprint_area * h_70p > 2 * lod12_volume "
          "OR footprint_area * h_70p * 2 < lod12_volume)")
AREA = ("is_clean IS NOT NULL AND (bag_net_internal_area / clean_floors < 10 "
        "OR bag_net_internal_area / clean_floors > 2.5 * footprint_area)")
view("complete", """SELECT * FROM {train} WHERE h_70p IS NOT NULL AND bag3d_roof_type IS NOT NULL
    AND bag_function IS NOT NULL AND no_floors IS NOT NULL""")
view("storeys", """SELECT *, h_70p / no_floors AS avg_h_storey FROM {complete}
    WHERE no_floors <= 17 AND bag3d_roof_type IN ('slanted', 'multiple horizontal', 'single horizontal')""")
view("iqr0", "SELECT * FROM {storeys} WHERE avg_h_storey > 1.5")
view("fence1", """SELECT no_floors, quantile_cont(h_70p, 0.25) AS q1, quantile_cont(h_70p, 0.75) AS q3
    FROM {iqr0} GROUP BY no_floors""")
view("iqr1", """SELECT s.*, (h_70p < q1 - 1.5 * (q3 - q1) OR h_70p > q3 + 1.5 * (q3 - q1)) AS is_outlier
    FROM {iqr0} s JOIN {fence1} f ON s.no_floors = f.no_floors""")
view("fence2", """SELECT no_floors, quantile_cont(h_70p, 0.25) AS q1, quantile_cont(h_70p, 0.75) AS q3
    FROM {iqr1} WHERE NOT is_outlier GROUP BY no_floors""")
view("steps", """SELECT bag_id, 1 AS removed_at_step FROM {storeys} WHERE NOT avg_h_storey > 1.5
    UNION ALL SELECT bag_id, 2 FROM {iqr1} WHERE is_outlier
    UNION ALL SELECT s.bag_id, CASE WHEN h_70p < q1 - 1.5 * (q3 - q1) OR h_70p > q3 + 1.5 * (q3 - q1) THEN 3 ELSE 0 END
    FROM {iqr1} s JOIN {fence2} f ON s.no_floors = f.no_floors WHERE NOT s.is_outlier""")
FEATURES = """bag_construction_year bag_net_internal_area bag_no_units cbs_pop_per_km2 cbs_percent_multihousehold
    cbs_cafe_avg_1km footprint_area footprint_perim footprint_no_vertices footprint_no_adjacent
    footprint_no_neighbours_100m h_50p h_70p h_max h_min lod22_href_diff lod12_area_walls lod12_area_roof
    lod12_volume lod22_area_walls lod22_area_roof lod22_volume""".split()
view("clean_nan", "SELECT bag_id, bag_function, bag3d_roof_type, esri_building_type, no_floors AS clean_floors, " + ", ".join(
    f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS {c}" for c in FEATURES) + " FROM {train}")
view("full_rows", "SELECT * FROM {clean_nan} WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in [*FEATURES, "bag_function", "bag3d_roof_type", "esri_building_type"]))
REGION_WHERE = "xmin <= 300000 AND xmax >= 90000 AND ymin <= 1e12 AND ymax >= -10"
PAND_REGION = REGION_WHERE.replace("xmin", "x0").replace("xmax", "x0 + w").replace("ymin", "y0").replace("ymax", "y0 + d")

# --- sources and sinks -----------------------------------------------------------------------

check("s01_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
check("s02_spatial_scan", "SELECT identificatie, 5 AS n_points, x0 + w AS x_far, y0 + d AS y_far FROM {pand} WHERE bouwjaar > 1950")
check("s03_region_clip", "SELECT identificatie, 28992 AS srid FROM {pand} WHERE einddatumtijdvakgeldigheid IS NULL AND " + PAND_REGION)
check("s04_collect_sources", """SELECT bag_id, no_floors, h_70p, data_source FROM {stock}
    WHERE data_source IN ('c1_ams', 'c2_rot', 'c3_dhg', 'c4_rho') AND bag3d_roof_type IS NOT NULL""")
check("s06_manual_label_csv", "SELECT * FROM {manual}")
HEIGHT_CLASS = """CASE WHEN h_70p > 10 THEN 5 WHEN h_70p > 8 THEN 4 WHEN h_70p > 6 THEN 3 WHEN h_70p > 5 THEN 2
    WHEN h_70p > 0 THEN 1 ELSE 0 END"""
view("split_ranks", f"""SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(bag_id || ':42'), bag_id) AS rn,
    count(*) OVER (PARTITION BY s) AS n FROM (SELECT *, {HEIGHT_CLASS} AS s FROM {{train}} WHERE h_70p IS NOT NULL) t""")
view("stratified", """SELECT *, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split
    FROM {split_ranks}""")
check("s07_s08_split_frame_store", "SELECT bag_id, no_floors AS clean_floors, h_70p FROM {stratified} WHERE split = 'test'")
check("s09_prediction_store", """SELECT p.bag_id, round_even(p.pred_value, 0) AS pred_value_rounded, p.split, t.no_floors
    FROM {pred} p JOIN {train} t ON p.bag_id = t.bag_id WHERE p.model = 'model_1.4'""")
check("s11_geojson_features", """SELECT concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[',
    '[', x0, ',', y0, '],[', x0 + w, ',', y0, '],[', x0 + w, ',', y0 + d, '],[', x0, ',', y0 + d, '],[', x0, ',', y0,
    ']]]}},"properties":{{"identificatie":"', identificatie, '","floors":', floors, '}}}}') AS value
    FROM {pand} WHERE floors > 0""")
check("s12_replace_table", "SELECT bag_id, no_floors + 1 AS no_floors, data_source FROM {stock}")
check("s12_duplicate_keys", "SELECT pandid, count(*) AS n FROM {adres} GROUP BY pandid HAVING count(*) > 1")
check("s13_predictions_table", """SELECT bag_id, pred_value, cast(round_even(pred_value, 0) AS int) AS pred_value_rounded, clean_floors
    FROM {pred} WHERE model = 'model_1.4'""")
check("s14_case_study_ids", """SELECT DISTINCT identificatie AS bag_id FROM {pand}
    WHERE pandstatus = 'Pand in gebruik' AND einddatumtijdvakgeldigheid IS NULL""")
check("s15_statistics_csv", "SELECT no_floors, count(*) AS n FROM {train} GROUP BY no_floors")

# --- labels and predicates -------------------------------------------------------------------

check("p01_labels_storey_range", "SELECT * FROM {c1}")
check("p02_labels_plain_counts", "SELECT * FROM {c2}")
check("p03_labels_flats_and_houses", "SELECT * FROM {c3}")
check("p04_labels_unit_levels", "SELECT * FROM {c4}")
check("p05_plausible_labels", "SELECT * FROM {labelled} WHERE no_floors BETWEEN 1 AND 48")
check("p06_level_corrections", """SELECT c.bag_id, coalesce(m.actual_floors, c.no_floors) AS no_floors, c.notes
    FROM {c3} c LEFT JOIN {manual} m ON m.bag_id = c.bag_id""")
check("p06_level_shift", """SELECT bag_id, CASE WHEN notes LIKE '%galerijflat%' AND (notes LIKE '%ET%'
    OR (notes LIKE '%WL%' AND (no_floors = 2 OR no_floors >= 7))) THEN no_floors + 1 ELSE no_floors END AS no_floors, notes FROM {c3}""")
check("p07_in_use_buildings", """SELECT identificatie, pandstatus FROM {pand}
    WHERE pandstatus LIKE 'Pand in gebruik%' AND einddatumtijdvakgeldigheid IS NULL""")
check("p07_in_use_of_municipality", """SELECT gm_code,
    count(*) FILTER (WHERE einddatumtijdvakgeldigheid IS NULL AND pandstatus LIKE 'Pand in gebruik%') AS prefix,
    count(*) FILTER (WHERE einddatumtijdvakgeldigheid IS NULL AND pandstatus LIKE '%Pand in gebruik%') AS anywhere,
    count(*) FILTER (WHERE einddatumtijdvakgeldigheid IS NULL AND pandstatus = 'Pand in gebruik') AS exact
    FROM {pand} GROUP BY gm_code""")
check("p08_active_units", "SELECT substring(pandid, 1, 4) AS gm_code, count(*) AS n FROM {units} GROUP BY 1")
check("p09_in_use_3d", "SELECT substring(bag_id, 1, 4) AS gm_code, count(*) AS n FROM {register3d} GROUP BY 1")
check("p10_census_of_region", "SELECT gemeentecode, buurtcode FROM {buurten} WHERE " + REGION_WHERE)
check("p11_residential_filter", "SELECT bag_id, bag_function FROM {residential}")
check("p12_construction_year", "SELECT identificatie, nullif(bouwjaar, 1005) AS year FROM {pand}")
check("p13_use_class", "SELECT bag_id, bag_function FROM {classes}")
# Dwelling types and their classes.
DWELLING_CLASSES = {"vrijstaande woning": "detached", "twee-onder-een-kap": "semi-detached", "hoekwoning": "terraced",
                    "tussenwoning/geschakeld": "terraced", "appartement": "apartment"}
TYPE_CASE = f"map({list(DWELLING_CLASSES)}, {list(DWELLING_CLASSES.values())})[woningtypering]"
check("p14_building_type", f"SELECT identificatie AS bag_id, {TYPE_CASE} AS esri_building_type FROM {{esri}}")
check("p15_p16_storey_height", """SELECT bag_id, CASE WHEN bag3d_roof_type = 'slanted' THEN 'slanted' ELSE 'horizontal' END
    AS bag3d_roof_type, round(avg_h_storey, 6) AS avg_h_storey FROM {storeys}""")
for _name, _rule in (("p17_high_rise_rule", HIGH), ("p18_volume_rule", VOLUME), ("p19_area_rule", AREA)):
    check(_name, f"SELECT bag_id, coalesce({_rule}, false) AS rejected FROM {{imported}}")
view("rule1", f"SELECT * REPLACE (CASE WHEN coalesce({HIGH}, false) THEN NULL ELSE is_clean END AS is_clean) FROM {{imported}}")
view("rule2", f"""SELECT * REPLACE (CASE WHEN coalesce({VOLUME}, false) THEN NULL ELSE is_clean END AS is_clean,
    CASE WHEN coalesce({VOLUME}, false) THEN NULL ELSE clean_floors END AS clean_floors) FROM {{rule1}}""")
check("p17_p19_plausibility_chain", f"""SELECT bag_id, CASE WHEN coalesce({AREA}, false) THEN NULL ELSE is_clean END AS is_clean,
    clean_floors FROM {{rule2}}""")
check("p20_manual_labels", """SELECT bag_id, no_floors, 'y' AS is_clean FROM {stock} WHERE no_floors <= 17
    UNION ALL SELECT bag_id, CASE WHEN is_clean = 'y' THEN td_floors ELSE actual_floors END, is_clean FROM {manual}""")
check("p21_p23_reference_model", """SELECT bag_id, floors_height_based, floors_area_based, ref_model,
    round(floors_height_based_unrounded, 6) AS floors_height_based_unrounded,
    round(floors_area_based_unrounded, 6) AS floors_area_based_unrounded,
    round(ref_model_unrounded, 6) AS ref_model_unrounded FROM {ref}""")
check("p24_p25_feature_projection", """SELECT cbs_pop_per_km2, cbs_percent_multihousehold,
    round(cbs_cafe_avg_1km, 6) AS cbs_cafe_avg_1km FROM {train}""")
check("p26_complete_numeric_rows", """SELECT bag_id, cast(bag_no_units AS int) AS bag_no_units,
    round(lod12_volume, 6) AS lod12_volume, round(h_70p, 6) AS h_70p FROM {full_rows}""")
check("p27_signed_error", "SELECT bag_id, model, p - clean_floors AS error, e AS abs_error FROM {errors}")

# --- enrichment and joins --------------------------------------------------------------------

check("j01_j03_cadastre_attributes", """SELECT p.identificatie AS bag_id, nullif(s.bouwjaar, 1005) AS bag_construction_year,
    s.w * s.d AS area FROM {pand} p LEFT JOIN (SELECT * FROM {pand} WHERE pandstatus LIKE 'Pand in gebruik%'
    AND einddatumtijdvakgeldigheid IS NULL) s ON s.identificatie = p.identificatie""")
check("j04_register_3d", """SELECT p.identificatie AS bag_id, r.bag3d_roof_type, r.bag3d_id, r.bag3d_h_ground
    FROM {pand} p LEFT JOIN {register3d} r ON r.bag_id = p.identificatie""")
check("j05_height_percentiles", """SELECT p.identificatie AS bag_id, round(h_dak_min - bag3d_h_ground, 6) AS h_min,
    round(h_dak_50p - bag3d_h_ground, 6) AS h_50p, round(h_dak_70p - bag3d_h_ground, 6) AS h_70p,
    round(h_dak_max - bag3d_h_ground, 6) AS h_max FROM {pand} p LEFT JOIN {register3d} r ON r.bag_id = p.identificatie
    LEFT JOIN {lod12_2d} h ON h.fid = r.bag3d_id""")
view("meshed", "SELECT r.bag_id, r.bag3d_roof_type, g.* FROM {register3d} r JOIN {geo} g ON g.fid = r.bag3d_id WHERE g.fid % 19 <> 0")
FACE_COUNT = "CASE WHEN dak_type = 'slanted' THEN 16 ELSE 12 END - CASE WHEN fid % 29 = 0 THEN 1 ELSE 0 END"
check("j06_mesh_fetch", f"SELECT bag_id, cast({FACE_COUNT} AS int) AS n_faces FROM {{meshed}}")
check("j07_j11_area_statistics", """SELECT p.identificatie AS bag_id,
    min_by(bevolkingsdichtheid, buurtcode) AS cbs_pop_per_km2,
    min_by(percentage_meergezinswoning, buurtcode) AS cbs_percent_multihousehold,
    min_by(afstand_winkels, buurtcode) AS cbs_shops_avg_dist, min_by(afstand_supermarkt, buurtcode) AS cbs_supermarket_avg_dist,
    min_by(afstand_cafe, buurtcode) AS cbs_cafe_avg_dist, min_by(aantal_winkels_1km, buurtcode) AS cbs_shops_avg_1km,
    min_by(aantal_supermarkt_1km, buurtcode) AS cbs_supermarket_avg_1km, min_by(aantal_cafe_1km, buurtcode) AS cbs_cafe_avg_1km
    FROM {pand} p LEFT JOIN {buurten} b ON p.x0 <= b.xmax AND p.x0 + p.w >= b.xmin AND p.y0 <= b.ymax AND p.y0 + p.d >= b.ymin
    GROUP BY p.identificatie""")
check("j12_j14_adjacent_counts", """SELECT t.bag_id, cast(count(c.bag_id) AS int) AS footprint_no_adjacent
    FROM {around_targets} t LEFT JOIN {around_counted} c ON t.counts AND t.bag_id <> c.bag_id
    AND t.x0 - 0.1::DOUBLE <= c.x1 AND t.x1 + 0.1::DOUBLE >= c.x0 AND t.y0 - 0.1::DOUBLE <= c.y1 AND t.y1 + 0.1::DOUBLE >= c.y0
    GROUP BY t.bag_id""")


def _within(r: int) -> str:
    return f"(t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) <= {r * r}"


view("neighbours", "SELECT t.bag_id, " + ", ".join(
    f"cast(count(c.bag_id) FILTER (WHERE {_within(r)}) AS int) AS footprint_no_neighbours_{r}m" for r in (25, 50, 75, 100)) + """
    FROM {around_targets} t LEFT JOIN {around_counted} c ON t.counts AND t.bag_id <> c.bag_id
    AND c.x BETWEEN t.x - 100 AND t.x + 100 AND c.y BETWEEN t.y - 100 AND t.y + 100 GROUP BY t.bag_id""")
check("j13_j14_neighbour_counts", "SELECT * FROM {neighbours}")
check("j15_candidate_buildings", "SELECT bag_id, bag_function, x, y FROM {around}")
check("j15_region_candidates", """SELECT bag_id, bag_function FROM {around}
    WHERE x0 <= 300000 AND x1 >= 90000 AND y0 <= 1e12 AND y1 >= -10""")
check("j16_predictions_with_reference", """SELECT p.bag_id, p.split, p.clean_floors, p.pred_value, r.ref_model
    FROM {pred} p LEFT JOIN {ref} r ON r.bag_id = p.bag_id WHERE p.model = 'model_1.4'""")
check("j17_geometry_with_predictions", """SELECT e.bag_id, g.w * g.d AS area, e.p - e.clean_floors AS error, e.e AS abs_error
    FROM {errors} e JOIN {pand} g ON g.identificatie = e.bag_id WHERE e.model = 'model_1.4' AND e.split = 'test'""")
check("j18_label_with_error", "SELECT bag_id, clean_floors, e AS abs_error FROM {errors} WHERE model = 'model_1.4'")
check("j20_import_results", """SELECT p.identificatie AS bag_id, t.no_floors, CASE WHEN t.bag_id IS NOT NULL THEN 'y' END AS is_clean
    FROM {pand} p LEFT JOIN {train} t ON t.bag_id = p.identificatie""")

# --- aggregates ------------------------------------------------------------------------------

check("a01_a04_unit_attributes", """SELECT bag_id, bag_net_internal_area, bag_no_units, array_to_string(uses, '|') AS uses,
    residential_uses FROM {unit_stats}""")
check("a04_residential_units", """SELECT bag_id, CASE WHEN bag_function = 'Residential' THEN residential_uses END AS bag_no_res_units
    FROM {classes}""")
check("a05_top_level", "SELECT bag_id, no_floors FROM {c4} WHERE no_floors BETWEEN 1 AND 48")
check("a06_neighbour_totals", "SELECT substring(bag_id, 1, 4) AS gm_code, " + ", ".join(
    f"cast(sum(footprint_no_neighbours_{r}m) AS bigint) AS within_{r}m" for r in (25, 50, 75, 100)) + " FROM {neighbours} GROUP BY 1")
check("a07_cleaning_step_counts", "SELECT removed_at_step, count(*) AS n FROM {steps} GROUP BY 1")
check("a08_floor_histogram", "SELECT split, clean_floors, count(*) AS n FROM {pred} WHERE model = 'model_1' GROUP BY 1, 2")
check("a09_floor_percentile", "SELECT round(quantile_cont(no_floors::DOUBLE, 0.9), 6) AS percentile FROM {train}")
view("merged", """SELECT s.data_source, CASE WHEN c.bag_function = 'Others' THEN 'Unknown'
    WHEN c.bag_function LIKE 'Non-residential%' THEN 'Non-residential' ELSE c.bag_function END AS class
    FROM {classes} c JOIN {stock} s ON s.bag_id = c.bag_id WHERE c.bag_function IS NOT NULL""")
check("a10_class_counts", """SELECT cast(NULL AS varchar) AS data_source, class, count(*) AS n FROM {merged} GROUP BY class
    UNION ALL SELECT data_source, CASE
      WHEN data_source = 'c3_dhg' AND class IN ('Non-residential', 'Mixed-residential', 'Unknown') THEN 'Other'
      WHEN data_source = 'c4_rho' AND class IN ('Non-residential', 'Unknown') THEN 'Other' ELSE class END AS class, count(*)
    FROM {merged} GROUP BY 1, 2""")
check("a11_source_shares", """SELECT data_source, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
    FROM {train} GROUP BY data_source""")


def _metric(name: str, where: str = "true") -> str:
    return {
        "accuracy": f"avg(CASE WHEN e = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE {where})",
        "mae": f"avg(e) FILTER (WHERE {where})",
        "rmse": f"sqrt(avg(e * e) FILTER (WHERE {where}))",
        "max_err": f"max(e) FILTER (WHERE {where})",
    }[name]


def _reported(name: str, expr: str) -> str:
    if name == "accuracy":
        return f"round_even(({expr}) * 100 * 10, 0) / 10"
    return f"round_even(({expr}) * 100, 0) / 100" if name in ("mae", "rmse") else expr


def _r6(name: str, expr: str) -> str:
    return expr if name == "max_err" else f"round({expr}, 6)"


METRICS = ("accuracy", "mae", "rmse", "max_err")
BOTH = (("above", "clean_floors > 5"), ("below", "clean_floors <= 5"))
check("a12_a15_overall_metrics", "SELECT model, split, " + ", ".join(
    f"{_r6(m, _metric(m))} AS {m}" for m in METRICS) + " FROM {errors} GROUP BY model, split")
check("a16_class_metrics", "SELECT model, split, " + ", ".join(
    f"round({_metric(m, w)}, 6) AS {m}_{s}" for s, w in BOTH for m in METRICS) + " FROM {errors} GROUP BY model, split")
MODEL_TABLE = "SELECT model, algorithm, tuning_description, " + ", ".join(
    f"{_reported(m, _metric(m, f'split = {chr(39)}{s}{chr(39)}'))} AS {m}_{s}" for m in METRICS for s in ("train", "test")) \
    + " FROM {errors} GROUP BY 1, 2, 3"
check("a17_model_table", MODEL_TABLE)
check("s10_metric_rows", MODEL_TABLE)
check("a17_model_table_per_class", "SELECT model, algorithm, tuning_description, " + ", ".join(
    f"{_reported(m, _metric(m, w + chr(32) + 'AND split = ' + chr(39) + 'test' + chr(39)))} AS {m}_{s}_test"
    for s, w in BOTH for m in METRICS) + " FROM {errors} GROUP BY 1, 2, 3")
view("best_test", """SELECT p.clean_floors, p.pred_value, r.ref_model::DOUBLE AS ref_model FROM {pred} p
    LEFT JOIN {ref} r ON r.bag_id = p.bag_id WHERE p.model = 'model_1.4' AND p.split = 'test'""")
view("three", """SELECT 'ref_model' AS model, clean_floors, abs(clean_floors - round_even(ref_model, 0)) AS e FROM {best_test}
    UNION ALL SELECT 'best_model', clean_floors, abs(clean_floors - round_even(pred_value, 0)) FROM {best_test}
    UNION ALL SELECT 'mean', clean_floors, abs(clean_floors - round_even((SELECT avg(clean_floors) FROM {best_test}), 0)) FROM {best_test}""")


def _three(name: str, where: str) -> str:
    # rows without a rule-of-thumb count carry no error
    return _reported(name, _metric(name, f"e IS NOT NULL AND {where}"))


check("a18_three_way_comparison", "SELECT model, " + ", ".join(f"{_three(m, 'true')} AS {m}" for m in METRICS) + ", " + ", ".join(
    f"{_three(m, w)} AS {m}_{s}" for s, w in BOTH for m in METRICS) + " FROM {three} GROUP BY model")
check("a19_abs_error_frequency", "SELECT model, split, e AS abs_error, count(*) AS n FROM {errors} GROUP BY 1, 2, 3")
check("a19_mean_error_per_floor", """SELECT model, split, clean_floors, round(avg(e), 6) AS mean_abs_error
    FROM {errors} GROUP BY 1, 2, 3""")
check("a20_confusion", """SELECT model, clean_floors AS true_floors, cast(p AS int) AS pred_floors, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model, clean_floors), 6) AS share
    FROM {errors} WHERE p >= 1 GROUP BY model, clean_floors, p""")
check("a22_gross_errors", "SELECT bag_id, model, p - clean_floors AS error FROM {errors} WHERE e >= 1")
check("a22_rounding_effect", """SELECT model, split, round(avg(abs(pred_value - clean_floors)), 6) AS mae_raw,
    round(avg(e), 6) AS mae_rounded, round(sqrt(avg((pred_value - clean_floors) * (pred_value - clean_floors))), 6) AS rmse_raw,
    round(sqrt(avg(e * e)), 6) AS rmse_rounded FROM {errors} GROUP BY 1, 2""")

# --- group-wise, ordering and sets -----------------------------------------------------------

check("w01_iqr_outliers", "SELECT bag_id, is_outlier FROM {iqr1}")
check("w01_two_pass_survivors", "SELECT bag_id, removed_at_step FROM {steps}")
check("w02_outer_percentiles", """SELECT s.bag_id, NOT (s.h_70p BETWEEN f.lo AND f.hi) AS is_outlier FROM {iqr0} s JOIN
    (SELECT no_floors, quantile_cont(h_70p, 0.05) AS lo, quantile_cont(h_70p, 0.95) AS hi FROM {iqr0} GROUP BY no_floors) f
    ON f.no_floors = s.no_floors""")
check("w04_one_row_per_building", """SELECT DISTINCT ON (pandid) pandid, adresseerbaarobject, verblijfsobjectstatus FROM {adres}
    ORDER BY pandid, adresseerbaarobject, verblijfsobjectstatus""")
check("w05_stratified_split", "SELECT bag_id, split FROM {stratified}")
check("o06_first_rows_per_source", """SELECT bag_id, data_source, no_floors FROM (SELECT *, row_number() OVER
    (PARTITION BY data_source ORDER BY bag_id) AS rn FROM {stock}) s WHERE rn <= 10""")
check("x01_x02_stacked_sources", "SELECT bag_id, no_floors, data_source FROM {labelled}")
check("x04_split_back_by_source", "SELECT bag_id, no_floors FROM {stock} WHERE data_source = 'c3_dhg'")

# --- footprints ------------------------------------------------------------------------------

check("g01_g02_footprint_measures", """SELECT identificatie, round(w * d, 6) AS footprint_area,
    round(2 * (w + d), 6) AS footprint_perim FROM {pand}""")
check("g03_simplified_vertices", "SELECT identificatie, 5.0::DOUBLE AS footprint_no_vertices FROM {pand}")
check("g04_mitre_buffer", """SELECT identificatie, round(x0 - 0.1::DOUBLE, 6) AS xmin, round(y0 - 0.1::DOUBLE, 6) AS ymin,
    round(x0 + w + 0.1::DOUBLE, 6) AS xmax, round(y0 + d + 0.1::DOUBLE, 6) AS ymax FROM {pand}""")
check("g05_centroid", "SELECT identificatie, round(x0 + w / 2, 6) AS x, round(y0 + d / 2, 6) AS y FROM {pand}")
check("g06_municipality_extent", """SELECT gemeentecode, count(*) AS parts, sum((xmax - xmin) * (ymax - ymin)) AS area,
    min(xmin) - 300 AS xmin, min(ymin) - 300 AS ymin, max(xmax) + 300 AS xmax, max(ymax) + 300 AS ymax
    FROM {gemeenten} GROUP BY gemeentecode""")
check("g06_within_buffered_municipality", """SELECT p.identificatie AS bag_id, min(g.gemeentecode) AS near_gemeente
    FROM {pand} p JOIN {gemeenten} g ON p.x0 <= g.xmax + 300 AND p.x0 + p.w >= g.xmin - 300
    AND p.y0 <= g.ymax + 300 AND p.y0 + p.d >= g.ymin - 300 GROUP BY p.identificatie""")
view("centres", "SELECT identificatie AS id, x0 + w / 2 AS x, y0 + d / 2 AS y, x0, y0, w, d FROM {pand}")
check("g07_pairs_within_distance", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {_within(r)}) AS pairs_{r}m" for r in (25, 50, 75, 100)) + """
    FROM {centres} t JOIN {centres} c ON t.id <> c.id AND c.x BETWEEN t.x - 100 AND t.x + 100 AND c.y BETWEEN t.y - 100 AND t.y + 100""")
check("g08_grid_cells", """SELECT cx, cy, count(*) AS n FROM (
    SELECT unnest(range(floor(x0 / 32)::BIGINT, floor((x0 + w) / 32)::BIGINT + 1)) AS cx, y0, d FROM {pand}) a,
    LATERAL (SELECT unnest(range(floor(a.y0 / 32)::BIGINT, floor((a.y0 + a.d) / 32)::BIGINT + 1)) AS cy) b GROUP BY cx, cy""")
check("g09_touching_footprints", """SELECT t.id AS bag_id, cast(count(*) AS int) AS footprint_no_adjacent
    FROM {centres} t JOIN {centres} c ON t.id <> c.id AND t.x0 - 0.1::DOUBLE <= c.x0 + c.w AND t.x0 + t.w + 0.1::DOUBLE >= c.x0
    AND t.y0 - 0.1::DOUBLE <= c.y0 + c.d AND t.y0 + t.d + 0.1::DOUBLE >= c.y0 GROUP BY t.id""")

# --- meshes ----------------------------------------------------------------------------------

view("gable", "SELECT *, dak_type = 'slanted' AS is_gable, fid % 29 = 0 AS is_open FROM {meshed}")
# rounding to 3 decimals, half-even on the scaled value, as the query does
R3 = "round_even(({}) * 1000, 0) / 1000"
view("levels", f"""SELECT *, {R3.format('g + h')} AS top, {R3.format('g + 0.7::DOUBLE * h')} AS low,
    {R3.format('g')} AS base FROM {{gable}}""")
view("ridges", f"""SELECT *, {R3.format('top - g')} AS ridge, {R3.format('low - g')} AS slanted,
    {R3.format('(low + base) / 2 - g')} AS mixed FROM {{levels}}""")
# walls of a gable hold ground, eaves and ridge heights; roofs hold the ridge height.
# The rounded ground counts as above ground when it was rounded up.
check("m01_height_references", """SELECT bag_id, round(ridge, 3) AS lod22_h_ridge, round(eaves, 3) AS lod22_h_eaves,
    round(ridge - eaves, 3) AS lod22_href_diff FROM (SELECT bag_id, ridge, CASE WHEN is_gable AND low <> top THEN
      CASE WHEN base > g AND low <> base THEN mixed WHEN low > g THEN slanted ELSE ridge END ELSE ridge END AS eaves FROM {ridges}) r""")
check("m02_face_areas", """SELECT bag_id, sem, round(area, 6) AS area FROM (
    SELECT bag_id, 0 AS sem, w * d AS area FROM {gable} UNION ALL SELECT bag_id, 1, w * d FROM {gable}
    UNION ALL SELECT bag_id, 2, 2 * (w + d) * h - CASE WHEN is_open THEN d * h / 2 ELSE 0 END FROM {gable}) a""")
check("m03_surface_areas", """SELECT bag_id, round(CASE WHEN is_gable THEN
      2 * (w + d) * 0.7::DOUBLE * h + 0.3::DOUBLE * d * h - CASE WHEN is_open THEN 0.15::DOUBLE * d * h ELSE 0 END
      ELSE 2 * (w + d) * h - CASE WHEN is_open THEN d * h / 2 ELSE 0 END END, 6) AS lod22_area_walls,
    round(CASE WHEN is_gable THEN 2 * w * sqrt(d * d / 4 + 0.09::DOUBLE * h * h) ELSE w * d END, 6) AS lod22_area_roof FROM {gable}""")
check("m04_distinct_vertices", """SELECT bag_id, cast(CASE WHEN h = 0 THEN CASE WHEN is_gable THEN 6 ELSE 4 END
    WHEN is_gable THEN 10 ELSE 8 END AS int) AS n_vertices FROM {gable}""")
check("m05_closed_volume", """SELECT bag_id, round(CASE WHEN is_gable THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * w * d * h, 6) AS volume
    FROM {gable} WHERE NOT is_open AND h > 0""")
check("m05_m08_exact_volumes", f"""SELECT bag_id, is_positive, CASE WHEN NOT is_open AND h > 0 THEN
    floor({R3.format('w * d * h')} * 10 + 0.0004::DOUBLE)::BIGINT END AS decimetres FROM (
    SELECT *, h > 0 AS is_positive FROM {{gable}}) x""")
CODES = "CASE WHEN h = 0 THEN ['non_manifold', 'degenerate_face'] WHEN is_open THEN ['open_edge'] ELSE ['valid'] END"
check("m06_quality_report", f"""SELECT code, count(*) AS meshes, any_value(total) AS total, any_value(invalid) AS invalid,
    any_value(round_even(invalid / total * 1000, 0) / 10) AS percent_invalid FROM (
    SELECT unnest({CODES}) AS code, count(*) OVER () AS total, count(*) FILTER (h = 0 OR is_open) OVER () AS invalid
    FROM {{gable}}) x GROUP BY code""")
check("m06_mesh_quality", """SELECT bag_id, NOT is_open AND h > 0 AS is_valid, CASE WHEN h > 0 AND is_open THEN 3 ELSE 0 END AS open_edges,
    CASE WHEN h = 0 THEN 'non_manifold,degenerate_face' WHEN is_open THEN 'open_edge' ELSE '' END AS codes FROM {gable}""")
check("m08_held_at_bound", """SELECT bag_id, round(CASE WHEN v > 1.1::DOUBLE * b THEN b ELSE v END, 6) AS volume FROM (
    SELECT bag_id, w * d * h AS b, 2 * CASE WHEN NOT is_open THEN CASE WHEN is_gable THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * w * d * h
      END AS v FROM {gable} WHERE NOT is_open AND h > 0) x""")

# --- statistics ------------------------------------------------------------------------------

CORR_COLUMNS = [*FEATURES, "clean_floors"]
_pairs = [(a, b) for a in CORR_COLUMNS for b in CORR_COLUMNS]
view("corr_wide", "SELECT " + ", ".join(
    f"corr({a}, {b}) AS c_{i}, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_{i}"
    for i, (a, b) in enumerate(_pairs)) + " FROM {clean_nan}")
view("corr_long", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, n_{i} AS n, c_{i} AS corr FROM {{corr_wide}}"
    for i, (a, b) in enumerate(_pairs)))
check("f01_pearson", "SELECT feature_a, feature_b, n, round(corr, 6) AS corr FROM {corr_long}")
check("o01_label_correlation", """SELECT feature_b AS feature, round(corr, 6) AS corr FROM {corr_long}
    WHERE feature_a = 'clean_floors' AND feature_b <> 'clean_floors'""")


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


check("f02_spearman", " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(corr(ra, rb), 6) AS corr FROM (
    SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM {{clean_nan}} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r"""
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
check("f03_o02_variance_inflation", " UNION ALL ".join(
    f"""SELECT '{c}' AS variables, round(1 / (1 - corr(footprint_area, footprint_no_vertices)
    * corr(footprint_area, footprint_no_vertices)), 6) AS VIF FROM {{clean_nan}}"""
    for c in ("footprint_area", "footprint_no_vertices")))
# Normal equations solved by sweeping one column after the other; a column without variance left is passed over, and it
# and all that weigh in it have infinite factors. Column 0 carries the means, for the intercept.
_k = len(FEATURES)
view("vif_rows", "SELECT * FROM {clean_nan} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
view("sweep_0", " UNION ALL ".join(
    [f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS v FROM {{vif_rows}}"
     for i, a in enumerate(FEATURES, 1) for j, b in enumerate(FEATURES, 1)]
    + [f"SELECT {i} AS i, 0 AS j, avg({a}) / stddev_pop({a}) AS v FROM {{vif_rows}} UNION ALL SELECT 0, {i}, avg({a}) / stddev_pop({a}) "
       "FROM {vif_rows}" for i, a in enumerate(FEATURES, 1)] + ["SELECT 0 AS i, 0 AS j, 0.0::DOUBLE AS v"]))
for _p in range(1, _k + 1):
    view(f"sweep_{_p}", f"""SELECT m.i, m.j, CASE WHEN d.v < 1e-10 THEN m.v WHEN m.i = {_p} AND m.j = {_p} THEN -1 / d.v
        WHEN m.i = {_p} OR m.j = {_p} THEN m.v / d.v ELSE m.v - r.v * c.v / d.v END AS v FROM {{sweep_{_p - 1}}} m
        JOIN {{sweep_{_p - 1}}} d ON d.i = {_p} AND d.j = {_p} JOIN {{sweep_{_p - 1}}} r ON r.i = m.i AND r.j = {_p}
        JOIN {{sweep_{_p - 1}}} c ON c.i = {_p} AND c.j = m.j""")
view("left_out", f"SELECT i FROM {{sweep_{_k}}} WHERE i = j AND i > 0 AND v > -0.5")
VIF_ALL = f"""SELECT variables, round(CASE WHEN m.i > 0 AND (m.i IN (FROM {{left_out}}) OR EXISTS (
        SELECT 1 FROM {{sweep_{_k}}} w WHERE w.i = m.i AND w.j IN (FROM {{left_out}}) AND abs(w.v) > 1e-6)) THEN 'inf'::DOUBLE
    WHEN m.i = 0 THEN 1 - m.v ELSE -m.v END, 4) AS VIF FROM {{sweep_{_k}}} m JOIN (VALUES (0, 'intercept'), """ + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(FEATURES, 1)) + ") n(i, variables) ON n.i = m.i WHERE m.i = m.j"
check("f03_variance_inflation_all", VIF_ALL)
view("f_scores", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, corr({c}, clean_floors) * corr({c}, clean_floors)
    / (1 - corr({c}, clean_floors) * corr({c}, clean_floors)) * (count(*) - 2) AS score FROM {{full_rows}}""" for c in FEATURES))
check("f04_f_scores", "SELECT feature, round(score, 6) AS score FROM {f_scores}")
check("o04_k_best_f", "SELECT feature, round(score, 6) AS score FROM {f_scores} ORDER BY score DESC, feature LIMIT 10")
view("mi_long", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, clean_floors AS y FROM {{full_rows}}" for c in FEATURES))
view("mi_cuts", "SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {mi_long} GROUP BY feature")
view("mi_joint", """SELECT l.feature, len(list_filter(c.q, lambda v: v < l.value)) AS bin, l.y, count(*)::DOUBLE AS c
    FROM {mi_long} l JOIN {mi_cuts} c ON c.feature = l.feature GROUP BY 1, 2, 3""")
view("mi_scores", """SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS score FROM (
    SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cx,
    sum(c) OVER (PARTITION BY feature, y) AS cy FROM {mi_joint}) j GROUP BY feature""")
check("f05_mutual_information", "SELECT feature, round(score, 6) AS score FROM {mi_scores}")
check("o04_k_best_mi", "SELECT feature, round(score, 6) AS score FROM {mi_scores} ORDER BY score DESC, feature LIMIT 10")
_chosen = "('h_70p', 'bag_net_internal_area', 'footprint_area', 'lod22_volume', 'cbs_cafe_avg_1km')"
check("f06_normalised_scores", f"""SELECT f.feature, round(f.score / max(f.score) OVER (), 6) AS f_score,
    round(m.score / max(m.score) OVER (), 6) AS mi_score FROM (SELECT * FROM {{f_scores}} WHERE feature IN {_chosen}) f
    JOIN {{mi_scores}} m ON m.feature = f.feature""")

# --- jobs ------------------------------------------------------------------------------------

view("quality_rows", """SELECT substring(l.bag_id, 1, 4) AS gm_code, c.bag_function, l.no_floors AS clean_floors,
    abs(l.no_floors - coalesce(round_even((h.h_dak_70p - r.bag3d_h_ground) / 2.65::DOUBLE, 0),
      round_even(c.bag_net_internal_area / (p.w * p.d) + 0.4::DOUBLE, 0))) AS e
    FROM (SELECT * FROM {labelled} WHERE no_floors BETWEEN 1 AND 48) l JOIN {residential} c ON c.bag_id = l.bag_id
    LEFT JOIN (SELECT * FROM {pand} WHERE pandstatus LIKE 'Pand in gebruik%' AND einddatumtijdvakgeldigheid IS NULL) p
      ON p.identificatie = l.bag_id
    LEFT JOIN {register3d} r ON r.bag_id = l.bag_id LEFT JOIN {lod12_2d} h ON h.fid = r.bag3d_id""")
check("flagship_rule_of_thumb", "SELECT gm_code, bag_function, count(*) AS n, " + ", ".join(
    f"round({_metric(m)}, 6) AS {m}" for m in METRICS) + ", " + ", ".join(
    f"round({_metric(m, w)}, 6) AS {m}_{s}" for s, w in BOTH for m in METRICS)
    + " FROM {quality_rows} WHERE e IS NOT NULL GROUP BY gm_code, bag_function")

# --- preparation -----------------------------------------------------------------------------


def _scaled(c: str) -> str:
    filled = f"coalesce({c}, avg({c}) OVER ())"
    return (f"round(({filled} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER () * count({c}) OVER () / count(*) OVER ()), 6) AS {c}")


check("l01_l02_imputed_scaled", "SELECT bag_id, " + ", ".join(
    _scaled(c) for c in ("h_70p", "bag_no_units", "lod12_volume", "bag_construction_year")) + " FROM {clean_nan}")
check("l03_l04_imputed_encoded", """SELECT bag_id, cast(bag_function = 'Residential' AS DOUBLE) AS bag_function_x0_Residential,
    cast(roof = 'multiple horizontal' AS DOUBLE) AS bag3d_roof_type_x0_multiple_horizontal,
    cast(roof = 'single horizontal' AS DOUBLE) AS bag3d_roof_type_x0_single_horizontal,
    cast(roof = 'slanted' AS DOUBLE) AS bag3d_roof_type_x0_slanted, cast(roof = 'unknown' AS DOUBLE) AS bag3d_roof_type_x0_unknown
    FROM (SELECT bag_id, bag_function, coalesce(bag3d_roof_type, (SELECT bag3d_roof_type FROM {train}
      WHERE bag3d_roof_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS roof FROM {train}) t""")

# --- whole feature table ---------------------------------------------------------------------

check("m06_validity", "SELECT bag_id, NOT is_open AND h > 0 AS is_valid FROM {gable}")
check("x03_wall_heights_off_roof", "SELECT bag_id, CASE WHEN h = 0 THEN 0 ELSE 1 END AS n FROM {gable}")
view("in_use", """SELECT * FROM {pand} WHERE pandstatus LIKE 'Pand in gebruik%' AND einddatumtijdvakgeldigheid IS NULL""")
view("adjacent", """SELECT t.bag_id, cast(count(c.bag_id) AS int) AS n
    FROM {around_targets} t LEFT JOIN {around_counted} c ON t.counts AND t.bag_id <> c.bag_id
    AND t.x0 - 0.1::DOUBLE <= c.x1 AND t.x1 + 0.1::DOUBLE >= c.x0 AND t.y0 - 0.1::DOUBLE <= c.y1 AND t.y1 + 0.1::DOUBLE >= c.y0
    GROUP BY t.bag_id""")
view("census", """SELECT p.identificatie AS bag_id, min_by(bevolkingsdichtheid, buurtcode) AS cbs_pop_per_km2
    FROM {in_use} p JOIN {buurten} b ON p.x0 <= b.xmax AND p.x0 + p.w >= b.xmin AND p.y0 <= b.ymax AND p.y0 + p.d >= b.ymin
    GROUP BY p.identificatie""")
check("prep_feature_table", f"""SELECT l.bag_id, l.data_source, l.no_floors, c.bag_function,
    nullif(p.bouwjaar, 1005) AS bag_construction_year, c.bag_net_internal_area, c.bag_no_units,
    CASE WHEN c.bag_function = 'Residential' THEN c.residential_uses END AS bag_no_res_units,
    r.bag3d_roof_type, {TYPE_CASE} AS esri_building_type, round(h.h_dak_70p - r.bag3d_h_ground, 6) AS h_70p,
    s.cbs_pop_per_km2, p.w * p.d AS footprint_area, a.n AS footprint_no_adjacent,
    n.footprint_no_neighbours_25m, n.footprint_no_neighbours_100m, g.w * g.d AS lod12_area_roof
    FROM (SELECT * FROM {{labelled}} WHERE no_floors BETWEEN 1 AND 48) l JOIN {{residential}} c ON c.bag_id = l.bag_id
    LEFT JOIN {{in_use}} p ON p.identificatie = l.bag_id LEFT JOIN {{register3d}} r ON r.bag_id = l.bag_id
    LEFT JOIN {{lod12_2d}} h ON h.fid = r.bag3d_id LEFT JOIN {{esri}} e ON e.identificatie = l.bag_id
    LEFT JOIN {{census}} s ON s.bag_id = l.bag_id LEFT JOIN {{adjacent}} a ON a.bag_id = l.bag_id
    LEFT JOIN {{neighbours}} n ON n.bag_id = l.bag_id LEFT JOIN {{meshed}} g ON g.bag_id = l.bag_id""")

view("unseen", """SELECT DISTINCT identificatie AS bag_id FROM {pand}
    WHERE region = 4 AND pandstatus = 'Pand in gebruik' AND einddatumtijdvakgeldigheid IS NULL""")
view("unseen_features", f"""SELECT u.bag_id, c.bag_function, nullif(p.bouwjaar, 1005) AS bag_construction_year, c.bag_net_internal_area,
    c.bag_no_units, r.bag3d_roof_type, {TYPE_CASE} AS esri_building_type, h.h_dak_70p - r.bag3d_h_ground AS h_70p, s.cbs_pop_per_km2,
    p.w * p.d AS footprint_area, a.n AS footprint_no_adjacent, n.footprint_no_neighbours_100m, g.w * g.d AS lod12_area_roof
    FROM {{unseen}} u JOIN {{residential}} c ON c.bag_id = u.bag_id
    LEFT JOIN {{in_use}} p ON p.identificatie = u.bag_id LEFT JOIN {{register3d}} r ON r.bag_id = u.bag_id
    LEFT JOIN {{lod12_2d}} h ON h.fid = r.bag3d_id LEFT JOIN {{esri}} e ON e.identificatie = u.bag_id
    LEFT JOIN {{census}} s ON s.bag_id = u.bag_id LEFT JOIN {{adjacent}} a ON a.bag_id = u.bag_id
    LEFT JOIN {{neighbours}} n ON n.bag_id = u.bag_id LEFT JOIN {{meshed}} g ON g.bag_id = u.bag_id""")
check("l18_case_study_table", """SELECT bag_id, bag_function, bag_construction_year, bag_net_internal_area, bag_no_units, bag3d_roof_type,
    esri_building_type, round(h_70p, 6) AS h_70p, cbs_pop_per_km2, round(footprint_area, 6) AS footprint_area, footprint_no_adjacent,
    footprint_no_neighbours_100m, round(lod12_area_roof, 6) AS lod12_area_roof, by_height AS floors_height_based, by_area AS floors_area_based,
    coalesce(by_height, by_area) AS ref_model,
    round(coalesce(h_70p / 2.65::DOUBLE, bag_net_internal_area / nullif(footprint_area, 0)), 6) AS ref_model_unrounded
    FROM (SELECT *, cast(round_even(h_70p / 2.65::DOUBLE, 0) AS int) AS by_height,
          cast(round_even(bag_net_internal_area / nullif(footprint_area, 0) + 0.4::DOUBLE, 0) AS int) AS by_area FROM {unseen_features}) f""")
check("s15_statistic_tables", f"""SELECT 'label_correlation' AS statistic, feature_b AS feature, round(corr, 4) AS value FROM {{corr_long}}
    WHERE feature_a = 'clean_floors' AND feature_b <> 'clean_floors'
    UNION ALL SELECT 'variance_inflation', variables, round(VIF, 4) FROM ({VIF_ALL}) v""")

# --- id hash -----------------------------------------------------------------------------------

# CRC-32 folded over the eight bytes of an id, least byte first, with the table of the reflected polynomial.
view("crc_table", """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps""")
view("id_crc", """SELECT bag_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(8), lambda k: (bag_id::BIGINT >> (8 * k)) & 255)),
      lambda c, b: xor(c >> 8, t.steps[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM {stock} s, {crc_table} t""")
check("w06_id_hash_split", """SELECT bag_id, crc, CASE WHEN crc < 0.2::DOUBLE * 4294967296 THEN 'test' ELSE 'train' END AS split
    FROM {id_crc}""")
