"""Registered queries: every operator over whole tables, keyed by inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pandwerk.functions import geom2d, mesh3d
from pandwerk.functions.lineage import checkpointed, scratch_path
from pandwerk.functions.scalar import nan_to_null
from pandwerk.operators import (
    clean, enrich, evaluate, footprints, labels, meshes, predicates, refmodel, spatial, split, stats)
from pandwerk.params import DEFAULTS
from pandwerk.learning import prep, tune
from pandwerk.learning import train as training
from pandwerk.plans import modelling, prepare
from pandwerk.plans.flagship import rule_of_thumb_quality
from pandwerk.plans.inputs import label_sources, registers, written
from pandwerk.sources import bindings as b
from pandwerk.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def r6(c) -> F.Column:
    """Result rounding of the checks; sums may associate differently."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


LABEL = "clean_floors"
MODEL_FEATURES = DEFAULTS.feature_columns("model_1")
NUMERIC = [c for c in MODEL_FEATURES if c not in DEFAULTS.text_columns]


def model_frame(spark, sf) -> DataFrame:
    """Id, label and the 25 features of the base model, over all training rows."""
    return b.flat(spark, sf, "train").select("bag_id", F.col("no_floors").alias(LABEL), *MODEL_FEATURES)


# A region wider than any one municipality: x and y ranges in metres.
REGION = [[(90_000.0, -10.0), (300_000.0, -10.0), (300_000.0, 1e12), (90_000.0, 1e12)]]


# --- sources and sinks -----------------------------------------------------------------------

@query("s01_table_scan")
def _(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'")


@query("s02_spatial_scan")
def _(spark, sf):
    ring = F.col("geom")[0]
    return tables.select_where(b.pand(spark, sf), ["identificatie", "geom"], "bouwjaar > 1950").select(
        "identificatie", F.size(ring).alias("n_points"), ring[2]["x"].alias("x_far"), ring[2]["y"].alias("y_far"))


@query("s03_region_clip")
def _(spark, sf):
    return tables.clip(b.pand(spark, sf), REGION, where="einddatumtijdvakgeldigheid IS NULL").select(
        "identificatie", "srid")


@query("s04_collect_sources")
def _(spark, sf):
    return tables.of_sources(b.flat(spark, sf, "stock"), list(DEFAULTS.training_tables),
                             ["bag_id", "no_floors", "h_70p"], "bag3d_roof_type IS NOT NULL")


@query("s06_manual_label_csv")
def _(spark, sf):
    path = scratch_path(spark, "manual")
    b.flat(spark, sf, "manual").write.option("header", True).csv(path)
    return tables.read_manual_labels(spark, path)


@query("s07_s08_split_frame_store")
def _(spark, sf):
    path = scratch_path(spark, "frame")
    sinks.write_split(split.stratified(model_frame(spark, sf)), path)
    return tables.read_split(spark, path, "test").select("bag_id", LABEL, "h_70p")


@query("s09_prediction_store")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    pred = b.flat(spark, sf, "pred").where("model = 'model_1.4'")
    sinks.write_predictions(pred, path)
    stored = sinks.read_predictions(spark, path).select("bag_id", "pred_value_rounded", "split")
    return stored.join(b.flat(spark, sf, "train").select("bag_id", "no_floors"), "bag_id")


@query("s10_metric_rows")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    pred = b.flat(spark, sf, "pred")
    for i, model in enumerate(("model_1", "model_1.4", "model_1.5")):
        sinks.write_metrics(evaluate.model_table(pred.where(F.col("model") == model)).coalesce(1), path, first=i == 0)
    return spark.read.parquet(path)


@query("s11_geojson_features")
def _(spark, sf):
    return sinks.geojson_features(b.pand(spark, sf).where("floors > 0"), "geom", ["identificatie", "floors"])


@query("s12_replace_table")
def _(spark, sf):
    name = "stock_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    rows = b.flat(spark, sf, "stock").select("bag_id", "no_floors", "data_source")
    sinks.replace_table(rows, name, "bag_id", scratch_path(spark, "table"))
    shifted = spark.table(name).withColumn("no_floors", F.col("no_floors") + 1)
    sinks.replace_table(shifted, name, "bag_id", scratch_path(spark, "table"))
    return spark.table(name)


@query("s12_duplicate_keys")
def _(spark, sf):
    return labels.duplicate_keys(b.flat(spark, sf, "adres"), "pandid")


@query("s13_predictions_table")
def _(spark, sf):
    name = "predictions_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    sinks.load_predictions_table(b.flat(spark, sf, "pred").where("model = 'model_1.4'"), name, scratch_path(spark, "table"))
    return spark.table(name)


@query("s14_case_study_ids")
def _(spark, sf):
    return enrich.case_study_ids(b.pand(spark, sf))


@query("s15_statistics_csv")
def _(spark, sf):
    path = scratch_path(spark, "statistics")
    counts = evaluate.floor_histogram(b.flat(spark, sf, "train"), "no_floors")
    sinks.write_statistics(counts.orderBy("no_floors"), path)
    return spark.read.schema("no_floors int, n bigint").option("header", True).csv(path)


# --- labels and predicates -------------------------------------------------------------------

@query("p01_labels_storey_range")
def _(spark, sf):
    return label_sources(spark, sf)["c1_ams"]


@query("p02_labels_plain_counts")
def _(spark, sf):
    return label_sources(spark, sf)["c2_rot"]


@query("p03_labels_flats_and_houses")
def _(spark, sf):
    return label_sources(spark, sf)["c3_dhg"]


@query("p04_labels_unit_levels")
def _(spark, sf):
    return label_sources(spark, sf)["c4_rho"]


@query("p05_plausible_labels")
def _(spark, sf):
    return labels.plausible(labels.standardised(label_sources(spark, sf)))


@query("p06_level_corrections")
def _(spark, sf):
    fixes = b.flat(spark, sf, "manual").select("bag_id", F.col("actual_floors").alias("no_floors"))
    return labels.correct_levels(label_sources(spark, sf)["c3_dhg"], fixes)


@query("p06_level_shift")
def _(spark, sf):
    return labels.correct_levels(label_sources(spark, sf)["c3_dhg"], apply_level_shift=True)


@query("p07_in_use_buildings")
def _(spark, sf):
    return b.pand(spark, sf).where(predicates.in_use_building()).select("identificatie", "pandstatus")


@query("p07_in_use_of_municipality")
def _(spark, sf):
    found = [F.when(predicates.in_use_building(pattern), 1) for pattern in (
        predicates.IN_USE_PREFIX, predicates.IN_USE_ANYWHERE, predicates.IN_USE_EXACT)]
    return b.pand(spark, sf).groupBy("gm_code").agg(*[
        F.count(c).alias(n) for c, n in zip(found, ("prefix", "anywhere", "exact"))])


@query("p08_active_units")
def _(spark, sf):
    return b.flat(spark, sf, "adres").where(predicates.active_unit()).groupBy(
        F.substring("pandid", 1, 4).alias("gm_code")).agg(F.count("*").alias("n"))


@query("p09_in_use_3d")
def _(spark, sf):
    return b.flat(spark, sf, "bag3d").where(predicates.in_use_3d()).groupBy(
        F.substring("identificatie", 15, 4).alias("gm_code")).agg(F.count("*").alias("n"))


@query("p10_census_of_region")
def _(spark, sf):
    return b.buurten(spark, sf).where(predicates.region_clip(F.col("geom"), REGION)).select("gemeentecode", "buurtcode")


def classified(spark, sf) -> DataFrame:
    ids = b.flat(spark, sf, "pand").select(F.col("identificatie").alias("bag_id"))
    return enrich.with_use(ids, b.flat(spark, sf, "adres"))


@query("p11_residential_filter")
def _(spark, sf):
    return classified(spark, sf).where(predicates.residential()).select("bag_id", "bag_function")


@query("p12_construction_year")
def _(spark, sf):
    return b.flat(spark, sf, "pand").select("identificatie", enrich.construction_year(F.col("bouwjaar")).alias("year"))


@query("p13_use_class")
def _(spark, sf):
    return classified(spark, sf).select("bag_id", "bag_function")


@query("p14_building_type")
def _(spark, sf):
    return enrich.dwelling_types(b.flat(spark, sf, "esri"))


@query("p15_p16_storey_height")
def _(spark, sf):
    rows = clean.with_storey_height(b.flat(spark, sf, "train").where("h_70p IS NOT NULL"))
    return rounded(rows.select("bag_id", "bag3d_roof_type", "avg_h_storey"), "avg_h_storey")


def imported_labels(spark, sf) -> DataFrame:
    """Training rows with the clean count set, before the plausibility rules."""
    return b.flat(spark, sf, "train").withColumns({
        "is_clean": F.when(F.expr("no_floors % 7 <> 0"), "y"), LABEL: F.expr("CASE WHEN no_floors % 7 <> 0 THEN no_floors END")})


@query("p17_high_rise_rule")
def _(spark, sf):
    return imported_labels(spark, sf).select(
        "bag_id", F.coalesce(clean.high_rise_rejected(), F.lit(False)).alias("rejected"))


@query("p18_volume_rule")
def _(spark, sf):
    return imported_labels(spark, sf).select(
        "bag_id", F.coalesce(clean.volume_rejected(), F.lit(False)).alias("rejected"))


@query("p19_area_rule")
def _(spark, sf):
    return imported_labels(spark, sf).select(
        "bag_id", F.coalesce(clean.area_rejected(), F.lit(False)).alias("rejected"))


@query("p17_p19_plausibility_chain")
def _(spark, sf):
    return clean.apply_plausibility(imported_labels(spark, sf)).select("bag_id", "is_clean", LABEL)


@query("p20_manual_labels")
def _(spark, sf):
    automatic = b.flat(spark, sf, "stock").where("no_floors <= 17").select(
        "bag_id", "no_floors", F.lit("y").alias("is_clean"))
    return labels.merge_manual(automatic, b.flat(spark, sf, "manual"))


@query("p21_p23_reference_model")
def _(spark, sf):
    out = refmodel.with_reference_model(b.flat(spark, sf, "stock"))
    return rounded(out.select("bag_id", "floors_height_based", "floors_area_based", "ref_model",
                              "floors_height_based_unrounded", "floors_area_based_unrounded", "ref_model_unrounded"),
                   "floors_height_based_unrounded", "floors_area_based_unrounded", "ref_model_unrounded")


@query("p24_p25_feature_projection")
def _(spark, sf):
    features = DEFAULTS.feature_columns("model_6")
    return model_frame(spark, sf).select("bag_id", LABEL, *features).drop("bag_id", LABEL).select(
        *[F.round(c, 6).alias(c) if c.startswith("cbs_cafe") else c for c in features])


@query("p26_complete_numeric_rows")
def _(spark, sf):
    frame = clean.complete_rows(model_frame(spark, sf))
    return rounded(frame.select("bag_id", *clean.numeric_columns(frame, (LABEL,)))
                   .select("bag_id", "bag_no_units", "lod12_volume", "h_70p"), "lod12_volume", "h_70p")


@query("p27_signed_error")
def _(spark, sf):
    return evaluate.with_errors(b.flat(spark, sf, "pred")).select("bag_id", "model", "error", "abs_error")


# --- enrichment and joins --------------------------------------------------------------------

def stock_ids(spark, sf) -> DataFrame:
    return b.flat(spark, sf, "pand").select(F.col("identificatie").alias("bag_id"))


@query("j01_j03_cadastre_attributes")
def _(spark, sf):
    out = enrich.attach(stock_ids(spark, sf), enrich.cadastre_attributes(b.pand(spark, sf)))
    return out.select("bag_id", "bag_construction_year", geom2d.area(F.col("footprint_geom")).alias("area"))


@query("j04_register_3d")
def _(spark, sf):
    return enrich.attach(stock_ids(spark, sf), enrich.register_3d(b.flat(spark, sf, "bag3d")))


@query("j05_height_percentiles")
def _(spark, sf):
    based = enrich.attach(stock_ids(spark, sf), enrich.register_3d(b.flat(spark, sf, "bag3d")))
    out = enrich.heights_above_ground(based, b.flat(spark, sf, "lod12_2d"))
    return rounded(out.select("bag_id", "h_min", "h_50p", "h_70p", "h_max"), "h_min", "h_50p", "h_70p", "h_max")


def mesh_buildings(spark, sf) -> DataFrame:
    return enrich.register_3d(b.flat(spark, sf, "bag3d"))


def lod12(spark, sf) -> DataFrame:
    return meshes.fetch(mesh_buildings(spark, sf), b.lod12_3d(spark, sf))


def lod22(spark, sf) -> DataFrame:
    return meshes.fetch(mesh_buildings(spark, sf), b.lod22_3d(spark, sf))


@query("j06_mesh_fetch")
def _(spark, sf):
    return lod22(spark, sf).select("bag_id", F.size("faces").alias("n_faces"))


@query("j07_j11_area_statistics")
def _(spark, sf):
    base = b.pand(spark, sf).select(F.col("identificatie").alias("bag_id"), F.col("geom").alias("footprint_geom"))
    return spatial.attach_area_statistics(base, b.buurten(spark, sf), prepare.AREA_COLUMNS, "buurtcode").drop("footprint_geom")


def surroundings(spark, sf) -> DataFrame:
    return footprints.candidate_buildings(b.pand(spark, sf), b.flat(spark, sf, "adres"))


def stored_surroundings(spark, sf) -> DataFrame:
    """Written once, as the spatial joins read their buildings several times."""
    return checkpointed(surroundings(spark, sf))


@query("j12_j14_adjacent_counts")
def _(spark, sf):
    return spatial.adjacent_counts(stored_surroundings(spark, sf), DEFAULTS.distance_adjacent, predicates.residential(),
                                   footprints.countable(F.col("bag_function")))


@query("j13_j14_neighbour_counts")
def _(spark, sf):
    return spatial.neighbour_counts(stored_surroundings(spark, sf), DEFAULTS.neighbour_radii, predicates.residential(),
                                    footprints.countable(F.col("bag_function")))


@query("j15_candidate_buildings")
def _(spark, sf):
    return surroundings(spark, sf).select("bag_id", "bag_function", "x", "y")


@query("j15_region_candidates")
def _(spark, sf):
    return footprints.candidate_buildings(b.pand(spark, sf), b.flat(spark, sf, "adres"), REGION).select("bag_id", "bag_function")


def best_predictions(spark, sf) -> DataFrame:
    return b.flat(spark, sf, "pred").where("model = 'model_1.4'")


def reference_counts(spark, sf) -> DataFrame:
    return refmodel.with_reference_model(b.flat(spark, sf, "stock")).select("bag_id", "ref_model")


@query("j16_predictions_with_reference")
def _(spark, sf):
    return evaluate.with_reference(best_predictions(spark, sf), reference_counts(spark, sf)).select(
        "bag_id", "split", "clean_floors", "pred_value", "ref_model")


@query("j17_geometry_with_predictions")
def _(spark, sf):
    shapes = b.pand(spark, sf).select(F.col("identificatie").alias("bag_id"), "geom")
    pred = evaluate.with_errors(best_predictions(spark, sf).where("split = 'test'"))
    return shapes.join(pred, "bag_id").select("bag_id", geom2d.area(F.col("geom")).alias("area"), "error", "abs_error")


@query("j18_label_with_error")
def _(spark, sf):
    return evaluate.with_errors(best_predictions(spark, sf)).select("bag_id", "clean_floors", "abs_error")


@query("j20_import_results")
def _(spark, sf):
    return enrich.attach(stock_ids(spark, sf), b.flat(spark, sf, "train").select(
        "bag_id", "no_floors", F.lit("y").alias("is_clean")))


# --- aggregates ------------------------------------------------------------------------------

@query("a01_a04_unit_attributes")
def _(spark, sf):
    return enrich.unit_attributes(b.flat(spark, sf, "adres")).select(
        "bag_id", "bag_net_internal_area", "bag_no_units", F.array_join("uses", "|").alias("uses"), "residential_uses")


@query("a04_residential_units")
def _(spark, sf):
    return classified(spark, sf).select("bag_id", "bag_no_res_units")


@query("a05_top_level")
def _(spark, sf):
    return labels.plausible(label_sources(spark, sf)["c4_rho"]).select("bag_id", "no_floors")


@query("a06_neighbour_totals")
def _(spark, sf):
    counts = spatial.neighbour_counts(stored_surroundings(spark, sf), DEFAULTS.neighbour_radii, predicates.residential(),
                                      footprints.countable(F.col("bag_function")))
    return counts.groupBy(F.substring("bag_id", 1, 4).alias("gm_code")).agg(*[
        F.sum(f"footprint_no_neighbours_{r}m").alias(f"within_{r}m") for r in DEFAULTS.neighbour_radii])


@query("a07_cleaning_step_counts")
def _(spark, sf):
    rows = clean.complete_rows(b.flat(spark, sf, "train"), ["bag_id", "no_floors", "h_70p", "bag_function", "bag3d_roof_type"])
    return clean.step_counts(clean.height_steps(rows))


@query("a08_floor_histogram")
def _(spark, sf):
    return evaluate.floor_histogram(b.flat(spark, sf, "pred").where("model = 'model_1'"), by=("split",))


@query("a09_floor_percentile")
def _(spark, sf):
    return rounded(evaluate.floor_percentile(b.flat(spark, sf, "train"), 0.9, "no_floors"), "percentile")


@query("a10_class_counts")
def _(spark, sf):
    sources = b.flat(spark, sf, "stock").select("bag_id", "data_source")
    return evaluate.class_counts(classified(spark, sf).join(sources, "bag_id"))


@query("a11_source_shares")
def _(spark, sf):
    return rounded(evaluate.source_shares(b.flat(spark, sf, "train")), "percent")


@query("a12_a15_overall_metrics")
def _(spark, sf):
    out = evaluate.overall(b.flat(spark, sf, "pred"), by=("model", "split"))
    return rounded(out, "accuracy", "mae", "rmse")


@query("a16_class_metrics")
def _(spark, sf):
    out = evaluate.per_class(b.flat(spark, sf, "pred"), DEFAULTS.class_threshold, by=("model", "split"))
    return rounded(out, *[c for c in out.columns if c not in ("model", "split")])


@query("a17_model_table")
def _(spark, sf):
    return evaluate.model_table(b.flat(spark, sf, "pred"))


@query("a17_model_table_per_class")
def _(spark, sf):
    return evaluate.model_table_per_class(b.flat(spark, sf, "pred"), DEFAULTS.class_threshold)


@query("a18_three_way_comparison")
def _(spark, sf):
    results = evaluate.with_reference(best_predictions(spark, sf).where("split = 'test'"), reference_counts(spark, sf))
    return evaluate.compare_models(results, DEFAULTS.class_threshold)


@query("a19_abs_error_frequency")
def _(spark, sf):
    return evaluate.abs_error_frequency(b.flat(spark, sf, "pred"), ("model", "split"))


@query("a19_mean_error_per_floor")
def _(spark, sf):
    return rounded(evaluate.mean_abs_error_per_floor(b.flat(spark, sf, "pred"), by=("model", "split")), "mean_abs_error")


@query("a20_confusion")
def _(spark, sf):
    return rounded(evaluate.confusion(b.flat(spark, sf, "pred"), by=("model",)), "share")


@query("a22_gross_errors")
def _(spark, sf):
    return evaluate.gross_errors(b.flat(spark, sf, "pred"), 1).select("bag_id", "model", "error")


@query("a22_rounding_effect")
def _(spark, sf):
    out = evaluate.rounding_effect(b.flat(spark, sf, "pred"), by=("model", "split"))
    return rounded(out, "mae_raw", "mae_rounded", "rmse_raw", "rmse_rounded")


# --- group-wise, ordering and sets -----------------------------------------------------------

def survivors(spark, sf) -> DataFrame:
    rows = clean.with_storey_height(b.flat(spark, sf, "train").where("h_70p IS NOT NULL"))
    return rows.where(F.col("avg_h_storey") > clean.MIN_STOREY_HEIGHT).select("bag_id", "no_floors", "h_70p")


@query("w01_iqr_outliers")
def _(spark, sf):
    return clean.flag_iqr_outliers(survivors(spark, sf), "h_70p").select("bag_id", "is_outlier")


@query("w01_two_pass_survivors")
def _(spark, sf):
    rows = clean.complete_rows(b.flat(spark, sf, "train"), ["bag_id", "no_floors", "h_70p", "bag_function", "bag3d_roof_type"])
    return clean.height_steps(rows).select("bag_id", "removed_at_step")


@query("w02_outer_percentiles")
def _(spark, sf):
    return clean.flag_outer_percentiles(survivors(spark, sf), 0.05, 0.95, "h_70p").select("bag_id", "is_outlier")


@query("w04_one_row_per_building")
def _(spark, sf):
    units = b.flat(spark, sf, "adres").select("pandid", "adresseerbaarobject", "verblijfsobjectstatus")
    return enrich.one_per_key(units, "pandid", ["adresseerbaarobject", "verblijfsobjectstatus"],
                              ["adresseerbaarobject", "verblijfsobjectstatus"])


@query("w05_stratified_split")
def _(spark, sf):
    return split.stratified(b.flat(spark, sf, "train")).select("bag_id", "split")


@query("w06_id_hash_split")
def _(spark, sf):
    return split.by_id_hash(b.flat(spark, sf, "stock")).select("bag_id", split.id_hash(F.col("bag_id")).alias("crc"), "split")


@query("o06_first_rows_per_source")
def _(spark, sf):
    return stats.first_rows(b.flat(spark, sf, "stock").select("bag_id", "data_source", "no_floors"), 10)


@query("x01_x02_stacked_sources")
def _(spark, sf):
    return labels.standardised(label_sources(spark, sf)).select("bag_id", "no_floors", "data_source")


@query("x03_wall_heights_off_roof")
def _(spark, sf):
    def zs(sem):
        return F.transform(F.flatten(F.transform(F.filter("faces", lambda f: f["sem"] == sem), lambda f: f["ring"])), lambda p: p["z"])
    return lod22(spark, sf).select("bag_id", F.size(F.array_except(zs(mesh3d.WALL), zs(mesh3d.ROOF))).alias("n"))


@query("x04_split_back_by_source")
def _(spark, sf):
    path = scratch_path(spark, "sources")
    b.flat(spark, sf, "stock").select("bag_id", "no_floors", "data_source").write.partitionBy("data_source").parquet(path)
    return spark.read.parquet(path).where("data_source = 'c3_dhg'").select("bag_id", "no_floors")


# --- footprints ------------------------------------------------------------------------------

@query("g01_g02_footprint_measures")
def _(spark, sf):
    out = footprints.with_measures(b.pand(spark, sf), "geom")
    return rounded(out.select("identificatie", "footprint_area", "footprint_perim"), "footprint_area", "footprint_perim")


@query("g03_simplified_vertices")
def _(spark, sf):
    return footprints.simplified_vertices(b.pand(spark, sf), "identificatie", "geom")


@query("g04_mitre_buffer")
def _(spark, sf):
    grown = b.pand(spark, sf).withColumn("_b", geom2d.bbox(geom2d.mitre_buffer(F.col("geom"), 0.1)))
    return grown.select("identificatie", *[r6(F.col("_b")[k]).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@query("g05_centroid")
def _(spark, sf):
    return rounded(footprints.with_centroid(b.pand(spark, sf), "geom").select("identificatie", "x", "y"), "x", "y")


@query("g06_municipality_extent")
def _(spark, sf):
    return footprints.municipality_extent(b.gemeenten(spark, sf), 300.0)


@query("g06_within_buffered_municipality")
def _(spark, sf):
    base = b.pand(spark, sf).select(F.col("identificatie").alias("bag_id"), F.col("geom").alias("footprint_geom"))
    return footprints.within_municipality(base, b.gemeenten(spark, sf), 300.0)


@query("g07_pairs_within_distance")
def _(spark, sf):
    points = footprints.with_centroid(b.pand(spark, sf), "geom")
    counts = spatial.neighbour_counts(points, DEFAULTS.neighbour_radii, F.lit(True), F.lit(True), "identificatie")
    return counts.agg(*[F.sum(f"footprint_no_neighbours_{r}m").alias(f"pairs_{r}m") for r in DEFAULTS.neighbour_radii])


@query("g08_grid_cells")
def _(spark, sf):
    boxed = b.pand(spark, sf).withColumn("_b", geom2d.bbox(F.col("geom")))
    return spatial.with_cells(boxed, "_b", 32.0).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("g09_touching_footprints")
def _(spark, sf):
    base = b.pand(spark, sf).select(F.col("identificatie").alias("bag_id"), F.col("geom").alias("footprint_geom"))
    counts = spatial.adjacent_counts(base, 0.1, F.lit(True), F.lit(True))
    return counts.where("footprint_no_adjacent > 0")


# --- meshes ----------------------------------------------------------------------------------

@query("m01_height_references")
def _(spark, sf):
    out = meshes.height_references(lod22(spark, sf))
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c != "bag_id"})


@query("m02_face_areas")
def _(spark, sf):
    areas = F.transform("faces", lambda f: F.struct(f["sem"].alias("sem"), mesh3d.polygon_area(f["ring"]).alias("a")))
    faces = lod12(spark, sf).select("bag_id", F.explode(areas).alias("f"))
    return faces.groupBy("bag_id", F.col("f.sem").alias("sem")).agg(r6(F.sum("f.a")).alias("area"))


@query("m03_surface_areas")
def _(spark, sf):
    # compared before the 3-decimal rounding, whose ties fall on either side of the last digit
    return lod22(spark, sf).select(
        "bag_id", r6(mesh3d.surface_area(F.col("faces"), mesh3d.WALL)).alias("lod22_area_walls"),
        r6(mesh3d.surface_area(F.col("faces"), mesh3d.ROOF)).alias("lod22_area_roof"))


@query("m04_distinct_vertices")
def _(spark, sf):
    return lod22(spark, sf).select("bag_id", mesh3d.vertex_count(F.col("faces")).alias("n_vertices"))


@query("m05_closed_volume")
def _(spark, sf):
    checked = meshes.quality(lod22(spark, sf)).where("is_valid")
    return checked.select("bag_id", r6(mesh3d.closed_volume(F.col("faces"))).alias("volume"))


@query("m06_mesh_quality")
def _(spark, sf):
    return meshes.quality(lod12(spark, sf)).select("bag_id", "is_valid", "open_edges", F.array_join("codes", ",").alias("codes"))


@query("m06_validity")
def _(spark, sf):
    return meshes.quality(lod12(spark, sf)).select("bag_id", "is_valid")


@query("m06_quality_report")
def _(spark, sf):
    return meshes.quality_report(meshes.quality(lod12(spark, sf)))


@query("m07_sampled_volume")
def _(spark, sf):
    broken = meshes.quality(lod12(spark, sf)).where("NOT is_valid")
    return rounded(meshes.sampled_volume(broken, 75), "sampled_volume")


@query("m08_held_at_bound")
def _(spark, sf):
    m = meshes.quality(lod22(spark, sf)).where("is_valid").withColumn("_v", mesh3d.closed_volume(F.col("faces")) * 2)
    return m.select("bag_id", r6(meshes.held_at_bound(F.col("_v"), meshes.prism_bound(F.col("faces")))).alias("volume"))


@query("m05_m08_volumes")
def _(spark, sf):
    out = meshes.volumes(lod12(spark, sf), "lod12", 75)
    return out.select("bag_id", nan_to_null(F.col("lod12_volume")).alias("lod12_volume"))


@query("m05_m08_exact_volumes")
def _(spark, sf):
    """The job's volumes of closed meshes; open ones, whose volume is sampled, only say that they have one."""
    volume = nan_to_null(F.col("lod12_volume"))
    out = meshes.volumes(lod12(spark, sf), "lod12", 75).join(
        meshes.quality(lod12(spark, sf)).select("bag_id", "is_valid"), "bag_id")
    return out.select("bag_id", F.when(F.col("is_valid"), F.floor(volume * 10 + 0.0004)).alias("decimetres"),
                      (volume > 0).alias("is_positive"))


# --- statistics ------------------------------------------------------------------------------

@query("f01_pearson")
def _(spark, sf):
    return rounded(stats.pearson(model_frame(spark, sf), [*NUMERIC, LABEL]), "corr")


@query("o01_label_correlation")
def _(spark, sf):
    corr = stats.pearson(model_frame(spark, sf), [*NUMERIC, LABEL])
    return rounded(stats.label_correlation(corr, LABEL), "corr")


@query("f02_spearman")
def _(spark, sf):
    return rounded(stats.spearman(model_frame(spark, sf), [*NUMERIC, LABEL]), "corr")


VIF_COLUMNS = ["footprint_area", "footprint_no_vertices"]


@query("f03_o02_variance_inflation")
def _(spark, sf):
    return rounded(stats.variance_inflation(model_frame(spark, sf), VIF_COLUMNS), "VIF").where("variables <> 'intercept'")


@query("f03_variance_inflation_all")
def _(spark, sf):
    return stats.variance_inflation(model_frame(spark, sf), NUMERIC).withColumn("VIF", F.round("VIF", 4))


@query("f04_f_scores")
def _(spark, sf):
    return rounded(stats.f_scores(clean.complete_rows(model_frame(spark, sf)), NUMERIC, LABEL), "score")


@query("f05_mutual_information")
def _(spark, sf):
    return rounded(stats.mutual_information(clean.complete_rows(model_frame(spark, sf)), NUMERIC, LABEL), "score")


@query("o04_k_best_f")
def _(spark, sf):
    return rounded(stats.k_best(model_frame(spark, sf), MODEL_FEATURES, LABEL, "f_regression", 10), "score")


@query("o04_k_best_mi")
def _(spark, sf):
    return rounded(stats.k_best(model_frame(spark, sf), MODEL_FEATURES, LABEL, "mutual_info_regression", 10), "score")


CHOSEN = ["h_70p", "bag_net_internal_area", "footprint_area", "lod22_volume", "cbs_cafe_avg_1km"]


@query("f06_normalised_scores")
def _(spark, sf):
    return rounded(stats.normalised_scores(model_frame(spark, sf), CHOSEN, LABEL), "f_score", "mi_score")


@query("f07_feature_clusters")
def _(spark, sf):
    return rounded(stats.feature_clusters(model_frame(spark, sf), NUMERIC, LABEL), "corr")


@query("f08_w03_uncorrelated_features")
def _(spark, sf):
    return rounded(stats.uncorrelated_features(stats.feature_clusters(model_frame(spark, sf), NUMERIC, LABEL)), "corr")


@query("j19_clusters_with_correlation")
def _(spark, sf):
    found = stats.feature_clusters(model_frame(spark, sf), NUMERIC, LABEL)
    return rounded(found.groupBy("cluster").agg(F.count("*").alias("n"), F.max("corr").alias("best")), "best")


@query("m09_a21_scale_medians")
def _(spark, sf):
    study = checkpointed(meshes.scale_study(lod22(spark, sf)))
    return rounded(evaluate.scale_medians(study), "median_diff")


@query("flagship_rule_of_thumb")
def _(spark, sf):
    return rule_of_thumb_quality(spark, sf)


@query("prep_feature_table")
def _(spark, sf):
    held = written(spark, sf)
    labelled = labels.plausible(labels.standardised(label_sources(spark, sf, held)))
    out = prepare.feature_table(labelled, registers(spark, sf, held))
    return rounded(out.select(
        "bag_id", "data_source", "no_floors", "bag_function", "bag_construction_year", "bag_net_internal_area", "bag_no_units",
        "bag_no_res_units", "bag3d_roof_type", "esri_building_type", "h_70p", "cbs_pop_per_km2", "footprint_area",
        "footprint_no_adjacent", "footprint_no_neighbours_25m", "footprint_no_neighbours_100m", "lod12_area_roof"),
        "h_70p", "footprint_area", "lod12_area_roof")


@query("prep_training_table")
def _(spark, sf):
    held = written(spark, sf)
    out = prepare.training_table(label_sources(spark, sf, held), registers(spark, sf, held), b.flat(spark, sf, "manual", held))
    return out.select("bag_id", "data_source", "no_floors", "bag_function", "bag_no_units", "bag_no_res_units",
                      "cbs_pop_per_km2", "footprint_no_adjacent", "footprint_no_neighbours_100m",
                      "is_clean", "clean_floors", "ref_model")


# --- preparation, training, tuning -----------------------------------------------------------

def split_model_frame(spark, sf) -> DataFrame:
    return split.stratified(model_frame(spark, sf))


@query("l01_l02_imputed_scaled")
def _(spark, sf):
    df = model_frame(spark, sf)
    columns = ["h_70p", "bag_no_units", "lod12_volume", "bag_construction_year"]
    out = prep.fit(df, columns, ["bag_id"]).transform(df)
    return rounded(out.select("bag_id", *columns), *columns)


@query("l03_l04_imputed_encoded")
def _(spark, sf):
    df = model_frame(spark, sf)
    columns = ["bag_function", "bag3d_roof_type"]
    stages = prep.fit(df, columns, ["bag_id"])
    names = prep.input_names(stages)
    return stages.transform(df).select("bag_id", *[F.col(f"`{n}`").alias(n.replace(" ", "_").replace("-", "_")) for n in names])


def _trained(spark, sf, algorithm: str):
    frame = checkpointed(split_model_frame(spark, sf))
    model, _ = training.fit(frame.where("split = 'train'"), MODEL_FEATURES, algorithm)
    return frame, model


def _evaluated(spark, sf, algorithm: str) -> DataFrame:
    frame, model = _trained(spark, sf, algorithm)
    return training.evaluate_models({("model_1", algorithm, "default"): model},
                                    frame.where("split = 'train'"), frame.where("split = 'test'"))


@query("l06_random_forest")
def _(spark, sf):
    return _evaluated(spark, sf, "rfr")


@query("l05_l07_l17_gradient_boosting")
def _(spark, sf):
    return _evaluated(spark, sf, "gbr")


@query("l08_linear_svr")
def _(spark, sf):
    return _evaluated(spark, sf, "svr")


@query("l14_o03_svr_coefficients")
def _(spark, sf):
    return training.importances(_trained(spark, sf, "svr")[1], spark)


@query("l14_o05_impurity_importance")
def _(spark, sf):
    _, model = _trained(spark, sf, "gbr")
    weights = training.importances(model, spark)
    chosen = stats.k_most_important(weights, DEFAULTS.top_k)
    return weights.withColumn("chosen", F.element_at(F.split("feature", "_x0_"), 1).isin(chosen))


@query("l16_s16_saved_model_predictions")
def _(spark, sf):
    frame, model = _trained(spark, sf, "svr")
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    return training.predict(sinks.load_model(path), frame, ["split"])


@query("l09_random_search")
def _(spark, sf):
    """75 draws over 5 folds of the linear model."""
    frame = split_model_frame(spark, sf).where("split = 'train'")
    _, table = tune.random_search(frame, MODEL_FEATURES, "svr")
    return table


@query("l10_f09_subset_models")
def _(spark, sf):
    """The best draw of the whole search refits all features and every subset."""
    frame = checkpointed(split_model_frame(spark, sf))
    train_rows = frame.where("split = 'train'")
    best, _ = tune.random_search(train_rows, MODEL_FEATURES, "svr")
    base = training.refit(train_rows, {"model_1": MODEL_FEATURES}, "svr", best)
    subsets = stats.feature_subsets(train_rows.drop("split"), MODEL_FEATURES, LABEL, DEFAULTS.text_columns,
                                    {"svr": training.importances(base["model_1"], spark)}, DEFAULTS.top_k, DEFAULTS.cluster_cut)
    models = base | training.refit(train_rows, subsets, "svr", best)
    return training.evaluate_models({(name, "svr", "refit"): m for name, m in models.items()},
                                    train_rows, frame.where("split = 'test'"))


@query("l11_validation_curve")
def _(spark, sf):
    return tune.validation_curve(split_model_frame(spark, sf).where("split = 'train'"), MODEL_FEATURES, "svr", "C", tune.grid("svr")["C"])


@query("l12_iteration_tolerance_grid")
def _(spark, sf):
    frame = checkpointed(split_model_frame(spark, sf))
    return tune.iteration_tolerance_grid(frame.where("split = 'train'"), frame.where("split = 'test'"), MODEL_FEATURES)


@query("l13_learning_curve")
def _(spark, sf):
    out = tune.learning_curve(split_model_frame(spark, sf).where("split = 'train'"), MODEL_FEATURES, "svr")
    return out.drop("fit_seconds")


@query("l15_permutation_importance")
def _(spark, sf):
    frame, model = _trained(spark, sf, "svr")
    return training.permutation_importance(model, frame.where("split = 'train'"))


def unseen_table(spark, sf) -> DataFrame:
    """Features and rule of thumb of the case study's buildings, from the registers."""
    held = written(spark, sf)
    ids = enrich.case_study_ids(b.pand(spark, sf, held).where("region = 4"))
    return prepare.case_study_table(ids, registers(spark, sf, held))


@query("l18_case_study_table")
def _(spark, sf):
    out = unseen_table(spark, sf)
    return rounded(out.select(
        "bag_id", "bag_function", "bag_construction_year", "bag_net_internal_area", "bag_no_units", "bag3d_roof_type", "esri_building_type",
        "h_70p", "cbs_pop_per_km2", "footprint_area", "footprint_no_adjacent", "footprint_no_neighbours_100m", "lod12_area_roof",
        "floors_height_based", "floors_area_based", "ref_model", "ref_model_unrounded"),
        "h_70p", "footprint_area", "lod12_area_roof", "ref_model_unrounded")


def _studied(spark, sf) -> DataFrame:
    _, model = _trained(spark, sf, "svr")
    unseen = unseen_table(spark, sf)
    kept = unseen.select("bag_id", "footprint_geom")
    return modelling.case_study(model, unseen).join(kept, "bag_id")


@query("l18_case_study")
def _(spark, sf):
    return _studied(spark, sf).drop("footprint_geom")


@query("l18_s11_case_study_geojson")
def _(spark, sf):
    """The case study as the written file holds it."""
    path = scratch_path(spark, "features")
    sinks.write_geojson(_studied(spark, sf).where("footprint_geom IS NOT NULL"), path, "footprint_geom",
                        ["bag_id", "pred_value_rounded", "ref_model", "diff"])
    return spark.read.text(path)


@query("s15_statistic_tables")
def _(spark, sf):
    """Correlation to the label and inflation factors, as their written tables hold them."""
    df = model_frame(spark, sf)
    tables = {"label_correlation": stats.label_correlation(stats.pearson(df, [*NUMERIC, LABEL]), LABEL),
              "variance_inflation": stats.variance_inflation(df, NUMERIC).select(F.col("variables").alias("feature"), "VIF")}
    return _written_statistics(spark, tables, 4)


@query("s15_model_tables")
def _(spark, sf):
    """Coefficients, impurity and permutation importances, as their written tables hold them."""
    frame, linear = _trained(spark, sf, "svr")
    trees, _ = training.fit(frame.where("split = 'train'"), MODEL_FEATURES, "gbr")
    return _written_statistics(spark, {
        "coefficients": training.importances(linear, spark), "impurity_importance": training.importances(trees, spark),
        "permutation_importance": training.permutation_importance(linear, frame.where("split = 'test'"))}, 6)


def _written_statistics(spark, results: dict[str, DataFrame], digits: int) -> DataFrame:
    parts = []
    for name, table in results.items():
        path = scratch_path(spark, name)
        sinks.write_statistics(table, path)
        read = spark.read.schema("feature string, value double").option("header", True).csv(path, enforceSchema=True)
        parts.append(read.select(F.lit(name).alias("statistic"), "feature", F.round("value", digits).alias("value")))
    return b.union_all(parts)


@query("l17_all_lists_linear")
def _(spark, sf):
    """A linear model of every feature list, trained and scored on the split of its list, beside the mean of the label."""
    return modelling.evaluate_lists(b.flat(spark, sf, "train").withColumn("clean_floors", F.col("no_floors")).withColumn("is_clean", F.lit("y")),
                                    ("svr",))


@query("l17_all_lists_boosting")
def _(spark, sf):
    """The same with boosted trees."""
    return modelling.evaluate_lists(b.flat(spark, sf, "train").withColumn("clean_floors", F.col("no_floors")).withColumn("is_clean", F.lit("y")),
                                    ("gbr",))
