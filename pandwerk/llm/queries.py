"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandwerk.llm import alignment, bpe, html_text, licenses, lm_score, mixing, near_vectors, ngram_join, pii, quality, secrets, url_filter, whitening
from pandwerk.llm.common import read_table
from pandwerk.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_secret_scan(spark, sf_dir):
    """An owner is a source; a repository is a source's texts of one language."""
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, owner=[F.col("source")], repo=[F.col("source"), F.col("lang")],
                                 carry=("doc_id",))
    base = F.filter("secrets", lambda s: s["kind"] != "bare")

    def count(field, value):
        return F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    return found.select(
        "doc_id", *[count("kind", k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"),
        count("kind", "bare"), count("verdict", "live"), count("verdict", "example"))


def op2_vector_near_dedup(spark, sf_dir):
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.judged(docs, carry=("doc_id",)).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_license_scan(spark, sf_dir):
    found = licenses.license_matches(read_table(spark, sf_dir, "documents"), carry=("doc_id",))
    best = F.array_max(F.transform("matches", lambda m: F.struct(
        m["dice"].alias("dice"), (-m["line"]).alias("line"), m["license"].alias("license"))))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform(
        "matches", lambda m: F.concat_ws(":", m["line"].cast("string"), m["license"])), ",").alias("matches"),
        best.alias("_best")).select("doc_id", "n_matches", "matches", F.col("_best.license").alias("license"),
                                    F.col("_best.dice").alias("dice"))


def op5_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("strict_hits"), F.col("soft_hits"),
                         "soft_weight")


def op6_bpe_round_trip(spark, sf_dir):
    import public_tokenizers

    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), carry=("doc_id",),
                              path=public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op7_source_mix(spark, sf_dir):
    rows, units = mixing.copies(read_table(spark, sf_dir, "documents"), carry=("doc_id",))
    return units.join(rows.select("rid", "_c0"), "rid").select(
        F.col("_c0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_ngram_jaccard(spark, sf_dir):
    return ngram_join.component_ids(read_table(spark, sf_dir, "documents"), "doc_id")


def op9_main_text(spark, sf_dir):
    pages = html_text.extracted(read_table(spark, sf_dir, "pages"), carry=("page_id", "url"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op10_lattice_score(spark, sf_dir):
    import public_tokenizers

    return lm_score.scored(read_table(spark, sf_dir, "documents"), "doc_id",
                           path=public_tokenizers.path("piece_bpe_32k.model"))


def op11_whitened_vectors(spark, sf_dir):
    rows, model, error = whitening.whitened(read_table(spark, sf_dir, "embeddings"), weights="one", carry=("vec_id",))
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return rows.select(F.col("_c0").alias("vec_id"), F.col("deviation").cast("long").alias("deviation"),
                       F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    found = alignment.aligned_corpus(read_table(spark, sf_dir, "documents"), carry=("doc_id",), digest=True,
                                     byte_path=public_tokenizers.path("byte_bpe_50k.json"),
                                     piece_path=public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("_c0").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))


def op13_personal_data(spark, sf_dir):
    found, _ = pii.pii_spans(read_table(spark, sf_dir, "documents"), carry=("doc_id",))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(F.col("_c0").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_vector_near_dedup, op3_quality_rules, op4_license_scan,
                                 op5_url_filter, op6_bpe_round_trip, op7_source_mix, op8_ngram_jaccard, op9_main_text, op10_lattice_score,
                                 op11_whitened_vectors, op12_token_alignment, op13_personal_data,
                                 pipeline)}
