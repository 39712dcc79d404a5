"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, fim, fingerprints, langid, licenses, linededup, matroska, minmax, mixing, packing, quality, rans, secrets
from .shared import read_table


def op1_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learnable(docs))
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_best_fit_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.tokenised(docs))


def op3_minmax_near_dedup(spark, sf_dir):
    return minmax.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op4_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_matroska_media(spark, sf_dir):
    return matroska.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_scan(spark, sf_dir):
    return secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_source_mix(spark, sf_dir):
    mix = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_line_dedup(spark, sf_dir):
    cleaned = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", F.col("__removed").alias("removed_chunks"), F.col("__lines_removed").alias("removed_lines"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_rans_token_files(spark, sf_dir):
    parts = rans.plain_parts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rans.digests(rans.write(parts))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.Alignment(read_table(spark, sf_dir, "documents").select("doc_id", "text")).documents()


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_minmax_near_dedup, op4_fingerprints, op5_matroska_media, op6_secret_scan, op7_license_scan, op8_source_mix, op9_quality, op10_line_dedup, op11_fill_in_middle, op12_rans_token_files, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_license_scan": licenses.oracle_sql(),
        "op8_source_mix": f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle_sql()})",
        "op10_line_dedup": linededup.oracle_sql(),
        "op11_fill_in_middle": fim.oracle_sql(),
    }
