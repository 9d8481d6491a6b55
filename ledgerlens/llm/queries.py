"""The registered queries of this package: opN_<name>, applied to whole tables."""

from __future__ import annotations

from .common import read_table
from .jaccard_join import jaccard_components
from .laesa import cluster_vectors
from .language_id import identify
from .lz_fingerprint import compare_neighbours
from .oracles import ORACLES
from .posting_lists import nearest_neighbours
from .quality import quality_report
from . import chat_format, mixing
from .secret_scan import span_digest
from .sentencepiece import round_trip_report
from .url_filter import judge
from .vector_join import near_duplicate_vectors
from .whitening import whiten


def op1_sentencepiece(spark, sf_dir):
    return round_trip_report(spark, read_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return identify(spark, read_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark, sf_dir):
    return chat_format.chat_report(spark, read_table(spark, sf_dir, "conversations"))


def op4_embedding_near_dedup(spark, sf_dir):
    return near_duplicate_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark, sf_dir):
    return quality_report(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(spark, read_table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return compare_neighbours(spark, read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return judge(spark, read_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark, sf_dir):
    return span_digest(read_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark, sf_dir):
    return mixing.mix_report(spark, read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whiten(spark, read_table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(spark, read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_language_id, op3_chat_formatting, op4_embedding_near_dedup, op5_quality_classifier,
    op6_document_fingerprints, op7_url_filter, op8_secret_scan, op9_ngram_jaccard_join, op10_source_mixing,
    op11_embedding_whitening, op12_centroid_clustering, op13_nearest_neighbours)}

__all__ = ["QUERIES", "ORACLES"]
