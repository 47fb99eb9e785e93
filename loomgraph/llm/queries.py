"""One thin query per operator: the whole intended table in, the digest columns out."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import audit, bpe, decontam, langid, licenses, lmscore, neardup, pii, quality, resharding, secrets, tokencount, whitening
from loomgraph.llm.common import table


def op1_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    return lmscore.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.classify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance")


def op8_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: Shards of documents before and after op13; a row's old shard goes by its text, so that copies crowd one.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op13_resharding(spark, sf_dir):
    old = F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(OLD_SHARDS))
    return resharding.reshard(table(spark, sf_dir, "documents"), old, NEW_SHARDS)


_ALL = (
    op1_pii, op2_lm_score, op3_license_scan, op4_byte_bpe, op5_token_counts, op6_near_duplicates, op7_quality_rules, op8_language_id,
    op9_secret_scan, op10_decontamination, op11_filter_audit, op12_whitening, op13_resharding,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op10_decontamination": decontam.LEAKS_SQL, "op11_filter_audit": audit.AUDIT_SQL}
