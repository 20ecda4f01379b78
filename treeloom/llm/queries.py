"""The queries of this subpackage, by the names they are registered under."""

from __future__ import annotations

from treeloom.llm import audio, bpe, content_sort, conversation, neighbours, ngram_join, oracles, packing, pii, ppm, secrets, token_counts, url_filter, whitening
from treeloom.llm.common import table


def op1(spark, sf_dir):
    return token_counts.part_counts(table(spark, sf_dir, "documents"), token_counts.default_path())


def op2(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), rounds=None)


def op3(spark, sf_dir):
    return content_sort.groups(table(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


def op5(spark, sf_dir):
    return ppm.identified(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return packing.digests(packing.packed(table(spark, sf_dir, "documents"), bpe.default_path()))


def op10(spark, sf_dir):
    return audio.digests(audio.columns(table(spark, sf_dir, "documents")))


def op11(spark, sf_dir):
    return neighbours.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12(spark, sf_dir):
    return conversation.repaired(conversation.damaged(table(spark, sf_dir, "conversations")))


def op13(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": op1,
    "op2_url_filter": op2,
    "op3_exact_dedup": op3,
    "op4_bpe": op4,
    "op5_language_id": op5,
    "op6_ngram_join": op6,
    "op7_secret_scan": op7,
    "op8_pii": op8,
    "op9_packing": op9,
    "op10_audio": op10,
    "op11_quality": op11,
    "op12_conversation_repair": op12,
    "op13_whitening": op13,
}

SQL = {
    "op2_url_filter": oracles.url_verdicts(),
    "op3_exact_dedup": content_sort.SQL,
    "op6_ngram_join": oracles.ngram_components(),
    "op7_secret_scan": oracles.secret_scan(),
    "op12_conversation_repair": oracles.conversation_repair(),
}
