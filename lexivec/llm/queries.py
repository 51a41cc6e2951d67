"""One query per operator over its whole table, by name; ``SQL`` has what DuckDB can say of them."""

from __future__ import annotations

from lexivec.llm import (
    bpe,
    exact_dedup,
    html_main,
    line_dedup,
    ngram_join,
    packing,
    quality_gam,
    secret_scan,
    url_reputation,
    winnow,
)
from lexivec.llm.common import table


def op1_quality_gam(spark, sf_dir):
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op3_html_main(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_url_reputation(spark, sf_dir):
    return url_reputation.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_winnowing(spark, sf_dir):
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_gam,
        op2_ngram_join,
        op3_html_main,
        op4_secret_scan,
        op5_bpe,
        op6_packing,
        op7_exact_dedup,
        op8_url_reputation,
        op9_winnowing,
        op10_line_dedup,
    )
}
