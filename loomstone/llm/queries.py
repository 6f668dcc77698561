"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_pairs, collocations, license_rules, mixture, perplexity_bands, piece_backend, pii_spans, quote_links, site_templates, spot_signatures, threshold_search, toxic_segments
from .common import table
from .odd_sketch import near_duplicates


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op3_pii_semi_crf(spark, sf_dir):
    return pii_spans.find(table(spark, sf_dir, "documents"))


def op4_spotsigs_fingerprints(spark, sf_dir):
    return spot_signatures.edited(table(spark, sf_dir, "documents"))


def op5_perplexity_bands(spark, sf_dir):
    return perplexity_bands.judge(table(spark, sf_dir, "documents"))


def op6_site_templates(spark, sf_dir):
    return site_templates.extract(table(spark, sf_dir, "pages"))


def op7_subset_sum_mix(spark, sf_dir):
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxic_segments(spark, sf_dir):
    return toxic_segments.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark, sf_dir):
    coded = piece_backend.tokenise(table(spark, sf_dir, "documents"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "n_bytes", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "parity")


def op10_quote_links(spark, sf_dir):
    return quote_links.conversations(quote_links.link(table(spark, sf_dir, "conversations")))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark, sf_dir):
    return byte_pairs.digest(table(spark, sf_dir, "documents"))


def op13_threshold_search(spark, sf_dir):
    return threshold_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Links by all pairs with a common shingle, components by recursion.
OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[k:k + 4], ' ') FOR k IN range(1, greatest(len(ws) - 4, 1) + 1)]) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.a = doc_id"""

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_license_scan, op3_pii_semi_crf, op4_spotsigs_fingerprints, op5_perplexity_bands, op6_site_templates, op7_subset_sum_mix, op8_toxic_segments, op9_sentencepiece, op10_quote_links, op11_collocations, op12_byte_bpe, op13_threshold_search)
}
#: The others train, search or parse in ways that SQL can't express; the tests hold them against plainer versions.
ORACLE: dict[str, str] = {"op1_minhash_near_dedup": OP1, "op2_license_scan": license_rules.oracle(), "op4_spotsigs_fingerprints": spot_signatures.oracle(), "op11_collocations": collocations.ORACLE, "op13_threshold_search": threshold_search.ORACLE}
