"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, decontaminate, licenses, mixing, phrases, pii, quality, runs, spans, token_counts, toxicity, warc
from quire.llm.common import read
from quire.llm.simhash import simhash_near_dedup


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.secret_key(spark), count="n_replaced")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), ann.every(50))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(read(spark, sf_dir, "documents")).drop("runs")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(read(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.looped(read(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# base32 of a SHA-1: five hex digits are four base32 digits
OP10_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, n, h, min(page_id) over (partition by h) as first,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as digest
  from p
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d
"""

# bytes as two hexadecimal digits each; every 50-byte string with its first document
OP8_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
  select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from d)
), first as (
  select s, min(doc_id) as first from w group by s having count(*) > 1
), x as (
  select distinct doc_id, p from w join first using (s) where doc_id > first
), g as (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from x
), r as (
  select doc_id, min(p) as a, max(p) + 50 as b from (select *, sum(new) over (partition by doc_id order by p) as k from g) group by doc_id, k
), runs as (
  select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a) as removed, count(*) as n from r group by doc_id
), kept as (
  select doc_id, h, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, n,
         array_to_string(list_transform(range(1, coalesce(n, 0) + 2), lambda i: substr(h,
           1 + 2 * case when i = 1 then 0 else b[i - 1] end,
           2 * (case when i = coalesce(n, 0) + 1 then len(h) // 2 else a[i] end - case when i = 1 then 0 else b[i - 1] end))), '') as rest
  from d left join runs using (doc_id)
)
select doc_id, (len(h) // 2)::bigint as n_bytes, n_removed, n_spans, sha256(unhex(rest)) as kept_sha256 from kept
"""


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), sized as (
  select 1 as m union all select 2 union all select 3
), grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from words, sized where len(w) >= m
), f as (
  select lang, m, phrase, count(*) as a from grams group by all
), totals as (
  select lang, sum(a) as n from f where m = 1 group by lang
), often as (
  select *, string_split(phrase, ' ') as w from f where a >= 10
), cuts as (
  select c.lang, c.m, c.phrase, c.a, k, x.a as l, y.a as r,
         ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score
  from often c, (select 1 as k union all select 2) ks, often x, often y
  where c.m > k and x.lang = c.lang and y.lang = c.lang
    and x.phrase = array_to_string(c.w[1:k], ' ') and y.phrase = array_to_string(c.w[k + 1:c.m], ' ')
), worst as (
  select *, row_number() over (partition by lang, phrase order by score, k) as nth from cuts
), inner_parts as (
  select lang, array_to_string(w[1:2], ' ') as phrase, a from often where m = 3
  union all select lang, array_to_string(w[2:3], ' '), a from often where m = 3
), most as (
  select lang, phrase, max(a) as most from inner_parts group by all
), ranked as (
  select c.*, row_number() over (partition by c.lang order by score desc, a desc, c.phrase) as rank
  from worst c left join most p on p.lang = c.lang and p.phrase = c.phrase
  where nth = 1 and (most is null or 100 * most < 50 * a)
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score
from ranked join totals using (lang) where rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op8_suffix_dedup": OP8_SQL.strip(), "op10_warc": OP10_SQL.strip(), "op12_collocations": OP12_SQL.strip()}
