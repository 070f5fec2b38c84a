"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm import decontaminate, html_render, license_scan, packing, pii, quality_rules, simhash_dedup, substring_dedup, toxicity, warc
from sitegraph.llm.common import keep, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.decompose(table(spark, sf_dir, "documents")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.audit(spark, warc.records(pages), warc.records(warc.mirror(pages)))
    return found.withColumnRenamed("key", "page_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score(docs, model))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(spark, table(spark, sf_dir, "documents"))


def op8_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.count_texts(table(spark, sf_dir, "documents"))
    return quality_rules.digest(quality_rules.judge(keep(spark, counted)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.train()))


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_warc_fixity": op2_warc_fixity,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_html_render": op8_html_render,
        "op9_quality_rules": op9_quality_rules,
        "op10_pii": op10_pii,
    }


_RECORD = """strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:'
  || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || cast(strlen(coalesce(html, '')) as varchar)
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))"""

#: Records compared one by one, without trees.
OP2_SQL = f"""
with one as (select page_id, url, html, {_RECORD} as n from pages),
copy as (
  select page_id, case when page_id % 251 = 3 then url || '#' else url end as url,
    case when page_id % 251 = 0 then left(html, cast(floor(length(html) / 2) as int)) when page_id % 251 = 1 then html || ' ' else html end as html
  from pages where page_id % 251 <> 2),
two as (select page_id, url, html, {_RECORD} as n from copy),
a as (select *, floor(page_id / 32768) as shard, sum(n) over (partition by floor(page_id / 32768) order by page_id) - n as at from one),
b as (select *, floor(page_id / 32768) as shard, sum(n) over (partition by floor(page_id / 32768) order by page_id) - n as at from two)
select cast(coalesce(a.shard, b.shard) as bigint) as shard, coalesce(a.page_id, b.page_id) as page_id,
  case when b.page_id is null then 'missing' when a.page_id is null then 'extra' else 'altered' end as status,
  cast(a.at as bigint) as offset_first, cast(a.n as bigint) as length_first, cast(b.at as bigint) as offset_second, cast(b.n as bigint) as length_second
from a full outer join b on a.page_id = b.page_id
where a.url is distinct from b.url or a.html is distinct from b.html
"""


#: Windows as strings of their words, the least doc_id of each, and the words no window of another document takes away.
OP5_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 49], ' ') as k from (select *, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
least as (select k, min(doc_id) as f from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join least using (k) where doc_id > f),
word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w),
kept as (
  select word.doc_id, string_agg(word, ' ' order by word.p) as text, count(*) as n
  from word left join gone on word.doc_id = gone.doc_id and word.p = gone.p where gone.p is null group by word.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": OP2_SQL, "op5_substring_dedup": OP5_SQL}
