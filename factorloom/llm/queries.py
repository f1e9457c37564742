"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html_wrappers, mixing, quality_knn, quality_rules, secrets, simhash, toxicity, warc
from .common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.classify(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_wrappers.main_text(pages, html_wrappers.wrappers(pages))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark)).where("is_secret")
    return found.select("doc_id", "start", "length", F.sha2(F.encode("secret", "utf-8"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_quality_knn, op4_html_wrappers, op5_pareto_mix, op6_fingerprints, op7_secrets, op8_simhash, op9_warc, op10_toxicity)
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
q as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first_id,
             row_number() over (partition by payload_digest order by page_id nulls last) as k from q)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and k > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and k > 1 then first_id end as refers_to
from r
"""


ORACLE_SQL["op5_pareto_mix"] = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as k from d group by source),
w as (select source, source_size, case k when 0 then 3 when 1 then 1 else 2 end as weight from s),
o as (select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as rn, sum(source_size) over () as total from w),
l as (select *, (3 * total - 4 * coalesce(sum(source_size) over (order by rn rows between unbounded preceding and 1 preceding), 0)) / 2.0
                / sum(weight) over (order by rn rows between current row and unbounded following) as level from o),
cut as (select level, rn from l where level * weight <= 2 * source_size order by rn limit 1),
t as (select l.source, l.source_size, l.weight, (case when cut.rn is null or l.rn < cut.rn then 2.0 * l.source_size else cut.level * l.weight end)::double as target from l left join cut on true),
c as (select *, least(case when source_size > 0 then floor(target / source_size) else 0 end, 2)::bigint as whole from t),
f as (select c.*, n.filled, case when whole < 2 and source_size > 0 then target / source_size - whole else 0 end as chance
      from c join (select source, count(*) filter (size > 0) as filled from d group by source) n on n.source is not distinct from c.source),
r as (select d.doc_id, d.size, d.key, f.*, (('0x' || substr(d.key, 1, 13))::bigint + 0.5) / 4503599627370496.0 as u from d join f on d.source is not distinct from f.source),
q as (select *, case when chance > 0 and size > 0 then (u / (1 - u)) / (chance / (1 - chance) * sqrt(size / (source_size / filled))) end as q from r),
m as (select source, q, key, sum(size)::bigint as mass, any_value(target - whole * source_size) as room, any_value(target / 1000) as near from q where q is not null group by source, q, key),
o2 as (select *, row_number() over (partition by source order by q, key) as k from m),
g(source, k, room, taken, place, mass) as (
  select source, 0::bigint, any_value(room)::double, null::varchar, 0::bigint, 0::bigint from o2 group by source
  union all
  select g.source, o2.k, case when o2.mass <= g.room and g.room > near then g.room - o2.mass else g.room end,
         case when o2.mass <= g.room and g.room > near then o2.key end, o2.k, o2.mass
  from g join o2 on o2.source is not distinct from g.source and o2.k = g.k + 1),
short as (select source, min(room) as short from g group by source),
rest as (select g.source, o2.key, row_number() over (partition by g.source order by o2.mass, o2.k) as j
         from g join o2 on o2.source is not distinct from g.source and o2.k = g.k join short on short.source is not distinct from g.source
         where taken is null and short > near and o2.mass < 2 * short),
more as (select source, taken as key from g where taken is not null union all select source, key from rest where j = 1)
select doc_id, size, source_size, target, (size * (whole + case when exists (select 1 from more where more.key = q.key and more.source is not distinct from q.source) then 1 else 0 end))::bigint as taken from q
"""
