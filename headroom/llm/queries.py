"""The registered queries of this subpackage: thin digests of the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontaminate, language, licenses, mixing, near_dup, oracles, prefix_trie, pu_quality, suffix_lpf, token_shards, topk, vector_dedup, whitening
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order; first_position and last_position (of 0 to 1) are where the schedules place a document's copies, null if none is taken."""
    out = mixing.curriculum_assign(read(spark, sf_dir, "documents"))
    place = lambda i: F.round(F.try_element_at("passes", F.lit(i))["position"], 9)
    out = out.withColumn("n_passes", F.size("passes").cast("long")).withColumn("first_position", place(1)).withColumn("last_position", place(-1)).drop("passes", "source")
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))) as place
  from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, (row_number() over (order by encode(source) nulls last) - 1) % 3 as class, [3.0, 1.0, 2.0][class + 1]::double as weight from per),
filled as (
  select *, (1.5::double * (sum(source_size) over ())::double
      - 2.0::double * coalesce(sum(source_size) over (order by source_size / weight, encode(source) nulls last
          rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(weight) over (order by source_size / weight, encode(source) nulls last
          rows between current row and unbounded following) as level
  from ranked),
final as (
  select min_by(level, source_size / weight) filter (level * weight <= 2.0::double * source_size) as level from filled),
targets as (
  select f.source, f.source_size, f.class,
    least(2.0::double * f.source_size, coalesce(final.level * f.weight, 2.0::double * f.source_size)) as target
  from filled f, final),
placed as (
  select d.doc_id, d.size, t.source_size, t.target,
    (coalesce(sum(d.size) over (partition by d.source order by d.place, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0))::bigint as ahead, row_number() over () as row_id, t.class
  from sized d join targets t on d.source is not distinct from t.source),
-- the weight schedules as straight pieces: class, from, to, weight at both ends
pieces(class, t0, t1, w0, w1) as (values (0, 0.0::double, 1.0::double, 1.5::double, 0.5::double), (1, 0.0, 0.6, 0.4, 0.8), (1, 0.6, 1.0, 0.8, 2.2), (2, 0.0, 0.5, 0.8, 1.2), (2, 0.5, 1.0, 1.2, 0.8)),
areas as (select *, coalesce(sum((t1 - t0) * (w0 + w1) / 2) over (partition by class order by t0 rows between unbounded preceding and 1 preceding), 0) as before,
  sum((t1 - t0) * (w0 + w1) / 2) over (partition by class) as whole, (w1 - w0) / (t1 - t0) as slope from pieces),
passes as (
  select p.*, k, greatest(0, least(size, floor(target)::bigint - k * source_size - ahead))::bigint as took, least(1.0::double, (k * source_size + ahead)::double / target) as share
  from placed p, (values (0), (1)) c(k)),
-- a pass stands where the demand so far, the area under the schedule, is the share of the target that was delivered before it
stood as (
  select x.*, a.t0 + case when a.slope = 0 then (share * a.whole - a.before) / a.w0
      else (sqrt(greatest(a.w0 * a.w0 + 2 * a.slope * greatest(share * a.whole - a.before, 0), 0)) - a.w0) / a.slope end as position
  from passes x left join areas a on a.class = x.class and share * a.whole >= a.before and (share * a.whole < a.before + (a.t1 - a.t0) * (a.w0 + a.w1) / 2 or a.t1 = 1)
  where took > 0)
select p.doc_id, p.size, p.source_size, p.target, coalesce(s.taken, 0)::bigint as taken, coalesce(s.n_passes, 0)::bigint as n_passes, round(s.first_position, 9) as first_position, round(s.last_position, 9) as last_position
from placed p left join (select row_id, sum(took) as taken, count(*) as n_passes, min_by(position, k) as first_position, max_by(position, k) as last_position from stood group by row_id) s on s.row_id = p.row_id
"""


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(read(spark, sf_dir, "documents"), default_tokenizer())


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.substring_dedup(read(spark, sf_dir, "documents"))


def op5_suffix_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lpf.suffix_dedup(read(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.minhash_dedup(read(spark, sf_dir, "documents"))


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"), licenses.template_table(spark))


def op9_simhash_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("distance")


def op11_bitsliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_curriculum_mix": op1_curriculum_mix,
    "op2_license_scan": op2_license_scan,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_debruijn_dedup": op4_debruijn_dedup,
    "op5_suffix_lpf_dedup": op5_suffix_lpf_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op6_language_bitmask": op6_language_bitmask,
    "op8_pu_quality": op8_pu_quality,
    "op7_token_shards": op7_token_shards,
    "op9_simhash_decontaminate": op9_simhash_decontaminate,
    "op11_bitsliced_whitening": op11_bitsliced_whitening,
    "op12_threshold_topk": op12_threshold_topk,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op1_curriculum_mix": OP1_SQL, **oracles.ORACLES}
