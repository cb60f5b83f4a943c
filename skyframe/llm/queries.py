"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, mixing, packing, quality, rules, runtime, sst, substring, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    runtime.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.export(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_language_id, op4_mix_sources, op5_jaccard_join, op6_quality_rules, op7_token_shards, op8_url_filters, op9_exact_topk, op10_best_fit_packing)}


_MIX = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size, coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) symbols,
    (cast('0x' || substr(md5('1' || chr(1) || coalesce(cast(doc_id as varchar), '-') || chr(1) || coalesce(text, '')), 1, 13) as ubigint) + 5e-1) / 4503599627370496e0 u
  from documents),
keyed as (select doc_id, source, size, -ln(u) / (cast(size + 1 as double) / (size + 1 + symbols)) sample_key from sized),
sources as (select source, cast(sum(size) as bigint) source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from keyed group by source),
levels as (
  select *, row_number() over o k, cast(sum(source_size) over () - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) as double)
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) level
  from sources window o as (order by source_size / weight, source nulls last)),
free as (select arg_min(level, k) level from levels where level * weight < 3 * source_size),
plan as (select source, source_size, least(cast(3 * source_size as double), weight * free.level) target from levels, free),
parts as (select *, case when source_size > 0 then floor(target / source_size) else 0 end epochs from plan),
run as (
  select doc_id, size, source_size, target, epochs, target - epochs * source_size rest, sum(size) over (partition by k.source order by sample_key range between unbounded preceding and current row) upto,
    sum(size) over (partition by k.source, sample_key) own
  from keyed k join parts p on k.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(size * (epochs + case when upto - own / 2e0 <= rest then 1 else 0 end) as bigint) taken from run
"""

_TOP = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(place as int) "rank", vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) place from s) t where place <= 5
"""


def _urls() -> str:
    """The template tree level by level; numbers are the defaults of urls."""
    fits = " ".join(f"when (host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '/{p}') then '{h}/{p}'" for h, p in (("example.net", "en/"), ("example.com", "de/"), ("org", "fr/"), ("net", "")))
    seg, rest = [f"s{k}" for k in range(4)], "host, shape, n, labelled, bad"
    parts = [
        "u as (select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages)",
        "hp as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u)",
        f"ru as (select *, case {fits} end rule, list_transform(list_filter(str_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '*' || regexp_extract(x, '(\\.[A-Za-z]+)\\z', 1) else x end) segs from hp)",
        "sh as (select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end decided, case when len(segs) > 4 then list_append(segs[1:3], '**') else segs end shape from ru)",
        f"t0 as (select host, shape, count(*) n, count(decided) labelled, count(case when decided = 'block' then 1 end) bad, {', '.join(f"coalesce(shape[{k + 1}], '') s{k}" for k in range(4))} from sh group by host, shape)",
    ]
    for k in range(4):
        node, others = ", ".join(["host", *seg[:k]]), ", ".join(x for x in seg if x != seg[k])
        parts += [
            f"c{k} as (select {node}, s{k}, sum(n) own from t{k} group by {node}, s{k})",
            f"w{k} as (select {node}, count(*) children, sum(own) total from c{k} group by {node})",
            f"t{k + 1} as (select {rest}, {others}, case when children > 24 and own * 24 < total and s{k} not in ('', '**') then '*' else s{k} end s{k} from t{k} join c{k} using ({node}, s{k}) join w{k} using ({node}))",
        ]
    every = ", ".join(seg)
    parts += [f"m4 as (select host, {every}, {', '.join(f's{k} t{k}' for k in range(4))}, sum(n) n, sum(labelled) labelled, sum(bad) bad from t4 group by host, {every})"]
    for k in reversed(range(3)):
        node, below, last = ", ".join(["host", *seg[:k]]), ", ".join(seg[k + 1 :]), "m4" if k == 2 else f"m{k + 1}"
        others = ", ".join(x for x in seg if x != seg[k])
        parts += [
            f"c_{k} as (select {node}, s{k}, {below}, sum(n) n from {last} where s{k} <> '' group by {node}, s{k}, {below})",
            f"e{k} as (select *, first_value(concat_ws('/', {below})) over (partition by {node}, s{k} order by n desc, {below}) kind from c_{k})",
            f"p{k} as (select {node}, kind, {below}, sum(n) p from e{k} group by {node}, kind, {below})",
            f"a{k} as (select {node}, kind, sum(p) w, count(*) - 1 free from p{k} group by {node}, kind having bool_or(s{k + 1} <> ''))",
            f"d{k} as (select {node}, kind, s{k}, sum(n) m, sum(n * ln(n / cast(p as double))) lg from e{k} join p{k} using ({node}, kind, {below}) group by {node}, kind, s{k})",
            f"l{k} as (select {node}, s{k}, case when sum(labelled) > 0 then cast((sum(bad) + 8e-1) / (sum(labelled) + 4e0) >= 5e-1 as int) end side from {last} group by {node}, s{k})",
            f"i{k} as (select {node}, kind, s{k}, side from d{k} join a{k} using ({node}, kind) join l{k} using ({node}, s{k}) where round(2 * (lg + m * ln(w / cast(m as double))), 6) <= free + 3 * sqrt(2e0 * free) + 4e-2 * m)",
            f"o{k} as (select {node}, kind, s{k}, coalesce(side, case when min(side) over g = max(side) over g then min(side) over g end, -1) side from i{k} window g as (partition by {node}, kind))",
            f"n{k} as (select {node}, s{k}, string_agg(s{k}, '|') over (partition by {node}, kind, side order by s{k} rows between unbounded preceding and unbounded following) name from o{k})",
            f"m{k} as (select host, {others}, coalesce(name, s{k}) s{k}, t0, t1, t2, t3, n, labelled, bad from {last} left join n{k} using ({node}, s{k}))",
        ]
    parts += [
        f"total as (select host, {every}, (sum(bad) + 8e-1) / (sum(labelled) + 4e0) bad_share from m0 group by host, {every})",
        f"judged as (select host, t0, t1, t2, t3, '/' || array_to_string(list_filter([{every}], lambda x: x <> ''), '/') template, bad_share from m0 join total using (host, {every}))",
        "found as (select t4.host, shape, template, bad_share from t4 join judged j on t4.host = j.host and s0 = t0 and s1 = t1 and s2 = t2 and s3 = t3)",
    ]
    return f"with {', '.join(parts)} select page_id, host, coalesce(path, '') path, rule, coalesce(decided, case when bad_share >= 5e-1 then 'block' else 'allow' end) verdict, template, bad_share from sh join found using (host, shape)"


def oracle_sql() -> dict[str, str]:
    """Only what SQL says without models, vocabularies or hashed n-grams; tests compare the others with plain versions."""
    return {"op4_mix_sources": _MIX, "op8_url_filters": _urls(), "op9_exact_topk": _TOP}
