"""The queries that apply the training-data operators to their whole tables, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, language, licenses, mixing, overlap_join, quality, substrings, suffixes, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.fuse(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_mix, op4_license_scan, op5_repeated_words, op6_repeated_bytes, op7_decontaminate, op8_token_files, op9_ngram_join, op10_fingerprints)}


def _mix_sql(weights=(5, 2, 1), block=8, shard_docs=500, seed=17, cap=3) -> str:
    def h(*xs: str) -> str:
        return "('0x' || substr(md5(" + " || ':' || ".join(xs) + "), 1, 12))::BIGINT"

    def words(p: str) -> str:
        return f"({block} * (((({p}) // {block}) * extra + start) // n_blocks) + (({p}) % {block}) * ((((({p}) // {block}) + 1) * extra + start) // n_blocks - ((({p}) // {block}) * extra + start) // n_blocks))"

    def seats(name: str, rows: str, share: str, n: str, order: str, by: str) -> str:
        return f"""
{name}_p as (select *, {n} as n_, sum({share}) over (partition by {by}) as all_, count(*) over (partition by {by}) as rows_ from {rows}),
{name}_b as (select *, coalesce({share}::DOUBLE / nullif(all_, 0)::DOUBLE, 0) as p_ from {name}_p),
{name}_l as (select *, greatest(0, floor(p_ * (n_ - rows_ / 2.0) - 0.5) - 1)::BIGINT as low_, ceil(p_ * (n_ + rows_ / 2.0) + 0.5)::BIGINT + 1 as top_ from {name}_b),
{name}_r as (select *, n_ - sum(low_) over (partition by {by}) as left_ from {name}_l),
{name}_k as (select {by} as by_, {order} as o_, left_, {share}::DOUBLE as s_, unnest(generate_series(low_ + 1, greatest(low_ + 1, top_))) as k_ from {name}_r where p_ > 0),
{name}_w as (select by_, o_, count(*) as won_ from (select *, row_number() over (partition by by_ order by s_ / (2 * k_ - 1) desc, o_) as rank_ from {name}_k) where rank_ <= left_ group by 1, 2),
{name} as (select r.*, case when p_ > 0 then low_ + coalesce(won_, 0) else 0 end as quota from {name}_r r left join {name}_w w on w.by_ = r.{by} and w.o_ = r.{order})"""

    weight = " ".join(f"when {i} then {w}.0" for i, w in enumerate(weights))
    return f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT as size from documents),
by_source as (select source, sum(size)::BIGINT as source_size, count(*) as n_docs from sized group by source),
s1 as (select *, row_number() over (order by source nulls last) as src, 1 as one from by_source),
s2 as (select *, case (src - 1) % {len(weights)} {weight} end::DOUBLE as weight, {cap} * source_size::DOUBLE as cap, (sum(source_size) over ())::DOUBLE as whole from s1),
s3 as (select *, cap / weight as ratio from s2),
s4 as (select *, (whole - coalesce(sum(cap) over (order by ratio, src rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, src rows between current row and unbounded following) as lev, row_number() over (order by ratio, src) as at_ from s3),
s5 as (select *, (select min_by(lev, at_) from s4 where ratio >= lev * (1 - 1e-12)) as level from s4),
s6 as (select src, one, source, source_size, n_docs, coalesce(least(cap, level * weight), cap) as target from s5),
{seats("q1", "s6", "target", f"round((sum(target) over ()) / {block})::BIGINT", "src", "one")},
d1 as (select d.*, q.src, q.source_size, q.target, q.quota as source_quota, {h(f"'{seed}'", "d.doc_id")} as h, greatest(1, ceil(q.n_docs / {shard_docs}.0))::BIGINT as n_shards from sized d join q1 q on d.source is not distinct from q.source),
d2 as (select *, h % n_shards as shard from d1),
g1 as (select src, shard, sum(size)::BIGINT as shard_size, any_value(source_quota) as source_quota from d2 group by 1, 2),
{seats("q2", "g1", "shard_size", "source_quota", "shard", "src")},
g2 as (select src, shard, greatest(1, ceil(shard_size / {block}.0))::BIGINT as n_blocks, least(quota, ceil(shard_size / {block}.0)::BIGINT * {cap}) as quota from q2),
g3 as (select *, quota // n_blocks as passes, quota % n_blocks as extra, {h(f"'{seed}'", "'shard'", "src", "shard")} % n_blocks as start from g2),
d3 as (select d.*, n_blocks, passes, extra, start, (sum(size) over (partition by d.src, d.shard order by h, doc_id, size rows between unbounded preceding and current row))::BIGINT as upto from d2 d join g3 g on g.src = d.src and g.shard = d.shard)
select doc_id, source, size, source_size, target, (passes * size + {words("upto")} - {words("upto - size")})::BIGINT as taken from d3"""


def _license_sql() -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        x = f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[^\\S\\n]*(copyright|\\(c\\)|\\x{{a9}})[^\\n]*$', '', 'g')"
        x = f"' ' || trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) || ' '"
        for old, new in licenses.SPELLINGS.items():
            x = f"replace({x}, ' {old} ', ' {new} ')"
        return f"sha256(trim({x}))"

    known = ", ".join(f"({q(name)}, {q(t)})" for name, texts in licenses.KNOWN.items() for t in texts)
    return f"""
with known as (select {canonical("t")} as dg, min(l) as license from (values {known}) v(l, t) group by 1),
units as (select doc_id, false as whole, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents union all select doc_id, true, coalesce(text, '') from documents),
hits as (select doc_id, whole, license from (select doc_id, whole, {canonical("t")} as dg from units) u left join known using (dg))
select doc_id, count(license) filter (not whole) as n_notices, coalesce(array_to_string(list_sort(list(distinct license) filter (license is not null)), ','), '') as licenses, max(license) filter (whole) as whole_license from hits group by doc_id"""


DECONTAMINATE_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as t from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as t from benchmark),
w as (select distinct item_id, t[i:i + 9] as g from (select item_id, t, unnest(generate_series(1, greatest(1, len(t) - 9))) as i from b where len(t) > 0)),
n as (select distinct len(g) as n from w),
g as (select doc_id, i, n, t[i:i + n - 1] as g from (select doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) as i from d, n where len(t) >= n)),
m as (select doc_id, i, n, item_id from g join w using (g)),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from m) group by 1),
s as (select doc_id, count(distinct item_id) as n_items, sha256(array_to_string(list_sort(list(distinct item_id::VARCHAR)), ',')) as items_sha256 from m group by 1)
select doc_id, len(t) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join s using (doc_id)"""

REPEATED_WORDS_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as t from documents),
g as (select doc_id, i, array_to_string(t[i:i + 34], ' ') as g from (select doc_id, t, unnest(generate_series(1, len(t) - 34)) as i from d where len(t) >= 35)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as n from g) where n > 1),
h as (select doc_id, list(distinct j) as js from (select doc_id, unnest(generate_series(i, i + 34)) as j from r) group by 1),
k as (select d.doc_id, t, coalesce(len(js), 0) as n_removed, js from d left join h using (doc_id)),
w as (select doc_id, string_agg(w, ' ' order by j) as kept from (select k.doc_id, unnest(t) as w, unnest(generate_series(1, len(t))) as j from k) u where not exists (select 1 from (select doc_id, unnest(js) as j from h) x where x.doc_id = u.doc_id and x.j = u.j) group by 1)
select k.doc_id, len(t) as n_words, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from k left join w using (doc_id)"""

NGRAM_JOIN_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as t from documents),
s as (select distinct doc_id, array_to_string(t[i:i + 2], ' ') as g from (select doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 2))) as i from d where len(t) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select doc_id, n, row_number() over (partition by g_hash, n order by doc_id) as r, min(doc_id) over (partition by g_hash, n) as rep from (select doc_id, n, md5(string_agg(g, chr(10) order by g)) as g_hash from s join n using (doc_id) group by 1, 2)),
u as (select s.doc_id, s.g, c.n from s join c using (doc_id) where r = 1),
p as (select a.doc_id as a, b.doc_id as b from u a join u b on a.g = b.g and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
reach as (select doc_id as x, doc_id as y from c where r = 1 union select reach.x, e.b from reach join e on reach.y = e.a),
m as (select x, min(y) as y from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.y, d.doc_id) as component_id from d left join n using (doc_id) left join c using (doc_id) left join m on m.x = c.rep"""

ORACLES = {"op9_ngram_join": NGRAM_JOIN_SQL, "op5_repeated_words": REPEATED_WORDS_SQL, "op7_decontaminate": DECONTAMINATE_SQL, "op3_mix": _mix_sql(), "op4_license_scan": _license_sql()}
