"""The queries of this subpackage, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    backoff_lm, byte_bpe, dart_minhash, exact_dedup, fim_rope, language_id, license_scan, line_quality, merkle_manifest, packing, ring_shard, token_store, toxicity,
)
from .shared import documents, new_dir, until_exit

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_quality.line_quality(docs, text_out=False).drop("text")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), path, WORD_TOKENIZER)
    until_exit(spark, path)
    return token_store.read_tokens(spark, path, ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), BYTE_TOKENIZER, ids=False)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(documents(spark, sf_dir))


def op7_ring_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = ring_shard.ring_shards(docs, 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.backoff_scores(documents(spark, sf_dir), order=3)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return license_scan.license_scan(docs).drop("text", "spans")


def op11_fim_rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_rope.round_trip(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).drop("text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audited(documents(spark, sf_dir))


# The SQL of the operators that SQL can express, for DuckDB. WORDS are runs of other than ASCII white space.
WORDS = "'[^\\x20\\x09-\\x0D]+'"

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from
documents)
select doc_id, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id, count(*) over (partition by h) as group_size,
doc_id = first_value(doc_id) over (partition by h order by n desc, doc_id) as kept, h as text_sha256 from d
""",
    "op2_line_quality": rf"""
with d as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, text, regexp_extract_all(text, {WORDS}) as words,
string_split(text, chr(10)) as lines from d),
p as (select doc_id, unnest(range(1, len(words) - 3)) as i, words from w), g as (select doc_id, i, array_to_string(words[i : i + 4], ' ') as
gram from p),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1), c as (select doc_id, count(distinct j) as n from
(select doc_id, unnest(range(i, i + 5)) as j from r) group by 1),
l as (select doc_id, unnest(lines) as line from w), lw as (select doc_id, line, regexp_extract_all(line, {WORDS}) as words from l),
q as (select doc_id, line, words, len(words) as n, len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]{{3}}') or (length(x) >= 2
and ends_with(x, '!!')))) as marks, len(list_filter(words, lambda x: x = '|')) as bars,
 len(list_filter([{", ".join(f"'{x}'" for x in line_quality.BOILERPLATE)}], lambda x: contains(lower(line), x))) > 0 as boiler from lw where
len(words) > 0),
f as (select doc_id, n, 100 * marks > 30 * n or (bars >= 2 and 100 * bars > 15 * n) or (boiler and n <= 30) or (n <= 20 and not
regexp_matches(words[n], '[.!?:;"'')\]\x{{2026}}\x{{201D}}\x{{2019}}\x{{BB}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]$')) as fails from q),
e as (select doc_id, count(*) filter (fails) as n_lost_lines, coalesce(sum(n) filter (fails), 0) as n_lost_words from f group by 1), u as
(select doc_id, count(*) - count(distinct line) as n from q group by 1),
m as (select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars, length(text) -
length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(u.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
 coalesce(n_lost_lines, 0) as n_lost_lines, cast(coalesce(n_lost_words, 0) as bigint) as n_lost_words from w left join c using (doc_id) left
join u using (doc_id) left join e using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_lines, n_lost_words,
base_failed, not base_failed and 100 * n_lost_words <= 40 * n_words as kept from b
""",
    "op9_backoff_lm": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as words from documents), t as (select doc_id, unnest(words) as x,
generate_subscripts(words, 1) as i, words from w),
b as (select doc_id, i, x, case when i > 1 then words[i - 1] end as p, case when i > 2 then words[i - 2] end as q from t), n as (select
sum(len(words)) as n from w), k as (select doc_id, len(words) as n_words from w),
c1 as (select x, count(*) as c from b group by 1), d1 as (select doc_id, x, count(*) as c from b group by 1, 2), c2 as (select p, x,
count(*) as c from b where p is not null group by 1, 2), d2 as (select doc_id, p, x, count(*) as c from b where p is not null group by 1, 2,
3),
c3 as (select q, p, x, count(*) as c from b where q is not null group by 1, 2, 3), d3 as (select doc_id, q, p, x, count(*) as c from b where
q is not null group by 1, 2, 3, 4),
r1 as (select doc_id, x, c1.c - d1.c as r from d1 join c1 using (x)), r2 as (select doc_id, p, x, c2.c - d2.c as r from d2 join c2 using (p,
x)), r3 as (select doc_id, q, p, x, c3.c - d3.c as r from d3 join c3 using (q, p, x)),
s as (select b.doc_id, b.i, r1.r as a1, rp.r as a0, r2.r as b1, rq.r as b0, r3.r as e1, greatest(n.n - k.n_words, 1)::double as rest from b
cross join n join k on b.doc_id = k.doc_id join r1 on b.doc_id = r1.doc_id and b.x = r1.x left join r1 rp on b.doc_id = rp.doc_id and b.p =
rp.x
 left join r2 on b.doc_id = r2.doc_id and b.p = r2.p and b.x = r2.x left join r2 rq on b.doc_id = rq.doc_id and b.q = rq.p and b.p = rq.x
left join r3 on b.doc_id = r3.doc_id and b.q = r3.q and b.p = r3.p and b.x = r3.x),
l as (select *, greatest(a1, 1) / rest as one, case when i > 1 and b1 > 0 then b1::double / a0 end as two, case when i > 2 and e1 > 0 then
e1::double / b0 end as three from s),
v as (select doc_id, three is not null as longest, log10(case when three is not null then three when i > 2 then 0.4::double * coalesce(two,
0.4::double * one) when i = 2 then coalesce(two, 0.4::double * one) else one end) as y from l)
select k.doc_id, k.n_words, coalesce(sum(longest::int), 0)::bigint as n_full, round(sum(y) / k.n_words, 4) as score from k left join v on
k.doc_id = v.doc_id group by k.doc_id, k.n_words
""",
    "op10_license_scan": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as s, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' and w[i + 1] =
'by') as a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') as b,
 list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved') as c from d),
x as (select doc_id, len(w) as n_words, len(a) + len(b) + len(c) as n_base, list_sort(list_concat(list_concat(a, b), c)) as places,
list_filter([case when len(a) > 0 then 'cc-by' end, case when len(b) > 0 then 'gpl' end, case when len(c) > 0 then 'reserved' end], lambda
v: v is not null) as base,
 list_filter([{license_scan.sql_labels("s")}], lambda v: v is not null) as more from p)
select doc_id, n_words, n_base, places[1] - 1 as first_word, places[len(places)] - 1 as last_word, array_to_string(base, ',') as
base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') as labels, case when len(more) > 0 then 1.0 when
len(base) > 0 then 0.5 else 0.0 end::double as score from x
""",
    "op11_fim_rope": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''),
'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, sha256('42:' || doc_id) as h from documents),
k as (select doc_id, text, units, len(units) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' ||
h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100
< 80 then 'spm' else 'psm' end as form from k),
s as (select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:n], '') as s
from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as
middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m
end) as output_sha256, sha256(text) as restored_sha256 from s
""",
    "op13_merkle_manifest": r"""
with recursive d as (select doc_id, lang, n_chars, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') ||
coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
 coalesce(octet_length(encode(text)) || ':' || text, '-') as tail, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i:
ord(cast(doc_id as varchar)[i])::bigint) as bytes from documents),
e as (select *, coalesce(length(cast(n_chars as varchar)) || ':' || n_chars, '-') as chars, coalesce(length(cast(n_chars + 1 as varchar)) ||
':' || (n_chars + 1), '-') as more,
 xor(list_reduce(bytes, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))),
4294967295::bigint), 4294967295) % 7 = 0 as hit from d),
f as (select doc_id, lang, sha256(head || chars || tail) as leaf, sha256(head || case when hit then more else chars end || tail) as start
from e),
p as (select *, row_number() over (partition by lang order by doc_id) - 1 as place, count(*) over (partition by lang) as n from f),
t(lang, level, i, n, h) as (select lang, 0, place, n, leaf from p union all select lang, level + 1, i // 2, (n + 1) // 2,
sha256(string_agg(h, '' order by i)) from t where n > 1 group by lang, level, i // 2, n),
b as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from t where n = 1),
r(level, i, n, h) as (select 0, place, n, subroot from b union all select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by
i)) from r where n > 1 group by level, i // 2, n),
w(doc_id, lang, tree, level, i, n, g, proof) as (select doc_id, lang, 0, 0, place, n, start, '' from p
 union all select w.doc_id, w.lang, case when w.n = 1 then 1 else w.tree end, case when w.n = 1 then 0 else w.level + 1 end, case when w.n =
1 then b.place else w.i // 2 end, case when w.n = 1 then b.n else (w.n + 1) // 2 end,
  case when w.n = 1 then w.g when w.i % 2 = 1 then sha256(coalesce(s.h, q.h, '') || w.g) else sha256(w.g || coalesce(s.h, q.h, '')) end,
w.proof || case when w.n = 1 then '' else coalesce(s.h, q.h, '') end
 from w join b on b.lang is not distinct from w.lang left join t s on w.tree = 0 and s.lang is not distinct from w.lang and s.level =
w.level and s.i = xor(w.i, 1) and w.n > 1
 left join r q on w.tree = 1 and q.level = w.level and q.i = xor(w.i, 1) and w.n > 1 where w.tree = 0 or w.n > 1)
select w.doc_id, p.leaf, b.subroot, x.h as root, sha256(w.proof) as proof_sha256, w.g as folded_root, w.g = x.h as verified from w join p
using (doc_id) join b on b.lang is not distinct from w.lang cross join (select h from r where n = 1) x where w.tree = 1 and w.n = 1
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
