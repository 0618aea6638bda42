"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    out = archive_pages(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order import materialise_order

    return materialise_order(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score_texts

    return score_texts(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontamination

    out = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_cache import TokenCache, Tokenizer, count_tokens

    scratch = Scratch(spark, "op11")
    return count_tokens(table(spark, sf_dir, "documents"), TokenCache(spark, scratch.path("cache")), Tokenizer(public_tokenizers.path("piece_bpe_32k.model")), scratch)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")), Scratch(spark, "op12"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_warc, op2_training_order, op3_brown_classes, op4_secret_forest, op5_jaccard_join, op6_language_id, op7_url_rules, op8_quality_rules, op9_decontamination, op10_source_mix, op11_token_cache, op12_conversation_repair, op13_source_divergence]
    return {f.__name__: f for f in made}


ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by 1 having count(*) > 1)
select p.page_id, p.payload_bytes, p.payload_digest, case when p.page_id < g.first then 'revisit' else 'response' end as record_type,
       case when p.page_id < g.first then g.first end as refers_to
from p left join g on p.payload_digest = g.payload_digest and p.payload_bytes >= 1000
"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = r"[^\x20\x09-\x0D]+"

ORACLE["op5_jaccard_join"] = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACES}') as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as low from n union select u.b, r.low from r join u on u.a = r.node where r.low < u.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.low, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select node, min(low) as low from r group by 1) m on m.node = d.doc_id
"""

#: (feature, value, guard, fence below too) of the thresholds, as in quality.FEATURES.
_F = (("word_length", "word_chars * 100 // n_words", 100), ("symbols", "n_symbols * 1000 // n_words", 50), ("dup_lines", "n_dup_lines * 1000 // n_lines", 150), ("repeats", "n_repeat_words * 1000 // n_words", 150))

ORACLE["op8_quality_rules"] = f"""
with d as (select row_number() over () as id, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{SPACES}') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{SPACES}')) as ls from d),
g as (select id, i, array_to_string(ws[i:i + 2], ' ') as gram from (select id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
k as (select id, i from (select *, count(*) over (partition by id, gram) as c from g) where c > 1),
h as (select id, count(distinct i + o) as n from k, (values (0), (1), (2)) v(o) group by id),
c as (select w.id, doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
      len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(h.n, 0) as n_repeat_words from w left join h using (id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
f as (select id, lang, source, unnest([{', '.join(f"struct_pack(feature := '{k}', v := {v})" for k, v, _ in _F)}], recursive := true) from b where not base_failed),
q as (select lang, source, feature, case when v < 64 then v else (length(bin(v)) - 7) * 32 + (v >> (length(bin(v)) - 6)) + 32 end as bucket from f),
l as (select 'group' as level, lang, source, feature, bucket, count(*) as n from q group by all
      union all select 'lang', lang, null, feature, bucket, count(*) from q group by all union all select 'all', null, null, feature, bucket, count(*) from q group by all),
o as (select *, sum(n) over (partition by level, lang, source, feature) as total, sum(n) over (partition by level, lang, source, feature order by bucket) as upto,
      case when bucket < 64 then bucket else ((bucket - ((bucket - 32) // 32) * 32 + 1) << ((bucket - 32) // 32)) - 1 end as top from l),
a as (select level, lang, source, feature, max(total) as total, min(case when upto * 4 >= total then top end) as q1, min(case when upto * 4 >= total * 3 then top end) as q3 from o group by all),
x as (select z.lang, z.source, e.feature, case when g.total >= 200 then g.q1 when m.total >= 200 then m.q1 else e.q1 end as q1, case when g.total >= 200 then g.q3 when m.total >= 200 then m.q3 else e.q3 end as q3
      from (select distinct lang, source from q) z join a e on e.level = 'all'
      left join a m on m.level = 'lang' and m.lang is not distinct from z.lang and m.feature = e.feature
      left join a g on g.level = 'group' and g.lang is not distinct from z.lang and g.source is not distinct from z.source and g.feature = e.feature),
y as (select lang, source, {', '.join(f"max(case when feature = '{k}' then q3 + 3 * (q3 - q1) + {guard} end) as {k}_high" for k, _, guard in _F)},
      max(case when feature = 'word_length' then q1 - 3 * (q3 - q1) - 100 end) as word_length_low from x group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(not base_failed and {' and '.join(f"{v.replace('n_words', 'nullif(n_words, 0)').replace('// n_lines', '// nullif(n_lines, 0)')} <= {k}_high" for k, v, _ in _F)} and word_chars * 100 // nullif(n_words, 0) >= word_length_low, false) as kept
from b left join y on y.lang is not distinct from b.lang and y.source is not distinct from b.source
"""

LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op9_decontamination"] = f"""
with i as (select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') as ws from benchmark),
v as (select distinct item, least(len(ws), 10) as n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') as win from (select item, ws, unnest(range(1, greatest(2, len(ws) - 8))) as k from i where len(ws) > 0)),
d as (select row_number() over () as id, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') as ws from documents),
m as (select distinct n from v),
g as (select id, k, n, array_to_string(ws[k:k + n - 1], ' ') as win from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, m where len(ws) >= n)),
f as (select g.id, g.k, v.n, v.item from g join v on v.win = g.win and v.n = g.n),
h as (select id, count(distinct p) as n from (select id, unnest(range(k, k + n)) as p from (select distinct id, k, n from f)) group by id),
t as (select id, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct id, item from f) group by id)
select doc_id, len(ws) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items, sha256(coalesce(t.names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join h using (id) left join t using (id)
"""

ORACLE["op12_conversation_repair"] = """
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: unicode(x)::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 20 as kind from k),
r as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy from h where kind <> 0),
o as (select *, dense_rank() over (order by conv_id nulls first) as c, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as pos, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
        substring(role, 1, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from r),
f as (select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault,
        lag(initial) over (partition by c order by pos) || initial as two from o),
facts as (select c, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
        count_if(fault = 'truncated') as truncated, count_if(two not in ('su', 'ua', 'au')) as illegal, max(pos) as n from f group by c),
states(state, fits, leads) as (values (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moved as (select state, 0 as n, state as goes from states union all select state, 1, leads from states union all select a.state, 2, b.leads from states a join states b on b.state = a.leads),
t as (select c, pos, n, goes, state, edit.letter, edit.price + 3 * n as price, edit.goal, repeat('I', n) || edit.letter as block
      from (select c, pos, m.state, m.n, m.goes, unnest([struct_pack(letter := 'D', price := 4, goal := goes),
        struct_pack(letter := 'K', price := case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 3 else 0 end, goal := case when initial = 's' and goes = 0 then 1 when initial = 'u' and goes in (0, 1, 3) then 2 when initial = 'a' and goes = 2 then 3 else 9 end),
        struct_pack(letter := 'R', price := case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 6 else 3 end, goal := case when goes = 2 then 3 else 2 end)]) as edit from f, moved m)
      where edit.goal < 9 and edit.price < 1000000),
dp as (select c, 0::bigint as pos, 0 as state, struct_pack(cost := 0, audit := '') as best from facts
       union all
       select dp.c, dp.pos + 1, t.goal, min(struct_pack(cost := dp.best.cost + t.price, audit := dp.best.audit || t.block)) from dp join t on t.c = dp.c and t.pos = dp.pos + 1 and t.state = dp.state group by dp.c, dp.pos + 1, t.goal),
done as (select dp.c, min(struct_pack(cost := dp.best.cost + 3 * m.n, audit := dp.best.audit || repeat('I', m.n))) as best
         from dp join facts on facts.c = dp.c and facts.n = dp.pos join moved m on m.state = dp.state and m.goes in (0, 3) group by dp.c),
letters as (select c, unnest(string_split(best.audit, '')) as letter, generate_subscripts(string_split(best.audit, ''), 1) as idx from done where best.audit <> ''),
placed as (select *, count_if(letter <> 'I') over (partition by c order by idx) as pos, count_if(letter <> 'D') over (partition by c order by idx) as e from letters),
emitted as (select p.c, p.idx, p.letter, p.e, case when p.letter <> 'I' then f.initial end as initial, case when p.letter <> 'I' then f.role end as role, case when p.letter = 'I' then '' else f.text end as text
            from placed p left join f on f.c = p.c and f.pos = p.pos where p.letter <> 'D'),
opened as (select *, max(case when e = 1 and letter = 'K' and initial = 's' then 1 else 0 end) over (partition by c) as shift from emitted),
mended as (select c, sha256(string_agg(case when letter = 'K' then role when (e - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by idx)) as repaired_sha256 from opened group by c)
select q.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) q left join (select distinct conv_id, c from o) i on i.conv_id is not distinct from q.conv_id
left join facts using (c) left join done using (c) left join mended using (c)
"""

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op13_source_divergence"] = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERMS}') as ws from documents),
c as (select lang, source, term, count(*)::hugeint as n, count(distinct id) as docs from (select id, lang, source, unnest(ws) as term from d) group by all),
k as (select lang, term, sum(n) as total from c group by all having sum(docs) >= 3),
v as (select lang, count(*) as v, sum(total) as size from k group by lang),
g as (select distinct lang, source from d),
s as (select c.lang, c.source, sum(n) as size from c join k using (lang, term) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.size, 0) + v.v) as p, 1 + 1000000000 * (k.total + 1) // (v.size + v.v) as q
      from g join k using (lang) join v using (lang) left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
y as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(y.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join y on y.lang = a.lang and y.source = a.source and y.item = b.source
      union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
z as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from x)
select lang, source, part, item, value::bigint as value, rank::int as rank from z where part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
