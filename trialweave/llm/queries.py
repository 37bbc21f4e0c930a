"""Queries over the given tables, one for each operator, and SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm.common import table
from trialweave.llm.convtrie import HUNDRED, SHARED, prefix_trie
from trialweave.llm.embdedup import LEAST, embedding_near_duplicates
from trialweave.llm.fingerprints import fingerprints
from trialweave.llm.langid import language_id
from trialweave.llm.lexsearch import FLAT, SATURATION, SLOPE, TOP, ranked_search
from trialweave.llm.license_rules import rules
from trialweave.llm.licenses import license_scan
from trialweave.llm.linededup import line_dedup
from trialweave.llm.lm import lm_scores
from trialweave.llm.mixing import BLOCKS_PER_SHARD, SHARDS, mix_report
from trialweave.llm.neardup import near_duplicates
from trialweave.llm.packing import pack
from trialweave.llm.quality import quality_rules
from trialweave.llm.urlfilter import host_of, url_filter


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    """The same rules over words that each have a space of their own on both sides, and suppression by comparing every two detections."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    own = lambda x: x.removeprefix("(?<= )").removesuffix("(?= )").replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    rows = ",\n".join(f"({r.rule}, {quoted(r.label)}, {quoted(r.kind)}, {[f' {g} ' for g in r.gate.split('|')]}, {quoted(f' {own(r.pattern)} ')}, {r.priority}, {r.weight}::double)" for r in rules())
    return rf"""
with rules(rule, label, kind, gates, pattern, priority, weight) as (values {rows}),
w as (
  select doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as words from documents),
n as (select doc_id, case when words = '' then 0 else len(words) - len(replace(words, ' ', '')) + 1 end as n_words, ' ' || words || ' ' as gated, ' ' || replace(words, ' ', '  ') || ' ' as framed from w),
g as (
  select doc_id, framed, rules.* from n join rules on contains(gated, gates[1]) or contains(gated, coalesce(gates[2], gates[1]))),
m as (select doc_id, rule, label, kind, priority, weight, regexp_extract_all(framed, pattern) as hits, string_split_regex(framed, pattern) as gaps from g),
k as (
  select doc_id, rule, label, kind, priority, weight, unnest(range(1, len(hits) + 1)) as k,
    list_transform(hits, lambda x: len(string_split(trim(regexp_replace(x, ' +', ' ', 'g')), ' '))) as hit, list_transform(gaps, lambda x: case when trim(x) = '' then 0 else len(string_split(trim(regexp_replace(x, ' +', ' ', 'g')), ' ')) end) as gap
  from m where len(hits) > 0),
f as (select *, list_sum(hit[1:k]) + list_sum(gap[1:k]) as stop, list_sum(hit[1:k]) + list_sum(gap[1:k]) - hit[k] as start from k),
d as (
  select *, exists(select 1 from f o where o.doc_id is not distinct from f.doc_id and o.start <= f.start and o.stop >= f.stop and o.priority >= f.priority
    and (o.start < f.start or o.stop > f.stop or o.priority > f.priority or o.rule < f.rule)) as gone
  from f),
s as (
  select doc_id, count(*) filter (kind = 'base') as n_base, min(start) filter (kind = 'base')::bigint as first_word, max(start) filter (kind = 'base')::bigint as last_word,
    array_to_string(list_sort(list(distinct label) filter (kind = 'base')), ',') as base_labels, array_to_string(list_sort(list(distinct label) filter (kind = 'base' or not gone)), ',') as labels,
    max(weight) filter (not gone) as score, count(*) as n_detections, count(*) filter (gone) as n_suppressed
  from d group by doc_id)
select n.doc_id, n_words::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score,
  coalesce(n_detections, 0) as n_detections, coalesce(n_suppressed, 0) as n_suppressed
from n left join s on s.doc_id is not distinct from n.doc_id
"""


OP1_SQL = _op1_sql()


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by their exact sets; components by the smallest id reached.
OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 75 * (na.n + nb.n - shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reached) as (select doc_id, doc_id from w union select r.doc_id, e.b from r join e on e.a = r.reached)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.reached) as component_id, min(r.reached) = w.doc_id as kept
from w left join n using (doc_id) join r on r.doc_id = w.doc_id group by w.doc_id
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _digest(text: Column) -> Column:
    """A number below 2^24 from a text's MD5, as SQL can compute it too."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def _day(number: Column) -> Column:
    return F.timestamp_add("DAY", number, F.lit("2024-01-01").cast("timestamp"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of ``pages``, by digests of their names: the tables have no lists."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("x", _digest(F.col("host")))
    x = F.col("x")

    def entry(held: Column, name: str, action: str, key: Column, op: str, day: Column) -> Column:
        return F.when(held, F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), key.alias("key"), F.lit(op).alias("op"), _day(day).alias("dated")))

    domain = F.substring_index("host", ".", -2)
    of = lambda prime: x % prime == 0
    first = x % 300
    made = F.array(
        entry(of(2), "adult", "block", F.col("host"), "add", first),
        entry(of(2) & (x % 3 > 0), "adult", "block", F.col("host"), "remove", first + 60 + x % 200),
        entry(of(2) & (x % 5 > 1), "adult", "block", F.col("host"), "add", first + 300 + x % 90),
        entry(x % 3 == 1, "spam", "block", F.concat("host", F.lit("/de/")), "add", first + 40),
        entry(x % 3 == 1, "trusted", "allow", F.concat("host", F.lit("/en/")), "add", first + 20),
        entry(x % 6 == 1, "trusted", "allow", F.concat("host", F.lit("/en/")), "remove", first + 220),
        entry(of(7), "registry", "block", domain, "add", F.lit(600)),
        entry(of(7), "registry", "block", domain, "remove", F.lit(650)),
    )
    return hosts.select(F.explode(made).alias("e")).where("e is not null").select("e.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against dated lists; fetch times are derived from the URLs, for the table has none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = F.col("page_id") % 86400
    fetched = F.timestamp_add("SECOND", seconds.cast("int"), _day(_digest(F.coalesce("url", F.lit(""))) % 730))
    found = url_filter(pages.withColumn("fetched_at", fetched), derived_entries(pages))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("page_id", "url", shown("fetched_at"), "verdict", "key", "list", shown("valid_from"), shown("valid_to"))


#: The same by an as-of join: one candidate key at a time, its last turn before the fetch.
OP5_SQL = r"""
with p as (
  select page_id, url, ('0x' || substr(md5(coalesce(url, '')), 1, 6))::int % 730 as d,
    regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)', 1), '\.+$', '') as host,
    regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
c as (select *, timestamp '2024-01-01' + to_days(d) + to_seconds(page_id % 86400) as f from p),
h as (select distinct host, ('0x' || substr(md5(host), 1, 6))::int as x from p where host <> ''),
e(list, action, key, adds, day) as (
  select 'adult', 'block', host, 1, x % 300 from h where x % 2 = 0 union all
  select 'adult', 'block', host, 0, x % 300 + 60 + x % 200 from h where x % 2 = 0 and x % 3 > 0 union all
  select 'adult', 'block', host, 1, x % 300 + 300 + x % 90 from h where x % 2 = 0 and x % 5 > 1 union all
  select 'spam', 'block', host || '/de/', 1, x % 300 + 40 from h where x % 3 = 1 union all
  select 'trusted', 'allow', host || '/en/', 1, x % 300 + 20 from h where x % 3 = 1 union all
  select 'trusted', 'allow', host || '/en/', 0, x % 300 + 220 from h where x % 6 = 1 union all
  select 'registry', 'block', array_to_string(string_split(host, '.')[-2:], '.'), 1, 600 from h where x % 7 = 0 union all
  select 'registry', 'block', array_to_string(string_split(host, '.')[-2:], '.'), 0, 650 from h where x % 7 = 0),
turns as (
  select *, timestamp '2024-01-01' + to_days(day::int) as t from (
    select *, coalesce(lag(adds) over w, 0) as was from (select distinct * from e)
    window w as (partition by list, action, key order by day, adds)) where adds <> was),
spans as (select *, lead(t) over (partition by list, action, key order by t, adds) as t2 from turns),
k as (
  select distinct page_id, url, f, lower(key) as key from (
    select page_id, url, f, unnest(list_concat(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1), lambda i: host || array_to_string(string_split(path, '/')[:i], '/') || '/'),
      [host || path])) as key
    from c where host <> '')),
lists as (select distinct list, action, key from spans),
hit as (
  select q.page_id, q.url, q.f, s.* from (select k.*, l.list, l.action from k join lists l using (key)) q
  asof join spans s on q.key = s.key and q.list = s.list and q.action = s.action and q.f >= s.t where s.adds = 1),
best as (
  select * from (select *, row_number() over (partition by page_id, url, f order by length(key) desc, action, list, t) as r from hit) where r = 1)
select c.page_id, c.url, strftime(c.f, '%Y-%m-%d %H:%M:%S') as fetched_at,
  case when c.host = '' then 'invalid' else coalesce(b.action, 'keep') end as verdict, b.key, b.list,
  strftime(b.t, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(b.t2, '%Y-%m-%d %H:%M:%S') as valid_to
from c left join best b on c.page_id is not distinct from b.page_id and c.url is not distinct from b.url and c.f is not distinct from b.f
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The same line by line; chunks are compared by their texts alone.
OP6_SQL = r"""
with l as (
  select doc_id, line, i, len(lines) as n, ('0x' || substr(md5(line), 1, 7))::bigint as h
  from (select doc_id, lines, unnest(lines) as line, unnest(range(0, len(lines))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
c as (
  select *, ((h + b * coalesce(lag(h) over w, 0)) % 2147483647) % 2 = 0 as candidate from l cross join (select unnest([1000003, 40692011, 715225739]) as b)
  window w as (partition by b, doc_id order by i)),
e as (select *, candidate and not coalesce(lag(candidate) over w, false) and not (b = 1000003 and i in (0, n - 2)) as ends from c window w as (partition by b, doc_id order by i)),
k as (select *, coalesce(sum(ends::int) over (partition by b, doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
f as (select *, (i - min(i) over (partition by b, doc_id, k)) // 32 as part from k),
ranges as (
  select distinct doc_id, first, n_lines, chunk from (
    select doc_id, min(i) as first, count(*) as n_lines, string_agg(line, chr(10) order by i) as chunk from f group by b, doc_id, k, part)
  where n_lines > 1),
marked as (
  select *, regexp_matches(chunk, '[^ 	-
]') and row_number() over (partition by chunk order by doc_id, first, n_lines) > 1 as gone from ranges),
sums as (select doc_id, count(*) as n_chunks, count(*) filter (gone) as n_removed_chunks from marked group by doc_id),
lost as (select distinct doc_id, unnest(range(first, first + n_lines)) as i from marked where gone)
select l.doc_id, count(*) as n_lines, coalesce(any_value(s.n_chunks), 0) as n_chunks, coalesce(any_value(s.n_removed_chunks), 0) as n_removed_chunks, count(x.i) as n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) order by l.i) filter (x.i is null), '')) as text_sha256
from l left join lost x on x.doc_id = l.doc_id and x.i = l.i left join sums s on s.doc_id = l.doc_id group by l.doc_id
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    """Running totals over each source's permuted documents, and the splitting tree, a node's half at a time."""
    digest = "('0x' || substr(md5('17:' || {0}), 1, 15))::bigint"
    levels, left = "", int(log2(SHARDS))
    for k in range(left):
        levels += f"""
n{k} as (
  select rank, node, unnest(range(1, blocks + 1)) as block from {f"m{k - 1}" if k else "m"}),
h{k} as (
  select rank, node, row_number() over (partition by node order by {digest.format("node || ':' || rank || ':' || block")}, rank, block) > count(*) over (partition by node) // 2 as goes_right from n{k}),
m{k} as (select rank, 2 * node + goes_right::int as node, count(*) as blocks from h{k} group by all),"""
    return rf"""
with d as (
  select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    {digest.format("coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))")} as place
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
r as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as ratio from s),
l as (
  select *, (1.5::double * sum(source_size) over () - (sum(cap) over (order by ratio, rank) - cap)) / (sum(w) over () - (sum(w) over (order by ratio, rank) - w)) as level
  from r),
t as (
  select source, rank, source_size, least(cap, coalesce((select min_by(level, ratio) from l where level <= ratio), 'inf'::double) * w) as target from l),
b as (select *, floor(target)::bigint as quota, greatest(1, ceil((sum(floor(target)) over ())::double / {SHARDS * BLOCKS_PER_SHARD}))::bigint as block_words from t),
m as (select rank, 1::bigint as node, ceil(quota::double / block_words)::bigint as blocks from b),{levels}
o as (
  select rank, node - {SHARDS} as shard, unnest(range(coalesce(sum(blocks) over w, 0)::bigint, (coalesce(sum(blocks) over w, 0) + blocks)::bigint)) as block
  from m{left - 1} window w as (partition by rank order by node rows between unbounded preceding and 1 preceding)),
p as (
  select d.*, b.rank, b.source_size, b.target, quota, block_words, coalesce(sum(d.size) over (partition by d.source order by d.place, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join b on d.source is not distinct from b.source),
q as (
  select *, greatest(least(quota - start, size), 0)::bigint as w0, greatest(least(quota - start - source_size, size), 0)::bigint as w1, start // block_words as b0, (start + source_size) // block_words as b1 from p)
select doc_id, size::bigint as size, source_size, target, w0 + w1 as taken,
  concat_ws(' ', case when w0 > 0 then x.shard || '/' || b0 || '/' || w0 end, case when w1 > 0 then y.shard || '/' || b1 || '/' || w1 end) as drawn
from q left join o x on x.rank = q.rank and x.block = b0 left join o y on y.rank = q.rank and y.block = b1
"""


OP2_SQL = _op2_sql()


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
with recursive
v as (
  select vec_id, label, len(embedding) as n, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as size from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.n = b.n and a.vec_id <> b.vec_id and a.size > 0 and b.size > 0
  where list_dot_product(a.e, b.e) / (a.size * b.size) >= {LEAST}::double),
r as (select a as one, b as other from l union select r.one, l.b from r join l on r.other = l.a),
n as (select a, count(*) as n_links from l group by a),
c as (select one, least(one, min(other)) as lowest from r group by one)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(lowest, vec_id) as component_id, coalesce(vec_id = coalesce(lowest, vec_id), true) as kept, 1.0::double as recall
from embeddings left join n on a = vec_id left join c on one = vec_id
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
i as (
  select row_number() over () as item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from benchmark),
n as (select count(*) filter (len(words) > 0) as documents, sum(len(words))::bigint as total from d),
q as (select item, item_id, word, count(*) as times from (select item, item_id, unnest(words) as word from i) group by all),
p as (select row, doc_id, n, word, count(*) as tf from (select row, doc_id, len(words) as n, unnest(words) as word from d) where word in (select word from q) group by all),
w as (select word, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from p cross join n group by word, documents),
s as (
  select item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + {SATURATION} * ({FLAT} + ({SLOPE} * n * documents) // total))))::bigint as score
  from q join p using (word) join w using (word) cross join n group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item order by score desc, doc_id) as rank from s where score > 0) where rank <= {TOP}
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# The checksum goes bit by bit over the bytes of the id, each followed by eight marks for its bits.
OP13_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(role := role, text := text) order by place) as own from t group by conv_id),
h as (
  select conv_id, own, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(conv_id::varchar) + 1), lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda sum, x: case when x >= 0 then xor(sum, x) when sum & 1 = 1 then xor(sum >> 1, 3988292384::bigint) else sum >> 1 end), 4294967295::bigint) % {SHARED} as h
  from c),
s as (
  select h.conv_id, list_concat(coalesce(o.own, [])[1:h], h.own[h + 1:]) as turns from h left join c o on o.conv_id = h.conv_id - h.conv_id % {HUNDRED}),
p as (select conv_id, len(turns) as n, unnest(range(0, len(turns) + 1)) as depth, turns from s),
m as (select conv_id, n, depth, turns[1:depth]::varchar as key, turns[1:depth - 1]::varchar as up, coalesce(len(turns[depth].text), 0) as size from p),
g as (
  select key, depth, any_value(case when depth > 0 then up end) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256
  from m group by key, depth),
k as (select up, depth - 1 as depth, count(*) as n_children from g where depth > 0 group by all),
f as (select g.*, coalesce(n_children, 0) as n_children from g left join k on k.up = g.key and k.depth = g.depth),
b as (select distinct a.key, a.depth, f.key as below, f.depth as deeper, n_children, (f.n_convs - 1) * f.size as saved from m a join m d on a.conv_id = d.conv_id and a.depth <= d.depth join f on f.key = d.key and f.depth = d.depth),
x as (select key, depth, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from b group by all)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, x.n_leaves, x.saved_tokens, f.ends_sha256
from f join x using (key, depth) left join f u on u.key = f.up and u.depth = f.depth - 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_lm_scores": op8_lm_scores,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_near_duplicates": op11_embedding_near_duplicates,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op2_source_mix": OP2_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_embedding_near_duplicates": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
