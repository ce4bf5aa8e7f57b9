"""The registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, mixing, packing, quality, simhash, simple8b, spelling, tiff, transducer, trie, urlfilter, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as read back from the Simple-8b files they were written to."""
    manifest = simple8b.write_ids(table(spark, sf_dir, "documents"))
    return simple8b.read_ids(spark, manifest, with_ids=False)


@query
def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the compiled tokenizer."""
    return transducer.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])


ORACLE["op3_url_filter"] = r"""
with cut as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '') as rest from pages),
hosted as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut),
parts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosted),
rules(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (
  select page_id, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fit using (page_id)
"""


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.payloads(warc.read_archives(spark, manifest, with_data=False))


ORACLE["op10_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
     d as (select page_id, strlen(body) as n, sha256(body) as digest from p),
     f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first < page_id then first end as refers_to
from f
"""


@query
def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF and read back."""
    return tiff.text_media(table(spark, sf_dir, "documents"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of every document in a mixture of 95 % of the sources' largest entropy, at most fourfold."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.Targets(entropy=0.95, repetition=4.0))


#: CRC-32 of a list of byte values, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform({bytes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE["op11_prefix_trie"] = """
with rows as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
  from conversations where conv_id is not null),
ids as (select conv_id, count(*) as n, CRC % 9 as h, conv_id - conv_id % 5 as base from rows group by conv_id),
plan as (select i.conv_id, i.base, i.h, least(i.h, coalesce(b.n, 0)) as taken from ids i left join ids b on b.conv_id = i.base),
turns as (
  select p.conv_id, r.pos, r.role, r.text from plan p join rows r on r.conv_id = p.base and r.pos < p.taken
  union all
  select p.conv_id, r.pos - p.h + p.taken, r.role, r.text from plan p join rows r using (conv_id) where r.pos >= p.h),
paths as (
  select conv_id, pos + 1 as depth, strlen(text) as bytes,
         string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by pos rows unbounded preceding) as path
  from turns union all select conv_id, 0, 0, '' from plan),
sizes as (select conv_id, max(depth) as size from paths group by 1),
found as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, bool_and(size = depth) as leaf,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256
  from paths join sizes using (conv_id) group by path, depth),
below as (
  select a.path, sum(case when n.leaf then 1 else 0 end)::bigint as n_leaves, sum((n.n_convs - 1) * n.bytes)::bigint as saved_tokens,
         sum(case when n.depth = a.depth + 1 then 1 else 0 end)::bigint as n_children
  from found n, unnest(range(0, n.depth + 1)) as up(k) join found a on a.path = substr(n.path, 1, 64 * k) group by a.path)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, n_children, n_leaves, saved_tokens, f.ends_sha256
from found f join below using (path) left join found p on f.depth > 0 and p.path = substr(f.path, 1, 64 * (f.depth - 1))
""".replace("CRC", CRC32_SQL.format(bytes="list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the more frequent spelling that it is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLE["op12_spelling"] = """
with runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
  from documents),
each as (select id, run, count(*) as times, encode(id || ':' || run) as bytes from runs group by id, run),
hashed as (select run, times, CRC as h from each),
words as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(times)::bigint as n
  from hashed group by word),
known as (select word, n, length(word) as size from words where size >= 5 and n >= 3),
cut as (
  select word, n, size, k, substr(word, 1, k - 1) || substr(word, k + 1) as less from known, unnest(range(1, size + 1)) as places(k)),
near as (
  select a.word, b.word as other, b.n from cut a join cut b on a.size = b.size and a.k = b.k and a.less = b.less and a.word <> b.word
  union
  select a.word, b.word, b.n from cut a join known b on a.less = b.word
  union
  select b.word, a.word, a.n from cut a join known b on a.less = b.word),
best as (select word, count(*) as n_near, min(struct_pack(minus := -n, other := other)) as b from near group by word),
forms as (select word, n, coalesce(n_near, 0) as n_near, case when -b.minus >= 2 * n then b.other end as form, case when -b.minus >= 2 * n then -b.minus end as form_n from known left join best using (word)),
chain as (
  with recursive c as (select word, word as spot, 0 as far from forms union all select c.word, f.form, far + 1 from c join forms f on f.word = c.spot where f.form is not null)
  select word, arg_max(spot, far) as root from c group by word)
select word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from forms join chain using (word)
""".replace("CRC", CRC32_SQL.format(bytes="list_transform(range(1, octet_length(bytes) + 1), lambda k: ('0x' || substr(hex(bytes), 2 * k - 1, 2))::bigint)"))


@query
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


# Every given page marks its article, so that its main text can also be cut out by patterns.
ORACLE["op13_main_text"] = r"""
with article as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') as inner_html from pages),
blocks as (
  select page_id, unnest(string_split_regex(inner_html, '</?(?:p|h1)>')) as block, generate_subscripts(string_split_regex(inner_html, '</?(?:p|h1)>'), 1) as place from article),
shown as (select page_id, place, regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g') as block from blocks),
decoded as (
  select page_id, place, replace(replace(replace(replace(replace(replace(block, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp', '&') as block from shown),
lines as (select page_id, place, trim(regexp_replace(block, '\s+', ' ', 'g')) as line from decoded),
texts as (select page_id, string_agg(line, chr(10) order by place) filter (where line <> '') as main from lines group by page_id)
select page_id, url, coalesce(main, '') as text, length(coalesce(main, ''))::bigint as n_chars from article left join texts using (page_id)
"""
