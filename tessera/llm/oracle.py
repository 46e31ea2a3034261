"""DuckDB equivalents of the queries that SQL can express: brute force over whole tables, without the operators' methods.

Token counts, packing and the classifier have none; tests hold those against their libraries, a round trip and held-out
labels.
"""

from __future__ import annotations

from tessera.llm.secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, LOGIN, SCOPE

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JOIN = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '{SPACED}') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w
),
n as (select doc_id, count(*) as n from s group by 1),
k as (select doc_id, n, g from s join n using (doc_id)),
links as (
  select a.doc_id as x, b.doc_id as y from k a join k b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
r as (select doc_id, doc_id as o from documents union select r.doc_id, y from r join links on o = x),
c as (select doc_id, min(o) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents join c using (doc_id) left join n using (doc_id)
"""


def _found(pattern: str, kind: int, where: str = "true") -> str:
    """Rows (doc_id, s, k, e) of the leftmost non-overlapping matches; ``where`` speaks of hit."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  select doc_id, s, {kind} as k, s + length(hit) as e from (
    select doc_id, hits[i] as hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::bigint as s from (
      select *, unnest(range(1, len(hits) + 1)) as i from (
        select doc_id, regexp_extract_all(text, {p}) as hits, string_split_regex(text, {p}) as gaps from documents)))
  where {where}"""


_VALUE = "length(regexp_extract(hit, '" + ASSIGN.replace("'", "''") + "', 2)) >= 8"
_SPANS = "string_agg(name || ':' || s || ':' || e, ',' order by s, k)"
SECRET_SCAN = f"""
with base as ({_found(ASSIGN, 0, _VALUE)} union all {_found(ACCESS, 1)} union all {_found(HEX, 2)}),
free as (
  select * from ({_found(LOGIN, 3)} union all {_found("[A-Za-z0-9+/=]+", 4, "length(hit) = 40 and not contains(hit, '=')")} union all {_found(ENDPOINT, 5)}) w
  where not exists (select 1 from base b where b.doc_id = w.doc_id and b.s < w.e and w.s < b.e)
),
parts as (select doc_id, s, k in (1, 3) as is_id, k in (0, 2, 4) as is_secret from (from base union all from free)),
weak as (
  select w.doc_id, w.s, w.k, w.e from free w join parts p on p.doc_id = w.doc_id and abs(p.s - w.s) <= {SCOPE}
  group by all having case w.k when 3 then bool_or(is_secret) when 4 then bool_or(is_id) else bool_or(is_secret) and bool_or(is_id) end
),
named as (select *, {list(KINDS)}[k + 1] as name from (from base union all from weak)),
sums as (
  select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    {_SPANS} filter (k < 3) as base, {_SPANS} as spans from named group by 1
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join sums using (doc_id)
"""

SUFFIX_DEDUP = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
t as (select doc_id, a, substr(h, 2 * a + 1, 1598) as h from (select doc_id, h, unnest(range(0, length(h) // 2, 400)) as a from h)),
w as (select doc_id, a + i as i, md5(substr(h, 2 * i + 1, 800)) as g from (select *, unnest(range(0, length(h) // 2 - 399)) as i from t)),
twice as (select g from w group by 1 having count(*) > 1),
hits as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from w semi join twice using (g)),
runs as (select doc_id, min(i) as b, max(i) + 400 as e from (select *, sum((gap is null or gap > 400)::int) over (partition by doc_id order by i) as run from hits) group by doc_id, run),
pieces as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by b), 0) as b, b as e from runs
  union all select doc_id, coalesce(e, 0), length(h) // 2 from h left join (select doc_id, max(e) as e from runs group by 1) using (doc_id)
),
kept as (select doc_id, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' order by b) as h from pieces join h using (doc_id) group by 1),
cut as (select doc_id, sum(e - b) as removed, count(*) as spans from runs group by 1)
select doc_id, (length(h.h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(kept.h)) as kept_sha256 from h join kept using (doc_id) left join cut using (doc_id)
"""

DECONTAMINATE = f"""
with d as (select doc_id, regexp_extract_all({LOWERED}, '{LETTERS}') as ws from documents),
b as (select item_id, regexp_extract_all({LOWERED}, '{LETTERS}') as ws from benchmark),
items as (
  select item_id, n, j, array_to_string(ws[j : j + 9], ' ') as g
  from (select item_id, ws, least(len(ws), 10) as n, unnest(range(1, greatest(len(ws) - 8, 2))) as j from b where len(ws) > 0)
),
lengths as (select distinct n from items),
grams as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, lengths)),
hits as (select doc_id, i, n, item_id, j from grams join items using (n, g)),
runs as (select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as run from hits),
longest as (select doc_id, max(l) as longest from (select doc_id, count(*) + any_value(n) - 1 as l from runs group by doc_id, item_id, i - j, run) group by 1),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hits) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(longest, 0)::bigint as longest
from d left join words using (doc_id) left join found using (doc_id) left join longest using (doc_id)
"""

COVER_TREE = """
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id, vec_id as o from embeddings union select r.vec_id, y from r join links on o = x),
c as (select vec_id, min(o) as component_id from r group by 1),
n as (select x as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)
"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') as ws from documents),
w as (select doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
hits as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as least from w) where least < doc_id),
gone as (select doc_id, list(distinct p) as gone, count(distinct p) as n from (select doc_id, unnest(range(i, i + 13)) as p from hits) group by 1),
words as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from d),
out as (select doc_id, p from (select doc_id, unnest(gone) as p from gone)),
kept as (select doc_id, string_agg(ws[p], ' ' order by p) as t from words anti join out using (doc_id, p) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::int >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
WARC = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, n::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from p
"""

ORACLE: dict[str, str] = {
    "op1_ngram_join": NGRAM_JOIN,
    "op2_secret_scan": SECRET_SCAN,
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op4_decontaminate": DECONTAMINATE,
    "op5_cover_tree": COVER_TREE,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op8_warc": WARC,
}
