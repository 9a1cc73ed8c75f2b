"""SQL for the corpus operators that SQL can express over whole tables in fair time."""

from __future__ import annotations

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: crc32 by its table of 256 entries, byte by byte; each distinct run of a document is summed once.
_CRC = """tb as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
 hx as (select key, hex(encode(key)) as h from (select distinct key from ru)),
 bs as (select key, list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) as b from hx),
 cr as (select key, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as h from bs, tb)"""

SPELLING_VARIANTS = f"""with recursive rw as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}'), '[a-zÀ-ÿ]+')) as run from documents),
 ru as (select run, concat(coalesce(doc_id::varchar, ''), ':', run) as key, count(*) as n from rw group by all),
 {_CRC},
 wd as (select case when h % 199 = 0 then concat(substr(run, 1, (h % length(run))::int), substr(run, (h % length(run))::int + 2)) else run end as word, n from ru join cr using (key)),
 w as (select word, sum(n)::bigint as n from wd where length(word) >= 6 group by all having sum(n) >= 5),
 dv as (select word, n, unnest(range(1, length(word) + 1)) as i from w), d as (select word, n, i, concat(substr(word, 1, (i - 1)::int), substr(word, (i + 1)::int)) as d from dv),
 pr as (select a.word as a, b.word as b, b.n as bn from d a join d b on a.i = b.i and a.d = b.d and a.word <> b.word union select d.word, w.word, w.n from d join w on d.d = w.word union select w.word, d.word, d.n from d join w on d.d = w.word),
 nr as (select a as word, count(*) as n_near, max(bn) as most, arg_min(b, (-bn, b)) as best from pr group by all),
 fm as (select word, n, coalesce(n_near, 0) as n_near, case when most >= 5 * n then best end as form, case when most >= 5 * n then most end as form_n from w left join nr using (word)),
 rt as (select word, word as root from fm union all select rt.word, fm.form from rt join fm on fm.word = rt.root where fm.form is not null),
 ro as (select rt.word, rt.root from rt join fm on fm.word = rt.root where fm.form is null)
 select word, form, root, n, n_near::bigint as n_near, form_n from fm join ro using (word)"""

PERIODIC_RUNS = f"""with ru as (select coalesce(doc_id::varchar, '') as key from documents),
 {_CRC},
 ws as (select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents join cr on key = coalesce(doc_id::varchar, '')),
 pa as (select *, len(w) as n, case when len(w) > 0 then g % len(w) end as a from ws), pb as (select *, 1 + (n - a) // (3 + g % 8) as p from pa),
 wi as (select doc_id, n, i, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] as w from pb, unnest(range(n)) t(i)),
 pq as (select x.doc_id, y.i - x.i as q, x.i from wi x join wi y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and y.i - x.i <= x.n // 3),
 st as (select doc_id, q, min(i) as s, count(*) + q as k from (select *, i - row_number() over (partition by doc_id, q order by i) as g from pq) group by doc_id, q, g having count(*) + q >= greatest(24, 3 * q)),
 rn as (select doc_id, s, k, min(q) as q from st group by all),
 bt as (select * from rn qualify row_number() over (partition by doc_id order by k / q::double desc, s, q) = 1),
 ag as (select doc_id, count(*) as n_runs, string_agg(concat(s, ',', k, ',', q, chr(10)), '' order by s, q) as told from rn group by all),
 gone as (select distinct doc_id, unnest(range(s + q, s + k)) as i from rn),
 kept as (select doc_id, string_agg(w, ' ' order by i) as t from wi anti join gone using (doc_id, i) group by all)
 select d.doc_id, coalesce(n_runs, 0) as n_runs, s as start, k as length, q as period, (1000 * k // q)::bigint as exponent_milli, sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
 from documents d left join ag using (doc_id) left join bt using (doc_id) left join kept using (doc_id)"""

_LABELS = """co as (select node, min(least) as component_id from (with recursive re as (select node, node as least from no union select re.node, lk.b from re join lk on lk.a = re.least) select * from re) group by node)"""

#: Documents by shared shingles; components by walking all links.
JACCARD_JOIN = f"""with ws as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 sh as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from ws, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
 cn as (select doc_id, count(*) as c from sh group by all),
 pr as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 lk as (select a, b from pr join cn x on x.doc_id = a join cn y on y.doc_id = b where 100 * k >= 75 * (x.c + y.c - k)),
 no as (select distinct a as node from lk), {_LABELS}
 select d.doc_id, coalesce(c, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, (select count(*) from lk where lk.a = d.doc_id) as n_links, coalesce(component_id, d.doc_id) = d.doc_id as kept
 from documents d left join cn using (doc_id) left join co on co.node = d.doc_id"""

#: All pairs of one label; the supplied vectors are of one length, without nulls.
NEAR_VECTORS = f"""with us as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and list_sum(list_transform(embedding, lambda x: (x <> 0)::int)) > 0),
 un as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from us),
 lk as (select a.vec_id as a, b.vec_id as b from un a join un b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.98),
 no as (select distinct a as node from lk), {_LABELS}
 select e.vec_id, (select count(*) from lk where lk.a = e.vec_id) as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept from embeddings e left join co on co.node = e.vec_id"""

ORACLES: dict[str, str] = {"op2_jaccard_join": JACCARD_JOIN, "op9_embedding_near_dedup": NEAR_VECTORS, "op11_spelling_variants": SPELLING_VARIANTS, "op12_periodic_runs": PERIODIC_RUNS}
