"""The rules of the engine as DuckDB SQL, for comparison on the same tables."""

from __future__ import annotations

from quillon.functions import text as tx
from quillon.operators import compact, render
from quillon.plans.settings import Compaction, Hashed, Retrieval
from quillon.sources.datasets import LETTERS, RECORDS, USERS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{tx.SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{tx.SPACE}+', ''), '{tx.SPACE}+\z', '')"


def trunc(x: str, n: int | str) -> str:
    return rf"case when length({x}) <= {n} then {x} else regexp_replace(substr({x}, 1, {n} - 3), '{tx.SPACE}+\z', '') || '...' end"


def fold(x: str) -> str:
    low = f"lower({x})"
    out = f"translate({low}, '{''.join(tx.SINGLE)}', '{''.join(tx.SINGLE.values())}')"
    for a, b in tx.SEVERAL.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"case when length({low}) = strlen({low}) then {low} else {out} end"


def _raw(x: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({x}, {lit('')})')}, '{tx.TOKEN}')"


def _split(t: str, sep: str) -> str:
    return f"case when contains({t}, '{sep}') then list_filter(string_split({t}, '{sep}'), lambda p: length(p) >= 2) else []::varchar[] end"


def tokens(x: str) -> str:
    stop = ", ".join(lit(s) for s in tx.STOPWORDS)
    clean = f"trim(t, '{tx.EDGE}')"
    return f"flatten(list_transform({_raw(x)}, lambda t: case when length({clean}) >= 2 and not list_contains([{stop}], {clean}) then list_concat(list_concat([{clean}], {_split('t', '/')}), {_split('t', '-')}) else []::varchar[] end))"


def hash_tokens(x: str) -> str:
    return f"flatten(list_transform({_raw(x)}, lambda t: list_concat(list_concat([t], {_split('t', '/')}), {_split('t', '-')})))"


def count_identifiers(x: str) -> str:
    return f"len(regexp_extract_all({x}, '(?i){tx.IDENTIFIERS}'))"


def keys(x: str, kind: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '(?i){tx.NAMESPACES[kind]}'), lambda m: {norm(fold('m'))})))"


def anchor(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '{tx.ANCHOR}')"


def kind(text: str, author: str, role: str) -> str:
    return f"case when contains(lower({text}), 'tool result:') or lower({author}) = 'tool' then 'tool' when lower({role}) = 'user' or lower({author}) = 'user' then 'user' else 'assistant' end"


def importance(text: str, kind: str) -> str:
    d = lambda x: f"{x}::double"
    return (
        f"greatest({d(0.1)}, case {kind} when 'user' then {d('1.0')} + {d(1.2)} when 'tool' then {d('2.0')} else {d('1.0')} + {d(0.2)} end"
        f" + least({d('1.0')}, {count_identifiers(text)}::double * {d(0.25)}) - case when length({text}) > 600 and {kind} = 'assistant' then {d(0.3)} else {d('0.0')} end)"
    )


DOCS = "doc_id as seq, 'app' as app_name, lang as user_id, source as session_id, (doc_id + 1)::double as created_at, case doc_id % 3 when 0 then 'user' when 1 then 'tool' else 'helper' end as author, case when doc_id % 3 = 0 then 'user' else 'model' end as role"


def letter_counts(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::double" for c in LETTERS) + ", 1.0::double]"


def entries_cte(vectors: bool = False, records: bool = False, chars: int = Retrieval().entry_chars, encoded: bool = False) -> str:
    text = f"concat('Patient/SYN-', doc_id % {RECORDS}, ' ', text)" if records else "text"
    vec = ", embedding::double[] as embedding" if vectors else ""
    join = " join embeddings on vec_id = doc_id % (select count(*) from embeddings)" if vectors else ""
    return f"""
m as (select {DOCS}, {strip(trunc(norm(text), chars))} as mt{vec} from documents{join}),
e0 as (select *, {norm('mt')} as text, row_number() over (partition by user_id order by seq) - 1 as doc_id from m where length(mt) >= {tx.MIN_ENTRY_CHARS}),
e1 as (select *, {kind('text', 'author', 'role')} as source_kind{f", {letter_counts('text')} as embedding" if encoded else ""} from e0),
e as (select *, {importance('text', 'source_kind')} as importance, {tokens('text')} as tokens from e1)"""


def queries_cte(vectors: bool = False, records: bool = False, encoded: bool = False) -> str:
    text = f"concat('Patient/SYN-', item_id % {RECORDS}, ' ', text)" if records else "text"
    users = ", ".join(f"({i}, '{u}')" for i, u in enumerate(USERS))
    vec = ", embedding::double[] as q_embedding" if vectors else ""
    join = " join embeddings on vec_id = item_id % (select count(*) from embeddings)" if vectors else ""
    precise = " or ".join([anchor("q_text"), *[f"len({keys('q_text', k)}) > 0" for k in tx.NAMESPACES]])
    s = Retrieval()
    return f"""
q0 as (select item_id * 10 + i as query_id, u.user_id, concat('src', item_id % 20) as q_session, {text} as q_text{vec} from benchmark{join}, (values {users}) as u(i, user_id)),
q as (select *{f", {letter_counts(lit(s.query_prefix) + ' || q_text')} as q_embedding" if encoded else ""}, {tokens('q_text')} as q_tokens, case when {precise} then {s.dense_weight}::double else {s.semantic_dense_weight}::double end as w from q0 where length({norm('q_text')}) > 0)"""


def retrieval(mode: str, session: bool = False, guard: bool = False, k: int = 5, s: Retrieval = Retrieval(), encoded: bool = False) -> str:
    """The whole ranking of one mode; columns as the operator's, scores rounded."""
    vectors = mode != "bm25" and not encoded
    d = lambda x: f"{x!r}::double"
    where = []
    if session:
        where.append("session_id = q_session")
    if guard:
        where += [f"(len({keys('q_text', n)}) = 0 or list_has_any({keys('q_text', n)}, {keys('text', n)}))" for n in tx.NAMESPACES]
    cos = "list_cosine_similarity(embedding, q_embedding)" if vectors or encoded else "0.0::double"
    bm = "0.0::double" if mode == "dense" else "coalesce(bm, 0.0::double)"
    value = {
        "dense": "greatest(0.0::double, dense)",
        "bm25": "bm25",
        "fused": f"w * greatest(0.0::double, dense) + (1.0::double - w) * sg + {d(1e-9)} * decay",
        "rrf": f"rd + rs + case when dense_eligible or sparse_eligible then {d(1e-12)} * decay else 0.0::double end",
        "cascade": "case when s_max > 0 then bm25 else greatest(0.0::double, dense) end",
        "union": "greatest(greatest(0.0::double, dense), sg)",
    }[mode]
    if mode == "union":
        chosen = f"""
sel0 as (select *, row_number() over (partition by query_id order by dense desc, created_at desc, doc_id) <= {k} and dense_eligible as a,
  row_number() over (partition by query_id order by bm25 desc, created_at desc, doc_id) <= {k} and sparse_eligible as b from sc),
sel as (select *, row_number() over (partition by query_id order by least(dense_rank, sparse_rank), greatest(dense, bm25) desc, doc_id) - 1 as position from sel0 where a or b)"""
    else:
        least = s.rrf_min_score if mode == "rrf" else s.min_score
        chosen = f"sel as (select *, row_number() over (partition by query_id order by score desc, created_at desc, doc_id) - 1 as position from sc where score >= {d(least)}{' and (dense_eligible or sparse_eligible)' if mode == 'rrf' else ''})"
    return f"""with {entries_cte(vectors, guard, encoded=encoded)}, {queries_cte(vectors, guard, encoded)},
et as (select user_id, doc_id, term, count(*) as tf from (select user_id, doc_id, unnest(tokens) as term from e) group by all),
df as (select user_id, term, count(*) as df from et group by all),
n as (select user_id, count(*) as n from e group by all),
c as (select q.query_id, q.w, e.*, len(tokens) as dl, {cos} as dense from e join q using (user_id){' where ' + ' and '.join(where) if where else ''}),
l as (select query_id, greatest(1.0::double, avg(dl)) as avgdl from c group by 1),
qt as (select distinct query_id, user_id, term from (select query_id, user_id, unnest(q_tokens) as term from q)),
h as (select c.query_id, c.doc_id, qt.term, ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * {d(s.k1 + 1)}) / (tf + {d(s.k1)} * ({d(1 - s.b)} + {d(s.b)} * (dl::double / avgdl))) as x
  from c join qt using (query_id) join et on et.user_id = c.user_id and et.doc_id = c.doc_id and et.term = qt.term
  join df on df.user_id = c.user_id and df.term = qt.term join n on n.user_id = c.user_id join l on l.query_id = c.query_id),
hs as (select query_id, doc_id, sum(x order by term) as bm from h group by all),
b as (select c.*, {bm} as bm25 from c left join hs using (query_id, doc_id)),
r as (select *, max(bm25) over (partition by query_id) as s_max, max(created_at) over (partition by query_id) as now,
  row_number() over (partition by query_id order by dense desc, doc_id) - 1 as dense_rank, row_number() over (partition by query_id order by bm25 desc, doc_id) - 1 as sparse_rank,
  dense >= {d(s.min_score)} as dense_eligible, bm25 > 0 as sparse_eligible from b),
x as (select *, case when s_max > 0 then 1.0::double / (1.0::double + exp(-(bm25 - 0.5::double * s_max))) else 0.0::double end as sg,
  pow(0.5::double, greatest(0.0::double, now - created_at) / {d(s.half_life_seconds)}) as decay,
  case when dense_eligible then {d(s.dense_weight)} / (dense_rank + {s.rrf_k + 1}) else 0.0::double end as rd,
  case when sparse_eligible then {d(s.sparse_weight)} / (sparse_rank + {s.rrf_k + 1}) else 0.0::double end as rs from r),
sc as (select *, ({value}) * importance as score from x), {chosen}
select query_id, position, text, round(score, 6) as score, round(dense, 6) as dense_score, round(bm25, 6) as sparse_score, source_kind, session_id, created_at, round(importance, 6) as importance,
  doc_id, dense_rank, sparse_rank, '{mode}' as retrieval_mode, dense_eligible, sparse_eligible, true as retrieved
from sel where position < {k}"""


def rendered(results: str, line: str, header: str, max_chars: int, ellipsis: bool) -> str:
    """Greedy packing of results (query_id, position, ...) in position order."""
    cut = trunc("t", max_chars) if ellipsis else f"substr(t, 1, {max_chars})"
    return f"""with recursive res as ({results}),
ln as (select query_id, position, {line} as line, row_number() over (partition by query_id order by position) as i from res),
w as (select query_id, i, line, length(line) <= {max_chars} as ok, case when length(line) <= {max_chars} then length(line) else 0 end as used from ln where i = 1
  union all select ln.query_id, ln.i, ln.line, w.used + length(ln.line) <= {max_chars}, w.used + case when w.used + length(ln.line) <= {max_chars} then length(ln.line) else 0 end
  from w join ln on ln.query_id = w.query_id and ln.i = w.i + 1),
t as (select query_id, {lit(header[:-1])} || chr(10) || string_agg(line, chr(10) order by i) as t from w where ok group by 1)
select query_id, 'user' as role, {cut} as text from t"""


def index_line() -> str:
    return f"'- ' || source_kind || ' session=' || session_id || ': ' || {trunc(norm('text'), render.LINE_CHARS)}"


def store_line() -> str:
    return f"'- ' || source_kind || case when session_id <> '' then ' session=' || session_id else '' end || ': ' || {trunc(norm('text'), render.LINE_CHARS)}"


def stored(table: str, chars: int = Hashed().entry_chars) -> str:
    """Store rows, without vectors, of ``table``: app_name, user_id, session_id, invocation_id, event_id, author, role, created_at, text."""
    return f"""
s0 as (select *, {strip(trunc(norm('text'), chars))} as mt from {table}),
s1 as (select *, {kind('mt', 'author', 'role')} as source_kind from s0 where length(mt) >= {tx.MIN_ENTRY_CHARS}),
s as (select sha256(app_name || chr(0) || user_id || chr(0) || session_id || chr(0) || invocation_id || chr(0) || event_id || chr(0) || mt) as id,
  app_name, user_id, session_id, invocation_id, source_kind, mt as text, {importance('mt', 'source_kind')} as importance, created_at from s1)"""


TURNS = "turns as (select 'app' as app_name, (conv_id % 10)::varchar as user_id, conv_id::varchar as session_id, 'inv' as invocation_id, turn::varchar as event_id, role as author, case when role = 'assistant' then 'model' else role end as role, (turn + 1)::double as created_at, turn, conv_id, text from conversations)"


def compacted(s: Compaction, contents: bool) -> str:
    """Compaction of conversations as event histories, or as model requests."""
    header, fallback = (compact.CONTENTS_HEADER, compact.CONTENTS_FALLBACK) if contents else (compact.EVENTS_HEADER, compact.EVENTS_FALLBACK)
    if contents:
        first = f"""
c0 as (select conv_id, turn, role, text, {strip('text')} as exact, max(case when role = 'user' then turn end) over (partition by conv_id) as cur from conversations),
c1 as (select *, greatest({compact.LEAST_BUDGET}, {s.context_chars} - coalesce(max(case when turn = cur then length(exact) end) over (partition by conv_id), 0)) as budget from c0),
src as (select conv_id, turn, case when role in ('model', 'assistant') then 'model' else 'user' end as r, text, budget from c1 where cur is null or turn < cur),
lab as (select *, case when r = 'model' then 'assistant' else 'user' end as label from rec)"""
    else:
        first = f"""
src as (select conv_id, turn, case when role = 'assistant' then 'model' else role end as r, role as author, text, {s.context_chars} as budget from conversations),
lab as (select *, case when r in ('model', 'assistant') and coalesce(author, '') not in ('', 'user', 'model') then author when r = 'model' then 'assistant' else r end as label from rec)"""
    head, tail = first.rsplit("\nlab as", 1)
    total = f"""{head}
rn as (select *, row_number() over (partition by conv_id order by turn desc) as nth from src),
rec as (select * from (select *, {trunc(strip(trunc(norm('text'), s.text_chars)), s.event_chars)} as ct from rn where nth <= {s.recent_events}) where length(ct) > 0),
lab as{tail},
bud as (select *, sum(length(ct)) over (partition by conv_id) as total, least({s.memory_chars}, greatest({compact.LEAST_BUDGET}, budget // 4)) as mem,
  row_number() over (partition by conv_id order by turn desc) as i from lab),
kp as (select conv_id, i, true as kept, length(ct) as used from bud where i = 1
  union all select b.conv_id, b.i, b.total <= b.budget or k.used + length(b.ct) <= greatest({compact.LEAST_BUDGET}, b.budget - b.mem),
    k.used + case when k.used + length(b.ct) <= greatest({compact.LEAST_BUDGET}, b.budget - b.mem) then length(b.ct) else 0 end
  from kp k join bud b on b.conv_id = k.conv_id and b.i = k.i + 1),
al as (select bud.*, kept from bud join kp using (conv_id, i)),
ov as (select *, '- ' || label || ': ' || {trunc(norm('ct'), compact.LINE_CHARS)} as line, row_number() over (partition by conv_id order by turn) - 1 as idx, count(*) over (partition by conv_id) as nl from al where not kept),
o1 as (select *, {fold(norm('line'))} as key from ov),
o2 as (select *, row_number() over (partition by conv_id, key order by idx) as dup from o1),
o3 as (select *, idx + case when starts_with(lower(line), '- user:') then nl + {compact.USER_BONUS} else 0 end + case when contains(lower(line), 'tool result summary:') then nl + {compact.RESULT_BONUS} else 0 end
  + case when contains(lower(line), 'tool call:') then nl + {compact.CALL_BONUS} else 0 end + case when contains(lower(line), 'patient/') or contains(lower(line), 'pmid') or contains(lower(line), 'fhir') then {compact.RECORD_BONUS} else 0 end
  - case when starts_with(lower(line), '- assistant:') then {compact.ASSISTANT_MALUS} else 0 end as rating from o2 where dup = 1),
o4 as (select *, row_number() over (partition by conv_id order by rating desc, idx) as j from o3),
pk as (select conv_id, j, idx, line, mem, length(line) <= mem as ok, case when length(line) <= mem then length(line) else 0 end as used from o4 where j = 1
  union all select o.conv_id, o.j, o.idx, o.line, o.mem, p.used + length(o.line) <= o.mem, p.used + case when p.used + length(o.line) <= o.mem then length(o.line) else 0 end
  from pk p join o4 o on o.conv_id = p.conv_id and o.j = p.j + 1),
mt as (select conv_id, mem, {lit(header[:-1])} || chr(10) || coalesce(string_agg(line, chr(10) order by idx) filter (ok), {lit(fallback)}) as t from pk group by 1, 2),
un as (select conv_id, -1 as turn, 'user' as role, {trunc('t', 'mem')} as text, true as is_memory from mt
  union all select conv_id, turn, r, ct, false from al where kept"""
    if contents:
        total += "\n  union all select conv_id, turn, role, exact, false from c0 where turn = cur"
    return f"with recursive {total})\nselect conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, role, text, is_memory from un"
