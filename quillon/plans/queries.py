"""Registered queries of the engine: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions import tooljson
from quillon.operators import compact, embed, hashed, index, render, retrieve
from quillon.operators import events as ev
from quillon.plans import sql
from quillon.plans.settings import Compaction, Hashed, Retrieval
from quillon.sources import datasets as ds
from quillon.sources.tables import hadoop_path, new_path, tidy

Query = Callable[[SparkSession, str], DataFrame]
RENDER_CHARS = 1200
SMALL = Compaction(recent_events=6, context_chars=1000)
RETENTION = 300
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = (f, oracle)
        return f

    return add


def _stored(name: str) -> Callable:
    """Of f(spark, sf_dir, folder): a query that gives it a new folder, writes its result and deletes the folder and all tables written on the way."""

    def wrap(f: Callable[[SparkSession, str, str], DataFrame]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            folder = new_path(spark, name)
            try:
                return tidy(name + "-result")(f)(spark, d, folder)
            finally:
                fs, p = hadoop_path(spark, folder)
                fs.delete(p, True)

        return run

    return wrap


def long(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query("text_normalize_truncate", f"select doc_id, {sql.norm('text')} as normal, {sql.trunc(sql.norm('text'), 80)} as short, {sql.fold(sql.norm('text'))} as folded from documents")
def _(spark, d):
    rows = ds.spread(ds.read(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.normalize("text").alias("normal"))
    return rows.select("doc_id", "normal", tx.truncate("normal", 80).alias("short"), tx.casefold("normal").alias("folded"))


def _tokenized(spark, d, kind):
    rows = ds.spread(ds.read(spark, d, "documents").select("doc_id", "text")).select("doc_id", kind("text").alias("k"))
    return rows.select("doc_id", F.array_join("k", " ").alias("tokens"), long(F.size("k")).alias("n"))


@query("tokenize_index", f"select doc_id, array_to_string({sql.tokens('text')}, ' ') as tokens, len({sql.tokens('text')}) as n from documents")
def _(spark, d):
    return _tokenized(spark, d, tx.tokens)


@query("tokenize_hashed", f"select doc_id, array_to_string({sql.hash_tokens('text')}, ' ') as tokens, len({sql.hash_tokens('text')}) as n from documents")
def _(spark, d):
    return _tokenized(spark, d, tx.hash_tokens)


_RECORD = "concat('Note PMID: ', doc_id % 5, ' of Patient/SYN-', doc_id % 7, ', topic  T', doc_id % 3, ' FHIR. ', text)"


def _record():
    part = lambda n: (F.col("doc_id") % n).cast("string")
    return F.concat(F.lit("Note PMID: "), part(5), F.lit(" of Patient/SYN-"), part(7), F.lit(", topic  T"), part(3), F.lit(" FHIR. "), F.col("text"))


@query("identifiers", f"select doc_id, {sql.count_identifiers(_RECORD)} as n, " + ", ".join(f"array_to_string({sql.keys(_RECORD, k)}, '|') as {k}" for k in tx.NAMESPACES) + " from documents")
def _(spark, d):
    rows = ds.read(spark, d, "documents").withColumn("t", _record()).withColumn("k", tx.identifier_keys("t"))
    return rows.select("doc_id", long(tx.identifier_count("t")).alias("n"), *[F.array_join(F.array_sort(F.col("k")[k]), "|").alias(k) for k in tx.NAMESPACES])


@query("source_kind_importance", f"with {sql.entries_cte()} select user_id, doc_id, source_kind, round(importance, 6) as importance from e")
def _(spark, d):
    return ds.entries(spark, d).select("user_id", "doc_id", "source_kind", F.round("importance", 6).alias("importance"))


_CODE = "concat(case item_id % 3 when 0 then 'Code AB-12 ' when 1 then 'code ab-12 ' else 'PMID 7 ' end, text)"


@query(
    "lexical_anchor_weight",
    f"select item_id, {sql.anchor(_CODE)} as anchor, {' or '.join(f'len({sql.keys(_CODE, k)}) > 0' for k in tx.NAMESPACES)} as precise, case when {sql.anchor(_CODE)} or {' or '.join(f'len({sql.keys(_CODE, k)}) > 0' for k in tx.NAMESPACES)} then 0.6::double else 0.85::double end as w from benchmark",
)
def _(spark, d):
    code = F.when(F.col("item_id") % 3 == 0, "Code AB-12 ").when(F.col("item_id") % 3 == 1, "code ab-12 ").otherwise("PMID 7 ")
    rows = ds.read(spark, d, "benchmark").withColumn("t", F.concat(code, "text"))
    precise = tx.has_identifier(tx.identifier_keys("t"))
    return rows.select("item_id", tx.has_anchor("t").alias("anchor"), precise.alias("precise"), F.when(tx.has_anchor("t") | precise, 0.6).otherwise(0.85).alias("w"))


@query("event_memory_text", f"select conv_id, turn, {sql.strip(sql.trunc(sql.norm('text'), 160))} as memory_text from conversations")
def _(spark, d):
    return ev.memory_text(ev.events(ds.turns(spark, d)), 160, tools=False).select(long("session_id").alias("conv_id"), long("event_id").alias("turn"), "memory_text")


@query("event_context_text", f"select conv_id, turn, {sql.trunc(sql.strip(sql.trunc(sql.norm('text'), 200)), 150)} as context_text, case when role = 'assistant' then 'model' else role end as role from conversations")
def _(spark, d):
    rows = ev.context_text(ev.events(ds.turns(spark, d)), Compaction(text_chars=200, event_chars=150), tools=False)
    return rows.select(long("session_id").alias("conv_id"), long("event_id").alias("turn"), "context_text", ev.event_role().alias("role"))


@query("index_entries", f"with {sql.entries_cte()} select app_name, user_id, session_id, doc_id, text, source_kind, round(importance, 6) as importance, created_at, len(tokens) as n_tokens from e")
def _(spark, d):
    return ds.entries(spark, d).select("app_name", "user_id", "session_id", "doc_id", "text", "source_kind", F.round("importance", 6).alias("importance"), "created_at", "n_tokens")


@query("document_frequency", f"with {sql.entries_cte()}, t as (select distinct user_id, doc_id, unnest(tokens) as term from e) select user_id, term, count(*) as df from t group by all")
def _(spark, d):
    return ev.document_frequency(ds.entries(spark, d)).select("user_id", "term", "df")


@query("scope_stats", f"with {sql.entries_cte()} select user_id, count(*) as n_docs, round(greatest(1.0::double, avg(len(tokens))), 6) as avgdl from e group by 1")
def _(spark, d):
    return ev.scope_stats(ds.entries(spark, d)).select("user_id", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _halves(spark, d, vectors=False, records=False):
    """Documents as events, in two batches by their sequence, the second from the middle of the ids on."""
    rows = ds.document_events(spark, d, records, vectors)
    middle = F.lit(ds.read(spark, d, "documents").agg(F.expr("max(doc_id) div 2")).first()[0])
    return rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)


@query("index_append", f"with {sql.entries_cte()}, t as (select distinct user_id, doc_id, unnest(tokens) as term from e), f as (select user_id, term, count(*) as df from t group by all), sums as (select t.user_id, t.doc_id, sum(df)::bigint as sum_df from t join f using (user_id, term) group by all), n as (select user_id, count(*) as n_docs, sum(len(tokens))::bigint as scope_tokens from e group by 1) select e.user_id, e.doc_id, e.text, len(tokens) as n_tokens, coalesce(sum_df, 0)::bigint as sum_df, n_docs, scope_tokens from e left join sums using (user_id, doc_id) join n on n.user_id = e.user_id")
@_stored("index")
def _(spark, d, path):
    for batch in _halves(spark, d):
        index.append(path, batch, tools=False)
    e = index.entries(spark, path)
    df = index.document_frequency(spark, path).select("user_id", "term", "df")
    sums = e.select("user_id", "doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(df, ["user_id", "term"]).groupBy("user_id", "doc_id").agg(F.sum("df").alias("sum_df"))
    counts = index.scope_counts(spark, path).select("user_id", "n_docs", F.col("n_tokens").alias("scope_tokens"))
    return e.select("user_id", "doc_id", "text", "n_tokens").join(sums, ["user_id", "doc_id"], "left").withColumn("sum_df", F.coalesce("sum_df", F.lit(0)).cast("long")).join(counts, "user_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("score", "dense_score", "sparse_score", "importance")})


def _from_index(settings: Retrieval = Retrieval(), mode: str = "bm25", records: bool = False) -> Query:
    """A question to a stored index of the documents, which has inverted lists; two batches."""
    vectors = mode != "bm25"

    @_stored("index")
    def ask(spark, d, path):
        for batch in _halves(spark, d, vectors, records):
            index.append(path, batch, settings, tools=False)
        return _rounded(index.retrieve(path, ds.queries(spark, d, vectors, records), mode, settings))

    return ask


def _retrieval(mode: str, settings: Retrieval = Retrieval()) -> Query:
    vectors = mode != "bm25"
    return lambda spark, d: _rounded(retrieve.retrieve(ds.entries(spark, d, vectors), ds.queries(spark, d, vectors), mode, settings))


for _mode in ("bm25", "dense", "fused", "rrf", "cascade", "union"):
    query(f"retrieve_{_mode}", sql.retrieval(_mode))(_from_index() if _mode == "bm25" else _retrieval(_mode))
query("retrieve_session", sql.retrieval("fused", session=True))(_retrieval("fused", settings=Retrieval(cross_session=False)))
query("retrieve_session_bm25", sql.retrieval("bm25", session=True))(_from_index(Retrieval(cross_session=False)))
query("retrieve_guarded", sql.retrieval("fused", guard=True))(_from_index(Retrieval(guard_identifiers=True), "fused", records=True))


@query("retrieve_embedded", sql.retrieval("dense", encoded=True))
@_stored("embeddings")
def _(spark, d, folder):
    """Texts encoded on the way; what two calls need twice is encoded once."""
    e, q = ds.entries(spark, d), ds.queries(spark, d)
    middle = F.col("doc_id") % 2 == 0
    load = embed.Loader("letter-counts", lambda: ds.letter_counts)
    embed.embedded_entries(e.where(middle), load, f"{folder}/entries")
    entries = embed.embedded_entries(e, load, f"{folder}/entries")
    return _rounded(retrieve.retrieve(entries, embed.embedded_queries(q, load, cache=f"{folder}/queries"), "dense"))


_POLICIES = (("plain", 100, False), ("fused_hybrid", 200, True))


@query("retrieve_policies", " union all ".join(f"select *, '{p}' as policy, {b}::bigint as budget from ({sql.retrieval('bm25', guard=guard)})" for p, b, guard in _POLICIES))
@_stored("policies")
def _(spark, d, root):
    out = None
    for policy, budget, guard in _POLICIES:
        index.store_for(root, ds.document_events(spark, d, records=guard), policy, budget, {}, tools=False)
        part = tidy("policy-result")(index.retrieve_for)(root, ds.queries(spark, d, records=guard), policy, budget, {}, "bm25", 5)
        index.reset(spark, index.policy_path(root, policy, budget))  # its question is answered: one index at a time takes room
        part = part.withColumn("policy", F.lit(policy)).withColumn("budget", F.lit(budget).cast("long"))
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


@query("render_index", sql.rendered(sql.retrieval("bm25"), sql.index_line(), render.INDEX_HEADER, RENDER_CHARS, ellipsis=False))
def _(spark, d):
    return render.index_context(_from_index()(spark, d), RENDER_CHARS)


@query("render_store", sql.rendered(sql.retrieval("bm25"), sql.store_line(), render.STORE_HEADER, RENDER_CHARS, ellipsis=True))
def _(spark, d):
    return render.store_context(_from_index()(spark, d), RENDER_CHARS)


_TWICE = "twice as (select * from turns union all select * from turns where turn % 2 = 0)"


def _twice(spark, d):
    rows = ds.turns(spark, d)
    return rows.unionByName(rows.where(F.col("seq") % 2 == 0))


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("vector").withColumn("importance", F.round("importance", 6))


_STORED = "id, app_name, user_id, session_id, invocation_id, source_kind, text, round(importance, 6) as importance, created_at"


@query("store_ingest", f"with {sql.TURNS}, {_TWICE}, {sql.stored('twice')} select distinct {_STORED} from s")
def _(spark, d):
    empty = spark.createDataFrame([], hashed.COLUMNS)
    return _plain(hashed.insert_ignore(empty, hashed.rows(_twice(spark, d), tools=False, vectors=False)))


@query("store_retention", f"with {sql.TURNS}, {sql.stored('turns')}, u as (select distinct * from s) select {_STORED} from u order by created_at desc, id limit {RETENTION}")
def _(spark, d):
    return _plain(hashed.retain(hashed.rows(ds.turns(spark, d), tools=False, vectors=False).dropDuplicates(["id"]), RETENTION))


@query("store_append", f"with {sql.TURNS}, {_TWICE}, {sql.stored('twice')}, u as (select distinct * from s) select {_STORED} from u order by created_at desc, id limit {RETENTION}")
@_stored("store")
def _(spark, d, path):
    """The same by writes of turns in four batches, each of which repeats some of the one before."""
    settings = Hashed(enabled=True, path=path, max_entries=RETENTION)
    for part in range(4):
        hashed.store(_twice(spark, d).where(((F.col("seq") + part) % 4 < 2)), settings, tools=False)
    return _plain(hashed.read_store(spark, settings))


_SCAN = Hashed(enabled=True, scan_rows=40)


def _scopes(spark, d):
    return ds.turns(spark, d).select("app_name", "user_id").distinct().select(long("user_id").alias("query_id"), "app_name", "user_id")


@query(
    "store_scan",
    f"with {sql.TURNS}, {sql.stored('turns')}, n as (select *, row_number() over (partition by user_id order by created_at desc, id) as n from s), k as (select *, {sql.fold(sql.norm('text'))} as key from n where n <= {_SCAN.scan_rows}), r as (select *, row_number() over (partition by user_id, key order by n) as r from k where key <> '') select user_id::bigint as query_id, id, text, source_kind, created_at, n from r where r = 1",
)
def _(spark, d):
    store = hashed.rows(ds.turns(spark, d), tools=False, vectors=False)
    return hashed.scan(store, _scopes(spark, d), _SCAN).select("query_id", "id", "text", "source_kind", "created_at", long("n").alias("n"))


@query("store_retrieve")
@_stored("store")
def _(spark, d, path):
    settings = Hashed(enabled=True, path=path, min_score=0.01, max_entries=0)
    hashed.store(ds.document_events(spark, d), settings, tools=False)
    return hashed.retrieve_stored(ds.queries(spark, d), settings).withColumn("score", F.round("score", 6))


@query("history_recent", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) select conv_id, turn, role, text from r where n <= 3")
def _(spark, d):
    return compact.recent(ds.read(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role", "text")


@query("history_compact", sql.compacted(SMALL, contents=False))
def _(spark, d):
    return compact.compact_events(ds.turns(spark, d), SMALL, tools=False).select(long("session_id").alias("conv_id"), "position", "role", "text", "is_memory")


@query("contents_compact", sql.compacted(SMALL, contents=True))
def _(spark, d):
    return compact.compact_contents(ds.requests(spark, d), SMALL, tools=False).select(F.col("request_id").alias("conv_id"), "position", "role", "text", "is_memory")


#: Canonical JSON of a flat object, which all payloads of the events table are; nested ones are tested in Python.
_FLAT = """'{' || array_to_string(list_transform(list_filter(list_sort(json_keys(props)), lambda k: %s), lambda k: '"' || k || '": ' || json_extract(props, '$."' || k || '"')::varchar), ', ') || '}'"""
_FULL = """json_extract(props, '$."' || k || '"')::varchar not in ('null', '""', '[]', '{}')"""


@query("tool_results", f"select event_id, {sql.strip(sql.trunc(sql.norm('m'), 900))} as memory_text from (select event_id, concat('Tool result: ', event_type, ' summary=', {sql.trunc(sql.norm(_FLAT % _FULL), 500)}) as m from events)")
def _(spark, d):
    return ev.memory_text(ev.events(ds.tool_events(spark, d)), 900).select(long("event_id").alias("event_id"), "memory_text")


def _nested_sql() -> str:
    """Compact forms of ``ds.nested_payload``."""
    flat = _FLAT % _FULL
    deep = [f"""'{{"list": {{"count": 4, "first_items": [', {flat}, ', 1, 2]}}, "nested": {{"deep": {{"deeper": {{"summary": "{{\\"deepest\\": {{\\"x\\": ', event_id, '}}}}"}}}}}}, '"""]
    deep += ["""'"patients": {"count": 4, "first_ids": ["', event_id, '", "', event_id, '"], "first_names": ["N', event_id, '"]}, "status": "ok", "timeline": {"count": 4, "first_items": [{"at": ', event_id, '}, {"at": 1}]}}'"""]
    listed = f"""concat('{{"count": 6, "first_items": [', {flat}, ', ', event_id, ', "text of a list", null, [1]]}}')"""
    compact_ = f"""case event_id % 5 when 0 then {flat} when 1 then {flat} when 2 then {listed} when 3 then concat({", ".join(deep)}) else concat('"some text ', event_id, '"') end"""
    rows = "(select event_id, event_type, coalesce(props, '{}') as props from events)"
    return f"select event_id, {sql.strip(sql.trunc(sql.norm('m'), 900))} as memory_text from (select event_id, concat('Tool result: ', event_type, ' summary=', {sql.trunc(sql.norm('x'), 500)}) as m from (select *, {compact_} as x from {rows}))"


@query("tool_results_nested", _nested_sql())
def _(spark, d):
    return ev.memory_text(ev.events(ds.tool_events(spark, d, nested=True)), 900).select(long("event_id").alias("event_id"), "memory_text")


@query("tool_arguments", f"select event_id, {sql.trunc(sql.norm(_FLAT % 'true'), 60)} as args from events")
def _(spark, d):
    return ds.read(spark, d, "events").select("event_id", F.get(tooljson.arguments(F.array("props"), 60), F.lit(0)).alias("args"))


def _parts_sql(name: str, args: int, answer: str, arrow: str, result: int, chars: int) -> str:
    """Of the events as ``part_events`` makes them; their texts are shorter than any limit."""
    said = f"case when event_id % 4 = 1 then '' else {sql.norm("concat('  Note on ', event_type, '  number ', event_id, ' ')")} end"
    asked = f"case when event_id % 3 <> 0 then concat('{ev.CALL}', event_type, ' args=', {sql.trunc(sql.norm(_FLAT % 'true'), args)}) else '' end"
    told = f"concat('{answer}', case when event_id % 5 <> 0 then event_type else 'tool' end, '{arrow}', {sql.trunc(sql.norm(_FLAT % _FULL), result)})"
    joined = f"array_to_string(list_filter([{said}, {asked}, {told}], lambda x: length(x) > 0), chr(10))"
    return f"select event_id, case when event_id % 7 = 6 then '' else {sql.trunc('t', chars)} end as {name} from (select event_id, {joined} as t from events)"


_PART_CHARS = Compaction(text_chars=200, event_chars=170, result_chars=90)


@query("event_parts_memory", _parts_sql("memory_text", ev.MEMORY_ARGS, ev.MEMORY_ANSWER, " summary=", ev.MEMORY_RESULT, 150))
def _(spark, d):
    return ev.memory_text(ev.events(ds.part_events(spark, d)), 150).select(long("event_id").alias("event_id"), "memory_text")


@query("event_parts_context", _parts_sql("context_text", ev.CONTEXT_ARGS, ev.CONTEXT_ANSWER, " -> ", _PART_CHARS.result_chars, _PART_CHARS.event_chars))
def _(spark, d):
    return ev.context_text(ev.events(ds.part_events(spark, d)), _PART_CHARS).select(long("event_id").alias("event_id"), "context_text")
