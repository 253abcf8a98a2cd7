"""Registered queries of the engine's operators over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom import lexicon as L
from contextloom.functions import text as X
from contextloom.operators import budget as B
from contextloom.operators import bundle as U
from contextloom.operators import conversation as C
from contextloom.operators import diff as D
from contextloom.operators import focus as O
from contextloom.operators import scoring as S
from contextloom.operators import vector as V
from contextloom.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols of the files named by brands."""
    kinds = F.array(*map(F.lit, [*L.SYMBOL_SECTIONS, "type_alias"]))
    p = table(spark, sf_dir, "part")
    name = F.regexp_replace(F.initcap("p_name"), r"[^A-Za-z0-9]+", "")
    start = (F.col("p_partkey") % 40 + 1).cast("int")
    return p.select(
        F.col("p_partkey").alias("ordinal"),
        name.alias("name"),
        F.col("p_brand").alias("file"),
        F.get(kinds, (F.col("p_partkey") % (len(L.SYMBOL_SECTIONS) + 1)).cast("int")).alias("kind"),
        F.concat(F.lower("p_type"), F.lit(" "), name).alias("signature"),
        start.alias("start_line"),
        (start + F.col("p_size")).cast("int").alias("end_line"),
        F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility"),
    )


TRIGGERS = C.Triggers(positive=["that", "with"], negative=["and not", "avoid"], decision=["from", "this"], question_end=".")

STOPS = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
TOKENS = r"list_filter(regexp_split_to_array(lower({column}), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 2 and w not in ({stops}))"


def sql_tokens(column: str) -> str:
    return TOKENS.replace("{column}", column).replace("{stops}", STOPS)


FILES = "select source || '/' || doc_id || '.' || lang as path, text as content from documents"
WANTED = f"select item_id as task_id, list_distinct({sql_tokens('text')}) as toks from benchmark"
SCORED = f"""w as ({WANTED}), t as (select task_id, len(toks) as task_size, unnest(toks) as token from w),
f as (select path, unnest(list_distinct({sql_tokens('content')})) as token from ({FILES})),
k as (select task_id, path, count(*) / any_value(task_size)::double as value from t join f using (token) group by all),
scored as (select task_id, path, round((0.40 * value) * 10000) / 10000 as score from k)"""

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("text_tokens", f"with t as (select doc_id, unnest({sql_tokens('text')}) as token from documents) select token, count(*) as uses, count(distinct doc_id) as docs from t group by token")
def text_tokens(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    return df.groupBy("doc_id", "token").count().groupBy("token").agg(F.sum("count").alias("uses"), F.count("*").alias("docs"))


@query("keyword_scores", f"with {SCORED} select task_id, path, score from scored")
def keyword_scores(spark, sf_dir):
    return S.score_files(tasks(spark, sf_dir), files(spark, sf_dir))


@query("rank_files", f"with {SCORED}, r as (select *, row_number() over (partition by task_id order by score desc, path) as rank from scored) select task_id, path, score, rank from r where rank <= 10")
def rank_files(spark, sf_dir):
    return S.rank(keyword_scores(spark, sf_dir), top=10)


@query(
    "symbol_tokens",
    """with s as (select p_brand as file, regexp_replace(list_reduce(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b), '[^A-Za-z0-9]+', '', 'g') as name from part),
    u as (select file, regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g') as parts from s),
    t as (select distinct file, lower(unnest(string_split(parts, '_'))) as token from u)
    select file as path, token from t where strlen(token) >= 2""",
)
def symbol_tokens(spark, sf_dir):
    return S.name_tokens(symbols(spark, sf_dir))


@query(
    "log_recency",
    """with n as (select user_id, row_number() over (order by ts desc, event_id desc) - 1 as position from events qualify position < 20),
    p as (select user_id as path, min(position) as position from n group by 1)
    select path, position, case when position = 0 then 1.0 when position <= 4 then 0.7 when position <= 19 then 0.3 else 0.0 end::double as recency from p""",
)
def log_recency(spark, sf_dir):
    return S.log_positions(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], "user_id")


@query(
    "share_budget",
    """with b as (select o_orderkey as id, (floor(o_totalprice))::bigint as declared, o_orderkey % 3 = 0 as strict, repeat('x', (o_custkey % 997)::int) as task from orders),
    e as (select *, case when strict then declared else floor(declared * 1.1::double)::bigint end as effective, strlen(task) // 4 as own from b),
    s as (select *, greatest(300, floor(effective * 0.05::double)::bigint) as repo_summary, case when strict then 0 else floor(effective * 0.05::double)::bigint end as safety from e),
    m as (select *, least(floor(effective * 0.2::double)::bigint, greatest(effective - own - repo_summary, 0)) as memory from s)
    select id, declared, effective, own as task, repo_summary, memory, safety, greatest(effective - own - repo_summary - memory - safety, 0) as code, strict, own + repo_summary + memory + safety >= effective as overflow from m""",
)
def share_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("declared"), (F.col("o_orderkey") % 3 == 0).alias("strict"), F.expr("repeat('x', int(o_custkey % 997))").alias("task"))
    return o.select("id", B.share_budget(F.col("declared"), F.col("task"), F.col("strict")).alias("b")).select("id", "b.*")


@query(
    "allocate_modes",
    f"""with recursive {SCORED.replace('w as', 'w as', 1)}, top as (select *, row_number() over (partition by task_id order by score desc, path) as rn from scored),
    c as (select t.task_id, t.path, rn, strlen(content) // 4 as full_cost, case when len(content) % 3 = 0 then strlen(content) // 10 end as focused, case when len(content) % 2 = 0 then strlen(content) // 16 end as sigs from top t join ({FILES}) f using (path)),
    g as (select task_id, 0::bigint as rn, 3000::bigint as remaining, ''::varchar as mode, 0::bigint as cost, ''::varchar as path from (select distinct task_id from c)
      union all
      select c.task_id, c.rn, g.remaining - x.cost, x.mode, x.cost, c.path from g join c on c.task_id = g.task_id and c.rn = g.rn + 1,
      lateral (select case when full_cost <= g.remaining then 'full' when focused > 0 and focused <= g.remaining and focused < full_cost * 0.8 then 'focused' when sigs > 0 and sigs <= g.remaining then 'signature_only' else 'skipped' end as mode,
        case when full_cost <= g.remaining then full_cost when focused > 0 and focused <= g.remaining and focused < full_cost * 0.8 then focused when sigs > 0 and sigs <= g.remaining then sigs else 0 end as cost) x)
    select task_id, path, mode, cost as tokens_used from g where rn > 0""",
)
def allocate_modes(spark, sf_dir):
    size = F.octet_length("content")
    costs = files(spark, sf_dir).select(
        "path",
        X.byte_tokens(F.col("content")).alias("full"),
        F.when(F.char_length("content") % 3 == 0, F.floor(size / 10)).cast("long").alias("focused"),
        F.when(F.char_length("content") % 2 == 0, F.floor(size / 16)).cast("long").alias("signatures"),
        F.lit(None).cast("string").alias("summary"),
    )
    return B.allocate(keyword_scores(spark, sf_dir).join(costs, "path").withColumn("budget", F.lit(3000)), "task_id", "budget").drop("summary")


@query("normalize_text", "select doc_id, trim(regexp_replace(replace(lower(text), '''', ''), '[^\\p{L}\\p{N}_\\-./]+', ' ', 'g')) as norm from documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text"), keep_prefix=True).alias("norm"))


@query("content_fingerprints", "select doc_id, substr(sha256(text), 1, 16) as fingerprint, strlen(text) // 4 as tokens from documents")
def content_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), X.byte_tokens(F.col("text")).alias("tokens"))


LINES = "select conv_id, turn as turn_index, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select conv_id, turn, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) as ls from conversations where text <> '')"
def sql_has(phrase: str) -> str:
    return "regexp_matches(' ' || low || ' ', '[^\\p{L}\\p{N}_]" + phrase + "[^\\p{L}\\p{N}_]')"


CLASSIFIED = f"""l as ({LINES}), z as (select conv_id, turn_index, line_no, trim(line, ' \t\r\n') as text, lower(trim(line, ' \t\r\n')) as low from l where trim(line, ' \t\r\n') <> ''),
i0 as (select *, case when {sql_has('that')} or {sql_has('with')} or {sql_has('and not')} or {sql_has('avoid')} then 'constraint' when {sql_has('from')} or {sql_has('this')} then 'decision' when suffix(text, '.') then 'open_question' end as classification,
  trim(regexp_replace(replace(low, '''', ''), '[^\\p{{L}}\\p{{N}}_\\-./]+', ' ', 'g')) as norm from z),
items as (select conv_id, turn_index, line_no, text, classification, substr(sha256(norm), 1, 16) as fingerprint from i0 where classification is not null
  qualify row_number() over (partition by conv_id, classification, norm order by turn_index, line_no) = 1)"""


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("turn_index"), X.lines(F.col("text")).alias("lines"))


@query("conversation_items", f"with {CLASSIFIED} select conv_id, turn_index, classification, text, fingerprint from items")
def conversation_items(spark, sf_dir):
    return C.extract_items(turns(spark, sf_dir), triggers=TRIGGERS).select("conv_id", "turn_index", "classification", "text", "fingerprint")


TRIMMED = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')), lambda w: w <> '' and w not in ({0})))".replace("{{", "{").replace("}}", "}").replace("{0}", STOPS)


@query(
    "resolved_questions",
    f"""with {CLASSIFIED}, w as (select *, {TRIMMED} as words from items),
    p as (select q.conv_id, q.turn_index, q.fingerprint, min(d.turn_index) as resolved_by from w q join w d on q.conv_id = d.conv_id and d.turn_index > q.turn_index
      where q.classification = 'open_question' and d.classification = 'decision' and len(q.words) + len(d.words) > 0
      and len(list_intersect(q.words, d.words))::float >= 0.1::float * len(list_distinct(list_concat(q.words, d.words))) group by all)
    select q.conv_id, q.turn_index, q.fingerprint, p.resolved_by from w q left join p using (conv_id, turn_index, fingerprint) where q.classification = 'open_question'""",
)
def resolved_questions(spark, sf_dir):
    items = C.resolve(C.extract_items(turns(spark, sf_dir), triggers=TRIGGERS), least=0.1)
    return items.where("classification = 'open_question'").select("conv_id", "turn_index", "fingerprint", "resolved_by")


@query(
    "merged_ranges",
    """with r as (select p_brand as path, (p_partkey * 7919) % 5000 + 1 as s, (p_partkey * 7919) % 5000 + 1 + p_size as e from part),
    a as (select *, case when s <= max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding) + 2 then 0 else 1 end as fresh from r),
    b as (select *, sum(fresh) over (partition by path order by s, e rows unbounded preceding) as island from a)
    select path, min(s)::bigint as start, max(e)::bigint as "end" from b group by path, island""",
)
def merged_ranges(spark, sf_dir):
    start = F.col("p_partkey") * 7919 % 5000 + 1
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), start.alias("start"), (start + F.col("p_size")).alias("end"))
    return O.merge_ranges(r, ["path"])


@query(
    "tree_diff",
    """with b as (select doc_id, 'f' || doc_id as path, md5(text) as h from documents where doc_id % 7 <> 0), a as (select case when doc_id % 11 = 0 then 'moved' || doc_id else 'f' || doc_id end as path, doc_id,
      md5(case when doc_id % 5 = 0 then text || ' more' else text end) as h from documents where doc_id % 6 <> 0)
    select coalesce(a.path, b.path) as path, case when b.h is null then 'added' when a.h is null then 'deleted' else 'modified' end as type from b full join a on a.path = b.path where a.h is distinct from b.h""",
)
def tree_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    before = d.where("doc_id % 7 <> 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    after = d.where("doc_id % 6 <> 0").select(name.alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("content"))
    out = D.diff_files(before, after)
    # a rename counts as its two halves here, as plain SQL has them
    return out.select("path", F.when(F.col("type") == "renamed", "added").otherwise(F.col("type")).alias("type")).unionByName(out.where("type = 'renamed'").select(F.col("from").alias("path"), F.lit("deleted").alias("type")))


SYMBOL_DIFF = """b as (select p_brand as file, p_type as name, p_type[1:3] as kind, max_by(p_name, p_partkey) as sig from part where p_partkey % 3 <> 0 group by all),
a as (select p_brand as file, p_type as name, p_type[1:3] as kind, max_by(p_name, p_partkey) as sig from part where p_partkey % 5 <> 0 group by all),
d as (select file, name, kind, case when b.sig is null then 'added' when a.sig is null then 'removed' else 'signature_changed' end as change, b.sig as old, a.sig as new from b full join a using (file, name, kind) where a.sig is distinct from b.sig)"""


def versions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.substring("p_type", 1, 3).alias("kind"), F.col("p_name").alias("signature"), F.col("p_partkey").alias("ordinal"))
    return p.where("ordinal % 3 <> 0"), p.where("ordinal % 5 <> 0")


@query("symbol_diff", f"with {SYMBOL_DIFF} select file, name, kind, change, case when change = 'signature_changed' then old end as \"from\", case when change = 'signature_changed' then new end as \"to\" from d")
def symbol_diff(spark, sf_dir):
    return D.diff_symbols(*versions(spark, sf_dir)).drop("fingerprint")


@query("symbol_change_counts", f"with {SYMBOL_DIFF} select file, sum((change = 'added')::int)::bigint as added, sum((change = 'removed')::int)::bigint as removed, sum((change = 'signature_changed')::int)::bigint as resigned from d group by file")
def symbol_change_counts(spark, sf_dir):
    return D.symbol_counts(D.diff_symbols(*versions(spark, sf_dir)))


WORDS_OF = "list_distinct(regexp_split_to_array(content, '[^\\p{L}\\p{N}_]+'))"


@query(
    "impact_radius",
    f"""with n as (select 'function::' || w as symbol, w, 'src0/0.en' as own from (select unnest(['the', 'that', 'oner', 'eaou', 'reanin', 'que', 'ein']) as w)),
    c as (select path, unnest({WORDS_OF}) as w from ({FILES})) select distinct symbol, path from c join n using (w) where path <> own""",
)
def impact_radius(spark, sf_dir):
    words = ["the", "that", "oner", "eaou", "reanin", "que", "ein"]
    changes = spark.createDataFrame([("src0/0.en", w, "function", "removed") for w in words], "file string, name string, kind string, change string")
    return D.impact(changes, files(spark, sf_dir))


@query(
    "symbol_sections",
    """with k as (select ['function', 'struct', 'class', 'enum', 'trait', 'interface', 'module', 'method', 'constant', 'type_alias'] as ks)
    select p_brand as file, (ks[(p_partkey % 10) + 1]) as kind, count(*) as symbols from part, k where p_partkey % 10 <> 9 group by all""",
)
def symbol_sections(spark, sf_dir):
    g = U.symbol_graph(symbols(spark, sf_dir), ["file"])
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.size(c).cast("long").alias("symbols")) for k, c in L.SYMBOL_SECTIONS.items())))
    return g.select("file", pairs.alias("x")).select("file", "x.kind", "x.symbols").where("symbols > 0")


DISTANCE = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1] - p[2])::double * (p[1] - p[2])::double)))"


@query("nearest_vectors", f"select e.vec_id as id, round({DISTANCE}, 5) as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {DISTANCE}, e.vec_id limit 50")
def nearest_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id = 0").first()["vector"]
    return V.nearest(e, q).select("id", F.round("distance", 5).alias("distance"))


@query(
    "vector_file_scores",
    f"""with s as (select e.vec_id // 10 as path, label % 2 as kind, 1 / (1 + {DISTANCE}) as sim from embeddings e, (select embedding from embeddings where vec_id = 0) q),
    b as (select path, coalesce(max(sim) filter (kind = 0), 0) as chunk_sim, coalesce(max(sim) filter (kind = 1), 0) as symbol_sim from s group by path)
    select path, round(chunk_sim, 5) as chunk_sim, round(symbol_sim, 5) as symbol_sim, round(0.6 * chunk_sim + 0.4 * symbol_sim, 5) as combined from b""",
)
def vector_file_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    m = e.select(F.expr("vec_id div 10").alias("path"), (F.col("label") % 2).alias("kind"), V.similarity(V.distance(F.col("embedding"), F.lit(q))).alias("similarity"))
    out = V.file_scores(m.where("kind = 0"), m.where("kind = 1"))
    return out.select("path", *(F.round(c, 5).alias(c) for c in ("chunk_sim", "symbol_sim", "combined")))


@query(
    "file_state_changes",
    """with c as (select doc_id as path, case when doc_id % 7 = 0 then md5(text || '!') else md5(text) end as h from documents where doc_id % 11 <> 0), s as (select doc_id as path, md5(text) as h from documents where doc_id % 13 <> 0)
    select path, case when c.h is null then 'removed' when c.h = s.h then 'unchanged' else 'changed' end as status from c full join s using (path)""",
)
def file_state_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", F.lit(0).alias("mtime"))
    now = F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = d.where("path % 11 <> 0").withColumn("content_hash", X.content_hash(now))
    return V.detect_changes(current, d.where("path % 13 <> 0").withColumn("content_hash", X.content_hash(F.col("text"))))


@query("file_chunks")
def file_chunks(spark, sf_dir):
    return V.chunk_files(files(spark, sf_dir)).select("path", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_hash")


@query(
    "pruned_changes",
    """with c as (select o_orderkey % 50 as task, o_orderkey::varchar as path, (o_totalprice::bigint % 997) / 1000.0::double as score, o_custkey as cost from orders),
    r as (select *, sum(cost) over w as total, row_number() over w as rn from c window w as (partition by task order by score desc, path rows unbounded preceding)) select task, path from r where rn = 1 or total <= 20000""",
)
def pruned_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("task"), F.col("o_orderkey").cast("string").alias("path"), (F.rint("o_totalprice").cast("long") % 997 / 1000.0).alias("score"), F.col("o_custkey").alias("cost"))
    return B.keep_prefix(o, ["task"], "cost", F.lit(20000)).select("task", "path")
