"""Queries of operators that the driver's tables do not reach as they are: scores, ranges, cuts and diffs over derived rows,
and classification, layouts, overlaps and pruning over small inline rows, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contextloom import lexicon as L
from contextloom.functions import text as X
from contextloom.operators import budget as B
from contextloom.operators import bundle as U
from contextloom.operators import conversation as C
from contextloom.operators import diff as D
from contextloom.operators import documents as T
from contextloom.operators import focus as O
from contextloom.operators import inspect as I
from contextloom.operators import render as R
from contextloom.operators import scoring as S
from contextloom.operators import vector as V
from contextloom.plans import commands as P
from contextloom.queries import FILES, LINES, SQL, allocate_modes, files, query, symbols, table, turns
from contextloom.shipping import ship
from contextloom.sources import analyzers as A


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of inline rows."""
    one = lambda x: "null" if x is None else "[" + ", ".join(map(one, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else f"{x}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


# Lines with the class, confidence (in hundredths) and polarity that the rules give them.
SAID = [
    ("We must keep the cache small, it grows.", "constraint", 90, "positive"),
    ("Files must not be larger than one page", "constraint", 70, "negative"),
    ("never call the parser twice", "constraint", 70, "negative"),
    ("In the end, as was said before by all of the people at the long table, tests should pass and always run", "constraint", 50, "positive"),
    ("We decided to go with parquet", "decision", 90, None),
    ("After lunch, the plan was confirmed", "decision", 50, None),
    ("we will ship it and we are using arrow", "decision", 80, None),
    ("Which port is it?", "open_question", 60, None),
    ("Should we keep it?", "constraint", 60, "positive"),
    ("mustard is yellow", None, None, None),
    ("nothing to see", None, None, None),
]


@query("classified_lines", values("text, classification, confidence, polarity", [r for r in SAID if r[1]]))
def classified_lines(spark, sf_dir):
    ship(spark)
    found = spark.createDataFrame([(r[0],) for r in SAID], "text string").withColumn("f", C.classify(F.col("text"))).where("f is not null")
    return found.select("text", "f.classification", F.round(F.col("f.confidence").cast("double") * 100).cast("long").alias("confidence"), "f.polarity")


SHAPES = [
    (1, "## User\nhello\n\n## Assistant\nhi", "markdown_heading"),
    (2, "[10:30] one\n[10:31] two", "timestamped"),
    (3, "User: hello\n\nAssistant: hi", "blank_line"),
    (4, "", "blank_line"),
    (5, "\n" * 60 + "  ## USER\nsaid", "markdown_heading"),
    (6, "x\n" * 50 + "## User\nlate", "blank_line"),
]


@query("conversation_layouts", values("id, layout", [(a, c) for a, _, c in SHAPES]))
def conversation_layouts(spark, sf_dir):
    ship(spark)
    return spark.createDataFrame([r[:2] for r in SHAPES], "id long, text string").select("id", C.layout(F.col("text")).alias("layout"))


SPOKEN = [
    (2, 0, None, ["one", "more"]),
    (2, 1, None, ["two"]),
    (3, 0, "user", ["hello", "there"]),
    (3, 1, "assistant", ["hi"]),
    (3, 2, None, ["quoted"]),
]


@query("spoken_turns", values("conv_id, turn_index, speaker, said", [(a, b, c, "|".join(d)) for a, b, c, d in SPOKEN]))
def spoken_turns(spark, sf_dir):
    ship(spark)
    rows = [(2, "lost\n[10:30] one\nmore\n\n[9:05] two\n"), (3, "User: hello\nthere\n\n\nassistant: hi\n\n> quoted\n")]
    return C.parse_turns(spark.createDataFrame(rows, "conv_id long, content string")).select("conv_id", "turn_index", "speaker", F.array_join("lines", "|").alias("said"))


@query(
    "parsed_turns",
    r"""with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as turn_index, turn = max(turn) over (partition by conv_id) as last from conversations)
    select conv_id, turn_index, case when role = 'user' then 'user' else 'assistant' end as speaker,
      regexp_replace(regexp_replace(text, '\s+(\n)', '\1', 'g'), '\s+$', '') || case when last then '' else chr(10) end as text from t""",
)
def parsed_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("\n"), F.col("text"), F.lit("\n"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "\n").alias("content"))
    return C.parse_turns(whole).select("conv_id", "turn_index", "speaker", F.array_join("lines", "\n").alias("text"))


@query(
    "mode_counts",
    f"with a as ({SQL['allocate_modes']}) select task_id, mode, count(*) as files, sum(tokens_used)::bigint as tokens from a group by all",
)
def mode_counts(spark, sf_dir):
    return U.mode_counts(allocate_modes(spark, sf_dir), ["task_id"])


@query(
    "included_files",
    f"with a as ({SQL['allocate_modes']}) select task_id, mode <> 'skipped' as shown, count(*) as files from a group by all",
)
def included_files(spark, sf_dir):
    """All of these files share a token with their task, so their score is above 0 (a rounding to 0 needs 4,000 tokens)."""
    a = allocate_modes(spark, sf_dir).withColumn("score", F.lit(0.1))
    shown = U.included(U.output_files(a)).groupBy("task_id").agg(F.count("*").alias("files")).select("task_id", F.lit(True).alias("shown"), "files")
    left = U.skipped_warning(a, ["task_id"]).select("task_id", F.lit(False).alias("shown"), F.col("skipped").alias("files"))
    return shown.unionByName(left)


WORN = [
    (1, "## The User's  Note!", "the users note"),
    (2, "USER: keep src/a-b.rs, v_1", "keep src/a-b.rs v_1"),
    (3, "assistant: # heading", "heading"),
    (4, "> quoted: Text", "quoted text"),
    (5, "[10:30:01] Started", "started"),
    (6, "", ""),
]


@query("normalize_without_prefix", values("id, norm", [(a, c) for a, _, c in WORN]))
def normalize_without_prefix(spark, sf_dir):
    ship(spark)
    return spark.createDataFrame([r[:2] for r in WORN], "id long, text string").select("id", X.normalize(F.col("text")).alias("norm"))


def sql_cut(column: str, most: int) -> str:
    return f"{column}[1:(select max(n) from range(0, {most + 1}) t(n) where strlen({column}[1:n]) <= {most})]"


@query("cut_texts", f"select doc_id, {sql_cut('text', 37)} as opening, case when text <> '' then {sql_cut('text', 300)} end as summary from documents")
def cut_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_bytes(F.col("text"), 37).alias("opening"), B.raw_summary(F.col("text")).alias("summary"))


@query(
    "blended_scores",
    """with l as (select l_orderkey, l_linenumber, (l_partkey % 1000) / 1000::double as score, case when l_suppkey % 3 > 0 then (l_suppkey % 100) / 100::double end as vec, l_quantity::bigint % 5 as mentions, l_discount * 10 as confidence from lineitem)
    select l_orderkey, l_linenumber, round(case when vec is null then score else round((0.7::double * score + 0.3::double * vec) * 10000) / 10000 end, 6) as hybrid,
      round(case when mentions = 0 then score else least(1, score * (1 + 0.15 * ln(1 + mentions) * confidence)) end, 6) as boosted from l""",
)
def blended_scores(spark, sf_dir):
    score, vec = F.col("l_partkey") % 1000 / 1000.0, F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 100 / 100.0)
    mentions = F.col("l_quantity").cast("long") % 5
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.hybrid_score(score, vec), 6).alias("hybrid"), F.round(S.boost(score, mentions, F.col("l_discount") * 10), 6).alias("boosted")
    )


CHANGED = """c as (select o_orderkey as path, case o_orderkey % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'deleted' else 'renamed' end as type, o_custkey % 90 as added_lines, o_custkey % 70 as removed_lines from orders)"""
SIGNED = """m as (select l_orderkey as file, case l_linenumber % 3 when 0 then 'added' when 1 then 'removed' else 'signature_changed' end as change, l_linenumber from lineitem),
n as (select file, count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'signature_changed') as resigned from m group by file)"""


def changed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("added", "modified", "deleted", "renamed")))
    return o.select(F.col("o_orderkey").alias("path"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("type"), (F.col("o_custkey") % 90).alias("added_lines"), (F.col("o_custkey") % 70).alias("removed_lines"))


def signed(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("added", "removed", "signature_changed")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.get(kinds, (F.col("l_linenumber") % 3).cast("int")).alias("change"))


@query(
    "change_scores",
    f"""with {CHANGED}, {SIGNED}, a as (select l_orderkey as path, count(*) as affected from lineitem where l_quantity > 40 group by 1),
    j as (select path, type, added_lines + removed_lines as churn, coalesce(added, 0) as ad, coalesce(removed, 0) as re, coalesce(resigned, 0) as si, coalesce(affected, 0) as af from c left join n on n.file = c.path left join a using (path)),
    x as (select max(churn) as mc, max(af) as ma from j)
    select path, round(round((0.3::double * (churn / mc) + 0.3::double * least(1, 0.2::double * ad + 0.3::double * re + 0.5::double * si) + 0.2::double * (af / ma) + 0.2::double * (case when type = 'deleted' then 0.5 else 1 end)) * 10000) / 10000, 4) as score from j, x""",
)
def change_scores(spark, sf_dir):
    reach = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("affected"))
    df = changed(spark, sf_dir).withColumn("churn", F.col("added_lines") + F.col("removed_lines"))
    return D.score_changes(df, D.symbol_counts(signed(spark, sf_dir)), reach).select("path", F.round("score", 4).alias("score"))


@query(
    "diff_stats",
    f"""with {CHANGED}, {SIGNED} select count(*) filter (type = 'added') as files_added, count(*) filter (type = 'modified') as files_modified, count(*) filter (type = 'deleted') as files_deleted, count(*) filter (type = 'renamed') as files_renamed,
    sum(added_lines)::bigint as lines_added, sum(removed_lines)::bigint as lines_removed, (select sum(added)::bigint from n) as symbols_added, (select sum(removed)::bigint from n) as symbols_removed, (select sum(resigned)::bigint from n) as symbols_changed from c""",
)
def diff_stats(spark, sf_dir):
    return D.diff_stats(changed(spark, sf_dir), signed(spark, sf_dir))


@query(
    "impact_files",
    f"""with n as (select unnest(['the', 'que', 'ein', 'and']) as w),
    c as (select path, unnest(list_distinct(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_]+'))) as w from ({FILES}))
    select 'function::' || w as symbol, count(distinct path) as files, min(path) as first from c join n using (w) group by all""",
)
def impact_files(spark, sf_dir):
    changes = spark.createDataFrame([("none", w, "function", "signature_changed") for w in ("the", "que", "ein", "and")], "file string, name string, kind string, change string")
    return D.references(D.impact(changes, files(spark, sf_dir))).select("symbol", F.size("files").cast("long").alias("files"), F.col("files")[0].alias("first"))


# Two tasks, three files, their symbols, one dependency and one recent file, with the scores that the four parts add up to.
TASKS = [(1, "parse config quickly"), (2, "serde parser")]
TREE = [("a.rs", "fn main() { parse(); } use serde;"), ("b.rs", "config config parser"), ("c.rs", "nothing here")]
NAMES = [("a.rs", "parseConfig"), ("b.rs", "HTTPParser"), ("c.rs", "quickly_done")]


@query(
    "whole_scores",
    values(
        "task_id, path, score",
        [(1, "a.rs", 0.5333), (1, "b.rs", 0.1333), (1, "c.rs", 0.1), (2, "a.rs", 0.45), (2, "b.rs", 0.35)],
    ),
)
def whole_scores(spark, sf_dir):
    ship(spark)
    make = spark.createDataFrame
    recent = make([("a.rs", 1.0), ("b.rs", 0.0)], "path string, recency double")
    return S.score_files(make(TASKS, "task_id long, task string"), make(TREE, "path string, content string"), make(NAMES, "file string, name string"), recent, make([("serde",)], "name string"))


@query("vector_only_files", values("task_id, path, found", [(1, "a.rs", True), (1, "b.rs", True), (1, "c.rs", True), (2, "b.rs", True), (2, "c.rs", True)]))
def vector_only_files(spark, sf_dir):
    """Files in the context of a task, whether words or only a vector find them."""
    ship(spark)
    make = spark.createDataFrame
    tree = make([("a.rs", "parse config"), ("b.rs", "parser"), ("c.rs", "nothing here")], "path string, content string")
    symbols_ = make([("a.rs", "main", "function", "fn main()", 1, 1, "public")], "file string, name string, kind string, signature string, start_line int, end_line int, visibility string")
    near = make([(1, "b.rs", 0.5), (1, "c.rs", 0.4), (2, "c.rs", 0.9), (2, "gone.rs", 0.9)], "task_id long, path string, combined double")
    out = P.build(make(TASKS, "task_id long, task string"), tree, symbols_, vectors=near)
    return out.select("task_id", "path", (F.col("mode") != "skipped").alias("found"))


@query(
    "focus_ranges",
    """with f as (select p_brand as path, 30 + (min(p_partkey) % 10)::int as n_lines from part group by 1), s as (select p_brand as path, case when p_partkey % 5 = 0 then 'alphaBeta' else 'gamma' end as name, (p_partkey % 29 + 1)::int as a, (p_partkey % 29 + 1 + p_partkey % 3)::int as z from part where p_partkey % 50 < 6),
    h as (select t.task_id, s.path, greatest(a - 5, 1) as s, least(z + 5, n_lines) as e from s join f using (path), (select 1::bigint as task_id, 'alphaBeta' as name) t where s.name = t.name),
    r as (select * from h union all select 1, path, 1, least(10, n_lines) from f where path in (select path from s)),
    a as (select *, case when s <= max(e) over (partition by task_id, path order by s, e rows between unbounded preceding and 1 preceding) + 2 then 0 else 1 end as fresh from r),
    b as (select *, sum(fresh) over (partition by task_id, path order by s, e rows unbounded preceding) as island from a)
    select task_id, path, min(s)::bigint as start, max(e)::bigint as "end" from b group by task_id, path, island""",
)
def focus_ranges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sized = p.groupBy(F.col("p_brand").alias("path")).agg((F.min("p_partkey") % 10 + 30).cast("int").alias("n_lines"))
    start = (F.col("p_partkey") % 29 + 1).cast("int")
    own = p.where("p_partkey % 50 < 6").select(
        F.col("p_brand").alias("file"), F.when(F.col("p_partkey") % 5 == 0, "alphaBeta").otherwise("gamma").alias("name"), start.alias("start_line"), (start + F.col("p_partkey") % 3).cast("int").alias("end_line")
    )
    wanted = spark.createDataFrame([(1, "alpha"), (1, "beta")], "task_id long, token string")
    pairs = sized.select(F.lit(1).cast("long").alias("task_id"), "path")
    return O.relevant_ranges(sized, own, wanted, pairs).select("task_id", "path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


BUNDLE = [
    ("keep.rs", 0.1, "full", 50, None, None),
    ("big.rs", 0.9, "full", 2600, ["fn big() (lines 1-9)"], None),
    ("part.rs", 0.8, "focused", 300, None, None),
    ("note.md", 0.7, "summary_only", 5, None, "A short note."),
    ("last.rs", 0.2, "skipped", 0, None, None),
]


@query(
    "pruned_bundle",
    values("path, mode, tokens_used", [("keep.rs", "full", 50), ("big.rs", "signature_only", 5), ("part.rs", "full", 300), ("note.md", "summary_only", 3), ("last.rs", "skipped", 0)]),
)
def pruned_bundle(spark, sf_dir):
    """2000 declared, strict: 250 for a task of 1000 bytes, 300 for the summary, 400 for memory leave 1050; 50 are kept."""
    ship(spark)
    df = spark.createDataFrame(BUNDLE, "path string, score double, mode string, tokens_used long, signatures array<string>, summary string")
    return P.prune(df, 2000, ["keep.rs"], task="x" * 1000, strict=True).select("path", "mode", "tokens_used")


@query("deleted_tokens", values("path, type, tokens", [("gone.rs", "deleted", 0), ("new.rs", "added", 10), ("same.rs", "modified", 5)]))
def deleted_tokens(spark, sf_dir):
    ship(spark)
    tree = lambda rows: spark.createDataFrame(rows, "path string, content string")
    none = spark.createDataFrame([], "file string, name string, kind string, signature string, ordinal int")
    out = P.diff(tree([("gone.rs", "a" * 400), ("same.rs", "x\ny\n")]), tree([("new.rs", "b" * 40), ("same.rs", "x\nz\n" + "w" * 16)]), none, none)
    return out["files"].select("path", "type", "tokens")


LINED = [(1, "one\x0ctwo three\u0085four\nfive\r\nsix\n")]


@query("chunk_lines", values("path, chunk_index, start_line, end_line, n_lines", [("1", 0, 1, 3, 3)]))
def chunk_lines(spark, sf_dir):
    """Only newlines end lines: form feeds, U+0085 and U+2028 stay within them."""
    ship(spark)
    df = spark.createDataFrame([(str(a), b) for a, b in LINED], "path string, content string")
    out = V.chunk_files(df)
    return out.select("path", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_line", "end_line")), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query(
    "vector_neighbours",
    """with q as (select vec_id as query, embedding as v from embeddings where vec_id % 20 = 0),
    d as (select query, vec_id as id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: (p[1] - p[2])::double * (p[1] - p[2])::double))) as distance from embeddings e, q)
    select query, id, round(distance, 5) as distance, row_number() over (partition by query order by distance, id) as rank from d qualify rank <= 50""",
)
def vector_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = V.nearest_of_each(e, e.where("id % 20 = 0").select(F.col("id").alias("query"), "vector"))
    return out.select("query", "id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


MADE = "select conv_id, turn as turn_index, case when turn % 3 = 0 then 'decision' when turn % 3 = 1 then 'open_question' else 'constraint' end as classification, text, case when turn % 4 = 1 then turn + 2 end as resolved_by from conversations"


def made_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "decision").when(F.col("turn") % 3 == 1, "open_question").otherwise("constraint")
    return c.select("conv_id", F.col("turn").alias("turn_index"), kind.alias("classification"), "text", F.when(F.col("turn") % 4 == 1, F.col("turn") + 2).alias("resolved_by"))


@query("items_since", f"with i as ({MADE}) select conv_id, turn_index, classification, case when resolved_by >= 4 then resolved_by end as resolved_by from i where turn_index >= 4")
def items_since(spark, sf_dir):
    return C.since(made_items(spark, sf_dir), 4).select("conv_id", "turn_index", "classification", "resolved_by")


@query(
    "truncated_memory",
    f"""with i as ({MADE}), s as (select *, case when classification = 'open_question' then case when resolved_by is not null then 1 else 2 end when classification = 'constraint' then 3 else 4 end as step, strlen(text) as b, (turn_index % 7) / 10::double as conf from i),
    w as (select *, sum(b) over (partition by conv_id) as total, coalesce(sum(b) over (partition by conv_id order by step range between unbounded preceding and 1 preceding), 0) as earlier,
      coalesce(sum(b) over (partition by conv_id order by step, case when step > 2 then conf else 0 end, turn_index, text rows between unbounded preceding and 1 preceding), 0) as each from s)
    select conv_id, turn_index, classification from w where not floor((total - case when step <= 2 then earlier else each end) / 4) > 60""",
)
def truncated_memory(spark, sf_dir):
    items = made_items(spark, sf_dir).withColumn("confidence", F.col("turn_index") % 7 / 10.0)
    return B.truncate_memory(items, ["conv_id"], F.lit(60)).select("conv_id", "turn_index", "classification")


@query("file_mentions", values("path, mentions, confidence", [("src/a.rs", 2, 0.45), ("lib/src/b.rs", 2, 0.35), ("b.rs", 2, 0.35)]))
def file_mentions(spark, sf_dir):
    ship(spark)
    make = spark.createDataFrame
    found = C.mentions(make([("src/a.rs",), ("lib/src/b.rs",), ("b.rs",), ("other.rs",)], "path string"), make([("a.rs", 1), ("src/a.rs", 3), ("b.rs", 2), ("src/b.rs", 5), ("zzz.rs", 7)], "file string, turn_index long"))
    strength = C.mention_strength(found, make([(1, 0.4), (1, 0.2), (2, 0.7), (3, 0.3), (6, 0.9)], "turn_index long, confidence double"))
    return strength.select("path", "mentions", F.round("confidence", 6).alias("confidence"))


@query(
    "fences",
    values("path, fence", [("a.rs", "rust"), ("b.tsx", "typescript"), ("x.y.py", "python"), ("Makefile", ""), ("c.hpp", "cpp"), ("d.exs", "elixir"), ("e.unknown", "")]),
)
def fences(spark, sf_dir):
    ship(spark)
    names = ["a.rs", "b.tsx", "x.y.py", "Makefile", "c.hpp", "d.exs", "e.unknown"]
    return spark.createDataFrame([(n,) for n in names], "path string").select("path", R.fence(F.col("path")).alias("fence"))


@query(
    "merged_memories",
    """with c as (select conv_id // 3 as topic, conv_id, turn, text, row_number() over (partition by conv_id, text order by turn) as n from conversations),
    t as (select conv_id // 3 as topic, conv_id, max(turn) + 1 as turns from conversations group by all),
    s as (select topic, conv_id, coalesce(sum(turns) over (partition by topic order by conv_id rows between unbounded preceding and 1 preceding), 0) as shift from t),
    m as (select c.topic, c.conv_id, (turn + shift)::bigint as turn_index, md5(text) as fingerprint from c join s using (topic, conv_id))
    select topic, turn_index, fingerprint from m qualify row_number() over (partition by topic, fingerprint order by turn_index) = 1""",
)
def merged_memories(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    topic = F.expr("conv_id div 3").alias("topic")
    items = c.select(
        topic, "conv_id", F.col("turn").alias("turn_index"), F.lit(0).alias("line_no"), "text", F.md5("text").alias("fingerprint"), F.lit("constraint").alias("classification"), F.lit(None).cast("long").alias("resolved_by")
    )
    counts = c.groupBy(topic, "conv_id").agg((F.max("turn") + 1).alias("turn_count")).withColumn("ordinal", F.col("conv_id"))
    return C.merge(items, counts, ["topic"], "ordinal", "conv_id").select("topic", "turn_index", "fingerprint")


EDGE = "[\"''`()\\[\\],;]+"
STAGES = f"""l as ({LINES}), w as (select conv_id, turn_index, line_no, generate_subscripts(ws, 1) as word_no, unnest(ws) as word from (select *, regexp_split_to_array(replace(line, 'tion ', '.md '), '\\s+') as ws from l)),
m as (select *, regexp_replace(regexp_replace(word, '^{EDGE}', ''), '{EDGE}$', '') as file from w),
k as (select * from m where regexp_full_match(file, '[\\p{{L}}\\p{{N}}_\\-./]+\\.({'|'.join(L.MARKER_EXTENSIONS)})')),
s as (select conv_id, turn_index as start_turn, list_reduce(list(file order by line_no, word_no), lambda a, f: case when contains(a, f) then a else a || ', ' || f end) as label from k group by all),
c as (select conv_id, max(turn) + 1 as turn_count from conversations where text <> '' group by 1),
i as (select conv_id, 0::bigint as start_turn, 'Initial' as label from c left join (select conv_id, min(start_turn) as first from s group by 1) using (conv_id) where first is null or first > 0),
e as (select conv_id, start_turn, label from s union all select conv_id, start_turn, label from i),
staged as (select conv_id, row_number() over o - 1 as stage_index, label, start_turn, coalesce(lead(start_turn) over o - 1, greatest(turn_count - 1, 0)) as end_turn from e join c using (conv_id) window o as (partition by conv_id order by start_turn))"""


@query("stages", f"with {STAGES} select * from staged")
def conversation_stages(spark, sf_dir):
    """Stages of conversations in which words that end in the last letters of words stand for paths."""
    t = turns(spark, sf_dir)
    marks = t.select("conv_id", "turn_index", F.transform("lines", lambda x: F.replace(x, F.lit("tion "), F.lit(".md "))).alias("lines"))
    counts = t.where(F.size("lines") > 0).groupBy("conv_id").agg((F.max("turn_index") + 1).alias("turn_count"))
    return C.stages(C.extract_markers(marks), counts)


@query("items_by_stage", f"with {STAGES}, it as ({MADE}) select conv_id, stage_index, count(*) as items, min(turn_index) as first from it join staged using (conv_id) where turn_index between start_turn and end_turn group by all")
def items_by_stage(spark, sf_dir):
    held = C.stage_items(made_items(spark, sf_dir), conversation_stages(spark, sf_dir))
    return held.groupBy("conv_id", "stage_index").agg(F.count("*").alias("items"), F.min("turn_index").alias("first"))


def small_build(spark):
    ship(spark)
    make = spark.createDataFrame
    tasks = make([(1, "parse config quickly"), (2, "serde")], "task_id long, task string")
    tree = make([("a.rs", "use serde;\nfn parse() {}\n"), ("b.rs", "config parser")], "path string, content string")
    own = make([("a.rs", "parse", "function", "fn parse()", 2, 2, "private"), ("b.rs", "Config", "struct", "struct Config", 1, 1, "public")], "file string, name string, kind string, signature string, start_line int, end_line int, visibility string")
    deps = make([("serde", "1.0", ["derive"]), ("tokio", None, [])], "name string, version string, features array<string>")
    return tasks, own, deps, P.build(tasks, tree, own, deps)


def small_documents(spark):
    tasks, own, deps, built = small_build(spark)
    shares = tasks.select("task_id", B.share_budget(F.lit(8000), F.col("task")).alias("share"))
    return T.context_documents(tasks, built, own, shares, F.lit("- a.rs: parses"), F.lit("root/\n"), deps)


@query(
    "context_documents",
    values(
        "task_id, schema_version, files, graph, dependencies, code, warned",
        [(1, "0.2", "a.rs:full,b.rs:full", 0, "serde 1.0", 6155, False), (2, "0.2", "a.rs:full", 0, "serde 1.0", 6159, False)],
    ),
)
def context_documents(spark, sf_dir):
    """8000 declared make 8800; of them 5 or 1 for the task, 440 for the summary, 1760 for memory and 440 for safety."""
    d = small_documents(spark)
    named = lambda c, f: F.array_join(F.transform(c, f), ",")
    return d.select(
        "task_id", "schema_version", named("relevant_files", lambda f: F.concat_ws(":", f["path"], f["inclusion_mode"])).alias("files"), F.size("symbol_graph.functions").cast("long").alias("graph"),
        named("dependency_graph", lambda x: F.concat_ws(" ", x["name"], x["version"])).alias("dependencies"), F.col("token_budget.code").alias("code"), F.col("warnings").isNotNull().alias("warned"),
    )


@query(
    "context_markdown",
    values("task_id, opening, n_parts, fenced", [(1, "# Context Bundle", 6, 3), (2, "# Context Bundle", 6, 2)]),
)
def context_markdown(spark, sf_dir):
    """Five sections and the title's rule; one block of code for the tree and one for each file in full."""
    text = T.context_markdown(small_documents(spark))
    count = lambda part: F.regexp_count("text", F.lit(part))
    return text.select("task_id", F.split("text", "\n")[0].alias("opening"), count("(?m)^##? ").cast("long").alias("n_parts"), (count("(?m)^```") / 2).cast("long").alias("fenced"))


@query(
    "diff_markdown",
    """select '# Diff: v1 -> v2' as title, 9::bigint as stats, '| gone.rs | Deleted | 0 | 1 |' as first, '- REMOVED: `old_name` (function)' as symbol, '**All affected files (1):**' as affected""",
)
def diff_markdown(spark, sf_dir):
    ship(spark)
    tree = lambda rows: spark.createDataFrame(rows, "path string, content string")
    own = lambda rows: spark.createDataFrame(rows, "file string, name string, kind string, signature string, ordinal int")
    d = P.diff(tree([("gone.rs", "x"), ("same.rs", "fn old_name() {}\n"), ("user.rs", "old_name();")]), tree([("same.rs", "fn new_name() {}\n"), ("user.rs", "old_name();")]), own([("same.rs", "old_name", "function", "fn old_name()", 0)]), own([("same.rs", "new_name", "function", "fn new_name()", 0)]))
    text = T.diff_markdown(d["files"], d["symbols"], d["references"], d["stats"], "v1", "v2").select(F.split("text", "\n").alias("l"))
    line = lambda start: F.filter("l", lambda x: F.startswith(x, F.lit(start)))
    return text.select(
        F.col("l")[0].alias("title"), F.size(F.filter("l", lambda x: x.rlike("^\\| (Files|Symbols|Total) "))).cast("long").alias("stats"), line("| gone")[0].alias("first"), line("- REMOVED")[0].alias("symbol"), line("**All")[0].alias("affected")
    )


@query(
    "index_counters",
    """with c as (select doc_id as path, case when doc_id % 7 = 0 then md5(text || '!') else md5(text) end as h from documents where doc_id % 11 <> 0), s as (select doc_id as path, md5(text) as h from documents where doc_id % 13 <> 0),
    t as (select path, case when c.h is null then 'removed' when c.h = s.h then 'unchanged' else 'changed' end as status from c full join s using (path))
    select count(*) filter (status = 'changed') as files_indexed, count(*) filter (status = 'removed') as files_removed, count(*) filter (status = 'unchanged') as files_unchanged,
      (select count(*) from t, range(0, 3) x(i) where status = 'changed') as chunks_embedded, 0::bigint as symbols_embedded from t""",
)
def index_counters(spark, sf_dir):
    from contextloom.queries import file_state_changes

    status = file_state_changes(spark, sf_dir)
    return V.index_stats(status, status.select("path", F.explode(F.sequence(F.lit(0), F.lit(2)))))


MADE_FILES = "select o_orderkey % 50 as task_id, o_orderkey::varchar as path, (o_custkey % 700) / 1000::double as score, ['full', 'focused', 'signature_only', 'summary_only', 'skipped'][(o_orderkey % 5) + 1] as mode, o_custkey % 300 as tokens_used from orders"


def made_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mode = F.get(F.array(*map(F.lit, B.MODES)), (F.col("o_orderkey") % 5).cast("int"))
    return o.select((F.col("o_orderkey") % 50).alias("task_id"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_custkey") % 700 / 1000.0).alias("score"), mode.alias("mode"), (F.col("o_custkey") % 300).alias("tokens_used"))


@query(
    "audited_files",
    f"""with f as ({MADE_FILES}) select task_id, {', '.join(f"count(*) filter (mode = '{m}') as {m}" for m in B.MODES)}, sum(tokens_used)::bigint as tokens,
    array_to_string((list(path order by score desc, path))[1:10], ',') as top_paths from f group by task_id""",
)
def audited_files(spark, sf_dir):
    return I.audit(made_files(spark, sf_dir), ["task_id"]).withColumn("top_paths", F.array_join("top_paths", ","))


@query(
    "context_checks",
    f"""with f as (select *, row_number() over (partition by task_id order by path) as rank from ({MADE_FILES})),
    s as (select *, lag(score) over (partition by task_id order by rank) as before from f where mode <> 'skipped'), u as (select task_id, sum(tokens_used) as used from f group by 1)
    select task_id, 'budget' as "check", count(*) as found from u where used > 2000 group by 1 union all select task_id, 'order', count(*) from s where score > before group by 1""",
)
def context_checks(spark, sf_dir):
    f = made_files(spark, sf_dir)
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("path")))  # not by score
    found = I.check_context(f, ["task_id"], budget=f.select("task_id", F.lit(2000).alias("code")).distinct())
    return found.groupBy("task_id", "check").agg(F.count("*").alias("found"))


@query(
    "graph_files",
    """with s as (select p_brand as file, p_partkey % 10 as kind from part), a as (select p_brand as path, ['full', 'summary_only', 'skipped'][(min(p_partkey) % 3) + 1] as mode, (count(*) % 4)::double as score from part group by 1)
    select file, count(*) as symbols from s join a on a.path = s.file where score > 0 and mode = 'summary_only' group by file""",
)
def graph_files(spark, sf_dir):
    mode = F.get(F.array(*map(F.lit, ("full", "summary_only", "skipped"))), (F.min("p_partkey") % 3).cast("int"))
    chosen = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(mode.alias("mode"), (F.count("*") % 4).cast("double").alias("score"))
    return U.graph_symbols(symbols(spark, sf_dir), chosen).groupBy("file").agg(F.count("*").alias("symbols"))


NAMED = "regexp_replace(list_reduce(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b), '[^A-Za-z0-9]+', '', 'g')"
KINDS = "['function', 'struct', 'class', 'enum', 'trait', 'interface', 'module', 'method', 'constant', 'type_alias'][(p_partkey % 10) + 1]"


@query(
    "symbol_texts",
    f"""with s as (select p_partkey, p_brand as path, {NAMED} as name, {KINDS} as kind, lower(p_type) || ' ' || {NAMED} as signature from part)
    select path || '::' || name || '::' || replace(kind, '_', '') as id, kind || ' ' || name || ' ' || signature as embed_text, sha256(kind || ' ' || name || ' ' || signature) as content_hash from s""",
)
def symbol_texts(spark, sf_dir):
    return V.symbol_records(symbols(spark, sf_dir)).select("id", "embed_text", "content_hash")


@query(
    "signature_costs",
    f"""with s as (select p_brand as path, lower(p_type) || ' ' || {NAMED} || ' (lines ' || (p_partkey % 40 + 1) || '-' || (p_partkey % 40 + 1 + p_size) || ')' as line from part)
    select path, count(*) as lines, sum(strlen(line) // 4)::bigint as cost from s group by path""",
)
def signature_costs(spark, sf_dir):
    return P.signature_costs(symbols(spark, sf_dir)).select("path", F.size("signatures").cast("long").alias("lines"), F.col("signature_cost").alias("cost"))


@query("focused_text", "select 1::bigint as id, '// Lines 1-2\na\nb\n\n// ...\n\n// Lines 4-9\nd\ne\n' as text")
def focused_text(spark, sf_dir):
    """The last range reaches beyond the last line."""
    ship(spark)
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne\n", [(1, 2), (4, 9)])], "id long, content string, ranges array<struct<start: int, end: int>>")
    return df.select("id", O.render_ranges(F.col("content"), F.col("ranges")).alias("text"))


@query("exact_mentions", values("path, marker, turn_index", [("src/a.rs", "src/a.rs", 3)]))
def exact_mentions(spark, sf_dir):
    ship(spark)
    make = spark.createDataFrame
    return C.mentions(make([("src/a.rs",), ("b.rs",)], "path string"), make([("a.rs", 1), ("src/a.rs", 3), ("src/b.rs", 5)], "file string, turn_index long"), loose=False)


@query("used_dependencies", values("name", [("serde",), ("Tokio",)]))
def used_dependencies(spark, sf_dir):
    ship(spark)
    make = spark.createDataFrame
    return U.used_dependencies(make([("serde",), ("Tokio",), ("axum",)], "name string"), make([("use SERDE;",), ("tokio::main and serde",)], "content string")).select("name")


BUNDLES = [(1, '{"task": "x", "relevant_files": []}', "context"), (2, '{"from_ref": "a", "to_ref": "b"}', "diff"), (3, '{"other": 1}', None), (4, "[1]", None), (5, "no json", None)]


@query("bundle_types", values("id, bundle_type", [(a, c) for a, _, c in BUNDLES]))
def bundle_types(spark, sf_dir):
    ship(spark)
    return P.inspect(spark.createDataFrame([r[:2] for r in BUNDLES], "id long, json string")).select("id", "bundle_type")


# Sources in which only brackets, comments and literals tell what is declared, and the symbols that they declare.
SOURCES = [
    ("a.rs", "/* fn no() {} /* fn no2() {} */ */\npub struct Store<T> { a: u8 }\nimpl<T: Into<U>, U> From<U> for Store<T> where T: Clone {\n    pub async fn open(&self,\n        key: &'a str) -> Result<Vec<u8>, E> { let s = \"fn x() {\"; Ok(s) }\n}\npub(crate) const N: [u8; 2] = [1, 2];\nmod inner { pub(super) unsafe fn deep() { fn local() {} } }\n"),
    ("b.go", "package p\nconst (\n\tA = 1 // const no = 1\n\tb, C = 2, 3\n)\ntype (\n\tS struct {\n\t\ta int\n\t}\n\tI interface{ M() }\n\tT = S\n)\nfunc (s *S) Run(a int,\n\tb string) error {\n\treturn nil\n}\n/*\nfunc no() {}\n*/\nfunc help() {}\n"),
    ("c.cpp", "template <class T>\nclass C {\n  int get() const {\n    if (x) {\n      f(a,\n        b);\n    }\n  }\n};\nclass Fwd;\nusing V = int;\nvoid C::go(int a) {\n}\n/* int no() { */\nint add(int a) { return a; }\n"),
    ("d.ts", "// type No = 1\nexport const f = async (\n  a: number,\n): Promise<void> => {\n};\nconst n = 3;\ntype A = string;\nclass B {\n}\nexport class B2 {\n}\n"),
]
DECLARED = [
    ("a.rs", 0, "Store", "struct", "public", "public struct Store", 2, 2),
    ("a.rs", 1, "open", "method", "public", "impl Store < T > :: pub async fn open(& self, key : & 'a str) -> Result < Vec < u8 > , E >", 4, 4),
    ("a.rs", 2, "N", "constant", "crate", "crate const N: [u8 ; 2]", 7, 7),
    ("a.rs", 3, "inner", "module", "private", "private mod inner", 8, 8),
    ("a.rs", 4, "deep", "function", "private", "unsafe fn deep()", 8, 8),
    ("b.go", 0, "A", "constant", "public", "const A", 2, 5),
    ("b.go", 1, "b", "constant", "private", "const b", 2, 5),
    ("b.go", 2, "C", "constant", "public", "const C", 2, 5),
    ("b.go", 3, "S", "struct", "public", "type S struct", 6, 12),
    ("b.go", 4, "I", "interface", "public", "type I interface", 6, 12),
    ("b.go", 5, "Run", "method", "public", "func (s *S) Run(a int,", 13, 16),
    ("b.go", 6, "help", "function", "private", "func help() {}", 20, 20),
    ("c.cpp", 0, "C", "class", "public", "class C {", 2, 9),
    ("c.cpp", 1, "get", "method", "public", "int get() const {", 3, 8),
    ("c.cpp", 2, "V", "type_alias", "public", "using V = int;", 11, 11),
    ("c.cpp", 3, "C::go", "method", "public", "void C::go(int a) {", 12, 13),
    ("c.cpp", 4, "add", "function", "public", "int add(int a) { return a; }", 15, 15),
    ("d.ts", 0, "A", "interface", "private", "type A = string;", 7, 7),
    ("d.ts", 1, "B", "class", "private", "class B {", 8, 9),
    ("d.ts", 2, "B2", "class", "public", "export class B2 {", 10, 11),
    ("d.ts", 3, "f", "function", "public", "export const f = async (", 2, 5),
]


@query("declared_symbols", values("file, ordinal, name, kind, visibility, signature, start_line, end_line", DECLARED))
def declared_symbols(spark, sf_dir):
    ship(spark)
    found = A.extract_symbols(spark.createDataFrame(SOURCES, "path string, content string"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("ordinal", "start_line", "end_line")})
