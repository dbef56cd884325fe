"""Ledgers, transcripts, run logs and streams over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import transcripts as T
from ..operators.sets import flag_dupes
from ..plans.artifacts import accept_artifacts
from ..session import work_dir
from ..sources import frames as FR
from ..sources import ledger as LG
from ..sources import records as R
from ..sources.graphs import read_tables, stage_graphs, write_documents, write_graphs
from ..streaming import streams as ST
from . import derive as D
from .registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)


# --- artifacts ---------------------------------------------------------------------------

def _files(spark, sf):
    """Documents as files; every source is a scope, and sources 0-9 are stored in one scope more."""
    d = D.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    f = LG.hash_column(d, "text")
    return f.select(
        F.col("lang").alias("scope"), F.col("doc_id").alias("file_seq"), "sha256", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "size", "source"
    )


_F = "f AS (SELECT lang AS scope, doc_id AS file_seq, sha256(text) AS sha256, 'd' || doc_id || '.txt' AS name, strlen(text) AS size, source FROM documents)"
# the ledger already holds the files of every third source
_L = "led AS (SELECT scope, sha256, arg_max('/old/' || sha256, file_seq) AS path, arg_max('2025-01-01T00:00:0' || (file_seq % 10) || 'Z', file_seq) AS seen_at, max(size) AS size FROM f WHERE source IN ('src0', 'src3', 'src6', 'src9') GROUP BY 1, 2)"


def _ledger(spark, sf):
    f = _files(spark, sf).where(F.col("source").isin("src0", "src3", "src6", "src9"))
    rec = f.select(
        "scope", "sha256", "name", F.concat(F.lit("/old/"), "sha256").alias("path"), "size", "source",
        F.concat(F.lit("2025-01-01T00:00:0"), (F.col("file_seq") % 10).cast("string"), F.lit("Z")).alias("seen_at"), F.col("file_seq").alias("pos"),
    )
    return rec


def _latest(spark, sf):
    return LG.latest(_ledger(spark, sf))


@query("hashed_files", f"WITH {_F} SELECT file_seq, sha256, size::BIGINT AS size FROM f")
def hashed_files(spark, sf):
    return _files(spark, sf).select("file_seq", "sha256", "size")


@query("ledger_latest", f"WITH {_F}, {_L} SELECT scope, sha256, path, seen_at FROM led")
def ledger_latest(spark, sf):
    return _latest(spark, sf).select("scope", "sha256", "path", "seen_at")


@query("ledger_round_trip", f"WITH {_F} SELECT scope, count(DISTINCT sha256) AS files FROM f GROUP BY 1")
def ledger_round_trip(spark, sf):
    path = work_dir(spark)
    new = accept_artifacts(_files(spark, sf), _latest(spark, sf).where("false"), "/store", "2026-01-01T00:00:00Z")
    LG.append_ledger(new, path)
    return LG.read_ledger(spark, path).groupBy("scope").agg(F.count("*").alias("files"))


@query("ledger_stats", f"WITH {_F}, {_L} SELECT scope, count(*) AS files, sum(size)::BIGINT AS bytes FROM led GROUP BY 1")
def ledger_stats(spark, sf):
    return A.ledger_stats(_latest(spark, sf))


_ADMIT = f"""{_F}, {_L}, r AS (SELECT f.*, l.path AS lpath, l.seen_at, row_number() OVER (PARTITION BY f.scope, f.sha256 ORDER BY file_seq) AS rn, min(file_seq) OVER (PARTITION BY f.scope, f.sha256) AS lead
  FROM f LEFT JOIN led l USING (scope, sha256))"""


@query("accepted_artifacts", f"""WITH {_ADMIT} SELECT scope, file_seq, CASE WHEN lpath IS NULL AND rn = 1 THEN 'new' ELSE 'dupe' END AS status, coalesce(lpath, '/store/' || sha256 || '.txt') AS path,
  CASE WHEN lpath IS NOT NULL THEN seen_at WHEN rn > 1 THEN '2026-01-01T00:00:00Z' END AS first_seen FROM r""")
def accepted_artifacts(spark, sf):
    out = accept_artifacts(_files(spark, sf), _latest(spark, sf), "/store/", "2026-01-01T00:00:00Z")
    return out.select("scope", "file_seq", "status", "path", "first_seen")


@query("readmitted_artifacts", f"WITH {_F} SELECT scope, file_seq, 'new' AS status, '/store/' || sha256 || '.txt' AS path FROM f")
def readmitted_artifacts(spark, sf):
    out = accept_artifacts(_files(spark, sf), _latest(spark, sf), "/store", "2026-01-01T00:00:00Z", dedupe=False)
    return out.select("scope", "file_seq", "status", "path")


@query("ledger_dupes", f"WITH {_F}, {_L} SELECT f.file_seq, l.sha256 IS NOT NULL AS in_ledger, l.seen_at AS first_seen FROM f LEFT JOIN led l USING (scope, sha256)")
def ledger_dupes(spark, sf):
    return flag_dupes(_files(spark, sf), _latest(spark, sf)).select("file_seq", "in_ledger", "first_seen")


@query("first_seen_files", f"WITH {_ADMIT} SELECT file_seq, CASE WHEN rn = 1 THEN 'new' ELSE 'dupe' END AS status, lead AS first_file FROM r")
def first_seen_files(spark, sf):
    return T.first_seen(_files(spark, sf), ["file_seq"]).select("file_seq", "status", "first_file")


@query("newest_artifacts", f"WITH {_F}, {_L} SELECT scope, sha256, seen_at FROM led")
def newest_artifacts(spark, sf):
    return A.newest_first(_latest(spark, sf), "seen_at", "sha256").select("scope", "sha256", "seen_at")


# --- transcripts ---------------------------------------------------------------------------

def _conv(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")


# every turn becomes three frames: its text in two deltas, and a mark that leaves no entry
_FR = """c AS (SELECT conv_id, turn AS seq, role, text FROM conversations),
fr AS (SELECT conv_id, seq * 3 AS seq, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'error' ELSE 'text' END AS type, text FROM c
  UNION ALL SELECT conv_id, seq * 3 + 1, CASE WHEN seq % 4 = 3 THEN 'tool_use' ELSE 'text' END, CASE WHEN seq % 4 = 1 THEN '' ELSE left(text, 5) END FROM c
  UNION ALL SELECT conv_id, seq * 3 + 2, 'done', 'x' FROM c),
kept AS (SELECT *, lag(type) OVER (PARTITION BY conv_id ORDER BY seq) AS prev FROM fr WHERE type <> 'done' AND NOT (type = 'text' AND text = '')),
runs AS (SELECT *, sum(CASE WHEN type = 'text' AND prev = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY seq) AS entry FROM kept)"""


def _frames(spark, sf):
    c = _conv(spark, sf)
    s = F.col("seq")
    three = F.array(
        F.struct((s * 3).alias("seq"), F.when(F.col("role") == "user", "user").when(F.col("role") == "system", "error").otherwise("text").alias("type"), F.col("text").alias("text")),
        F.struct((s * 3 + 1).alias("seq"), F.when(s % 4 == 3, "tool_use").otherwise("text").alias("type"), F.when(s % 4 == 1, "").otherwise(F.substring("text", 1, 5)).alias("text")),
        F.struct((s * 3 + 2).alias("seq"), F.lit("done").alias("type"), F.lit("x").alias("text")),
    )
    return c.select("conv_id", F.explode(three).alias("f")).select("conv_id", "f.*", F.lit("t").alias("ts"))


@query("folded_transcripts", f"WITH {_FR} SELECT conv_id, entry::BIGINT AS entry, arg_min(type, seq) AS type, count(*) AS frames, md5(string_agg(text, '' ORDER BY seq)) AS digest FROM runs GROUP BY 1, 2")
def folded_transcripts(spark, sf):
    # chunks of 7 sequence numbers make every conversation cross several
    out = T.fold_transcript(_frames(spark, sf), chunk=7)
    return out.select("conv_id", big("entry"), "type", "frames", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("transcript_titles", "SELECT conv_id, arg_min(left(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 60), turn) AS title FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def transcript_titles(spark, sf):
    return T.auto_title(_frames(spark, sf)).select("conv_id", "title")


def _messages(spark, sf):
    return _conv(spark, sf).withColumn("plain", F.col("seq") % 5 != 4)


_U = "m AS (SELECT conv_id, turn AS seq, role, text, role = 'user' AND turn % 5 <> 4 AS u FROM conversations)"


@query("last_user_turns", f"WITH {_U}, k AS (SELECT *, sum(u::INT) OVER (PARTITION BY conv_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after, sum(u::INT) OVER (PARTITION BY conv_id) AS total FROM m) SELECT conv_id, seq FROM k WHERE coalesce(after, 0) < 2 OR total <= 2")
def last_user_turns(spark, sf):
    return T.last_user_turns(_messages(spark, sf), 2).select("conv_id", "seq")


@query("without_dangling_turn", f"WITH {_U} SELECT conv_id, seq FROM m WHERE NOT (u AND seq = (SELECT max(seq) FROM m x WHERE x.conv_id = m.conv_id))")
def without_dangling_turn(spark, sf):
    return T.drop_dangling_turn(_messages(spark, sf)).select("conv_id", "seq")


@query("wire_messages", f"""WITH {_U}, d AS (SELECT * FROM m WHERE NOT (u AND seq = (SELECT max(seq) FROM m x WHERE x.conv_id = m.conv_id))),
k AS (SELECT *, sum(u::INT) OVER (PARTITION BY conv_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after, sum(u::INT) OVER (PARTITION BY conv_id) AS total FROM d) SELECT conv_id, seq, length(text)::BIGINT AS chars FROM k WHERE coalesce(after, 0) < 1 OR total <= 1""")
def wire_messages(spark, sf):
    return T.wire_messages(_messages(spark, sf), 1).select("conv_id", "seq", F.length("text").cast("bigint").alias("chars"))


@query("trailing_entries", "SELECT conv_id, turn AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def trailing_entries(spark, sf):
    return T.keep_trailing(_conv(spark, sf), ["conv_id"], "seq", 3).select("conv_id", "seq")


@query("trailing_run_log", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1500")
def trailing_run_log(spark, sf):
    e = D.table(spark, sf, "events").select("event_type", "event_id")
    return T.keep_trailing(e, ["event_type"], "event_id", 1500)


@query("chained_states", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_state FROM conversations")
def chained_states(spark, sf):
    s = _conv(spark, sf).select(F.col("conv_id").alias("trace_id"), F.col("seq").alias("step"), F.col("role").alias("state_id"))
    return T.chain_edges(s, chunk=3).select(F.col("trace_id").alias("conv_id"), F.col("step").alias("turn"), "prev_state")


@query("allocated_ids", """WITH mx AS (SELECT c_nationkey, max(c_custkey) AS m FROM customer GROUP BY 1)
SELECT s_suppkey, 'sl' || (coalesce(m, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS id FROM supplier LEFT JOIN mx ON c_nationkey = s_nationkey""")
def allocated_ids(spark, sf):
    new = D.table(spark, sf, "supplier").select(D.host_of("s_nationkey").alias("host"), "s_suppkey")
    old = D.table(spark, sf, "customer").select(D.host_of("c_nationkey").alias("host"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"))
    return T.allocate_ids(new, old, ["s_suppkey"]).select("s_suppkey", "id")


@query("sessions_by_mode", "SELECT conv_id, min(turn) AS turns FROM conversations WHERE conv_id % 3 <> 1 GROUP BY 1")
def sessions_by_mode(spark, sf):
    s = _conv(spark, sf).groupBy("conv_id").agg(F.min("seq").alias("turns"))
    m = F.col("conv_id") % 3
    s = s.withColumn("mode", F.when(m == 0, "workspace").when(m == 1, "flow"))
    return A.by_mode(s, "workspace").select("conv_id", "turns")


# --- runs ------------------------------------------------------------------------------------

def _events(spark, sf):
    return D.table(spark, sf, "events")


_STATUS = "CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'aborted' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'click' THEN 'new' WHEN event_type = 'view' THEN 'dupe' ELSE 'ok' END"


def _status():
    t, i = F.col("event_type"), F.col("event_id")
    return (
        F.when((t == "purchase") & (i % 7 == 0), "aborted").when((t == "error") & (i % 3 == 0), "error").when(t == "click", "new")
        .when(t == "view", "dupe").otherwise("ok")
    )


@query("run_summaries", f"""WITH e AS (SELECT user_id * 1000 + event_id % 50 AS run_id, event_type, {_STATUS} AS status FROM events)
SELECT run_id, CASE WHEN bool_or(status = 'aborted') THEN 'aborted' WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status, count(*) AS steps,
  count(*) FILTER (WHERE status = 'new') AS artifacts_new, count(*) FILTER (WHERE status = 'dupe') AS artifacts_dupe FROM e GROUP BY 1""")
def run_summaries(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") * 1000 + F.col("event_id") % 50).alias("run_id"), F.lit("download").alias("op"), _status().alias("status"))
    return A.run_summary(e)


@query("retained_runs", "SELECT user_id AS flow_id, event_id AS run_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END) DESC, event_id DESC) <= 50")
def retained_runs(spark, sf):
    r = _events(spark, sf).select(
        F.col("user_id").alias("flow_id"), F.col("event_id").alias("run_id"),
        F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("started_at"),
    )
    return T.keep_newest_runs(r, 50).select("flow_id", "run_id")


@query("paging_stops", """WITH p AS (SELECT user_id AS run_id, event_id AS page, event_type || (event_id % 3) AS sig FROM events),
s AS (SELECT run_id, min(page) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sig ORDER BY page) AS k FROM p) WHERE k > 1 GROUP BY 1)
SELECT p.run_id, p.page FROM p LEFT JOIN s USING (run_id) WHERE stop IS NULL OR page <= stop""")
def paging_stops(spark, sf):
    p = _events(spark, sf).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("page"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("sig")
    )
    return T.stop_on_repeat(p).select("run_id", "page")


@query("call_counts", "SELECT user_id AS scenario, count(*) AS calls, count(*) FILTER (WHERE event_type = 'click') AS clicks, bool_or(event_type = 'purchase') AS found FROM events GROUP BY 1")
def call_counts(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("scenario"), F.col("event_type").alias("call"), (F.col("event_type") == "purchase").alias("found"))
    return A.call_counts(e)


# one run per user: its events as step frames, the last one of a purchase as the result
_LINE = """CASE event_type WHEN 'purchase' THEN '{"type":"result","status":"' || (CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'error' END) || '","n":' || event_id || '}'
  WHEN 'view' THEN 'plain text ' || event_id WHEN 'signup' THEN '{"broken":' || event_id || '}' ELSE '{"type":"step","op":"' || event_type || '","status":"ok"}' END"""


def _line():
    t, i = F.col("event_type"), F.col("event_id").cast("string")
    return (
        F.when(t == "purchase", F.concat(F.lit('{"type":"result","status":"'), F.when(F.col("event_id") % 2 == 0, "ok").otherwise("error"), F.lit('","n":'), i, F.lit("}")))
        .when(t == "view", F.concat(F.lit("plain text "), i)).when(t == "signup", F.concat(F.lit('{"broken":'), i, F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"step","op":"'), t, F.lit('","status":"ok"}')))
    )


def _lines(df):
    return df.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), _line().alias("line"))


@query("parsed_frames", f"""SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'view' THEN 'log' WHEN 'signup' THEN 'log' ELSE 'step' END AS type,
  CASE WHEN event_type = 'purchase' THEN (CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'error' END) WHEN event_type IN ('click', 'error') THEN 'ok' END AS status, {_LINE} AS payload FROM events""")
def parsed_frames(spark, sf):
    return FR.parse_frames(_lines(_events(spark, sf))).select("seq", "type", "status", "payload")


def _progress_lines(df):
    i = F.col("event_id").cast("string")
    hit = F.concat(
        F.lit("· ["), i, F.lit(" states / "), (F.col("event_id") * 2).cast("string"), F.lit(" visits] depth "), (F.col("event_id") % 5).cast("string"),
        F.lit(" · https://x.test/"), i, F.lit(" ("), (F.col("event_id") % 30).cast("string"), F.lit(" controls, 3 items)"),
    )
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("  ! skip ["), i, F.lit(" states / 1 visits]"))).otherwise(hit)
    return df.select(F.col("user_id").alias("crawl_id"), F.col("event_id").alias("seq"), line.alias("line"))


@query("parsed_progress", """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'log' ELSE 'progress' END AS type, CASE WHEN event_type = 'error' THEN -1 ELSE event_id END AS states,
  CASE WHEN event_type = 'error' THEN -1 ELSE event_id % 5 END AS depth, CASE WHEN event_type <> 'error' THEN 'https://x.test/' || event_id END AS url, event_id AS any_states FROM events""")
def parsed_progress(spark, sf):
    li = _progress_lines(_events(spark, sf)).withColumn("any_states", FR.short_progress("line")[0])
    p = FR.parse_progress(li)
    return p.select("seq", "type", F.coalesce("states", F.lit(-1)).alias("states"), F.coalesce("depth", F.lit(-1)).alias("depth"), "url", "any_states")


@query("run_records", "SELECT 'r' || event_id AS id, 'u' || user_id AS flow_id, event_type AS status FROM events WHERE event_type <> 'error'")
def run_records(spark, sf):
    e = _events(spark, sf)
    text = F.to_json(F.struct(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("flow_id"),
        F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
    ))
    torn = F.expr("substring(document, 1, 20)")
    docs = e.select("event_type", text.alias("document")).select(F.when(F.col("event_type") == "error", torn).otherwise(F.col("document")).alias("document"))
    return R.runs_from_documents(docs).select("id", "flow_id", "status")


@query("audit_goals", """SELECT 's' || s_suppkey AS site, unnest(['add one', 'drop two']) AS goal, unnest(['ok', 'no_match']) AS want, unnest([2, -1])::BIGINT AS min_fields FROM supplier""")
def audit_goals(spark, sf):
    k = F.col("s_suppkey").cast("string")
    doc = F.concat(
        F.lit('{"sites":[{"name":"s'), k, F.lit('","host":"h","start_url":"https://h/","goals":[{"goal":"add one","expect":{"min_fields":2}},'),
        F.lit('{"goal":"drop two","expect":{"status":"no_match","phase":1}}]}]}'),
    )
    g = R.goals_from_documents(D.table(spark, sf, "supplier").select(doc.alias("document")))
    return g.select("site", "goal", "want", F.coalesce("min_fields", F.lit(-1)).cast("bigint").alias("min_fields"))


# one run record a supplier, as a file; some are cut off in the middle
@query("run_files", """SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS flow_id, CASE WHEN s_acctbal < 0 THEN 'error' ELSE 'ok' END AS status FROM supplier WHERE s_suppkey % 7 <> 3""")
def run_files(spark, sf):
    path, key = work_dir(spark), F.col("s_suppkey").cast("string")
    text = F.to_json(F.struct(
        F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("flow_id"), F.when(F.col("s_acctbal") < 0, "error").otherwise("ok").alias("status")))
    torn = F.when(F.col("s_suppkey") % 7 == 3, F.substring(text, 1, 12)).otherwise(text)
    write_documents(D.table(spark, sf, "supplier").select(F.concat(F.lit("run"), key).alias("host"), torn.alias("document")), path)
    return R.read_runs(spark, path).select("id", "flow_id", "status")


# one audit file a nation, with a site a supplier
@query("goal_files", """SELECT 's' || s_suppkey AS site, unnest(['buy', 'call']) AS goal, unnest(['ok', 'no_match']) AS want, 'https://n' || s_nationkey || '.example.com/' AS start FROM supplier""")
def goal_files(spark, sf):
    path, n = work_dir(spark), F.col("s_nationkey").cast("string")
    start = F.concat(F.lit("https://n"), n, F.lit(".example.com/"))
    goal = lambda name, want: F.struct(F.lit(name).alias("goal"), F.struct(F.lit(want).alias("status")).alias("expect"))
    site = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), start.alias("start_url"), F.array(goal("buy", "ok"), goal("call", "no_match")).alias("goals"))
    docs = D.table(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), n).alias("host")).agg(F.collect_list(site).alias("sites"))
    write_documents(docs.select("host", F.to_json(F.struct("sites")).alias("document")), path)
    return R.read_goals(spark, path).select("site", "goal", "want", "start")


@query("file_hashes", """SELECT 'f' || s_suppkey || '.json' AS name, sha256(s_name || chr(10)) AS sha256, (strlen(s_name) + 1)::BIGINT AS size, '.json' AS ext FROM supplier""")
def file_hashes(spark, sf):
    path = work_dir(spark)
    write_documents(D.table(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("host"), F.col("s_name").alias("document")), path)
    return LG.hash_files(spark, path).select("name", "sha256", "size", "ext")


# --- streams ----------------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("progress_stream", """SELECT user_id AS crawl_id, count(*) AS lines, max(event_id) AS states, arg_max(event_id % 30, event_id) AS controls FROM events WHERE event_type <> 'error' GROUP BY 1""")
def progress_stream(spark, sf):
    base = work_dir(spark)
    ST.progress_stream(_progress_lines(_event_stream(spark, sf)), f"{base}/store", f"{base}/ckpt")
    return ST.latest_progress(spark, f"{base}/store").select(big("crawl_id"), "lines", "states", "controls")


@query("frame_stream", """SELECT user_id AS run_id, count(*) AS frames, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS logs,
  arg_max(CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'error' END, event_id) FILTER (WHERE event_type = 'purchase') AS result_status FROM events GROUP BY 1""")
def frame_stream(spark, sf):
    base = work_dir(spark)
    ST.frame_stream(_lines(_event_stream(spark, sf)), f"{base}/store", f"{base}/ckpt")
    kept = ST.stored_frames(spark, f"{base}/store").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("kept"))
    # counts and frames themselves must agree
    both = ST.frame_totals(spark, f"{base}/store").join(kept, "run_id").where("kept = frames")
    return both.select(big("run_id"), "frames", "logs", "result_status")


@query("run_stream", """SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'purchase') THEN arg_max(CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'error' END, event_id) FILTER (WHERE event_type = 'purchase')
  ELSE 'running' END AS status, count(*) AS frames FROM events GROUP BY 1""")
def run_stream(spark, sf):
    base = work_dir(spark)
    ST.run_stream(FR.parse_frames(_lines(_event_stream(spark, sf))), f"{base}/runs", f"{base}/ckpt")
    return ST.latest_runs(spark, f"{base}/runs").select(big("run_id"), "status", "frames")


@query("ledger_stream", f"WITH {_F} SELECT scope, sha256, arg_min(name, file_seq) AS name FROM f GROUP BY 1, 2")
def ledger_stream(spark, sf):
    base = work_dir(spark)
    # three parts of the table: two runs of one stream, then another stream with a checkpoint of its own
    f = _files(spark, sf).select("scope", "file_seq", "sha256", "name", "size", "source")
    last = f.agg(F.max("file_seq")).first()[0]
    parts = [("a", F.col("file_seq") <= last // 3), ("a", F.col("file_seq").between(last // 3 + 1, 2 * last // 3)), ("b", F.col("file_seq") > 2 * last // 3)]
    for name, part in parts:
        f.where(part).write.mode("append").parquet(f"{base}/in_{name}")
        stream = spark.readStream.schema(f.schema).parquet(f"{base}/in_{name}")
        ST.ledger_stream(stream, f"{base}/ledger", "/store", "2026-01-01T00:00:00Z", f"{base}/ckpt_{name}")
    return ST.stored_ledger(spark, f"{base}/ledger").select("scope", "sha256", "name")


@query("merge_stream", """SELECT 'shop' || n_nationkey || '.example.com' AS host, 2 * count(c_custkey) AS live_hits, count(c_custkey) AS live_triggers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def merge_stream(spark, sf):
    from .plan_queries import _live

    base = work_dir(spark)
    write_graphs(D.stored_graphs(spark, sf), f"{base}/graphs")
    live = _live(spark, sf)
    live.repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(live.schema).parquet(f"{base}/in")
    # a first try that died before its commit
    stage_graphs(read_tables(spark, f"{base}/graphs"), f"{base}/graphs")
    ST.merge_stream(stream, f"{base}/graphs", "2026-01-01 00:00:00", f"{base}/ckpt")
    g = read_tables(spark, f"{base}/graphs")
    live_n = g.triggers.groupBy("host").agg(F.count_if(F.col("cache_source") == "live").alias("live_triggers"))
    return g.meta.join(live_n, "host").select("host", big("live_hits"), "live_triggers")


