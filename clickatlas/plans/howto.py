"""How to reach an action: matched triggers, routes, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..operators.graph import Reached, lay_out, path_steps, search, shown_paths, start_state
from ..operators.match import match_goals
from ..operators.rows import first_by, last_by_id, top_n
from ..session import at_once, cut, few
from ..sources.graphs import Graphs


def _blank(c: str):
    return F.coalesce(F.col(c), F.lit("")) == ""


def routes(graphs: Graphs, questions: DataFrame) -> tuple[DataFrame, Reached]:
    """(matches, reached) of a question batch.

    ``questions`` is (q_id, host, goal, match, start).  ``matches`` has one narrow
    row per question and selected trigger: its keys, its distance where a route
    exists, and what ranking needs.  Texts, forms and paths are fetched later for
    the rows that are shown.  ``reached`` is the search table, distances only: one
    search per (host, start) serves every question that shares it.
    """
    asked = few(questions.where(~(_blank("goal") & _blank("match"))))
    st = start_state(graphs.states, asked, "root").select(
        "host", F.coalesce("start", F.lit("")).alias("start"), F.col("state_id").alias("root")
    ).dropDuplicates(["host", "start"])
    # the few questions carry their start, so the matches join once per table
    q = asked.select("q_id", "host", F.coalesce("start", F.lit("")).alias("start")).join(st, ["host", "start"]).drop("start")
    t = graphs.triggers.select("host", "trig_seq", "state_id", labels.form_confidence("kind", "form").alias("confidence"))
    matched = lambda: cut(match_goals(asked, graphs.triggers).join(t, ["host", "trig_seq"]).join(few(q), ["q_id", "host"]))
    m, laid = at_once(matched, lambda: lay_out(graphs.edges, parallel=True))
    wanted = m.where(F.col("state_id").isNotNull()).select("host", "root", F.col("state_id").alias("node")).distinct()
    reached = search(laid, wanted.select("host", "root"), targets=wanted, paths=False)
    m = m.join(reached.rows.select("host", "root", F.col("node").alias("state_id"), "depth"), ["host", "root", "state_id"], "left")
    return m, reached


def with_trigger(rows: DataFrame, graphs: Graphs) -> DataFrame:
    """Adds the trigger's own columns to the few rows that are shown."""
    t = graphs.triggers.select("host", "trig_seq", "label", "kind", "selector", "href", "accept", "opens_at", "form")
    return rows.join(t, ["host", "trig_seq"])


def with_urls(rows: DataFrame, graphs: Graphs) -> DataFrame:
    shown = few(rows.select("host", F.explode(F.array("root", "state_id")).alias("id")))
    st = few(last_by_id(graphs.states, shown, ["url"]))
    root = st.select("host", F.col("id").alias("root"), F.col("url").alias("start_url"))
    page = st.select("host", F.col("id").alias("state_id"), F.col("url").alias("state_url"))
    return rows.join(root, ["host", "root"], "left").join(page, ["host", "state_id"], "left")


def with_path(rows: DataFrame, reached: Reached, edges: DataFrame) -> DataFrame:
    """Adds the whole paths of the few rows that are shown."""
    paths = shown_paths(edges, reached, rows.select("host", "root", F.col("state_id").alias("node")))
    return rows.join(few(paths).withColumnRenamed("node", "state_id"), ["host", "root", "state_id"], "left")


_ORDER = ["depth", "needle_desc", "trig_seq"]


def _ranked(m: DataFrame) -> DataFrame:
    return m.withColumn("needle_desc", F.when(F.col("needle_hit"), 0).otherwise(1))


def question_status(questions: DataFrame, m: DataFrame, graphs: Graphs) -> DataFrame:
    """Status of every question; never an exception."""
    high = (F.col("confidence") == "high") & F.col("depth").isNotNull()
    agg = m.groupBy("q_id", "host").agg(
        F.count("*").alias("matched"), F.count("depth").alias("routed"), F.count_if(high).alias("high"), F.max("root").alias("root")
    )
    agg = few(agg)
    st = few(last_by_id(graphs.states, agg.select("host", F.col("root").alias("id")), ["url"]))
    agg = agg.join(st.select("host", F.col("id").alias("root"), F.col("url").alias("start_url")), ["host", "root"], "left").drop("host", "root")
    status = (
        F.when(_blank("goal") & _blank("match"), "invalid_args")
        .when(F.coalesce("matched", F.lit(0)) == 0, "no_match")
        .when(F.col("routed") == 0, "unreachable")
        .when(F.col("high") == 0, "no_match")
        .otherwise("ok")
    )
    return questions.join(agg, "q_id", "left").select(
        "q_id", "host", "goal", "match", status.alias("status"), "start_url",
        F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("routed", F.lit(0)).alias("routed"),
        F.coalesce("high", F.lit(0)).alias("high"),
    )


def pick_triggers(m: DataFrame, show_all: bool = False) -> DataFrame:
    """The nearest confident route of each question, or all of them."""
    high = _ranked(m.where((F.col("confidence") == "high") & F.col("depth").isNotNull()))
    if show_all:
        return high
    return first_by(high, ["q_id"], _ORDER)


def low_confidence(m: DataFrame) -> DataFrame:
    """Reachable matches that open no real form."""
    return _ranked(m.where((F.col("confidence") == "low") & F.col("depth").isNotNull()))


def candidates(m: DataFrame, status: DataFrame, graphs: Graphs) -> DataFrame:
    """Labels matched by the questions that no route answers."""
    lost = m.join(status.where("status = 'unreachable'").select("q_id"), "q_id", "left_semi")
    return with_trigger(lost.select("q_id", "host", "trig_seq"), graphs).select("q_id", "host", "trig_seq", "label")


def narrate(picked: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the spoken steps; labels are fetched for the shown paths only."""
    paths = picked.select("host", "root", "state_id", "path").dropDuplicates(["host", "root", "state_id"])
    clicks = (
        path_steps(paths, edges.select("host", "edge_seq", "label"), ["host", "root", "state_id"])
        .groupBy("host", "root", "state_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step", F.coalesce("label", F.lit("")).alias("label")))),
                lambda x: F.concat(F.lit("Click “"), x["label"], F.lit("”")),
            ).alias("clicked")
        )
    )
    out = picked.join(clicks, ["host", "root", "state_id"], "left")
    last = F.when(
        F.lower("kind") == "download", F.concat(F.lit("Download via “"), F.col("label"), F.lit("”"))
    ).otherwise(F.concat(F.lit("Click the “"), F.col("label"), F.lit("” button")))
    empty = F.expr("cast(array() as array<string>)")
    steps = F.concat(
        F.array(F.concat(F.lit("Go to "), F.coalesce("start_url", F.lit("None")))), F.coalesce("clicked", empty), F.array(last)
    )
    return out.withColumn("steps", steps).drop("clicked")


def howto(graphs: Graphs, questions: DataFrame, show_all: bool = False) -> DataFrame:
    """One row per question (per route with ``show_all``) with status and the shortest click path."""
    questions = cut(questions)
    m, reached = routes(graphs, questions)
    m = cut(m)
    status = question_status(questions, m, graphs)
    picked = few(with_trigger(few(pick_triggers(m, show_all)), graphs))
    picked = cut(with_path(with_urls(picked, graphs), reached, graphs.edges))
    best = narrate(picked, graphs.edges).select(
        "q_id", "trig_seq", F.col("label").alias("trigger_label"), "state_id", "state_url", (F.col("depth") + 1).alias("clicks"),
        "steps", "opens_at", F.coalesce("kind", F.lit("form")).alias("action_kind"),
        F.when(F.lower("kind") == "download", F.col("href")).alias("download_url"), "form",
        labels.form_field_count("form").alias("field_count"), "confidence",
    )
    return status.join(best, "q_id", "left")


def path_step_structs(picked: DataFrame, graphs: Graphs) -> DataFrame:
    """Adds ``path_steps``: a link step goes to its target's url, any other step clicks its selector."""
    paths = picked.select("host", "root", "state_id", "path").dropDuplicates(["host", "root", "state_id"])
    steps = path_steps(paths, graphs.edges.select("host", "edge_seq", "dst", "label", "selector", "kind"), ["host", "root", "state_id"])
    steps = few(steps)
    dest = few(last_by_id(graphs.states, steps.select("host", F.col("dst").alias("id")), ["url"]))
    steps = steps.join(dest.select("host", F.col("id").alias("dst"), F.col("url").alias("dest_url")), ["host", "dst"], "left")
    one = F.struct(
        "step", "label", "selector", F.when(F.col("kind") == "link", F.col("dest_url")).alias("href"),
    )
    listed = steps.groupBy("host", "root", "state_id").agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["label"].alias("label"), x["selector"].alias("selector"), x["href"].alias("href"))).alias("path_steps")
    )
    empty = F.expr("cast(array() as array<struct<label:string,selector:string,href:string>>)")
    return picked.join(listed, ["host", "root", "state_id"], "left").withColumn("path_steps", F.coalesce("path_steps", empty))


def resolve_action(graphs: Graphs, questions: DataFrame) -> DataFrame:
    """The executable record behind each question.

    ``questions`` may carry ``index``: which of the routed matches to take, the
    confident ones where there are any, else all.
    """
    if "index" not in questions.columns:
        questions = questions.withColumn("index", F.lit(0))
    questions = cut(questions)
    m, reached = routes(graphs, questions)
    m = cut(m)
    status = question_status(questions, m, graphs)
    pool = _ranked(m.where(F.col("depth").isNotNull()))
    sizes = pool.groupBy("q_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("h"))
    want = questions.join(sizes, "q_id").select(
        "q_id", F.coalesce("index", F.lit(0)).alias("index"), F.when(F.col("h") > 0, F.col("h")).otherwise(F.col("n")).alias("match_count"),
        (F.col("h") > 0).alias("only_high"),
    )
    want = few(want)
    deepest = want.where(F.col("index") < F.col("match_count")).agg(F.max("index")).first()[0]
    pool = pool.join(want, "q_id").where(~F.col("only_high") | (F.col("confidence") == "high"))
    ranked = top_n(pool, ["q_id"], _ORDER, max(int(deepest or 0), 0) + 1, rank="pool_rank")
    chosen = few(ranked.where(F.col("pool_rank") == F.col("index") + 1))
    chosen = cut(with_path(few(with_trigger(chosen, graphs)), reached, graphs.edges))
    chosen = path_step_structs(chosen, graphs).select(
        "q_id", "trig_seq", "label", "state_id", "kind", "selector", "href", "accept", "opens_at", "form", "path_steps", "depth", "confidence",
        F.lit(True).alias("chosen"),
    )
    out = status.join(want.select("q_id", "index", "match_count"), "q_id", "left").join(chosen, "q_id", "left")
    routed = F.coalesce("match_count", F.lit(0)) > 0
    final = F.when(F.col("status").isin("invalid_args", "unreachable"), F.col("status")).when(
        routed & F.col("chosen"), "ok"
    ).otherwise("no_match")
    detail = F.when(
        routed & F.col("chosen").isNull(),
        F.concat(F.lit("index "), F.col("index").cast("string"), F.lit(" out of range ("), F.col("match_count").cast("string"), F.lit(" match(es))")),
    )
    return out.withColumn("status", final).withColumn("detail", detail).drop("chosen").withColumnRenamed("label", "trigger_label")


# --- plans ---------------------------------------------------------------------------

def _step(role: str, verb: str, target, value=None, comment=None, label=None, needs_input=False, disabled=False):
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(role).alias("role"), F.lit(verb).alias("verb"), (target if target is not None else none).cast("string").alias("target"),
        (value if value is not None else none).cast("string").alias("value"),
        (comment if comment is not None else none).cast("string").alias("comment"),
        (label if label is not None else none).cast("string").alias("label"),
        F.lit(needs_input).alias("needs_input"), F.lit(disabled).alias("disabled"),
    )


def _note(text):
    return _step("note", "", None, comment=text, disabled=True)


def _field_step(f):
    kind = F.lower(F.coalesce(F.nullif(f["type"], F.lit("")), F.lit("text")))
    lab = F.trim(F.coalesce(F.nullif(f["label"], F.lit("")), F.lit("(unlabeled)")))
    note = F.concat(lab, F.when(F.coalesce(f["required"], F.lit(False)), " *").otherwise(""))
    value = labels.field_placeholder(f)
    accept = F.nullif(f["accept"], F.lit(""))
    sel = f["selector"]
    return (
        F.when(
            F.coalesce(sel, F.lit("")) == "",
            _note(F.concat(F.lit("no_selector "), kind, F.lit(" "), note)),
        )
        .when(kind.isin(list(K.CHECK_TYPES)), _step("check", "check", sel, comment=note, label=lab, needs_input=True))
        .when(
            accept.isNotNull() | (kind == "file"),
            _step("upload", "upload", sel, F.lit("<FILE>"), F.concat(note, F.lit(" accept="), F.coalesce(accept, F.lit("*"))), lab, True),
        )
        .when(kind.isin(list(K.SELECT_TYPES)), _step("select", "select", sel, value, note, lab, True))
        .otherwise(_step("fill", "fill", sel, value, note, lab, True))
    )


def action_plan(resolved: DataFrame, allow_submit: bool = False) -> DataFrame:
    """Ordered steps of each resolved action; a submit stays disabled unless allowed.

    The steps of one action are built from its own row, so no shuffle is needed.
    Comments are labels (`*` marks a required field) or short codes: ``section``
    begins a part, ``no_selector``, ``no_url`` and ``no_target`` say what the graph
    lacks.
    """
    r = resolved.where("status = 'ok'")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    nav = F.concat(
        F.array(_step("nav", "nav", F.col("start_url"))),
        F.transform(
            "path_steps",
            lambda s: F.when(
                F.coalesce(s["href"], F.lit("")) != "", _step("nav", "nav", s["href"], comment=F.nullif(F.trim(s["label"]), F.lit("")))
            ).when(
                F.coalesce(s["selector"], F.lit("")) != "", _step("click", "click", s["selector"], comment=F.nullif(F.trim(s["label"]), F.lit("")))
            ).otherwise(
                _note(F.concat(F.lit("no_selector click "), F.trim(F.coalesce(s["label"], F.lit("")))))
            ),
        ),
    )
    download = F.concat(
        F.array(_note(F.lit("section download"))),
        F.when(
            has("href"), F.array(_step("download", "download", F.col("href"), labels.suggest_filename(F.col("href"), F.col("accept"), F.col("trigger_label"))))
        ).when(
            has("selector"), F.array(_step("download", "click", F.col("selector"), comment=F.lit("no_url")))
        ).otherwise(F.array(_note(F.lit("no_target")))),
    )
    none = F.slice(nav, 1, 0)
    opener = F.when(has("opens_at"), F.array(_step("nav", "nav", F.col("opens_at"), comment=F.lit("open_form")))).when(
        has("selector"), F.array(_step("click", "click", F.col("selector"), comment=F.lit("open_form")))
    ).otherwise(none)
    fields = F.coalesce(F.transform(F.col("form.fields"), _field_step), none)
    sub_sel = F.coalesce(F.col("form.submitSelector"), F.lit(""))
    first_sub = F.try_element_at(F.col("form.submitButtons"), F.lit(1))
    if allow_submit:
        submit_step = _step("submit", "click", sub_sel, comment=F.concat_ws(" ", F.lit("submit"), first_sub))
    else:
        submit_step = _step("submit", "click", sub_sel, comment=F.lit("submit"), disabled=True)
    submit = F.when(sub_sel != "", F.array(submit_step)).when(
        first_sub.isNotNull(), F.array(_note(F.concat(F.lit("no_selector submit "), first_sub)))
    ).otherwise(none)
    fill = F.concat(
        F.array(_note(F.lit("section form"))), opener, fields, submit
    )
    steps = F.concat(nav, F.when(F.lower("kind") == "download", download).otherwise(fill))
    return r.select("q_id", "host", F.posexplode(steps).alias("step", "s")).select("q_id", "host", "step", "s.*")


def tour_steps(resolved: DataFrame) -> DataFrame:
    """Highlight steps of a guided tour: the path, the trigger, the form; never a submit."""
    none = F.lit(None).cast("string")
    row = lambda kind, label, sel: F.struct(F.lit(kind).alias("kind"), label.alias("label"), sel.alias("selector"))
    r = resolved.where("status = 'ok'")
    steps = F.concat(
        F.transform("path_steps", lambda s: row("nav", s["label"], s["selector"])),
        F.array(row("trigger", F.col("trigger_label"), none), row("form", none, none)),
    )
    return r.select("q_id", "host", F.posexplode(steps).alias("step", "s")).select("q_id", "host", "step", "s.*")


def scenario_report(graphs: Graphs, questions: DataFrame) -> DataFrame:
    """One report row per question: clicks, trigger and form size where a path was found."""
    h = howto(graphs, questions)
    ok = F.col("status") == "ok"
    cand = F.when(F.col("status") == "unreachable", F.col("matched")).otherwise(0)
    return h.select(
        "q_id", "host", "goal", "status", "start_url", F.when(ok, F.col("clicks")).alias("clicks"),
        F.when(ok, F.col("trigger_label")).alias("trigger"), F.when(ok, F.col("form.fieldCount")).alias("form_field_count"),
        cand.alias("candidates"), F.lit("unrated").alias("verdict"), ok.alias("found"),
    )
