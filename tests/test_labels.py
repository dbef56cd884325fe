from pyspark.sql import functions as F

from clickatlas.functions import labels


def test_goal_nouns(spark):
    goals = {"sign in": ["sign"], "post a job": ["post", "job"], "add a new report to my team": ["report", "team"], "create role": ["role"], "": [], None: [],
             "Añadir niño": ["niño"]}
    df = spark.createDataFrame([(g,) for g in goals], "g string")
    assert [r[0] for r in df.select(labels.goal_nouns("g")).collect()] == list(goals.values())


def test_needle(spark):
    cases = [("sign in", "Find a new job", False), ("create role", "Create Role", True), ("create role", "Add Roles", True), ("create role", "Delete Widget", False),
             ("post a job", "Find a new job", True), ("", "Download all", True), ("", "Show all", False)]
    df = spark.createDataFrame(cases, "g string, l string, want boolean")
    got = df.select(F.rlike("l", labels.goal_needle(labels.goal_nouns("g"))).alias("r"), "want").collect()
    assert all(r["r"] == r["want"] for r in got)


def test_families_and_text(spark):
    df = spark.createDataFrame([("Sign out",), ("Télécharger",), ("Crear rol",), ("+",)], "t string").select(labels.classify_label("t").alias("c")).select("c.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (True, False, False, True, False)
    assert got[1][2] and got[2][3] and got[2][4] and got[3][1]


def test_form_confidence(spark):
    schema = "kind string, form struct<fieldCount:int, fields:array<string>>"
    rows = [("form", (0, [])), ("form", None), (None, None), ("form", (2, None)), ("form", (None, ["x"])), ("Download", None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(labels.form_confidence("kind", "form")).collect()] == ["low", "low", "low", "high", "high", "high"]


def test_names(spark):
    df = spark.createDataFrame([("s12", "a.b", "My  Report!"), ("sl3", "..", "¡Ñu!"), ("x", "a/b", "")], "i string, h string, t string")
    got = df.select(labels.id_num("i"), labels.valid_host("h"), labels.slug("t")).collect()
    assert [tuple(r) for r in got] == [(12, True, "my-report"), (3, False, "ñu"), (0, False, "file")]
    names = spark.createDataFrame([("https://a/x/q3.pdf?z", None, "L"), ("https://a/x", ".csv,.txt", "Q3 data"), (None, "image/png", None), (None, "image/*", "Logo")], "h string, a string, l string")
    assert [r[0] for r in names.select(labels.suggest_filename(F.col("h"), F.col("a"), F.col("l"))).collect()] == ["q3.pdf", "q3-data.csv", "download.png", "logo"]


def test_shell_sig_ignores_data(spark):
    s = "c array<struct<text:string,nav:boolean,bulk:boolean>>, v array<string>"
    a = ([("Home", True, False), ("12 new", False, False), ("Row", True, True)], ["Chat"])
    b = ([("Home", True, False), ("12 new", False, False), ("Other row", True, True), ("99 items", False, False)], ["Chat"])
    c = ([("Home", True, False), ("12 new", False, False)], ["Files"])
    got = [r[0] for r in spark.createDataFrame([a, b, c], s).select(labels.shell_state_sig(F.lit("https://x/#a"), "c", "v")).collect()]
    assert got[0] == got[1] == "https://x/||12 new|Home||view=Chat" and got[2] != got[0]
