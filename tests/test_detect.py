import numpy as np
from pyspark.sql import functions as F

from lintlake.operators import device, rules, scoring
from lintlake.plans import detect
from lintlake.sources import config, corpus
from lintlake.sources.sinks import read_findings

RULES = (
    rules.LineRule("api_key", r'(?i)api_key\s*=\s*"', "Hardcoded key", ""),
    rules.LineRule("key_file", r'"[^"]*(?:id_rsa|\.pem)"', "Key file name", '"'),
    rules.LineRule("temp_path", r'"/tmp/', "Temporary path", "/tmp/"),
)


def length_logits(texts):
    n = texts.str.len().to_numpy(dtype=np.float32)
    return np.stack([np.full_like(n, 20.0), n], axis=1)


def write_tree(root):
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "one.py").write_text('API_KEY = "1"\nopen("/tmp/id_rsa")\nopen("/tmp/x.pem")\n')
    (root / "a" / "b" / "two.py").write_text("print(1)\n")
    (root / "a" / "b" / "three.PY").write_text("skip\n")
    (root / "a" / "vulnerable.js").write_text("skip\n")
    (root / "a" / "latin.py").write_bytes(b"x = '\xe9'\n")
    (root / "empty.py").write_text("")


def test_tree(spark, tmp_path):
    write_tree(tmp_path)
    files = corpus.corpus_scan(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["one.py", "two.py"]
    assert [r.path.split("/")[-1] for r in corpus.unreadable_files(spark, str(tmp_path)).collect()] == ["latin.py"]

    reports = f"{tmp_path}/reports"
    found = detect.detect_tree(spark, str(tmp_path / "a"), length_logits, RULES, reports)
    verdicts = {r.path.split("/")[-1]: r.verdict for r in found.verdicts.collect()}
    assert verdicts == {"one.py": "YES", "two.py": "NO"}
    rows = [(r.line, r.attrs["variable_name"]) for r in read_findings(spark, reports).orderBy("pos").collect()]
    assert rows == [(1, "api_key"), (2, "key_file"), (2, "temp_path"), (3, "key_file"), (3, "temp_path")]
    report = found.report.collect()
    assert len(report) == 6
    assert [r.message for r in report if r.path.endswith("two.py")] == [None]
    assert {r.report.split("_")[-1] for r in report} == {"one.json", "two.json"}


def test_rule_on_whole_text(spark):
    """Hits on the last line of a long text, and a text whose every line hits."""
    long = "x\n" * 5000 + 'open("/tmp/a")'
    every = '"/tmp/"\n' * 300
    df = spark.createDataFrame([("long", long), ("every", every), ("none", "x")], "path string, text string")
    got = rules.scan_verdicts(df, RULES[2:], ["path"]).collect()
    assert {r.path: (r.findings, r.passed) for r in got} == {"long": (1, False), "every": (300, False), "none": (0, True)}
    assert rules.scan_lines(df, RULES[2:], ["path"]).filter("path = 'long'").first().line_number == 5001


def test_rulesets(spark):
    df = spark.createDataFrame([("a", "import flask"), ("b", "import flask.views"), ("c", "import django\nfrom flask import x")], "path string, code string")
    got = {}
    for r in rules.file_rulesets(df, ["path"]).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.ruleset)
    base = list(rules.BASE_RULESETS)
    assert got == {"a": base + ["p/flask"], "b": base, "c": base + ["p/django", "p/flask"]}


def test_guidance_order_and_case(spark):
    c = rules.matched_guidance(F.lit("subprocess Pickle os.system"), {"os.system": "a", "pickle": "b", "subprocess": "c"})
    assert spark.range(1).select(c.alias("c")).first().c == ["\t* For 'os.system', a", "\t* For 'subprocess', c"]


def test_argmax_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 1.0],)], "v array<float>")
    assert [r.a for r in df.select(scoring.argmax(F.col("v")).alias("a")).collect()] == [1, 0]


def test_every_window_is_scored(spark):
    df = spark.createDataFrame([("late", "a " * 1200 + "=" * 30), ("short", "a"), ("empty", "")], "path string, text string")

    def marks(texts):
        n = texts.str.count("=").to_numpy(dtype=np.float32)
        return np.stack([np.full_like(n, 0.5), n], axis=1)

    got = {r.path: (r.windows, r.label) for r in scoring.classify(df, marks, ["path"]).collect()}
    assert got == {"late": (3, 1), "short": (1, 0), "empty": (1, 0)}


def test_scores_do_not_depend_on_the_join(spark):
    rows = [("a", "x y x"), ("b", "z"), ("c", ""), ("n", None), ("tenths", "t " * 10)]
    files = spark.createDataFrame(rows, "path string, text string")
    weights = spark.createDataFrame([("x", 0.4), ("y", 0.2), ("t", 0.1)], "token string, weight double")
    want = [("a", 1.0, 1), ("b", 0.0, 0), ("c", 0.0, 0), ("n", 0.0, 0), ("tenths", 1.0, 1)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (limit, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert sorted(tuple(r) for r in scoring.weighted_scores(files, weights, ["path"], 1.0).collect()) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_windows_are_slices_of_the_text(spark):
    texts = ["def f():\n    return 1", "  a\tb\n\nc  ", "", " \n ", "w" * 5000, "a " * 1200, "\u00a0x\u2003y\x1cz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    for tokens in (1, 2, 512):
        got = {i: [] for i in range(len(texts))}
        for r in scoring.token_windows(df, ["id"], tokens=tokens).collect():
            got[r.id].append(r.window)
        for i, text in enumerate(texts):
            assert "".join(got[i]) == text
            assert all(len(w.split()) <= tokens for w in got[i])
            assert len(got[i]) == max(1, -(-len(text.split()) // tokens))


def test_snapshot(spark):
    text = (
        "GPU[0]\t\t: VBIOS version: 113-D\nGPU[0]\t\t: GPU use (%): 47\nGPU[0]\t\t: VRAM Total Memory (B): 2097152\n"
        "GPU[0]\t\t: VRAM Total Used Memory (B): 1048576\nGPU[0] : Temperature (Sensor edge) (C): 40.5\n"
        "GPU[0] : sclk clock level: 1: (77Mhz)\nGPU[0] : Performance Level: auto\nAverage Graphics Package Power (W): 41.5\n"
    )
    board = "  Board name:   Radeon X \n"
    df = spark.createDataFrame([(1, text, board), (2, "", "")], "id int, snapshot string, board string")
    one, two = config.device_snapshots(df, board="board").orderBy("id").collect()
    assert (one.gpu_name, one.vbios_version, one.p_state) == ("Radeon X", "113-D", "auto")
    assert (one.gpu_utilization, one.memory_used, one.memory_total, one.memory_utilization) == (0.04, 1.0, 2.0, 0.5)
    assert (one.temperature, one.power_draw, one.clocks_sm, one.current_graphics_clock) == (40.0, 42.0, 77.0, 77.0)
    assert two.driver_version == "Driver version not found in rocm-smi output."
    assert {two.p_state, two.memory_utilization, two.clocks_video} == {"-1.0", -1.0}


def test_memory_change(spark):
    df = spark.createDataFrame(
        [("r", 1, 10.0, 100.0), ("r", 3, 40.0, 100.0), ("r", 2, 99.0, 100.0), ("q", 1, -1.0, -1.0)],
        "request string, ts int, memory_used double, memory_total double",
    )
    got = {r.request: (r.before, r.after, r.delta) for r in device.memory_change(df, ["request"]).collect()}
    assert got == {"r": (10.0, 40.0, 30.0), "q": (None, None, None)}
