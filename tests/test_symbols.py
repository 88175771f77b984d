import ast

import pytest
from pyspark.sql import functions as F

from lintlake.operators import code_facts as cf
from lintlake.operators import symbols as sy
from lintlake.plans import repair


@pytest.fixture(scope="module")
def files(spark, sample):
    data = [("s.py", sample), ("bad.py", "def broken(:\n"), ("empty.py", "")]
    return spark.createDataFrame(data, "path string, text string")


@pytest.fixture(scope="module")
def facts(files):
    return cf.symbol_facts(files).cache()


def names(df, *columns):
    return [tuple(r) for r in df.filter("path = 's.py'").orderBy("pos").select(*columns).collect()]


def test_unparseable_file_is_one_error_row(facts):
    assert [r.path for r in cf.errors(facts).collect()] == ["bad.py"]
    assert facts.filter("path = 'bad.py'").count() == 1


def test_functions_breadth_first(facts, sample):
    walked = [n.name for n in ast.walk(ast.parse(sample)) if isinstance(n, ast.FunctionDef)]
    assert [n for n, in names(cf.functions(facts), "name")] == walked == ["lookup", "enter", "size", "inner"]
    assert [n for n, in names(cf.methods(facts), "name")] == ["lookup", "enter"]
    assert [n for n, in names(cf.module_functions(facts), "name")] == ["lookup", "enter", "size"]


def test_imports(facts):
    assert names(cf.imports(facts), "module", "name", "alias") == [
        (None, "shelve", None), (None, "requests", None), ("web", "App", None), ("web", "incoming", "inc"),
    ]
    assert ("import pickle",) in [tuple(r) for r in cf.all_imports(facts).select("code").collect()]


def test_slices(files, facts):
    got = {r.section: r.code for r in repair.sections(files, facts).collect()}
    assert set(got) == {"lookup", "enter"}
    assert got["lookup"] == (
        "import shelve\nservice = App(name)\n# Check one: runs a tool\n@service.route('/lookup')\n"
        "def lookup():\n    return shelve.open(inc.args)"
    )
    assert got["enter"].startswith(
        "SECRET_WORD = 'hunter2'\nADMIN = 'root'\nservice = App(name)\n@service.route('/enter')\ndef enter(a: int, b=None, *rest)"
    )


def test_alias_name_is_not_a_use(spark):
    text = "import numpy as np\ndef f():\n    return np.pi\ndef g():\n    return numpy\n"
    facts = cf.symbol_facts(spark.createDataFrame([("p", text)], "path string, text string"))
    assert [r.scope for r in sy.import_uses(cf.imports(facts), cf.refs(facts)).collect()] == ["g"]


def test_unused(facts):
    unused = sy.unused_globals(cf.assigns(facts), cf.refs(facts))
    assert unused.count() == 0
    left = sy.unused_imports(cf.imports(facts), cf.refs(facts)).collect()
    assert sorted(r.code for r in left) == ["from web import App, incoming as inc", "import requests"]
    assert [r.name for r in sy.instance_uses(cf.assigns(facts), cf.refs(facts)).collect()] == ["service"]


def test_the_main_block_uses_instances_only(spark):
    text = (
        "import os\nimport re\nLIMIT = 1\napp = Flask(name)\nother = Flask(name)\napp = None\n"
        "def f():\n    return re\nif __name__ == '__main__':\n    app.run(os, LIMIT)\n"
    )
    facts = cf.symbol_facts(spark.createDataFrame([("p", text)], "path string, text string"))
    assigns, refs = cf.assigns(facts), cf.refs(facts)
    assert sorted(r.name for r in sy.unused_globals(assigns, refs).collect()) == ["LIMIT", "other"]
    assert [r.code for r in sy.unused_imports(cf.imports(facts), refs).collect()] == ["import os"]
    made = sy.instance_uses(assigns, refs).collect()
    assert [(r.name, r.code, r.call_class) for r in made] == [("app", "app = None", "Flask")]


def test_standard_modules_are_those_of_one_release(spark):
    said = spark.createDataFrame([("import tomllib",), ("import _thread",), ("import distutils",)], "s string")
    got = {r.s: r.g for r in said.select("s", sy.import_group(F.col("s")).alias("g")).collect()}
    assert got == {"import tomllib": "third_party", "import _thread": "standard", "import distutils": "standard"}


def test_signature(facts):
    from lintlake.functions import text as tx

    rows = cf.functions(facts).select("name", tx.signature(F.col("name"), F.col("args"), F.col("returns")).alias("s"))
    assert {r.name: r.s for r in rows.collect()}["enter"] == "def enter(a: int, b: Any) -> str"


def test_merge_and_groups(spark):
    rows = [("p", 0, None, "requests", None), ("p", 1, None, "zlib", None), ("p", 2, "numpy", "b", "x"),
            ("p", 3, "numpy", "a", None), ("p", 4, "numpy", "b", None), ("p", 5, ".util", "q", None), ("p", 6, "xyz", "q", None)]
    imports = spark.createDataFrame(rows, "path string, pos int, module string, name string, alias string")
    merged = sy.merged_imports(imports)
    assert sorted(r.statement for r in merged.collect()) == [
        "from .util import q", "from numpy import a, b", "from xyz import q", "import requests", "import zlib",
    ]
    group = {r.statement: r.g for r in merged.select("statement", sy.import_group(F.col("statement")).alias("g")).collect()}
    assert group["import requests"] == "standard"  # because of "re"
    exact = {r.statement: r.g for r in merged.select("statement", sy.import_group(F.col("statement"), exact=True).alias("g")).collect()}
    assert exact["import requests"] == "third_party" and exact["import zlib"] == "standard"
    assert exact["from .util import q"] == "local"
    kept = sy.merged_imports(imports, keep_alias=True)
    assert "from numpy import a, b, b as x" in [r.statement for r in kept.collect()]


def test_organised_module(spark, sample):
    text = sample + "\nLIMIT = 3\nLIMIT = 4\nbox = Box(LIMIT)\nplain = 1\nclass Z:\n    pass\n"
    files = spark.createDataFrame([("s.py", text)], "path string, text string")
    got = repair.organised(files).first().code
    tree = ast.parse(text)
    moved = {"service", "ADMIN", "SECRET_WORD", "LIMIT", "box"}
    rest = [
        n for n in tree.body
        if not isinstance(n, (ast.Import, ast.ImportFrom)) and not (isinstance(n, ast.Assign) and n.targets[0].id in moved)
    ]
    assert got == (
        "import requests\nimport shelve\n\nfrom web import App, incoming"
        "\n\nADMIN = 'root'\nSECRET_WORD = 'hunter2'\nLIMIT = 4\n\nservice = App(name)\nbox = Box(LIMIT)\n\n"
    ) + ast.unparse(ast.Module(body=rest, type_ignores=[]))
    ast.parse(got)


def test_combined_module(spark):
    one = "import b\ndef f():\n    return 1\ndef f():\n    return 2\ndef g():\n    pass\n"
    two = "import a\nimport b\ndef h():\n    import zzz\n    def inner(): pass\ndef f():\n    return 3\ndef f():\n    return 4\n"
    rows = [("x", 1, "one.py", one), ("x", 2, "two.py", two), ("y", 1, "three.py", "import q\n")]
    got = {r.project: r.code for r in repair.combined(spark.createDataFrame(rows, "project string, file_id int, path string, text string")).collect()}
    assert got["x"] == (
        "import a\nimport b\n\ndef f():\n    return 3\n\ndef g():\n    pass\n\n"
        "def h():\n    import zzz\n\n    def inner():\n        pass\n\n"
        'if __name__ == "__main__":\n    f()\n    g()\n    h()'
    )
    assert got["y"] == 'import q\n\nif __name__ == "__main__":\n    '


def test_import_map(spark):
    facts = cf.symbol_facts(spark.createDataFrame([("p", "import a\nfrom b import c, d\nfrom b import c\nimport b\n")], "path string, text string"))
    assert sorted((r.module, r.names) for r in sy.import_map(cf.all_imports(facts)).collect()) == [("a", ""), ("b", "c, d, c")]
    turned = cf.all_imports(facts).withColumn("alias_pos", -F.col("alias_pos"))
    assert ("b", "d, c, c") in [(r.module, r.names) for r in sy.import_map(turned).collect()]


def test_leading_blocks(spark):
    text = "# top\n\n# a\n  @b\ndef f():\n    # in\n    pass\n@c\nasync def g(): pass\n#x\ndef h(): pass\ndef i(): pass"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = [(r.line, r.name, r.block) for r in cf.leading_lines(df, ["path"]).collect()]
    assert got == [(5, "f", "# a\n@b"), (11, "h", "#x")]
    df = spark.createDataFrame([("p", "x = 1\r\n\t# note\t\r\n@route\t\r\ndef f(): pass\r\n"), ("q", "def g(): pass"), ("n", None)], "path string, text string")
    assert [tuple(r) for r in cf.leading_lines(df, ["path"]).collect()] == [("p", 4, "f", "# note\n@route")]


def test_strip_comments(spark):
    source = '"""doc"""\nx = 1  # c\ndef f():\n    """doc\n    more"""\n    s = "# no"\n    return s + \\\n        "t"\n'
    df = spark.createDataFrame([("a", source), ("bad", "x = (\n"), ("e", "")], "path string, text string")
    got = {r.path: r for r in cf.strip_comments(df).collect()}
    assert got["a"].code == '\nx = 1  \ndef f():\n    \n    s = "# no"\n    return s +        "t"\n'
    assert got["bad"].code is None and got["bad"].error
    assert got["e"].code == ""


def test_test_plan(spark):
    methods = spark.createDataFrame([("p", 0, "main", "m"), ("p", 1, "f", "c")], "path string, pos int, name string, code string")
    plan = sy.test_plan(methods).collect()
    assert [(r.name, r.test_type) for r in plan] == [("f", "positive"), ("f", "negative"), ("f", "boundary")]


SCRIPT_WITH_PARTS = '''import os, sys
import json
import json
from a import b
early = Maker(x)
late = Maker(early)
spare = 1
spare = 2
held = early
def f():
    return os, held
if __name__ == '__main__':
    early.run()
x = Other()
if '__main__' == __name__:
    late.run(); early.stop()
'''


def test_script_parts(spark):
    from lintlake.plans import repair

    rows = [("a.py", SCRIPT_WITH_PARTS), ("empty.py", ""), ("bad.py", "def ("), ("none.py", None), ("m.py", "if x == '__main__':\n    pass")]
    found = repair.script_parts(spark.createDataFrame(rows, "path string, text string")).collect()
    parts = {(r.path, r.part): r.text for r in found}
    assert len(found) == 9 and {r.page for r in found} == {0}
    # sys is part of a statement that is used; json is not used and stands twice
    assert parts["a.py", "import_statements"] == "import json\nimport json\nfrom a import b"
    # the last assignment at the place of the first; instances count as used once a main block uses them
    assert parts["a.py", "global_variables"] == "spare = 2\nx = Other()"
    assert parts["a.py", "main_script"] == "late = Maker(early)\nearly = Maker(x)\nif '__main__' == __name__:\n    late.run(); early.stop()"
    assert {parts["empty.py", p] for p in ("import_statements", "global_variables", "main_script")} == {""}
    assert parts["m.py", "main_script"] == "if x == '__main__':\n    pass"


@pytest.mark.parametrize("job", [repair.script_parts, repair.sections])
def test_facts_are_never_broadcast(files, job, tmp_path, capsys):
    """A parsed file is many more rows than Spark takes it for."""
    files.write.parquet(f"{tmp_path}/files")
    job(files.sparkSession.read.parquet(f"{tmp_path}/files")).explain()
    assert "Broadcast" not in capsys.readouterr().out
