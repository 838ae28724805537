"""The engine end to end: command line, tools, JSON-RPC, shell, settings and streams."""

import io
import json

import pytest

import corvane
from corvane.config import Config, ConfigError, load_config
from corvane.engine import Engine, NoIndex
from corvane.serving import cli, server, shell
from corvane.serving.color import enabled, styler
from corvane.serving.tools import TOOLS, call_tool
from corvane.streaming.refresh import FileTable, changed_files, refresh_stream

FILES = {
    "src/login.js": "import { db } from './db.js';\n\nexport function login(user) {\n  return db(user);\n}\n",
    "src/db.js": "export function db(user) {\n  return user;\n}\n",
    "README.md": "login docs\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return base


@pytest.fixture(scope="module")
def engine(spark, root):
    with pytest.raises(NoIndex):
        Engine(root, spark).index  # noqa: B018
    e = Engine(root, spark)
    e.build()
    return e


def test_config(tmp_path):
    assert load_config(tmp_path) == Config()
    home = tmp_path / ".corvane"
    home.mkdir()
    (home / "config.json").write_text('{"top": 3, "chunkMaxLines": 9, "mine": 1}')
    c = load_config(tmp_path)
    assert (c.top, c.chunk_max_lines, c.budget, c.extra) == (3, 9, 8000, {"mine": 1})
    for text, message in (("{", "invalid JSON"), ("[1]", "must contain a JSON object")):
        (home / "config.json").write_text(text)
        with pytest.raises(ConfigError, match=message):
            load_config(tmp_path)


def test_build_without_saving(spark, tmp_path):
    (tmp_path / "a.py").write_text("def alpha():\n    pass\n")
    e = Engine(tmp_path, spark)
    e.build(save=False)
    assert not (tmp_path / ".corvane").exists() and e.query("alpha")[0].symbol == "alpha"


def test_cli(engine, root, monkeypatch, capsys):
    monkeypatch.chdir(root)
    assert cli.main(["ask", "login", "--top", "2"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 and lines[0].startswith("src/login.js:L3-6 [login] ")
    assert cli.main(["ask", "login", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["file"] == "src/login.js"
    assert cli.main(["pack", "login", "--budget", "15", "--out", "p.md"]) == 0
    assert "packed" in capsys.readouterr().err and (root / "p.md").read_text().startswith("# corvane pack: login")
    (root / "p.md").unlink()
    assert cli.main(["outline", "src/db.js"]) == 0
    assert capsys.readouterr().out == "src/db.js\n  function db  (L1-L4)\n"
    assert cli.main(["stats"]) == 0
    assert capsys.readouterr().out == "files: 3\nchunks: 4\nlanguages:\n  js: 2\n  text: 1\n"
    assert cli.main(["nope"]) == 1 and capsys.readouterr().err.startswith("corvane: ")
    assert cli.main(["ask"]) == 1 and cli.main(["ask", "x", "--top", "1.5"]) == 1
    assert "non-negative integer" in capsys.readouterr().err
    assert cli.main([]) == 0 and cli.main(["version"]) == 0


def test_colours():
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    assert not enabled(Terminal(), {"NO_COLOR": "1", "FORCE_COLOR": "1"}) and enabled(io.StringIO(), {"FORCE_COLOR": "1"}) and not enabled(Terminal(), {"FORCE_COLOR": "0"})
    assert styler(Terminal(), {})("cyan", "x") == "\x1b[36mx\x1b[39m" and styler(io.StringIO(), {})("cyan", "x") == "x"


def test_index_command_and_api(spark, tmp_path):
    (tmp_path / "a.py").write_text("def alpha():\n    pass\n")
    assert cli.main(["index", str(tmp_path), "--json"]) == 0
    doc = json.loads((tmp_path / ".corvane/index.json").read_text())
    assert doc["fileCount"] == 1 and doc["files"][0]["symbols"] == [{"name": "alpha", "kind": "def", "line": 1, "endLine": 3}]
    index = corvane.load_index(spark, tmp_path)
    assert corvane.query(tmp_path, "alpha")[0].symbol == "alpha" and corvane.outline_repo(index) == "a.py (def alpha)" and corvane.outline_file(index, "b") is None
    assert corvane.rank(index, "alpha")[0].file == "a.py"


def test_tools(engine):
    assert [t["name"] for t in TOOLS] == ["corvane_search", "corvane_outline", "corvane_read", "corvane_neighbors", "corvane_pack"]
    assert call_tool("corvane_search", {"query": "login", "top": 1}, engine).startswith("src/login.js:L3-6 [login]")
    assert call_tool("corvane_search", {"query": "zzz"}, engine) == "nothing found"
    assert call_tool("corvane_outline", {}, engine).splitlines() == ["src/", "  db.js (function db)", "  login.js (function login)", "README.md"]
    assert call_tool("corvane_outline", {"path": "nope"}, engine) == "(no files under nope)"
    assert call_tool("corvane_read", {"path": "./src/db.js", "symbol": "db"}, engine).splitlines()[0] == "1: export function db(user) {"
    assert call_tool("corvane_read", {"path": "src/db.js", "startLine": 2, "endLine": 2}, engine) == "2:   return user;"
    assert call_tool("corvane_read", {"path": "src/db.js", "startLine": 9}, engine) == ""
    assert call_tool("corvane_neighbors", {"path": "src/db.js"}, engine).splitlines() == ["imports (0):", "importedBy (1):", "  src/login.js"]
    assert call_tool("corvane_pack", {"task": "login", "budget": 0}, engine).startswith("# corvane pack: login")
    for args, message in (({"path": "../x"}, "path escapes root"), ({"path": "src/db.js", "symbol": "no"}, 'declares no "no"'), ({}, 'give its "path"')):
        with pytest.raises(ValueError, match=message):
            call_tool("corvane_read", args, engine)


@pytest.mark.parametrize(
    ("line", "code"),
    [
        ("{bad", -32700), ("[]", -32600), ('{"jsonrpc":"1.0","id":1,"method":"ping"}', -32600), ('{"jsonrpc":"2.0","id":{},"method":"ping"}', -32600), ('{"jsonrpc":"2.0","id":1}', -32600),
        ('{"jsonrpc":"2.0","id":1,"method":"nope"}', -32601), ('{"jsonrpc":"2.0","id":1,"method":"tools/call"}', -32602), ('{"jsonrpc":"2.0","id":1,"method":"ping","params":[]}', -32602),
        ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":1}}', -32602), ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"x","arguments":3}}', -32602),
        ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"x"}}', -32603),
    ],
)
def test_rpc_errors(engine, line, code):
    assert server.handle(line, engine)["error"]["code"] == code


def test_rpc(engine):
    assert server.handle('{"jsonrpc":"2.0","id":"a","method":"initialize"}', engine)["result"]["protocolVersion"] == "2024-11-05"
    assert server.handle('{"jsonrpc":"2.0","id":0,"method":"ping"}', engine) == {"jsonrpc": "2.0", "id": 0, "result": {}}
    assert len(server.handle('{"jsonrpc":"2.0","id":1,"method":"tools/list"}', engine)["result"]["tools"]) == 5
    for silent in ("", '{"jsonrpc":"2.0","method":"ping"}', '{"jsonrpc":"2.0","id":3,"result":{}}'):
        assert server.handle(silent, engine) is None
    out = io.StringIO()
    server.serve(engine, io.StringIO('{"jsonrpc":"2.0","id":7,"method":"tools/call","params":{"name":"corvane_search","arguments":{"query":"login"}}}\n'), out)
    assert json.loads(out.getvalue())["result"]["content"][0]["text"].startswith("src/login.js")


def test_shell(engine):
    out = io.StringIO()
    shell.run(engine, source=io.StringIO("login\n1\n99\np login\nzzz\nhelp\nq\n"), sink=out)
    text = out.getvalue()
    assert "│ 3  export function login(user) {" in text and "no result 99" in text and "# corvane pack: login" in text and "nothing found" in text and text.endswith("closed\n")


def test_changed_files(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert sorted(map(tuple, changed_files(old, new.where("path != 'a'"), []).collect())) == [("a", "removed"), ("b", "changed"), ("d", "added")]


def test_refresh_stream(spark, tmp_path):
    rows = [("x", "old", 1), ("y", "only", 1), ("x", "new", 2), (None, "z", 1)]
    for i in range(0, 4, 2):
        spark.createDataFrame(rows[i : i + 2], "path string, text string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = FileTable(spark, f"file://{tmp_path}/out", [])
    seen = []
    stream = spark.readStream.schema("path string, text string, version long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh_stream(stream, target, str(tmp_path / "cp"), lambda b, n: seen.append(n)).awaitTermination()
    assert sorted((r.path, r.text) for r in target.read().collect()) == [("x", "new"), ("y", "only")] and len(seen) == 2
    target.upsert(spark.createDataFrame([("x", "older", 0)], "path string, text string, version long"))
    assert sorted((r.path, r.text) for r in FileTable(spark, f"file://{tmp_path}/out", []).read().collect()) == [("x", "new"), ("y", "only")]
