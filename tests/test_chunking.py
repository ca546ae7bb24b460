from spindrift.chunking.files import chunk_files, parse

PY = '''import os
from sys import path

def load(name):
    return open(os.path.join(name)).read()

@decorated
def hidden():
    pass

class Store:
    """A store."""

    def __init__(self, root):
        self.root = root

    async def fetch(self, key):
        return await self.client.get(key)

CONST = 1
'''
TS = '''import { a } from "./a";

export interface Shape {
  area: number;
  name?: string;
}

export default function () {
  return build("}", /[/}]/, `${run({x: 1})}`);
}

// function ghost() {}
export class Client extends Base {
  private url: string = "x";
  constructor(url: string) { super(url); this.start(); }
  async get<T>(path: string): Promise<T> {
    return this.http.send(new Request(path));
  }
}
const arrow = () => call();
function last() { if (ok()) { go(); } }
'''
DART = '''import 'dart:io';

int twice(int x) => x + add(x);

abstract class Animal {
  final String name;
  Animal(this.name);
  Animal.named(String n) : name = n;
  @override
  String get label => name.trim();
  set label(String v) { notify(v); }
  Future<Map<String, int>> count() async { return Counter(fetch()); }
  void speak();
}

extension Ext on String { bool get empty => isBlank(this); }
mixin Logs { void log(String s) { print(s); } }
'''


def by_name(chunks):
    return {(c["chunk_type"], c["name"]): c for c in chunks}


def test_python():
    got = by_name(parse("a.py", PY, "python"))
    assert set(got) == {("function", "load"), ("class", "Store"), ("method", "__init__"), ("method", "fetch")}
    assert got["function", "load"]["calls"] == ["join", "open", "read"]
    assert got["class", "Store"]["content"] == "class Store:\n  def __init__(self, root):\n  async def fetch(self, key):"
    assert got["method", "fetch"]["parent_name"] == "Store" and got["method", "fetch"]["calls"] == ["get"]
    assert got["function", "load"]["imports"] == ["import os", "from sys import path"]
    assert (got["function", "load"]["line_start"], got["function", "load"]["line_end"]) == (4, 5)


def test_python_that_does_not_parse():
    got = by_name(parse("a.py", "def ok(x):\n    return f(x)\n\nclass C:\n    def m(self):\n        pass\n\ndef broken(:\n    pass\n", "python"))
    assert ("function", "ok") in got and got["class", "C"]["outline"] == ["def m(self):"]


def test_long_functions_split_before_the_part_that_is_too_much():
    body = "\n".join(f"    x{i} = f{i}(\n        {i},\n    )" for i in range(10))
    got = parse("a.py", f"def big():\n{body}\n", "python", 7)
    assert [c["name"] for c in got] == [f"big__part{i}" for i in range(1, 6)]
    assert all(c["line_end"] - c["line_start"] + 1 == 6 for c in got)
    assert got[0]["calls"] == got[4]["calls"]


def test_typescript():
    got = by_name(parse("src/index.ts", TS, "typescript"))
    assert set(got) == {("class", "Shape"), ("function", "index"), ("class", "Client"), ("method", "constructor"), ("method", "get"), ("function", "last")}
    assert got["class", "Shape"]["outline"] == ["area: number;", "name?: string;"]
    assert got["function", "index"]["calls"] == ["build"]
    assert got["method", "get"]["calls"] == ["send"]
    assert got["method", "constructor"]["calls"] == ["start"]
    assert got["function", "last"]["calls"] == ["go", "ok"]


def test_javascript_has_no_interfaces():
    assert parse("a.js", "interface X { a: 1 }", "javascript") == []


def test_dart():
    got = parse("a.dart", DART, "dart")
    names = [(c["chunk_type"], c["name"], c["parent_name"]) for c in got]
    assert names == [
        ("function", "twice", ""),
        ("class", "Animal", ""),
        ("method", "Animal", "Animal"),
        ("method", "named", "Animal"),
        ("method", "label", "Animal"),
        ("method", "label", "Animal"),
        ("method", "count", "Animal"),
        ("class", "Ext", ""),
        ("method", "empty", "Ext"),
        ("class", "Logs", ""),
        ("method", "log", "Logs"),
    ]
    assert got[0]["calls"] == ["add"] and got[6]["calls"] == ["fetch"]
    assert got[4]["line_start"] == 9  # with its annotation


def test_blank_and_unknown_files():
    assert parse("a.py", "  \n", "python") == [] and parse("a.py", None, "python") == [] and parse("a.rb", "x", "ruby") == []


def test_odd_sources_do_not_crash():
    for source in ("{", "}}}", "class", "class {", "function (", "'", "`${", "/*", "export default", "@", "import", "a => {", "get x"):
        for path, language in (("a.ts", "typescript"), ("a.js", "javascript"), ("a.dart", "dart"), ("a.py", "python")):
            parse(path, source, language)


def test_operator(spark):
    df = spark.createDataFrame([("a.py", PY, "h", "python"), ("b.py", None, "i", "python")], "file_path string, content string, file_hash string, language string")
    rows = chunk_files(df).collect()
    assert len(rows) == 4 and {r["file_hash"] for r in rows} == {"h"}
