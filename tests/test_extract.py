"""Extractors on small sources."""

from symgraph.extract import detect_language, extract_file

GO = b'''package shop

import (
	"fmt"
	st "shop/internal/store"
)

type Cart struct{ items []string }
type Pricer interface{ Price() int }
type Alias = Cart

const Limit = 3

var total, other int

func (c *Cart) Add(x string) error {
	const inner = "{("
	var seen int // not a call()
	fmt.Println(x, inner)
	st.Save(c)
	Map[string, int](nil, '(')
	go func() { c.flush() }()
	return helper(`raw ( text`)
}

func Map[K comparable, V any](m map[K]V, r rune) {}
func helper(s string) error { return nil }
'''


def by_name(result):
    return {n["qualified_name"]: n for n in result.nodes}


def test_go():
    r = extract_file("shop/cart.go", GO)
    assert r.errors == []
    kinds = {n["qualified_name"]: n["kind"] for n in r.nodes}
    assert kinds == {
        "fmt": "import", "st": "import", "Cart": "struct", "Pricer": "interface", "Alias": "type_alias", "Limit": "constant", "total": "variable", "other": "variable",
        "Cart.Add": "method", "inner": "constant", "seen": "variable", "Map": "function", "helper": "function",
    }
    n = by_name(r)
    assert n["fmt"]["name"] == "fmt" and n["st"]["import_module"] == "shop/internal/store" and not n["st"]["is_exported"]
    assert n["Cart.Add"]["signature"] == "func (c *Cart) Add(x string) error" and (n["Cart.Add"]["start_line"], n["Cart.Add"]["end_line"]) == (16, 24)
    assert n["Cart.Add"]["is_exported"] and not n["helper"]["is_exported"]
    assert [(e["target"], e["callee_text"]) for e in r.edges] == [
        ("name:Println", "fmt.Println"), ("name:Save", "st.Save"), ("name:Map", "Map"), ("name:flush", "c.flush"), ("name:helper", "helper"),
    ]
    first = r.edges[0]
    assert (first["line"], first["col"]) == (19, 12) and first["source"] == "shop/cart.go::Cart.Add::16"


def test_go_that_does_not_parse_keeps_what_was_seen():
    r = extract_file("a.go", b"package a\n\nfunc Good() { other() }\n\nfunc Bad( {\n")
    assert "Good" in by_name(r) and any("parse failed" in e for e in r.errors)
    assert extract_file("b.go", b"").errors and extract_file("c.go", b"\xff\xfe junk").errors


def test_go_callees():
    r = extract_file("a.go", b"package a\nfunc f() {\n\ta.b.c()\n\tg()()\n\tx[0].y()\n\t(h)()\n\tnew(T).Do(len(z))\n\tif v := k(); v {\n\t}\n}\n")
    assert [(e["target"][5:], e["callee_text"]) for e in r.edges] == [("c", "a.b.c"), ("g", "g"), ("y", "x.y"), ("Do", ".Do"), ("new", "new"), ("len", "len"), ("k", "k")]


PY = b'''import os.path as osp, sys
from pkg.mod import thing as other, more,

class Box(Base):
    """Holds things."""

    @staticmethod
    def make(x):
        return helper(x)

    async def run(self):
        def inner():
            self.a.b(1)
            if (1): pass
        class Local:
            pass
        await other (2)

def helper(y):
\treturn y
'''


def test_python():
    r = extract_file("pkg/box.py", PY)
    n = by_name(r)
    assert [x["qualified_name"] for x in r.nodes] == ["os.path", "sys", "pkg.mod.thing", "pkg.mod.more", "Box", "Box.make", "Box.run", "Box.inner", "Box.Local", "helper"]
    assert n["os.path"]["id"] == "pkg/box.py::osp::1" and n["os.path"]["name"] == "osp"
    assert (n["pkg.mod.thing"]["name"], n["pkg.mod.thing"]["import_symbol"]) == ("other", "thing")
    assert n["Box"]["docstring"] == "Holds things." and n["Box"]["end_line"] == 17
    assert n["Box.make"]["is_static"] and n["Box.make"]["kind"] == "method" and n["Box.make"]["signature"] == "def make(x)"
    assert n["Box.run"]["is_async"] and n["Box.inner"]["kind"] == "function" and n["Box.Local"]["kind"] == "class"
    contains = [(e["source"].split("::")[1], e["target"].split("::")[1]) for e in r.edges if e["kind"] == "contains"]
    assert contains == [("Box", "Box.make"), ("Box", "Box.run"), ("Box.run", "Box.inner"), ("Box.run", "Box.Local")]
    calls = [(e["source"].split("::")[1], e["target"], e["callee_text"]) for e in r.edges if e["kind"] == "calls"]
    assert calls == [("Box.make", "name:helper", "helper"), ("Box.inner", "name:b", "a.b"), ("Box.inner", "name:if ", "if "), ("Box.run", "name:other ", "other ")]


TS = b"""import { a, b as c } from './m';
import * as ns from "lib";
import Def from '@app/def';

export class Shop {
  static of(x) {
    return new Shop(x);
  }
  async load() {
    c.get(1);
  }
}

export async function main(q) {
  ns.run(q);
}
export default function skip() {}
const hidden = (x) => x;
export const go = async (x) => {
  hidden(x);
}
"""


def test_typescript():
    r = extract_file("src/shop.ts", TS)
    n = by_name(r)
    imports = [(x["name"], x["import_module"], x["import_symbol"]) for x in r.nodes if x["kind"] == "import"]
    assert imports == [("a", "./m", "a"), ("c", "./m", "b"), ("ns", "lib", "*"), ("Def", "@app/def", "default")]
    assert n["Shop"]["is_exported"] and n["Shop"]["end_line"] == 12
    assert n["Shop.of"]["is_static"] and n["Shop.load"]["is_async"] and n["Shop.load"]["is_exported"]
    assert n["main"]["is_async"] and n["main"]["is_exported"] and not n["skip"]["is_exported"] and not n["hidden"]["is_exported"] and n["go"]["is_async"]
    calls = {(e["source"].split("::")[1], e["callee_text"]) for e in r.edges if e["kind"] == "calls"}
    assert {("Shop.of", "Shop"), ("Shop.load", "c.get"), ("main", "ns.run"), ("go", "hidden")} <= calls
    assert all(e["col"] == 0 for e in r.edges if e["kind"] == "calls")


def test_tsx_and_languages():
    r = extract_file("ui/App.tsx", "function App() {\n  return <b>{later('é')}</b>;\n}\nfunction later(x) {}\n".encode())
    assert [e["target"] for e in r.edges] == ["name:later"] and r.language == "tsx"
    assert [detect_language(p) for p in ("A.PY", "x.d.mts", "y.JSX", "z.go", "w.txt", "Makefile", "a.b/c")] == ["python", "typescript", "javascript", "go", "", "", ""]


def test_empty_and_unknown():
    for path in ("a.py", "a.ts", "a.js"):
        r = extract_file(path, b"")
        assert not (r.nodes or r.edges or r.errors)
    assert not extract_file("a.txt", b"def x(): pass").nodes


def test_sources_of_a_small_table_are_dealt_to_all_cores(spark):
    from symgraph import queries

    sf, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    assert queries._all_sources(spark, sf).rdd.getNumPartitions() > cores
    assert queries._sources(spark, sf, ".go", lambda w: w).rdd.getNumPartitions() > cores
