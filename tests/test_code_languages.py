"""Extractors of languages with braces, the registry, git history, rules of questions and embedders."""

import subprocess
import time

import pytest
from pyspark.sql import functions as F

from bitempo.functions import embed
from bitempo.model import SCHEMAS, empty
from bitempo.operators import code
from bitempo.operators.retrieval import classify

GO = """package main
import (
 "fmt"
 s "strings"
)
type Cat struct { Name string }
func (c *Cat) Meow() string { return c.name() }
func (c *Cat) name() string { return s.ToUpper(c.Name) } // {
func main() {
 if ok(1) { fmt.Println("}") }
}
"""
RUST = """use std::{io, fs::{self, File}};
pub struct Cat { name: String }
impl<'a> Animal for Cat {
    pub fn meow(&self) -> String { self.purr(); let c = '{'; helper(r#"}"#) }
    fn purr(&self) {}
}
trait Animal { fn meow(&self) -> String; }
mod inner { fn deep() { helper() } }
"""
JAVA = """package com.acme;
import java.util.List;
@Entity(name = "cats")
public class Cat<T extends X> extends Animal implements a.Pet, Loud<T> {
    private int n = size();
    @Named("m") public String meow() { return this.purr("}"); }
    public Cat(String n) { super(n); }
    private String purr(String x) { return x.trim(); }
}
"""
PHP = """<html>{<?php
namespace App;
use A\\{B, C as D};
# note {
class Cat extends Animal implements Pet {
    public function meow(): string { return $this->purr(); }
    private function purr() { return strtoupper("x{"); }
}
function hi() { return new Cat(); }
"""
TYPESCRIPT = """import { a, b } from "./x"
export default class Cat<T> extends ns.Animal implements Pet {
  name: string = make()
  constructor(n: string) { super(n) }
  async meow(x: number): Promise<void> {
    if (x) { this.purr() }
  }
  private purr() { return /[{"]/.test(`}`) }
}
export const go = async (n: number) => {
  run(n)
}
const one = x => two(x)
export function main(cb = () => {}) {
  [1].map(v => { inner(v) })
}
"""
WANT = {
    "go": (GO, {"main": "module", "Cat": "class", "Cat.Meow": "method", "Cat.name": "method", "main()": "function"}, {("main", "IMPORTS", "fmt"), ("main", "IMPORTS", "strings"), ("Cat.Meow", "CALLS", "Cat.name"), ("Cat.name", "CALLS", "ToUpper"), ("main", "CALLS", "ok"), ("main", "CALLS", "Println")}),
    "rust": (RUST, {"m": "module", "Cat": "class", "Cat.meow": "method", "Cat.purr": "method", "Animal": "class", "Animal.meow": "method", "deep": "function"}, {("m", "IMPORTS", "std::io"), ("m", "IMPORTS", "std::fs"), ("m", "IMPORTS", "std::fs::File"), ("Cat", "INHERITS_FROM", "Animal"), ("Cat.meow", "CALLS", "Cat.purr"), ("Cat.meow", "CALLS", "helper"), ("deep", "CALLS", "helper")}),
    "java": (JAVA, {"com.acme": "module", "Cat": "class", "Cat.meow": "method", "Cat.Cat": "method", "Cat.purr": "method"}, {("com.acme", "IMPORTS", "java.util.List"), ("Cat", "INHERITS_FROM", "Animal"), ("Cat", "INHERITS_FROM", "Pet"), ("Cat", "INHERITS_FROM", "Loud"), ("Cat.meow", "CALLS", "Cat.purr"), ("Cat.purr", "CALLS", "trim")}),
    "php": (PHP, {"App": "module", "Cat": "class", "Cat.meow": "method", "Cat.purr": "method", "hi": "function"}, {("App", "IMPORTS", "A\\B"), ("App", "IMPORTS", "A\\C"), ("Cat", "INHERITS_FROM", "Animal"), ("Cat", "INHERITS_FROM", "Pet"), ("Cat.meow", "CALLS", "Cat.purr"), ("Cat.purr", "CALLS", "strtoupper"), ("hi", "CALLS", "Cat")}),
    "typescript": (TYPESCRIPT, {"m": "module", "Cat": "class", "Cat.constructor": "method", "Cat.meow": "method", "Cat.purr": "method", "go": "function", "one": "function", "main": "function"}, {("m", "IMPORTS", "./x"), ("Cat", "INHERITS_FROM", "Animal"), ("Cat", "INHERITS_FROM", "Pet"), ("Cat.meow", "CALLS", "Cat.purr"), ("Cat.purr", "CALLS", "test"), ("go", "CALLS", "run"), ("one", "CALLS", "two"), ("main", "CALLS", "map"), ("main", "CALLS", "inner")}),
}


@pytest.mark.parametrize("language", list(WANT))
def test_structure_and_calls(language):
    source, names, links = WANT[language]
    e, s, c = code.extract(source, language, "m")
    assert sorted((x[1], x[0]) for x in e) == sorted((n.rstrip("()"), k) for n, k in names.items())
    assert {(x[0], x[2], x[1]) for x in s + c if x[2] != "DEFINES"} == links
    hidden = {x[1] for x in e if x[6] == "private"}
    assert {"go": {"Cat.name", "main"}, "rust": {"Cat.purr", "Animal", "Animal.meow", "deep"}}.get(language, {"Cat.purr"}) == hidden


@pytest.mark.parametrize("language", list(WANT))
def test_hostile_files_take_linear_time(language):
    for bad in ("", "{" * 40000, "}" * 40000, "(" * 40000, '"' * 40001, "/*" * 40000, "class a " * 10000, "func f() {" * 10000, "import {" * 5000, "impl <" * 5000 + "{", "a (b" * 5000 + "{"):
        start = time.time()
        assert code.extract(("<?php " if language == "php" else "") + bad, language, "m")[0][0][0] == "module"
        assert time.time() - start < 5, bad[:10]


def test_registry_and_spark(spark):
    with pytest.raises(ValueError, match="unsupported language"):
        code.extract("x", "cobol", "m")
    files = spark.createDataFrame([("a.go", GO), ("b/index.ts", TYPESCRIPT), ("e.rs", None), ("n.txt", "x")], "path string, content string")
    got = {(r.path, r.name, r.type) for r in code.extract_entities(files).collect()}
    assert {("a.go", "Cat.Meow", "method"), ("b/index.ts", "go", "function"), ("e.rs", "e", "module")} <= got
    assert not any(p == "n.txt" for p, _, _ in got)
    old = code.PARSERS["go"]
    try:
        code.register("go", lambda source, module: ([("module", "mine", 1, 1, None, None, "public")], [], []))
        assert {r.name for r in code.extract_entities(files.where("path = 'a.go'")).collect()} == {"mine"}
    finally:
        code.register("go", old)


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("def login(user):\n    pass\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("def login(user, password):\n    pass\n\n\ndef logout():\n    pass\n")
    (tmp_path / "b.rs").write_bytes(b"fn bite() {} // \xff\n")
    git("add", "."), git("commit", "-qm", "two")
    new, old = code.git_commits(str(tmp_path))
    none = {n: empty(spark, n) for n in SCHEMAS}
    names = lambda t: {(r.code_commit_sha, r.name) for r in t["entities"].where("type = 'function'").collect()}
    assert names(code.ingest_history(none, str(tmp_path), "2024-01-01")) == {(new, "login"), (new, "logout"), (new, "bite")}
    full = code.ingest_history(none, str(tmp_path), "2024-01-01", mode="full", paths=["*.py", "a.py"])
    assert names(full) == {(old, "login"), (new, "login"), (new, "logout")}
    assert {tuple(r) for r in code.diff(full["entities"], old, new).collect()} == {("added", "logout"), ("changed", "login")}


def test_rules_and_embedders(spark):
    asked = spark.createDataFrame([("zap the cat",), ("who owns it",), (None,)], "query string")
    assert [r["class"] for r in classify(asked, {"CODE": [r"\bzap\b"]}).collect()] == ["CODE", "FACT", "VIBE"]
    with pytest.raises(ValueError, match="class of questions"):
        classify(asked, {"NONE": ["x"]})
    with pytest.raises(ValueError, match="unknown embedder"):
        embed.embedder("none")
    assert len(embed.embedder("auto", 8)(asked, "query").first().vector) == 8
    try:
        embed.register("lengths", lambda texts: [[len(t)] for t in texts])
        assert [r.vector for r in embed.embedder()(asked, "query").collect()] == [[11.0], [11.0], [0.0]]
    finally:
        del embed.EMBEDDERS["lengths"]
    name = spark.createDataFrame([("Cat", "About pets."), ("Cat", None), ("Cat", "")], "name string, context string")
    assert [r[0] for r in name.select(embed.contextual(F.col("name"), F.col("context"))).collect()] == ["About pets.\nCat", "Cat", "Cat"]
