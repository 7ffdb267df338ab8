"""Functions of every language: names, lines, parameters, summaries, what is published; braces and words in strings count for nothing."""

import pytest

from sparkloom.sources import lexers

C = '''#include <stdio.h>
int add(int a, int b);

/**
 * @brief Add two numbers.
 * @param a the first
 */
int
add(int a, int b)
{
    if (a && b) { return a + b; } /* } */
    return 0;
}

/// A helper.
static void helper(const char *name, int *out[], void (*call)(int)) { printf("{ %s", name); }
#define MAX(a) { (a)
struct point { int x; };
int main(void) { for (;;) { while (1) ; } }
'''
H = '''int add(int a, int b);
/* Multiply them. */
double mul(double x, double y);
typedef struct p { int x; } p;
'''
CPP = '''namespace app {
class Thing : public Base {
    int secret(int n);
public:
    /// Do the thing.
    virtual void go(std::map<int, int> m, int n = 3) const;
    explicit Thing(int n) : n_(n) {}
private:
    bool check() { return n_ > 0; }
    int n_;
};
struct Pair { int size() const { return 2; } };
}
// Do the thing, at last.
void Thing::go(std::map<int, int> m, int n) const {
    auto f = [&](int x) { return x; };
    if (n) { call(n); }
}
template <typename T> T twice(T v) { return v + v; }
'''
JAVA = '''package com.example.app;
import java.util.List;

/** Greets people. */
public class Greeter {
    private static final int MAX = compute(3);
    /**
     * Greet one person.
     * @param name who
     */
    @Override
    public String greet(final String name, List<Map<String, Integer>> xs) {
        return "hi { " + name;
    }
    private int count(List<String> xs) { if (xs != null) { return xs.size(); } return 0; }
    protected void log() {
    }
    public Greeter() {
    }
    interface Doer { void doIt(int n); }
}
'''
CSHARP = '''namespace Acme.Tools;
/// <summary>A widget.</summary>
public class Widget
{
    /// <summary>Adds them.</summary>
    /// <param name="x">The first.</param>
    public int Add(int x, int y)
    {
        return x + y;
    }
    private void Helper(string s = "}") { }
    void Implicit() { }
    public int Twice(int n) => n * 2;
    public Widget() { }
    public int Size { get; set; }
}
interface IThing { void Go(ref int n); }
'''
DART = '''import 'dart:io';
/// A widget.
class Widget {
  final String name;
  int _count = 0;
  /// Builds one.
  Widget(this.name);
  /// Adds them.
  int add(int x, {required int y, int z = 2}) {
    return x + y;
  }
  void _helper() => print('{');
}
abstract class Doer {
  /// Do it.
  void go();
}
void main() {
  run(() { print(1); });
}
int _privateTopLevel(int a) => a;
'''
GO = '''package main

// Add adds.
func Add(a int, b int) int {
	return a + b
}
func sum(x, y int, rest ...string) (n int, err error) {
	s := "func fake() {"
	if x > 0 && y > 0 { return }
	return
}
type Widget struct { n int }
func (w *Widget) Run(f func(int) error) { }
type Thinger interface {
	// Go does it.
	Go(n int) error
	hidden()
}
'''
RUST = '''/// Adds.
pub fn add(a: i32, mut b: Vec<u8>) -> i32 { a }
fn private<'a>(x: &'a str) -> char { '{' }
impl Widget {
    pub fn new(name: String) -> Self { Widget { name } }
    fn helper(&self, n: usize) {}
    pub(crate) fn crate_only(&mut self) {}
}
trait Doer { fn go(&self, n: i32); }
impl Doer for Widget { fn go(&self, n: i32) { match n { _ => {} } } }
mod inner { pub fn nested() {} }
'''
KOTLIN = '''class Widget(val n: Int) {
    /** Adds them. */
    fun add(x: Int, y: Int = 3): Int {
        return x + y
    }
    private fun helper(s: String) = s.length
    protected fun guarded() {}
}
interface Doer { fun go(n: Int) }
fun String.shout(): String = this + "}"
fun <T> freeStanding(x: T) {
}
'''
SWIFT = '''/// A widget.
public class Widget {
    /// Adds them.
    public func add(_ x: Int, to y: Int) -> Int {
        return x + y
    }
    func moduleOnly() {}
    fileprivate func fileOnly(n: [Int]) {}
    public init(n: Int) { }
}
protocol Doer {
    func go(n: Int)
}
'''
SCALA = '''object A {
  /** Doubles it. */
  def twice(n: Int): Int = {
    n * 2
  }
  private def helper(s: String) = s.length
  def size = 3
}
trait Doer { def go(n: Int): Unit }
'''
PHP = '''<?php
namespace Acme;
class Widget {
    /** Adds them. */
    public function add(int $x, ?array &$y = []) { # }
        return $x;
    }
    private function helper() {}
}
interface Doer { public function go(string $s); }
function freeStanding(...$rest) { return "{"; }
'''
ZIG = '''/// Adds.
pub fn add(a: i32, b: i32) i32 { return a + b; }
fn private() void {}
'''
JS = '''// Adds them.
function add(a, b = 2) { return `{${a}`; }
export const twice = (n) => {
  return n * 2;
};
const once = async (n) => n
class Widget extends Base {
  constructor(name) { super(name); }
  /** Runs it. */
  async run(x, { y }) { if (x || y) { go(); } for (const a of x) { } }
  static build() { return new Widget(); }
  #hidden() { }
  handler = (e) => { this.run(e); };
}
module.exports.last = function (z) { return z; };
call(function () { return 1; });
'''
TS = '''export class Store<T> {
  private items: T[] = [];
  public get(id: string, fallback?: T): T | undefined { return this.items[0]; }
  private reset(): void { }
}
interface Api { load(id: number): Promise<void>; }
export function of<T>(x: T): Store<T> { return new Store<T>(); }
'''
RUBY = '''module Acme
  # A widget.
  class Widget
    # Adds them.
    def add(x, y = 2)
      if x && y
        return x + y
      end
      [1].each do |z|
        puts "end #{z}"
      end
    end
    def self.build; new; end
    private
    def helper(*rest)
      return 1 if rest
    end
  end
end
'''
ELIXIR = '''defmodule Acme.Widget do
  @doc "Adds two numbers."
  def add(x, y) do
    Enum.map([x], fn z -> z + y end)
  end
  defp helper(x), do: x
  def guarded(x) when x > 1 do
    if x do
      1
    else
      2
    end
  end
  defmodule Inner do
    def nested, do: 1
  end
end
'''
CASES = {
    ("c", "util.c", C): [("add", 8, 13, ["a", "b"], "Add two numbers.", False, 3), ("helper", 16, 16, ["name", "out", "call"], "A helper.", True, 1), ("main", 19, 19, [], "", False, 3)],
    ("c", "util.h", H): [("add", 1, 1, ["a", "b"], "", False, 1), ("mul", 3, 3, ["x", "y"], "Multiply them.", False, 1)],
    ("cpp", "thing.cpp", CPP): [("secret", 3, 3, ["n"], "", True, 1), ("go", 6, 6, ["m", "n"], "Do the thing.", False, 1), ("Thing", 7, 7, ["n"], "", False, 1), ("check", 9, 9, [], "", True, 1), ("size", 12, 12, [], "", False, 1), ("Thing::go", 15, 18, ["m", "n"], "Do the thing, at last.", False, 2), ("twice", 19, 19, ["v"], "", False, 1)],
    ("java", "Greeter.java", JAVA): [("Greeter.greet", 11, 14, ["name", "xs"], "Greet one person.", False, 1), ("Greeter.count", 15, 15, ["xs"], "", True, 2), ("Greeter.log", 16, 17, [], "", True, 1), ("Greeter", 18, 19, [], "", False, 1), ("Doer.doIt", 20, 20, ["n"], "", False, 1)],
    ("csharp", "W.cs", CSHARP): [("Widget.Add", 7, 10, ["x", "y"], "Adds them.", False, 1), ("Widget.Helper", 11, 11, ["s"], "", True, 1), ("Widget.Implicit", 12, 12, [], "", True, 1), ("Widget.Twice", 13, 13, ["n"], "", False, 1), ("Widget.Widget", 14, 14, [], "", False, 1), ("IThing.Go", 17, 17, ["n"], "", False, 1)],
    ("dart", "w.dart", DART): [("Widget.Widget", 7, 7, ["name"], "Builds one.", False, 1), ("Widget.add", 9, 11, ["x", "y", "z"], "Adds them.", False, 1), ("Widget._helper", 12, 12, [], "", True, 1), ("Doer.go", 16, 16, [], "Do it.", False, 1), ("main", 18, 20, [], "", False, 1), ("_privateTopLevel", 21, 21, ["a"], "", True, 1)],
    ("go", "m.go", GO): [("Add", 4, 6, ["a", "b"], "Add adds.", False, 1), ("sum", 7, 11, ["x", "y", "rest"], "", True, 3), ("Widget.Run", 13, 13, ["f"], "", False, 1), ("Thinger.Go", 16, 16, ["n"], "Go does it.", False, 1), ("Thinger.hidden", 17, 17, [], "", True, 1)],
    ("rust", "l.rs", RUST): [("add", 2, 2, ["a", "b"], "Adds.", False, 1), ("private", 3, 3, ["x"], "", True, 1), ("Widget::new", 5, 5, ["name"], "", False, 1), ("Widget::helper", 6, 6, ["n"], "", True, 1), ("Widget::crate_only", 7, 7, [], "", True, 1), ("Doer::go", 9, 9, ["n"], "", False, 1), ("Widget::go", 10, 10, ["n"], "", False, 1), ("inner::nested", 11, 11, [], "", False, 1)],
    ("kotlin", "W.kt", KOTLIN): [("Widget.add", 3, 5, ["x", "y"], "Adds them.", False, 1), ("Widget.helper", 6, 6, ["s"], "", True, 1), ("Widget.guarded", 7, 7, [], "", True, 1), ("Doer.go", 9, 9, ["n"], "", False, 1), ("String.shout", 10, 10, [], "", False, 1), ("freeStanding", 11, 12, ["x"], "", False, 1)],
    ("swift", "w.swift", SWIFT): [("Widget.add", 4, 6, ["x", "y"], "Adds them.", False, 1), ("Widget.moduleOnly", 7, 7, [], "", True, 1), ("Widget.fileOnly", 8, 8, ["n"], "", True, 1), ("Widget.init", 9, 9, ["n"], "", False, 1), ("Doer.go", 12, 12, ["n"], "", False, 1)],
    ("scala", "A.scala", SCALA): [("A.twice", 3, 5, ["n"], "Doubles it.", False, 1), ("A.helper", 6, 6, ["s"], "", True, 1), ("A.size", 7, 7, [], "", False, 1), ("Doer.go", 9, 9, ["n"], "", False, 1)],
    ("php", "w.php", PHP): [("Widget::add", 5, 7, ["x", "y"], "Adds them.", False, 1), ("Widget::helper", 8, 8, [], "", True, 1), ("Doer::go", 10, 10, ["s"], "", False, 1), ("freeStanding", 11, 11, ["rest"], "", False, 1)],
    ("zig", "a.zig", ZIG): [("add", 2, 2, ["a", "b"], "Adds.", False, 1), ("private", 3, 3, [], "", True, 1)],
    ("javascript", "a.js", JS): [("add", 2, 2, ["a", "b"], "Adds them.", False, 1), ("twice", 3, 5, ["n"], "", False, 1), ("once", 6, 6, ["n"], "", False, 1), ("Widget.constructor", 8, 8, ["name"], "", False, 1), ("Widget.run", 10, 10, ["x", "y"], "Runs it.", False, 4), ("Widget.build", 11, 11, [], "", False, 1), ("Widget.#hidden", 12, 12, [], "", True, 1), ("Widget.handler", 13, 13, ["e"], "", False, 1), ("last", 15, 15, ["z"], "", False, 1)],
    ("typescript", "a.ts", TS): [("Store.get", 3, 3, ["id", "fallback"], "", False, 1), ("Store.reset", 4, 4, [], "", True, 1), ("Api.load", 6, 6, ["id"], "", False, 1), ("of", 7, 7, ["x"], "", False, 1)],
    ("ruby", "w.rb", RUBY): [("Acme::Widget#add", 5, 12, ["x", "y"], "Adds them.", False, 3), ("Acme::Widget.build", 13, 13, [], "", False, 1), ("Acme::Widget#helper", 15, 17, ["rest"], "", True, 2)],
    ("elixir", "w.ex", ELIXIR): [("Acme.Widget.add", 3, 5, ["x", "y"], "Adds two numbers.", False, 1), ("Acme.Widget.helper", 6, 6, ["x"], "", True, 1), ("Acme.Widget.guarded", 7, 13, ["x"], "", False, 3), ("Acme.Widget.Inner.nested", 15, 15, [], "", False, 1)],
}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[1])
def test_functions_of_a_language(case):
    language, path, text = case
    got = [(f[0], f[1], f[2], list(f[3]), f[4], f[6], f[5]) for f in sorted(lexers._of(text, language, path), key=lambda f: (f[1], f[0]))]
    assert got == sorted(CASES[case], key=lambda f: (f[1], f[0]))


def test_functions_in_spark(spark):
    """All languages in one table; odd files give no rows and no errors."""
    rows = [(f"{k}", lang, path, text) for k, (lang, path, text) in enumerate(CASES)] + [("odd", lang, None, t) for lang in ("c", "java", "go", "ruby", "rust", "elixir", "none", None) for t in ("{{{", "}}}", "", None, "\x00((", '"', "/*", "end end")]
    got = lexers.functions(spark.createDataFrame(rows, "node_id string, language string, path string, content string"))
    assert got.where("node_id != 'odd'").count() == sum(map(len, CASES.values())) and got.where("node_id = 'odd'").isEmpty()
