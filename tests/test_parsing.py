"""The scanner on code that trips token patterns: imports, symbols, extents, calls, measures."""

import pytest
from lithoscope.operators.parsing import parse_text

#: language, source, imports, symbols as (kind, name, first, last, owner, decorators, bases, calls, complexity, depth, loops)
CASES = {
    "rust": ("use a::b;\nfn longest<'a>(x: &'a str, y: &'a str) -> &'a str { x }\nfn g(c: char) { c == '{' }\nstruct P(i32);\nimpl<T> A for B<T> where T: C {\n  fn m(&self) {\n    let s = r#\"a { \" b\"#;\n    match x { 1 => go(), _ => println!(\"}\") }\n    loop { while let Some(x) = y { f(x); } }\n  }\n}\n/* a /* } */ { */\nfn h() { if a { } else if b { } }\n", ["a::b"], [
        ("function", "longest", 2, 2, None, [], [], [], 1, 0, 0), ("function", "g", 3, 3, None, [], [], [], 1, 0, 0), ("class", "P", 4, 4, None, [], [], [], 1, 0, 0), ("class", "<anonymous>", 5, 11, None, [], [], [], 1, 0, 0),
        ("method", "m", 6, 10, "<anonymous>", [], [], ["go", 'println!("}")', "f"], 4, 1, 2), ("function", "h", 13, 13, None, [], [], [], 3, 2, 0)]),
    "cpp": ("#include <x>\n#define M(a) { a\nint A::run(int x) { return go(x); }\nA::A() : x_(1), y_{2} {\n  init();\n}\nA::~A() {}\nclass A : public Base<T>, private C {\npublic:\n  A() = default;\n  void save() const noexcept override {}\n  virtual void z() = 0;\n  template <class T> T get(T t) { return t; }\n};\ntemplate <typename T>\nstatic inline std::vector<T> mk(int a, T b) {\n  auto s = R\"(})\";\n  int n = 1'000'000;\n  switch (a) { case 1: go(); break; default: stop(); }\n  return {};\n}\nenum class E { X };\nint v = f(3);\n", ["x"], [
        ("function", "A::run", 3, 3, None, [], [], ["go"], 1, 0, 0), ("function", "A::A", 4, 6, None, [], [], ["init"], 1, 0, 0), ("function", "A::~A", 7, 7, None, [], [], [], 1, 0, 0), ("class", "A", 8, 14, None, [], ["Base", "T", "C"], [], 1, 0, 0),
        ("method", "A", 10, 10, "A", [], [], [], 1, 0, 0), ("method", "save", 11, 11, "A", [], [], [], 1, 0, 0), ("method", "get", 13, 13, "A", [], [], [], 1, 0, 0), ("function", "mk", 16, 21, None, [], [], ["go", "stop"], 3, 1, 0)]),
    "c": ("#include \"x.h\"\nstruct point { int x; };\nstatic struct point *mk(int a) {\n  do { a--; } while (a);\n  for (;;) { if (a) break; else if (b) go(); }\n  return 0;\n}\nint decl(int a);\n", ["x.h"], [
        ("class", "point", 2, 2, None, [], [], [], 1, 0, 0), ("function", "mk", 3, 7, None, [], [], ["go"], 4, 3, 1)]),
    "javascript": ("import x from 'y';\nconst f = x => x + 1;\nconst g = async (a, b) => { return a ? go(`${h(a)} ${`in ${b}`}`) : /[/{]/.test(b); };\nclass A extends mix(B) {\n  #p = 1;\n  constructor(a) { super(a); new Z(a); }\n  static async m(a) {\n    for (const k of a) { if (k && a[k]) { go(k); } else if (z) { y(); } }\n  }\n  h = () => this.v;\n}\nif (a) { b(); }\n", ["y"], [
        ("function", "<anonymous>", 2, 2, None, [], [], [], 2, 1, 0), ("function", "<anonymous>", 3, 3, None, [], [], ["go", "h", "/[/{]/.test"], 2, 1, 0), ("class", "A", 4, 11, None, [], ["mix", "B"], [], 1, 0, 0),
        ("method", "constructor", 6, 6, "A", [], [], ["super"], 1, 0, 0), ("method", "m", 7, 9, "A", [], [], ["go", "y"], 5, 3, 1), ("method", "<anonymous>", 10, 10, "A", [], [], [], 1, 0, 0)]),
    "typescript": ("import { A } from './a';\n@Injectable()\nexport class S<T extends object = {}> extends Base<T> implements I, J {\n  constructor(private readonly a: A, @Inject(X) b?: B) { super(); }\n  @Get('/x')\n  async m<K>(a: { x: number }, b?: string): Promise<{ y: K }> {\n    return a.x;\n  }\n  abstract n(): void;\n  cb: (a: number) => void;\n}\nexport interface I { m(): void; }\nconst f = (a: number): string => go(a);\ntype Fn = (a: number) => void;\n", ["./a"], [
        ("class", "S", 2, 11, None, ["@Injectable()"], ["Base", "T", "I", "J"], [], 1, 0, 0), ("method", "constructor", 4, 4, "S", [], [], ["Inject", "super"], 1, 0, 0), ("method", "m", 6, 8, "S", ["@Get('/x')"], [], [], 1, 0, 0),
        ("class", "I", 12, 12, None, [], [], [], 1, 0, 0), ("function", "<anonymous>", 13, 13, None, [], [], ["go"], 1, 0, 0)]),
    "tsx": ("export const V = ({ a }: P) => {\n  return <div onClick={() => go(a)}>{a}</div>;\n};\n", [], [("function", "<anonymous>", 1, 3, None, [], [], ["go"], 1, 0, 0)]),
    "java": ("import a.b.C;\nimport static d.E.f;\n@Service\npublic class A<T extends B> extends C<T> implements D, E {\n  private int x = go(1);\n  @Autowired\n  public A(int x) { this.x = x; }\n  @Override\n  public List<Map<String, T>> m(@P(\"q\") int a) throws X, Y {\n    String s = \"\"\"\n      { \" }\n      \"\"\";\n    switch (a) { case 1: go(); break; default: x.y(2); }\n    return new Foo(a);\n  }\n  abstract void z();\n  enum K { A, B }\n}\n", ["a.b.C", "d.E.f"], [
        ("class", "A", 3, 18, None, ["@Service"], ["C", "T", "D", "E"], [], 1, 0, 0), ("method", "A", 6, 7, "A", ["@Autowired"], [], [], 1, 0, 0), ("method", "m", 8, 15, "A", ["@Override"], [], ["go()", "x.y(2)", "Foo"], 3, 1, 0),
        ("method", "z", 16, 16, "A", [], [], [], 1, 0, 0), ("class", "K", 17, 17, "A", [], [], [], 1, 0, 0)]),
    "go": ("package p\nimport (\n  \"fmt\"\n  x \"a/b\"\n)\ntype U struct {\n  N string `json:\"{\"`\n}\ntype ID int\nfunc (u *U) Save(a interface{}) (int, error) {\n  for i := range a { if i == '{' { fmt.Println(i) } }\n  switch a { case 1: go1(); default: }\n  return 0, nil\n}\nfunc G[T any](x T) T { return x }\n", ["fmt"], [
        ("class", "U", 6, 8, None, [], [], [], 1, 0, 0), ("class", "ID", 9, 9, None, [], [], [], 1, 0, 0), ("function", "Save", 10, 14, None, [], [], ["fmt.Println", "go1"], 4, 2, 1), ("function", "G", 15, 15, None, [], [], [], 1, 0, 0)]),
    "php": ("html { \n<?php\nuse App\\Models\\User;\n#[Entity]\nfinal class A extends B implements C, D {\n  # note {\n  #[Route(\"/u\")]\n  public function m(int $a): ?string {\n    $s = <<<EOT\n  { it's\n  EOT;\n    foreach ($a as $b) { if ($b) { $this->go($b); } elseif ($c) { D::x(); } }\n    return $a ? f(1) : null;\n  }\n  abstract function z();\n}\nfunction &f($x) { return $x; }\n?>\n<b> { </b>\n", ["App\\Models\\User"], [
        ("class", "A", 4, 16, None, ["#[Entity]"], ["B", "C", "D"], [], 1, 0, 0), ("method", "m", 7, 14, "A", ['#[Route("/u")]'], [], ["$this->go($b)", "D::x()", "f"], 4, 2, 1), ("method", "z", 15, 15, "A", [], [], [], 1, 0, 0), ("function", "f", 17, 17, None, [], [], [], 1, 0, 0)]),
    "csharp": ("using System;\nnamespace N {\n#region x {\n[ApiController]\npublic class A<T> : B<T>, IC where T : D, new() {\n  [HttpGet(\"x\")]\n  public async Task<List<int>> M<K>(int? a) where K : Z {\n    var s = @\"c:\\\"; var t = $\"{a}\"; var c = '{';\n    foreach (var i in a) { Go(i); }\n    return a > 1 ? new Foo(a) : null;\n  }\n  public A(int x) : base(x) { }\n  int E() => Go2(1);\n  public int P { get; set; }\n}\npublic record R(int X);\n#endregion\n}\n", ["System"], [
        ("class", "A", 4, 15, None, ["[ApiController]"], ["B", "T", "IC"], [], 1, 0, 0), ("method", "M", 6, 11, "A", ['[HttpGet("x")]'], [], ["Go", "Foo"], 3, 1, 1), ("method", "A", 12, 12, "A", [], [], [], 1, 0, 0), ("method", "E", 13, 13, "A", [], [], ["Go2"], 1, 0, 0), ("class", "R", 16, 16, None, [], [], [], 1, 0, 0)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_symbols(language):
    source, imports, want = CASES[language]
    got_imports, symbols, error = parse_text(language, source)
    assert error is None and got_imports == imports
    assert [(s["kind"], s["name"], s["start_line"], s["end_line"], s["parent_class"], s["decorators"], s["base_classes"], s["calls"], s["complexity"], s["max_nesting_depth"], s["max_loop_nesting"]) for s in symbols] == want


@pytest.mark.parametrize("language", sorted(CASES))
def test_any_cut_of_a_file_is_read(language):
    """Files that stop anywhere give what stands before, not an error."""
    source = CASES[language][0]
    for cut in range(0, len(source), 7):
        imports, symbols, error = parse_text(language, source[:cut])
        assert error is None, (cut, error)
    assert parse_text(language, "") == ([], [], None)


def test_no_window_of_tokens():
    """Headers, decorators, generics and parameters of thousands of tokens."""
    many = ", ".join(f"B{i}" for i in range(900))
    assert parse_text("typescript", f"class A implements {many} {{ m() {{ go(1); }} }}")[1][0]["base_classes"] == many.split(", ")
    symbols = parse_text("java", f"class A {{\n  @T({{{', '.join(map(str, range(900)))}}})\n  <{many}> void m({', '.join(f'int a{i}' for i in range(900))}) throws {many} {{ if (a) {{ go(1); }} }}\n}}")[1]
    assert [(s["name"], s["start_line"], s["complexity"], len(s["decorators"])) for s in symbols] == [("A", 1, 1, 0), ("m", 2, 2, 1)]
