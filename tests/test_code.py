"""Source files: the parser's nodes, the detectors, gates and marks."""

import pytest
from pyspark.sql import functions as F

from lodesieve.functions import rules as R
from lodesieve.functions import vocabulary as V
from lodesieve.operators import detectors as D
from lodesieve.operators import report, symbols
from lodesieve.plans import programs as P
from lodesieve.sources import code as C

GOOD = """
const f = (t) => { jwt.verify(t, k, { algorithms: ['RS256'], kid }); return jwt.decode(t); };
jwt.sign({ id }, k, { expiresIn: '1h' });
app.get('/health', (req, res) => res.end('ok')); app.use(cors({ origin: ['https://x'] })); app.use(express.json({ limit: '1kb' }));
function g(req) { const n = Number(req.query.page); db.query('select 1', [n]); }
function h(req) { const c = schema.parse(req.body); exec(c); }
bcrypt.hash(p, 12); const s = 'rejectUnauthorized: false'; // jwt.decode(x)
if (a.length === token.length) { k(); } const v = /jwt\\.decode\\(x\\)/; const w = `app.use(cors())`;
res.cookie('session', v, { httpOnly: true, secure: true, sameSite: 'lax' }); res.redirect('/home'); const x = Math.random();
"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [("good", GOOD), ("null", None), ("empty", ""), ("broken", "f((1);"), ("marked", "jwt.decode(t); // bcr-disable-line BCR-JWT-001 -- known\njwt.decode(t);")]
    files = spark.createDataFrame(rows, "file string, content string").withColumn("size", F.length("content").cast("long"))
    return files, C.nodes(files).cache(), D.findings(files).cache()


@pytest.mark.parametrize("rule", list(P.CASES))
def test_each_rule_on_its_programs(rule):
    for text, severity, line in P.programs(rule):
        u = C.Unit(("src/config/" if rule == "BCR-KEY-002" else "src/") + "a.ts", text)
        assert [(f["severity"], f["line"]) for f in D.found(u) if f["rule_id"] == rule] == ([(severity, line)] if severity else []), text


def test_rules_are_all_but_the_retired_one(found):
    assert {r[0] for r in R.RULES if r[0].startswith("BCR-")} - set(D.rules_covered()) == {"BCR-VAL-004"}
    assert set(D.rules_covered()) == set(P.CASES)
    assert {r["file"] for r in found[2].collect()} == {"marked"}


def rules_in(text, file="src/a.ts"):
    return {f["rule_id"] for f in D.found(C.Unit(file, text))}


def test_taint_goes_by_declaration():
    assert "BCR-VAL-002" not in rules_in("function a(req) { const q = req.body.c; use(q); }\nfunction b() { const q = 'x'; exec(q); }")
    assert "BCR-VAL-002" in rules_in("function a(req) { let q; q = req.body.c; if (q) { const z = q; exec(z); } }")
    assert "BCR-VAL-002" not in rules_in("function a(req) { const q = hash(req.body.c); exec(q); }")
    assert "BCR-VAL-002" not in rules_in("function a(req) { const q = rules.parse(req.body); exec(q); }")
    assert "BCR-VAL-002" in rules_in("function a(req) { const { cmd: c, ...rest } = req.body; exec(c); }")
    assert "BCR-SSRF-001" in rules_in("class A { m(@Body() dto: Dto) { return axios.get(dto.url); } }")
    assert "BCR-SSRF-001" in rules_in("channel.consume((msg) => axios.get(msg.url));")
    assert "BCR-SSRF-001" in rules_in("const resolvers = { Query: { one: (parent, args) => axios.get(args.url) } };")
    assert "BCR-SSRF-001" not in rules_in("f({ url: 1 }, (msg) => axios.get(msg.url));")


def test_taint_goes_through_helpers():
    helpers = "function pass(x) { return x.id; }\nconst read = (r) => r.params.id;\nfunction get(req) { return req.params.id; }\n"
    assert "BCR-SSRF-001" in rules_in(helpers + "function f(q) { const u = get(q); axios.get(u); }")
    assert "BCR-SSRF-001" in rules_in(helpers + "function f(req) { const a = req.body; const b = pass(a); const c = pass(b); axios.get(c); }")
    assert "BCR-SSRF-001" not in rules_in(helpers + "function f(q) { const u = pass('x'); axios.get(u); }")


def test_sinks_by_their_imports():
    assert "BCR-VAL-002" in rules_in("import * as cp from 'child_process';\nfunction f(req) { cp.exec(req.body.c); }")
    assert "BCR-VAL-002" in rules_in("const { exec: go } = require('child_process');\nfunction f(req) { go(req.body.c); }")
    assert "BCR-PT-001" in rules_in("import { readFileSync as slurp } from 'fs';\nfunction f(req) { slurp(req.body.c); }")
    assert "BCR-VAL-002" not in rules_in("import { exec } from './mine';\nimport { go } from 'x';\nfunction f(req) { go(req.body.c); }")
    assert C.imports("import a, { b as c, type D } from 'm'; import * as e from \"n\"; import './side'; const { g, h: i } = require('o')") == {"c": ("m", "b"), "D": ("m", "D"), "a": ("m", "default"), "e": ("n", "*"), "g": ("o", "g"), "i": ("o", "h")}
    assert C.re_exports("export * from './a'; export * as b from './b'; export { c, d as e } from './f';") == [("*", "./a", "*"), ("b", "./b", "*"), ("c", "./f", "c"), ("e", "./f", "d")]


def test_symbols_across_files(spark):
    files = spark.createDataFrame([(f"p/{k}", v) for k, v in P.PROJECT.items()] + [("p/loop.ts", "import { a } from './loop2';"), ("p/loop2.ts", "export { a } from './loop3';"), ("p/loop3.ts", "export { a } from './loop2';"), ("p/odd.ts", "import { x } from './nowhere'; import dft from './dft';"), ("p/dft.ts", "export default function (req) { return req.body; }"), ("p/null.ts", None)], "file string, content string")
    got = {(r["file"], r["local"]): (r["module"], r["name"], r["taints"]) for r in symbols.resolved(files.unionByName(files)).collect()}
    assert got[("p/api/orders.ts", "readId")] == ("./ids", "getId", True) and got[("p/api/orders.ts", "fixedId")] == ("./ids", "fixedId", False)
    assert got[("p/api/jobs.ts", "run")] == ("child_process", "exec", False) and got[("p/api/jobs.ts", "safe")] == ("./other", "run", False)
    assert got[("p/odd.ts", "x")] == ("./nowhere", "x", False) and got[("p/odd.ts", "dft")] == ("./dft", "default", True) and not got[("p/loop.ts", "a")][2]
    with_symbols = {(r["file"], r["rule_id"]) for r in D.findings(files, symbols.dangerous(symbols.resolved(files))).collect()}
    assert {("p/api/orders.ts", "BCR-VAL-001"), ("p/api/jobs.ts", "BCR-VAL-002")} <= with_symbols
    assert "BCR-VAL-002" not in {r["rule_id"] for r in D.findings(files).collect()}
    assert symbols.resolved(files.where("false")).count() == 0


def test_numbers():
    assert [C.number(x) for x in ("15 * 60 * 1000", "(1 + 2) * -3", "6 / 4 - 1", "1_000", "1 / 0", "n * 2", "", None)] == [900000.0, -9.0, 0.5, 1000.0, None, None, None, None]


def test_gates_and_marks(found):
    files, _, rows = found
    got = D.reviewed(files).where("file = 'marked'").collect()
    assert sorted((r["line"], r["suppressed"], r["suppression_source"], r["reason"]) for r in got) == [(1, True, "inline", "known"), (2, False, None, None)]
    base = rows.where("file = 'marked' and line = 2").select("fingerprint", "rule_id", "file")
    assert {r["suppression_source"] for r in D.reviewed(files, baseline=base).where("file = 'marked'").collect()} == {"inline", "baseline"}
    assert D.reviewed(files, ["bcr-jwt-001"]).where("rule_id = 'BCR-JWT-001'").isEmpty()


def test_issues(found):
    files, nodes, _ = found
    met = C.issues(files.withColumn("size", F.when(F.col("file") == "good", V.LARGEST + 1).otherwise(1)), nodes)
    assert [(r["file"], r["type"]) for r in met.orderBy("file").collect()] == [("broken", "PARSE_FAILURE"), ("good", "INVALID_TARGET")]
    assert {r["type"]: r["n"] for r in report.issue_counts(met).collect()} == dict.fromkeys(R.ISSUES, 0) | {"PARSE_FAILURE": 1, "INVALID_TARGET": 1}
    assert report.has_errors(met) and not report.has_errors(met.where("severity = 'WARNING'"))
    assert all(r["fix"] == report.REMEDIES[r["type"]] for r in report.with_remedies(met).collect())


def test_nodes_of_odd_texts():
    deep = "f(" * 300 + ")" * 300
    assert len(C.Unit("x", deep).nodes["call"]) == 300
    for text in ("const", "=", "(", ")", "{}", "`${`a${b}`}`", "//", "/*", "return", "a ? b : c", "x =>", "😀 = é.f(1)", "a = '", "İ.f(req.body)", "if (", "if ()", "export", "for (const x of y) z", "f<T>(", "x = <T>(y) => y", "({a, b: c, ...d}) => 1", "function({a = 1}) {}", "@X() class Y {}", "async x => 1"):
        u = C.Unit("x", text)
        assert D.found(u) is not None if u.s.whole else C.rows_of("x", text)[0]["kind"] == "issue"
    assert [(r["line"], r["column"]) for r in C.rows_of("x", "\n\n  f(1)") if r["kind"] == "call"] == [(3, 3)]
    kinds = {k: len(v) for k, v in C.Unit("x", "axios.get<User>(u); new Map<string, number>(); a < b > (c); `${f(g(1))}`; f<A | B<C>>(x, y);").nodes.items()}
    assert kinds["new"] == 1 and kinds["call"] == 4


def test_rows_grow_with_the_text():
    """Callbacks in callbacks, each twice as deep as before, give twice the rows and twice their size."""
    size = []
    for depth in (50, 100, 200):
        text = ""
        for _ in range(depth):
            text = f"app.on('x', function (err, v) {{ {text} use(v); }});"
        rows = C.rows_of("x", text)
        size.append(sum(len(str(r)) for r in rows))
        assert len(rows) < 20 * depth
    assert size[2] < 2.2 * size[1] < 4.9 * size[0]


def test_source_files(spark, tmp_path):
    for name in ("a.ts", "b.js", "c.txt", "d.d.ts", "e.min.js", "node_modules/f.ts", "src/g.tsx", ".h/i.ts", "tests/j.ts", "src/pocs/k.ts", "gen/l.ts", "gen/keep.ts", "m.gen.ts"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("jwt.decode(t);")
    names = lambda rows: [r["file"].rsplit("/", 1)[1] for r in rows.collect()]
    files = C.source_files(spark, str(tmp_path))
    assert sorted(names(files)) == ["a.ts", "b.js", "g.tsx", "keep.ts", "l.ts", "m.gen.ts"]
    assert sorted(names(C.source_files(spark, str(tmp_path), ignored=["# note", "", "gen/*", "!gen/keep.ts", "*.gen.ts", "/b.js"]))) == ["a.ts", "g.tsx", "keep.ts"]
    assert names(C.source_files(spark, str(tmp_path / "tests"))) == ["j.ts"] and names(C.source_files(spark, str(tmp_path / "d.d.ts"))) == ["d.d.ts"]
    assert D.findings(files).count() == 6
