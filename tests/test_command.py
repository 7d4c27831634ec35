"""The command line, and hits from a log store over HTTP (a small server of the test's own)."""

import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodesieve import __main__ as cli
from lodesieve.sources import hits, store


def run(spark, *args):
    lines = []
    return cli.run(spark, cli.options(list(args)), lines.append), "\n".join(lines)


def test_options():
    for bad in (["--days", "0"], ["--days", "400"], ["--mode", "x"], ["--format", "pdf"], ["--fail-on", "bad"], ["--mode", "search", "--hits", "x"], ["--mode", "logs"], ["--update-baseline"], ["--unknown"]):
        with pytest.raises(cli.Usage):
            cli.options(bad)
    assert cli.options(["--mode", "logs", "--hits", "x", "--max-hits", "nine"]).most == 50_000 and cli.options(["--mode", "SEARCH", "--hits", "x", "-q", "a", "--max-hits", "7"]).most == 7
    assert cli.main(["--path", "/no/such/folder"]) == 2


def test_log(capsys):
    cli.log(cli.options(["--log-format", "json"])).info("a %s", 1)
    assert json.loads(capsys.readouterr().err)["message"] == "a 1"
    cli.log(cli.options(["--quiet"])).warning("b")
    cli.log(cli.options(["--verbose"])).debug("c")
    assert capsys.readouterr().err == "DEBUG c\n"


def test_code(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.ts").write_text("crypto.createCipher('aes', k);\n// bcr-disable-next-line BCR-TLS-001 -- known\nf({ rejectUnauthorized: false });\n")
    (src / "b.ts").write_text("import { run } from './c';\nexport const job = (req) => run(req.body.cmd);\n")
    (src / "c.ts").write_text("export { exec as run } from 'child_process';\n")
    (src / "broken.ts").write_text("f((1);")
    (src / "out.gen.ts").write_text("crypto.createCipher('aes', k);\n")
    (src / ".gitignore").write_text("*.gen.ts\n")
    code, text = run(spark, "--path", str(src), "--output", "r.json")
    made = json.loads((tmp_path / "r.json").read_text())
    assert code == 1 and sorted(f["rule_id"] for f in made["findings"]) == ["BCR-CRYPTO-005", "BCR-VAL-002"] and [f["rule_id"] for f in made["suppressedFindings"]] == ["BCR-TLS-001"]
    assert made["filesAnalyzed"] == 4 and made["hasRuntimeErrors"] and made["runtimeIssuesByType"]["PARSE_FAILURE"] == 1 and "Fix:" in text and "Total findings: 2" in text
    run(spark, "--path", str(src), "--output", "r.sarif", "--format", "sarif", "--show-suppressed")
    sarif = json.loads((tmp_path / "r.sarif").read_text())["runs"][0]
    assert len(sarif["results"]) == 3 and sarif["properties"]["suppressedFindings"] == 1 and all("help" in r and "name" in r for r in sarif["tool"]["driver"]["rules"])
    assert run(spark, "--path", str(src), "--baseline", "b.json", "--update-baseline")[0] == 0
    assert run(spark, "--path", str(src), "--baseline", "b.json", "--output", "r.txt", "--format", "text")[0] == 0
    assert "Findings: 0" in (tmp_path / "r.txt").read_text()
    assert run(spark, "--path", str(src), "--baseline", "b.json", "--output", "r.txt", "--fail-on-runtime-errors")[0] == 1
    assert len(json.loads(run(spark, "--list-rules")[1])) == 128


def test_logs_and_search(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = [("a", "i", "api", "2024-01-02 00:00:00", "card 4111111111111111 declined"), ("b", "i", "api", "2024-01-03 00:00:00", "all well, declined"), ("c", "i", "web", "2024-01-04 00:00:00", "password=hunter22"), ("d", "i", "api", "2023-01-01 00:00:00", "cvv=123")]
    spark.createDataFrame(rows, "id string, index string, container string, ts string, message string").selectExpr("id", "index", "container", "cast(ts as timestamp) ts", "message").write.parquet(f"{tmp_path}/hits.parquet")
    window = ["--hits", "hits.parquet", "--from", "2024-01-01", "--to", "2024-02-01"]
    code, _ = run(spark, "--mode", "logs", *window, "--container", "api, other", "--output", "r.json")
    made = json.loads((tmp_path / "r.json").read_text())
    assert code == 1 and [f["rule_id"] for f in made["findings"]] == ["LOG-PCI-001"] and "4111111111111111" not in json.dumps(made) and made["filesAnalyzed"] == 2
    text = run(spark, "--mode", "search", *window, "-q", "declined", "--format", "text")[1]
    assert "Showing 2 of 2 hits" in text and "4111111111111111" not in text and text.index("i/b") < text.index("i/a")
    one = json.loads(run(spark, "--mode", "search", *window, "-q", "declined", "--max-hits", "1")[1])
    assert one["truncated"] and one["returned"] == 1 and one["matched"] == 2 and one["query"] == "de****ed"


DOCS = [{"_id": f"h{k}", "_index": "logs", "_source": {"@timestamp": f"2024-01-0{1 + k % 8}T0{k % 10}:00:00.000Z", "message": f"cvv=12{k % 10} hit {k}", "kubernetes": {"container": {"name": "api"}}}} for k in range(40)]


class Handler(BaseHTTPRequestHandler):
    failures, seen = 0, []

    def log_message(self, *_):
        pass

    def answer(self, status, body, **headers):
        data = body.encode()
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        Handler.seen.append(("GET", self.path, self.headers.get("Authorization")))
        if self.path == "/_cluster/health":
            self.answer(200, "{}")
        elif self.path.startswith("/circle"):
            self.answer(302, "", Location="/circle2" if self.path == "/circle" else "/circle")
        elif self.path.startswith("/deep"):
            self.answer(302, "", Location=f"/deep{int(self.path[5:] or 0) + 1}")
        elif self.path == "/away":
            self.answer(302, "", Location=f"http://127.0.0.1:{self.server.server_port}/there")
        else:
            self.answer(200, "ok")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Handler.seen.append(("POST", self.path, self.headers.get("Authorization")))
        if Handler.failures:
            Handler.failures -= 1
            return self.answer(503, "later")
        index = self.path.split("/")[1]
        if index in ("gone", "secret", "page", "odd"):
            return self.answer(*{"gone": (404, '{"type": "index_not_found_exception"}'), "secret": (403, ""), "page": (200, "<html>http://me:pw@host/</html>"), "odd": (400, "bad http://me:pw@host/")}[index])
        bounds = body["query"]["bool"]["filter"][0]["range"]["@timestamp"]
        after = body.get("search_after", [""])[0]
        rows = sorted((d for d in DOCS if bounds["gte"] <= d["_source"]["@timestamp"] < bounds["lt"] and d["_source"]["@timestamp"] >= after), key=lambda d: (d["_source"]["@timestamp"], d["_id"]))
        page = [d | {"sort": [d["_source"]["@timestamp"]]} for d in rows[: body["size"]]]
        self.answer(200, json.dumps({"hits": {"total": {"value": len(rows), "relation": "eq"}, "hits": page}}))


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://localhost:{s.server_port}"
    s.shutdown()


def test_requests(server):
    s = store.Store(server, "logs", "Basic x", waits=[0.0])
    assert s.alive() == (True, 200) and Handler.seen[-1] == ("GET", "/_cluster/health", "Basic x")
    Handler.failures = 2
    assert len(s.search(store.search_body("2024-01-01", "2025-01-01"))["hits"]["hits"]) == 40
    assert 0.5 <= s.waits[1] <= 0.65 and 1.0 <= s.waits[2] <= 1.3
    Handler.failures = 9
    with pytest.raises(store.StoreError, match="HTTP 503"):
        s.search({})
    Handler.failures = 0
    for index, said in (("gone", "isn't there"), ("secret", "not allowed"), ("page", "without JSON"), ("odd", "HTTP 400")):
        with pytest.raises(store.StoreError, match=said) as caught:
            store.Store(server, index, "x").search(store.search_body("a", "b"))
        assert "pw" not in str(caught.value)
    with pytest.raises(store.StoreError, match="circle"):
        s.request("GET", server + "/circle")
    with pytest.raises(store.StoreError, match="more than 5"):
        s.request("GET", server + "/deep")
    s.request("GET", server + "/away")
    assert Handler.seen[-1][1:] == ("/there", None)
    with pytest.raises(store.StoreError, match="refused"):
        store.Store("http://localhost:9", "logs", "x", waits=[0.0]).search({})
    through = store.Store("http://store.invalid", "logs", "x", proxy=server)
    assert through.request("GET", "http://store.invalid/a")[1] == "ok" and Handler.seen[-1][1] == "http://store.invalid/a"
    assert store.may_know("http://a/x", "https://a/y") and not store.may_know("https://a", "http://a") and not store.may_know("http://a", "http://b")
    assert store.matched({"hits": {"total": 5}}) == (5, "eq") and store.matched({"hits": {"total": {"value": 9, "relation": "gte"}}}) == (9, "gte") and store.matched({}) is None
    assert [store.authorization(e).split()[0] for e in ({"LOG_STORE_TOKEN": "t"}, {"LOG_STORE_KEY_ID": "i", "LOG_STORE_KEY": "k"}, {"LOG_STORE_USER": "u", "LOG_STORE_PASSWORD": "p"})] == ["Bearer", "ApiKey", "Basic"]


def test_hits_of_a_store(spark, server, monkeypatch):
    monkeypatch.setenv("LOG_STORE_TOKEN", "t")
    rows = store.read_store(spark, url=server, index="logs", from_="2024-01-01T00:00:00Z", to="2024-01-09T00:00:00Z", slices=3, page=7, containers="api")
    got = hits.window_scan(rows, "2024-01-01", "2024-01-09", ["api"]).collect()
    assert {r["id"] for r in got} == {d["_id"] for d in DOCS} and len(got) == 40
    assert all(r["message"].startswith("cvv=12") and "\n{" in r["message"] and r["message_field_length"] == len(r["message"].split("\n")[0]) for r in got)
    assert store.slices("2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z", 2)[0].stop == datetime(2024, 1, 2, tzinfo=UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
