import json
import threading
import urllib.error
import urllib.request

from stratalog.model import Options
from stratalog.server import seconds_or, serve, split_list, truthy
from stratalog.sources.table import LogTable


def test_routes(spark, tmp_path):
    table = LogTable.open(spark, str(tmp_path / "t"), Options(("service", "host"), merge_min_parts=4))
    server = serve(table, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, method=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body.encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode(), r.headers
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(), e.headers

    assert call("/healthz")[:2] == (200, "ok\n") and call("/nope")[0] == 404 and call("/insert")[0] == 405
    assert json.loads(call("/insert", '{"_msg":"valve open","service":"pump","host":"n7"}')[1]) == {"inserted": 1, "flushed": False}
    assert table.parts().count() == 0
    assert json.loads(call("/insert?flush=1", '{"_msg":"pressure low","service":"pump","_time":"2025-02-03T15:00:00Z"}')[1])["flushed"]
    status, text, headers = call("/query?service=pump&contains=pressure&stats=1&user=ignored")
    lines = [json.loads(x) for x in text.splitlines()]
    assert status == 200 and lines[0]["_msg"] == "pressure low" and lines[1]["_stats"]["rows_returned"] == 1 and headers["X-Query-Rows-Returned"] == "1"
    for bad in ("/query?limit=-1", "/query?start=nope", "/query?limit=x"):
        assert call(bad)[0] == 400
    for bad in ("", "[]", '{"a":'):
        assert call("/insert", bad)[0] == 400
    call("/insert?flush=1", '{"_msg":"door code 1234","service":"gate","_time":"2025-02-03T15:00:00Z"}')
    assert json.loads(call("/internal/force_merge?day=20250203", "")[1]) == {"ok": True, "day": "20250203"}
    assert {r["tier"] for r in table.parts().where("day = '20250203'").collect()} == {"big"}
    assert call("/internal/force_merge?day=x", "")[0] == 400
    assert json.loads(call("/delete?contains=code", "")[1]) == {"ok": True, "purged_mem": 0}
    assert call("/delete", "")[0] == 400 and "code" not in call("/query")[1]
    assert json.loads(call("/flush", "")[1]) == {"flushed": True}
    # Without a limit rows are streamed, and counted behind them.
    bulk = "".join(json.dumps({"_msg": f"line {i}", "service": "bulk", "_time": "2025-02-05T10:00:00Z"}) + "\n \n" for i in range(300))
    assert json.loads(call("/insert?flush=1", bulk)[1])["inserted"] == 300
    status, text, headers = call("/query?service=bulk&limit=0&stats=1")
    lines = [json.loads(x) for x in text.splitlines()]
    assert status == 200 and headers["Transfer-Encoding"] == "chunked" and headers["X-Query-Blocks-Scanned"] == "1"
    assert sorted(x["_msg"] for x in lines[:-1]) == sorted(f"line {i}" for i in range(300)) and lines[-1]["_stats"]["rows_returned"] == 300
    assert call("/query?service=none&limit=0")[:2] == (200, "") and len(call("/query?service=bulk")[1].splitlines()) == 100
    server.shutdown()


def test_options_text():
    assert truthy(" Yes ") and not truthy("0") and split_list(" a, ,b") == ("a", "b")
    assert seconds_or("300ms", 1).total_seconds() == 0.3 and seconds_or("2m", 1).total_seconds() == 120 and seconds_or("x", 7).total_seconds() == 7
