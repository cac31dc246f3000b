"""A small HTTP front for a log table."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from stratalog.functions.times import parse_time
from stratalog.model import HTTP_LIMIT, DeleteSpec, Options, QuerySpec
from stratalog.operators.output import to_ndjson
from stratalog.sources.table import LogTable

NDJSON = "application/x-ndjson"
HELP = "POST /insert /flush /delete /internal/force_merge, GET /query /healthz\n"


def truthy(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def split_list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def env_or(name: str, default: str) -> str:
    return os.environ.get(name, "").strip() or default


def env_int_or(name: str, default: int) -> int:
    try:
        return int(env_or(name, ""))
    except ValueError:
        return default


def seconds_or(text: str, default: float) -> timedelta:
    """A duration like 5s, 2m, 1h or 300ms; what isn't one takes the default."""
    units = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}
    for unit in units:
        number = text.strip().removesuffix(unit)
        if text.strip().endswith(unit) and number.lstrip("+-").replace(".", "", 1).isdigit():
            return timedelta(seconds=float(number) * units[unit])
    return timedelta(seconds=default)


def handler(table: LogTable) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        started = False

        def log_message(self, *_) -> None:
            pass

        def _send(self, status: int, body: str, kind: str = "application/json", headers: dict[str, str] | None = None) -> None:
            raw = body.encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), **(headers or {})}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def _route(self) -> None:
            self.started = False
            # A kept connection goes on behind the body, whether the route needs it or not.
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            url = urlsplit(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            post = self.command == "POST"
            tags = {f: args[f] for f in table.fields if args.get(f)}
            try:
                if url.path == "/healthz":
                    self._send(200, "ok\n", "text/plain")
                elif url.path == "/":
                    self._send(200, HELP, "text/plain")
                elif url.path == "/query" and self.command in ("GET", "POST"):
                    self._query(args, tags)
                elif url.path in ("/insert", "/flush", "/delete", "/internal/force_merge", "/query"):
                    if not post:
                        self._send(405, json.dumps({"error": "method not allowed"}))
                    elif url.path == "/insert":
                        flush = truthy(args.get("flush", ""))
                        n = table.insert(body.decode(), flush)
                        self._send(200, json.dumps({"inserted": n, "flushed": flush}))
                    elif url.path == "/flush":
                        table.flush()
                        self._send(200, json.dumps({"flushed": True}))
                    elif url.path == "/delete":
                        spec = DeleteSpec(parse_time(args.get("start", "")), parse_time(args.get("end", "")), tags, args.get("contains", ""))
                        self._send(200, json.dumps({"ok": True, "purged_mem": table.delete(spec)}))
                    else:
                        day = args.get("day", "")
                        table.force_merge(day)
                        self._send(200, json.dumps({"ok": True, "day": day}))
                else:
                    self._send(404, json.dumps({"error": "not found"}))
            except ValueError as e:
                self._send(400, json.dumps({"error": str(e)}))
            except Exception as e:  # a request must not end the server
                if self.started:
                    # Rows are out already: the answer stays without its end, which tells the client.
                    self.close_connection = True
                    return
                self._send(500, json.dumps({"error": str(e)[:300]}))

        def _query(self, args: dict[str, str], tags: dict[str, str]) -> None:
            limit = int(args["limit"]) if args.get("limit") else HTTP_LIMIT
            if limit < 0:
                raise ValueError("limit is negative")
            spec = QuerySpec(parse_time(args.get("start", "")), parse_time(args.get("end", "")), tags, args.get("contains", ""), limit)
            found, with_stats = table.start(spec), truthy(args.get("stats", ""))
            lines = to_ndjson(found.rows, table.fields)
            name = lambda k: "X-Query-" + "-".join(w.capitalize() for w in k.split("_"))
            trailer = lambda: [json.dumps({"_stats": asdict(found.stats)})] if with_stats else []
            if limit:
                # No more than the limit: one scan, then all counters go ahead of the rows.
                out = [r["value"] for r in lines.collect()]
                found.stats.rows_returned = len(out)
                found.count_hidden()
                self._send(200, "".join(f"{x}\n" for x in [*out, *trailer()]), NDJSON, {name(k): str(v) for k, v in asdict(found.stats).items()})
                return
            # Any number of rows: they are sent as they come. What only the rows tell follows them, in the line of counters.
            rows = iter(lines.toLocalIterator(prefetchPartitions=True))
            head = next(rows, None)
            known = {k: v for k, v in asdict(found.stats).items() if k not in ("rows_returned", "rows_suppressed_delete")}
            self._start({name(k): str(v) for k, v in known.items()})
            while head is not None:
                self._chunk(head["value"])
                found.stats.rows_returned += 1
                head = next(rows, None)
            if with_stats:
                found.count_hidden()
                self._chunk(trailer()[0])
            self.wfile.write(b"0\r\n\r\n")

        def _start(self, headers: dict[str, str]) -> None:
            self.send_response(200)
            for k, v in {"Content-Type": NDJSON, "Transfer-Encoding": "chunked", **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.started = True

        def _chunk(self, line: str) -> None:
            raw = f"{line}\n".encode()
            self.wfile.write(f"{len(raw):x}\r\n".encode() + raw + b"\r\n")

        do_GET = do_POST = do_PUT = do_DELETE = _route

    return Handler


def serve(table: LogTable, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(table))


def main() -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser()
    p.add_argument("--root", default=env_or("STRATALOG_ROOT", "./logs"))
    p.add_argument("--port", type=int, default=env_int_or("STRATALOG_PORT", 9428))
    p.add_argument("--stream-fields", default=env_or("STRATALOG_STREAM_FIELDS", "service,host"))
    p.add_argument("--max-rows-per-block", type=int, default=1024)
    p.add_argument("--flush-interval", default=env_or("STRATALOG_FLUSH_INTERVAL", "5s"))
    p.add_argument("--merge-interval", default=env_or("STRATALOG_MERGE_INTERVAL", "10s"))
    p.add_argument("--merge-min-parts", type=int, default=env_int_or("STRATALOG_MERGE_MIN_PARTS", 4))
    p.add_argument("--retention", default=env_or("STRATALOG_RETENTION", "0s"))
    p.add_argument("--retention-interval", default=env_or("STRATALOG_RETENTION_INTERVAL", "1h"))
    a = p.parse_args()
    off = lambda d: d if d > timedelta(0) else timedelta(seconds=-1)  # noqa: E731  here 0 means off
    options = Options(split_list(a.stream_fields), a.max_rows_per_block, off(seconds_or(a.flush_interval, 5)), merge_min_parts=a.merge_min_parts, merge_interval=off(seconds_or(a.merge_interval, 10)), retention=seconds_or(a.retention, 0), retention_interval=seconds_or(a.retention_interval, 3600))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    table = LogTable.open(spark, a.root, options, workers=True)
    try:
        serve(table, a.port).serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        table.close()


if __name__ == "__main__":
    main()
