"""A log table: day-partitioned Parquet parts named by immutable snapshots, and an unflushed tip.

Layout under the table's root:

* ``parts/day=YYYYMMDD/part_id=N/``: Parquet files, clustered by stream and time;
* ``catalog/part_id=N/``: a part's blocks (day, stream, tags, time range, rows) as Parquet, written and searched by Spark;
* ``index/part_id=N/``: the trigram index of a part's files;
* ``snapshots/NNNNNNNN.json``: which parts are visible, with their tier, time range and numbers of rows and blocks,
  the tombstones, and what has been taken in: a few numbers for each day and part. The highest number counts. A part that no
  snapshot names is invisible, and removed when the table is opened;
* ``wal/NNNNNNNN.json``: appended batches that aren't in a part yet, if the table keeps them.

A query works on one snapshot and one tip. Files of parts that a merge replaced stay until
``vacuum``, so a reader of an older snapshot never misses them. One process writes to a table at a time.
"""

from __future__ import annotations

import json
import threading
import time
import zlib
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.streams import stream_eq
from stratalog.functions.times import day_bounds, day_column, day_of, day_overlaps, timestamp_column
from stratalog.model import DeleteSpec, Options, QuerySpec, QueryStats, row_schema, tag_column
from stratalog.operators import catalog, skipindex, tombstones
from stratalog.operators.predicates import filter_rows, limited
from stratalog.sources.files import Files
from stratalog.sources.ingest import decode_entries, normalise

_EMPTY = {"version": 0, "next_part": 1, "next_delete": 1, "parts": {}, "deletes": [], "batches": {}, "wal": 0}


@dataclass
class Search:
    """Rows of a query; those that tombstones hide from it (none if no tombstone may count); counters."""

    rows: DataFrame
    hidden: DataFrame | None
    stats: QueryStats

    def count_hidden(self) -> None:
        """Fill rows_suppressed_delete, which takes a scan where there are tombstones."""
        self.stats.rows_suppressed_delete = self.hidden.count() if self.hidden is not None else 0


class LogTable:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.options = (options or Options()).resolved()
        self.fields = self.options.stream_fields
        self._files = Files(spark, self.root)
        self._lock = threading.RLock()
        self._stop = threading.Event()
        self._workers: list[threading.Thread] = []
        self._tip: list[dict] = []
        self._blocks: Counter = Counter()
        self._retired: list[str] = []
        self._wal_seq = self._used_part = 0
        self._snapshot = dict(_EMPTY)

    # -- opening and closing -------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None, workers: bool = False) -> LogTable:
        """Load the newest snapshot, remove what it doesn't name, and take in the batches not flushed."""
        table = cls(spark, root, options)
        files = table._files
        shown = [n for n in files.names("snapshots") if n.endswith(".json")]
        if shown:
            table._snapshot = json.loads(files.read(f"snapshots/{shown[-1]}"))
        for n in files.names("snapshots"):
            if n.endswith(".new"):
                files.remove(f"snapshots/{n}")
        visible = {(p["day"], p["id"]) for p in table._parts()}
        for day in (n for n in files.names("parts") if n.startswith("day=")):
            for part in (n for n in files.names(f"parts/{day}") if n.startswith("part_id=")):
                if (day.removeprefix("day="), int(part.removeprefix("part_id="))) not in visible:
                    files.remove(f"parts/{day}/{part}")
        table._clean_indexes()
        table._replay()
        if workers:
            table._start_workers()
        return table

    def close(self) -> None:
        """Stop the workers and flush."""
        self._stop.set()
        for w in self._workers:
            w.join()
        self.flush()

    def _start_workers(self) -> None:
        o, zero = self.options, timedelta(0)

        def every(interval: timedelta, job) -> None:
            def run() -> None:
                while not self._stop.wait(interval.total_seconds()):
                    job()

            self._workers.append(threading.Thread(target=run, daemon=True))
            self._workers[-1].start()

        if o.flush_interval > zero:
            every(o.flush_interval, self.flush)
        if o.merge_interval > zero and not o.merge_disable:
            every(o.merge_interval, self.merge_pass)
        if o.retention > zero and o.retention_interval > zero:
            every(o.retention_interval, self.apply_retention)

    def _clean_indexes(self) -> int:
        """Remove the catalogs and trigram indexes of parts that aren't visible."""
        visible, n = {p["id"] for p in self._parts()}, 0
        for kind in ("catalog", "index"):
            for name in self._files.names(kind):
                if name.startswith("part_id=") and int(name.removeprefix("part_id=")) not in visible:
                    self._files.remove(f"{kind}/{name}")
                    n += 1
        return n

    def _publish(self, **changes) -> None:
        new = self._snapshot | changes | {"version": self._snapshot["version"] + 1}
        self._files.publish(f"snapshots/{new['version']:08d}.json", json.dumps(new))
        old = new["version"] - 2
        self._snapshot = new
        if old > 0:
            self._files.remove(f"snapshots/{old:08d}.json")

    def _parts(self) -> list[dict]:
        return [p for ps in self._snapshot["parts"].values() for p in ps]

    # -- writing -------------------------------------------------------------------------------------------

    def append(self, entries: Iterable[tuple[int | None, Mapping[str, str]]]) -> int:
        """Take in (time or None, fields) records, visible at once. A stream with a full block flushes its day."""
        now = time.time_ns()
        rows = [normalise(t, f, self.fields, now) for t, f in entries]
        with self._lock:
            if self.options.enable_wal and rows:
                self._log(rows)
            self._tip += rows
            new = Counter((day_of(r["_time_ns"]), r["_stream"]) for r in rows)
            self._blocks.update(new)
            for day in sorted({day for day, stream in new if self._blocks[day, stream] >= self.options.max_rows_per_block}):
                self.flush(day)
        return len(rows)

    def _log(self, rows: list[dict], version: int = 0) -> None:
        """A record of the log. One with a version counts only once that snapshot is there."""
        self._wal_seq += 1
        text = json.dumps(rows)
        self._files.publish(f"wal/{self._wal_seq:08d}.json", json.dumps({"crc32": zlib.crc32(text.encode()), "version": version, "rows": text}))

    def _hold(self, rows: list[dict]) -> None:
        self._tip = rows
        self._blocks = Counter((day_of(r["_time_ns"]), r["_stream"]) for r in rows)

    def insert(self, body: str, flush: bool = False) -> int:
        """Records of a request body, all or none."""
        n = self.append(decode_entries(body))
        if flush:
            self.flush()
        return n

    def _replay(self) -> None:
        """Take in the batches that aren't in a part. A last record that is cut short was never acknowledged, and is left out."""
        names = [n for n in self._files.names("wal") if n.endswith(".json")]
        rows: list[dict] = []
        for name in names:
            seq = int(name.removesuffix(".json"))
            self._wal_seq = max(self._wal_seq, seq)
            if seq <= self._snapshot["wal"]:
                continue
            try:
                record = json.loads(self._files.read(f"wal/{name}"))
            except ValueError:
                if name != names[-1]:
                    raise ValueError(f"wal/{name} is damaged") from None
                self._files.remove(f"wal/{name}")
                continue
            if zlib.crc32(record["rows"].encode()) != record["crc32"]:
                raise ValueError(f"wal/{name} is damaged")
            if record.get("version", 0) <= self._snapshot["version"]:
                rows += json.loads(record["rows"])
            else:
                self._files.remove(f"wal/{name}")
        self._wal_seq = max(self._wal_seq, self._snapshot["wal"])
        self._hold(self._tip + rows)

    def flush(self, day: str | None = None) -> list[int]:
        """Write the tip, or what it has of one day, as one part for each day. If that fails, the tip stays."""
        with self._lock:
            own = [r for r in self._tip if day is None or day_of(r["_time_ns"]) == day]
            if not own:
                return []
            rest = [r for r in self._tip if day is not None and day_of(r["_time_ns"]) != day]
            mark, old = self._wal_seq, self._files.names("wal") if self.options.enable_wal else []
            if rest and old:
                self._log(rest, self._snapshot["version"] + 1)
            ids = self.append_frame(self._tip_frame(own).drop("day"), wal=mark)
            self._hold(rest)
            for name in old:
                self._files.remove(f"wal/{name}")
            return ids

    def append_frame(self, rows: DataFrame, tier: str = "small", batch: tuple[str, int] | None = None, **changes) -> list[int]:
        """Write normalised rows (any number) as one part for each day, and make them visible at once.

        batch (source, number) makes this idempotent: a batch that was taken in isn't again.
        """
        with self._lock:
            if batch and self._snapshot["batches"].get(batch[0], -1) >= batch[1]:
                return []
            first = self._new_part()
            stamped = rows.withColumn("day", day_column(F.col("_time_ns"))).withColumn("part_id", F.lit(first).cast("long"))
            made = self._write(stamped, first)
            parts = {d: list(ps) for d, ps in self._snapshot["parts"].items()}
            for p in made:
                parts.setdefault(p["day"], []).append(p | {"tier": tier})
            if batch:
                changes["batches"] = self._snapshot["batches"] | {batch[0]: batch[1]}
            self._publish(parts=parts, next_part=first + 1, **changes)
            return [p["id"] for p in made]

    def _new_part(self) -> int:
        """An id that no write had before, failed ones included: their files stay invisible, and never mix with others."""
        self._used_part = max(self._used_part, self._snapshot["next_part"] - 1) + 1
        return self._used_part

    def _write(self, stamped: DataFrame, part_id: int) -> list[dict]:
        """Files of a part, its trigram index, and its statistics by day, read back from what was written."""
        names = [f.name for f in row_schema(self.fields, True)]
        # Rebalancing by day and stream keeps a stream's rows together but splits one that is too large.
        clustered = stamped.select(*names).hint("rebalance", "day", "_stream").sortWithinPartitions("day", "_stream", "_time_ns")
        clustered.write.partitionBy("day", "part_id").mode("append").parquet(f"{self.root}/parts")
        written = self._scan([f"{self.root}/parts/*/part_id={part_id}"])
        refs = catalog.block_refs(written, [tag_column(f) for f in self.fields])
        refs.drop("part_id").write.mode("overwrite").parquet(f"{self.root}/catalog/part_id={part_id}")
        by_day = self._catalog([part_id]).groupBy("day").agg(F.sum("rows").alias("rows"), F.min("time_min_ns").alias("time_min_ns"), F.max("time_max_ns").alias("time_max_ns"), F.count(F.lit(1)).alias("blocks"))
        made = [{"id": part_id, **r.asDict()} for r in by_day.orderBy("day").collect()]
        if self.options.skip_index and made:
            index = skipindex.build(self._scan([f"{self.root}/parts/day={p['day']}/part_id={part_id}" for p in made]))
            index.write.mode("overwrite").parquet(f"{self.root}/index/part_id={part_id}")
        return made

    def _catalog(self, ids: Iterable[int]) -> DataFrame:
        """Blocks of parts: day, part_id, _stream, tags, time range, rows."""
        schema = ", ".join(["day string", "_stream string", *[f"`{tag_column(f)}` string" for f in self.fields], "time_min_ns long", "time_max_ns long", "rows long", "part_id long"])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/catalog").parquet(*[f"{self.root}/catalog/part_id={i}" for i in sorted(set(ids))])

    # -- reading -------------------------------------------------------------------------------------------

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(row_schema(self.fields, True)).option("basePath", f"{self.root}/parts").parquet(*paths)

    def _tip_frame(self, rows: list[dict] | None = None) -> DataFrame:
        schema = row_schema(self.fields)
        plain = [tuple(r.get(f.name) for f in schema) for r in (self._tip if rows is None else rows)]
        made = self.spark.createDataFrame(plain, schema)
        return made.withColumn("_time", timestamp_column(F.col("_time_ns"))).withColumn("day", day_column(F.col("_time_ns")))

    def _matches(self, row: Mapping, tags: Mapping[str, str]) -> bool:
        return all(k in self.fields and row.get(tag_column(k)) == v for k, v in tags.items())

    def _blocks_inside(self, parts: list[dict], spec: QuerySpec) -> dict[tuple[str, int], tuple[int, int, int]]:
        """By day and part: blocks with the query's tags, and of those the blocks and rows that overlap its time range.

        What is whole inside is known from the snapshot; Spark searches the catalogs of the others.
        """
        whole = lambda p: not spec.tags and (spec.start_ns is None or p["time_min_ns"] >= spec.start_ns) and (spec.end_ns is None or p["time_max_ns"] <= spec.end_ns)
        out = {(p["day"], p["id"]): (p["blocks"], p["blocks"], p["rows"]) for p in parts if whole(p)}
        open_ = [p for p in parts if not whole(p)]
        if not open_:
            return out
        blocks = self._catalog(p["id"] for p in open_).where(F.col("day").isin(sorted({p["day"] for p in open_})))
        if spec.tags:
            blocks = blocks.where(stream_eq(spec.tags, self.fields))
        inside = F.lit(True)
        if spec.start_ns is not None:
            inside = inside & (F.col("time_max_ns") >= spec.start_ns)
        if spec.end_ns is not None:
            inside = inside & (F.col("time_min_ns") <= spec.end_ns)
        found = blocks.groupBy("day", "part_id").agg(F.count(F.lit(1)), F.count_if(inside), F.sum(F.when(inside, F.col("rows")).otherwise(0)))
        wanted = {(p["day"], p["id"]) for p in open_}
        out |= {key: (0, 0, 0) for key in wanted}
        out |= {(r[0], r[1]): tuple(r)[2:] for r in found.collect() if (r[0], r[1]) in wanted}
        return out

    def plan(self, spec: QuerySpec, stats: QueryStats, snapshot: dict) -> tuple[list[str], list[dict]]:
        """The paths to read and the tombstones that may count: days, parts by tag, blocks by time, files by trigram."""
        paths, seen = [], []
        parts = [p for day in sorted(snapshot["parts"]) if day_overlaps(day, spec.start_ns, spec.end_ns) for p in snapshot["parts"][day]]
        known = self._blocks_inside(parts, spec)
        for p in parts:
            tagged, inside, rows = known[p["day"], p["id"]]
            if not tagged:
                stats.parts_pruned_indexdb += 1
                continue
            stats.parts_scanned += 1
            stats.blocks_seen += inside
            if inside:
                seen.append((f"day={p['day']}/part_id={p['id']}", p, inside, rows))
        chosen = self._files_with(seen, spec.contains)
        for path, _, inside, rows in seen:
            files = chosen.get(path, [path])
            if not files:
                stats.blocks_skipped_bloom += inside
                continue
            stats.blocks_scanned += inside
            stats.rows_scanned += rows
            paths += [f"{self.root}/parts/{f}" for f in files]
        found = [t for t in snapshot["deletes"] if day_overlaps(t["day"], spec.start_ns, spec.end_ns)]
        return paths, found

    def _files_with(self, seen: list[tuple], needle: str) -> dict[str, list[str]]:
        """For each part's path below ``parts`` that has an index, its files that may hold the needle."""
        needed = skipindex.needle_places(self.spark, needle) if needle and self.options.skip_index else []
        indexed = {path: f"{self.root}/index/part_id={p['id']}" for path, p, *_ in seen if self._files.exists(f"index/part_id={p['id']}")}
        if not needed or not indexed:
            return {}
        index = self.spark.read.schema("file string, place int").parquet(*sorted(set(indexed.values())))
        out: dict[str, list[str]] = {path: [] for path in indexed}
        for r in skipindex.files_with(index, needed).collect():
            folder = r["file"].rpartition("/")[0]
            if folder in out:
                out[folder].append(r["file"])
        return out

    def search(self, spec: QuerySpec) -> DataFrame:
        """Rows of the tip and of the parts that the query asks for and no tombstone hides. Bag semantics, no order."""
        return self.start(spec).rows

    def start(self, spec: QuerySpec) -> Search:
        """A search that is planned once: its rows, and the counters known before any row is read."""
        stats = QueryStats()
        with self._lock:
            snapshot, tip = self._snapshot, list(self._tip)
        paths, found = self.plan(spec, stats, snapshot)
        inside = [r for r in tip if day_overlaps(day_of(r["_time_ns"]), spec.start_ns, spec.end_ns) and self._matches(r, spec.tags)]
        stats.mem_blocks_scanned = len({(day_of(r["_time_ns"]), r["_stream"]) for r in inside})
        stats.rows_scanned += len(inside)
        parts = []
        if tip:
            parts.append(filter_rows(self._tip_frame(tip), spec, self.fields, True))
        if paths:
            parts.append(filter_rows(self._scan(paths), spec, self.fields, True).drop("part_id"))
        rows = self._tip_frame([]) if not parts else parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        shown = limited(tombstones.apply(rows, found, self.fields).drop("day"), spec.limit)
        return Search(shown, tombstones.apply(rows, found, self.fields, True) if found else None, stats)

    def search_with_stats(self, spec: QuerySpec) -> tuple[DataFrame, QueryStats]:
        """The rows, and the work done. Counters of a limited query are those of the unlimited one, but for rows_returned."""
        found = self.start(spec)
        found.stats.rows_returned = found.rows.count()
        found.count_hidden()
        return found.rows, found.stats

    # -- deletes and maintenance ------------------------------------------------------------------------------

    def delete(self, spec: DeleteSpec) -> int:
        """Hide the rows that match, now and later, on the days known now. Returns how many of the tip's rows went."""
        spec.check()
        with self._lock:
            query = QuerySpec(spec.start_ns, spec.end_ns, spec.stream_eq, spec.contains)
            tags = query.tags

            def hit(r: dict) -> bool:
                return (spec.start_ns is None or r["_time_ns"] >= spec.start_ns) and (spec.end_ns is None or r["_time_ns"] <= spec.end_ns) and all(k in self.fields and r.get(f"tag_{k}") == v for k, v in tags.items()) and spec.contains in r["_msg"]

            kept = [r for r in self._tip if not hit(r)]
            purged = len(self._tip) - len(kept)
            known = set(self._snapshot["parts"]) | {t["day"] for t in self._snapshot["deletes"]}
            days = tombstones.resolve_days(spec, known)
            first = self._snapshot["next_delete"]
            new = tombstones.records(spec, days, first, time.time_ns())
            if new:
                self._publish(deletes=self._snapshot["deletes"] + new, next_delete=first + len(new))
            self._hold(kept)
            if self.options.enable_wal and purged:
                self._rewrite_wal()
            return purged

    def _rewrite_wal(self) -> None:
        """The log holds the tip as it is now, so that a replay brings no purged row back."""
        old = self._files.names("wal")
        self._log(self._tip)
        for name in old:
            self._files.remove(f"wal/{name}")

    def _merge_day(self, day: str, least: int) -> bool:
        small = sorted((p for p in self._snapshot["parts"].get(day, []) if p["tier"] != "big"), key=lambda p: p["id"])
        if len(small) < least:
            return False
        inputs = small[: self.options.merge_max_parts]
        new_id = self._new_part()
        rows = self._scan([f"{self.root}/parts/day={day}/part_id={p['id']}" for p in inputs])
        made = self._write(rows.drop("part_id").withColumn("part_id", F.lit(new_id).cast("long")), new_id)
        gone = {p["id"] for p in inputs}
        parts = {d: list(ps) for d, ps in self._snapshot["parts"].items()}
        parts[day] = [p for p in parts[day] if p["id"] not in gone] + [p | {"tier": "big"} for p in made]
        self._publish(parts=parts, next_part=new_id + 1)
        self._retired += [f"parts/day={day}/part_id={i}" for i in gone]
        return True

    def merge_pass(self) -> bool:
        """One merge of the first day with enough small parts, oldest parts first. Tombstones stay as they are."""
        with self._lock:
            return any(self._merge_day(d, self.options.merge_min_parts) for d in sorted(self._snapshot["parts"]))

    def force_merge(self, day: str = "") -> bool:
        """One merge of a day from two small parts on; without a day, one pass."""
        if not day:
            return self.merge_pass()
        day_bounds(day)
        with self._lock:
            return self._merge_day(day, 2)

    def apply_retention(self, now_ns: int | None = None) -> list[str]:
        """Drop the flushed days that ended before the retention period; returns them."""
        if self.options.retention <= timedelta(0):
            return []
        with self._lock:
            edge = (time.time_ns() if now_ns is None else now_ns) - self.options.retention // timedelta(microseconds=1) * 1000
            gone = [d for d in sorted(self._snapshot["parts"]) if day_bounds(d)[1] < edge]
            if gone:
                parts = {d: ps for d, ps in self._snapshot["parts"].items() if d not in gone}
                self._publish(parts=parts, deletes=[t for t in self._snapshot["deletes"] if t["day"] not in gone])
                self._hold([r for r in self._tip if day_of(r["_time_ns"]) not in gone])
                self._retired += [f"parts/day={d}" for d in gone]
            return gone

    def vacuum(self) -> int:
        """Remove files that no snapshot names any more. Call it when no query of an older snapshot runs."""
        with self._lock:
            for name in self._retired:
                self._files.remove(name)
            n, self._retired = len(self._retired), []
            self._clean_indexes()
            return n

    def parts(self) -> DataFrame:
        rows = [(p["day"], p["id"], p["tier"], p["rows"], p["time_min_ns"], p["time_max_ns"]) for p in self._parts()]
        return self.spark.createDataFrame(rows, "day string, part_id long, tier string, rows long, time_min_ns long, time_max_ns long")


