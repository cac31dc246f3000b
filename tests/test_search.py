"""Scenarios of the log table, on a handful of rows."""

import itertools
import json
import time
from datetime import timedelta

import pytest

from stratalog.functions.times import parse_time
from stratalog.model import DeleteSpec, Options, QuerySpec
from stratalog.operators import skipindex
from stratalog.sources.table import LogTable

T = parse_time


def msgs(table, **query):
    return sorted(r["_msg"] for r in table.search(QuerySpec(**query)).collect())


def entry(time, msg, **fields):
    return T(time), {"_msg": msg, **fields}


@pytest.fixture()
def table(spark, tmp_path):
    return LogTable.open(spark, str(tmp_path / "t"), Options(("service", "host")))


TAGS = ("zone", "unit", "tier")
VALUES = {"zone": ("north", "south", None), "unit": ("pump", "valve"), "tier": ("gold", None)}


def grid():
    """A record for every combination of tag values, absent ones included, of which each second one is about a leak."""
    out = []
    for k, combination in enumerate(itertools.product(*VALUES.values())):
        fields = {t: v for t, v in zip(TAGS, combination) if v}
        out.append((fields, f"{'leak' if k % 2 else 'fine'} at reading {k}"))
    return out


@pytest.mark.parametrize("flushed", [False, True])
def test_every_combination_of_tags(spark, tmp_path, flushed):
    """Tag equality is a conjunction; a value that no record has, and a tag that a record lacks, match nothing."""
    records = grid()
    table = LogTable.open(spark, str(tmp_path / "t"), Options(TAGS))
    table.append((T("2025-02-03T04:05:06Z"), {"_msg": m, **fields}) for fields, m in records)
    if flushed:
        table.flush()
    asked = [{}, {"unit": "hose"}, {"zone": "gold"}, {"zone": "", "unit": "pump"}, {"colour": "red"}]
    asked += [{a: x, b: y} for a, b in itertools.combinations(TAGS, 2) for x in VALUES[a] for y in VALUES[b] if x and y]
    asked += [{"zone": z, "unit": u, "tier": "gold"} for z in ("north", "south") for u in VALUES["unit"]]
    for tags in asked:
        for needle in ("", "leak", "reading 1"):
            own = sorted(m for fields, m in records if all(fields.get(k) == v for k, v in tags.items() if v) and needle in m)
            assert msgs(table, stream_eq=tags, contains=needle) == own, (tags, needle)
    assert {r["_stream"] for r in table.search(QuerySpec(stream_eq={"zone": "south", "tier": "gold"})).collect()} == {"tier=gold,unit=pump,zone=south", "tier=gold,unit=valve,zone=south"}


def test_prune_by_day_tag_and_message(table):
    table.append([
        entry("2026-03-19T10:00:00Z", "hello error", service="api", host="h1"), entry("2026-03-19T11:00:00Z", "ok", service="api", host="h1"),
        entry("2026-03-19T11:00:00Z", "error from worker", service="worker", host="h2"), entry("2026-03-20T09:00:00Z", "next day error", service="api", host="h1"),
    ])
    table.flush()
    assert len(msgs(table, start_ns=T("2026-03-19T10:00:00Z"), end_ns=T("2026-03-19T11:00:00Z"))) == 3
    assert len(msgs(table, stream_eq={"service": "api", "host": "h1"})) == 3
    assert len(msgs(table, contains="error")) == 3
    assert msgs(table, contains="Error") == []
    assert len(msgs(table, limit=2)) == 2 and len(msgs(table, limit=-1)) == 4
    plan = table.search(QuerySpec(start_ns=T("2026-03-19T10:00:00Z"), stream_eq={"service": "api"}, contains="error"))._jdf.queryExecution().executedPlan().toString()
    for pushed in ("PartitionFilters: [isnotnull(day", "GreaterThanOrEqual(_time_ns", "EqualTo(tag_service,api)", "StringContains(_msg,error)"):
        assert pushed in plan


def test_tip_and_disk_together(table):
    table.append([entry("2026-03-19T09:00:00Z", "stored line", service="api")])
    table.flush()
    table.append([entry("2026-03-19T11:00:00Z", "waiting line", service="api")])
    assert msgs(table) == ["stored line", "waiting line"]
    assert table.parts().count() == 1


def test_counters(table):
    table.append([entry("2026-03-19T10:00:00Z", "api-log", service="api", host="h1")])
    table.flush()
    table.append([entry("2026-03-19T10:00:00Z", "worker-log", service="worker", host="h2")])
    table.flush()
    _, stats = table.search_with_stats(QuerySpec(stream_eq={"service": "api"}))
    assert (stats.parts_scanned, stats.parts_pruned_indexdb, stats.rows_returned) == (1, 1, 1)
    _, stats = table.search_with_stats(QuerySpec(contains="nomatchxyz"))
    assert (stats.blocks_seen, stats.blocks_skipped_bloom, stats.blocks_scanned, stats.rows_returned) == (2, 2, 0, 0)
    table.append([entry("2026-03-19T12:00:00Z", "mem", service="api")])
    _, stats = table.search_with_stats(QuerySpec(contains="-log"))
    assert (stats.mem_blocks_scanned, stats.blocks_seen, stats.rows_scanned, stats.rows_returned) == (1, 2, 3, 2)


def test_trigram_index_never_loses_a_row(spark, table):
    table.append([entry("2026-03-19T10:00:00Z", m, service="a") for m in ("alpha beta gamma", "über alles", "x")])
    table.flush()
    for needle in ("beta", "über", "x", "be", "ü", "alles", "zz", "", "a b"):
        off = sorted(r["_msg"] for r in table.search(QuerySpec()).collect() if needle in r["_msg"])
        assert msgs(table, contains=needle) == off
    assert skipindex.needle_places(spark, "ab") == [] and len(skipindex.needle_places(spark, "abcd")) == 2


def test_delete(spark, table):
    table.append([entry("2026-03-19T10:00:00Z", m, service=s, host=h) for m, s, h in (("keep me", "api", "h1"), ("drop secret", "api", "h1"), ("other stream", "worker", "h2"))])
    table.flush()
    table.append([entry("2026-03-19T11:00:00Z", "mem secret", service="api", host="h1")])
    assert table.delete(DeleteSpec(contains="secret")) == 1
    assert msgs(table) == ["keep me", "other stream"]
    _, stats = table.search_with_stats(QuerySpec())
    assert stats.rows_suppressed_delete == 1
    again = LogTable.open(spark, table.root, table.options)
    assert msgs(again) == ["keep me", "other stream"]
    # Rows that come later on a day of the delete are hidden too; those of other days aren't.
    again.append([entry("2026-03-19T12:00:00Z", "late secret", service="api"), entry("2026-03-25T12:00:00Z", "new secret", service="api")])
    again.flush()
    assert msgs(again, contains="secret") == ["new secret"]
    again.delete(DeleteSpec(stream_eq={"service": "api", "host": "h1"}))
    assert msgs(again) == ["new secret", "other stream"]
    for bad in (DeleteSpec(), DeleteSpec(stream_eq={"service": ""})):
        with pytest.raises(ValueError):
            again.delete(bad)


def test_merge_keeps_rows_and_tombstones(spark, table):
    for i in range(4):
        table.append([entry("2026-03-19T10:00:00Z", f"row-{i}", service="api")])
        table.flush()
    table.delete(DeleteSpec(contains="row-3"))
    assert table.merge_pass() and not table.merge_pass()
    assert [(r["tier"], r["rows"]) for r in table.parts().collect()] == [("big", 4)]
    before = table.search(QuerySpec())
    assert msgs(table) == ["row-0", "row-1", "row-2"]
    assert table.vacuum() == 4 and before is not None
    assert msgs(LogTable.open(spark, table.root, table.options)) == ["row-0", "row-1", "row-2"]
    with pytest.raises(ValueError):
        table.force_merge("2026-3-1")
    assert not table.force_merge("20260319")


def test_retention(spark, tmp_path):
    table = LogTable.open(spark, str(tmp_path / "t"), Options(("service",), retention=timedelta(hours=48)))
    table.append([entry("2026-03-10T10:00:00Z", "old-row", service="a"), entry("2026-03-19T10:00:00Z", "keep-row", service="a")])
    table.flush()
    assert table.apply_retention(T("2026-03-20T15:00:00Z")) == ["20260310"]
    assert msgs(table) == ["keep-row"]
    # Strictly before the edge: a day that ends at it stays.
    assert table.apply_retention(T("2026-03-19T23:59:59.999999999Z") + 48 * 3600 * 10**9) == []


def test_orphans_and_unfinished_parts(spark, table, tmp_path):
    table.append([entry("2026-03-19T10:00:00Z", "kept", service="a")])
    table.flush()
    planted = tmp_path / "t/parts/day=20260319/part_id=99"
    source = next((tmp_path / "t/parts/day=20260319").glob("part_id=1"))
    planted.mkdir()
    for f in source.glob("*.parquet"):
        (planted / f.name).write_bytes(f.read_bytes())
    assert msgs(table) == ["kept"]
    assert msgs(LogTable.open(spark, table.root, table.options)) == ["kept"] and not planted.exists()


def test_failed_flush_keeps_the_tip(table, monkeypatch):
    table.append([entry("2026-03-19T10:00:00Z", "retry-me", service="a")])
    monkeypatch.setattr(table, "_publish", lambda **_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        table.flush()
    monkeypatch.undo()
    assert msgs(table) == ["retry-me"]
    table.flush()
    assert msgs(table) == ["retry-me"] and table.parts().count() == 1


def test_wal(spark, tmp_path):
    options = Options(("service",), enable_wal=True)
    table = LogTable.open(spark, str(tmp_path / "t"), options)
    table.append([entry("2026-03-19T10:00:00Z", "day1", service="a")])
    table.flush()
    table.append([entry("2026-03-20T10:00:00Z", "day2", service="a"), entry("2026-03-20T10:00:00Z", "purged", service="a")])
    table.delete(DeleteSpec(contains="purged"))
    again = LogTable.open(spark, table.root, options)
    assert msgs(again) == ["day1", "day2"]
    again.close()
    assert msgs(LogTable.open(spark, table.root, options)) == ["day1", "day2"]


def test_a_full_block_flushes_its_day_only(spark, tmp_path):
    options = Options(("service",), max_rows_per_block=3, enable_wal=True)
    table = LogTable.open(spark, str(tmp_path / "t"), options)
    table.append([entry("2025-02-03T10:00:00Z", "early", service="a"), entry("2025-02-04T10:00:00Z", "other day", service="a")])
    table.append([entry("2025-02-03T11:00:00Z", f"more {i}", service="a") for i in range(2)])
    assert [r["day"] for r in table.parts().collect()] == ["20250203"]
    assert msgs(table) == ["early", "more 0", "more 1", "other day"]
    # After a crash here, what wasn't flushed comes back once.
    again = LogTable.open(spark, table.root, options)
    assert msgs(again) == ["early", "more 0", "more 1", "other day"] and len(again._tip) == 1


def test_a_flush_that_fails_after_the_log_was_rewritten(spark, tmp_path, monkeypatch):
    options = Options(("service",), enable_wal=True)
    table = LogTable.open(spark, str(tmp_path / "t"), options)
    table.append([entry("2025-02-03T10:00:00Z", "one", service="a"), entry("2025-02-04T10:00:00Z", "two", service="a")])
    monkeypatch.setattr(table, "_publish", lambda **_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        table.flush("20250203")
    assert msgs(table) == ["one", "two"]
    assert msgs(LogTable.open(spark, table.root, options)) == ["one", "two"]


def test_a_log_cut_short_at_its_end(spark, tmp_path):
    options = Options(("service",), enable_wal=True)
    table = LogTable.open(spark, str(tmp_path / "t"), options)
    table.append([entry("2025-02-03T10:00:00Z", "whole", service="a")])
    table.append([entry("2025-02-03T10:00:00Z", "cut", service="a")])
    last = tmp_path / "t/wal/00000002.json"
    raw = last.read_text()
    (tmp_path / "t/wal/.00000002.json.crc").unlink(missing_ok=True)
    last.write_text(raw[: len(raw) // 2])
    assert msgs(LogTable.open(spark, table.root, options)) == ["whole"]
    # A record that is whole but for a wrong sum is damage, and so is one cut short before the end.
    last.write_text(raw.replace('"crc32": ', '"crc32": 1'))
    with pytest.raises(ValueError):
        LogTable.open(spark, table.root, options)
    last.write_text(raw[:9])
    (tmp_path / "t/wal/00000003.json").write_text(raw)
    with pytest.raises(ValueError):
        LogTable.open(spark, table.root, options)


def test_workers(spark, tmp_path):
    """Flush, merge and retention by themselves, within seconds of their interval."""
    def soon(condition):
        end = time.time() + 60
        while not condition() and time.time() < end:
            time.sleep(0.2)
        return condition()

    second = timedelta(seconds=1)
    options = Options(("service",), flush_interval=second, merge_interval=second, merge_min_parts=2, retention=timedelta(days=3), retention_interval=second)
    table = LogTable.open(spark, str(tmp_path / "t"), options, workers=True)
    now = time.time_ns()
    table.append([(now, {"_msg": "ticked", "service": "a"})])
    assert soon(lambda: table.parts().where("tier = 'small'").count() == 1 or table.parts().count() >= 1)
    table.append([(now, {"_msg": "ticked again", "service": "a"}), (now - 9 * 86400 * 10**9, {"_msg": "old", "service": "a"})])
    assert soon(lambda: [r["tier"] for r in table.parts().collect()] == ["big"])
    assert soon(lambda: msgs(table) == ["ticked", "ticked again"])
    table.close()
    off = LogTable.open(spark, str(tmp_path / "u"), Options(flush_interval=-second, merge_disable=True), workers=True)
    assert not off._workers


def test_odd_roots(spark, tmp_path):
    """Blanks, signs and a folder called parts in the table's own path."""
    for name in ("with space/100% logs", "a/parts/b", "\u00fcber#x"):
        table = LogTable.open(spark, str(tmp_path / name), Options(("service",)))
        table.append([entry("2025-02-03T10:00:00Z", m, service="a") for m in ("needle here", "hay")])
        table.flush()
        table.append([entry("2025-02-04T10:00:00Z", "hay too", service="b")])
        table.flush()
        assert msgs(table, contains="needle") == ["needle here"]
        _, stats = table.search_with_stats(QuerySpec(contains="needle"))
        assert (stats.blocks_scanned, stats.blocks_skipped_bloom) == (1, 1)


def test_indexes_of_parts_that_are_gone_go_too(spark, tmp_path):
    table = LogTable.open(spark, str(tmp_path / "t"), Options(("service",), merge_min_parts=2, retention=timedelta(days=1)))
    held = lambda kind: sorted(int(p.name.removeprefix("part_id=")) for p in (tmp_path / "t" / kind).iterdir())
    for i in range(2):
        table.append([entry("2025-02-03T10:00:00Z", f"row {i}", service="a")])
        table.flush()
    table.merge_pass()
    assert held("index") == held("catalog") == [1, 2, 3]
    table.vacuum()
    assert held("index") == held("catalog") == [3] and msgs(table, contains="row 1") == ["row 1"]
    (tmp_path / "t/index/part_id=77").mkdir()
    LogTable.open(spark, table.root, table.options)
    assert held("index") == [3]
    assert table.apply_retention(T("2025-03-01T00:00:00Z")) == ["20250203"]
    table.vacuum()
    assert held("index") == held("catalog") == [] and msgs(table) == []


def test_blocks_are_counted_in_spark(spark, tmp_path):
    """A snapshot names parts, not streams; tags with commas are told apart; time cuts a part's blocks."""
    table = LogTable.open(spark, str(tmp_path / "t"), Options(("service", "host")))
    table.append([entry(f"2025-02-03T{h:02}:00:00Z", "m", service=f"s{k}", host="a,b" if k % 2 else "a") for k in range(20) for h in (5, 9)])
    table.flush()
    shown = sorted((tmp_path / "t/snapshots").glob("0*.json"))[-1].read_text()
    assert "s7" not in shown and json.loads(shown)["parts"]["20250203"][0]["blocks"] == 20
    _, stats = table.search_with_stats(QuerySpec(stream_eq={"host": "a,b"}))
    assert (stats.blocks_seen, stats.rows_scanned, stats.rows_returned) == (10, 20, 20)
    _, stats = table.search_with_stats(QuerySpec(start_ns=T("2025-02-03T08:00:00Z"), stream_eq={"host": "a", "service": "s4"}))
    assert (stats.blocks_seen, stats.rows_scanned, stats.rows_returned) == (1, 2, 1)
    _, stats = table.search_with_stats(QuerySpec(start_ns=T("2025-02-03T09:30:00Z")))
    assert (stats.parts_scanned, stats.blocks_seen, stats.rows_returned) == (1, 0, 0)


def test_many_tombstones(spark, table, monkeypatch):
    from stratalog.operators import tombstones

    monkeypatch.setattr(tombstones, "FEW", 1)
    table.append([entry("2025-02-03T10:00:00Z", f"row {i}", service="a") for i in range(30)])
    table.flush()
    for i in (3, 17):
        table.delete(DeleteSpec(contains=f"row {i}"))
    assert msgs(table) == sorted(f"row {i}" for i in range(30) if i not in (3, 17))
    _, stats = table.search_with_stats(QuerySpec())
    assert (stats.rows_suppressed_delete, stats.rows_returned) == (2, 28)


def test_block_full_flushes(spark, tmp_path):
    table = LogTable.open(spark, str(tmp_path / "t"), Options(("service",), max_rows_per_block=3))
    table.append([entry("2026-03-19T10:00:00Z", f"m{i}", service="a") for i in range(3)])
    assert table.parts().count() == 1 and msgs(table) == ["m0", "m1", "m2"]
    assert Options(flush_interval=timedelta(milliseconds=5)).resolved().flush_interval == timedelta(seconds=1)
    assert Options(max_rows_per_block=0, merge_min_parts=1).resolved().merge_min_parts == 2
