"""The pipeline's stages against plain versions, on rows with nulls, copies and columns of the operators' own names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalog.llm import langid, mixing, near_dup

from .test_operators import plain_language, shingle_set

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
OWN = ("rate", "copy", "copies", "tokens", "posterior", "features", "own", "Score", "mark", "__mark", "__text", "lang_pred", "name", "domain", "key", "n_words", "spans")


def rows():
    r = random.Random(44)
    made = {"xx": ["".join(r.choice("abcdef") for _ in range(r.randrange(2, 8))) for _ in range(300)], "yy": ["".join(r.choice("opqrsté") for _ in range(r.randrange(2, 8))) for _ in range(300)]}
    out = []
    for i in range(90):
        lang = ("xx", "yy")[i % 2]
        text = " ".join(r.choice(made[lang]) for _ in range(r.randrange(30, 80))) + (" ### $$$" * 9 if i % 5 == 0 else "")
        out.append((i, text, lang))
    out += [(100 + i, out[3 * i][1], out[3 * i][2]) for i in range(8)]
    out += [(200 + i, " ".join(["other", *out[7][1].split()[1:]]), "xx") for i in range(3)]
    out += [(300, None, "xx"), (301, "", None), (302, " 12 ٣ \n", "yy"), (303, "token = \"abcdefgh12\" " + out[1][1], "yy"), (304, "AKIA" + "Z9" * 10 + " " + out[2][1], None), (None, out[5][1] + " abc", "yy"), (None, None, None), (90, " ".join(made["xx"]) * 40, "xx"), (5, out[5][1], out[5][2])]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[F.lit(f"own {n}").alias(n) for n in OWN]).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 90, 2)] + [(None, 1, 0), (7000, 0, 1), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def as_rows(frame):
    return Counter(tuple(x) for x in frame.collect())


def plain(name, given, spark, folder):
    """What a stage leaves of some rows (doc_id, text, lang, ...), one row at a time."""
    if name == "language_id":
        import zlib

        learned = [(x["text"], x["lang"]) for x in given if x["text"] is not None and x["lang"] is not None and not (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)]
        judged = plain_language(learned, [x["text"] for x in given])
        assert all(s < 0.4999 or s > 0.5001 for _, s in judged)
        return Counter(tuple(x) for x, (lang, s) in zip(given, judged) if lang != "und" and s >= 0.5)
    if name == "near_dup":
        sets = [shingle_set(x["text"]) for x in given]
        group = list(range(len(given)))
        for i in range(len(given)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    group = [group[i] if g == group[j] else g for g in group]
        found, out = defaultdict(list), Counter()
        for x, s, g in zip(given, sets, group):
            if s and x["doc_id"] is not None:
                found[g].append(x)
            else:
                out[tuple(x)] += 1
        return out + Counter(tuple(min(own, key=lambda x: x["doc_id"])) for own in found.values())
    if name == "secret_scans":
        mask = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", re.I | re.A)
        out = Counter()
        for x in given:
            text = x["text"] and mask.sub("[secret]", x["text"])
            out[tuple((x.asDict() | {"text": text, "n_chars": len(text) if text is not None else None}).values())] += 1
        return out
    if name == "source_mixing":
        # The operator by itself, on two columns; the stage must repeat whole rows as often as it says.
        frame = spark.createDataFrame([(x["doc_id"], x["text"]) for x in given], "doc_id long, text string")
        fit = mixing.fit_rates(mixing.with_posteriors(frame, spark.read.parquet(f"{folder}/labels.parquet"), ["doc_id", "text"]), mixing.TARGETS)
        assert fit.met
        times = {(x["doc_id"], x["text"]): 1 if x["tokens"] == 0 else x["c"] for x in fit.rows.withColumn("c", mixing.copies(F.col("rate"), F.col("doc_id"))).collect()}
        out = Counter()
        for x in given:
            out[tuple(x)] += times[x["doc_id"], x["text"]]
        return +out
    return Counter((x["doc_id"], hashlib.sha256((x["text"] or "").encode()).hexdigest(), True) for x in given)


def test_each_stage_matches_its_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in pipeline.STAGES:
        given = docs.collect()
        out = stage(spark, docs, folder).cache()
        shown = out.select("doc_id", "text_sha256", "lossless") if name == "sentencepiece" else out
        assert as_rows(shown) == plain(name, given, spark, folder), name
        if name != "sentencepiece":
            assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            docs = out


def test_run_is_all_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert as_rows(pipeline.run(spark, folder).drop("pieces")) == as_rows(docs.drop("pieces"))


def test_no_rows(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, held = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"] for r in held.select("doc_id").collect()}
        out = stage(spark, held, SF)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == names
            held = out.cache()
        if name == "near_dup":
            assert held.count() == held.select("doc_id").distinct().count()
    assert out.count() == held.count() and out.where("NOT lossless").count() == 0


def test_names_stay_free():
    from stratalog.llm.session import free_name

    assert free_name(["a", "Mark", "mark_"], "mark") == "mark__" and free_name([], "x") == "x"
    assert langid.UNDETERMINED == "und" and near_dup.SIMILARITY == 0.8
