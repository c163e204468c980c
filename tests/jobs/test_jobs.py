"""The jobs on copies of growing inputs: only what is new is done, reruns change nothing, runs that die are made good."""

import datetime as dt
import hashlib
import json
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugemark.functions import contracts as C
from jobs import common, monthly_scores, queries, text_ledger

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PAIRS = "model string, station string, time timestamp, lead int, fcst double, obs double, flags int"
CONFIG = {"columns": {"model": "model", "station_id": "station", "variable": "'t2m'", "valid_time": "time", "lead_hours": "lead", "fcst": "fcst", "obs": "obs", "qc_flags": "flags"}, "models": ["a", "b", "c"], "mask": 1}


def pairs(seed, month, n=60):
    r = random.Random(seed)
    return [(r.choice("abcd"), r.choice("xy"), dt.datetime(2024, month, r.randint(1, 3), 12), 24, round(r.uniform(0, 9), 3), round(r.uniform(0, 9), 3), r.choice([0, 0, 0, 1, 2])) for _ in range(n)]


def brute(rows, models="abc", mask=1):
    """Daily scores by definition: every set of models, keys that each of them has."""
    good = [x for x in rows if x[2] is not None and x[0] in tuple(models) and x[6] & mask == 0 and x[4] is not None and x[5] is not None]
    sets = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    of = {}
    for m in sets:
        for x in good:
            if x[0] in m and all(any(y[0] == z and y[1:4] == x[1:4] for y in good) for z in m):
                of.setdefault(("+".join(m), x[0], x[2].date()), []).append(x[4] - x[5])
    return sorted((*k, len(e), pytest.approx(sum(e) / len(e)), pytest.approx(sum(map(abs, e)) / len(e))) for k, e in of.items())


def scored(spark, out):
    return sorted((r["comparison_id"], r["model"], r["day"], r["n_pairs"], r["bias"], r["mae"]) for r in monthly_scores.read_scores(spark, out).collect())


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def put(spark, rows, path, schema=PAIRS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_only_new_and_changed_months_are_scored(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    january, february = pairs(1, 1), pairs(2, 2)
    put(spark, january + february, src)
    first = monthly_scores.run(spark, src, out, CONFIG)
    assert first["months"] == ["2024-01", "2024-02"] and first["rows_in"] == 120 == first["rows_out"] + sum(first["dropped"].values())
    assert scored(spark, out) == brute(january + february)
    before = files(f"{out}/scores")
    assert monthly_scores.run(spark, src, out, CONFIG)["months"] == [] and files(f"{out}/scores") == before

    march, more = pairs(3, 3), [("a", "x", dt.datetime(2024, 2, 1, 12), 24, 1.0, 2.0, 0), ("b", "x", None, 24, 1.0, 2.0, 0), (None, "x", dt.datetime(2024, 3, 1), 24, None, 2.0, None)]
    put(spark, march + more, src)
    second = monthly_scores.run(spark, src, out, CONFIG)
    assert second["months"] == ["2024-02", "2024-03"] and second["rows_in"] == 122 and second["without_time"] == 1
    assert scored(spark, out) == brute(january + february + march + more)
    kept = {f for f in before if "2024-01" in f}
    assert kept and kept <= files(f"{out}/scores") and not {f for f in before if "2024-02" in f} & files(f"{out}/scores")


def test_a_new_configuration_scores_all_and_a_month_may_lose_its_last_pair(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    flagged = [(m, "x", dt.datetime(2024, 5, 1), 24, 1.0, 2.0, 2) for m in "abc"]
    rows = pairs(4, 4) + flagged
    put(spark, rows, src)
    monthly_scores.run(spark, src, out, CONFIG)
    assert len([x for x in scored(spark, out) if x[2].month == 5]) == 9
    strict = CONFIG | {"mask": 3}
    assert monthly_scores.run(spark, src, out, strict)["months"] == ["2024-04", "2024-05"]
    assert scored(spark, out) == brute(rows, mask=3) and not [x for x in scored(spark, out) if x[2].month == 5]
    assert monthly_scores.run(spark, src, out, dict(reversed(strict.items())))["months"] == []


def test_a_run_that_died_is_made_good(spark, tmp_path, monkeypatch):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = pairs(5, 1) + pairs(6, 2)
    put(spark, rows, src)
    write = monthly_scores.write_months

    def dies(df, path):
        if path.endswith("ledger"):
            raise RuntimeError("lost")
        write(df, path)

    monkeypatch.setattr(monthly_scores, "write_months", dies)
    with pytest.raises(RuntimeError, match="lost"):
        monthly_scores.run(spark, src, out, CONFIG)
    monkeypatch.setattr(monthly_scores, "write_months", write)
    assert monthly_scores.run(spark, src, out, CONFIG)["months"] == ["2024-01", "2024-02"]
    assert scored(spark, out) == brute(rows)


def test_inputs_without_rows_or_columns(spark, tmp_path):
    spark.createDataFrame([], PAIRS).write.parquet(f"{tmp_path}/in")
    assert monthly_scores.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG)["months"] == []
    assert monthly_scores.read_scores(spark, f"{tmp_path}/out").collect() == []
    with pytest.raises(ValueError, match="qc_flags"):
        monthly_scores.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG | {"columns": {k: v for k, v in CONFIG["columns"].items() if k != "qc_flags"}})


def test_one_scan_and_one_shuffle_serve_all_comparisons(spark, sf_dir):
    rows = monthly_scores.read_pairs(spark, f"{sf_dir}/lineitem.parquet", common.default_config(monthly_scores.__file__)["columns"])
    plan = monthly_scores.scores(rows.where(monthly_scores.within(["1995-01", "1995-02"])), common.default_config(monthly_scores.__file__))[0]._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and text.count("Join") == 0 and text.count("Exchange hashpartitioning") == 2  # keys, then sums
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(l_shipdate" in text


TEXTS = "doc_id long, text string, source string, extra int"


def test_the_ledger_takes_only_new_files(spark, tmp_path):
    src, out, config = f"{tmp_path}/in", f"{tmp_path}/out", common.default_config(text_ledger.__file__)
    rows = [(1, "one\ntwo", "a", 0), (2, "", "a", 0), (3, None, None, 0), (4, "one\ntwo", "b", 0), (5, "é" * 3, "", 0)]
    put(spark, rows, src, TEXTS)
    assert text_ledger.run(spark, src, out, config) == {"taken": 5, "texts": 5}
    before = files(f"{out}/entries")
    assert text_ledger.run(spark, src, out, config) == {"taken": 0, "texts": 5} and files(f"{out}/entries") == before
    more = [(6, "one\ntwo", "a", 0), (None, "é" * 3, "c", 0), (1, "x" * 100_000, "a", 0)]
    put(spark, more, src, TEXTS)
    assert text_ledger.run(spark, src, out, config) == {"taken": 3, "texts": 8}
    assert before < files(f"{out}/entries")
    got = text_ledger.read_ledger(spark, out).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((f"documents/{i}" if i is not None else f"sha256:{sha(t)}", s or s, sha(t), len((t or "").encode()), "fetched" if t else "empty") for i, t, s, _ in rows + more)
    assert sorted((r["url"], r["source"], r["sha256"], r["bytes"], r["status"]) for r in got if r["source"] is not None) == [x for x in want if x[1] is not None]
    assert len([r for r in got if r["source"] is None]) == 1 == len([r for r in got if r["source"] == ""])
    totals = {r["source"]: (r["source_texts"], r["source_empty"], r["source_repeats"]) for r in got}
    assert totals == {"a": (4, 1, 1), "b": (1, 0, 1), None: (1, 1, 0), "": (1, 0, 0), "c": (1, 0, 1)}
    C.validate(text_ledger.read_entries(spark, out).drop("part"), C.MANIFEST, "manifest")


def test_the_ledger_goes_on_after_a_run_that_died(spark, tmp_path, monkeypatch):
    src, out, config = f"{tmp_path}/in", f"{tmp_path}/out", common.default_config(text_ledger.__file__)
    put(spark, [(1, "one", "a", 0)], src, TEXTS)
    with monkeypatch.context() as m:
        m.setattr(text_ledger, "audit", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            text_ledger.run(spark, src, out, config)
    put(spark, [(2, "two", "a", 0)], src, TEXTS)
    assert text_ledger.run(spark, src, out, config | {"files_a_batch": 1}) == {"taken": 1, "texts": 2}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    columns = sorted(out.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(r) for r in out.select(columns).collect()), key=str)
    assert got and got == sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str)


def test_settings_and_folders(spark):
    a, b = common.new_folder(spark, "job"), common.new_folder(spark, "job")
    assert a != b and monthly_scores.within(["2024-02"]) is not None
    assert text_ledger.as_glob("/a/b.parquet/") == "/a/b.parque[t]" and text_ledger.as_glob("/a/*.parquet") == "/a/*.parquet"


def test_command_lines(spark, sf_dir, tmp_path):
    put(spark, pairs(7, 1), f"{tmp_path}/in")
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    for job, options in (("monthly_scores", ["--pairs", f"{tmp_path}/in", "--config", f"{tmp_path}/c.json"]), ("text_ledger", ["--texts", f"{sf_dir}/documents.parquet"])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *options, "--out", f"{tmp_path}/{job}"], cwd=ROOT, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-2000:]
        said = [json.loads(line[line.index("{") :]) for line in done.stdout.splitlines() if '"job"' in line]
        assert {"read", "wrote"} <= {k for x in said for k in x}
    assert scored(spark, f"{tmp_path}/monthly_scores") == brute(pairs(7, 1))
    assert text_ledger.read_entries(spark, f"{tmp_path}/text_ledger").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert spark.sql("select 1").first()[0] == 1 and F is not None
