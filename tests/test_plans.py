import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import moves, review, state, stats
from shelfmark.operators.categorize import CONTENT_ROUTES
from shelfmark.plans import structure, waves
from shelfmark.settings import Settings
from shelfmark.sources.store import Store
from shelfmark.streaming.waves import run_available


def plan(spark, rows, archive=()):
    mv = spark.createDataFrame(rows, "path string, category string, filename string")
    ar = spark.createDataFrame(list(archive), "category string, filename string")
    return {r["path"]: r["dest"] for r in moves.move_plan(mv, ar, "/arc").collect()}


def test_suffixes_count_up_and_skip_what_is_taken(spark):
    rows = [(f"/s{i}", "C", "document.docx") for i in range(4)]
    assert plan(spark, rows) == {
        "/s0": "/arc/C/document.docx", "/s1": "/arc/C/document_1.docx",
        "/s2": "/arc/C/document_2.docx", "/s3": "/arc/C/document_3.docx",
    }
    taken = [("C", "document.docx"), ("C", "document_2.docx"), ("D", "document_1.docx"), ("C", "document_02.docx")]
    assert plan(spark, rows[:3], taken) == {
        "/s0": "/arc/C/document_1.docx", "/s1": "/arc/C/document_3.docx", "/s2": "/arc/C/document_4.docx",
    }


def test_a_literal_name_among_the_movers_is_respected(spark):
    rows = [("/a", "C", "x.txt"), ("/b", "C", "x.txt"), ("/c", "C", "x_1.txt")]
    assert plan(spark, rows) == {"/a": "/arc/C/x.txt", "/b": "/arc/C/x_2.txt", "/c": "/arc/C/x_1.txt"}


@pytest.mark.parametrize("seed", range(3))
def test_destinations_are_unique_and_free(spark, seed):
    rng = random.Random(seed)
    names = ["x.txt", "x_1.txt", "x_1_1.txt", "x_2.txt", "y", "y_1", ".z", "x_3.txt"]
    rows = [(f"/p{i:03}", rng.choice("CD"), rng.choice(names)) for i in range(120)]
    archive = [(rng.choice("CD"), n) for n in names + ["x_7.txt", "x_9.txt", "y_4"] if rng.random() < 0.5]
    got = plan(spark, rows, archive)
    assert len(got) == len(rows) and len(set(got.values())) == len(rows)
    assert not set(got.values()) & {f"/arc/{c}/{n}" for c, n in archive}


def test_empty_folders_cascade_and_dry_run(spark):
    files = spark.createDataFrame([("/r/a/b/x", "a/b/x"), ("/r/c/y", "c/y"), ("/r/top", "top")], "path string, relative_path string")
    gone = spark.createDataFrame([("/r/a/b/x",), ("/r/top",)], "path string")
    listed = spark.createDataFrame([("e",), ("e/f",), ("a",)], "folder string")
    full = {r[0] for r in moves.empty_folders(files, gone, listed).collect()}
    dry = {r[0] for r in moves.empty_folders(files, gone, listed, cascade=False).collect()}
    assert full == {"a", "a/b", "e", "e/f"}
    assert dry == {"e/f"}


def test_written_decisions(spark):
    lines = spark.createDataFrame(
        [("Archive: DELETE ALL",), ("Desktop: DELETE 5-8, SKIP rest",), ("Drive Root #1,2,9: Customers/North/",), ("Misc: MOVE: Old",)],
        "line string",
    )
    got = {tuple(r) for r in review.parse_decisions(lines).select("bucket", "lo", "hi", "action", "dest").collect()}
    assert got == {
        ("Archive", None, None, "DELETE", None),
        ("Desktop", 5, 8, "DELETE", None), ("Desktop", None, None, "SKIP", None),
        ("Drive Root", 1, 1, "MOVE", "Customers/North"), ("Drive Root", 2, 2, "MOVE", "Customers/North"),
        ("Drive Root", 9, 9, "MOVE", "Customers/North"),
        ("Misc", None, None, "MOVE", "Old"),
    }


def test_written_decisions_are_never_moves_by_accident(spark):
    lines = spark.createDataFrame(
        [("Inbox: DELETE 5,7, skip rest",), ("Papers: delete all",), ("Misc: Clients/West, North",), ("Old #1,2: skip",), ("Old #3,4-6: Move: A, B/",),
         ("Papers - DELETE ALL",), ("Inbox: DELETE some",), ("Inbox: MOVE 5",), ("Inbox: DELETE 9-3",), ("Inbox: delete, 4 5",), ("",), (None,)],
        "line string",
    )
    got = {tuple(r) for r in review.parse_decisions(lines).collect()}
    assert got == {
        ("Inbox", 5, 5, "DELETE", None, None), ("Inbox", 7, 7, "DELETE", None, None), ("Inbox", None, None, "SKIP", None, None),
        ("Papers", None, None, "DELETE", None, None), ("Misc", None, None, "MOVE", "Clients/West, North", None),
        ("Old", 1, 1, "SKIP", None, None), ("Old", 2, 2, "SKIP", None, None),
        ("Old", 3, 3, "MOVE", "A, B", None), ("Old", 4, 6, "MOVE", "A, B", None),
        ("", None, None, None, None, "Papers - DELETE ALL"), ("Inbox", None, None, None, None, "Inbox: DELETE some"),
        ("Inbox", None, None, None, None, "Inbox: MOVE 5"), ("Inbox", None, None, None, None, "Inbox: DELETE 9-3"),
        ("Inbox", None, None, "DELETE", None, None), ("Inbox", None, None, None, None, "Inbox: delete, 4 5"),
        ("", None, None, None, None, ""),  # a null is no line
    }


def test_worksheet_pages(spark):
    rows = [(f"/d/Desktop/F{i:03}", f"F{i:03}") for i in range(205)]
    df = spark.createDataFrame(rows, "path string, filename string")
    sheet = review.worksheet(df).groupBy("page").count().orderBy("page").collect()
    assert [tuple(r) for r in sheet] == [(1, 100), (2, 100), (3, 5)]


def test_latest_row_per_path(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "X", 5, "unknown", t), (2, "a", "Y", 8, "move", t), (1, "b", "Z", 2, "unknown", t)]
    df = spark.createDataFrame(rows, "wave int, path string, category string, confidence int, action string, processed_at timestamp_ntz")
    got = {(r["path"], r["category"]) for r in state.latest_decisions(df).collect()}
    assert got == {("a", "Y"), ("b", "Z")}
    assert {tuple(r) for r in state.unknowns_by_wave(df).collect()} == {(1, "a"), (1, "b")}


def test_category_of_a_destination(spark):
    df = spark.createDataFrame([("/arc/A/B/x",), ("/arc/x",), ("/other/x",)], "dest string")
    got = [r[0] for r in df.select(stats.move_category(F.col("dest"), "/arc")).collect()]
    assert got == ["A/B", "Root", "Unknown"]


# ---- waves

INV = (
    "path string, relative_path string, filename string, extension string, parent_folder string, "
    "text string, size_bytes long, modified_time timestamp_ntz"
)


def inventory(spark, names):
    out = []
    for n in names:
        base = n.rsplit("/", 1)[-1]
        out.append((f"/r/{n}", n, base, ".txt", n.split("/")[0], f"the budget of {n}", 10, dt.datetime(2024, 1, 1)))
    return spark.createDataFrame(out, INV)


def alias_rows(spark):
    return spark.createDataFrame([(1, "acme", "Acme")], "ord int, alias string, canonical string")


NOW = lambda: F.to_timestamp_ntz(F.lit("2024-05-05 00:00:00"))


def run(spark, files, done, wave, **kw):
    return waves.run_wave(files, done, alias_rows(spark), wave, NOW(), **kw).decisions


def test_two_waves_equal_one_batch(spark):
    a = ["HR/a.txt", "x/Untitled 1.txt", "x/notes.txt"]
    b = ["x/other.txt", "Finance/f.txt", "y/acme offer.txt"]
    none = spark.createDataFrame([], "path string")
    whole = {tuple(r) for r in run(spark, inventory(spark, a + b), none, 1).select("path", "category", "action").collect()}
    first = run(spark, inventory(spark, a), none, 1)
    second = run(spark, inventory(spark, a + b), first.select("path"), 2)
    assert second.count() == len(b)
    both = {tuple(r) for r in first.unionByName(second).select("path", "category", "action").collect()}
    assert both == whole
    assert ("/r/x/notes.txt", "Internal/Finance", "move") in whole
    # a clear name is scored without its content
    assert ("/r/y/acme offer.txt", "Unknown", "unknown") in whole


def test_phrases_far_behind_in_a_text_decide(spark):
    none = spark.createDataFrame([], "path string")
    files = inventory(spark, ["x/notes.txt", "x/table.csv"])
    phrase = CONTENT_ROUTES[0][1][0]
    far = files.withColumn("text", F.concat(F.repeat(F.lit("word\n"), 4000), F.lit(phrase)))
    got = {r["category"] for r in run(spark, far, none, 1).collect()}
    assert got == {CONTENT_ROUTES[0][0]}


def test_older_versions_leave_before_scoring(spark):
    none = spark.createDataFrame([], "path string")
    got = {r["path"]: r["action"] for r in run(spark, inventory(spark, ["x/p_v1.txt", "x/p_v2.txt"]), none, 1).collect()}
    assert got == {"/r/x/p_v1.txt": "delete", "/r/x/p_v2.txt": "move"}


def test_second_call_only_for_borderline_answers(spark):
    def scorer(batch):
        return [
            '{"category":"A","confidence":%d,"reasoning":"r","action":"move"}' % (7 if "low" in n else 9)
            for n in batch["filename"]
        ]

    def critic(batch):
        assert all("confidence: 7" in q for q in batch["request"])
        return ['{"changed":true,"final_category":"B","final_confidence":8}'] * len(batch)

    none = spark.createDataFrame([], "path string")
    files = inventory(spark, ["x/low.txt", "x/high.txt"])
    got = {r["path"]: (r["category"], r["confidence"]) for r in run(spark, files, none, 1, scorer=scorer, critic=critic).collect()}
    assert got == {"/r/x/low.txt": ("B", 8), "/r/x/high.txt": ("A", 9)}


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, table, mark = (str(tmp_path / n) for n in ("src", "table", "mark"))
    files = inventory(spark, [f"HR/{i}.txt" for i in range(4)])
    files.coalesce(1).write.mode("append").parquet(src)

    def decide(batch, wave):
        return batch.select("path", F.lit("HR").alias("category"))

    go = lambda: run_available(spark, src, files.schema, decide, table, mark)
    assert go().count() == 4
    inventory(spark, ["HR/new.txt"]).coalesce(1).write.mode("append").parquet(src)
    after = go()
    assert after.count() == 5 and after.agg(F.max("wave")).first()[0] == 2
    assert go().count() == 5


# ---- waves that go on


def store_rows(store):
    """Every table of a store as multisets of rows, without times."""
    from collections import Counter

    out = {}
    for kind in store.names:
        rows = store.all(kind)
        out[kind] = Counter(str(r) for r in rows.drop(*(c for c in ("processed_at", "ts", "seconds") if c in rows.columns)).collect())
    return out


def latest(store):
    rows = state.latest_decisions(store.all("decisions")).collect()
    return {(r["path"], r["category"], r["confidence"], r["action"]) for r in rows}


ARRIVALS = [
    ["x/plan_v2.txt", "HR/a.txt", "x/notes.txt", "Customers/Acme Corp/offer.txt", "y/acme corp.txt"],
    ["x/plan_v1.txt", "x/other.txt", "z/notes.txt", "x/plan_v3.txt"],
    ["x/plan_FINAL.txt", "q/Untitled 1.txt", "q/odd.txt"],
]


def stored(spark, folder, arrivals, **kw):
    store = Store.open(spark, str(folder), 4)
    for wave, names in enumerate(arrivals, 1):
        waves.run_stored_wave(store, inventory(spark, names), wave, alias_rows(spark), NOW(), **kw)
    return store


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_arrivals_in_any_order_equal_one_batch(spark, tmp_path, order):
    """A newer variant displaces an earlier winner, an older one is no better than the winner known."""
    store = stored(spark, tmp_path / "s", [ARRIVALS[i] for i in order])
    none = spark.createDataFrame([], "path string")
    files = inventory(spark, sum(ARRIVALS, []))
    whole = {(r["path"], r["category"], r["confidence"], r["action"]) for r in run(spark, files, none, 1).collect()}
    assert latest(store) == whole
    older = {r["path"] for r in state.latest_decisions(store.all("decisions")).filter("action = 'delete'").collect()}
    assert older == {"/r/z/notes.txt", *(f"/r/x/plan_{v}.txt" for v in ("v1", "v2", "v3"))}
    store.forget()


def test_a_wave_writes_every_table(spark, tmp_path):
    def scorer(batch):
        return ['{"category":"A","confidence":6,"reasoning":"r","action":"move"}'] * len(batch)

    def critic(batch):
        return ['{"critique":"c","alternative_interpretations":["B","C"],"changed":true,"final_category":"B","final_confidence":5}'] * len(batch)

    store = stored(spark, tmp_path / "s", ARRIVALS, scorer=scorer, critic=critic)
    names = {r["name"] for r in store.all("names").collect()}
    assert "Acme Corp" in names and store.all("names").count() == len(names)
    moves = store.all("moves").collect()
    dests = [r["dest"] for r in moves]
    assert len(dests) == len(set(dests)) and all(d.startswith("/archive/") for d in dests)
    log = store.all("log").collect()
    assert {r["dest"] for r in log if r["action"] == "MOVED"} == set(dests)
    assert {r["source"] for r in log if r["action"] == "DELETED"} == {"/r/z/notes.txt", *(f"/r/x/plan_{v}.txt" for v in ("v1", "v2", "v3"))}
    sheet = {r["path"]: r for r in store.all("worksheet").collect()}
    assert sheet["/r/x/notes.txt"]["alternatives"] == ["B", "C"] and sheet["/r/x/notes.txt"]["category"] == "B"
    done = {r["path"]: r for r in store.all("decisions").collect() if r["decided_by"] == "scorer"}
    assert done["/r/x/notes.txt"]["critique"] == "c" and done["/r/x/notes.txt"]["original_category"] == "A" and done["/r/x/notes.txt"]["original_confidence"] == 6
    measures = {r["wave"]: r for r in stats.wave_metrics(store.all("waves")).collect()}
    assert {w: (r["arrived"], r["bytes"], r["decided"], r["errors"]) for w, r in measures.items()} == {1: (5, 50, 5, 0), 2: (4, 40, 5, 0), 3: (3, 30, 4, 0), None: (12, 120, 14, 0)}
    assert all(abs(r["files_per_second"] * r["seconds"] - r["arrived"]) < 1e-6 and r["seconds"] > 0 for r in measures.values())
    store.forget()


def test_failed_calls_are_counted(spark, tmp_path):
    def scorer(batch):
        raise RuntimeError("no service")

    quick = Settings(max_retries=0, retry_delay_seconds=0)
    store = stored(spark, tmp_path / "s", [["x/one.txt", "x/two.txt", "HR/a.txt"]], scorer=scorer, settings=quick)
    # files that have come before are no news
    waves.run_stored_wave(store, inventory(spark, ["x/one.txt"]), 2, alias_rows(spark), NOW(), scorer=scorer, settings=quick)
    rows = {r["wave"]: (r["arrived"], r["decided"], r["errors"]) for r in store.all("waves").collect()}
    assert rows == {1: (3, 3, 2), 2: (0, 0, 0)}
    store.forget()


@pytest.mark.parametrize("last", ["decisions", "worksheet"])
def test_a_broken_wave_is_written_anew(spark, tmp_path, last):
    whole = store_rows(stored(spark, tmp_path / "a", ARRIVALS[:2]))

    class Lost(Exception):
        pass

    def lose(kind):
        if kind == last:
            raise Lost

    store = stored(spark, tmp_path / "b", ARRIVALS[:1])
    with pytest.raises(Lost):
        waves.run_stored_wave(store, inventory(spark, ARRIVALS[1]), 2, alias_rows(spark), NOW(), written=lose)
    store.forget()  # another session opens the folder
    store = Store.open(spark, str(tmp_path / "b"), 64)
    waves.run_stored_wave(store, inventory(spark, ARRIVALS[1]), 2, alias_rows(spark), NOW())
    assert store_rows(store) == whole


def test_state_is_not_moved_and_other_waves_are_not_touched(spark, tmp_path):
    import os

    store = stored(spark, tmp_path / "s", ARRIVALS[:2])
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "s" / "decisions" / "wave=1").iterdir())}
    waves.run_stored_wave(store, inventory(spark, ARRIVALS[2]), 3, alias_rows(spark), NOW())
    assert before == {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "s" / "decisions" / "wave=1").iterdir())}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        fresh = inventory(spark, ["n/new.txt"]).select("path")
        plan = fresh.join(store.before("decisions", 4).select("path"), "path", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    state_side = plan[plan.index("FileScan") - 400 :]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in state_side
    store.forget()


def test_structure_proposal(spark):
    files = inventory(spark, ["HR/a.txt", "x/b.txt"])
    request = structure.structure_request(files, "Known names: none")
    text = request.first()["request"]
    assert "Files: 2" in text and "* a.txt" in text and text.index("Files: 2") < text.index("Known names") < text.index("* a.txt")

    def scorer(batch):
        return ["├── Customers/\n│   ├── Acme Corp/\n- Legal/ contracts\n- no folder\n├── {Name}/"] * len(batch)

    got = {(r["folder"], r["approved"]) for r in structure.proposed_folders(request, scorer).collect()}
    assert got == {("Customers", False), ("Corp", False), ("Legal", False)}


def test_context_names_every_table():
    from shelfmark.operators.scoring import context_text

    text = context_text(
        Settings(own_names=("Us",), vendors={"V": ["v1"]}, customers={"C": []}, former_customers={"F": {"aliases": ["f"]}},
                 employees={"P": {"role": "R", "team": "T"}}), ["E"], ["HR"])
    for part in ("Us", "V [v1]", "* C", "F [f]", "P [R | T]", "Known names: E", "* HR"):
        assert part in text


def test_an_arrival_is_written_by_as_many_tasks_as_read_it(spark, tmp_path, monkeypatch):
    """And all its files are one wave."""
    import os

    from shelfmark.checks import plans
    from shelfmark.checks.registry import QUERIES
    from shelfmark.streaming import waves as streaming

    docs = spark.range(60).selectExpr("id as doc_id", "concat('invoice number ', id) as text", "'en' as lang", "'s' as source", "16L as n_chars")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)  # a task per file
    paths, came, keep = [], [], plans.scratch_path
    monkeypatch.setattr(plans, "scratch_path", lambda *a: paths.append(keep(*a)) or paths[-1])
    monkeypatch.setattr(streaming, "run_stored_wave", lambda store, arrived, wave, *a, **k: came.append((wave, arrived.count())))
    try:
        QUERIES["incremental_wave"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    source = next(p for p in paths if "arrivals" in p)
    for arrival in range(3):
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{source}/{arrival}")) == 4
    assert came == [(1, 20), (2, 20), (3, 20)]
