import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from shelfmark.operators import filters
from shelfmark.settings import Settings
from shelfmark.sources import aliases, inventory, preview, records, sinks

NAMES = ["b.txt", "sub/d.PDF", "HR/f.txt", "sub/noext", "_a.txt", ".c.txt", "sub/_hid/e.txt"]


def tree(root, names=NAMES):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(n.encode())
    return str(root)


def relative(df, root):
    return {r["path"][len(root) + 1 :] for r in df.select("path").collect()}


def test_binary_listing_hides_names_and_full_listing_does_not(spark, tmp_path):
    root = tree(tmp_path)
    visible = relative(inventory.list_binary_files(spark, root), root)
    assert visible == {"b.txt", "sub/d.PDF", "HR/f.txt", "sub/noext"}
    assert relative(inventory.list_all_files(spark, root), root) == set(NAMES)


def test_full_listing_prunes_before_entering(spark, tmp_path):
    root = tree(tmp_path, [*NAMES, "Node_Modules/deep/x.txt"])
    assert relative(inventory.list_all_files(spark, root, ["node_modules"]), root) == set(NAMES)


def test_listed_metadata_makes_an_inventory(spark, tmp_path):
    root = tree(tmp_path)
    listed = inventory.list_all_files(spark, root).withColumn("root", F.lit(root))
    rows = {r["relative_path"]: r for r in inventory.inventory_from_manifest(listed, "root").collect()}
    assert rows["sub/d.PDF"]["extension"] == ".pdf"
    assert rows["sub/d.PDF"]["parent_folder"] == "sub"
    assert rows["b.txt"]["size_bytes"] == 5
    assert rows["b.txt"]["modified_time"] > dt.datetime(2020, 1, 1)


def test_content_is_not_read_by_the_listing(spark, tmp_path):
    df = inventory.list_binary_files(spark, tree(tmp_path)).filter("size_bytes > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert "PushedFilters: [IsNotNull(length), GreaterThan(length,5)]" in plan


def test_roots_that_are_missing_or_files(spark, tmp_path):
    root = tree(tmp_path)
    kinds = {r["root"]: r["kind"] for r in inventory.probe_roots(spark, [root, root + "/none", root + "/b.txt"]).collect()}
    assert kinds == {root: "dir", root + "/none": "missing", root + "/b.txt": "file"}


def test_overall_limit_takes_the_first_paths(spark):
    rows = [(r, f"{r}/f{i}", f"f{i}", 1, dt.datetime(2024, 1, 1)) for r in ("/a", "/b", "/c") for i in range(3)]
    manifest = spark.createDataFrame(
        rows, "root string, path string, relative_path string, size_bytes long, modified_time timestamp_ntz"
    )
    roots = spark.createDataFrame([("/a", "missing"), ("/b", "dir"), ("/c", "dir")], "root string, kind string")
    files, errors = inventory.multi_root_inventory(manifest, roots, limit=4)
    assert [r["path"] for r in files.orderBy("path").collect()] == ["/b/f0", "/b/f1", "/b/f2", "/c/f0"]
    assert [r["message"] for r in errors.collect()] == ["Root does not exist: /a"]


def test_decoding_order(spark):
    cases = [
        ("plain", "é".encode(), "é"),
        ("utf16le", "hé".encode("utf-16"), "hé"),
        ("utf16be", b"\xfe\xff" + "hé".encode("utf-16-be"), "hé"),
        ("lone", b"caf\xe9", "café"),
        ("broken16", b"\xff\xfeA", "ÿþA"),
        ("surrogate", b"\xff\xfe\x00\xd8", "ÿþ\x00Ø"),
        ("empty", b"", ""),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in cases], "name string, content binary")
    got = {r["name"]: r["t"] for r in df.select("name", preview.decode_bytes(F.col("content")).alias("t")).collect()}
    assert got == {n: t for n, _, t in cases}


def test_previews_by_format_with_a_custom_extractor(spark):
    def shout(content: bytes) -> str:
        if content == b"bad":
            raise ValueError("broken file")
        return content.decode().upper()

    rtf = rb"{\rtf1\ansi {\b Hello} world\par second}"
    rows = [
        ("a", ".txt", b"x" * 6000, 6000),
        ("b", ".csv", b"\n".join(b"%d" % i for i in range(50)), 100),
        ("c", ".rtf", rtf, len(rtf)),
        ("d", ".pdf", b"%PDF", 4),
        ("e", ".txt", b"big", 60 * 1024 * 1024),
        ("f", ".up", b"hey", 3),
        ("g", ".up", b"bad", 3),
    ]
    df = spark.createDataFrame(
        [(p, e, bytearray(c), s) for p, e, c, s in rows], "path string, extension string, content binary, size_bytes long"
    )
    got = {r["path"]: (r["status"], r["preview"]) for r in preview.binary_previews(df, {".up": shout}).collect()}
    assert got["a"] == ("ok", "x" * 5000)
    assert got["b"] == ("ok", "\n".join(str(i) for i in range(20)))
    assert got["c"] == ("ok", "Hello world second")
    assert got["d"] == ("unsupported", None)
    assert got["e"] == ("too_large", None)
    assert got["f"] == ("ok", "HEY")
    assert got["g"] == ("failed: broken file", None)


def test_alias_store_file(spark, tmp_path):
    store = {
        "entity_type": "customer",
        "entity_mappings": {"Acme": ["ACME Inc", "Shared"], "Beta": ["shared"]},
        "learned_entities": ["Gamma", "acme"],
        "fuzzy_matches_pending_confirmation": [
            {"detected": "Acm", "possible_match": "Acme", "confidence": 85, "file_path": "/x"}
        ],
    }
    path = tmp_path / "store.json"
    path.write_text(json.dumps(store, indent=2))
    mappings, learned, pending = aliases.read_store(spark, str(path))
    rows = aliases.flatten_aliases(mappings, learned).orderBy("ord").collect()
    # a later equal alias takes the name over, but keeps the first place
    assert [(r["alias"], r["canonical"]) for r in rows] == [
        ("acme", "acme"), ("acme inc", "Acme"), ("shared", "Beta"), ("beta", "Beta"), ("gamma", "Gamma"),
    ]
    assert pending.collect()[0]["possible_match"] == "Acme"


def test_record_round_trip_and_defaults(spark):
    df = spark.createDataFrame(
        [("/a/b.txt", "b.txt", ".txt", 5, dt.datetime(2024, 2, 3, 4, 5, 6), "a", "b.txt")],
        "path string, filename string, extension string, size_bytes long, modified_time timestamp_ntz, "
        "parent_folder string, relative_path string",
    )
    text = df.select(records.to_record(df).alias("r"))
    back = text.select(records.parse_files(F.col("r")).alias("f")).select("f.*")
    assert back.select(*df.columns).collect() == df.collect()
    row = spark.createDataFrame([("not json",), ('{"current_wave": 7}',)], "r string").select(
        records.parse_state(F.col("r")).alias("s")
    ).collect()
    assert row[0]["s"]["phase"] == "init" and row[0]["s"]["current_wave"] == 1
    assert row[1]["s"]["current_wave"] == 7 and row[1]["s"]["structure_approved"] is False


def test_report_is_written_in_line_order(spark, tmp_path):
    lines = spark.createDataFrame([(w, s, i, f"{w}-{s}-{i}") for w in (1, 2) for s in (1, 0) for i in (1, 0, 2)],
                                  "wave int, section int, line_no int, line string")
    out = str(tmp_path / "report")
    sinks.write_report(lines, out, by="wave")
    text = ""
    for part in sorted((tmp_path / "report" / "wave=1").glob("part-*")):
        text += part.read_text()
    assert text.split() == [f"1-{s}-{i}" for s in (0, 1) for i in (0, 1, 2)]


def test_action_rows_in_a_dry_run(spark, tmp_path):
    plan = spark.createDataFrame([("/a", "/b")], "path string, dest string")
    at = F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05"))
    real = sinks.action_rows(plan, "MOVE", "path", "dest", at)
    dry = sinks.action_rows(plan, "REMOVE FOLDER", "path", None, at, dry_run=True)
    both = [r["l"] for r in real.unionByName(dry).select(sinks.log_line().alias("l")).collect()]
    assert both == ["[2024-01-02 03:04:05] [ACTION] MOVED: /a -> /b", "[2024-01-02 03:04:05] [ACTION] WOULD REMOVE FOLDER: /a"]
    sinks.append(real, str(tmp_path / "log"))
    sinks.append(dry, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_skip_folders_spare_the_root_and_file_names(spark):
    df = spark.createDataFrame([("venv",), ("a/VENV/x.txt",), ("a/venvx/x.txt",), ("a/venv",)], "relative_path string")
    kept = {r[0] for r in filters.prune_folders(df).collect()}
    assert kept == {"venv", "a/venvx/x.txt", "a/venv"}


def test_empty_allow_list_accepts_all_but_denied(spark):
    df = spark.createDataFrame([(".txt",), (".MD".lower(),), ("",)], "extension string")
    open_all = Settings(process_extensions=())
    assert {r[0] for r in filters.filter_extensions(df, open_all).collect()} == {".txt", ""}


def test_release_deletes_only_what_was_written(spark, monkeypatch):
    from pathlib import Path

    from shelfmark import session

    monkeypatch.setattr(session, "_written", [])
    kept = Path(session.scratch_root(spark)) / "foreign"
    kept.mkdir(exist_ok=True)
    table = session.materialize(spark.range(10), "probe")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and table.count() == 10
    assert session.release(spark) == 1
    assert not folder.exists() and kept.exists()
    assert session.release(spark) == 0


def test_scratch_follows_the_session_setting(spark):
    from shelfmark import session

    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_links_to_folders_are_not_files_and_errors_come_out(spark, tmp_path):
    from shelfmark.sources import inventory

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    files, errors = inventory.list_tree(spark, str(tmp_path))
    assert [r["path"] for r in files.collect()] == [str(tmp_path / "a" / "x.txt")]
    assert [r["path"] for r in errors.collect()] == [str(tmp_path / "gone")]


def test_report_keeps_groups_together(spark, tmp_path):
    from shelfmark.sources import sinks

    rows = [(0, "g2", 0, "keep b", "/b"), (0, "g1", 1, "delete z", "/z"), (0, "g1", 0, "keep a", "/a"), (0, "g2", 1, "delete c", "/c"), (0, "g1", 1, "delete y", "/y")]
    lines = spark.createDataFrame(rows, "section int, group_key string, line_no int, line string, path string")
    sinks.write_report(lines, str(tmp_path / "r"))
    parts = sorted((tmp_path / "r").glob("part-*"))
    got = [line for p in parts for line in p.read_text().splitlines()]
    assert got == ["keep a", "delete y", "delete z", "keep b", "delete c"]


def test_scratch_must_be_shared_on_a_cluster():
    import types

    from shelfmark import session

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)
