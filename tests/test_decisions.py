import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import categorize, decide, entities, scoring
from shelfmark.settings import Settings


def truth(reply, crit):
    """The decision table, row by row, for a reply dict or None and a critique or None."""
    if not reply:
        return ("Unknown", 0, "unknown")
    c1, a1 = reply.get("confidence"), reply.get("action")
    gate = 6 <= (c1 or 0) <= 8
    if gate and (reply.get("category") is None or reply.get("reasoning") is None):
        return ("Unknown", 0, "unknown")
    if gate and crit and crit["changed"]:
        c2 = crit["final_confidence"] if crit["final_confidence"] is not None else c1
        action = "unknown" if c2 < 7 else (a1 or "move")
        return (crit["final_category"] or reply["category"] or "Unknown", c2, action)
    conf = c1 or 0
    action = "unknown" if a1 is None or (a1 == "move" and conf < 7) else a1
    return (reply.get("category") or "Unknown", conf, action)


def test_final_decision_truth_table(spark):
    rows, crits, want = [], [], {}
    key = 0
    for c1 in (None, 0, 5, 6, 7, 8, 9):
        for a1 in (None, "move", "skip", "unknown"):
            for cat in ("A", None):
                for why in ("r", None):
                    for crit in (None, (True, "B", 5), (True, "B", 9), (True, None, None), (False, "B", 9)):
                        key += 1
                        reply = {"confidence": c1, "action": a1, "category": cat, "reasoning": why}
                        known = any(v is not None for v in reply.values())
                        rows.append((key, cat, c1, None, why, a1))
                        c = None
                        if crit:
                            crits.append((key, *crit))
                            c = dict(zip(("changed", "final_category", "final_confidence"), crit))
                        want[key] = truth(reply if known else None, c)
    first = spark.createDataFrame(
        rows, "k int, category string, confidence int, entity_detected string, reasoning string, action string"
    )
    second = spark.createDataFrame(crits, "k int, changed boolean, final_category string, final_confidence int")
    got = {r["k"]: (r["category"], r["confidence"], r["action"]) for r in decide.decide(first, second, "k").collect()}
    assert got == want


def test_critique_can_be_switched_off(spark):
    df = spark.createDataFrame([(7,)], "confidence int")
    assert df.filter(decide.needs_critique(F.col("confidence"), Settings(critique_enabled=False))).count() == 0


def test_replies_are_recovered_from_prose(spark):
    texts = ['{"category":"A","confidence":7}', 'x {"category":"B"} y', "none", "{broken", '{"a":{"b":1},"category":"C"} tail']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["c"] for r in df.select(decide.parse_reply(F.col("t"))["category"].alias("c")).collect()]
    assert got == ["A", "B", None, None, "C"]


@pytest.mark.parametrize(
    "path, category, entity",
    [
        ("/d/a. Customers/Acme/x", "Customers/Acme", "Acme"),
        ("/d/Customers/note.txt", "Customers/note.txt", "note.txt"),
        ("/d/CHR/x", "HR", None),
        ("/d/Finance/HR/x", "HR", None),
        ("C:\\d\\vendors\\Paper Mill\\x", "Vendors/Paper Mill", "Paper Mill"),
        ("/d/contoso & sons/x", "Customers/Contoso & Sons", "Contoso & Sons"),
        ("/d/else/x", None, None),
    ],
)
def test_path_rules(spark, path, category, entity):
    df = spark.createDataFrame([(path,)], "path string")
    hit = categorize.path_hit(F.col("path"), F.col("path"))
    row = df.select(hit["category"].alias("c"), hit["entity_detected"].alias("e")).first()
    assert (row["c"], row["e"]) == (category, entity)


def test_whole_component_variant(spark):
    df = spark.createDataFrame([("/d/CHR/x",), ("/d/HR/x",)], "path string")
    hit = categorize.path_hit(F.col("path"), F.col("path"), categorize.whole_component(categorize.PATH_RULES), ())
    assert [r[0] for r in df.select(hit["category"]).collect()] == [None, "HR"]


def test_generic_names_are_anchored(spark):
    names = ["Book1.xlsx", "MyBook1.xlsx", "copy of a.txt", "untitled", "Document.doc"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    hits = [r[0] for r in df.select(categorize.generic_hit(F.col("filename"))["category"].isNotNull()).collect()]
    assert hits == [True, False, True, True, True]


# ---- scoring


def rows_to_score(spark, n=25):
    return spark.range(n).select(F.col("id").cast("string").alias("path"), F.col("id").cast("string").alias("preview"))


FAST = Settings(retry_delay_seconds=0.0)


def test_a_bad_row_never_fails_its_batch(spark):
    def scorer(batch):
        if "7" in set(batch["preview"]):
            raise RuntimeError("no seven")
        return ['{"category":"A","confidence":9,"reasoning":"r","action":"move"}'] * len(batch)

    got = {r["path"]: r for r in scoring.score_and_parse(rows_to_score(spark), scorer, settings=FAST).collect()}
    assert len(got) == 25
    assert got["7"]["confidence"] == 0 and got["7"]["reasoning"] == "Error: no seven"
    assert all(r["confidence"] == 9 for p, r in got.items() if p != "7")


def test_batches_hold_at_most_ten_rows_and_wrong_counts_are_errors(spark):
    def sizes(batch):
        return ['{"category":"%d"}' % len(batch)] * len(batch)

    got = [int(r["category"]) for r in scoring.score_and_parse(rows_to_score(spark), sizes, concurrency=1).collect()]
    assert len(got) == 25 and max(got) == 10

    short = scoring.score_and_parse(rows_to_score(spark, 3), lambda b: [], settings=FAST).collect()
    assert {r["action"] for r in short} == {"unknown"}


def test_transient_errors_are_retried(spark):
    def scorer(batch):
        import builtins

        seen = getattr(builtins, "_tries", 0) + 1
        builtins._tries = seen
        if seen % 3:
            raise TimeoutError("later")
        return ['{"category":"ok"}'] * len(batch)

    got = scoring.score_and_parse(rows_to_score(spark, 4), scorer, settings=FAST, concurrency=1).collect()
    assert {r["category"] for r in got} == {"ok"}


# ---- entities


def test_first_alias_in_store_order_wins(spark):
    store = spark.createDataFrame([(1, "acme", "A"), (2, "acme corp", "B")], "ord int, alias string, canonical string")
    df = spark.createDataFrame([("p", "The ACME Corp file"), ("q", "nothing")], "path string, t string")
    got = {r["path"]: r["entity"] for r in entities.match_substrings(df, "t", store, "path").collect()}
    assert got == {"p": "A", "q": None}


@pytest.mark.parametrize("size", [3, 40, 400])
def test_substring_search_is_the_same_for_stores_of_any_size(spark, size):
    rng = random.Random(size)
    store = list(dict.fromkeys([" ", "", "a", "x  y", *("".join(rng.choices("abc ", k=rng.randrange(1, 8))) for _ in range(size))]))
    aliases = spark.createDataFrame([(i, a, a.upper()) for i, a in enumerate(store)], "ord int, alias string, canonical string")
    texts = ["x  y", " ", *("".join(rng.choices("abcd \n", k=rng.randrange(0, 15))) for _ in range(80))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, t string")
    got = {r["path"]: r["entity"] for r in entities.match_substrings(df, "t", aliases, "path").collect()}
    # aliases of blanks name nothing
    want = {str(i): next((a.upper() for a in store if a.strip() and a in t), None) for i, t in enumerate(texts)}
    assert got == want


def test_aliases_with_equal_beginnings_meet_only_their_words(spark):
    aliases = spark.range(20_000).selectExpr("cast(id as int) as ord", "concat('customer#', lpad(cast(id as string), 6, '0')) as alias", "cast(id as string) as canonical")
    df = spark.range(2_000).selectExpr("cast(id as string) as path", "concat('the customer#', lpad(cast(id * 7 as string), 6, '0'), ' and cus') as t")
    found = entities.match_substrings(df, "t", aliases, "path").collect()
    assert {r["path"]: r["entity"] for r in found} == {str(i): str(i * 7) for i in range(2_000)}


def _indel_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(len(b)), lambda best, j: max(best, row[j + 1], row[j] + (x == b[j])), initial=0)][1:]
    return 200.0 * row[-1] / (len(a) + len(b))


def test_piece_join_finds_every_pair_of_ratio_80(spark):
    rng = random.Random(9)
    words = list({"".join(rng.choices("abc", k=rng.randrange(1, 10))) for _ in range(150)})
    for size in (3, 70):
        store = list(dict.fromkeys(["", " ", *("".join(rng.choices("abc", k=rng.randrange(1, 10))) for _ in range(size))]))
        aliases = spark.createDataFrame([(i, a, a) for i, a in enumerate(store)], "ord int, alias string, canonical string")
        vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
        got = {r["word"]: (r["canonical"], round(r["ratio"], 6)) for r in entities.fuzzy_word_matches(vocabulary, aliases).collect()}
        want = {}
        for w in words:
            best = min(((-_indel_ratio(w, a), i, a) for i, a in enumerate(store) if a.strip()), default=None)
            if best and -best[0] >= 80:
                want[w] = (best[2], round(-best[0], 6))
        assert got == want and (size == 3 or want)


def test_find_entity_falls_back_to_fuzzy_words(spark):
    store = spark.createDataFrame([(1, "betatech", "Beta"), (2, "acme", "Acme")], "ord int, alias string, canonical string")
    df = spark.createDataFrame([("a", "x betatec y"), ("b", "akme"), ("c", "acmes offer betatec")], "path string, t string")
    got = {r["path"]: r["entity"] for r in entities.find_entities(df, "t", store, "path").collect()}
    assert got == {"a": "Beta", "b": None, "c": "Acme"}


def test_confirmation_promotes_a_learned_name(spark):
    mappings = spark.createDataFrame([("Acme", "ac")], "canonical string, alias string")
    learned = spark.createDataFrame([("Beta",), ("Gamma",)], "name string")
    pending = spark.createDataFrame(
        [("Bet", "Beta", 85, "/x"), ("Foo", "Acme", 82, "/y"), ("Bar", "Acme", 81, "/z")],
        "detected string, possible_match string, confidence int, file_path string",
    )
    verdicts = spark.createDataFrame([("Bet", "Beta", True), ("Foo", "Acme", False)], "detected string, canonical string, confirmed boolean")
    maps, names, left = entities.apply_confirmations(mappings, learned, pending, verdicts)
    assert {tuple(r) for r in maps.collect()} == {("Acme", "ac"), ("Beta", "Bet")}
    assert {r[0] for r in names.collect()} == {"Gamma", "Foo"}
    assert {r["detected"] for r in left.collect()} == {"Bar"}


def test_reply_numbers_in_any_form(spark):
    from shelfmark import schemas

    replies = ['{"confidence": 8}', '{"confidence": 8.0}', '{"confidence": "8"}', '{"confidence": 7.5}', '{"confidence": "high"}', "broken", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "k int, reply string")
    got = [r["c"] for r in rows.select("k", decide.parse_reply(F.col("reply"))["confidence"].alias("c")).orderBy("k").collect()]
    assert got == [8.0, 8.0, 8.0, 7.5, None, None, None]
    pair = rows.select(decide.parse_reply(F.lit('{"keep_file": "2", "is_duplicate": true}'), schemas.PAIR_REPLY)["keep_file"].alias("k")).first()
    assert pair["k"] == 2.0


def test_fractional_confidence_passes_the_gate(spark):
    first = spark.createDataFrame([(1, "A", 7.5, None, "r", "move"), (2, "A", 6.9, None, "r", "move")], "k int, category string, confidence double, entity_detected string, reasoning string, action string")
    second = spark.createDataFrame([], "k int, changed boolean, final_category string, final_confidence double")
    got = {r["k"]: r["action"] for r in decide.decide(first, second, "k").collect()}
    assert got == {1: "move", 2: "unknown"}
