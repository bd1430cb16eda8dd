"""Allowlist rules against the expanded rule list, and decisions on personal data."""

import random
import re

from pyspark.sql import functions as F

from scrubframe.operators import allowlist, pii


def judge(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "ocrtext string")
    return {r.ocrtext: r.safe for r in allowlist.allowlist_match(df, **kw).collect()}


def test_known_texts(spark):
    got = judge(spark, ["ERECT", "AP ERECT", "PA ERECT", "NOT ERECT", "AP ERECT L MOBILE", "L AP Supine", "LeFT WT BEARING",
                        "R R", "AP PA ERECT", "", "ERECT\n", " ERECT", "hb l", "l hb l", "hb l l", "ankle", "Red Dot", "ankles"])
    assert {t for t, safe in got.items() if safe} == {
        "ERECT", "AP ERECT", "PA ERECT", "AP ERECT L MOBILE", "L AP Supine", "LeFT WT BEARING", "hb l", "l hb l", "hb l l",
        "ankle", "Red Dot"}


def test_rule_list_sizes():
    assert len(allowlist.build_view_rules()) == 741
    assert len(allowlist.build_view_rules(reduce=True)) == 141
    assert len(allowlist.build_view_rules(["AAA", "ABC"])) == 743


def test_one_pattern_equals_all_orders(spark):
    rng = random.Random(3)
    words = ["l", "R", "lt", "Left", "pa", "AP", "mobile", "port", "under trolley", "resus", "in resus", "erect", "semi supine",
             "semi-erect", "weightbearing", "wt bearing", "hb", "hb l", "hbl", "horizontal beam lateral", "sitting", "x", "", "trolley"]
    texts = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(1500)}
    for reduce in (False, True):
        rules = [re.compile(p) for p in allowlist.view_rules(reduce)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r.t: r.s for r in df.select("t", F.col("t").rlike(allowlist.view_pattern(reduce)).alias("s")).collect()}
        want = {t: any(r.fullmatch(t) for r in rules) for t in texts}
        assert got == want and any(want.values()) and not all(want.values())


def test_numeric_rules(spark):
    safe = ["kV 54 mAs 2", "kVp: 100 mAs: 12.50", "DAP 12.34 e(0)", "DAP: 1O.O5 e(o) mGycm2", "REX 123", "rex 1 23.45.67", "2 of 3",
            "1/2", "kV 54 mAs 2 REX 123", "ext rot", "R internal-rotation L", "int"]
    unsafe = ["kV 54", "mAs 2", "4 of 5", "rotation", "DAP 12.34", "kV 54 mAs 2 jane"]
    got = judge(spark, safe + unsafe)
    assert {t for t, s in got.items() if s} == set(safe)


def test_glossary(spark):
    html = ("<ul><li><a href='x'>AAA</a>: abdominal aortic (aneurysm)</li><li>ABC: airway check : <b>again</b></li>"
            "<li>NONE</li><li> </li><li>(P)​<i>:</i>paren</li></ul>")
    pages = spark.createDataFrame([(1, html), (2, "<li>AAA<b>other</b></li>")], "page_id bigint, html string")
    entries = allowlist.parse_glossary(pages)
    got = {(r.page_id, r.abbr): list(r.meanings) for r in entries.collect()}
    assert got == {(1, "AAA"): [": abdominal aortic (aneurysm)"], (1, "ABC"): ["airway check", "again"],
                   (1, "P)"): ["paren"], (2, "AAA"): ["other"]}
    merged = {r.abbr: list(r.meanings) for r in allowlist.merge_glossaries(entries).collect()}
    assert merged["AAA"] == ["other"]
    assert judge(spark, ["aaa", "abc", "zzz"], glossary=entries) == {"aaa": True, "abc": True, "zzz": False}


def test_stored_decision_is_used(spark):
    df = spark.createDataFrame([("jane", 50, 0), ("jane", 50, 1), ("jane", 10, 0), ("ERECT", 10, 1), ("", 50, 0)],
                               "ocrtext string, nerengine int, nerpii int")
    left = allowlist.apply_allowlist_before_redaction(df).collect()
    assert sorted(tuple(r) for r in left) == [("", 50, 0), ("jane", 10, 0), ("jane", 50, 1)]


def test_pii_flag(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, "d")], "text_id int, text string")
    found = spark.createDataFrame([(1, "spacy", "PERSON"), (2, "spacy", "DATE"), (3, "spacy", "ORG"), (2, "flair", "GPE")],
                                  "text_id int, engine string, label string")
    entities = pii.entity_label_map(found)
    assert sorted((r.text_id, r.label) for r in entities.collect()) == [(1, "PER"), (2, "MISC"), (3, "ORG")]
    for engine, want in (("spacy", [1, 0, -1, 0]), ("allowlist", [1, 1, -1, 0]), (None, [-1, -1, -1, -1])):
        rows = pii.pii_flag(texts, entities, engine).orderBy("text_id").collect()
        assert [r.is_sensitive for r in rows] == want


def test_detectors(spark):
    df = spark.createDataFrame([("ERECT",), ("jane",), ("",)], "t string")
    rows = df.select(pii.detector_plugin("allowlist")(F.col("t")).alias("e")).collect()
    assert [[(x.text, x.label) for x in r.e] for r in rows] == [[], [("jane", "MISC")], []]
    shout = pii.detector_plugin("shout", lambda t: [(t, "PER")] if t.isupper() else [])
    assert [len(r.e) for r in df.select(shout(F.col("t")).alias("e")).collect()] == [1, 0, 0]


def test_detector_decisions(spark):
    pii.detector_plugin("capitals", lambda t: [(w, "PER") for w in t.split() if w.isupper()])
    df = spark.createDataFrame([("ERECT",), ("jane",), ("",)], "t string")
    for engine, want in (("allowlist", [0, 1, -1]), ("capitals", [1, 0, -1])):
        assert [r.s for r in df.select(pii.sensitivity(F.col("t"), engine).alias("s")).collect()] == want


def test_one_text_per_frame(spark):
    items = spark.createDataFrame([("f", 0, -1, i, f"w{i}") for i in range(25)] + [("g", 0, -1, 1, "ERECT")],
                                  "filename string, frame int, overlay int, ord int, ocrtext string")
    for piece in (10, 1000):
        rows = pii.frame_text_summary(items, piece=piece).orderBy("filename").collect()
        assert [(r.filename, r.n_items) for r in rows] == [("f", 25), ("g", 1)]
        assert rows[0].ocrtext == "".join(f"w{i} " for i in range(25))
