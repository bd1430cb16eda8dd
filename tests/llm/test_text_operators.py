"""Text operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import shutil
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubframe.llm import chat, contamination, exact, extract, hashing, jaccard, language, lines, mix, pii, queries, warc
from scrubframe.llm.common import join_counted, maybe_in
from scrubframe.plans.fixtures import TABLES
from tests.conftest import SMALL
from tools.check_oracle import compare

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon phi chi psi omega"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, spans string"
ROWS = [
    (1, BASE, "en", "a", 1, "x", "x"), (2, BASE.upper(), "en", "a", 1, None, None), (3, BASE + " more", "en", "b", 1, None, None),
    (4, None, None, None, None, None, None), (5, "", "de", "b", 0, None, None), (6, "one two", "de", None, 7, None, None),
    (6, "one two", "de", None, 7, None, None), (7, "Ärger mit\n\n" + BASE + "\n" + BASE + " x", "de", "c", 3, None, None),
    (None, "lone words without an id stand here", "en", "c", 1, None, None), (8, "a " * 30_000, "en", "c", 1, None, None),
    (9, "1234 !!", "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in queries.queries() if n in queries.oracle_sql()])
def test_query_against_sql(spark, duck, name):
    assert compare(queries.queries()[name](spark, SMALL), duck, queries.oracle_sql()[name]).startswith("ok")


def test_line_dedup_keeps_the_first(docs):
    got = {r["doc_id"]: r for r in lines.deduplicated(docs).collect()}
    assert got[1]["removed"] == [] and got[2]["removed"] == [0] and got[3]["removed"] == [0] and got[7]["removed"] == [2, 3]
    assert got[7]["text"] == "Ärger mit\n" and got[4]["text"] is None and got[4]["n_lines"] == 0
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_long_lists_and_more_candidates_change_nothing(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, "\n".join(" ".join(rng.choice(words, rng.integers(4, 9))) for _ in range(6))) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [(d, n, frozenset(line.split())) for d, t in rows for n, line in enumerate(t.split("\n"))]
    want = {(d, n) for d, n, s in sets if s and any((e, m) < (d, n) and 100 * len(s & t) >= 80 * len(s | t) for e, m, t in sets)}
    for list_rows, kept in ((20_000, 4), (10, 1)):
        got = lines.deduplicated(frame, buckets=64, list_rows=list_rows, kept=kept).select("doc_id", F.explode("removed")).collect()
        assert {tuple(r) for r in got} == want


def test_short_lines_are_joined(spark, duck):
    texts = ["Les.\nyes no\n\n" + "la " * 200, "les.\n\n \nno YES no\nles", "你好世界\nla\none two three", "你好世界\nthree two one\none two three four",
             "yes\nno\nyes no x\nLes."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [(d, n, frozenset(line.lower().split())) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    for percent in (80, 50):
        want = {(d, n) for d, n, s in sets if s and any((e, m) < (d, n) and 100 * len(s & t) >= percent * len(s | t) for e, m, t in sets)}
        got = lines.deduplicated(frame, percent=percent).select("doc_id", F.explode("removed")).collect()
        assert {tuple(r) for r in got} == want and len(want) >= 6
    sql = queries.oracle_sql()["op1_line_dedup"]
    assert compare(queries.queries()["op1_line_dedup"](spark, SMALL), duck, sql).startswith("ok")


def test_chat_is_reversible(spark):
    texts = ["<|im_end|>", "<\\|a<|b", None, "", "plain ä", "<|im_end|><|im_start|>assistant ok"]
    rows = [(1, k, "assistant" if k % 2 else "us<|\ner<n", t) for k, t in enumerate(texts)] + [(None, None, None, None)]
    pieces = chat.chat_format(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    assert pieces[0]["piece"] is not None
    for row, want in zip([p for p in pieces if p["conv_id"] == 1], rows, strict=False):
        assert chat.read_piece(bytes(row["piece"])) == (want[2], want[3] or "")
        assert bytes(row["piece"]).count(b"<|") == 2
    read = {r["conv_id"]: r for r in chat.read_back(chat.chat_format(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    trained = "".join(t or "" for k, t in enumerate(texts) if k % 2)
    assert read[1]["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest() and read[None]["n_turns"] == 1


def test_language_on_held_out_rows(spark, docs):
    found = queries.op3_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n >= 0.95
    names, prototypes = language.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, names, prototypes).collect()}
    assert got[4] == got[5] == got[9] == "und" and got[1] in names
    names, prototypes = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, names, prototypes).collect()} == {"und"}


def test_archive_edge_rows(spark):
    long = "ä" * 700
    rows = [(1, "http://www.A.org/x?Q=1", long), (2, "https://b.org", long), (2, "https://b.org", long), (3, None, None), (None, "::bad::", "<p>"), (4, "http://a.org", "<p>")]
    got = warc.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == sorted(
        [("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("None", "response", "None"), ("4", "response", "None")])
    assert {r["payload_digest"] for r in got if r["page_id"] == 3} == {hashlib.sha1(b"").hexdigest()}
    assert warc.url_key("http://www.A.org/x?Q=1") == "org,a)/x?q=1"
    assert warc.archived(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_lookup_across_small_blocks(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    root = warc.shared_folder(spark, "test")
    directory = warc.write_archive(pages, root, block_rows=7, archive_bytes=10_000)
    assert directory.count() > 5
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.lookup(directory, pages.where("page_id % 3 = 0"), root).collect() if r["record_type"] == "response"}
    want = {r["page_id"]: r["html"] for r in pages.where("page_id % 3 = 0").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_extracted_text(spark):
    tree = extract.train(spark)
    assert all(tree.says(x) == bool(y) for x, y in extract.labelled_rows())
    page = ("<nav><a href=1>Home</a></nav><script>x='<p>no</p>'</script><article><h1>T &amp; U</h1><p>A <b>long\n\tpart</b> of&nbsp;text<br>more.<p>B.</p>"
            "<div class='comments'><p>me too</p></div></article><footer>f</footer><!-- open")
    assert extract.main_text(page, tree) == "T & U\nA long part of text more.\nB."
    rows = spark.createDataFrame([(1, "u", None), (None, None, "")], "page_id bigint, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in extract.extract(rows, tree).collect()] == [("", 0), ("", 0)]
    got = {r["page_id"]: r["text"] for r in queries.op5_extract_text(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S).group(1)
        parts = [" ".join(extract.html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in parts if b)


def test_mix_targets_and_limits(spark, docs):
    got = mix.mixed(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (4, 5)} == {0}
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 1)], "source string, source_size bigint")
    plan = {r["source"]: r["target"] for r in mix.targets(sizes).collect()}
    assert plan == {"a": 78.0, "b": 30.0, None: 3.0}
    assert mix.mixed(docs.limit(0)).count() == 0
    clash = docs.withColumn("part", F.lit(1)).withColumn("mean", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("cutoff", F.lit(4)).withColumn("copies", F.lit(9))
    rows = mix.mixed(clash).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r["doc_id"], r["copies"], r["part"], r["cutoff"]) for r in rows] == [
        (r["doc_id"], r["copies"], 1, 4) for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]


def test_longer_documents_are_repeated_more_often(spark):
    """Two sources of which one gets half of its words once more: documents of 400 words have four times the odds of those of 25."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.repeat(
        F.lit("w "), F.when(F.col("id") % 2 == 0, 400).otherwise(25)).alias("text"))
    rows = mix.mixed(frame, weights=(5, 3)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("copies"), F.sum(F.col("size") * F.col("copies")).alias(
        "words"), F.first("target").alias("target")).collect()
    often = {r["size"]: r["copies"] - 1 for r in rows}
    assert abs(sum(r["words"] for r in rows) - rows[0]["target"]) <= 400
    odds = {size: p / (1 - p) for size, p in often.items()}
    assert 3 < odds[400] / odds[25] < 5.3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> list[tuple]:
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def test_personal_data_against_plain_patterns(spark):
    texts = ["mail a.b@c.de, x@y, a@b.c_d@e.f é😀 q@w.e.r", "1.2.3.4.5.6.7.8 001.2.3.255 1.2.3.256 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (017) 555-7713.",
             "+49 30 1234567 card 5500005555555559", "", None, "7" * 50_000, "a" * 50_000 + "@", "IBAN DE89 3704 0044 0532 0130 00 end, DE89 3704 0044 0532 0130 01"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: [(s["start"], s["kind_no"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.personal_data(frame).collect()}
    for k, text in enumerate(texts):
        assert [s for s in got[k] if s[2] in PATTERNS] == brute_spans(text or ""), text
    assert [s[2] for s in got[8] if s[2] == "iban"] == ["iban"]
    assert pii.personal_data(frame.limit(0)).count() == 0


def test_context_decides_weak_spans(spark):
    far = "x" * pii.CONTEXT
    texts = {
        "part 123-45-6789 of the list": [], "SSN 123-45-6789": [("ssn", 4, 0.65)], "123-45-6789 is the social security number": [("ssn", 0, 0.55)],
        "ssn 123-45 6789, 000-12-3456, 900-12-3456, 123-00-4567": [], f"ssn {far} 123-45-6789": [],
        "order 12345678Z": [], "DNI 12345678Z": [("dni", 4, 0.65)], "DNI 12345678-Z": [("dni", 4, 0.65)], "DNI 12345678A": [],
        "type AB1234567": [], "passport: AB1234567": [("passport", 10, 0.65)], "passport AB12345": [],
        # A word speaks for the match it precedes; the one before it gets less.
        "build 1.2.3.4 and host 1.2.3.4": [("ip", 6, 0.7), ("ip", 23, 0.8)], "build 1.2.3.4": [("ip", 6, 0.6)],
        "é😀 ssn 123-45-6789, ssn 123-45-6780": [("ssn", 7, 0.65), ("ssn", 24, 0.65)]}
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for r in pii.personal_data(frame).collect():
        assert [(s["kind"], s["start"], round(s["score"], 2)) for s in r["spans"]] == texts[r["text"]], r["text"]
    bare = tuple(replace(kind, least=0.0) for kind in pii.KINDS)
    assert [s["kind"] for s in pii.personal_data(frame.where("text like 'part %'"), bare).first()["spans"]] == ["ssn"]


def brute_hits(text, items, window=10):
    words = [w.decode("utf-8", "surrogatepass") for w in contamination.words_of(text or "")]
    hit, found = [False] * len(words), set()
    for item, t in items:
        want = [w.decode() for w in contamination.words_of(t or "")]
        size = min(window, len(want))
        for k in range(len(want) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == want[k:k + size]:
                    hit[p:p + size] = [True] * size
                    found.add(str(item))
    return hit, found


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_contamination_against_brute_force(spark, part_bytes):
    rng = np.random.default_rng(3)
    words = list("abcdef")
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate((12, 15, 3, 1, 0))] + [(9, None), (10, "z " * 12)]
    rows = [(k, " ".join(rng.choice([*words, "q"], 200, p=[.15] * 6 + [.1]))) for k in range(6)] + [(6, None), (7, ""), (8, "Z," * 300), (8, items[0][1] + "! " + items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination.contaminated(docs, bench, ["doc_id", "text"], part_bytes=part_bytes, shard_words=300).collect()
    assert len(got) == len(rows)
    for r in got:
        hit, found = brute_hits(r["text"], items)
        assert [(s["start"], s["end"]) for s in r["spans"]] == contamination.spans_of(np.array(hit, bool)) and set(r["items"]) == found
    clean = contamination.decontaminated(docs, bench, part_bytes=part_bytes).collect()
    assert all(not any(brute_hits(r["text"], items)[0]) for r in clean)


def test_exact_dedup_with_colliding_digests(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.repartition(3).write.parquet(path)
    for digest in (exact.sha256, lambda text: F.substring(F.md5(text.cast("binary")), 1, 1).cast("binary")):
        got = exact.exact_dedup(spark, path, str(tmp_path / f"s{id(digest)}"), digest).collect()
        assert len(got) == len(ROWS)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
        assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)] and by[4] == [(5, 2, False)] and sorted(by[6]) == [(6, 2, False), (6, 2, True)]
        assert by[None] == [(None, 1, True)]


def test_exact_dedup_ignores_stray_files_in_the_log(spark, docs, tmp_path):
    path, root = str(tmp_path / "docs"), str(tmp_path / "root")
    docs.write.parquet(path)
    log = exact.digest_log(spark, path, root)
    for k, part in enumerate(sorted((tmp_path / "root" / "log").glob("part-*.parquet"))):
        shutil.copy(part, f"{log}/part-stray-{k}.parquet")
    sizes = {r["doc_id"]: r["group_size"] for r in exact.exact_dedup(spark, path, root).collect()}
    assert sizes == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2, 6: 2, 7: 1, None: 1, 8: 1, 9: 1}


def brute_components(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in sets}
    for _ in sets:
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    label[a] = label[b] = min(label[a], label[b])
    return {d: (len(s), label[d]) for d, s in sets}


@pytest.mark.parametrize("limits", [(4000, 4_000_000), (6, 4_000_000)])
def test_jaccard_join_against_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(4):
        base = [f"v{x}" for x in rng.integers(0, 400, 80)]
        for _ in range(14):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 4)):
                text[at] = f"u{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(text[:rng.integers(66, 81)])))
    rows += [(100, None), (101, ""), (102, "two words"), (103, "TWO words"), (104, rows[0][1])]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), buckets=1 << 12, most_sets=limits[0], most_shingles=limits[1]).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("parts", [(2, 1), (1, 2)])
def test_links_do_not_depend_on_equal_shards(spark, monkeypatch, parts):
    for name, n in zip(("describe", "postings_of"), parts, strict=True):
        def dealt(docs, *args, plain=getattr(jaccard, name), n=n):
            return plain(docs.repartitionByRange(n, "doc_id"), *args)

        monkeypatch.setattr(jaccard, name, dealt)
    pair = spark.createDataFrame([(1, BASE), (2, BASE + " more")], "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard.near_duplicates(pair).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}


def test_jaccard_join_of_rows_without_id_repeats_and_long_texts(spark):
    long = " ".join(f"w{k % 7919}x{k % 31}" for k in range(60_000))
    rows = [(None, BASE)] * 40 + [(None, BASE + " more")] * 40 + [(5, BASE)] * 3 + [(6, BASE + " more")] + [(8, long), (9, long + " end"), (10, "w0x0 w1x1"), (None, None), (11, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in jaccard.near_duplicates(frame).select("doc_id", "component_id").collect()}
    assert got == {(None, 5), (5, 5), (6, 5), (8, 8), (9, 8), (10, 10), (None, None), (11, 11)}
    lone = {tuple(r) for r in jaccard.near_duplicates(frame.where("doc_id is null")).collect()}
    assert {r[2] for r in lone} == {None}
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0


def test_common_words_tie_no_documents(spark, monkeypatch):
    """Counters far fuller than any shingle is common: runs of everyday words must not make candidates of unrelated documents."""
    rng, rows = np.random.default_rng(11), []
    for k in range(300):
        rows.append((k, " ".join(f"c{rng.integers(0, 3)}" if rng.random() < 0.6 else f"r{rng.integers(0, 1 << 40)}" for _ in range(120))))
    rows.append((300, rows[7][1] + " end"))
    moved = []

    def counted(members, *args, plain=jaccard.verified):
        moved.append(members.count())
        return plain(members, *args)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), buckets=1 << 8).collect()}
    assert got == {k: 7 if k == 300 else k for k in range(301)}
    assert 2 <= sum(moved) <= 30


def test_reach_ties_all_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(40):
        rank, sets = rng.integers(0, 50, 3000), []
        for _ in range(6):
            base = rng.choice(3000, rng.integers(5, 60), replace=False)
            for _ in range(5):
                sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.choice(3000, rng.integers(1, len(base) // 6 + 2))])))
        own = [jaccard._prefix(s.astype(np.uint64), rank[s], 80).astype(np.int64) for s in sets]
        e, o = np.concatenate(own), np.repeat(np.arange(len(sets)), [len(x) for x in own])
        m = np.array([len(s) for s in sets])[o]
        reach = np.concatenate([jaccard.reach_of(len(s), len(x), 80) for s, x in zip(sets, own, strict=True)])
        order = np.lexsort((o, -reach, m, e))
        number = np.cumsum(jaccard._chains(e[order], m[order], reach[order])[0])
        chains = [set(number[o[order] == k].tolist()) for k in range(len(sets))]
        for a in range(len(sets)):
            for b in range(a):
                if jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                    assert chains[a] & chains[b]
    assert jaccard.reach_of(100, 21, 80)[[0, 11, 20]].tolist() == [125, 100, 80]


def test_signature_tree_finds_all_classes():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)) for _ in range(3)]
    family = [np.sort(np.concatenate([np.delete(s, rng.integers(0, len(s), 3)), rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for s in sets for _ in range(12)]
    tree = jaccard.SignatureTree([np.unique(s) for s in family])
    tree.join()
    label = [tree.find(k) for k in range(len(family))]
    for a in range(len(family)):
        for b in range(a):
            common = len(np.intersect1d(family[a], family[b]))
            if jaccard.similar(common, len(np.unique(family[a])), len(np.unique(family[b]))):
                assert label[a] == label[b]
    assert len(set(label[:12])) < 12 and not set(label[:12]) & set(label[12:24])


def test_hashing_is_per_word():
    values, at = hashing.shingles(["a b c d e f", None, "x", "A b c d E f"], 5)
    assert at.tolist() == [0, 2, 2, 3, 5] and (values[:2] == values[3:]).all() and len(set(values.tolist())) == 3


def thue_morse(a, b, n=1024):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_of_equal_parts_stay_apart(spark):
    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    assert hashing.word_hashes(f"{x} {y} {x[:512]} {y[:512]}".encode(), True)[0].size == len(set(hashing.word_hashes(f"{x} {y} {x[:512]} {y[:512]}".encode(), True)[0].tolist())) == 4
    frame = spark.createDataFrame([(1, f"one two three {x}"), (2, f"one two three {y}"), (3, f"three two one {x}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["removed"] for r in lines.deduplicated(frame).collect()}
    assert got == {1: [], 2: [], 3: [0]}
    frame = spark.createDataFrame([(1, f"a b c d {x}"), (2, f"a b c d {y}"), (3, f"a b c D {x}")], "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard.near_duplicates(frame).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_hashes_depend_on_the_word_alone():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "ABCDEFGHI", "é" * 9, "x" * 100, "bcdefgh", "a\u00a0b"]
    alone = [hashing.word_hashes(w.encode(), True)[0].tolist() for w in words]
    assert [h for hs in alone for h in hs] == hashing.word_hashes((" \n".join(words) + "\t").encode(), True)[0].tolist()
    assert alone[3] == alone[4] and len({h[0] for h in alone}) == len(words) - 1 and len(hashing.word_hashes(b" \n", True)[0]) == 0


def test_many_lines_of_one_document(spark):
    import time
    text = "\n".join(f"line number {k % 20_000} has words w{k % 20_000} of v{k % 20_000} its own" for k in range(50_000))
    start = time.perf_counter()
    row = lines.deduplicated(spark.createDataFrame([(1, text, 5, "x")], "doc_id bigint, text string, n_lines int, removed string")).first()
    assert row["n_lines"] == 50_000 and row["removed"] == list(range(20_000, 50_000))
    assert time.perf_counter() - start < 120


def test_hot_join_and_prefilter(spark):
    left = spark.createDataFrame([(k % 700 if k % 3 else 0, k) for k in range(3000)], "key bigint, v bigint")
    right = left.where("key < 500").groupBy("key").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, left.join(right, "key", "left").select("key", "v", "n").na.fill(-1).collect()))
    assert sorted(map(tuple, join_counted(left, right, "key", "n").select("key", "v", "n").na.fill(-1).collect())) == want
    marked = maybe_in(left, right, ["key"])
    assert marked.where("key < 500 and not _maybe").isEmpty() and marked.where("_maybe").count() < 3000


def test_pipeline_stages(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(1).first()["text"]
    extra = spark.createDataFrame([(50, "Some clean words of its own in front.\n" + bench, "en", "a", 1, None, None), (51, bench, "en", "a", 1, None, None)], SCHEMA)
    frame = docs.unionByName(extra).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "mix_sources"]
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    known = stages["language_id"](spark, frame, SMALL)
    assert known.columns == frame.columns and not {"4", "5", "9"} & set(ids(known)) and "1" in ids(known)
    deduped = stages["line_dedup"](spark, frame, SMALL)
    assert deduped.columns == frame.columns and "2" not in ids(deduped) and {"1", "4", "5", "50"} <= set(ids(deduped))
    near = stages["near_dedup"](spark, frame, SMALL)
    assert near.columns == frame.columns and ids(near).count("6") == 1 and not {"2", "3"} & set(ids(near)) and {"1", "4", "5", "None"} <= set(ids(near))
    clean = {r["doc_id"]: r["text"] for r in stages["decontamination"](spark, frame, SMALL).collect()}
    assert 51 not in clean and clean[50].startswith("Some clean words") and len(clean[50]) < 60 and clean[1] == BASE and 4 in clean
    assert stages["mix_sources"](spark, frame.limit(0), SMALL).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    other = "quite another text that stands alone with words of its own here"
    rows = [(1, BASE), (6, BASE + " more"), (6, other), (None, BASE + " more"), (7, None), (7, None), (8, None), (9, "!"), (None, "x y"), (5, BASE.upper())]
    frame = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, SMALL).collect()}
    assert got == {(1, BASE), (6, other), (7, None), (8, None), (9, "!"), (None, "x y")}
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), SMALL).count() == 0


def test_pipeline_run(spark, tmp_path):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    passage = bench.limit(1).first()["text"]
    rng = np.random.default_rng(6)
    known = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 400").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in known] + [
        (9001, None, "en", "src0", 0), (9002, "12 34", "en", "src0", 5), (9003, passage, "en", "src1", len(passage)), (9004, known[0]["text"], "en", "src2", 1)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    ids = {r["doc_id"] for r in whole.collect()}
    assert not {9001, 9002, 9003, 9004} & ids and len(ids) > 20


def test_postings_of_lines_move_packed(spark):
    rows = {"some": np.array([1, 0, 1]), "doc_id": np.array([-5, 0, 1 << 40]), "th": np.zeros(3, np.int64), "ln": np.array([0, 300, 7]), "n": np.array([1, 2, 3]),
            "bits": np.array([0, 1 << 63, 1], np.uint64)}
    parts = list(lines.unpacked(lines.packed(rows, [0, 1, 3]), lines.LINE))
    assert [len(p["n"]) for p in parts] == [1, 2] and all((np.concatenate([p[c] for p in parts]) == rows[c]).all() for c in rows)
    assert lines.ranks(rows).tolist() == [1, 0, 2]
    texts = [f"{BASE} r{d} s{d}\n{BASE} u{d} v{d} w{d}" for d in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("th", F.lit(0).cast("bigint")).coalesce(2)
    sets = lines.line_groups(lines.describe(frame, hashing.commonness(frame, lines.tokens), 80, 20_000)).where("lines is not null").cache()
    none = np.zeros(0, np.int64)
    n = sets.agg(F.sum("postings")).first()[0]
    moved = lines.postings_of(sets, (none, none), 3)
    assert n > 2000 and moved.agg(F.sum("rows.count")).first()[0] == n and moved.count() <= 3 * sets.count()
    assert moved.select(F.expr("length(rows.th) + length(rows.ask)").alias("k")).where("k > 0").isEmpty()
    sets.unpersist()


def test_lines_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(25)]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(1, 8))) for _ in range(4)) for _ in range(60)]
    rows = [(None if k % 3 == 0 else k % 7, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, *rows[:20], (1, None), (None, None), (2, "")], "doc_id bigint, text string").withColumn("th", F.xxhash64("text"))
    # Null first, then doc_id, then the hash of the text.
    docs = sorted({((r["doc_id"] is not None, r["doc_id"] or 0, r["th"]), r["text"]) for r in frame.where("text is not null").collect()})
    sets = [((*d, n), frozenset(line.split())) for d, t in docs for n, line in enumerate(t.split("\n"))]
    want = {p for p, s in sets if s and any(q < p and 100 * len(s & t) >= 80 * len(s | t) for q, t in sets)}
    got = lines.deduplicated(frame, keep=["doc_id", "th"], kept=1).collect()
    assert {(r["doc_id"] is not None, r["doc_id"] or 0, r["th"], n) for r in got for n in r["removed"]} == want
    assert len(got) == 83 and all(r["n_lines"] == 0 and r["text"] is None for r in got if r["th"] == 42)
