import csv
import json
import os

from pyspark.sql import functions as F

from textweir import Policy, scan
from textweir.operators import audit, blocklist, compliance
from textweir.plans.tables import settings
from textweir.sources import readers, sinks

POLICY = Policy(name="p", pii_enabled=True, pii_patterns=("EMAIL",), topics=("crypto",), injection_enabled=True)


def test_attack_csv(spark, tmp_path):
    def write(name, rows, blank=False):
        path = tmp_path / name
        with open(path, "w", newline="") as f:
            csv.writer(f).writerows(rows)
            if blank:
                f.write("\n")
        return str(path)

    rows = [["Prompt", "expected"], ['say "hi", now', "passed"], ["two\nlines", "redacted_or_blocked"], ["no label"]]
    got = readers.read_attack_csv(spark, write("a.csv", rows, blank=True)).collect()
    assert [tuple(r) for r in got] == [('say "hi", now', "passed"), ("two\nlines", "redacted_or_blocked"), ("no label", "blocked")]
    got = readers.read_attack_csv(spark, write("b.csv", rows[1:])).collect()
    assert len(got) == 3
    # one folder: a header in one file and none in the other
    got = {r.prompt for r in readers.read_attack_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {'say "hi", now', "two\nlines", "no label"}
    write("c.csv", [["gamma", "passed"], ["prompt", "passed"]])
    got = [r.prompt for r in readers.read_attack_csv(spark, str(tmp_path / "*.csv")).collect()]
    assert sorted(got)[:2] == ["gamma", "no label"] and got.count("prompt") == 1 and len(got) == 8


def test_chat_requests_keep_every_line(spark, tmp_path):
    same = '{"model":"m","messages":[{"role":"user","content":"a","name":"n"}],"top_p":0.5}'
    (tmp_path / "r.jsonl").write_text("\n".join([same, same, '{"model":"m","messages":[]}', "broken"]) + "\n")
    got = readers.read_chat_requests(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r.conv_id for r in got}) == 4
    assert sorted((r.text or "", r.name or "", r.top_p or 0.0, r.corrupt) for r in got) == [
        ("", "", 0.0, False), ("", "", 0.0, True), ("a", "n", 0.5, False), ("a", "n", 0.5, False)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo a@b.co\n")
    got = readers.read_text_files(spark, str(tmp_path)).collect()
    assert got[0].text == "one\ntwo a@b.co\n" and got[0].path.endswith("a.txt")


def scanned(texts):
    return scan(texts(["a@b.co", "crypto", "system prompt and crypto", "fine"]), POLICY)


def test_audit(texts):
    events = audit.audit_events(scanned(texts), POLICY, keys=("i",)).orderBy("i").collect()
    assert [(e.action, e.input_len, e.valid) for e in events] == [
        ("redacted", 6, True), ("blocked", 6, False), ("blocked", 24, False), ("allowed", 4, True)]
    assert events[0].profile == "p" and events[0].latency_ms is None
    lines = audit.audit_events(scanned(texts).withColumn("latency_ms", F.lit(1.005)), POLICY).select(audit.console_line()).collect()
    assert lines[1][0] == "[Audit] BLOCKED | Rule: Topic:crypto | Latency: 1.00ms"
    freq = {r.label: (r.n, r.detector) for r in audit.rule_frequency(scanned(texts)).collect()}
    assert freq["Topic:crypto"] == (2, "Topic") and freq["PII:EMAIL"] == (1, "PII")
    counts = audit.audit_counts(audit.audit_events(scanned(texts), POLICY)).collect()
    assert {r.n for r in counts if r.level == 7} == {4}
    assert {r.n for r in counts if r.action == "blocked" and r.level == 0} == {2}


def test_log_rows(texts):
    rows = audit.gateway_rows(scanned(texts), "i", F.lit("PASSED"), F.lit(0.1), F.struct("action")).collect()
    assert json.loads(rows[0].metadata) == {"action": "redacted"} and len(rows[0].original_prompt) == 64
    kept = audit.gateway_rows(scanned(texts), "i", F.lit("PASSED"), F.lit(0.1), keep_original=True).collect()
    assert kept[0].original_prompt == "a@b.co" and kept[0].metadata == "{}"
    logs = audit.gateway_rows(scanned(texts), "i", F.lit("PASSED"), F.lit(0.1), keep_original=True).withColumn(
        "id", F.col("client_ip").cast("int"))
    assert [r.id for r in audit.audit_latest(logs, n=2).collect()] == [3, 2]
    fresh = audit.new_audit_rows(logs, (-1,)).orderBy("id").collect()
    assert [r.notice for r in fresh] == [True, False, False, False]
    assert audit.high_water_mark(logs) == (3,) and audit.high_water_mark(logs.limit(0)) is None
    assert audit.new_audit_rows(logs, None).count() == 4


def test_sinks(texts, spark, tmp_path, capsys):
    events = audit.audit_events(scanned(texts), POLICY)
    sinks.jsonl_sink(f"{tmp_path}/a")(events)
    sinks.jsonl_sink(f"{tmp_path}/a")(events)
    lines = [json.loads(line) for f in os.listdir(tmp_path / "a") if f.endswith(".json")
             for line in open(tmp_path / "a" / f)]
    assert len(lines) == 8 and lines[0]["timestamp"].endswith("Z") and "latency_ms" in lines[0]
    rows = audit.gateway_rows(scanned(texts), "i", F.lit("PASSED"), F.lit(0.1))
    for batch in (0, 1, 1):  # the retried batch replaces itself
        sinks.table_sink(f"{tmp_path}/t")(rows, batch)
    table = spark.read.parquet(f"{tmp_path}/t")
    assert table.count() == 8 and table.select("batch_id", "id").distinct().count() == 8
    sinks.result_json_sink(f"{tmp_path}/r")(scanned(texts))
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert {"valid", "action", "reason", "sanitized_text"} == set(got[0]) and len(got) == 4
    sinks.null_sink()(events)
    capsys.readouterr()
    many = events.crossJoin(spark.range(15).select())
    printed = str(tmp_path / "console")

    def show(line):  # runs in the tasks
        with open(printed, "a") as out:
            out.write(line + "\n")

    sinks.console_sink(show)(many)
    with open(printed) as lines:
        assert lines.read().count("[Audit] ") == 60
    # marks go over batches, whose ids start again
    mark = audit.high_water_mark(table)
    sinks.table_sink(f"{tmp_path}/t")(rows, 2)
    table = spark.read.parquet(f"{tmp_path}/t")
    assert {r.batch_id for r in audit.new_audit_rows(table, mark).collect()} == {2}
    assert audit.new_audit_rows(table, mark).count() == 4
    assert [r.batch_id for r in audit.audit_latest(table, n=5).collect()] == [2, 2, 2, 2, 1]
    for sink in (sinks.jsonl_sink(f"{tmp_path}/b"), sinks.result_json_sink(f"{tmp_path}/c"), sinks.null_sink()):
        for _ in range(2):  # a retried batch
            sink(scanned(texts), 5)
    assert spark.read.json(f"{tmp_path}/b").count() == 4 and spark.read.text(f"{tmp_path}/c").count() == 4


def test_compliance(spark, tmp_path):
    rows = [("buy crypto", "blocked"), ("a@b.co", "redacted_or_blocked"), ("fine", "passed"), ("other", "blocked")]
    details = compliance.run_corpus(spark.createDataFrame(rows, "prompt string, expected string"), POLICY)
    s = compliance.compliance_summary(details).first()
    assert (s.total, s.blocked, s.passed, s.errors, s.compliance_rate) == (4, 1, 3, 0, 25.0)
    assert compliance.compliance_summary(details.filter("false")).first().compliance_rate == 0.0
    confusion = {(r.expected, r.actual): (r.n, r.n_met) for r in compliance.compliance_confusion(details).collect()}
    assert confusion[("blocked", "allowed")] == (1, 0) and confusion[("redacted_or_blocked", "redacted")] == (1, 1)
    codes = spark.createDataFrame([(400, "security_policy_violation"), (200, None), (400, None), (429, None)], "h int, e string")
    assert [r[0] for r in codes.select(compliance.compliance_status(F.col("h"), F.col("e"))).collect()] == [
        "blocked", "passed", "error", "error"]
    sinks.compliance_report_sink(f"{tmp_path}/rep")(details)
    assert spark.read.json(f"{tmp_path}/rep/summary").first().total == 4
    assert spark.read.json(f"{tmp_path}/rep/details").count() == 4


def test_blocklist_equals_the_alternation(texts, spark):
    from conftest import random_texts

    from textweir.functions.keywords import sorted_unique_matches

    words = ["buy stock", "stock tip", "stock", "insider trading now", "tip"]
    rows = random_texts(500, ["buy ", "stock ", "Stock", " tip", "-", "insider ", "trading ", "now", ", ", "x", "é"], seed=2)
    df = texts(rows)
    terms = spark.createDataFrame(list(enumerate(words)), "rank int, term string")
    want = {r.i: "Topic:" + ",".join(r.m) for r in
            df.select("i", sorted_unique_matches(F.col("text"), words).alias("m")).collect() if r.m}
    got = {r.i: r.label for r in blocklist.blocklist_hits(df, "i", terms).collect()}
    assert got == want
    # the same through a Bloom filter and a salted shuffle join, for lists too long to broadcast
    got = {r.i: r.label for r in blocklist.blocklist_hits(df, "i", terms, broadcast_rows=0).collect()}
    assert got == want
    assert blocklist.blocklist_hits(df, "i", terms.limit(0), broadcast_rows=-1).count() == 0


def test_long_blocklist_is_stored_once_and_not_copied(texts, spark, monkeypatch):
    terms = spark.range(300).selectExpr("concat('w', id % 150, ' common') AS term").unionAll(spark.sql("SELECT 'the common' UNION ALL SELECT NULL"))
    rows = [f"{'The' if i % 3 else 'the'} common, w{i} common" for i in range(2000)]
    want = {i: ("Topic:" + ",".join([t[:10], f"w{i} common"][:1 + (i < 150)]), 1 + (i < 150)) for i, t in enumerate(rows)}
    split = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    for filtered in (blocklist._FILTERED, 0):  # through the Bloom filter, and too many terms for it
        monkeypatch.setattr(blocklist, "_FILTERED", filtered)
        with settings(spark, split):
            out = blocklist.blocklist_hits(texts(rows), "i", terms, broadcast_rows=10)
            assert {r.i: (r.label, r.n_hits) for r in out.collect()} == want
            plan = out._jdf.queryExecution()
            # each term once, read from the store; the frequent n-gram's partition is split
            assert plan.optimizedPlan().toString().count("Generate") == 1 and "Range (" not in plan.optimizedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan.executedPlan().toString()


def test_phrases_start_at_words(texts):
    from conftest import random_texts

    from textweir.plans import spans

    rows = [*random_texts(300, ["ab", "É9", "_", " ", "  ", "-", "\n", "c d", "😀", "२"], seed=11), "a" * 3000 + " b", "a" * 3000, "", None]
    found = texts(rows).select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (spans._PHRASE, r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+"))).collect()
    assert [r[0] for r in found] == [r[1] for r in found] and sum(len(r[0] or ()) for r in found) > 100


def test_blocklist_of_single_words(texts, spark):
    df = texts(["Tip, tip and STOCK", "tipping", None, ""])
    terms = spark.createDataFrame([("tip",), ("stock",), ("TIP",)], "term string")
    got = [tuple(r) for r in blocklist.blocklist_hits(df, "i", terms).collect()]
    assert got == [(0, "Topic:STOCK,Tip,tip", 3)]
    assert blocklist.blocklist_hits(df, "i", terms.limit(0)).count() == 0


def test_bloom_filter_lets_all_members_through_and_few_others(spark):
    members = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    bloom = blocklist.bloom_filter(members, "k")
    got = {r.k for r in blocklist.may_hold(spark.range(40_000).withColumnRenamed("id", "k"), "k", bloom).collect()}
    assert set(range(0, 40_000, 2)) <= got and len(got) < 20_000 + 2_600
    assert blocklist.may_hold(members, "k", blocklist.bloom_filter(members.limit(0), "k")).count() == 0


def test_substrings_of_all_lengths(texts, spark):
    from conftest import random_texts

    rows = [*random_texts(300, ["ab", "Ab", "ba", "c", " ", "é", "😀", "\n", "xyz", "İ"], seed=5), None, "", "x" * 30_000 + "needle"]
    words = ["a", "ab", "aba", "bab", "abab", "É", "b\nc", "xyzxyz", "😀a", "needle", "", None, "AB", "zzz", "c a", "é 😀"]
    terms = spark.createDataFrame(list(enumerate(words)), "rank int, term string")
    first = {}
    for i, w in enumerate(words):
        if w:
            first.setdefault(w.lower(), i)
    want = {}
    for i, t in enumerate(rows):
        low = spark.createDataFrame([(t,)], "t string").selectExpr("lower(t) AS l").first().l if t and "İ" in t else (t or "").lower()
        found = [w for w in sorted(first, key=first.get) if w in low]
        if found:
            want[i] = found
    df = texts(rows)
    for limit in (100, 0):  # broadcast and shuffled
        got = {r.i: r.found for r in blocklist.substring_hits(df, ["i"], terms, broadcast_rows=limit).collect()}
        assert got == want
    assert blocklist.substring_hits(df, ["i"], terms.limit(0)).count() == 0
    plan = blocklist.substring_hits(df, ["i"], terms)._jdf.queryExecution().toString()
    assert "needle" not in plan  # the terms are data


def test_substrings_in_lanes(texts, spark, monkeypatch):
    from conftest import random_texts

    monkeypatch.setattr(blocklist, "_LANE", 6)
    monkeypatch.setattr(blocklist, "_TEXTS", 7)
    words = sorted({w for n in (1, 2, 3, 5) for w in random_texts(12, ["ab", "ba", "c", "é", "😀"], seed=n, most=n + 3) if w} | {"abbacabbabac", "c" * 9})
    rows = [*random_texts(120, ["ab", "ba", "c", "É", "😀"], seed=8, most=20), "abbacabbabac" * 2, "c" * 40, None]
    terms = spark.createDataFrame([(len(words) - i, w) for i, w in enumerate(words)], "rank int, term string")
    want = {i: found for i, t in enumerate(rows) if (found := [w for w in words[::-1] if w in (t or "").lower()])}
    out = blocklist.substring_hits(texts(rows), ["i"], terms, broadcast_rows=0)
    assert {r.i: r.found for r in out.collect()} == want
    assert any(len(w) > blocklist._Q for found in want.values() for w in found)
    # terms of up to _Q characters are decided by their gram: no join of candidates with the texts
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    lanes = blocklist._lanes({1: 3, 2: 3, 3: 4, 8: 13})
    assert lanes == [([1, 2], 0, 1), ([3], 0, 1), *(([8], part, 3) for part in range(3))]


def test_substring_hits_are_not_shuffled(texts, spark):
    from conftest import random_texts

    rows = [*random_texts(200, ["ab", "Ba", "c", " ", "é"], seed=9, most=30), None]
    words = sorted({w.lower() for w in random_texts(60, ["ab", "ba", "c", " ", "é"], seed=10, most=6) if w})
    terms = spark.createDataFrame([(i % 3, w) for i, w in enumerate(words)], "rank int, term string")  # many of one rank
    listed = sorted(words, key=lambda w: (words.index(w) % 3, w))
    want = {i: found for i, t in enumerate(rows) if (found := [w for w in listed if w in (t or "").lower()])}
    for limit in (1_000, 0):  # broadcast, and dealt with the texts
        out = blocklist.substring_hits(texts(rows), ["i"], terms, broadcast_rows=limit)
        assert {r.i: r.found for r in out.collect()} == want
        above = out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert "Aggregate" not in above and "Repartition" not in above and "Sort" not in above


def test_substrings_of_hot_grams_long_texts_and_many_letters(texts, spark, monkeypatch):
    from itertools import product

    monkeypatch.setattr(blocklist, "_CHARS", 64)
    # the longer terms share all of their q-grams but the last
    words = ["abcdefgh", *("abcdefgh" + "".join(x) for x in product("xyz", repeat=3)), "hx", "h"]
    rows = ["abcdefghxyz" * 40 + "q" * 200 + "abcdefghzzx", "abcdefgh", "zhx" * 30, ""]
    terms = spark.createDataFrame([(len(w), w) for w in words], "rank int, term string")
    want = {i: found for i, t in enumerate(rows) if (found := [w for w in sorted(words, key=lambda w: (len(w), w)) if w in t])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for lane, limit in ((1_000, 1_000), (1_000, 0), (5, 0)):
            monkeypatch.setattr(blocklist, "_LANE", lane)
            out = blocklist.substring_hits(texts([*rows, *rows]), ["i"], terms, broadcast_rows=limit)
            assert {r.i: r.found for r in out.collect()} == want | {i + len(rows): found for i, found in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # as many letters as a key of four bytes does not hold
    import pyarrow as pa

    letters = [chr(c) for c in range(0x4E00, 0x9FFF)] + [chr(c) for c in range(0x20000, 0x27000)]
    grams = sorted(a + b for a, b in zip(letters, letters[1:]))
    lane = blocklist._Lane()
    for i in range(0, len(grams), 10_000):
        piece = grams[i:i + 10_000]
        lane.add(pa.array(piece), pa.nulls(len(piece), pa.string()), pa.array(range(i, i + len(piece)), pa.int64()))
    lane.close()
    assert {level.keys.dtype.itemsize for level, _ in lane._levels} == {4, 8}
    text, term, _ = lane.find(pa.array(["".join(letters[100:120]), "x", "".join(letters[::2])]), False)
    assert text.tolist() == [0] * 19 and [lane.terms[lane._order[k]].as_py() for k in term] == sorted(a + b for a, b in zip(letters[100:119], letters[101:120]))


def test_effective_rules(spark):
    listed = spark.createDataFrame([("a", "x"), ("a", "d1"), ("b", "y"), ("b", "y")], "policy string, rule string")
    got = {tuple(r) for r in audit.effective_rules(listed, ["d1", "d2"], "policy", "rule").collect()}
    assert got == {("a", "x"), ("a", "d1"), ("a", "d2"), ("b", "y"), ("b", "d1"), ("b", "d2")}
