import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import iter_admit
from textweir import Policy
from textweir.operators.corpus import sanitize_by_sentence, sanitize_sentence_rows
from textweir.sources.readers import CHUNK_SCHEMA, read_chunk_stream
from textweir.streaming import live, ordered, sanitize

POLICY = Policy(name="p", pii_enabled=True, pii_patterns=("EMAIL", "PHONE"), topics=("insider trading",))
DDL = CHUNK_SCHEMA.replace("ts timestamp", "sec double")


class Feed:
    """Chunk files that arrive one micro-batch at a time, and a stream over them."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        for name, value in ordered.ROCKSDB.items():
            spark.conf.set(name, value)
        for name in ("in", "out"):
            (folder / name).mkdir()

    def put(self, rows):
        df = self.spark.createDataFrame(rows, DDL).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1e6)).drop("sec")
        df.select("stream_id", "seq", "ts", "chunk", "eos").coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self

    def run(self, mode="text", idle="10 minutes"):
        chunks = read_chunk_stream(self.spark, f"{self.folder}/in", max_files=1)
        out = sanitize.sanitize_stream(chunks, POLICY, mode, idle)
        q = (out.writeStream.format("parquet").option("path", f"{self.folder}/out")
             .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()
        return self

    def rows(self, stream="s"):
        got = self.spark.read.parquet(f"{self.folder}/out").filter(F.col("stream_id") == stream).orderBy("ord").collect()
        assert [r.ord for r in got] == list(range(len(got)))
        return got

    def text(self, stream="s"):
        return "".join(r.emitted for r in self.rows(stream) if r.kind != "pass")


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def chunks(parts, stream="s", t0=0.0, start=0, eos=True):
    last = len(parts) - 1
    return [(stream, start + i, t0 + i, p, eos and i == last) for i, p in enumerate(parts)]


def test_finance_stream(feed):
    feed.put(chunks(["Hello", " ", "world", "!", " ", "Insider", " ", "trading", "."])).run()
    assert feed.text() == "Hello world! [BLOCKED: Topic:Insider trading]"


@pytest.mark.parametrize("mode, want", [("chunk", ["Pi is 3.", "14 ok."]), ("text", ["Pi is 3.14 ok."])])
def test_modes(feed, mode, want):
    feed.put(chunks(["Pi is 3.", "14 ok."])).run(mode)
    assert [r.emitted for r in feed.rows()] == want


TEXT = ("Hi there.  Call 555-123-4567 now!\nIs 3.14 fine?\t\tInsider trading is not. "
        "Mail a.b@c.org.  And é... so on. No end insider trading here")


def test_text_mode_does_not_depend_on_chunks(spark, feed):
    df = spark.createDataFrame([("s", TEXT)], "stream_id string, text string")
    batch = sanitize_by_sentence(df, POLICY).first()
    rng, rows = random.Random(1), []
    for n in range(12):
        cuts = sorted(rng.sample(range(1, len(TEXT)), rng.randint(0, 25)))
        parts = [TEXT[a:b] for a, b in zip([0, *cuts], [*cuts, len(TEXT)])]
        rows += chunks(parts, f"s{n}")
    rng.shuffle(rows)  # any order, across three micro-batches
    for i in range(3):
        feed.put(rows[i::3])
    feed.run()
    for n in range(12):
        assert feed.text(f"s{n}") == batch.sanitized_text
    assert batch.n_blocked == 2
    longform = sanitize_sentence_rows(df, POLICY).orderBy("pos").collect()
    assert "".join(r.emitted for r in longform) == batch.sanitized_text


def test_restart_from_checkpoint(feed):
    feed.put(chunks(["One. Tw", "o. Th"], eos=False)).run()
    assert feed.text() == "One. Two. "
    feed.put(chunks(["ree. Four"], start=2)).run()
    assert feed.text() == "One. Two. Three. Four"
    assert feed.rows()[-1].kind == "tail"


def test_idle_stream_is_flushed_over_a_gap(feed):
    feed.put([("s", 0, 0.0, "Start", False), ("s", 2, 1.0, " after gap", False)]).run(idle="1 minute")
    feed.put(chunks(["Other. x"], "o", t0=1000.0)).run(idle="1 minute")
    feed.put(chunks(["Later. x"], "l", t0=3000.0)).run(idle="1 minute")
    assert feed.text() == "Start after gap"


def test_empty_chunks_pass_through(feed):
    feed.put([("s", 0, 0.0, "", False), ("s", 1, 0.0, "A. ", False), ("s", 2, 0.0, None, False), ("s", 3, 0.0, "B", True)]).run()
    assert [(r.kind, r.sentence, r.seq) for r in feed.rows()] == [
        ("pass", "", 0), ("pass", None, 2), ("sentence", "A.", 3), ("tail", "B", 3)]
    assert feed.text() == "A. B"


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted([(i, rng.choice("ab"), rng.randint(0, 400) / 4) for i in range(300)], key=lambda r: r[2])
    (tmp_path / "in").mkdir()
    for part in range(3):  # in time order, a file per micro-batch
        df = spark.createDataFrame(rows[part * 100 : part * 100 + 100], "id int, client string, sec double")
        df.withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id int, client string, sec double, ts timestamp").parquet(f"{tmp_path}/in")
        out = live.rate_limit_stream(source, "client", "ts", "id", 5, 10)
        (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
         .trigger(availableNow=True).start().awaitTermination())
    got = {r.id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 300
    for client in "ab":
        mine = sorted((r for r in rows if r[1] == client), key=lambda r: (r[2], r[0]))
        want = iter_admit((round(r[2] * 1e6) for r in mine), 5, 10_000_000)
        # equal times may fall in two micro-batches, so ids are compared within a time
        by_time = {}
        for r, ok in zip(mine, want):
            by_time.setdefault(r[2], [0, 0])
            by_time[r[2]][0] += ok
            by_time[r[2]][1] += got[r[0]]
        assert all(a == b for a, b in by_time.values())


def test_audit_stream_hot_swap_and_retry(spark, tmp_path):
    active = {"p": POLICY}
    body = live.audit_batch(lambda: active["p"], [live.batch_parquet_sink(f"{tmp_path}/v"), live.batch_parquet_sink(f"{tmp_path}/a")])
    batch = spark.createDataFrame([("insider trading",), ("x",)], "text string")
    body(batch, 0)
    body(batch, 0)  # a retry replaces the batch
    active["p"] = Policy(name="open")
    body(batch, 1)
    got = spark.read.parquet(f"{tmp_path}/v").groupBy("policy", "action").count().collect()
    assert {(r.policy, r.action): r["count"] for r in got} == {("p", "blocked"): 1, ("p", "allowed"): 1, ("open", "allowed"): 2}
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    got = {}

    def run(rows):
        df = spark.createDataFrame(rows, "sec double, action string").withColumn("timestamp", F.timestamp_seconds("sec"))
        df.drop("sec").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("action string, timestamp timestamp").parquet(f"{tmp_path}/in")

        def keep(batch, batch_id):
            got.update({(r.window_start.timestamp(), r.action): r.n for r in batch.collect()})

        (live.audit_tumbling(source, late="1 minute").writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination())

    run([(0.0, "blocked"), (10.0, "blocked"), (1000.0, "allowed")])
    run([(5.0, "blocked"), (1001.0, "allowed")])
    assert sorted(got.values()) == [2, 2]


def test_cutting_is_linear():
    import time

    cutter, start = sanitize.Cutter(), time.perf_counter()
    for _ in range(8_000):
        assert cutter.feed("x" * 40, "text") == []
    assert time.perf_counter() - start < 1.0 and len(cutter.rest()) == 320_000


def test_cutter_equals_the_sentence_pattern():
    import re

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", ".", "? ", "!", " ", "\n", "b. "]) for _ in range(rng.randint(0, 30)))
        want = [(m.group(1), m.group(2)) for m in re.finditer(r"(.*?[.?!])(\s+)(?=\S)", text, re.DOTALL)]
        cutter, got, at = sanitize.Cutter(), [], 0
        while at < len(text):
            step = rng.randint(1, 5)
            got += cutter.feed(text[at:at + step], "text")
            cutter = sanitize.Cutter(cutter.rest())  # as from a checkpoint
            at += step
        assert got == want and "".join(a + b for a, b in got) + cutter.rest() == text


def test_parked_chunks_beyond_the_bound_are_dead_letters(feed):
    chunks_ = [("s", n, 0.0, f"c{n}. ", False) for n in range(1, 6)]
    feed.put(chunks_)
    source = read_chunk_stream(feed.spark, f"{feed.folder}/in", max_files=1)
    q = (sanitize.sentence_stream(source, parked_most=3).writeStream.format("parquet").option("path", f"{feed.folder}/out")
         .option("checkpointLocation", f"{feed.folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    got = feed.spark.read.parquet(f"{feed.folder}/out").collect()
    assert sorted((r.kind, r.sentence) for r in got) == [("dead_letter", "c4. "), ("dead_letter", "c5. ")]


def test_many_chunks_out_of_order_come_out_whole(feed):
    # more than several Arrow batches, backwards, in one micro-batch
    parts = [f"c{n}. " for n in range(25_000)]
    feed.put(chunks(parts)[::-1]).run()
    assert feed.text() == "".join(parts)
    assert {r.kind for r in feed.rows()} == {"sentence"}


def test_a_gap_closed_by_a_later_micro_batch_loses_nothing(feed):
    parts = [f"c{n}. " for n in range(11_000)]
    rows = [("s", n, 0.0, part, n == len(parts) - 1) for n, part in enumerate(parts)]
    feed.put(rows[1:]).run()
    feed.put(rows[:1]).run()
    assert feed.text() == "".join(parts)


def test_a_stream_goes_on_after_dead_letters_and_ends_with_them(feed):
    for rows in ([("s", n, 0.0, f"c{n}. ", n == 5) for n in range(1, 6)], [("s", 0, 1.0, "c0. ", False)]):
        feed.put(rows)
        source = read_chunk_stream(feed.spark, f"{feed.folder}/in", max_files=1)
        q = (sanitize.sentence_stream(source, parked_most=3).writeStream.format("parquet").option("path", f"{feed.folder}/out")
             .option("checkpointLocation", f"{feed.folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    got = feed.rows()
    assert [r.seq for r in got if r.kind == "dead_letter"] == [5, 4]
    assert "".join(r.sentence + r.separator for r in got if r.kind != "dead_letter") == "c0. c1. c2. c3. "


def test_blanks_after_a_mark_are_looked_at_once():
    for blanks in (" ", "\n \t"):
        start = time.perf_counter()
        cutter = sanitize.Cutter()
        assert cutter.feed("One.", "text") == []
        for _ in range(320_000 // len(blanks) // 8):
            assert cutter.feed(blanks * 8, "text") == []
        assert len(cutter.rest()) >= 320_000 - 8 * len(blanks)
        (body, between), = cutter.feed("x", "text")
        assert (body, set(between)) == ("One.", set(blanks)) and cutter.rest() == "x"
        assert time.perf_counter() - start < 1.0


def test_parked_chunks_cost_what_is_read(spark, feed):
    """Ten thousand parked chunks; a call that reads one more of another stream, or of this one, leaves them alone."""
    parked = [("s", i, 0.0, f"w{i} ", False) for i in range(1, 10_001)]
    feed.put(parked).run()
    start = time.perf_counter()
    feed.put([("s", 10_001, 1.0, "end. ", False)]).run()
    assert time.perf_counter() - start < 10
    feed.put([("s", 0, 2.0, "w0 ", False), ("s", 10_002, 2.0, "", True)]).run()
    assert feed.text() == "".join(f"w{i} " for i in range(10_001)) + "end. "


@pytest.mark.parametrize("path, slot", [(None, 3), ("path", 25)])  # slots shorter and longer than the window
def test_limiter_in_order_over_micro_batches(spark, tmp_path, path, slot):
    """Requests that arrive up to a batch late are decided at their place; a hot client has most of them."""
    for name, value in ordered.ROCKSDB.items():
        spark.conf.set(name, value)
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), i / 4 + rng.random() * 5, rng.choice(["/v1/x", "/v1/x", "/ping", None])) for i in range(400)]
    rows += [(-1, "closing", 10_000.0, "/v1/x")]
    schema = "id int, client string, sec double, path string"
    for part in range(5):
        df = spark.createDataFrame(rows[part * 100:part * 100 + 100], schema).withColumn("ts", F.timestamp_seconds("sec"))
        df.withColumn("odd name", F.lit(1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(f"{schema}, ts timestamp, `odd name` int").parquet(f"{tmp_path}/in")
        out = ordered.rate_limit_in_order(source, "client", "ts", "id", 5, 10, late="40 seconds", path=path, slot_seconds=slot)
        (out.withColumnRenamed("odd name", "odd").writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination())
    got = {r.id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").filter("id >= 0").collect()}
    assert len(got) == 400
    counted = [r for r in rows[:400] if path is None or (r[3] or "").startswith("/v1/")]
    want = {r[0]: True for r in rows[:400]}
    for client in {r[1] for r in counted}:
        mine = sorted((r for r in counted if r[1] == client), key=lambda r: (round(r[2] * 1e6), r[0]))
        want |= dict(zip([r[0] for r in mine], iter_admit((round(r[2] * 1e6) for r in mine), 5, 10_000_000)))
    assert got == want


def test_a_call_of_the_sentence_stream_takes_and_gives_rows():
    """A frame for every stream of a micro-batch cost more than the work on it."""
    from pyspark.sql import Row

    class Empty:
        def exists(self):
            return False

    from textweir.streaming import sanitize as module

    calls = module._Sentences("text", 1_000, None)
    calls.value, calls.parked, calls.gone = Empty(), None, None
    given = Row("stream_id", "seq", "ts", "chunk", "eos", "ms")
    got = list(calls.handleInputRows(("a",), iter([given("a", 1, None, "is. Two", True, 7), given("a", 0, None, "One ", False, 5)]), None))
    assert [tuple(r) for r in got] == [("a", 0, 1, "sentence", "One is.", " "), ("a", 1, 1, "tail", "Two", "")]
