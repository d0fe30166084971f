"""URL rules, archives, weak-label quality and the pipeline."""

import collections
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_text_operators import check_packing, linked, table
from textweir.llm import quality, urlrules, warc
from textweir.llm import queries as q
from textweir.llm.shared import fresh_path


def test_url_rules_against_all_pairs(spark):
    rng = random.Random(2)
    labels = ["a", "b", "ab", "com", "net"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/x", "/x/", "/x/y?z", "/xy#f", "/X"]
    rules = sorted({(rng.choice(hosts), rng.choice(["", "/", "/x", "/x/", "/xy"]), rng.choice(["allow", "block"])) for _ in range(80)})
    urls = [None, "", "nohost", "http://", "HTTP://A.COM", "http://é.a.com/x"] + [
        f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)] + ["http://a.com/x"] * 200
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id bigint, url string, pid int, key string")
    given = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(pages, given).collect()}
    for i, u in enumerate(urls):
        _, mark, rest = (u or "").partition("://")
        rest = rest if mark else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(-len(h + p), -len(h), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = min(fits)[2:] if fits and host else (None, "allow")
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best), u
    assert urlrules.judge(pages.limit(0), given).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, given.limit(0), "block").collect()} == {"block"}


def test_archives_come_back(spark):
    long = "".join(chr(97 + i % 26) for i in range(70_000)) + "é😀" * 9_000
    html = [None, "", "short", "short", "é" * 60, "é" * 60, long, long, "WARC/1.1\r\n\r\n0\r\n\r\n" * 20, "line\n" * 30, "x" * 100, "x" * 99, "x" * 99]
    rows = [(i, None if i == 1 else f"http://h/{i} \n", h, "d", 1) for i, h in enumerate(html)]
    rows += [rows[4], (4, "u", "other " * 30, "d", 1), (None, "u", "h", "d", 1), (None, "v", long, "d", 1), (None, None, "n" * 200, "d", 1),
             (None, None, "n" * 200, "d", 1), (9, "u", "x" * 100, "d", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, size int")
    path = fresh_path(spark, "warc")
    warc.write(pages.repartition(3), path)
    got = warc.read(spark, path).withColumn("page", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to"))).collect()
    assert len({r.record_id for r in got}) == len(rows)
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        h = h or ""
        again = len(h.encode()) >= 100 and h in first and first[h] != i
        want.append((i, "revisit" if again else "response", first[h] if again else None, None if again else h.encode(),
                     len(h.encode()) if again else None, "sha256:" + hashlib.sha256(h.encode()).hexdigest()))
    rank = lambda r: (r[0] is None, *map(str, r))
    assert sorted(want, key=rank) == sorted(
        ((r.page, r.type, r.to, r.payload and bytes(r.payload) if r.payload is not None else None, r.http_length, r.digest) for r in got), key=rank)
    empty = fresh_path(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_cut_archives_and_any_file_names(spark, tmp_path):
    whole = [r.encode() for i in range(3) for r in warc._records(i, "u", f"page {i} " * 40, "d", None, 10, "0")]
    data = b"\r\n\r\n".join(whole) + b"\r\n\r\n"
    packed = gzip.compress(data)
    noise = random.Random(3).randbytes(300)
    cases = {
        "crawl-1.warc.gz": packed, "plain.warc": data,
        "header.warc": data + b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:textweir:page:7:0>\r\nContent-Le",
        "block.warc": data[:-50], "zip.warc.gz": gzip.compress(data + noise)[:-100], "broken.warc.gz": packed[:60] + noise,
        "length.warc": data + whole[0].replace(b"Content-Length", b"X-Length") + b"\r\n\r\n" + whole[1], "empty.warc": b"", "other.txt": noise,
    }
    want = {"crawl-1.warc.gz": (3, 3), "plain.warc": (3, 3), "header.warc": (4, 3), "block.warc": (3, 2), "length.warc": (5, 4), "empty.warc": (0, 0)}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
        got = warc.read(spark, str(tmp_path / name)).collect()
        good = [r for r in got if r.payload is not None]
        if name in want:
            assert (len(got), len(good)) == want[name], name
        for r in good:
            assert bytes(r.payload) == f"page {r.record_id.split(':')[3]} ".encode() * 40
        if name == "header.warc":
            assert sum(r.record_id == "urn:textweir:page:7:0" and r.type == "response" for r in got) == 1
    assert warc.read(spark, str(tmp_path)).count() >= 18


def test_query_of_archives_with_odd_ids(spark, tmp_path):
    rows = [(1, "u", "a" * 120), (1, "v", "a" * 120), (1, "w", "b" * 120), (None, "x", "a" * 120), (2, None, None), (None, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = q.op8_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (0, 0, "response", 0), (0, 120, "revisit", 1), (1, 120, "response", 0), (1, 120, "response", 0), (1, 120, "response", 0),
        (2, 0, "response", 0)]


def test_broken_messages_have_no_payload(spark):
    whole = list(warc._records(7, "u", "y" * 160_000, "d", None, 160_000))
    assert len(whole) == 3
    for kept in ([0, 1, 2], [0, 2], [0, 1], [2, 0, 1]):
        path = fresh_path(spark, "warc")
        records = spark.createDataFrame([(whole[k],) for k in kept], "value string")
        records.write.option("lineSep", "\r\n\r\n").text(path)
        payload = warc.read(spark, path).first().payload
        assert (payload is not None) == (len(kept) == 3)
        assert payload is None or bytes(payload) == b"y" * 160_000
    assert warc.unchunk(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab\r\n0\r\n\r\n")[1] is None


def test_votes_give_back_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.8, 0.65, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, -1, np.where(rng.random(len(truth)) < a, truth, ~truth)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_votes(patterns.astype(np.int64), counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03 and np.abs(model.accuracy() - accuracy).max() < 0.03
    assert ((model.posterior(votes.astype(np.int64)) > 0.5) == truth).mean() > 0.9


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.classify(docs).collect()
    right = [r.kept == bool(labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert len(got) == docs.count() and sum(right) / len(right) > 0.93
    odd = table(spark, [None, "", " ", "word", "word " * 500, "$$ %% ## " * 50])
    assert quality.classify(odd).count() == 6 and quality.classify(odd.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = before
        if name != "packing":
            assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near_duplicates":
            ids = sorted(before)
            roots = linked([before[i] for i in ids])
            assert after == {ids[r] for r in set(roots)}
        if name == "decontamination":
            bad = {r.doc_id for r in q.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").collect()}
            assert after == set(before) - bad
        if name == "pii":
            assert after == set(before)
            assert out.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        docs = out
    rows = docs.collect()
    check_packing(rows, kept["packing"], 2048, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_pipeline_takes_odd_documents(spark):
    import tempfile

    texts = [None, "", "idiot", "a b c d e f", "a b c d e f", "call (212) 555-0100"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, kinds string")
    folder = tempfile.mkdtemp()
    docs.drop("kinds").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, 1, 1), (3, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in rows)[None] == 1 and {0, 1, 3, 5} <= {r.doc_id for r in rows} and 4 not in {r.doc_id for r in rows}


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, evidence int, row_key int"


def stage(spark, name, rows, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 5, 6) for i, t in rows], DOCUMENT).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert name == "packing" or out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) if name != "packing" else out.collect()


def test_stages_judge_rows_not_ids(spark, sf_dir):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c)]
    assert stage(spark, "near_duplicates", rows, sf_dir) == [(1, a), (1, b), (None, c)]
    assert stage(spark, "near_duplicates", [(5, a), (5, a), (4, a + " x"), (None, None), (6, None), (7, ""), (7, "")], sf_dir) == [
        (4, a + " x"), (6, None), (7, ""), (7, ""), (None, None)]
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, passage), (1, a), (None, passage), (None, b), (2, None), (2, ""), (3, a + " " + "w " * 50_000)]
    assert [i for i, _ in stage(spark, "decontamination", rows, sf_dir)] == [1, 2, 2, 3, None]
    bad = "you are worthless scum, a stupid pathetic idiot and disgusting trash, you moron clown loser"
    large = "/root/testdata/sf0.01"  # labelled documents to learn from, and rows of one of their ids and of none
    known = [(r.doc_id, r.text) for r in spark.read.parquet(f"{large}/documents.parquet").collect()]
    odd = [(-1, bad), (-1, a), (None, bad), (None, c), (-2, None), (-2, "")]
    left = stage(spark, "toxicity", known + odd, large)
    assert [r for r in left if r[0] is None or r[0] < 0] == [(-2, ""), (-2, None), (-1, a), (None, c)]
    assert 0.8 * len(known) < len(left) < len(known)
    rows = [(1, "mail me at joe@example.org"), (1, a), (None, b), (2, None), (2, "")]
    got = stage(spark, "pii", rows, sf_dir)
    assert [i for i, _ in got] == [1, 1, 2, 2, None] and "joe@example.org" not in str(got)
    assert sorted(r.doc_id or 0 for r in stage(spark, "packing", rows, sf_dir)) == [0, 1, 1, 2, 2]
    for name in dict(corpus_pipeline.STAGES):
        assert stage(spark, name, [], sf_dir) == []
