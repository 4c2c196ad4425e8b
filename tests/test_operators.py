"""Hand-made rows for operators without a natural table, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import flatten, hooks
from marlstone.functions import text as X
from marlstone.operators import chunks, evidence, html, prepare, retrieval, versions
from marlstone.sources import files, published
from marlstone.streaming import jobs


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, X.normalize_text, "ﬁne\r\n\r\n\r\n\r\n  a \t b\x00c  ") == "fine\n\na b c"
    assert one(spark, X.language, "你好 abc") == "zh" and one(spark, X.language, "12") == "und"
    assert one(spark, X.version_of, "see Version v1.2 now") == "Version v1.2"
    for raw, want in (("v1.2", "1.2.0"), ("release 3", "3.0.0"), ("v2.0.1-Beta.1", "2.0.1-beta.1"), ("version 1.0 rc1", "1.0.0-rc1"), ("version 1.0 today", "1.0.0")):
        assert one(spark, X.normal_version, raw) == want, raw


def test_urls(spark):
    for raw, want in (("HTTP://Ex.com:80//a/../b/?utm_x=1&b=2&a#f", "http://ex.com/b?a=&b=2"), ("https://e.com", "https://e.com/"), ("rel/path#x", "rel/path"), (None, "")):
        assert one(spark, prepare.canonical_url, raw) == want


def test_history(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None)]
    h = versions.version_history(spark.createDataFrame(rows, "e int, t int, s string"), "e", "t", "s", "t").orderBy("e", "version_no").collect()
    assert [(r.e, r.s, r.valid_from, r.valid_to, r.n_seen) for r in h] == [(1, "a", 1, 3, 2), (1, "b", 3, 4, 1), (1, "a", 4, None, 1), (2, None, 1, None, 1)]


def test_conflicts(spark):
    rows = [("c1", "g", "f", "10", 0, 5), ("c2", "g", "f", "12", 5, None), ("c3", "g", "f", "13", 4, 6), ("c4", "h", "f", "1", 0, None), ("c5", "h", "f", "1", 0, None)]
    f = spark.createDataFrame(rows, "chunk string, g string, field string, value string, valid_from int, valid_to int")
    got = evidence.detect_conflicts(f, ["g", "field"], "chunk").collect()
    assert [(r.g, r.n_pairs, list(r.chunks), r.preferred) for r in got] == [("g", 2, ["c1", "c2", "c3"], "c2")]


def test_conflicts_by_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(f"c{i}", r.choice("gh"), r.choice("abc"), *(lambda a: (a, r.choice([None, a + r.randint(1, 6)])))(r.randint(0, 20))) for i in range(60)] + [("n", "g", "a", None, 3)]
    low = lambda x: -1 if x is None else x
    high = lambda x: 99 if x is None else x
    want = {}
    for g in "gh":
        p = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[1] == y[1] == g and x[2] != y[2] and low(x[3]) < high(y[4]) and low(y[3]) < high(x[4])]
        want[g] = (len(p), sorted({z[0] for q in p for z in q}), sorted({z[2] for q in p for z in q}))
    f = spark.createDataFrame(rows, "chunk string, g string, value string, valid_from int, valid_to int")
    assert {x.g: (x.n_pairs, list(x.chunks), list(x.conflict_values)) for x in evidence.detect_conflicts(f, ["g"], "chunk").collect()} == want


def test_temporal(spark):
    kind = "q string, question string, as_of timestamp, current_only boolean, versions array<string>, start_time timestamp, end_time timestamp, id string, score double, publish_time timestamp, is_current boolean, product_version string, valid_from timestamp, valid_to timestamp"
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    doc = lambda q, i, **x: (q.get("q"), q.get("text", ""), q.get("as_of"), q.get("only"), q.get("versions"), q.get("start"), q.get("end"), i, x.get("score", 1.0), x.get("at"), x.get("cur"), x.get("version"), x.get("a"), x.get("b"))
    of = lambda rows, **how: {(r.q, r.id): (r.time_score, r.version_score) for r in retrieval.temporal_rank(spark.createDataFrame(rows, kind), "q", "id", F.lit(day(180)), **how).collect()}
    v, w, t = {"q": "v", "versions": ["v1.2"]}, {"q": "w", "only": True}, {"q": "t", "as_of": day(50)}
    rows = [doc(v, "a", version="Version 1.2.0", at=day(0)), doc(v, "b", version="1.20"), doc(v, "c"), doc(w, "d", cur=True, at=day(180)), doc(w, "e", cur=False), doc(t, "f", a=day(40), b=day(50)), doc(t, "g", a=day(50)), doc({"q": "s", "start": day(9)}, "h", at=day(3)), doc({"q": "s", "start": day(9)}, "i", at=day(9))]
    assert of(rows) == {("v", "a"): (0.75, 1.0), ("w", "d"): (1.0, 1.0), ("t", "g"): (1.0, 1.0), ("s", "i"): (round(0.5 + 0.5 * 2 ** (-171 / 180), 6), 0.5)}
    soft = of(rows, strict=False)
    assert soft["v", "b"] == (0.625, 0.0) and soft["w", "e"] == (0.25, 0.0) and soft["t", "f"] == (0.0, 0.0) and soft["s", "h"] == (round((0.5 + 0.5 * 2 ** (-177 / 180)) * 0.2, 6), 0.5)
    with pytest.raises(ValueError):
        of(rows, temporal_weight=0.9, version_weight=0.2)


def test_hashed_vectors(spark):
    d = spark.createDataFrame([(1, "aa bb aa"), (2, "你好吗"), (3, None), (4, "ＡＡ bb aa")], "id long, text string")
    got = {r.id: list(r.embedding) for r in retrieval.hash_vectors(d, "id", "text", 64).collect()}
    assert sorted(got) == [1, 2, 4] and got[1] == got[4] and abs(sum(x * x for x in got[2]) - 1) < 1e-9
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [0.0, 2.0])], "id long, embedding array<double>")
    v = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id long, embedding array<double>")
    for block in (1, 4096):
        assert [(r.query_id, r.id, r["rank"]) for r in retrieval.dense_topk(q, v, 2, block, "id").orderBy("query_id", "rank").collect()] == [(7, 1, 1), (7, 3, 2), (9, 2, 1), (9, 1, 2)]


def test_html():
    page = "<html><nav>menu</nav><main><h1>Top</h1><p>One <b>two</b></p><ol start=3><li>x<li>y</ol><table><tr><th colspan=2>A</th></tr><tr><td>1<td>2</tr></table><pre>a\n b</pre><div class=cookie-bar>c</div></main><footer>f</footer></html>"
    assert html.blocks_of(page, 10) == [("heading", 1, "Top"), ("paragraph", 0, "One two"), ("item", 1, "3. x"), ("item", 1, "4. y"), ("header_row", 2, "A | "), ("row", 2, "1 | 2"), ("code", 0, "a\n b")]


def test_sections(spark):
    t = "lead\n# A\nx\n## B\ny\n# C\n## D\nz"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = chunks.heading_sections(d).orderBy("section").collect()
    assert [(list(r.path), t[r.char_start : r.char_end]) for r in got] == [([], "lead"), (["A"], "# A\nx"), (["A", "B"], "## B\ny"), (["C", "D"], "## D\nz")]


def test_windows(spark):
    t = ("Some words here. " * 300).strip()
    d = spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id long, text string")
    got = chunks.window_chunks(d).orderBy("chunk_index").collect()
    assert all(t[r.char_start : r.char_end] == r.content and len(r.content) <= 1800 for r in got) and got[-1].char_end == len(t)
    assert all(b.char_start <= a.char_end for a, b in zip(got, got[1:]))


def test_cuts():
    t = "One two. Three four five.\n\nSix " + "x" * 30 + " seven   "
    marks = chunks.Marks(t)
    assert (marks.word_from(3), marks.word_from(len(t)), marks.word_until(len(t)), marks.word_until(0)) == (4, None, len(t) - 3, 0)
    assert marks.cut(5, 20, 40) == 20 and marks.cut(10, 26, 40) == 26 and marks.cut(33, 40, 50) == 50
    got = chunks.windows(marks, 0, len(t), 20, 30, 5, 4)
    assert [t[a:b] for a, b in got] == ["One two. Three four", "four five.\n\nSix", "Six " + "x" * 26, "xxxx seven"]


def test_changes(spark):
    t = "# 2.0\n## Security fixes\na\n## Known issues\nb\n### Details\nc\n# Release notes\n## New\nd"
    r = chunks.release_sections(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("section").collect()
    assert [x.change_category for x in r] == ["other", "security", "known_issues", "known_issues", "other", "features"]
    d = spark.createDataFrame([(1, t, "changelog"), (2, "# A\nbody text", "blog"), (3, "plain", None)], "doc_id long, text string, source_type string")
    got = chunks.chunk_documents(d).collect()
    assert {x.change_category for x in got if x.doc_id == 1} >= {"security", "features"} and sorted(x.doc_id for x in got if x.doc_id > 1) == [2, 3]


def test_links(spark):
    hrefs = ["x.html", "//cdn.com/y", "../up", "/root?b=2&a=1", "?q=1", "mailto:a@b", "#top", "http://e.com/a/b/x.html", "https://o.com"]
    d = spark.createDataFrame([(1, "http://e.com/a/b/page?z#f", "".join(f'<a class=c href="{h}">t</a>' for h in hrefs))], "page_id long, url string, html string")
    want = [("http://e.com/a/b/x.html", True), ("http://cdn.com/y", False), ("http://e.com/a/up", True), ("http://e.com/root?a=1&b=2", True), ("http://e.com/a/b/page?q=1", True), ("https://o.com/", False)]
    assert [(r.link, r.same_origin) for r in html.page_links(d).orderBy("pos").collect()] == want
    assert [r.link for r in html.page_links(d, "/a/b").orderBy("pos").collect()] == ["http://e.com/a/b/x.html", "http://e.com/a/b/page?q=1"]


def test_table_rows(spark):
    page = '<main><ol start="x"><li>a</ol><table><tr><th colspan="100%">A<th>b | c</tr><tr><td colspan=2>1<td>2</tr></table></main>'
    got = html.table_rows(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.is_header, list(r.cells)) for r in got] == [(True, ["A", "b | c"]), (False, ["1", "", "2"])]


def test_flatten():
    assert flatten.text_of({"id": 1, "b": True, "title": "T", "a": {"url": "u", "text": "x"}, "n": [1, None]}) == ["T", "x", "b: true", "n: 1"]


def test_raw(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a/p.html").write_bytes(b"hi")
    (tmp_path / "a/p.meta.json").write_text(json.dumps({"raw_record_id": "1", "payload_path": "p.html", "payload_hash": "sha256:" + hashlib.sha256(b"hi").hexdigest()}))
    (tmp_path / "q.meta.json").write_text(json.dumps({"raw_record_id": "2", "payload_path": "x/none.html"}))
    (tmp_path / "r.meta.json").write_text(json.dumps({"raw_record_id": "3", "payload_path": "a/p.html", "payload_hash": "sha256:0"}))
    (tmp_path / "s.meta.json").write_text("{broken")
    got = {r.raw_record_id: r.failure for r in files.read_raw(spark, str(tmp_path)).collect()}
    assert got == {"1": None, "2": "missing_payload", "3": "hash_mismatch", None: "invalid_json"}
    for run in ("r1", "r2"):  # an unchanged page captured twice has one file name in two folders
        (tmp_path / "two" / run).mkdir(parents=True)
        (tmp_path / "two" / run / "same.html").write_bytes(run.encode())
        (tmp_path / "two" / run / "same.meta.json").write_text(json.dumps({"raw_record_id": run, "payload_path": f"{run}/same.html"}))
    assert sorted((r.raw_record_id, bytes(r.payload)) for r in files.read_raw(spark, str(tmp_path / "two")).collect()) == [("r1", b"r1"), ("r2", b"r2")]


def test_documents(spark, tmp_path):
    row = lambda v, d, c: json.dumps({"version_id": v, "document_id": d, "is_current": c})
    (tmp_path / "d.jsonl").write_text("\n".join([row("1", "a", True), "", "{bad", row("2", "b", True), row("2", "b", False), row("3", "c", True), row("4", "c", True)]))
    ok, bad = files.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert [r.version_id for r in ok.collect()] == ["1"]
    assert sorted(r.reason for r in bad.collect()) == ["duplicate_version", "duplicate_version", "invalid_json", "many_current", "many_current"]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x</link><description>d</description><pubDate>p</pubDate></item></channel></rss>")
    (tmp_path / "g.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://y"/><summary>s</summary><updated>u</updated></entry></feed>')
    assert sorted((r.title, r.link, r.body, r.published) for r in files.read_feed(spark, str(tmp_path)).collect()) == [("A", "http://x", "d", "p"), ("B", "http://y", "s", "u")]


def test_issues(spark, tmp_path):
    i = {"id": 1, "number": 7, "title": "t", "user": {"login": "u"}, "labels": [{"name": "x"}], "comments": 2, "comment_items": [{"id": 9, "body": "c", "user": {"login": "v"}}]}
    (tmp_path / "i.json").write_text(json.dumps([i, i | {"number": 8, "pull_request": {"url": "p"}}]))
    a, b = files.read_repo_events(spark, str(tmp_path))
    assert [(r.number, list(r.labels), r.comments_truncated) for r in a.collect()] == [(7, ["x"], True)] and [(r.number, r.author) for r in b.collect()] == [(7, "v")]


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('case_id,question,relevant_document_ids,relevance_grades,expected_version\n1,q,a;b,"{""a"": 2}",\n2,q,"[""x"",""y""]",,v1\n')
    got = files.read_eval_cases(spark, str(tmp_path / "c.csv")).orderBy("case_id").collect()
    assert [(list(r.relevant_document_ids), r.relevance_grades, r.expected_version) for r in got] == [(["a", "b"], {"a": 2.0}, None), (["x", "y"], None, "v1")]
    row = lambda i, ok="yes", rate="0.5", start="s", more="": f"{i},c,t,1,f,v,p,{start},x,,m,{ok},,{rate},1,2,0,0.1,no,\"a, note\",2024-01-01T00:00:00Z{more}"
    (tmp_path / "r.csv").write_text("\n".join([",".join(files.RUN_COLUMNS), row(1), row(2, "maybe"), row(3, "no", start=""), row(4, rate="1.5"), row(5, ok=""), row(6, more=",z")]) + "\n")
    ok, bad = files.read_runs(spark, str(tmp_path / "r.csv"))
    assert sorted((r.run_id, r.task_success, r.compile_success, r.model, r.product_version, r.notes, r.run_at.year) for r in ok.collect()) == [("1", True, None, "m", None, "a, note", 2024), ("5", False, None, "m", None, "a, note", 2024)]
    assert sorted((r.run_id, r.reject) for r in bad.collect()) == [("2", "bad_task_success"), ("3", "missing_provenance"), ("4", "bad_test_pass_rate"), ("6", "extra_values")]
    (tmp_path / "w.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.read_runs(spark, str(tmp_path / "w.csv"))


def test_json_documents(spark):
    d = spark.createDataFrame([('{"m": {"t": "T"}, "a": "x", "b": "y"}',), ('{"a": ""}',), ("no",)], "j string")
    assert [(r.title, r.content) for r in files.read_json_documents(d, "j", {"title": "m.t", "content": ["a", "b"]}).collect()] == [("T", "x\ny")]


def test_sinks(spark, tmp_path):
    d = spark.range(3)
    assert files.write_versioned(d, str(tmp_path / "v"), "1") and published.read(spark, str(tmp_path / "v")).count() == 3
    assert not files.write_versioned(spark.range(9), str(tmp_path / "v"), "2", failures=spark.range(1)) and published.read(spark, str(tmp_path / "v")).count() == 3
    log = spark.createDataFrame([("old",)], "digest string")
    assert [(r.expected, r.found, r.ok) for r in files.import_bundle(spark, {"t": 3}, {"t": d}, "new", log).collect()] == [(3, 3, True)]
    assert files.import_bundle(spark, {"t": 3}, {"t": d}, "old", log).count() == 0


def test_hooks(spark):
    d = spark.createDataFrame([(1, "q", "ab"), (1, "q", "abc")], "query_id int, q string, t string")
    got = hooks.pair_scores(d, "query_id", "q", "t", lambda q, t: [float(len(x)) for x in t])
    assert sorted(r.pair_score for r in got.collect()) == [0.0, 1.0]
    assert [r[0] for r in d.select(hooks.quote_selector(lambda q, t: t[:2])("q", "t")).collect()] == ["ab", "ab"]


def test_tokens_cjk(spark):
    assert one(spark, retrieval.tokens, "Foo-1 你好吗") == ["foo-1", "你", "好", "吗", "你好", "好吗"]


EVENTS = [(1, "2024-01-01 00:00:01", "a", 1), (2, "2024-01-01 00:00:30", "a", 2), (2, "2024-01-01 00:00:30", "a", 2), (3, "2024-01-01 00:01:30", "a", 3), (4, "2024-01-01 00:02:00", "b", 4)]


@pytest.fixture
def stream(spark, tmp_path):
    d = spark.createDataFrame(EVENTS, "id long, t string, k string, v int").withColumn("t", F.to_timestamp("t"))
    d.repartition(2).write.parquet(str(tmp_path / "in"))
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), tmp_path


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("ck" + name))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, stream):
    batch, s, tmp = stream
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(drain(jobs.event_counts(s, "t", "k", "1 minute"), "complete", tmp, "ec")) == rows(jobs.event_counts(batch, "t", "k", "1 minute"))
    assert rows(drain(jobs.latest_state(s, "k", "t", "v"), "complete", tmp, "ls")) == rows(jobs.latest_state(batch, "k", "t", "v"))
    assert rows(drain(jobs.dedup(s, "id", "t"), "append", tmp, "dd")) == rows(jobs.dedup(batch, "id", "t"))
    assert rows(drain(jobs.rate_demand(s, "k", "t"), "complete", tmp, "rd")) == rows(jobs.rate_demand(batch, "k", "t"))
    assert rows(drain(jobs.stale_sessions(s, "k", "t", "30 seconds"), "complete", tmp, "ss")) == rows(jobs.stale_sessions(batch, "k", "t", "30 seconds"))
    for _ in range(2):
        jobs.ingest(s, lambda d: d.where("k = 'a'"), "id", str(tmp / "out"), str(tmp / "ckin")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp / "out")).collect()) == [1, 2, 3]


def test_verdict(spark):
    rows = [("a", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3))] + [("a", 9, "2024-01-01 00:01:01")]
    d = spark.createDataFrame(rows, "k string, seq int, t string").withColumn("t", F.to_timestamp("t"))
    got = jobs.rate_verdict(d, "k", "t", "seq", 2).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True]
