"""Golden and brute-force tests of the operators."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import models
from quillspark.operators import crawl, ledger, ocr, outline, records, retrieval, timestamps, vectors
from quillspark.plans.catalogue import QUERIES
from quillspark.schemas import FETCH
from quillspark.sources import files


def test_longest_first_of_equals(spark):
    rows = spark.createDataFrame([("A", "12345", 1), ("B", "123", 2), ("A", "1234567", 3), ("A", "7654321", 4)], "id string, t string, pos int")
    got = {r["key"]: r for r in records.keep_longest(rows, F.col("id"), F.length("t"), "pos").collect()}
    assert got["A"]["t"] == "1234567" and got["A"]["first_seen"] == 1 and got["A"]["n_records"] == 3 and len(got) == 2
    assert records.keep_longest(rows.where("false"), F.col("id"), F.length("t"), "pos").count() == 0


def test_upsert_and_lookup(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string"), spark.createDataFrame([("b", "2"), ("c", "2")], "k string, v string")
    assert {tuple(r) for r in records.upsert(old, new, "k").collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    dims = spark.createDataFrame([("english", "en")], "name string, code string")
    assert records.lookup_code(spark.createDataFrame([(" English ",)], "lang string"), dims, "lang").first()["code"] == "en"
    with pytest.raises(Exception, match="unknown language"):
        records.lookup_code(spark.createDataFrame([("klingon",)], "lang string"), dims, "lang").collect()


def test_nearest_is_exact(spark):
    v = np.random.default_rng(1).normal(size=(300, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "i bigint, v array<double>")
    got = vectors.nearest(df.where("i < 20"), df, "i", "v", 4).orderBy("query_id", "rank").collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for qid in range(20):
        far = np.round(1 - u @ u[qid], 9)
        assert [r["id"] for r in got if r["query_id"] == qid] == sorted(range(300), key=lambda i: (far[i], i))[:4]
    assert vectors.nearest(df.where("false"), df, "i", "v").count() == 0


def test_ocr(spark):
    rows = [(1, 1, 1, 0, "שלום", "95"), (1, 1, 1, 1, "x", "39.9"), (1, 1, 2, 2, "world", "40"), (2, 1, 1, 3, " ", "90"), (2, 1, 1, 4, "end", "bad"), (2, 1, 1, 5, "fin", "41")]
    words = spark.createDataFrame([(1, *r) for r in rows], "page int, block_num int, par_num int, line_num int, pos int, text string, conf string")
    assert ocr.regroup(words, ["page"]).first()["text"] == "שלום\nworld\n\nfin"


def test_ledger(spark):
    raws = [json.dumps({"document_type": "sales", "amount": a}) for a in (100, "50", True, 2.5, None)] + ["broken", '```json\n{"document_type": "refund"}\n```', "[1]", None, ""]
    got = ledger.totals(ledger.decode(spark.createDataFrame(list(enumerate(raws)), "invoice_id int, raw string"), keep=("invoice_id",)), "document_type")
    assert {(r["document_type"], r["n"], r["amount"]) for r in got.collect()} == {("sales", 5, 103.5), ("unrecognized", 5, 0.0)}


def test_outline(spark):
    raws = ['{"slides":[{"heading":" ","bullets":[" a ",""]},{"heading":"","bullets":[]},3]}', '{"title":"x","slides":[]}', None, "no", '{"slides":[{"heading":null}]}']
    got = [r["o"] for r in spark.createDataFrame(list(enumerate(raws)), "i int, r string").orderBy("i").select(outline.normalise(F.col("r")).alias("o")).collect()]
    assert got[0]["title"] == "Untitled Presentation" and got[0]["subtitle"] == "" and [(s["heading"], s["bullets"]) for s in got[0]["slides"]] == [("Untitled", ["a"])]
    assert got[1] is got[2] is got[3] is None and got[4]["slides"][0]["heading"] == "None"


def fetches(spark):
    day = dt.datetime(2024, 1, 1)
    steps = [(200, "A", True, None), (304, None, True, None), (200, "A", True, None), (200, "B", True, None), (500, None, True, None), (200, "C", False, None), (200, None, None, None), (200, "B", True, "timeout")]
    return spark.createDataFrame([("u", day + dt.timedelta(hours=20 * k), s, h, None, None, r, e, day) for k, (s, h, r, e) in enumerate(steps)] + [(None, day, 200, "x", None, None, True, None, day), ("v", None, 200, "x", None, None, True, None, day)], FETCH)


def test_manifest_changes_and_stream(spark, tmp_path):
    f = fetches(spark)
    got = [r["outcome"] for r in crawl.manifest_changes(f).orderBy("ts").collect()]
    assert got == ["new", "unchanged", "unchanged", "updated", "error", "error", "error", "error"]
    stats = crawl.crawl_stats(crawl.manifest_changes(f)).first()
    assert (stats["pdfs_seen"], stats["pdfs_new"], stats["pdfs_updated"], stats["pdfs_unchanged"], stats["errors"]) == (8, 1, 1, 2, 2)
    from quillspark.streaming.manifest import manifest_stream

    f.where("pdf_url IS NOT NULL AND ts IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = manifest_stream(spark.readStream.schema(FETCH).parquet(str(tmp_path / "in")))
    run = out.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["outcome"] for r in spark.table("changes").orderBy("ts").collect()] == got


def many_fetches(spark, n=60):
    rng, day = np.random.default_rng(5), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        status = int(rng.choice([200, 200, 200, 304, 500]))
        sha = str(rng.choice(["A", "B", "C"])) if status == 200 else None
        error = "timeout" if rng.random() < 0.1 else None
        rows.append((f"https://x.example/f/{'hot' if k % 3 else k % 7}.pdf", day + dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 9))), status, sha, str(rng.choice(["e1", "e2"])) if rng.random() < 0.6 else None, None, bool(rng.random() < 0.9), error, day + dt.timedelta(minutes=k)))
    return rows


def brute_manifest(rows, told, manifest=None):
    """The fetches one after another, as a crawler would apply them."""
    state, out = {k: dict(v) for k, v in (manifest or {}).items()}, []
    at = lambda ts: ts.strftime("%Y-%m-%dT%H:%M:%SZ")
    for url, ts, status, sha, etag, modified, robots, error, _ in sorted(rows, key=lambda r: (r[1], r[8])):
        entry = state.get(url, {})
        if not robots or error or status not in (200, 304):
            out.append("error")
            continue
        if status == 304 or entry.get("sha256") == sha:
            out.append("unchanged")
            if status == 200:
                entry = entry | {"etag": etag or entry.get("etag"), "last_modified": modified or entry.get("last_modified")}
            state[url] = entry | {"last_checked": at(ts)}
            continue
        out.append("updated" if url in state else "new")
        page, title = told[url]
        state[url] = {"etag": etag, "last_modified": modified, "sha256": sha, "local_filename": entry.get("local_filename") or f"{title} -- {url.rsplit('/', 1)[1]}", "source_page_url": page, "source_title": title, "first_seen": entry.get("first_seen") or at(ts), "last_checked": at(ts)}
    return state, out


def test_manifest_equals_brute_force(spark, tmp_path):
    from quillspark.schemas import MANIFEST, MANIFEST_FIELDS
    from quillspark.streaming.manifest import crawl_run, manifest_stream, stored_manifest

    rows = many_fetches(spark)
    f = spark.createDataFrame(rows, FETCH)
    told = {u: (f"https://x.example/he/{k}", f"Law {k}") for k, u in enumerate(sorted({r[0] for r in rows}))}
    discoveries = spark.createDataFrame([(u, p, t) for u, (p, t) in told.items()], "pdf_url string, source_page_url string, source_title string")
    hot = "https://x.example/f/hot.pdf"
    start = {hot: {"sha256": "A", "etag": "e0", "local_filename": "kept.pdf", "first_seen": "2020-01-01T00:00:00Z"}, "https://x.example/f/old.pdf": {"sha256": "Z", "last_checked": "2020-01-01T00:00:00Z"}}
    held = spark.createDataFrame([(u, *(e.get(c) for c in MANIFEST_FIELDS)) for u, e in start.items()], MANIFEST)
    for prior, table in (({}, None), (start, held)):
        state, outcomes = brute_manifest(rows, told, prior)
        changes = crawl.manifest_changes(f, table)
        assert [r["outcome"] for r in changes.orderBy("ts", "arrived_at").collect()] == outcomes
        got = {r["pdf_url"]: {c: r[c] for c in MANIFEST_FIELDS} for r in crawl.manifest_state(changes, discoveries, "Site", table).collect()}
        assert got == {u: {c: e.get(c) for c in MANIFEST_FIELDS} for u, e in state.items()}
    errors = crawl.crawl_errors(crawl.manifest_changes(f)).collect()
    assert len(errors) == sum(1 for r in rows if r[6] and (r[7] or r[2] == 500)) and any("HTTP 500" in r["message"] for r in errors)
    # as a stream: an address in several frames of one batch, in no order
    state, outcomes = brute_manifest(rows, told)
    f.orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = manifest_stream(spark.readStream.schema(FETCH).parquet(str(tmp_path / "in")))
        out.writeStream.format("memory").queryName("hot_changes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [r[1] for r in sorted(rows, key=lambda r: (r[1], r[8]))]
    assert [r["outcome"] for r in spark.table("hot_changes").orderBy("ts").collect()] == outcomes and len(set(order)) == len(order)
    # as a daily run: batches in order of time, each upon the manifest of the one before
    by_time = sorted(rows, key=lambda r: r[1])
    for k in range(3):
        spark.createDataFrame(by_time[20 * k : 20 * k + 20], FETCH).coalesce(1).write.parquet(str(tmp_path / "days" / f"d={k}"))
        run = crawl_run(spark.readStream.schema(FETCH).parquet(str(tmp_path / "days" / "d=*")), discoveries, str(tmp_path / "store"), str(tmp_path / "cp2"), "Site", discoveries)
        run.awaitTermination(120)
    got = {r["pdf_url"]: {c: r[c] for c in MANIFEST_FIELDS} for r in stored_manifest(spark, str(tmp_path / "store")).collect()}
    assert got == {u: {c: e.get(c) for c in MANIFEST_FIELDS} for u, e in state.items()}
    assert crawl_run(f, discoveries, str(tmp_path / "none"), str(tmp_path / "cp3"), "Site", None) is None
    assert "aborting" in spark.read.parquet(str(tmp_path / "none" / "errors" / "batch=aborted")).first()["message"] and stored_manifest(spark, str(tmp_path / "none")).count() == 0


def test_not_modified_makes_an_entry(spark):
    day = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("u", day + dt.timedelta(days=k), s, h, None, None, True, None, day) for k, (s, h) in enumerate([(304, None), (200, "A"), (200, "A")])], FETCH)
    assert [r["outcome"] for r in crawl.manifest_changes(f).orderBy("ts").collect()] == ["unchanged", "updated", "unchanged"]


def test_discovery(spark):
    pages = spark.createDataFrame([("https://x.example/he/p", "<title>A &amp; B</title><a href='/f/a.PDF?x'>a</a><a href='b.txt'>b</a>"), ("https://x.example/he/q", None)], "page_url string, html string")
    assert [tuple(r) for r in crawl.discover_pdfs(pages).collect()] == [("https://x.example/he/p", "A & B", "https://x.example/f/a.PDF?x")]
    edges = spark.createDataFrame([("r", "s", True), ("s", "r", True), ("s", "https://x.example/he/1", False), ("s", "https://x.example/en/1", False)], "parent string, child string, is_index boolean")
    assert [r["url"] for r in crawl.walk_sitemaps(edges, "r").collect()] == ["https://x.example/he/1"]
    deep = spark.createDataFrame([(f"s{k}", f"s{k + 1}", True) for k in range(25)] + [("s25", "https://x.example/he/deep", False), ("s25", "https://x.example/he/deep2", False)], "parent string, child string, is_index boolean")
    assert crawl.walk_sitemaps(deep, "s0").count() == 2 and crawl.walk_sitemaps(deep, "s0", most=1).first()["url"] == "https://x.example/he/deep"
    rules = spark.createDataFrame([("x.example", "/private")], "host string, path_prefix string")
    urls = spark.createDataFrame([("https://x.example/he/1",), ("https://x.example/private/2",), ("https://y.example/",)], "u string")
    assert [r["u"] for r in crawl.robots_allow(urls, rules, "u").collect()] == ["https://x.example/he/1"]


def test_modes_and_feeds(spark):
    pages = spark.createDataFrame([("https://x.example/he/p", "<title>Law (חוק) - אתר הזכויות</title><a href='/f/a.pdf'>a</a><a href='https://evilx.example/b.pdf'>b</a>"), ("https://x.example/he/q", "<title>News</title><a href='/c.pdf'>c</a>"), ("https://x.example/en/r", "<title>R (חוק) – אתר הזכויות</title><a href='d.pdf'>d</a>")], "page_url string, html string")
    edges = spark.createDataFrame([("root", u, False) for u in ("https://x.example/he/p", "https://x.example/he/q", "https://x.example/en/r")], "parent string, child string, is_index boolean")
    feeds = spark.createDataFrame([("<feed><entry><link href='https://x.example/en/r'/><link href='no'/></entry></feed>",)], "xml string")
    law = F.col("title").rlike(r"\((?:חוק|תקנות|חקיקה)\)\s*[-–]\s*אתר.?הזכויות")
    find = lambda mode: [r["pdf_url"] for r in crawl.discover(mode, pages, edges, "root", feeds, title_filter=law, domain="x.example").collect()]
    assert find("full") == ["https://x.example/f/a.pdf"] and find("incremental") == ["https://x.example/en/d.pdf"]
    with pytest.raises(ValueError, match="weekly"):
        find("weekly")
    url = spark.range(1).select(crawl.feed_url(F.lit("https://x.example"), "a b*~ü", 2, 9).alias("u")).first()["u"]
    assert url == "https://x.example/w/he/index.php?title=a%20b%2A~%C3%BC&feed=atom&days=2&limit=9"


def test_sitemaps_and_gzip(spark):
    import gzip

    index = b"<sitemapindex xmlns='u'><sitemap><loc> https://x.example/a.xml.gz </loc></sitemap></sitemapindex>"
    leaf = gzip.compress(b"<urlset><url><loc>https://x.example/he/1</loc></url></urlset>")
    fetched = spark.createDataFrame([("r", bytearray(index)), ("https://x.example/a.xml.gz", bytearray(leaf)), ("bad", bytearray(b"<urlset>")), ("bad.gz", bytearray(b"plain")), ("cut", bytearray(leaf[:20])), ("none", None)], "url string, content binary")
    assert sorted(tuple(r) for r in crawl.sitemap_edges(fetched).collect()) == [("https://x.example/a.xml.gz", "https://x.example/he/1", False), ("r", "https://x.example/a.xml.gz", True)]
    got = {r["url"]: r["c"] for r in fetched.select("url", files.gunzip_named("url", "content").alias("c")).collect()}
    assert bytes(got["r"]) == index and got["bad.gz"] is None and got["cut"] is None and got["none"] is None and b"urlset" in bytes(got["https://x.example/a.xml.gz"])
    assert fetched.where("url = 'cut'").select(files.gunzip("content").alias("c")).first()["c"] is None


def test_manifest_file(spark, tmp_path):
    from quillspark.schemas import MANIFEST

    entries = spark.createDataFrame([('u"1', "e", None, "s", "f", "p", "כותרת", "a", "b"), ("u2", None, None, None, None, None, None, None, "c")], MANIFEST)
    text = files.save_manifest(entries).first()["content"]
    assert json.loads(text)['u"1']["source_title"] == "כותרת" and "כותרת" in text and json.loads(text)["u2"]["etag"] is None
    (tmp_path / "m.json").write_text(text, encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"u": {"etag"', encoding="utf-8")
    back = files.manifest(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
    assert files.manifest(spark, str(tmp_path / "bad.json")).count() == 0 == files.manifest(spark, str(tmp_path / "none.json")).count()


def test_pages_and_documents(spark):
    heb = "שלום עולם זה מסמך ארוך מאוד " * 12
    docs = [("/d/a.pdf", heb.encode()), ("/d/b.png", ("סרוק &amp; ישן\n\nשורה\ufffd" + "\f" + "דף").encode()), ("/d/c.pdf", b"plain &lt;text&gt;"), ("/d/e.docx", "‏שלום".encode()), ("/d/f.png", b"\xffboom")]
    df = spark.createDataFrame([(p, bytearray(c), k) for k, (p, c) in enumerate(docs)], "path string, content binary, k int")

    def convert(content):
        return "md: " + content.decode()

    def words(content, dpi):
        if content.startswith(b"\xff"):
            raise ValueError("no image")
        return models.stub_words(content, dpi)

    got = {r["path"]: r for r in files.extract(df, F.col("path") == "/d/f.png", convert, models.stub_pages, words, models.stub_script).collect()}
    assert got["/d/a.pdf"]["used_ocr"] and got["/d/a.pdf"]["markdown"] == heb.strip()
    assert got["/d/b.png"]["markdown"] == "סרוק & ישן\n\nשורה\n\nדף" and got["/d/b.png"]["used_ocr"]
    assert (got["/d/c.pdf"]["markdown"], got["/d/c.pdf"]["used_ocr"]) == ("md: plain <text>", False) and got["/d/e.docx"]["markdown"] == "md: שלום"
    assert got["/d/f.png"]["markdown"] is None and got["/d/f.png"]["error"] == "no image" and len(got) == 5
    split = files.split_pages(df, lambda c: [c, c], "k").orderBy("file_no", "page_no").collect()
    assert [(r["name"], r["file_no"]) for r in split] == [("a_page1.pdf", 0), ("a_page2.pdf", 0), ("b.png", 1), ("c_page1.pdf", 2), ("c_page2.pdf", 2), ("f.png", 4)]


def test_office_files(spark, tmp_path):
    from xml.etree import ElementTree

    from quillspark.sinks import office

    def parts(content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}

    def texts(root):
        return [e.text for e in root.iter() if e.tag.endswith("}t")]

    md = "# Title\n\nfirst line\nsecond & third\n\n- item\n| a | שלום עולם |\n|---|---|\nשורה בעברית\n\n\n"
    rows = spark.createDataFrame([("d1", md), ("d2", None), ("d3", "x\x00y")], "doc string, md string").select("doc", F.posexplode(office.blocks(F.col("md"))).alias("at", "b")).select("doc", "at", "b.*")
    assert [(r["kind"], r["text"], r["is_rtl"]) for r in rows.where("doc = 'd1'").orderBy("at").collect()] == [("h1", "Title", False), ("p", "first line second & third", False), ("item", "- item", False), ("cell", "a", False), ("cell", "שלום עולם", True), ("p", "שורה בעברית", True)]
    made = {r["key"]: parts(r["content"]) for r in office.files_of(rows, "doc", ["at"], ["kind", "text", "is_rtl"], office.word_file).collect()}
    body = made["d1"]["word/document.xml"]
    assert texts(body) == ["Title", "first line second & third", "- item", "a", "שלום עולם", "שורה בעברית"] and sum(e.tag.endswith("}bidi") for e in body.iter()) == 2 and texts(made["d3"]["word/document.xml"]) == ["xy"] and "d2" not in made
    deck = parts(office.slide_file([(1, 1, "b", False), (0, 0, "T", False), (1, 0, "כותרת", True), (1, 2, "c", False)]))
    assert texts(deck["ppt/slides/slide1.xml"]) == ["T"] and texts(deck["ppt/slides/slide2.xml"]) == ["כותרת", "b", "c"] and len(deck["ppt/presentation.xml"][1]) == 2
    raws = [json.dumps({"document_type": k, "party_name": "P", "amount": a}) for k, a in (("sales", 1.5), ("sales", "x"))] + ["broken"]
    lines = ledger.ledger_rows(ledger.decode(spark.createDataFrame([(i, f"f{i}.pdf", r) for i, r in enumerate(raws)], "invoice_id int, filename string, raw string")))
    office.write_ledger_workbook(lines, str(tmp_path / "l.xlsx"))
    book = parts((tmp_path / "l.xlsx").read_bytes())
    assert [s.get("name") for s in book["xl/workbook.xml"][0]] == ["Sales", "Expenses", "Unrecognized"]
    assert texts(book["xl/worksheets/sheet2.xml"]) == list(office.LEDGER_HEADERS) and texts(book["xl/worksheets/sheet3.xml"]) == ["Filename", "f2.pdf"]
    assert [e.text for e in book["xl/worksheets/sheet1.xml"].iter() if e.tag.endswith("}v")] == ["1.5"]
    office.write_ledger_workbook(lines.where("sheet = 'Sales'"), str(tmp_path / "s.xlsx"))
    assert len(parts((tmp_path / "s.xlsx").read_bytes())["xl/workbook.xml"][0]) == 2
    office.write_files(spark.createDataFrame([("x.pdf", bytearray(b"1")), ("../y.pdf", bytearray(b"2")), ("z.pdf", None), (None, bytearray(b"3"))], "name string, content binary"), str(tmp_path / "out"))
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()) == [("x.pdf", b"1"), ("y.pdf", b"2")]


def test_workbook_goes_on_in_further_sheets(tmp_path, monkeypatch):
    from quillspark.sinks import office

    monkeypatch.setattr(office, "SHEET_ROWS", 3)
    office.write_workbook(str(tmp_path / "b.xlsx"), [("S", ("h",), [(k,) for k in range(5)]), ("E", ("h",), [])])
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert b'name="S 3"' in z.read("xl/workbook.xml") and z.read("xl/worksheets/sheet3.xml").count(b"<v>") == 1


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    files.write_store(rows, str(tmp_path / "s"))
    opened = files.open_store(spark, str(tmp_path / "s"))
    assert files.store_space(opened) == "cosine" and opened.count() == 1 and files.open_store(spark, str(tmp_path / "none")) is None
    assert tuple(files.store_health(spark, str(tmp_path), "s").first()) == (1, True, 1) and tuple(files.store_health(spark, str(tmp_path), "t").first()) == (1, False, 0)


def test_outline_is_asked_again(spark):
    said = []

    def model(messages):
        said.append(len(messages))
        return "no" if len(messages) == 1 else '{"slides": [{"heading": "H"}]}'

    asked = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    got = spark.range(1).select(models.ask_outline(asked, model).alias("a")).first()["a"]
    assert got["tries"] == 2 and got["error"] is None and outline_of(spark, got["raw"])["title"] == "Untitled Presentation"
    bad = spark.range(1).select(models.ask_outline(asked, lambda m: '{"slides": []}').alias("a")).first()["a"]
    assert bad["raw"] is None and bad["error"].startswith("Could not parse")
    broken = spark.range(1).select(models.ask_outline(asked, lambda m: 1 / 0).alias("a")).first()["a"]
    assert broken["tries"] == 1 and "division" in broken["error"]
    assert models.is_outline('```json\n{"slides": [{"bullets": ["b"]}]}\n```') and not models.is_outline("[1]") and not models.is_outline('{"slides": 3}')


def outline_of(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(outline.normalise(F.col("r")).alias("o")).first()["o"]


def test_chunks_equal_the_rule():
    from quillspark.functions.text import chunk_text, packed

    assert packed(["a" * 5, "b", "c" * 9, "d"], 7) == ["aaaaa b", "c" * 9, "d"] and packed([], 7) == []
    assert chunk_text("One two. Three four.\n\n\n\nFive.", 12) == ["One two.", "Three four.", "Five."] and chunk_text(" \n\n ", 9) == []
    assert chunk_text("aa\n\nbb", 9) == ["aa bb"]


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "a.pdf").write_bytes(b"12")
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in files.files(spark, str(tmp_path / "d")).collect()] == [("a.pdf", 2)]
    (tmp_path / "x.jsonl").write_text('{"chunk_id": "c", "text": "t"}\n\n{"chunk_id": "d"}\n')
    assert sorted((r["chunk_id"], r["text"]) for r in files.json_lines(spark, str(tmp_path / "x.jsonl")).collect()) == [("c", "t"), ("d", None)]
    (tmp_path / "y.jsonl").write_text('{"chunk_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(tmp_path / "y.jsonl")).collect()
    rows = spark.createDataFrame([(k % 7, f"p{k % 50:02d}", k) for k in range(300)] + [(1, None, 300)], "place0 int, path string, k int").repartition(5)
    got = files.in_order(rows, "path", "k").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(301)) and [(r["path"] or "", r["k"]) for r in got] == sorted((r["path"] or "", r["k"]) for r in got)
    assert files.in_order(rows.where("false"), "path").count() == 0


def test_polite_fetching(spark):
    from quillspark.sources.fetch import RateLimiter, fetch

    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    limiter = RateLimiter(2.0, lambda: now[0], sleep)
    for pause in (0.0, 0.5, 3.0):
        limiter.wait()
        now[0] += pause
    limiter.wait()
    assert slept == [2.0, 1.5]

    def get(url, headers):
        if url == "b":
            raise OSError("timeout")
        return {"status": 304 if headers else 200, "content": b"x", "etag": headers.get("If-None-Match")}

    urls = spark.createDataFrame([("a", "e", None), ("b", None, None), ("c", None, None)], "pdf_url string, if_none_match string, if_modified_since string")
    got = {r["pdf_url"]: r for r in fetch(urls, get, 0.01).collect()}
    assert got["a"]["status"] == 304 and got["a"]["etag"] == "e" and got["b"]["transport_error"] == "timeout" and got["b"]["status"] is None and bytes(got["c"]["content"]) == b"x"


def test_uploads_and_languages(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", b"2")
    df = spark.createDataFrame([("x.zip", bytearray(box.getvalue())), ("bad.zip", None), ("a.pdf", None), ("a.doc", None), (None, None)], "path string, content binary")
    assert {r["path"]: r["message"] for r in files.batch_status(df).collect()} == {"x.zip": files.NOTHING_FOUND, "bad.zip": files.BAD_ARCHIVE, "a.pdf": None, "a.doc": "Unsupported file type '.doc'. Upload a .zip or a .pdf.", None: files.NO_FILE}
    accept = models.in_language(models.stub_language)
    assert accept("one two", "he") and not accept("one two three four five six", "he") and accept("שלום " * 6, "he")
    assert models.translate_text("a b", "it", models.tagged(str.upper), accept) == ("<2IT> A B", True)


def test_batch_report(spark):
    raws = [json.dumps({"document_type": "sales", "amount": 2}), "broken", "broken"]
    got = ledger.batch_report(ledger.decode(spark.createDataFrame([(i, f"{3 - i}.pdf", r) for i, r in enumerate(raws)], "invoice_id int, filename string, raw string"))).orderBy("part", "place").collect()
    assert "\n".join(r["line"] for r in got).endswith("\n\nNot recognized (check these manually):\n- 1.pdf\n- 2.pdf") and got[0]["line"].startswith("Processed 3 page(s)/file(s): 1 sales, 0 expenses, 2 unrecognized.")
    assert ledger.batch_report(ledger.decode(spark.createDataFrame([(1, "f", raws[0])], "invoice_id int, filename string, raw string"))).count() == 1


def test_archives(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("d/b.pdf", b"1")
        z.writestr("a.txt", b"2")
        z.writestr("a.PNG", b"3")
    df = spark.createDataFrame([("x.zip", bytearray(box.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = files.archive_entries(df).collect()
    assert [r["entry"] for r in got if r["error"] is None] == ["a.PNG", "d/b.pdf"] and sum(r["error"] is not None for r in got) == 1


def test_translate_retry():
    def model(text, code):
        if len(text) > 40:
            raise ValueError
        return text.upper()

    words = " ".join(["abcde"] * 10)
    assert models.translate_text(words, "it", model) == (words.upper(), True)
    assert models.translate_text(words, "it", lambda *_: 1 / 0) == (words, False)
    assert models.translate_text("   ", "it", model) == ("   ", True) and models.translate_text(None, "it", model) == (None, True)


def test_messages(spark):
    history = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x")], "conv_id bigint, turn bigint, role string, content string")
    asked = spark.createDataFrame([(1, "why?")], "conv_id bigint, content string")
    assert [r["role"] for r in retrieval.messages(history, asked, "be brief").orderBy("part", "turn").collect()] == ["system", "assistant", "user"]


@pytest.mark.parametrize(
    ("text", "first", "zone", "instant"),
    [
        ("2023-01-25 05:40", True, "Asia/Jerusalem", "2023-01-25T03:40:00Z"), ("01/25/2023 1:05 p.m.", False, "America/New_York", "2023-01-25T18:05:00Z"), ("25/01/23 13:05", True, "Europe/Rome", "2023-01-25T12:05:00Z"),
        ("2023-W02-1T00:22:27-05:00", True, "Europe/Rome", "2023-01-09T05:22:27Z"), ("20230122T0841Z", True, "Europe/Rome", "2023-01-22T08:41:00Z"), ("1673845532078", True, "Europe/Rome", "2023-01-16T05:05:32Z"),
        ("27 בינואר 2023 בשעה 09:00:16", True, "Asia/Jerusalem", "2023-01-27T07:00:16Z"), ("‎27 mars 2023 à 10h47‏", True, "Europe/Paris", "2023-03-27T08:47:00Z"), ("08:56 CEST, 16.04.2023", True, "Europe/Paris", "2023-04-16T06:56:00Z"),
        ("2023-01-26 11:15:57 IST", True, "Asia/Kolkata", "2023-01-26T05:45:57Z"), ("2023-01-26 11:15:57 IST", True, "Asia/Jerusalem", "2023-01-26T09:15:57Z"), ("Thu, 19 Jan 2023 22:42:55 +0200", True, "Europe/Rome", "2023-01-19T20:42:55Z"),
        ("2023-03-26 02:30", True, "Europe/Rome", None), ("2023-10-29 02:30", True, "Europe/Rome", None), ("2023-10-29 02:30 CET", True, "Europe/Rome", "2023-10-29T01:30:00Z"), ("2023-01-25", True, "Europe/Rome", None),
        ("31/06/2025 11:42", True, "Europe/Rome", None), ("2023-01-25 25:00", True, "Europe/Rome", None), ("see stamp", True, "Europe/Rome", None), ("", True, "Europe/Rome", None), (None, True, "Europe/Rome", None), ("Fri, 19 Jan 2023 22:42:55 +0200", True, "Europe/Rome", None),
    ],
)
def test_timestamps(spark, text, first, zone, instant):
    rows = spark.createDataFrame([(1, text, "p", dt.datetime(2026, 1, 1))], "i int, t string, place string, at timestamp_ntz")
    places = spark.createDataFrame([("p", zone, first)], "place string, zone_name string, day_first boolean")
    found, _ = timestamps.normalise_timestamps(rows, places, "i", "t", "place", "at")
    assert [r["instant_utc"] for r in found.collect()] == ([instant] if instant else [])


def test_missing_zone_is_estimated(spark):
    start = dt.datetime(2024, 2, 1, 12)
    rows = [(k, (start + dt.timedelta(hours=7 * k)).strftime("%Y-%m-%d %H:%M:%S"), "x", start + dt.timedelta(hours=7 * k, seconds=30) + dt.timedelta(hours=5)) for k in range(20)]
    df = spark.createDataFrame(rows + rows[:2], "i int, t string, place string, at timestamp_ntz")
    places = spark.createDataFrame([("x", None, True), ("a", "America/New_York", False), ("b", "Europe/Rome", True)], "place string, zone_name string, day_first boolean")
    found, zones = timestamps.normalise_timestamps(df, places, "i", "t", "place", "at")
    assert zones.first()["zone"] == "America/New_York" and found.count() == 20


def test_histories_and_costs():
    year = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    known = timestamps.histories(int(year), int(year) + 300 * 86_400, ["Europe/Rome"])
    rome = next(h for h in known if "Europe/Rome" in h.zones)
    assert rome.zones[0] == "Europe/Rome" and "Europe/Paris" in rome.zones and "Europe/London" not in rome.zones
    rng = np.random.default_rng(0)
    for h in known:
        local = rng.integers(int(year), int(year) + 300 * 86_400, 200)
        at, skipped = h.instants(local)
        for wall, got, gap in zip(local.tolist(), at.tolist(), skipped.tolist()):
            there = dt.datetime.fromtimestamp(got, timestamps.ZoneInfo(h.zones[0]))
            assert gap or there.replace(tzinfo=dt.timezone.utc).timestamp() == wall
    costs = timestamps.delay_costs({k: 100 for k in range(40)})
    assert costs[:40].max() < 1 < costs[60] and timestamps.delay_class(np.array([0, 899, 900, 43_200, 10**9])).tolist() == [0, 0, 1, 48, 61]


def test_documented_zone_is_outweighed_by_many_rows(spark):
    start = dt.datetime(2024, 5, 1, 12)
    rows = [(k, (start + dt.timedelta(hours=5 * k)).strftime("%Y-%m-%d %H:%M:%S"), "x", start + dt.timedelta(hours=5 * k, minutes=k % 50) - dt.timedelta(hours=9)) for k in range(60)]
    df = spark.createDataFrame([*rows, (None, None, None, None), (900, "2024-05-05 10:00", None, start), (901, "2024-05-05 10:00", "y", None)], "i int, t string, place string, at timestamp_ntz")
    places = spark.createDataFrame([("x", "Europe/Rome", True), ("x", "Europe/Rome", True), ("y", "Europe/Rome", True), (None, "Europe/Rome", True)], "place string, zone_name string, day_first boolean")
    found, zones = timestamps.normalise_timestamps(df, places, "i", "t", "place", "at")
    got = {r["place"]: r for r in zones.collect()}
    assert got["x"]["declared"] == "Europe/Rome" and got["x"]["zone"] == "Asia/Tokyo" or timestamps.ZoneInfo(got["x"]["zone"]).utcoffset(start) == dt.timedelta(hours=9)
    instants = {r["i"]: r["instant_utc"] for r in found.collect()}
    assert instants[0] == "2024-05-01T03:00:00Z" and instants[901] == "2024-05-05T08:00:00Z" and 900 not in instants
    few, zones = timestamps.normalise_timestamps(df.where("i < 1"), places, "i", "t", "place", "at")
    assert zones.first()["zone"] == "Europe/Rome"  # one violation doesn't
    assert timestamps.normalise_timestamps(df.where("false"), places, "i", "t", "place", "at")[0].count() == 0


LONG = 'Eine "lange" Zeile \\ mit {Klammern},\n\u2028\u0085 ```und``` שורה שנייה; ' * 300 + "end"


def test_whole_attachments(spark, tmp_path):
    spark.createDataFrame([(1, "a.pdf", LONG), (2, "b.pdf", None), (3, None, LONG)], "file_id bigint, path string, markdown string").write.parquet(str(tmp_path / "extracted_file.parquet"))
    import base64

    got = {r["file_id"]: (r["uri"], r["block"]) for r in QUERIES["data_uris"](spark, str(tmp_path)).collect()}
    assert got == {1: ("data:application/pdf;base64," + base64.b64encode(LONG.encode()).decode(), "--- Content of a.pdf ---\n" + LONG), 2: ("data:application/pdf;base64,", "--- Content of b.pdf ---\n")}


def test_whole_translation_inputs(spark, tmp_path):
    spark.createDataFrame([(4, LONG), (5, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("italian", "it"), ("hebrew", "he")], "name string, code string").write.parquet(str(tmp_path / "language_dim.parquet"))
    got = {tuple(r) for r in QUERIES["language_lookup"](spark, str(tmp_path)).collect()}
    assert got == {(4, "it", "<2it> " + LONG, False, False), (5, "he", None, True, True)}


def test_whole_chat_context(spark, tmp_path):
    texts = {1: "x" * 61, 2: "y" * 6000, 3: LONG}
    spark.createDataFrame([(k, 0, "user", text) for k, text in texts.items()], "conv_id bigint, turn bigint, role string, content string").write.parquet(str(tmp_path / "chat_turn.parquet"))
    got = {r["conv_id"]: r["content"] for r in QUERIES["chat_messages"](spark, str(tmp_path)).where("part = 2").collect()}
    shown = texts | {3: LONG[:6000] + "\n[...truncated, file is longer...]"}
    assert got == {k: f"The user attached the following document(s):\n\n{text}\n\nUser question: What follows?" for k, text in shown.items()}


def test_whole_outlines(spark, tmp_path):
    spark.createDataFrame([(1, 0, LONG), (1, 1, None), (1, 3, LONG), (1, 4, LONG)], "conv_id bigint, turn bigint, content string").write.parquet(str(tmp_path / "chat_turn.parquet"))
    got = {r["turn"]: (r["title"], r["slides"]) for r in QUERIES["outline_normalize"](spark, str(tmp_path)).collect()}
    assert got == {0: ("Deck", f"Untitled: a;{LONG}\nH0: "), 1: ("Untitled Presentation", "Untitled: a\nH1: "), 3: (None, None), 4: (None, None)}
