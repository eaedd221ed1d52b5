import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from baraza.functions import identity, urls
from baraza.operators.numbered import numbered
from baraza.plans import answers, conversations, corpus, links, maintenance, moderation, quality, retrieval, stats
from baraza.sources import documents, tables

NOW = dt.datetime(2026, 1, 1)
FILL = " filler text long enough to count"


def ago(days):
    return NOW - dt.timedelta(days=days)


# ---- corpus -----------------------------------------------------------------------------------
def _pages(spark, rows):
    return spark.createDataFrame(rows, "source string, page int, text string")


def test_chunk_ids_and_overlap(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = _pages(spark, [("nakuru_audit_report.pdf", 12, words), ("b", 1, "   "), ("b", 2, "one two")])
    got = {r["chunk_id"]: r["text"].split() for r in corpus.chunk_pages(df, 10, 3).collect()}
    assert got["nakuru_audit_report_p12_c0"][-3:] == got["nakuru_audit_report_p12_c1"][:3]
    assert "b_p2_c0" in got and not any(k.startswith("b_p1") for k in got)


def test_chunk_numbers_run_over_a_source(spark):
    df = _pages(spark, [("a", p, "x " * n) for p, n in ((1, 25), (2, 3), (5, 12))])
    got = corpus.chunk_pages_numbered(df, 10, 0).orderBy("page", "chunk_no").collect()
    assert [r["chunk_index"] for r in got] == list(range(6))
    assert [r["chunk_no"] for r in got] == [0, 1, 2, 0, 0, 1]


def test_county_section(spark):
    rows = [("d", 1, "Cover page of a consolidated report"), ("d", 2, "COUNTY EXECUTIVE OF NAKURU – NO.32\n" + FILL),
            ("d", 3, "continuation" + FILL), ("d", 4, "COUNTY EXECUTIVE OF NANDI – NO.29\n" + FILL), ("d", 5, "tiny"),
            ("plain", 1, "no headings here at all" + FILL), ("nandi", 1, "COUNTY EXECUTIVE OF NANDI – NO.29\n" + FILL)]
    got = {(r["source"], r["page"]) for r in corpus.county_pages(_pages(spark, rows), "nakuru").collect()}
    assert got == {("d", 2), ("d", 3), ("plain", 1)}
    changes = [(r["page"], r["section"]) for r in corpus.section_changes(_pages(spark, rows)).where("source = 'd'").orderBy("page").collect()]
    assert changes == [(2, "Nakuru"), (4, "Nandi")]


def test_build_chunks_outcomes(spark):
    pages = _pages(spark, [("ok", 1, "COUNTY EXECUTIVE OF NAKURU\n" + "word " * 30), ("scan", 1, " "),
                           ("other", 1, "COUNTY EXECUTIVE OF NANDI\n" + "word " * 30)])
    known = spark.createDataFrame([(1, "ok", "executive", "nakuru"), (2, "scan", "executive", "nakuru"), (3, "other", "executive", "nakuru")],
                                  "id long, title string, government_arm string, county string")
    chunks, outcomes = corpus.build_chunks(pages, known, "nakuru", size=10, overlap=2)
    assert chunks.count() == 4 and {r["source_id"] for r in chunks.collect()} == {1}
    assert {r["source_id"]: r["status"] for r in outcomes.collect()} == {1: "completed", 2: "failed", 3: "failed"}


def test_text_layer(spark):
    """The first pages are told by their place in the source, whatever they are called."""
    rows = [("a", 10 * i, " ") for i in range(5)] + [("a", 60, "x" * 50), ("b", 2, "y" * 20), ("c", 900, " "), ("c", 901, "z" * 20)]
    pages = _pages(spark, rows).select("source", "page", documents.trimmed_length(F.col("text")).alias("n_chars"))
    got = {r["source"]: r["has_text"] for r in documents.text_layer(numbered(pages, ["source"], ["page"], "number", ranges=3)).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_the_screen_holds_back_scans_with_late_text(spark):
    rows = [("scan", i, " ") for i in range(1, 6)] + [("scan", 6, "word " * 30), ("ok", 7, " "), ("ok", 9, "word " * 30)]
    known = spark.createDataFrame([(1, "ok", "executive", "nakuru"), (2, "scan", "executive", "nakuru")], "id long, title string, government_arm string, county string")
    chunks, outcomes = corpus.build_chunks(_pages(spark, rows), known, "nakuru", size=10, overlap=0)
    assert sorted((r.source_id, r.page_number, r.chunk_index) for r in chunks.collect()) == [(1, 9, 0), (1, 9, 1), (1, 9, 2)]
    assert {r.source_id: (r.error or "")[:13] for r in outcomes.collect()} == {1: "", 2: "no text layer"}


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"<html>error</html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF" + b"x" * 100)
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_binary_documents(spark, str(tmp_path), max_bytes=50).collect()}
    import hashlib

    assert got["a.pdf"]["ok"] and got["a.pdf"]["content_hash"] == hashlib.sha256(b"%PDF-1.7 body").hexdigest()
    assert got["b.pdf"]["error"] == "not a PDF" and got["c.pdf"]["error"] == "exceeds maximum size"


def _chunk_rows(spark, source, n):
    return spark.createDataFrame([(source, 1, i, f"t{i}") for i in range(n)], "source_id long, page_number int, chunk_index int, chunk_text string")


def _stored_counts(spark, path):
    return {r["source_id"]: r["count"] for r in documents.read_chunks(spark, path).groupBy("source_id").count().collect()}


def test_chunk_sink_replaces_only_given_sources(spark, tmp_path):
    path = str(tmp_path / "chunks")
    with pytest.raises(ValueError, match="nothing has been stored"):
        documents.read_chunks(spark, path)
    documents.replace_chunks(_chunk_rows(spark, 1, 5).union(_chunk_rows(spark, 2, 4)), path)
    documents.replace_chunks(_chunk_rows(spark, 1, 2), path)
    assert _stored_counts(spark, path) == {1: 2, 2: 4}
    documents.replace_chunks(_chunk_rows(spark, 3, 1), path, spark.createDataFrame([(2,), (9,)], "source_id long"))
    assert _stored_counts(spark, path) == {1: 2, 3: 1}
    documents.compact_chunks(spark, path)
    assert _stored_counts(spark, path) == {1: 2, 3: 1}
    documents.replace_chunks(_chunk_rows(spark, 2, 7), path)
    assert _stored_counts(spark, path) == {1: 2, 2: 7, 3: 1}


def test_a_replacement_is_seen_when_it_is_entered(spark, tmp_path):
    path = str(tmp_path / "chunks")
    documents.replace_chunks(_chunk_rows(spark, 1, 5), path)
    _chunk_rows(spark, 1, 1).write.parquet(f"{path}/part-1/chunks")  # a run that broke off
    assert _stored_counts(spark, path) == {1: 5}
    documents.replace_chunks(_chunk_rows(spark, 1, 3), path)
    assert _stored_counts(spark, path) == {1: 3}


def test_sink_files_follow_the_rows_not_the_sources(spark, tmp_path):
    """Many small sources and one large one: few files, and the large source in more than one."""
    path = str(tmp_path / "chunks")
    rows = spark.range(120_000).select(F.when(F.col("id") < 100_000, F.col("id")).otherwise(-1).alias("source_id"), F.lit(1).alias("page_number"),
                                       F.col("id").alias("chunk_index"), F.sha2(F.col("id").cast("string"), 512).alias("chunk_text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        documents.replace_chunks(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    stored = documents.read_chunks(spark, path)
    files = stored.select("source_id", F.input_file_name().alias("f")).distinct()
    assert stored.count() == 120_000 and files.select("f").distinct().count() < 60
    assert files.where("source_id = -1").count() > 1


def test_seed_if_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h", NOW, NOW)], "id long, hashed_wa_id string, created_at timestamp, last_active_at timestamp")
    assert tables.seed_if_empty(spark, rows, str(tmp_path), "users")
    assert not tables.seed_if_empty(spark, rows, str(tmp_path), "users")
    assert tables.read_table(spark, str(tmp_path), "users").count() == 1


# ---- identities and URLs ----------------------------------------------------------------------
@pytest.mark.parametrize("secret", [b"s", b"k" * 64, b"longer" * 20])
def test_pseudonym(one, secret):
    import hashlib
    import hmac

    values = ["+254700000001", "", "é"]
    assert one(lambda c: identity.pseudonym(c, secret), values) == [hmac.new(secret, v.encode(), hashlib.sha256).hexdigest() for v in values]


def test_canonical_number(one):
    assert one(identity.canonical_number, [" whatsapp:+2547 ", "2547", "+2547", "", None]) == ["+2547", "+2547", "+2547", "", ""]


def test_incoming_posts_meet_in_one_identity(spark):
    posts = spark.createDataFrame([(1, "2547", None, "hi", None, None), (2, None, "whatsapp:+2547", "hi", None, None),
                                   (3, None, None, None, "+2547", "hi"), (4, None, None, None, "", "hi"), (5, "2547", None, "", None, None)],
                                  "id int, WaId string, From string, Body string, from_number string, text string")
    got = conversations.incoming(posts, b"s").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3] and len({r["hashed_wa_id"] for r in got}) == 1


def test_url_screen(one):
    bad = ["http://127.0.0.1/x", "http://localhost/x", "http://169.254.169.254/latest", "http://10.1.2.3", "https://192.168.0.1:8443/a",
           "http://172.20.0.1/", "ftp://example.org/a", "file:///etc/passwd", "http://user@127.0.0.1/"]
    assert all(one(urls.url_error, bad))
    assert one(urls.url_error, ["https://example.org/a.pdf", "http://8.8.8.8/", "http://172.32.0.1/"]) == [None, None, None]


def test_resolve_matches_the_standard_rules(spark):
    from urllib.parse import urljoin

    cases = [(b, h) for b in ("https://x.org/a/b/c.html?q=1#f", "https://x.org", "http://x.org/dir/") for h in (
        "d.pdf", "/d.pdf", "../d.pdf", "./d.pdf", "../../../d.pdf", "//cdn.org/d.pdf", "https://o.org/e", "?p=2", "/a/../b.pdf", "e/f/../g", "..", "/x//y.pdf", "mailto2/z?x=/../y")]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(cases)], "i int, b string, h string").orderBy("i")
    got = [r[0] for r in df.select(urls.resolve(F.col("b"), F.col("h"))).collect()]
    assert dict(zip(cases, got)) == {c: urljoin(*c) for c in cases}


def test_url_parts(one):
    assert one(urls.handle, ["https://r.org/handle/123/9?x=1", "https://r.org/x"]) == ["123/9", None]
    assert one(urls.origin, "https://r.org:80/handle/1") == "https://r.org:80"


# ---- links ------------------------------------------------------------------------------------
def _html(spark, body, url="https://oag.example.org/reports/"):
    return spark.createDataFrame([(1, url, body)], "page_id long, url string, html string")


def test_page_links(spark):
    body = ("<!-- <a href='x.pdf'>no</a> --><a href='/docs/a.pdf'>Audit <b>A</b></a><a href=\"b.pdf\"></a>"
            "<A HREF='https://oag.example.org/docs/a.pdf'>again</A><a href='#top'>t</a><a href='mailto:x'>m</a><a href='javascript:x'>j</a>"
            "<a href='page.html'>Page &amp; more</a><a name='n'>none</a><a href='C.PDF'>C</a>")
    got = [(r["title"], r["url"], r["is_pdf"]) for r in links.page_links(_html(spark, body)).orderBy("pos").collect()]
    root = "https://oag.example.org"
    assert got == [("Audit A", f"{root}/docs/a.pdf", True), ("b.pdf", f"{root}/reports/b.pdf", True),
                   ("Page & more", f"{root}/reports/page.html", False), ("C", f"{root}/reports/C.PDF", True)]


def test_onclick_links(spark):
    body = ("<h3>Before</h3><a href='#' onclick=\"location.href='/d?wpdmdl=1'\">Download</a><h3>First <i>Half</i></h3>"
            "<a href='#' onclick=\"location.href='/d?wpdmdl=2'\">Download</a>")
    page = _html(spark, body)
    got = [(r["title"], r["url"]) for r in links.onclick_links(page).orderBy("pos").collect()]
    assert got == [("First Half", "https://oag.example.org/d?wpdmdl=1"), ("First Half", "https://oag.example.org/d?wpdmdl=2")]
    assert links.page_classes(page).first()["page_class"] == "onclick_downloads"


def test_page_classes(spark):
    pages = spark.createDataFrame([(1, "u", "<ds-app></ds-app>"), (2, "u", "<a href='a.pdf'>a</a>"), (3, "u", "<a href='a'>a</a>"), (4, "u", "x")],
                                  "page_id long, url string, html string")
    assert [r["page_class"] for r in links.page_classes(pages).orderBy("page_id").collect()] == [
        "repository_shell", "direct_pdf", "two_level", "nothing"]


def _sources(spark, *rows):
    return spark.createDataFrame([(i, "u", *r) for i, r in enumerate(rows)], "source_id long, listing_url string, title string, government_arm string, report_type string")


def _links(spark, *rows):
    return spark.createDataFrame([(1, "u", i, t, u, True) for i, (t, u) in enumerate(rows)],
                                 "page_id long, page_url string, pos int, title string, url string, is_pdf boolean")


def test_best_link(spark):
    found = _links(spark, ("Download", "https://x/GREEN-BOOK-ASSEMBLIES-2023.pdf"), ("Download", "https://x/GREEN-BOOK-EXECUTIVES-2023.pdf"),
                   ("BIRR First Quarter", "https://x/birr-first-quarter.pdf"), ("BIRR First Half", "https://x/birr-first-half.pdf"),
                   ("BIRR", "https://x/birr-first-nine-months.pdf"))
    wanted = _sources(spark, ("Audit Nakuru County Executive 2023", "executive", "audit_report"), ("Audit Nakuru County Assembly 2023", "assembly", "audit_report"),
                      ("Governments BIRR First Half", "consolidated", "birr"), ("Governments BIRR First Nine Months", "consolidated", "birr"),
                      ("zzz", "revenue", "exchequer"))
    got = {r["source_id"]: r for r in links.best_link(wanted, found).collect()}
    assert got[0]["link_url"].endswith("EXECUTIVES-2023.pdf") and got[1]["link_url"].endswith("ASSEMBLIES-2023.pdf")
    assert got[2]["link_url"].endswith("first-half.pdf") and got[3]["link_url"].endswith("nine-months.pdf")
    assert links.best_link(_sources(spark, ("zzz", "revenue", "exchequer")), _links(spark, ("a", "b"))).first()["error"] == "no_match"
    assert links.best_link(wanted, found.limit(0)).where("error = 'no_links'").count() == 5


def test_a_listing_of_many_sources_is_split(spark):
    """Parts of a hot listing meet all its links; nothing is lost or doubled."""
    found = _links(spark, *[(f"report {i}", f"https://x/{i}.pdf") for i in range(7)])
    wanted = _sources(spark, *[(f"report {i % 9}", "executive", "audit_report") for i in range(40)])
    whole, split = (sorted((r.source_id, r.link_url, r.score) for r in links.scored_links(wanted, found, fan).collect()) for fan in (1024, 3))
    assert whole == split and len(whole) == 280


def test_two_level_listing(spark):
    pages = spark.createDataFrame([(1, "https://r.org/list", "<a href='/i/1'>Budget Review 2023</a><a href='/i/2'>Budget Review 2024</a>"),
                                   (2, "https://r.org/i/2", "<a href='/f/2024.pdf'>file</a>"), (3, "https://r.org/i/1", "<a href='/f/2023.pdf'>file</a>")],
                                  "page_id long, url string, html string")
    wanted = spark.createDataFrame([(5, "https://r.org/list", "Budget Review 2024", "executive", "cbrop"), (6, "https://none", "x", "executive", "cbrop")],
                                   "source_id long, listing_url string, title string, government_arm string, report_type string")
    got = {r["source_id"]: (r["link_url"], r["error"]) for r in links.resolve_listings(wanted, pages).collect()}
    assert got == {5: ("https://r.org/f/2024.pdf", None), 6: (None, "listing_not_found")}


# ---- answers and routing ----------------------------------------------------------------------
HIT = "array<struct<rank:int,id:long,source_id:long,source_title:string,page_number:int,government_arm:string,chunk_text:string,similarity:double,lexical_rank:double>>"


def _hit(rank, title="Report", text="passage"):
    return (rank, rank, 7, title, rank + 10, "executive", text, 0.5, None)


def test_finish_answers(spark):
    raw = spark.createDataFrame([(1, "It cost 5.\nSource: x, page 1\nUSED_CHUNK: 2, 1"), (2, "Jibu la swali ni hili.\nUSED_CHUNK: none"),
                                 (3, "No marker"), (4, "Out\nUSED_CHUNK: 9"), (5, "pesa za kaunti\nUSED_CHUNK: 1"), (6, "empty")],
                                "query_id long, raw_text string")
    hits = spark.createDataFrame([(i, [_hit(1, None if i == 3 else "R1"), _hit(2, "R2")]) for i in range(1, 6)], f"query_id long, hits {HIT}")
    got = {r["query_id"]: r for r in answers.finish_answers(raw, hits).collect()}
    assert (got[1]["text"], got[1]["citation"]) == ("It cost 5.", "R2, page 12")
    assert got[1]["reply"].endswith("Source: R2, page 12") and got[5]["reply"].endswith("Chanzo: R1, page 11")
    assert [got[i]["citation"] for i in (2, 3, 4, 6)] == ["N/A", "source 7, page 11", "N/A", "N/A"]
    assert len(json.loads(got[1]["retrieved_chunks"])) == 2 and got[6]["retrieved_chunks"] is None


def test_prompt_and_anchor(spark):
    shape = f"q string, h array<struct<role:string,text:string>>, hits {HIT}"
    df = spark.createDataFrame([("how much did it cost?", [("user", "Molo bridge?"), ("assistant", "a")], [_hit(1)]),
                                ("a long question with well over five words", [("user", "x")], []), ("short one", [], []),
                                ("short one", [("assistant", "a")], [])], shape)
    got = [r[0] for r in df.select(retrieval.anchored_query(F.col("q"), F.col("h"))).collect()]
    assert got == ["Molo bridge? how much did it cost?", "a long question with well over five words", "short one", "short one"]
    prompt = df.select(retrieval.grounded_prompt(F.col("h"), F.col("hits"), F.col("q"))).first()[0]
    assert prompt == ("CONVERSATION SO FAR:\nuser: Molo bridge?\nassistant: a\n\nCONTEXT:\n[1] Source chunk (page 11):\npassage\n\n"
                      "<QUESTION>\nhow much did it cost?\n</QUESTION>")


def test_plan_responses(spark):
    vocabulary = ["stalled", "bridge", "construction", "molo", "county", "road", "budget", "water", "payments"]

    def embed(df):
        return df.withColumn("vector", F.array(*[F.lower("text").contains(w).cast("double") for w in vocabulary]))

    base = spark.createDataFrame([(1, 1, 3, "executive", "stalled bridge construction in molo"), (2, 1, 4, "executive", "county road budget allocation"),
                                  (3, 1, 5, "assembly", "water project payments")], "id long, source_id long, page_number int, government_arm string, text string")
    chunks = embed(base).withColumnRenamed("vector", "embedding").withColumnRenamed("text", "chunk_text")
    known = spark.createDataFrame([(1, "Audit")], "id long, title string")
    asked = spark.createDataFrame([(1, "molo bridge construction", []), (2, "is it worth the price", []), (3, "zzz qqq", []),
                                   (4, "MOLO  bridge construction", []), (5, "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp", [])],
                                  "query_id long, text string, history array<struct<role:string,text:string>>")
    got = {r["query_id"]: r for r in retrieval.plan_responses(asked, chunks, known, embed).collect()}
    assert got[1]["route"] == "generate" and got[1]["hits"][0]["id"] == 1 and "molo" in got[1]["prompt"]
    assert [h["id"] for h in got[4]["hits"]] == [h["id"] for h in got[1]["hits"]]
    assert got[2]["prompt"].startswith("[1] ") and len(got[2]["hits"]) == 3
    assert got[2]["route"] == "value_for_money" and got[3]["route"] == "clarify" and got[5]["route"] == "generate"
    assert "<QUESTION>\n" in got[3]["prompt"] and got[3]["prompt"].endswith("\n</SNIPPETS>") and "CONTEXT:\n" in got[3]["fallback_prompt"]


def test_hit_limit_equals_a_shallower_search(spark):
    from baraza.catalog import hash_embed

    texts = [f"{a} {b} {c}" for a in ("road", "water", "school") for b in ("budget", "audit") for c in ("nakuru", "njoro", "meru")]
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    chunks = hash_embed(base).withColumnRenamed("vector", "embedding").withColumnRenamed("text", "chunk_text")
    asked = spark.createDataFrame([(1, "road budget ya njoro"), (2, "maji audit meru")], "query_id long, text string")
    shallow = retrieval.hybrid_hits(asked, chunks, hash_embed, 3)
    limited = retrieval.hybrid_hits(asked.withColumn("hit_limit", F.lit(3)), chunks, hash_embed, 8)
    columns = ["query_id", "id", "rank", "score"]
    assert sorted(map(tuple, shallow.select(*columns).collect())) == sorted(map(tuple, limited.select(*columns).collect()))


# ---- conversations ----------------------------------------------------------------------------
def _talk(spark, rows):
    return spark.createDataFrame([(i, s, r, t) for i, (s, r, t) in enumerate(rows)], "id long, session_id long, role string, text string")


def test_report_dialogue(spark):
    rows = [(1, "user", "ripoti"), (1, "user", "q1"), (1, "assistant", "a"), (1, "user", "si  KWELI"), (1, "user", "wrong figure"), (1, "user", "q2"),
            (1, "user", "report"), (1, "user", "report"), (1, "assistant", "b"), (1, "user", "because"), (2, "user", "q")]
    got = [(r["action"], r["target_message_id"]) for r in conversations.report_labels(_talk(spark, rows)).orderBy("id").collect()]
    assert got == [("no_answer", None), ("question", None), ("prompt_reason", None), ("file_reason", 2), ("question", None),
                   ("prompt_reason", None), ("prompt_reason", None), ("file_reason", 2), ("question", None)]


def test_session_browser(spark):
    sessions = spark.createDataFrame([(1, 1, True, ago(5)), (2, 1, False, ago(4)), (3, 2, True, ago(3))], "id long, user_id long, is_active boolean, created_at timestamp")
    messages = spark.createDataFrame([(1, 1, ago(2)), (2, 1, ago(1)), (3, 2, ago(1.5))], "id long, session_id long, created_at timestamp")
    got = conversations.session_page(sessions, messages).collect()
    assert [(r["id"], r["message_count"]) for r in got] == [(1, 2), (2, 1), (3, 0)]
    assert got[2]["last_message_at"] == ago(3)
    assert {r["user_id"]: r["session_id"] for r in conversations.active_sessions(sessions).collect()} == {1: 1, 2: 3}


# ---- moderation, quality, maintenance ---------------------------------------------------------
DISPUTE = ("id long, message_id long, reported_by_user_id long, reason string, status string, report_count long, flagged_for_review boolean, "
           "reviewed_by string, reviewed_at timestamp, resolution_note string, escalation_report string, created_at timestamp")


def _dispute(i, message, status="pending_review", days=1):
    return (i, message, i, f"r{i}", status, 2, False, None, None, None, None, ago(days))


def _answers(spark):
    return spark.createDataFrame([(10, "assistant", "a" * 600, "R, page 1", [("T", 1, "executive", "p")], 1, ago(9)), (11, "user", "q", None, None, 1, ago(9))],
                                 "id long, role string, text string, citation string, retrieved_chunks array<struct<source_title:string,page_number:int,"
                                 "government_arm:string,chunk_text:string>>, session_id long, created_at timestamp")


def test_queue_groups_by_answer(spark):
    df = spark.createDataFrame([_dispute(1, 10, days=5), _dispute(2, 10, days=1), _dispute(3, 11, "escalated", days=2)], DISPUTE)
    got = moderation.dispute_page(df).collect()
    assert [(r["message_id"], r["id"]) for r in got] == [(10, 1), (11, 3)] and got[0]["last_reported_at"] == ago(1)
    counts = moderation.dispute_status_counts(df).first()
    assert (counts["total"], counts["pending_review"], counts["escalated"], counts["resolved_valid"]) == (2, 1, 1, 0)


def test_decisions(spark):
    df = spark.createDataFrame([_dispute(1, 10, "under_review"), _dispute(2, 10, "under_review"), _dispute(3, 11), _dispute(4, 12, "resolved_valid")], DISPUTE)
    decisions = spark.createDataFrame([(1, "escalated", "see", None, "auditor"), (3, "resolved_valid", None, None, None), (4, "resolved_valid", None, "fix", None),
                                       (99, "under_review", None, None, None)],
                                      "dispute_id long, new_status string, resolution_note string, correction_message string, recipient string")
    after, outcome = moderation.apply_decisions(df, decisions, _answers(spark), F.lit(NOW))
    rows = {r["id"]: r for r in after.collect()}
    assert rows[1]["status"] == rows[2]["status"] == "escalated" and rows[1]["escalation_report"] == rows[2]["escalation_report"]
    record = json.loads(rows[1]["escalation_report"])
    assert record["recipient"] == "auditor" and len(record["content"]["disputed_answer"]) == 500
    assert record["content"]["retrieved_passages"][0]["chunk_text"] == "p" and record["content"]["moderator_note"] == "see"
    assert rows[3]["status"] == "pending_review"
    assert {r["dispute_id"]: r["error"] for r in outcome.collect()} == {1: None, 3: "invalid_transition", 4: None, 99: "not_found"}


def test_ratings(spark):
    ratings = spark.createDataFrame([(10, 5, True, "formal_swahili"), (10, 6, True, "sheng"), (10, 3, True, "klingon"), (11, 3, True, "sheng"), (99, 3, True, "sheng")],
                                    "message_id long, tone_score int, grounded boolean, register string")
    checked = quality.check_ratings(ratings, _answers(spark))
    assert sorted(r["reject_reason"] or "" for r in checked.collect()) == ["", "message_not_found", "not_an_answer", "tone_out_of_range", "unknown_register"]
    got = quality.validation_stats(checked.where("accepted"), _answers(spark)).first()
    assert (got["total_validations"], got["average_tone"], got["grounded_pct"], got["register_formal_swahili"], got["pending_review"]) == (1, 5.0, 100.0, 1, 0)
    empty = quality.validation_stats(ratings.limit(0), _answers(spark)).first()
    assert (empty["total_validations"], empty["average_tone"], empty["grounded_pct"], empty["pending_review"]) == (0, None, None, 1)


def test_retention(spark):
    messages = spark.createDataFrame([(1, ago(10)), (2, ago(100)), (3, ago(100)), (4, ago(100))], "id long, created_at timestamp")
    disputes = spark.createDataFrame([(1, 2, ago(30)), (2, 3, ago(400))], "id long, message_id long, created_at timestamp")
    kept, left, report = maintenance.retain(messages, disputes, F.lit(NOW))
    row = report.first()
    assert (row["disputes_deleted"], row["messages_deleted"]) == (1, 2)
    assert {r["id"] for r in kept.collect()} == {1, 2} and left.count() == 1
    again = maintenance.retain(kept, left, F.lit(NOW))[2].first()
    assert (again["disputes_deleted"], again["messages_deleted"]) == (0, 0)


SOURCE = ("id long, url string, title string, publisher string, government_arm string, county string, report_type string, fiscal_year string, "
          "last_scraped_at timestamp, ingestion_status string, ingestion_error string, created_at timestamp")


def _registry(spark):
    return spark.createDataFrame([(i, "u", f"t{i}", "p", "executive", "nakuru", "birr", "2024", ago(1), s, None, ago(9)) for i, s in enumerate(
        ["completed", "in_progress", "failed"])], SOURCE)


def test_edits_deletes_and_upserts(spark):
    chunks = spark.createDataFrame([(0,), (0,), (1,), (2,)], "source_id long")
    edits = spark.createDataFrame([(0, "new", None, None), (2, "u", "renamed", None)], "id long, url string, title string, government_arm string")
    after, left = maintenance.edit_sources(_registry(spark), chunks, edits)
    rows = {r["id"]: r for r in after.collect()}
    assert rows[0]["ingestion_status"] == "pending" and rows[0]["last_scraped_at"] is None and rows[2]["title"] == "renamed"
    assert rows[2]["ingestion_status"] == "failed" and sorted(r[0] for r in left.collect()) == [1, 2]
    kept, kept_chunks, outcome = maintenance.delete_sources(_registry(spark), chunks, spark.createDataFrame([(0,), (1,), (9,)], "id long"))
    assert {r["id"]: (r["outcome"], r["chunks_deleted"]) for r in outcome.collect()} == {0: ("deleted", 2), 1: ("in_progress", 0), 9: ("not_found", 0)}
    assert {r["id"] for r in kept.collect()} == {1, 2} and kept_chunks.count() == 2
    incoming = spark.createDataFrame([("u", "t0", "q"), ("u", "fresh", "q")], "url string, title string, publisher string")
    merged = {r["title"]: r for r in maintenance.upsert_sources(_registry(spark), incoming, F.lit(NOW)).collect()}
    assert len(merged) == 4 and merged["t0"]["publisher"] == "q" and merged["fresh"]["ingestion_status"] == "pending"


def test_empty_overview(spark):
    e = _registry(spark).withColumn("published_at", F.col("created_at")).limit(0)
    none = spark.createDataFrame([], "id long, role string, created_at timestamp")
    row = stats.overview(e, none, none, none, spark.createDataFrame([], DISPUTE), F.lit(NOW)).first()
    assert row["total_sources"] == 0 and row["sources_failed"] == 0 and row["disputes_escalated"] == 0 and row["queries_today"] == 0


def test_repeated_changes_change_rows_once(spark):
    chunks = spark.createDataFrame([(0,), (1,), (2,)], "source_id long")
    edits = spark.createDataFrame([(0, "first", 1), (0, "last", 2), (2, "only", 1)], "id long, title string, seq int")
    after, _ = maintenance.edit_sources(_registry(spark), chunks, edits, "seq")
    assert sorted((r["id"], r["title"]) for r in after.collect()) == [(0, "last"), (1, "t1"), (2, "only")]
    incoming = spark.createDataFrame([("u", "t0", "q", 1), ("u", "t0", "r", 2), ("u", "n", "q", 1), ("u", "n", "z", 0)], "url string, title string, publisher string, seq int")
    merged = sorted((r["title"], r["publisher"]) for r in maintenance.upsert_sources(_registry(spark), incoming, F.lit(NOW), sequence="seq").collect())
    assert merged == [("n", "q"), ("t0", "r"), ("t1", "p"), ("t2", "p")]
    hashed = _registry(spark).withColumn("content_hash", F.lit(None).cast("string"))
    outcomes = spark.createDataFrame([(0, "failed", "x", "h", 1), (0, "completed", None, "i", 2)], "source_id long, status string, error string, content_hash string, seq int")
    rolled = maintenance.roll_up_outcomes(hashed, outcomes, F.lit(NOW), "seq").collect()
    assert len(rolled) == 3 and {r["id"]: r["content_hash"] for r in rolled}[0] == "i"


def test_any_query_id_and_null_vectors(spark):
    from baraza.catalog import hash_embed

    base = spark.createDataFrame([(i, t) for i, t in enumerate(["road budget", "water audit", "school budget"])], "id long, text string")
    chunks = hash_embed(base).withColumnRenamed("vector", "embedding").withColumnRenamed("text", "chunk_text")
    chunks = chunks.withColumn("embedding", F.when(F.col("id") != 1, F.col("embedding")))
    asked = spark.createDataFrame([(-5, "road budget"), (-6, "school budget"), (2 ** 62, "road budget")], "query_id long, text string")
    got = retrieval.hybrid_hits(asked, chunks, hash_embed, 2, lexical=False).collect()
    assert {r["query_id"] for r in got} == {-5, -6, 2 ** 62} and all(r["id"] != 1 for r in got)


def test_stems_widen_the_lexical_list(spark):
    from baraza.catalog import hash_embed

    base = spark.createDataFrame([(0, "the project stalls"), (1, "hospital stall"), (2, "other words")], "id long, text string")
    chunks = hash_embed(base).withColumnRenamed("vector", "embedding").withColumnRenamed("text", "chunk_text")
    stems = spark.createDataFrame([(w, "stall") for w in ("stalled", "stalls", "stall")], "term string, stem string")
    asked = spark.createDataFrame([(1, "stalled project")], "query_id long, text string")
    given = {"plain": {"stem": None}, "stored": {"stems": stems}, "default": {}}
    found = {s: {r["id"] for r in retrieval.hybrid_hits(asked, chunks, hash_embed, 3, **o).where("lexical_rank > 0").collect()} for s, o in given.items()}
    assert found == {"plain": {0}, "stored": {0, 1}, "default": {0, 1}}


def test_chunks_bring_their_stems(spark):
    """Stems beside the chunks give the hits that a dictionary gives; terms at hand give the vectors that the text gives."""
    from baraza.catalog import hash_embed, stand_in_stems
    from baraza.functions import text as tx
    from baraza.plans import retrieval

    base = spark.createDataFrame([(1, "county roads stalled in Njoro", "a"), (2, "roadside works", "a"), (3, "the of", "b"), (3, "roads roads", "b")],
                                 "id long, text string, government_arm string")
    chunks = hash_embed(base).withColumnRenamed("vector", "embedding").withColumnRenamed("text", "chunk_text")
    told = hash_embed(base.withColumn("terms", tx.lexical_terms(F.col("text"))), F.col("terms"))
    assert sorted(map(tuple, told.select("id", "vector").collect())) == sorted(map(tuple, chunks.select("id", "embedding").collect()))
    asked = spark.createDataFrame([(7, "roads stalling", "a"), (8, "roads", "b"), (9, "of", None)], "query_id long, text string, scope string")
    terms = chunks.withColumn("terms", tx.lexical_terms(F.col("chunk_text")))
    stemmed = terms.withColumn("stemmed", F.transform("terms", lambda t: F.left(t, F.lit(5)))).drop("terms")
    found = [sorted(map(tuple, retrieval.hybrid_hits(asked, c, hash_embed, 3, scope=True, stem=stand_in_stems).collect())) for c in (terms, stemmed)]
    assert found[0] == found[1] and any(r[-1] for r in found[0])
