"""Operators on small tables, against plain Python or by hand."""

import datetime
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, chunking, conversations, evaluation, report, retrieval
from lectern.sources import files, html


def test_select_context(spark):
    def run(rows, k=2, expand=False):
        made = [(1, f"c{n}", s, p, d, n, expand) for n, (s, p, d) in enumerate(rows, 1)]
        df = spark.createDataFrame(made, "question_id int, id string, source string, page int, distance double, rank int, expand boolean")
        return [r["id"] for r in retrieval.select_context(df, k=k).orderBy("place").collect()]

    assert run([("a", 1, 0.1), ("b", 1, 0.119)]) == ["c1", "c2"]
    assert run([("a", 1, 0.1), ("b", 1, 0.12)]) == ["c1"]
    assert run([("a", 1, 0.1), ("a", 2, 0.1), ("b", 1, 0.1), ("a", 3, 0.2), ("a", 9, 0.2)]) == ["c1", "c2", "c4"]
    assert run([("a", 1, 0.1), ("a", 5, 0.1), ("a", 6, 0.2)]) == ["c1", "c2"]
    assert run([("a", 1, 0.1), ("a", 5, 0.1), ("a", 6, 0.2)], expand=True) == ["c1", "c2", "c3"]
    assert run([("a", 1, 0.1)]) == ["c1"]


def test_search_routes_and_fallback(spark):
    rows = [(1, [1.0, 0.0], "026_2021_fr.pdf", 1, "fr", True), (2, [0.9, 0.1], "x_fr.pdf", 1, "fr", None), (3, [0.0, 1.0], "y_ar.pdf", 1, "ar", True), (4, [1.0, 0.0], "z_fr.pdf", 1, "fr", False)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, source string, page int, language string, readable boolean").withColumn("chunk", F.lit(0)).withColumn("content", F.lit("t"))
    asked = [(10, [0.0, 1.0], "fr", "026_", False), (11, [0.0, 1.0], "fr", None, False), (12, [1.0, 0.0], "fr", "zzz", False)]
    questions = spark.createDataFrame(asked, "question_id int, query array<double>, question_language string, prefix string, expand boolean")
    got = {}
    for r in retrieval.search(chunks, questions).orderBy("question_id", "place").collect():
        got.setdefault(r["question_id"], []).append(r["id"])
    assert got[10] == [1]  # routed by number, and nothing else
    assert 3 in got[11]  # weak in French, so the Arabic document comes in
    assert got[12][0] == 1 and 4 not in got[12]  # unknown number: general search, unreadable left out


def test_context_budget(spark):
    rows = [(1, k, "word " * 600, f"s{k}", k, "fr", True) for k in range(1, 5)]
    df = spark.createDataFrame(rows, "question_id int, place int, content string, source string, page int, language string, readable boolean")
    r = retrieval.format_context(df).first()
    assert r["chars"] == len(r["context"]) <= 5001 and r["context"].startswith("[Document 1]\nSource: s1\nPage: 1\nLanguage: fr\nReadable: True\nExcerpt: word")
    assert r["chunks"] == 3


def test_candidates(spark):
    rows = [("p", 0, "a", "text", 0.5, False), ("p", 1, "b", "text", 0.5, False), ("p", 2, "c", "longer text", 0.9, True), ("q", 0, "a", " ", 0.9, False)]
    df = spark.createDataFrame(rows, "k string, ordinal int, method string, text string, score double, corrupted boolean")
    assert [tuple(r) for r in chunking.best_candidate(df, ["k"]).select("k", "method").collect()] == [("p", "a")]
    good = "Le texte est lisible et assez long pour être bon, avec des mots différents partout. " * 3
    steps = [("p", "pymupdf", "x"), ("p", "ocr_psm_3", good), ("r", "pymupdf", good), ("r", "pdfplumber", good + good)]
    scored = chunking.candidate_scores(spark.createDataFrame(steps, "k string, method string, text string").withColumn("language", F.lit("fr")))
    assert sorted(tuple(r) for r in chunking.cascade(scored, ["k"]).select("k", "method").collect()) == [("p", "ocr_psm_3"), ("r", "pymupdf")]


def test_catalog(spark):
    rows = [("u1", "h1", 1, "fr"), ("u1", "h9", 2, "fr"), ("u2", "h1", 3, "ar"), ("u3", "h3", 4, "ar"), ("u4", "h4", 5, "fr")]
    df = spark.createDataFrame(rows, "pdf_url string, content_sha256 string, ordinal int, language string")
    known = spark.createDataFrame([("u3",)], "pdf_url string"), spark.createDataFrame([("h4",)], "content_sha256 string")
    done = catalog.actions(df, *known)
    assert {r["pdf_url"]: r["action"] for r in done.collect()} == {"u1": "download", "u2": "duplicate_hash", "u3": "skip_url", "u4": "duplicate_hash"}
    assert catalog.counters(done).first()["duplicate_hash"] == 2
    names = [("a.pdf", "1" * 64, 1), ("a.pdf", "2" * 64, 2), ("a.pdf", "2" * 64, 3), ("a.pdf", "1" * 64, 4)]
    got = catalog.unique_names(spark.createDataFrame(names, "n string, h string, o int"), "n", "h", "o").orderBy("o").collect()
    assert [r["destination"] for r in got] == ["a.pdf", "a_22222222.pdf", "a_22222222_2.pdf", "a_11111111.pdf"]


def test_one_name_for_a_third_of_all_rows(spark):
    rows = [("a.pdf" if k % 3 == 0 else f"n{k % 50}", f"{k % 7}" * 64, k) for k in range(900)] + [(None, "x" * 64, 1000), (None, "x" * 64, 1001)]
    got = catalog.unique_names(spark.createDataFrame(rows, "n string, h string, o long").repartition(4), "n", "h", "o")
    expected, seen, marks = {}, set(), {}
    for n, h, o in rows:
        if n not in seen:
            seen.add(n)
            expected[o] = n
            continue
        m = marks[n, h] = marks.get((n, h), 0) + 1
        if n is not None:
            stem, dot, tail = n.partition(".")
            expected[o] = f"{stem}_{h[:8]}" + (f"_{m}" if m > 1 else "") + dot + tail
        else:
            expected[o] = None
    assert {r["o"]: r["destination"] for r in got.collect()} == expected
    assert catalog.unique_names(spark.createDataFrame([], "n string, h string, o long"), "n", "h", "o").count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "Quel est le taux ?"), (1, 1, "assistant", "Dix.\n\nSource : a.pdf, page 1"), (1, 2, "user", "Pourquoi ?"), (1, 3, "user", "Explique cela"), (2, 0, "user", "Pourquoi ?"), (1, 4, "user", "Explique cela document 12")]
    out = conversations.rewritten_questions(spark.createDataFrame(rows, "s int, o int, role string, text string"), "s", "o")
    got = {(r["s"], r["o"]): r["rewritten"] for r in out.collect()}
    expected = "\nQuestion précédente concernée : Quel est le taux ?\nContexte précédent : Dix."
    assert got == {(1, 0): "Quel est le taux ?", (1, 2): "Pourquoi ?" + expected, (1, 3): "Explique cela" + expected, (2, 0): "Pourquoi ?", (1, 4): "Explique cela document 12"}
    cases = spark.createDataFrame([(None, None, 1), (1, None, 1), (1, None, None), (1, 1, 1), (1, 1, 2), (1, 1, None)], "i int, o int, u int")
    access = [r[0] for r in cases.select(conversations.access(F.col("i"), F.col("o"), F.col("u"))).collect()]
    assert access == ["not_found", "claimed", "granted", "granted", "forbidden", "forbidden"]
    t = datetime.datetime(2020, 1, 1)
    sessions = spark.createDataFrame([(1, t), (2, t)], "id int, updated_at timestamp")
    messages = spark.createDataFrame([(1, t + datetime.timedelta(1))], "session_id int, created_at timestamp")
    assert [r["id"] for r in conversations.recency(sessions, messages).collect()] == [1, 2]
    new = spark.createDataFrame([(2, t), (7, t)], "session_id int, created_at timestamp")
    assert conversations.append_message(messages, sessions, new).count() == 2


def test_evaluation(spark):
    q = spark.createDataFrame([(1, ["a"], [2]), (2, [], []), (3, ["zz"], [])], "question_id int, documents array<string>, pages array<int>")
    r = spark.createDataFrame([(1, 1, "b", 1), (1, 2, "xa", 2), (1, 4, "a", 2), (3, 1, "b", 1)], "question_id int, rank int, source string, page int")
    m = {x["question_id"]: x for x in evaluation.retrieval_metrics(q, r).collect()}
    assert (m[1]["document_rank"], m[1]["document_hit_at_1"], m[1]["document_hit_at_3"], m[1]["document_mrr"], m[1]["page_recall_at_k"]) == (2, False, True, 0.5, 1.0)
    assert m[2]["document_mrr"] is None and m[3]["document_mrr"] == 0.0 and m[3]["page_mrr"] is None
    facts = spark.createDataFrame([(1, "Le délai est de dix jours", ["dix jours", "vingt jours"])], "k int, t string, f array<string>")
    x = evaluation.fact_matches(facts, "t", "f", ["k"]).first()
    assert (x["facts"], x["matched"], x["ratio"]) == (2, 1, 0.5)
    needed = spark.range(0, 12).select(evaluation.facts_needed(F.col("id"), F.lit(None))).collect()
    assert [r[0] for r in needed] == [max(1, (n * 7 + 9) // 10) for n in range(12)]
    signal = spark.createDataFrame([(1, "Cela n'est pas disponible"), (2, "Oui"), (3, "Oui\nSource: non disponible"), (4, None)], "k int, a string")
    told = signal.select("k", evaluation.unavailable_signal(F.col("a")).alias("u"))
    assert {r["k"]: r["u"] for r in told.collect()} == {1: True, 2: False, 3: False, 4: None}
    failed = spark.createDataFrame([("e", None, None)], "error string, citation_honest boolean, hallucination_risk string")
    assert tuple(evaluation.with_error_defaults(failed).first())[1:] == (False, "high")


def test_report(spark):
    rows = [("a", 1, True, True, 0.9, "fr"), ("a", 1, False, None, 0.9, None), ("b", 1, False, False, 0.2, "ar")]
    df = spark.createDataFrame(rows, "source string, page int, ocr_used boolean, readable boolean, extraction_quality double, language string")
    assert [(r["source"], r["ocr_ratio"]) for r in report.risk_documents(df).collect()] == [("a", 0.5), ("b", 0.0)]
    t = report.totals(df).first()
    assert (t["total_chunks"], t["unreadable_chunks"], t["corrupted_chunks"], t["low_quality_chunks"]) == (3, 1, None, 1)
    assert {r["language"]: r["chunks"] for r in report.counters(df, "language").collect()} == {"fr": 1, "unknown": 1, "ar": 1}
    every = {(r["field"], r["value"]): r["chunks"] for r in report.all_counters(df, ["language", "source", "readable"]).collect()}
    assert every == {("language", "fr"): 1, ("language", "unknown"): 1, ("language", "ar"): 1, ("source", "a"): 2, ("source", "b"): 1, ("readable", "true"): 1, ("readable", "unknown"): 1, ("readable", "false"): 1}


PAGE = """<html><body><table><tr><th>Numero du texte</th><th>Objet</th><th>Date</th></tr>
<tr><td>7</td><td>Un objet assez long</td><td>01/02/2020</td><td><a href="/fr/a.pdf#x">PDF</a></td></tr></table>
<ul><li>Note <a href="b_ar.PDF">Download</a></li><li><a href="https://other.org/c.pdf">c</a></li><li><a href="/fr/a.pdf">again</a></li></ul>
<a href="/fr/theme-2/">t</a></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("http://h.tn/fr/theme-1/", PAGE), (None, None)], "url string, html string")
    got = {r["pdf_url"]: r for r in html.records(pages, ("h.tn",)).collect()}
    assert set(got) == {"https://h.tn/fr/a.pdf", "https://h.tn/fr/theme-1/b_ar.PDF"}
    a, b = got["https://h.tn/fr/a.pdf"], got["https://h.tn/fr/theme-1/b_ar.PDF"]
    assert (a["document_number"], a["title"], a["date"], a["language"]) == ("7", "Un objet assez long", "01/02/2020", "fr")
    assert b["title"] == "Note Download" and b["language"] == "ar"
    assert [r["link"] for r in html.relevant_links(pages, "theme", ("h.tn",)).collect()] == ["https://h.tn/fr/theme-2/"]


def test_file_hashes_of_any_size(spark, tmp_path):
    """A file beyond the 2 GB of a cell (sparse on disk), an odd name and a copy."""
    with open(tmp_path / "large.bin", "wb") as f:
        f.write(b"start")
        f.truncate((2 << 30) + 5)
    (tmp_path / "s ub").mkdir()
    for name in ("a%20é+#.bin", "s ub/copy.bin"):
        (tmp_path / name).write_bytes(b"x\n")
    got = {r["content_sha256"]: (r["path"], r["files"]) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    with open(tmp_path / "large.bin", "rb") as f:
        large = hashlib.file_digest(f, "sha256").hexdigest()
    paths = {large: ("large.bin", 1), hashlib.sha256(b"x\n").hexdigest(): ("a%20é+#.bin", 2)}
    assert got == {h: (f"file:{tmp_path}/{name}", n) for h, (name, n) in paths.items()}


def test_file_hashes_by_lines(spark, tmp_path, monkeypatch):
    """What is too large for a cell in a store that only Spark reads: beginnings and ends of all kinds, cut into splits."""
    monkeypatch.setattr(files, "is_local", lambda *_: False)
    monkeypatch.setattr(files, "CELL_BYTES", 2)
    mark, body = b"\xef\xbb\xbf", bytes(range(256)) * 40
    contents = [b"x\n", b"\n\n\n", b"abc", b"abc\n", mark + b"abc", mark + b"abc\n", mark + b"\n", mark + mark, b"\r\n\r\n", body, body + b"\n", mark + body, b"\n" + body, b"a" * 5000, body]
    (tmp_path / "s ub").mkdir()
    for k, content in enumerate(contents):
        (tmp_path / "s ub" / f"{k:02}%20é+#.bin").write_bytes(content)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = {r["content_sha256"]: (r["path"].rpartition("/")[2], r["files"]) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {hashlib.sha256(c).hexdigest(): (f"{contents.index(c):02}%20é+#.bin", contents.count(c)) for c in contents}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.gz").write_bytes(gzip.compress(body))
    with pytest.raises(Exception, match="bytes in its lines"):
        files.file_hashes(spark, str(tmp_path / "t")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = files.scan_files(spark, str(tmp_path), content=True)
    assert sorted(r["relative_path"] for r in found.collect()) == ["b.pdf", "sub/a.PDF"]
    assert found.where(files.is_pdf(F.col("content"))).count() == 2
    assert files.file_hashes(spark, str(tmp_path), "*.[pP][dD][fF]").first()["files"] == 2
    rows = [("1", "d", "t,\"x\"", "fr", "u1", "p", "/r/a.pdf", "h", "s"), ("2", "d", "t2", "fr", "u1", "p", "/r/a.pdf", "h", "s"), ("3", "d", "t", "fr", "", "p", "", "h", "s")]
    files.write_metadata(spark.createDataFrame(rows, files.METADATA).coalesce(1), str(tmp_path / "meta"))
    back = files.read_metadata(spark, str(tmp_path / "meta"))
    assert back.count() == 3 and files.metadata_by_url(back).count() == 1
    assert [(r["relative_path"], r["document_number"]) for r in files.metadata_by_path(back, "/r").collect()] == [("a.pdf", "2")]
    (tmp_path / "q.json").write_text('[{"id": "q1", "expected_facts": ["x"], "answer_available": true}]')
    assert files.read_questions(spark, str(tmp_path / "q.json")).first()["expected_facts"] == ["x"]
    chunks = spark.createDataFrame([("a", "fr"), ("b", "ar")], "id string, language string")
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).where("language = 'fr'").count() == 1
    assert files.with_columns(chunks, files.METADATA).columns[2:] == [c for c in files.METADATA_FIELDS if c != "language"]


def test_facts_are_found_by_keys(spark):
    """The same pairs as the rule on every pair of a fact and a text, in one pass and in several."""
    import contextlib
    import io
    import itertools
    import random

    from lectern.functions.unicode import normalized_udf

    rng = random.Random(7)
    words = ["a", "ba", "cat", "scat", "cats", "dix", "jours", "10", "%", "é", "يجب", "إيداع", "الملف", "خلال", "عشرة", "أيام", "x-y", "€"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(100, None), (101, "")]
    facts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for k in range(80)]
    facts += [(200, None), (201, " "), (202, "€"), (203, "a cat"), (204, "cat"), (205, "DIX Jours"), (206, "10%"), (207, "يجب إيداع الملف خلال أيام عشرة")]
    t = spark.createDataFrame(texts, "tid long, text string").repartition(3)
    f = spark.createDataFrame(facts, "fid long, fact string")
    norm_t = {r[0]: r[1] for r in t.select("tid", normalized_udf("text")).collect()}
    norm_f = {r[0]: r[1] for r in f.select("fid", normalized_udf("fact")).collect()}
    pairs = [(a, b, norm_t[b], norm_f[a]) for a, b in itertools.product(norm_f, norm_t) if norm_f[a] and norm_t[b] is not None]
    both = spark.createDataFrame(pairs, "fid long, tid long, t string, p string")
    expected = sorted((r["fid"], r["tid"]) for r in both.where(evaluation.present(F.col("t"), F.col("p"))).collect())
    assert len(expected) > 200
    for limit in (evaluation.BROADCAST_FACTS, 20):
        got = evaluation.fact_texts(f, t, "fid", "fact", "tid", "text", limit)
        assert sorted(map(tuple, got.collect())) == expected
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        got.explain("formatted")
    assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()
    assert evaluation.fact_texts(f, t.limit(0), "fid", "fact", "tid", "text").count() == 0


def test_texts_are_normalised_once_to_find_facts(spark):
    import contextlib
    import io

    t = spark.createDataFrame([(1, "un texte")], "tid long, text string")
    f = spark.createDataFrame([(1, "texte")], "fid long, fact string")
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        evaluation.fact_texts(f, t, "fid", "fact", "tid", "text").explain()
    assert shown.getvalue().count("MapInArrow") == 1 and "Window" not in shown.getvalue()
    assert all("fact" in x for x in shown.getvalue().splitlines() if "EvalPython" in x)


def test_columns_are_normalised_in_one_worker(spark):
    import contextlib
    import io

    rows = spark.createDataFrame([(1, "L’Élève", "ÇA va"), (2, None, "x y")], "id long, t string, own string")
    forms = evaluation.normalized_columns(rows, "t", "own").where("own like '% %'")
    assert sorted(map(tuple, forms.collect())) == [(1, "l eleve", "ca va"), (2, None, "x y")]
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        forms.explain()
    assert "EvalPython" not in shown.getvalue()


def test_selected_questions(spark):
    import pytest

    q = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, t string")
    assert [r["id"] for r in evaluation.selected(q, "id", limit=2).collect()] == [1, 2] and evaluation.selected(q, "id").count() == 3
    assert [r["id"] for r in evaluation.selected(q, "id", wanted=3, limit=1).collect()] == [3]
    with pytest.raises(ValueError, match="9"):
        evaluation.selected(q, "id", wanted=9)
