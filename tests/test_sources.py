"""Page files, tables and the crawl on hand-made rows."""

from pyspark.sql import functions as F

from lectern.operators import catalog, chunking, conversations
from lectern.sources import database, files, html, pages

GOOD = "Le présent texte fixe les délais de dépôt des demandes et les conditions de prorogation, article 12, alinéa 3, pour les opérateurs agréés, les mandataires et les transporteurs."


class Second:
    name = "pdfplumber"

    def __init__(self):
        self.opened = []

    def pages(self, content):
        return [x.decode().replace("#", " mots de plus ") + GOOD for x in content.split(b"\f")]


class Images(pages.PlainImages):
    def read(self, image, layout):
        if image.startswith(b"boom"):
            raise RuntimeError("no reader")
        return f"{GOOD} {layout}"


def test_load_pages(spark):
    rows = [("/raw/fr/a.txt", f"{GOOD}\fx".encode()), ("/raw/fr/b.txt", b"\xff\xfe"), ("/raw/fr/c.txt", b""), ("/raw/fr/d.txt", b"boom\fok")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(2)
    found, failed = pages.load_pages(df, pages.PlainText())
    assert {(r["path"], r["page"], r["method"]) for r in found.collect()} == {("/raw/fr/a.txt", 1, "pymupdf"), ("/raw/fr/a.txt", 2, "pymupdf"), ("/raw/fr/d.txt", 1, "pymupdf"), ("/raw/fr/d.txt", 2, "pymupdf")}
    assert [(r["path"], r["error"].split(":")[0]) for r in failed.collect()] == [("/raw/fr/b.txt", "UnicodeDecodeError")]
    more, _ = pages.load_pages(df, pages.PlainText(), Second())
    assert {(r["path"], r["page"]): r["method"] for r in more.collect()} == {("/raw/fr/a.txt", 1): "pymupdf", ("/raw/fr/a.txt", 2): "pdfplumber", ("/raw/fr/c.txt", 1): "pdfplumber", ("/raw/fr/d.txt", 1): "pdfplumber", ("/raw/fr/d.txt", 2): "pdfplumber"}
    seen, _ = pages.load_pages(df, pages.PlainText(), None, Images(), Images())
    told = {(r["path"], r["page"]): r["method"] for r in seen.collect()}
    assert told[("/raw/fr/a.txt", 1)] == "pymupdf" and told[("/raw/fr/a.txt", 2)] == "ocr_psm_3" and told[("/raw/fr/d.txt", 1)] == "pymupdf"
    chunks = chunking.split_pages(found.withColumn("relative_path", F.col("path")))
    outcomes = pages.file_outcomes(df, found, failed, chunks.withColumnRenamed("path", "p").withColumn("path", F.col("p")))
    s = pages.ingestion_summary(outcomes).first()
    assert tuple(s) == (4, 2, 4, 2)
    wrong = {r["path"]: r["error"] for r in outcomes.where("error is not null").collect()}
    assert set(wrong) == {"/raw/fr/b.txt", "/raw/fr/c.txt"} and wrong["/raw/fr/b.txt"].startswith("UnicodeDecodeError") and wrong["/raw/fr/c.txt"] == "no usable text"
    empty, _ = pages.load_pages(df.limit(0), pages.PlainText())
    assert empty.count() == 0


def test_folders(spark, tmp_path):
    new = [str(tmp_path / "a" / "b"), str(tmp_path)]
    assert files.ensure_folders(spark, *new) == new[:1] and files.ensure_folders(spark, *new) == []


def test_command_line(sf_dir, tmp_path, capsys):
    from lectern import __main__ as cli

    cli.main(["list"])
    assert "ret1_search" in capsys.readouterr().out.split()
    cli.main(["run", "fil6_question_selection", "--tables", sf_dir, "--limit", "3"])
    assert len(capsys.readouterr().out.splitlines()) == 3
    cli.main(["run", "src10_collection_count", "--tables", sf_dir, "--out", str(tmp_path / "out")])
    assert [x for x in (tmp_path / "out").iterdir() if x.suffix == ".json"]


def test_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lectern_test")
    try:
        assert database.read_table(spark, None, "users") is None and database.read_table(spark, "", "users") is None
        spark.sql("CREATE TABLE lectern_test.users (id string, email string) USING parquet")
        assert database.create_tables(spark, "lectern_test") == ["users", "chat_sessions", "chat_messages"]
        assert database.create_tables(spark, "lectern_test") == []
        database.append(spark.createDataFrame([("1", "a@b.c", True)], "id string, email string, is_admin boolean"), "lectern_test.users")
        row = spark.table("lectern_test.users").first()
        assert (row["email"], row["is_admin"], row["full_name"]) == ("a@b.c", True, None)
    finally:
        spark.sql("DROP DATABASE lectern_test CASCADE")


def test_users_and_sessions(spark):
    columns = "id string, email string, full_name string, hashed_password string, is_active boolean, is_admin boolean, created_at timestamp"
    have = spark.createDataFrame([("1", "a@b.c", None, "h", False, True, None)], columns)
    new = spark.createDataFrame([("2", " A@B.c", "x", "h", None, False, None), ("4", "D@e.f", " Y ", "h", None, False, None), ("3", "d@E.f", "z", "h", None, False, None)], columns)
    users = {r["id"]: r for r in conversations.create_users(have, new).collect()}
    assert sorted(users) == ["1", "3"] and users["3"]["email"] == "d@e.f" and users["3"]["is_active"] is True and users["1"]["is_active"] is False
    s = spark.createDataFrame([(1, None), (2, 5)], "id int, user_id int")
    ask = lambda i, u: conversations.session_for_user(s, i, u).count()
    assert (ask(1, None), ask(1, 5), ask(2, 5), ask(2, None), ask(3, 5)) == (1, 0, 1, 0, 0)


def test_crawl(spark):
    links = {"a": "cb", "b": "da", "c": "xe", "d": "f", "e": "", "f": "g", "g": ""}
    rows = [(u, v) for u, vs in links.items() for v in vs]
    table = spark.createDataFrame(rows, "page_url string, link string")
    have = spark.createDataFrame([(u,) for u in links], "url string")  # x cannot be fetched
    order = lambda n: [r["url"] for r in catalog.crawl(have, table, "a", n).orderBy("place").collect()]
    assert order(20) == ["a", "b", "c", "d", "e", "f", "g"] and order(4) == ["a", "b", "c", "d"] and order(1) == ["a"]
    assert catalog.crawl(have, table, "zz").count() == 0


def test_page_trees():
    tree = html.Tree("</b>" * 20000 + "<div>" * 50 + "<p>x</i></div>y")
    assert tree.root.text() == "x y"
    host = ("h.org",)
    found = list(html.rows_of("<ul><li>Avis <a href='/a/b.pdf?x=1'>PDF</a></li></ul><a href='/c.d.pdf?y'>télécharger</a>", "http://h.org/", host))
    assert [(v, u) for v, _, u in found] == [(["Avis PDF"], "https://h.org/a/b.pdf?x=1"), (["c.d"], "https://h.org/c.d.pdf?y")]


def test_paths_and_filters(spark):
    df = spark.createDataFrame([(" ", 1), ("raw/x", 2), ("/data/raw/y", 3), ("s3://b/z", 4)], "p string, n int")
    got = df.select(files.full_path(F.col("p"), "/data").alias("f"), files.relative_to(files.full_path(F.col("p"), "/data"), "/data").alias("r")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("/data/raw/x", "raw/x"), ("/data/raw/y", "raw/y"), ("s3://b/z", "s3://b/z")]
    assert files.safe_where(df, "n > 1").count() == 3 and files.safe_where(df, "missing = 1").count() == 0


def test_counters_come_from_the_pass_that_writes(spark, tmp_path):
    rows = [("abc", True, False, "fr"), ("de", None, True, "ar"), (None, False, True, "fr")]
    df = spark.createDataFrame(rows, "document string, readable boolean, ocr_used boolean, language string")
    told = pages.write_counted(df, str(tmp_path / "chunks"), partition_by="language")
    assert told == {"chunks": 3, "characters": 5, "unreadable": 1, "recognised": 2}
    assert spark.read.parquet(str(tmp_path / "chunks")).where("language = 'fr'").count() == 2
    assert pages.write_counted(df.limit(0).select("document"), str(tmp_path / "none")) == {"chunks": 0, "characters": 0}


def test_trees_go_at_once():
    """No element outlives its page, though elements and their parents hold each other."""
    import gc

    from lectern.sources import html

    page = "<table><tr><th>Date</th></tr><tr><td>1</td><td><a href='/a.pdf'>x</a></td></tr></table><li><a href='/b.pdf'>y</a>" + "<div>" * 5000
    gc.collect()
    gc.disable()
    try:
        assert [r[2] for r in html.rows_of(page, "https://h.org/p", ("h.org",))] == ["https://h.org/a.pdf", "https://h.org/b.pdf"]
        assert not any(isinstance(x, html.Element) for x in gc.get_objects())
    finally:
        gc.enable()


def test_anchors_are_those_of_the_tree():
    from lectern.sources import html

    page = "<A HREF='/1'>x<a href=/2 href=/3>y</p><a/><a name=z><a href='&amp;4'/><script><a href='/5'></script><!-- <a href=/6> --><table><a href=/7"
    assert html.Anchors(page).found == [a.attributes.get("href") for a in html.Tree(page).root.all("a")] and len(html.Anchors(page).found) > 4


def test_pages_leave_by_pieces(spark):
    """Files go through Arrow batches that Python takes apart, not through whole batches of rows."""
    import contextlib
    import io

    from lectern.sources import pages

    files = spark.createDataFrame([("a", bytearray(b"x\x0cy")), ("b", bytearray(b"\xff")), ("c", None)], "path string, content binary")
    rows = pages.extract(files, pages.PlainText())
    assert sorted((r["path"], r["page"], r["text"], (r["error"] or "").partition(":")[0]) for r in rows.collect() if r["page"]) == [("a", 1, "x", ""), ("a", 2, "y", "")]
    assert sorted((r["path"], r["error"].partition(":")[0]) for r in rows.where("page is null").collect()) == [("b", "UnicodeDecodeError"), ("c", "TypeError")]
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        rows.explain()
    assert "MapInArrow" in shown.getvalue()
