"""Expressions on hand-made Arabic and French rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import language as L
from lectern.functions import quality as Q
from lectern.functions import references as R
from lectern.functions import text as T
from lectern.functions import unicode as U
from lectern.operators import chunking


def values(spark, expression, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_script_language(spark):
    arabic, french, short, digits = "النص القانوني رقم ستة", "le texte de loi numéro six", "abc", "123456789012"
    assert values(spark, L.script_language(F.col("x")), [arabic, french, short, digits, "aaaaaaaaaaaa", None]) == ["ar", "fr", None, None, None, None]
    assert values(spark, L.is_readable(F.col("x"), F.lit("ar")), [arabic, french]) == [True, False]
    assert values(spark, L.question_language(F.col("x")), [arabic, french]) == ["ar", "fr"]


def test_filename_language(spark):
    names = ["a/b_ar.pdf", "texte-français.pdf", "plain.pdf", "my.arabic.copy.pdf", "arfr.pdf", "x\\y_fr.PDF"]
    assert values(spark, L.filename_language(F.col("x")), names) == ["ar", "fr", None, "ar", None, "fr"]


def test_record_language(spark):
    rows = [("t", "https://h/a_ar.pdf", "https://h/"), ("t", "https://h/fr/a.pdf", ""), ("عنوان", "https://h/a.pdf", ""), ("12", "https://h/a.pdf", "https://h/ar/x"), ("12", "bad url", "x")]
    got = values(spark, L.record_language(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got == ["ar", "fr", "ar", "ar", "fr"]


def windows(text, size=800, overlap=150):
    return [x for x in (text[i : i + size].strip() for i in range(0, len(text), size - overlap)) if x]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aé \n😀ب", max_size=1500), min_size=1, max_size=6))
def test_windows(spark, texts):
    assert values(spark, chunking.windows_of(F.col("x")), texts) == [windows(t) for t in texts]


def test_window_edges(spark):
    texts = ["", " ", "a" * 800, "a" * 801, "a" * 1450, "a" * 1451]
    assert values(spark, chunking.windows_of(F.col("x")), texts) == [windows(t) for t in texts]
    with pytest.raises(ValueError):
        chunking.windows_of(F.col("x"), 10, 10)


def shortened(text, limit):
    text = " ".join(text.split())
    if len(text) <= limit:
        return text
    head = text[: limit + 1]
    end = max(head.rfind(m) for m in (". ", "؟ ", "! ", "? "))
    if end >= limit // 2:
        return head[: end + 1]
    return (head.rsplit(" ", 1)[0] if " " in head else head[:limit]) + "…"


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab. !؟?", max_size=80), min_size=1, max_size=8))
def test_truncate(spark, texts):
    assert values(spark, T.truncate_text(F.col("x"), 20), texts) == [shortened(t, 20) for t in texts]


def test_quality(spark):
    good = "Le présent texte fixe les conditions générales applicables aux marchandises importées, " * 3
    runs, filler = good + "aaaaaaaa", "=" * 20
    a, b, c, d = values(spark, Q.quality_score(F.col("x"), F.lit("fr")), [good, runs, filler, None])
    assert a > b > 0.65 and c == d == 0.0
    odd = "ؤ" * 30 + "ػ" * 3 + "ب" * 30
    assert values(spark, Q.corrupted_arabic(F.col("x"), F.lit("ar")), [odd, "ب" * 60, "abc"]) == [True, False, False]
    table = "\n".join(f"{k} 10 %" for k in range(6))
    assert values(spark, Q.looks_like_table(F.col("x"), F.lit("fr")), [table, "a\nb", None]) == [True, False, False]
    assert values(spark, Q.clean_lines(F.col("x")), ["a  b\n-----------\n\n\n\nc \x00"]) == ["a b\n\nc"]


def test_references(spark):
    asked = ["texte n° 26 de 2021", "026-2026 ?", "القرار عدد ٢٦ لسنة ٢٠٢٦", "rien", "document 7"]
    assert values(spark, R.document_number_prefix(F.col("x")), asked) == ["026_2021", "026_2026", "026_2026", None, "007_"]
    assert U.references("Le décret n° 26 de 2021, 26/2021 puis 27-2022 et 26/2021") == [("26", "2021"), ("27", "2022"), ("26", "2021")]
    cells = [(["Note", "عدد 5 لسنة 2020", "12/03/2020"], "https://h/x.pdf"), (["a"], "https://h/2021-03-04-2021-15.pdf"), ([""], "https://h/file.pdf")]
    got = values(spark, R.record_number(F.col("v"), F.col("u")), cells, "v array<string>, u string")
    assert got == ["005_2020", "015_2021", "file"]
    assert values(spark, R.record_date(F.col("v"), F.col("u")), cells, "v array<string>, u string") == ["12/03/2020", "2021-03-04", ""]


def test_answers(spark):
    raw = ['```json\n{"answer": "Oui."}\n```', 'x {"answer": "Non"} y', '{"answer": "cut off', "plain"]
    assert values(spark, R.answer_text(F.col("x")), raw) == ["Oui.", "Non", "cut off", "plain"]
    messy = "<think>hm</think>Okay so\nFinal answer: la réponse\n\nI need to go\nfin"
    assert values(spark, R.clean_answer(F.col("x")), [messy, "<think>open"]) == ["la réponse\nfin", ""]
    cited = "Oui.\nSource : texte_1.pdf، page 12."
    assert values(spark, R.cited_source(F.col("x")), [cited, "no"]) == ["texte_1.pdf", None]
    assert values(spark, R.cited_page(F.col("x")), [cited, "no"]) == [12, None]
    assert values(spark, R.strip_trailing_source(F.col("x")), ["Oui. (Source : a, page 3)", "Oui."]) == ["Oui.", "Oui."]
    assert values(spark, R.is_unavailable(F.col("x")), ["Cela n'est pas  disponible", "oui"]) == [True, False]
    chunk = "mot " * 100
    assert values(spark, R.long_copy(F.col("x"), F.lit(chunk)), ["a" + chunk, "mot " * 50]) == [True, False]


def test_decision(spark):
    from lectern.operators import evaluation

    asked = {
        "Oui, c'est prévu.": ("yes", False), "Non, rien.\nSource: a, page 1": ("no", False), "oui mais le texte n'existe pas": ("unknown", True),
        "Le délai est de dix jours": ("unknown", False), "L'information n'est pas disponible": ("no", False), "Le texte existe": ("yes", False),
        "Non, le texte existe": ("unknown", True), "Non, c'est disponible": ("no", False), "C'est disponible mais pas exigé": ("unknown", True),
        "نعم، موجود": ("yes", False), "المعلومة غير متوفرة": ("no", False), "": ("unknown", False), "Source: oui": ("unknown", False), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in asked], "answer string")
    got = {r["answer"]: (r["decision"], r["contradiction"]) for r in evaluation.decided(rows).collect()}
    assert got == asked
    told = {r[0]: r[1] for r in rows.select("answer", evaluation.unavailable_signal(F.col("answer"))).collect()}
    assert [k for k, x in told.items() if x] == ["L'information n'est pas disponible", "المعلومة غير متوفرة"]


def test_forms_by_whole_strings():
    """Character by character as on whole strings, over all characters that decompose."""
    import unicodedata

    points = [chr(k) for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000 and chr(k) not in U.FOLLOW_UP_LETTERS and chr(k) not in U.ANSWER_LETTERS]
    text = " ".join(points)
    bare = lambda x: "".join(c for c in x if not unicodedata.combining(c))
    assert text.translate(U.BARE) == bare(unicodedata.normalize("NFKD", text.casefold()))
    assert U.header("Été — ½ ﬁn") == "ete 1 2 fin" and U.follow_up("l’Été ﻯ") == "l'ete ي"


def test_normalized():
    assert U.normalized("L'Été (12) الكتاب") == "l ete كتاب"


def test_follow_ups(spark):
    form = U.follow_up_udf(F.col("x"))
    asked = ["Pourquoi ?", "Explique cela", "et aussi les taxes", "Quel est le taux de la taxe ?", "لماذا؟"]
    assert values(spark, R.is_follow_up(form), asked) == [True, True, True, False, True]


def test_small_text(spark):
    assert values(spark, T.zfill(F.col("x")), ["7", "1234"]) == ["007", "1234"]
    assert values(spark, T.safe_component(F.col("x"), 40, "document"), ['a/b: "c"', "..", None]) == ["a_b_c", "document", "document"]
    assert values(spark, T.base_name(F.col("x"), "Unknown source"), ["a\\b/c.pdf", None]) == ["c.pdf", "Unknown source"]
    assert U.canonical_url("/x.pdf#p", "http://h.tn/fr/", ("h.tn", "www.h.tn")) == "https://www.h.tn/x.pdf"


def test_forms_are_made_by_pieces():
    """Of a batch's texts only those of a piece are Python's at a time; nulls and texts longer than a piece stay in place."""
    import pyarrow as pa

    from lectern.functions.batches import PIECE_BYTES, pieces
    from lectern.functions.unicode import by_pieces

    texts = pa.array(["é" * 1000, None, "", "x" * (PIECE_BYTES + 1)] * 3 + ["É"] * 10)
    cut = list(pieces(texts))
    assert sum(n for _, n in cut) == len(texts) and len(cut) == 7
    assert by_pieces(str.upper)(texts).to_pylist() == [x and x.upper() for x in texts.to_pylist()]
    assert by_pieces(str.upper)(texts.slice(0, 0)).to_pylist() == [] and by_pieces(str.upper)(texts.slice(3, 2)).to_pylist() == [texts[3].as_py().upper(), "É" * 1000]


def test_comparison_forms_leave_by_pieces():
    from pyspark.util import PythonEvalType

    from lectern.functions import unicode as U

    assert U.normalized_whole_udf.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF and U.normalized_udf.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_dominance_takes_letters_out(spark):
    """The most frequent letter's share, each letter counted in what the ones before it left."""
    from collections import Counter

    from lectern.functions import quality as Q

    texts = ["", "12 %", "ZZz", "abcab", "ÉéÀ÷", "زززب", "xé زز", "q" * 50 + "e" * 49, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["d"] for r in rows.select("k", Q.dominance(F.col("t")).alias("d")).collect()}
    for k, t in enumerate(texts):
        letters = [x for x in (t or "").lower() if "a" <= x <= "z" or "à" <= x <= "ÿ" or "؀" <= x <= "ۿ"]
        assert got[k] == (max(Counter(letters).values()) / len(letters) if letters else 0.0)
    assert "aggregate(" in str(Q.dominance(F.col("t")))
