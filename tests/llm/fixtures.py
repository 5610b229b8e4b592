"""Small tables with the awkward rows: nulls, empty and long texts, ties, copies, clashing columns."""

import random

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "yz", "qq", str(rng.randint(0, 99))]) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (5, 40, 80, 120, 300, 900)]
    passage = sentence(rng, 60)
    line = "Read our notice on cookies and terms before you go on."
    out = [None, "", " \n\t ", "word", "two words", *base, base[2], base[2], base[3] + " tail", "lead " + base[4]]
    out += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(6)]
    out += ["\n".join([line, sentence(rng, 70), line]) for _ in range(30)]
    out += ["ab " * 400, "a" * 700, "é" * 300 + "ü" * 300, "#*$ " * 20 + "\n\nx\nx\nX", "A B C a b c A B C", base[5] * 12, "\ud7ff 😀 " + base[1], "x\x0by\x0cz\r\n" * 30, "<|endoftext|> and  two  spaces"]
    return out


DOCUMENTS = "doc_id long, text string, source string, lang string, n_chars long, block string, kept string, fp string, start string, row string, doc string, _row string, _size string, _source string, _lines string, _order string, id string"


def documents(spark):
    rows = [(k, t, None if k % 7 == 0 else f"src{k % 3}", "en", len(t or ""), *["clash"] * 12) for k, t in enumerate(texts())]
    rows += [rows[5], rows[7], (None, "row without an id", None, None, None, *["clash"] * 12)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def spans_of(n, starts, width):
    gone = [False] * n
    for s in starts:
        gone[s : s + width] = [True] * width
    return gone


def repeated_starts(sequences, width):
    """For each sequence, in order, the starts of the windows that occurred before."""
    seen, out = set(), []
    for x in sequences:
        starts = []
        for s in range(len(x) - width + 1):
            key = x[s : s + width] if isinstance(x, bytes) else tuple(x[s : s + width])
            if key in seen:
                starts.append(s)
            seen.add(key)
        out.append(starts)
    return out
