"""Decontamination against a plain search for every window."""

import random
import re

from sitegrid.llm import contamination

from .cases import awkward, frame

ITEMS = "item_id long, text string, wid string, h long, words string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def expected(rows, items):
    wins = [(k, tuple(w[i:i + 10])) for k, w in ((k, words(t)) for k, t, *_ in items) if w for i in range(max(1, len(w) - 9))]
    out = []
    for doc_id, text, *_ in rows:
        w, hit, held = words(text), set(), set()
        for k, x in wins:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i:i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    if k is not None:
                        held.add(str(k))
        out.append((doc_id, len(w), len(hit), sorted(held), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def case():
    r = random.Random(9)
    rows = [x if x[0] != 207 else (207, " ".join(x[1].split()[:2000]), *x[2:]) for x in awkward()]
    base = [r.choice(["la", "de", "Él", "un", "ja", "x1", "ñ", "Ya"]) for _ in range(400)]
    items = []
    for k in range(30):
        i, n = r.randrange(350), r.choice([1, 4, 7, 10, 11, 30])
        items.append((k, ", ".join(base[i:i + n]), "w", 1, "x"))
    items += [(100, None, None, None, None), (101, "", "w", 1, "x"), (102, "!!!", "w", 1, "x"), (0, "not the same", "w", 1, "x"),
              (None, " ".join(base[20:31]), "w", 1, "x"), (103, items[7][1], "w", 1, "x"), (103, items[7][1], "w", 1, "x"),
              (104, "same " * 14, "w", 1, "x")]
    for i in range(50):
        j, n = r.randrange(380), r.randrange(3, 60)
        rows.append((500 + i, "Intro words. " * r.randrange(3) + " ".join(base[j:j + n]).upper().replace("É", "É"), None, "s", 1, "x", "y"))
    return rows, items


def test_windows_of_items(spark):
    rows, items = case()
    items_df = spark.createDataFrame(items, ITEMS)
    want = expected(rows, items)
    assert any(x[3] for x in want)
    assert result(contamination.decontaminate(frame(spark, rows), items_df)) == want
    # a benchmark joined in many parts gives the same
    assert result(contamination.decontaminate(frame(spark, rows), items_df, together=100)) == want


def test_long_items_only_and_empty_tables(spark):
    rows, items = case()
    long_items = [x for x in items if len(words(x[1])) >= 10]
    assert result(contamination.decontaminate(frame(spark, rows), spark.createDataFrame(long_items, ITEMS))) == expected(rows, long_items)
    none = spark.createDataFrame([], ITEMS)
    assert result(contamination.decontaminate(frame(spark, rows), none)) == expected(rows, [])
    assert contamination.decontaminate(frame(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0


def test_spans(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j k", "en", "s", 1, "x", "y")])
    row = contamination.decontaminate(docs, spark.createDataFrame([(7, "B c d e f g h i j K", "", 1, "")], ITEMS)).first()
    assert [tuple(s) for s in row.spans] == [(1, 10)] and row.n_hit == 10
