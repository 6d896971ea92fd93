"""Small documents with every awkward case, and plain definitions to hold results against."""

import random

from tests.graphs import roots

__all__ = ["awkward", "frame", "roots"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, node string"


def awkward(seed=3, n=60):
    """Rows with nulls in any column, empty and long texts, ties, repeated rows and
    extra columns whose names clash with internal ones."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "Theta", "iota", "kappa", "λ", "mu,", "nu.", "$$$", "42"]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6)))
        rows.append((i, text, "en", f"src{i % 4}", len(text), "x", "y"))
    rows += [(200, rows[0][1], "en", None, 1, None, None), (201, rows[0][1] + " tail", None, "src0", None, "x", "y"),
             (202, None, None, None, None, None, None), (203, "", "en", "src1", 0, "x", "y"), (204, "one", "en", "src1", 3, "x", "y"),
             (205, "", "en", "src1", 0, "x", "y"), (206, "\n\n \t\n", "en", "src2", 5, "x", "y"),
             (207, " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(30000)), "en", "src2", 0, "x", "y"),
             (208, "same " * 5000, "en", "src2", 0, "x", "y"),
             (None, "no identifier here", "en", "src3", 1, "x", "y"), rows[5], rows[5]]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
