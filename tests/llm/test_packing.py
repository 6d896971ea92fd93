import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sitegrid.llm import packing
from sitegrid.llm.queries import QUERIES

from .cases import frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def hold(rows, texts, tight):
    """Every piece once, ids as the tokenizer's, sequences gapless and within capacity."""
    tk = Tokenizer.from_file(PATH)
    ids = {d: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for d, t in texts.items()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        own = sorted(got[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, 2048 * i, len(x[2048 * i:2048 * i + 2048])) for i in range(-(-len(x) // 2048))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(x[r.start:r.start + r.length].tobytes()) for r in own]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= len(bins) <= least * tight + 1


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    hold(QUERIES["op9_linear_grouping"](spark, folder).collect(), texts, 1.02)


def test_awkward_rows(spark):
    texts = ["İstanbul <|endoftext|> it's", "a\x1cb c\xa0d e\x85f", "été ΣΑΣ ﬁ", "x²³ 12 don't!!! " * 900, "日本語 テキスト", "A" * 9000, None, ""]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    hold(packing.pack_documents(docs, PATH).collect(), dict(enumerate(texts)), 1.5)
    assert packing.pack_documents(frame(spark).limit(0), PATH).collect() == []
    twice = packing.pack_documents(docs.union(docs), PATH).collect()
    assert len(twice) == 2 * len(packing.pack_documents(docs, PATH).collect())
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_plan_covers_every_rank():
    r = random.Random(1)
    for counts in ({}, {1: 5}, {2048: 3}, {1025: 10}, {700: 9, 1300: 9}, {r.randint(1, 2048): r.randint(1, 3000) for _ in range(900)},
                   {n: 1 for n in range(1, 2049)}, {256: 1, 257: 100000, 1: 3}):
        ranks, bins = defaultdict(list), defaultdict(list)
        for length, lo, hi, first, offset in packing.plan(counts):
            ranks[length].append((lo, hi))
            bins[first].append((offset, length, hi - lo))
        assert set(ranks) == set(counts)
        for n, x in ranks.items():
            x.sort()
            assert x[0][0] == 0 and x[-1][1] == counts[n] and all(a[1] == b[0] for a, b in zip(x, x[1:]))
        total = 0
        for b in bins.values():
            b.sort()
            assert len({c for *_, c in b}) == 1 and all(a[0] + a[1] == c[0] for a, c in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
            total += b[0][2]
        least = -(-sum(n * c for n, c in counts.items()) // 2048)
        if len(counts) > 500:
            assert total <= 1.01 * least + sum(c for n, c in counts.items() if n > 256) / packing.GROUPS + 1, (total, least)  # what rounding can cost


def test_chunks_as_the_tokenizer():
    r = random.Random(2)
    enc, tk = packing.WordTokens(PATH), Tokenizer.from_file(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzABCéèßñ0123456789#$%&*()!@-=+<>.,;:'…–·"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(40)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), np.uint32).tolist() == tk.encode(t, add_special_tokens=False).ids
