import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from sitegrid.llm import bpe
from sitegrid.llm.queries import QUERIES

from .cases import frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def test_table(spark):
    folder, enc = "/root/testdata/sf0.01", library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_distinct_words"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_awkward_rows(spark):
    enc = library()
    extra = ["it's  we'll x  y\x85z\x1c a᠎b​", "\U0001f600́ Ⅷ½١ xᲉy \U00010d40\U0001e5d0 ￾", "\r\n\r\n \t x   ",
             "a" * 20000, " " * 3000 + "b", "<|endoftext|>", "\x00\x00 \x00", "日本語 テキスト ไทย"]
    rows = [(300 + i, t, "en", "s", 1, "x", "y") for i, t in enumerate(extra)]
    docs = frame(spark).union(frame(spark, rows))
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes))
                 for r in bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, staged=False), PATH).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    for g, w in zip(got, want, strict=True):
        assert g == w, (g[0], w[2][:60], g[2][:60])
    assert bpe.decode(bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, staged=False), PATH).collect() == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = frame(spark).repartition(2)
    whole = {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, staged=False).collect()}
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(bpe, "MEMORY", 5000)
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN, staged=False).collect()
    assert {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows} == whole and len(rows) == docs.count()
