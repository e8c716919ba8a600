"""The corpus pipeline, against its stages done by brute force."""

import base64
import hashlib

import numpy as np
import pytest
from test_repeats import brute_lines  # noqa: F401  the same definition of windows
from test_rowwise import brute_marks
from test_similar import brute_kept

import corpus_pipeline
from symgraph.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows):
    """Texts without later windows; what loses all its words goes."""
    first, out = {}, []
    lines = {i: t.split("\n") for i, t in rows}
    used = {i: [k for k, x in enumerate(v) if x.strip(" \t\n\r\x0b\x0c")] for i, v in lines.items()}
    for i in sorted(lines):
        bare = [lines[i][k].strip(" \t\n\r\x0b\x0c") for k in used[i]]
        gone = set()
        for p in range(len(bare) - 2):
            if first.setdefault(tuple(bare[p : p + 3]), (i, p)) != (i, p):
                gone.update(used[i][p : p + 3])
        text = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
        if not gone or text.strip(" \t\n\r\x0b\x0c"):
            out.append((i, text))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_rows(spark):
    import public_tokenizers as P
    import tiktoken

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    table = quality.fit(docs, labels)
    rows = [r for r, s in zip(rows, quality.scores([t for _, t in rows], table)) if s >= 0.3]
    rows = without_repeats(rows)
    kept = set(brute_kept(rows))
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rows = [r for r in rows if brute_marks([r], items)[0].endswith("False)")]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_repeated_rows_are_one_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    once = sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()))
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs.unionByName(docs).unionByName(docs), SF).collect())) == once


def test_last_stage_takes_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0), (10**9 + 1, "a " * 20_000, None, "s", 40_000)], docs.schema)
    out = corpus_pipeline.byte_bpe_stage(spark, odd, SF).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1000000000", "1000000000", "1000000001", "None"]
    assert {r["n_tokens"] for r in out if r["doc_id"] != 10**9 + 1} == {0}
    assert corpus_pipeline.byte_bpe_stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_take_odd_rows_and_keep_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0), (10**9 + 1, "a " * 20_000, None, "s", 40_000)], docs.schema)
    out = corpus_pipeline.STAGES[stage][1](spark, docs.limit(20).unionByName(odd), SF)
    assert out.columns == COLUMNS and out.count() >= 1
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), SF).count() == 0
