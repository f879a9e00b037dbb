"""The registered queries themselves on the small tables: against SQL, the libraries, or plain versions."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_copies_and_passages import Sets, brute_matches, plain_fingerprint

from lorekeep.llm import bpe, surrogates
from lorekeep.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    df = QUERIES[name](spark, SF)
    return df.columns, df.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cols, got = rows(spark, name)
    cursor = c.execute(ORACLES[name])
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(at) == sorted(cols)
    want = sorted((tuple(r[at[k]] for k in cols) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_op1(spark, docs):
    cols, got = rows(spark, "op1_quality_model")
    assert cols[:4] == ["doc_id", "held_out", "score", "predicted"] and {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.8 * len(held)


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(bpe.model_text())
    _, got = rows(spark, "op3_bpe")
    assert len(got) == len(docs)
    for r in got:
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        whole = tok.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())


def test_op5(spark, docs):
    _, got = rows(spark, "op5_simhash")
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    found, ids = Sets(), sorted(prints)
    for k, a in enumerate(ids):
        found.find(a)
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                found.join(a, b)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{p:016x}", found.find(i)) for i, p in prints.items()}


def test_op6(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, got = rows(spark, "op6_decontaminate")
    ids = sorted(docs)
    want = brute_matches([docs[i].encode() for i in ids], items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(ids[d], x) for d, x in want}


def test_op8(spark, docs):
    cols, got = rows(spark, "op8_surrogates")
    key = surrogates.session_key(spark)
    for r in got:
        text, found = surrogates.replaced(docs[r["doc_id"]], key)
        assert (r["text"], r["n_entities"]) == (text, len(found))
        # No detected original is left anywhere in the text.
        for kind, a, z in surrogates.mentions(docs[r["doc_id"]]):
            if z - a > 3 and kind != "name":
                assert docs[r["doc_id"]][a:z] not in r["text"]
    assert sum(r["n_entities"] > 0 for r in got) > 0 and len(got) == len(docs)


def test_op9(spark, docs):
    _, got = rows(spark, "op9_pitman_yor")
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = collections.Counter(w for i, x in tokens.items() if i not in held for w in x)
    n, v = sum(c.values()), len(c)
    sums = collections.defaultdict(lambda: [0.0, 0.0])
    for r in got:
        x = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9)
        sums[r["held_out"]][0] += r["score"]
        sums[r["held_out"]][1] += r["base_score"]
    assert len(got) == len(docs) and all(score > base for score, base in sums.values())


def test_op10(spark, docs):
    coder = bpe.Coder(bpe.model_text())
    _, got = rows(spark, "op10_token_counts")
    plain = {i: t for i, t in docs.items() if not re.search(r"<\|endoftext\|>", t)}
    assert len(got) == len(docs) and {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in plain} == dict(zip(plain, map(len, coder.encode_batch(list(plain.values()))), strict=True))
