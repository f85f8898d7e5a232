"""Fingerprints, sharding and personal data: SQL functions only, held against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelab.llm import fingerprints as fp
from sievelab.llm import pii, sharding
from sievelab.llm.common import bucket_of


def no_python(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# fingerprints


def expected_edits(rows):
    ordered = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    out = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 1_000])
def test_edited_texts(make_docs, odd_rows, rows_per_bucket):
    got = fp.fingerprint_documents(make_docs(odd_rows), rows_per_bucket=rows_per_bucket).collect()
    found = sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    assert found == sorted(expected_edits(odd_rows))


def test_single_document_follows_itself(make_docs):
    (row,) = fp.fingerprint_documents(make_docs([(1, "ab cd ef gh")])).collect()
    assert row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"ab cd ab cd"[:6] + b"ab cd").hexdigest()


def test_empty_table(make_docs):
    assert fp.fingerprint_documents(make_docs([])).count() == 0


def test_equal_texts_have_equal_fingerprints(make_docs, odd_rows):
    df = fp.fingerprint_documents(make_docs(odd_rows))
    assert no_python(df)
    got = {(r["doc_id"], r["n_chars"]): r for r in df.collect()}
    same = len(dict(odd_rows)[3])
    assert got[3, same]["fingerprint"] == got[4, same]["fingerprint"] == got[None, same]["fingerprint"] != ""
    assert got[1, 0]["fingerprint"] == "" and got[1, 0]["near_edited"] == 1.0


def test_estimates_follow_true_likeness(spark):
    rng = random.Random(0)
    pool = [f"w{i}" for i in range(4_000)]
    rows, truth = [], []
    for share in (0.0, 0.1, 0.3, 0.5, 0.8, 0.95, 1.0):
        a = [rng.choice(pool) for _ in range(1_500)]
        cut = int(len(a) * share)
        b = a[:cut] + [rng.choice(pool) for _ in range(len(a) - cut)]
        shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        truth.append((len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]), len(shingles[0]), len(shingles[0] & shingles[1]) / len(shingles[0])))
        rows.append((len(rows), " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, F.col("a"), "x"), F.col("b"), "y")
    got = df.select(
        "id", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.distinct_count(F.col("x")).alias("n"), fp.containment(F.col("x"), F.col("y")).alias("c")
    ).orderBy("id").collect()
    for r, (j, n, c) in zip(got, truth, strict=True):
        assert abs(r["j"] - j) < 0.16 and abs(r["n"] / n - 1) < 0.35 and abs(r["c"] - c) < 0.3


def test_merging_parts_equals_sketch_of_whole(spark):
    rng = random.Random(1)
    hashes = [(g, [rng.randrange(-(2**63), 2**63) for _ in range(300)]) for g in ["a", "a", "a", None, "b"]]
    rows = [(g, sorted(h)[: fp.K]) for g, h in hashes] + [("c", [])]
    df = spark.createDataFrame(rows, "g string, sk array<bigint>")
    got = {r["g"]: r["sk"] for r in fp.merge_sketches(df, ["g"], "sk").collect()}
    union = {g: sorted(x for k, h in hashes if k == g for x in h)[: fp.K] for g in ("a", None, "b")}
    assert got == union | {"c": []}


def test_bucket_of(spark):
    cuts = sorted(random.Random(2).sample(range(1000), 37))
    df = spark.range(1000).where(F.col("id") >= cuts[0])
    for r in df.select("id", bucket_of(F.col("id"), cuts).alias("b")).collect():
        assert cuts[r["b"]] <= r["id"] and (r["b"] + 1 == len(cuts) or r["id"] < cuts[r["b"] + 1])


# sharding


@pytest.mark.parametrize("rows_per_block", [3, 1_000])
def test_shards_are_exact_and_gapless(make_docs, odd_rows, rows_per_block):
    docs = make_docs(odd_rows)
    got = sharding.shuffle_to_shards(docs.select("doc_id", "text", "shard"), 4, rows_per_block=rows_per_block)
    rows = got.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(i), str(t)) for i, t in odd_rows)
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharded_documents(make_docs, odd_rows):
    df = sharding.shard_documents(make_docs(odd_rows))
    assert no_python(df)
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in df.collect())
    assert got == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sharding.shard_documents(make_docs([])).count() == 0


def test_sharding_repeats_and_changes_with_the_seed(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id").repartition(5)
    run = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_to_shards(df.sort("doc_id"), 7, seed).collect()}
    assert run(1) == run(1) != run(2)


def test_neighbours_are_spread_evenly(spark):
    """Rows that are equal in everything go to all shards alike."""
    df = spark.range(4_000).select(F.lit(1).alias("doc_id"))
    got = sharding.shuffle_to_shards(df, 8, rows_per_block=100).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {500}


def test_matrix_sums_and_mean():
    rng = np.random.default_rng(0)
    rows, columns = [5, 0, 12, 3], [7, 6, 7]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(rows, columns, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == columns
        total += m
    assert np.abs(total / 400 - np.outer(rows, columns) / 20).max() < 0.35
    # the search for populations beyond numpy's limit follows the same law
    big = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 400) for _ in range(600)]
    assert abs(np.mean(big) - 100) < 2 and abs(np.std(big) - np.sqrt(400 * 0.25 * 0.75)) < 1
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


# personal data

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= digits(v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= digits(v) <= 15),
]


def digits(v):
    return sum(c.isdigit() for c in v)


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text or "") if ok(m[0])]
    joined = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()


def pii_rows():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", "1", "22", "255", "256", ".", "-", " ", "  ", "+", "+1 (234) 555-0199", "4111111111111111"]
    parts += ["4111 1111 1111 1111", "1.2.3.4", "0001.2.3.4", "(", ")", "é", "😀", "\n", "_", "%", "378282246310005", "5", "@b", "co.uk"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1_500)]
    hard = ["a" * 20_000, "1" * 20_000, "a@" * 3_000, "1." * 5_000, "+" + "1 " * 5_000 + "x", "a.b" * 3_000 + "@" + "c.d" * 3_000, "1-" * 9_000]
    return list(enumerate([None, "", *made, *hard, " ".join(["me@home.org +44 20 7946 0958"] * 400)]))


def test_base_spans_equal_plain_regexes(make_docs):
    rows = pii_rows()
    df = pii.find_personal_data(make_docs(rows))
    assert no_python(df)
    got = {r["doc_id"]: r for r in df.collect()}
    for i, text in rows:
        counts, digest = base(text)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == [*counts, digest], (i, text)


def test_method_adds_spans_and_keeps_base_ones(make_docs):
    texts = ["call me: (212) 555-0143 today", "order 212-555-0143 total", "ssn 123-45-6789 of Mr. John Smith here", "mail joe [at] home [dot] org now"]
    texts += ["contact jim@home.org or tel +1 212 555 0100", "nothing here", None] + ["phone: (415) 555-0%03d please" % i for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(make_docs(list(enumerate(texts)))).collect()}
    assert got[0] == "phone:9:23"
    assert "email:8:20" in got[4] and "phone" in got[4]
    assert got[5] == got[6] == ""


def test_redaction(make_docs, odd_rows):
    docs = make_docs([(1, "é to a@b.org, 1.2.3.4 end"), (2, "clean"), (3, None), (4, "x@y.zz")])
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.schema["n_chars"] == docs.schema["n_chars"]
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert rows == {1: ("é to <EMAIL>, <IP> end", 22), 2: ("clean", 5), 3: (None, None), 4: ("<EMAIL>", 7)}
    assert pii.redact(make_docs(odd_rows)).count() == len(odd_rows)
    assert pii.find_personal_data(make_docs([])).count() == 0
    assert pii.redact(make_docs([])).count() == 0


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4_000) < 0.4
    right = [0.95, 0.9, 0.85, 0.55]
    votes = np.stack([np.where(rng.random(4_000) < p, truth, ~truth) * 2 - 1 for p in right], axis=1)
    posterior, table = pii.reliabilities(votes, np.zeros(4_000, int), np.ones(4_000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    hit = table[:, 1, 2]
    assert hit[0] > hit[1] > hit[2] > hit[3] and abs(hit[0] - 0.95) < 0.04
