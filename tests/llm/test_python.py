"""Operators with Python inside tasks, held against the tokenizer, brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelab.llm import decontaminate, language, near_dedup, packing, quality, secrets, token_files
from sievelab.llm.components import connected_components
from sievelab.llm.word_ids import DROPPED, WordEncoder, byte_kinds, encoder, forget_encoders, pieces

PARTS = [*"abXYéÉßñİıſσΣ中文 \n\t.,;'\"-#$0129\x1c\x85  ́😀°", "'s", "<|endoftext|>", "<|startoftext|>", "<|", "the", " the", "\nthe"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)
SF = "/root/testdata/sf0.01"


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)], ids=["byte", "word"])
def encoders(request):
    name, keeps_space = request.param
    return tokenizer(name), WordEncoder(public_tokenizers.path(name), keeps_space, words=40, cores=40)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_ids_equal_the_tokenizer(encoders, texts):
    plain, cached = encoders
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_signs_after_a_word_make_no_other_word():
    words, signs = ["an", "élan", "naïve", "x1", "mañana"], ["", ",", ".", "!?", "...", '")', "***"]
    text = " ".join(word + sign for word in words for sign in signs) + "\n" + "\n".join(words)
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    (ids,) = encoder.encode([text])
    assert ids.tolist() == tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert len(encoder.numbers) <= 2 * len(words) + len(signs)  # words of a space, of a line, the first one and the signs


def test_words_met_once_are_forgotten_between_tasks():
    plain, encoder = tokenizer("byte_bpe_50k.json"), WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    letters = "abcdefghij"
    for task in range(4):
        once = [f"q{a}{b}{letters[task]}" for a in letters for b in letters]
        texts = [" ".join([*once, "an", "an"]), "so an end\nso an end"]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        encoder.trim()
        assert set(encoder.numbers) == {" an", " end"} and len(encoder.start) == len(encoder.size) == len(encoder.uses) == 3
    for _ in range(3):
        encoder.trim()
    assert not encoder.numbers


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_pieces_make_the_text(texts):
    found, ends = pieces(texts, byte_kinds())
    words, start = found.to_pylist(), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert "".join(words[start:end]) == text and all(words[start:end])
        start = end
    assert start == len(words)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_dropped_space_and_case(texts):
    found, ends = pieces(texts, byte_kinds(DROPPED), False)
    words, start = found.to_pylist(), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        plain = re.sub("[ \t\n\v\f\r]", "", text)
        assert "".join(words[start:end]) == re.sub("[A-Z]", lambda m: m[0].lower(), plain) and all(words[start:end])
        start = end
    assert start == len(words)


def test_case_and_signs_make_no_other_word():
    text = " ".join(word + sign for word in ["an", "An", "AN", "élan", "x1"] for sign in ["", ",", "...", '")'])
    words = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    (ids,) = words.encode([text + "\n" + text])
    assert ids.tolist() == tokenizer("word_bpe_49k.json").encode(f"{text} {text}", add_special_tokens=False).ids
    assert len(words.numbers) == 3 + 3  # three words and the signs


def test_encoders_are_forgotten():
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = encoder(path, True)
    assert encoder(path, True) is kept
    forget_encoders()
    assert encoder(path, True) is not kept


def test_decontamination_and_encoding_use_small_batches(make_docs, spark, monkeypatch):
    """A batch is held whole by Python and once more outside the heap of the executor's JVM."""
    seen = []
    for module in (decontaminate, packing):
        save = module.save_table
        monkeypatch.setattr(
            module,
            "save_table",
            lambda df, label, save=save: seen.append((label, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))) or save(df, label),
        )
    docs = make_docs([(i, f"text number {i} of a few that are distinct enough") for i in range(20)])
    benchmark = spark.createDataFrame([(1, "text number 7 of a few that are distinct enough")], "item_id long, text string")
    left = decontaminate.drop_leaked(docs, benchmark)
    assert 7 not in {r["doc_id"] for r in left.collect()} and left.columns == docs.columns
    packing.pack_documents(left)
    assert {label: n <= 1_000 for label, n in seen} == {"clean": True, "encoded": True}


# token files


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 700), st.sampled_from([1, 2, 300, 49_408, 2**32 - 1]), st.integers(0, 10**6))
def test_blocks_round_trip(n, high, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
    ids[rng.random(n) < 0.05] = 2**32 - 1
    raw = token_files.write_segment([3], [ids], 9)
    names, counts, before, back = token_files.read_segment(raw)
    assert (names.tolist(), counts.tolist(), before) == ([3], [n], 9) and (back == ids).all()
    for block in range(-(-n // 128)):
        assert (token_files.read_block(raw, block) == ids[128 * block : 128 * block + 128]).all()


def test_outliers_are_patched_and_blocks_small():
    ids = np.tile(np.arange(16, dtype="<u4"), 1_000)
    ids[::200] = 40_000
    packed = token_files.pack_blocks(ids)
    assert set(packed.index["width"]) == {4} and len(packed.outliers) == len(ids[::200])
    assert packed.words.nbytes == len(ids) // 2


def test_token_files(make_docs, odd_rows):
    plain = tokenizer("word_bpe_49k.json")
    key = lambda i: -(2**63) if i is None else i
    ordered = sorted(((key(i), (t or "")) for i, t in odd_rows), key=lambda r: (r[0], r[1].encode()))
    expected, start = [], 0
    for i, text in ordered:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.token_file_digest(make_docs(odd_rows)).collect()
    assert sorted((key(r["doc_id"]), *r[1:]) for r in got) == sorted(expected)
    assert token_files.token_file_digest(make_docs([])).count() == 0


# packing


def check_pieces(rows, texts, window=1_024):
    """Every id in exactly one piece; sequences gapless and within the window."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, ids in texts.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window


def test_packing_keeps_every_id_once(make_docs, odd_rows):
    rows = [(i, t) for i, t in dict(odd_rows).items()]
    plain = tokenizer("byte_bpe_50k.json")
    texts = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    for indexed in (4, 1_024):
        got = packing.pack_documents(make_docs(rows), indexed=indexed).collect()
        check_pieces(got, texts)
    ids = sum(map(len, texts.values()))
    assert 1 - ids / (1_024 * len({r["sequence_id"] for r in got})) < 0.1
    assert packing.pack_documents(make_docs([])).count() == 0
    assert packing.pack_documents(make_docs(odd_rows)).groupBy().sum("length").first()[0] >= ids


def test_neighbours_are_related():
    """Texts of one topic share a window, and scores equal the plain formula."""
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(1_000 * t, 1_000 * t + 60, 255), 0) for t in range(8) for _ in range(4)]
    windows = list(packing.fill_windows(texts))
    assert all(len({at // 4 for at, *_ in w}) == 1 for w in windows) and len(windows) == 8
    index = packing.Index(texts)
    n, mean = len(texts), np.mean([len(t) for t in texts])
    for a, b in [(0, 1), (0, 7), (5, 5), (9, 8)]:
        score = 0.0
        for term in set(texts[a].tolist()):
            df = sum(term in t for t in texts)
            tf = (texts[b] == term).sum()
            idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5))) if df > 1 else 0.0
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[b]) / mean))
        assert abs(index.scores(a)[b] - score) < 1e-9


def piece_pairs(rows):
    """Documents of each sequence's seed and its best neighbour, with the score."""
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by.setdefault(r["sequence_id"], []).append(r)
    return [(part[0]["doc_id"], part[1]["doc_id"], part[1]["neighbour_score"]) for part in by.values() if len(part) > 1]


def test_long_texts_are_compared_whole(make_docs):
    """The first window of a text is of its topic, and all that is left to place is not."""
    plain, rng = tokenizer("byte_bpe_50k.json"), random.Random(3)
    size = lambda words: len(plain.encode("".join(words), add_special_tokens=False).ids)
    word = lambda: " " + "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for topic in range(8):
        own = [word() for _ in range(60)]
        for copy in range(2):
            body = [rng.choice(own) for _ in range(600)]
            while size(body) > 1_024:
                body.pop()
            body += [" the"] * (1_024 - size(body))
            tail = []
            while size(tail) < 495:
                tail.append(word())
            rows.append((10 * topic + copy, "".join(body + tail)))
    pairs = piece_pairs(packing.pack_documents(make_docs(rows)).collect())
    assert len(pairs) >= 7 and all(a // 10 == b // 10 and score > 0 for a, b, score in pairs[:7])


def test_copies_meet_whatever_the_number_of_shards(make_docs):
    """Near copies are dealt to one shard, and scores are those of the whole corpus."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for group in range(40):
        own = [word() for _ in range(50)]
        rows += [(10 * group + copy, " ".join([*own, word(), word()])) for copy in range(4)]
    got = packing.pack_documents(make_docs(rows), indexed=16).collect()
    shard = {r["doc_id"]: r["sequence_id"] >> 32 for r in got}
    together = np.mean([shard[10 * group] == shard[10 * group + copy] for group in range(40) for copy in (1, 2, 3)])
    assert len(set(shard.values())) >= 8 and together > 0.6, together
    pairs = piece_pairs(got)
    plain = tokenizer("byte_bpe_50k.json")
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    n, mean, sets = len(ids), np.mean([len(x) for x in ids.values()]), {i: set(x) for i, x in ids.items()}
    for a, b, got in pairs[:5]:
        score = 0.0
        for term in sets[a] & sets[b]:
            df, tf = sum(term in x for x in sets.values()), ids[b].count(term)
            score += max(0.0, np.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids[b]) / mean))
        assert abs(got - score) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1_023), max_size=40))
def test_windows_are_full(lengths):
    texts = [np.arange(n) % 50 for n in lengths]
    windows = list(packing.fill_windows(texts))
    assert sum(length for w in windows for _, _, length, _ in w) == sum(lengths)
    assert all(sum(p[2] for p in w) == 1_024 for w in windows[:-1])


def test_used_texts_leave_the_index():
    """Scores of the others stay to the last bit, and what is looked through shrinks."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 400, n) for n in rng.integers(1, 300, 200)]
    every, left = packing.Index(texts), packing.Index(texts)
    gone = rng.random(200) < 0.7
    left.drop(gone)
    assert len(left.docs) == (~gone[every.docs]).sum() < len(every.docs) / 2
    for i in range(0, 200, 7):
        assert (left.scores(i)[~gone] == every.scores(i)[~gone]).all()


# near duplicates


def brute_components(rows, size, pct=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[ \t-\r]+", (text or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(25):
        text = [rng.choice(pool) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = [rng.choice(pool) if rng.random() < 0.03 else w for w in text]
            rows.append((i, " ".join(copy).replace(" w1", rng.choice([" W1", "\n w1", " w1"]))))
            i += 1
        if rng.random() < 0.5:
            text = [w for w in text for _ in range(1 if rng.random() < 0.95 else 2)]  # a chain of likeness
            rows.append((i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("spec", [near_dedup.Spec(words=2), near_dedup.Spec(words=5), near_dedup.Spec(words=2, block=4, broadcast_rows=1)])
def test_components_equal_brute_force(make_docs, odd_rows, spec):
    rows = [(1_000 + i if i is not None and abs(i) < 1_000 else i, t) for i, t in odd_rows] + near_rows()
    got = near_dedup.near_duplicates(make_docs(rows), spec).collect()
    expected = brute_components(rows, spec.words)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(map(key, expected))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_estimates_lose_no_link(make_docs):
    """No estimate is high enough for these deviations, and every link is found all the same."""
    rows = near_rows()
    got = near_dedup.near_duplicates(make_docs(rows), near_dedup.Spec(words=2, deviations=-30.0)).collect()
    wanted = {i: c for i, _, c in brute_components(rows, 2)}
    assert len(set(wanted.values())) < len(wanted) and {r["doc_id"]: r["component_id"] for r in got} == wanted


def test_members_missed_by_the_centre_are_linked(make_docs):
    """A ring whose neighbours are alike and whose opposite ends are not."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 100])) for i in range(70)]
    got = near_dedup.near_duplicates(make_docs(rows), near_dedup.Spec(words=1)).collect()
    assert {r["component_id"] for r in got} == {0}


def shared_passage(n):
    """Texts that have a passage of 60 words in common and are otherwise unlike."""
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(60)]
    return [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(120)] + passage)) for i in range(n)]


def test_a_shared_passage_makes_no_visits(make_docs, monkeypatch):
    """Pairs that are compared on whole sets do not grow with the square of the texts."""
    seen = []
    confirmed = near_dedup.NearDuplicates.confirmed_visits
    monkeypatch.setattr(near_dedup.NearDuplicates, "confirmed_visits", lambda self, v, l: seen.append(v.count()) or confirmed(self, v, l))
    for n in (500, 2_000):
        rows = near_dedup.near_duplicates(make_docs(shared_passage(n)), near_dedup.Spec(words=5)).collect()
        assert all(r["kept"] for r in rows) and len(rows) == n
    assert seen[0] <= 50 and seen[1] <= 200


def test_fewest_equal_minima():
    found = near_dedup.fewest_equal(near_dedup.Spec())
    tail = lambda k: sum(math.comb(96, i) * Fraction(4, 5) ** i * Fraction(1, 5) ** (96 - i) for i in range(k))
    assert tail(found[96]) <= Fraction(1, 10**9) < tail(found[96] + 1)
    assert found[0] == 0 and (np.diff(found) >= 0).all()
    rng = np.random.default_rng(4)
    assert (rng.binomial(96, 0.8, 10**6) >= found[96]).all()


def test_one_row_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    texts = [r["text"] for r in rows]
    same = dict(odd_rows)[3]
    assert texts.count(same) <= 1 + sum(i is None for i, t in odd_rows if t == same)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (3, 4)) == [3]
    assert {r["doc_id"] for r in rows} >= {1, 2, 5, 6, 7, 2**62, -5} and len([r for r in rows if r["doc_id"] in (7, 8)]) == 1
    assert near_dedup.drop_near_duplicates(make_docs([])).count() == 0


def test_small_tables_are_read_by_executors(make_docs, odd_rows, spark, monkeypatch):
    """No rows pass through the driver's Python, which would start more Python workers in each executor."""
    docs = make_docs(odd_rows)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows made by the driver"))
    broadcast, shuffled = (near_dedup.drop_near_duplicates(docs, near_dedup.Spec(broadcast_rows=n)) for n in (1_000, 1))
    key = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    assert key(broadcast) == key(shuffled) and 0 < broadcast.count() < docs.count()


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + rng.randrange(1, 300)) for _ in range(400)] + [(5_000, 5_000), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[1_000] in got
    assert len({v for k, v in got.items() if 1_000 <= k < 2_000}) == 1 and got[5_000] == 5_000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def least_distance(pattern, text):
    """Plain dynamic programming over every substring end."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60))
def test_bit_parallel_distance(pattern, text):
    distance, end = decontaminate.least_distance(decontaminate.masks(pattern), len(pattern), text)
    assert distance == least_distance(pattern, text)
    assert distance == len(pattern) or least_distance(pattern, text[:end]) == distance


def test_leaks_equal_brute_force(make_docs, spark):
    rng = random.Random(6)
    syllables = ["ta", "ro", "mi", "ke", "su", "na", "lo", "vi", "pe", "du"]
    sentence = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, sentence(14)) for i in range(12)] + [(50, "short"), (51, ""), (52, None), (None, sentence(14)), (3, sentence(14))]
    rows = []
    for i in range(120):
        text = sentence(rng.randrange(0, 60))
        if rng.random() < 0.6:
            leak = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 14)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(0, 2)] = rng.choice("abcdefg")
            text += ". " + "".join(leak).upper() + "!\n" + sentence(5)
        rows.append((i, text))
    rows += [(500, None), (501, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for block_chars in (10**6, 200):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(make_docs(rows), bench, block_chars=block_chars).collect()}
        expected = {}
        for i, text in rows:
            for k, item in items:
                pattern = decontaminate.normalise(item or "")
                if len(pattern) >= 20:
                    d = least_distance(pattern, decontaminate.normalise(text or ""))
                    if d <= int(len(pattern) * 0.08):
                        expected[i, k] = min(d, expected.get((i, k), d))
        assert {k: r["distance"] for k, r in got.items()} == expected and len(expected) > 30
        clean = decontaminate.drop_leaked(make_docs(rows), bench, block_chars=block_chars)
        assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {k[0] for k in expected})
    r = got[None, 0]
    assert (r["start"], r["end"]) == (0, len(items[0][1]))
    assert decontaminate.find_leaks(make_docs([]), bench).count() == 0
    assert decontaminate.find_leaks(make_docs(rows), bench.limit(0)).count() == 0
    assert decontaminate.drop_leaked(make_docs(rows), bench.limit(0)).count() == len(rows)


def test_short_items_are_found_as_whole_words(make_docs, spark):
    bench = spark.createDataFrame([(1, "What is 17 x 23?"), (2, "两个数的和"), (3, "?!"), (4, "ox")], "item_id long, text string")
    rows = [
        (1, "Q: what is 17 x 23? 391"),
        (2, "what is 17 x 234"),
        (3, "somewhat is 17 x 23"),
        (4, "求两个数的和是多少"),
        (5, "a box of oxen, an OX"),
        (6, "boxes and foxes ?!"),
        (7, "box " * 200_000 + "ox"),
    ]
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in decontaminate.find_leaks(make_docs(rows), bench).collect()}
    assert got == {(1, 1, 0, 3, 18), (4, 2, 0, 0, 9), (5, 4, 0, 18, 20), (7, 4, 0, 800_000, 800_002)}
    kept = decontaminate.drop_leaked(make_docs(rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 6}


# secrets

RULES = [
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def test_base_secrets_equal_plain_regexes(make_docs, odd_rows):
    rng = random.Random(8)
    parts = ["password", "Secret", "apikey", "API_KEY", "token", '"', "'", " ", "  ", ":", "=", "abcdef012345", "AKIA", "ABCDEFGH12345678", "é", "\n", "x" * 12, "ſecret", "K"]
    rows = list(enumerate("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(800)))
    rows += [(-1, "a" * 100_000), (-2, "token" + " " * 50_000), (-3, None)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(make_docs(rows)).collect()}
    for i, text in rows:
        found = [(m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text or "") if ok(m)]
        joined = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        counts = [sum(f[1] == k for f in found) for k in range(3)]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, hashlib.sha256(joined.encode()).hexdigest()], text
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
    assert secrets.scan_secrets(make_docs(odd_rows)).count() == len(odd_rows)
    assert secrets.scan_secrets(make_docs([])).count() == 0


def test_guess_costs():
    cost = lambda v: secrets.guesses(v)[0]
    assert cost("") == 0
    for weak in ["password", "PASSWORD", "p@ssw0rd", "aaaaaaaaaaaa", "abcabcabcabc", "qwertyuiop", "12345678", "2019-04-23", "letmein1999"]:
        assert cost(weak) < secrets.GUESSES, weak
    for strong in ["x9$Kq!2zRv", "Tr0ub4dor&3x!Z", "7hG#2kPq"]:
        assert cost(strong) > secrets.GUESSES, strong
    assert [k for k, _ in secrets.guesses("password2019")[1]] == ["word", "date"]
    assert "".join(s for _, s in secrets.guesses("qwer%7monkeyaaa")[1]) == "qwer%7monkeyaaa"
    assert cost("z" * 50_000) < 12


def brute_guess(value):
    """Cheapest of all segmentations into words and brute-force spans."""
    import math

    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            joint = secrets.NEXT_SEGMENT if i else 0.0
            best[j] = min(best[j], best[i] + joint + sum(math.log10(secrets.alphabet(c)) for c in value[i:j]))
            if j - i >= 3 and value[i:j] in secrets.ranks():
                best[j] = min(best[j], best[i] + joint + math.log10(secrets.ranks()[value[i:j]]))
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["monkey", "admin", "zq", "xk", "vw", "cheese"]), max_size=5))
def test_segmentation_is_the_cheapest(parts):
    value = "".join(parts)
    assert abs(secrets.guesses(value)[0] - brute_guess(value)) < 1e-9 or secrets.guesses(value)[0] < brute_guess(value)


def test_passwords_in_context(make_docs):
    rows = [(1, 'login password = "x9$Kq!2zRv" ok'), (2, "password: changeme"), (3, "the password is here"), (4, "x9$Kq!2zRv alone"), (5, "token=abcdefghijkl")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(make_docs(rows)).collect()}
    assert got == {1: "password:18:28", 2: "", 3: "", 4: "", 5: "assign:0:18"}


def test_lower_case_values_and_joined_keys(make_docs):
    found = {
        "pwd=kqzvxjwbtm": "password:4:14",
        "passphrase: correcthorsebatterystaple": "password:12:37",
        "the password is kqzvxjwbtm": "password:16:26",
        "dbPassword=Tr0ub4dor&3": "password:11:22",
        "userpwd=Tr0ub4dor&3": "password:8:19",
        "password\tis\tTr0ub4dor&3xq": "password:12:25",
        "pin: éüßøñ": "password:5:10",
        "pwd=": "",
        "password: hello-world": "",
        "the password is information": "",
        "secret: information": "",
        "compass is kqzvxjwbtm": "",
    }
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(make_docs(list(enumerate(found)))).collect()}
    assert [got[i] for i in range(len(found))] == list(found.values())


# language


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right > 0.98 and total > 100


def test_mixtures_and_odd_texts(make_docs, spark, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 1500")
    model = language.learn(docs)
    text = {r["lang"]: r["text"][:1500] for r in docs.dropDuplicates(["lang"]).collect()}
    rows = [(1, text["en"] + " " + text["de"][:700]), (2, "12 .. 34"), (3, None), (4, ""), (5, text["fr"])]
    got = {r["doc_id"]: r for r in language.identify(make_docs(rows + odd_rows[10:]), model).collect()}
    shares = {k: float(v) for k, v in (x.split(":") for x in got[1]["mixture"].split(","))}
    assert got[1]["lang_pred"] == "en" and 0.15 < shares["de"] < 0.5 and set(shares) == {"en", "de"}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5]["lang_pred"] == "fr" and got[5]["mixture"].count(":") == 1
    untaught = language.identify_languages(make_docs([(1, "some words", None), (2, None, "en")])).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert language.identify_languages(make_docs([])).count() == 0


# quality


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.document_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.95 and got["quality"].nunique() == 2


def test_gradient():
    rng = np.random.default_rng(1)
    number = np.array([1, 3, 2])
    x, label = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    w = {"w": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 4)), "u": rng.normal(size=(4, 4))}
    w |= {"a": rng.normal(size=4), "c": rng.normal(size=4), "d": rng.normal(size=1)}

    def loss(w):
        z = quality.forward(x, number, w)["logit"]
        return np.mean(np.log1p(np.exp(z)) - label * z)

    for name, g in quality.gradient(x, number, label, w).items():
        for at in np.ndindex(g.shape):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += 1e-6
            assert abs((loss(moved) - loss(w)) / 1e-6 - g[at]) < 1e-4


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(2)
    number = rng.integers(1, 9, 600)
    x = rng.normal(size=(number.sum(), 6))
    bad = rng.random(600) < 0.5
    first = np.cumsum(number) - number
    x[first[bad] + rng.integers(0, number[bad])] += 4 * np.eye(6)[0]
    model = quality.fit(x, number, (~bad).astype(float), hidden=8)
    found = quality.forward((x - model.mean) / model.scale, number, model.weights)["logit"] > 0
    assert (found == ~bad).mean() > 0.9


def test_quality_without_labels_and_odd_texts(make_docs, odd_rows, spark):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        rows = quality.document_quality(docs, table).collect()
        assert len(rows) == len(odd_rows) and all(r["score"] == 1.0 and r["predicted"] == 1 for r in rows)
        assert quality.keep_good(docs, quality.learn(docs, table)).count() == len(odd_rows)
    both = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(100, 0), (100, 1)], "doc_id long, quality int")
    rows = quality.document_quality(docs, both).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.document_quality(make_docs([]), both).count() == 0


def test_passages_cover_the_whole_text():
    classes = quality.char_classes()
    for texts in ([""], ["ab"], ["x" * 399, "", "y" * 400, "z" * 401], ["", ""]):
        x, number = quality.encode(texts, classes)
        assert number.tolist() == [max(1, -(-len(t) // quality.PASSAGE)) for t in texts]
        assert np.isfinite(x).all() and len(x) == number.sum()
        assert np.allclose(np.expm1(x[:, -1]).sum(), sum(map(len, texts)))


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
    source = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.toPandas()
        kept[name] = rows
        if name != "packing":
            assert out.columns == source.columns
            docs = spark.createDataFrame(rows, source.schema)
    con = duckdb.connect()
    good, one, clean, safe = (kept[n] for n in names[:4])  # noqa: F841
    bad = con.execute(f"SELECT count(*), sum(quality) FROM good JOIN '{SF}/labels.parquet' USING (doc_id)").fetchone()
    assert bad[1] / bad[0] > 0.98
    lost = con.execute(f"SELECT count(*) FROM '{SF}/labels.parquet' WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM good)").fetchone()
    assert lost[0] <= 4
    groups = {i: c for i, _, c in brute_components(list(zip(good["doc_id"], good["text"], strict=True)), 5)}
    assert sorted(one["doc_id"]) == sorted(set(groups.values()))
    leaks = con.execute(f"SELECT count(*) FROM clean, '{SF}/benchmark.parquet' b WHERE contains(clean.text, b.text)").fetchone()
    assert leaks[0] == 0 and 0.9 * len(one) < len(clean) < len(one)
    assert sorted(safe["doc_id"]) == sorted(clean["doc_id"]) and not safe["text"].str.contains("@mail").any()
    assert (safe["text"].str.len() == safe["n_chars"]).all()
    assert set(kept["packing"]["doc_id"]) == set(safe["doc_id"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["packing"])


def test_pipeline_writes_no_rows_twice(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(30)) + f" a{i}@mail.org" for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, "", texts[3]])] + [(50, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for module in (corpus_pipeline, quality, decontaminate):
        save = module.save_table
        monkeypatch.setattr(module, "save_table", lambda df, label, save=save: seen.append(label) or save(df, label))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert seen == ["good", "near_dedup", "clean", "personal_data"]
    assert kept == {*range(41), 50} - {5}
