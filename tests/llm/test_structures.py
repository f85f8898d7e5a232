"""Pieces, Merkle manifests and spelling variants, held against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelab.llm import merkle, pieces, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(MODEL, words=200)


PARTS = [*"abeinrstXYéßſ中文한글😀𝔘́ \n\t\r;)▁\0", "  ", "    ", " the", "ing", "tion", "<s>", "<0x0A>", "<unk>", "　", "\r\n"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_pieces_equal_the_library(models, text):
    library, model = models
    ids = library.encode(text)
    assert model.encode(text).tolist() == ids
    assert model.decode(ids) == library.decode(ids)


def test_known_words_are_not_looked_up_one_by_one(models, monkeypatch):
    library, _ = models
    model = pieces.PieceModel(MODEL, words=200)
    text = "the ships sail over the seas, the seas are wide " * 20
    assert model.encode(text).tolist() == library.encode(text)
    calls, get = [], pieces.Memory.get
    monkeypatch.setattr(pieces.Memory, "get", lambda self, key: calls.append(key) or get(self, key))
    assert model.encode(text).tolist() == library.encode(text) and not calls
    model.words.old, model.words.new = model.words.new, {}  # older entries are found and kept
    assert model.encode(text).tolist() == library.encode(text) and calls and not model.words.new.keys() - model.words.old.keys()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_library(models, ids):
    library, model = models
    assert model.decode(ids) == library.decode(ids)


def merged(text, score):
    """What merging leaves of a text, step by step."""
    symbols = list(text)
    while True:
        pairs = [(score.get(a + b), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score]
        if not pairs:
            return symbols
        at = -max(pairs)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=5), st.integers(-3, 0), max_size=12), st.text("abc", max_size=20))
def test_last_tokens_for_any_scores(models, score, text):
    """Tied scores, tokens that no merging reaches and characters that are no piece."""
    import ahocorasick

    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model.pieces = [pieces.Piece(t, s, pieces.NORMAL) for t, s in score.items()]
    model.tokens, model.score = [p.text for p in model.pieces], score
    model.lone, model.runs, model.pairs = {}, {}, {}
    model.automaton = ahocorasick.Automaton()
    for i, token in enumerate(list(model.tokens)):
        model.automaton.add_word(token, (i, len(token)))
    if score:
        model.automaton.make_automaton()
    else:
        return
    last, at, found = model.last_tokens(text), len(text), []
    while at:
        found.append(model.tokens[last[at - 1]])
        at -= len(found[-1])
    assert found[::-1] == merged(text, score)


def test_encoded_documents(make_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    decoded = pieces.decode_pieces(pieces.encode_pieces(make_docs(odd_rows), MODEL), MODEL).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd_rows]
    assert sorted(map(tuple, decoded), key=repr) == sorted(want, key=repr)
    assert pieces.encode_pieces(make_docs([]), MODEL).count() == 0
    null = pieces.decode_pieces(make_docs([(1, "x")]).selectExpr("doc_id", "CAST(NULL AS ARRAY<INT>) AS ids", "text"), MODEL)
    assert null.first()["text"] == ""


# Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    found = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        found.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return found


def manifest(rows):
    groups = {}
    for doc, source, lang, n, text in rows:
        own = leaf(doc, source, lang, n, text)
        even = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        shown = leaf(doc, source, lang, n, text.replace("\n", "")) if even else own
        groups.setdefault(source, []).append((doc is not None, doc or 0, own, shown))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (known, doc, own, shown) in enumerate(sorted(groups[s])):
            path = way(trees[s], i) + way(top, k)
            for before, behind in path:
                shown = sha(*before, shown, *behind)
            proof = sha(*[x for before, behind in path for x in before + behind])
            yield doc if known else None, own, trees[s][-1][0], top[-1][0], proof, shown, shown == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_brute_force(spark, height):
    rng = random.Random(height)
    sources = [None, "", "a", "ä", "Z", *"0123456"]
    rows = [
        (rng.choice([None, *range(60)]), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "\n", "é😀"]))
        for _ in range(260)
    ]
    rows += [(1000 + i, "hot", "en", 1, f"row\n{i}" * (1 + 9_000 * (i == 5))) for i in range(150)] + [(7, "hot", "en", 1, "same\n")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    odd = docs.selectExpr("*", "'x' AS pos", "1 AS size", "'y' AS node", "'z' AS group", "0 AS leaf").repartition(5)
    got = [tuple(r) for r in merkle.verify_documents(odd, height).collect()]
    assert sorted(got, key=repr) == sorted(manifest(rows), key=repr)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.verify_documents(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(None, None, None, None, None)], [(i, None, "en", 1, "a\nb") for i in range(4)], [(i, str(i), "en", 1, "t") for i in range(10)]):
        got = [tuple(r) for r in merkle.verify_documents(spark.createDataFrame(rows, schema), 1).collect()]
        assert sorted(got, key=repr) == sorted(manifest(rows), key=repr)


def test_positions_in_a_hot_group(spark):
    rows = spark.range(5_000).selectExpr("if(id % 3 = 0, 'b', 'a' || id % 7) AS g", "id % 40 AS k")
    got = merkle.numbered(rows, "g", ["k"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["pos"], r["k"], r["size"]))
    assert sum(map(len, groups.values())) == 5_000
    for found in groups.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and {s for _, _, s in found} == {len(found)}
        assert [k for _, k, _ in found] == sorted(k for _, k, _ in found)


# spelling variants


def counted(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def variants(count):
    near = {w: set() for w in count}
    for a in count:
        for b in count:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
            if len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 5 * count[w]:
            form[w] = best
    for w in count:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))


@pytest.mark.parametrize("options", [{}, {"deepest": 3}, {"max_rows": 0}, {"max_rows": 0, "spread": 4}])
def test_variants_equal_brute_force(spark, options):
    rng = random.Random(5)
    count = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(1, 8))): 5 ** rng.randrange(6) for _ in range(250)}
    words = spark.createDataFrame([(n, w, 1) for w, n in count.items()], "n int, word string, node int")
    got = [tuple(r) for r in spelling.spelling_variants(words, **options).collect()]
    assert sorted(got) == sorted(variants(count))


def test_words_of_documents(make_docs, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(500 + i, " ".join(rng.choice(["Straße", "straße×", "ÀBCDEF", "letters", "LETTERS1letter", "lettersx"]) for _ in range(40))) for i in range(60)]
    got = {r["word"]: r["n"] for r in spelling.corpus_words(make_docs(rows)).collect()}
    assert got == counted(rows)
    result = [tuple(r) for r in spelling.document_spelling(make_docs(rows)).collect()]
    assert sorted(result, key=repr) == sorted(variants(got), key=repr)
    assert spelling.document_spelling(make_docs([])).count() == 0


def test_very_long_words(make_docs):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef") for _ in range(20_000))
    texts = [base, base[:7] + base[8:], base[:19_990] + "z" + base[19_991:], base + "q", base[:48], base[:47], base[:49], base[:48] + "Ä"]
    rows = [(i, " ".join([t] * (5 if k else 40))) for i, (k, t) in enumerate(enumerate(texts))]
    docs = make_docs(rows)
    count = {r["word"]: r["n"] for r in spelling.corpus_words(docs, slips=10**10).collect()}
    got = [tuple(r) for r in spelling.spelling_variants(spelling.corpus_words(docs, slips=10**10)).collect()]
    assert sorted(got, key=repr) == sorted(variants(count), key=repr) and max(map(len, count)) == 20_001


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "word string, form string")
    assert {r["root"] for r in spelling.roots_of(forms, 9).collect()} == {"9"}
