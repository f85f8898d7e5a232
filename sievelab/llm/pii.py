"""Personal data in texts by weak supervision, in SQL functions only.

Patterns give candidate spans, labelers vote on each, expectation-maximisation estimates how reliable each labeler is, and a
logistic span classifier is fitted to the resulting posteriors. Corpus-wide, only counts of vote and feature patterns leave the
executors; their number is bounded by the labelers and buckets, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelab.sources.scratch import save_table

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
BASE_KINDS = 4

# A start inside a run of a pattern's first class cannot match where the run's start does not, so starts are held to run
# starts (or the last match's end) and repeats are possessive: time is linear in the text. Matches are as without both.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
# whole chains of digits only: a chain of another length fails the count anyway
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# spans that only the method adds, with the kind each alternative stands for
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?",
}

# fixed values: gazetteers and context words
TLDS = "com org net edu gov io co info biz de fr es it uk us ca au nl ch at be eu jp cn in br ru pl se no"
COUNTRY_CODES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah"
FOR = {
    "email": "e-?mail|mail|contact|write|reach|reply",
    "ip": "ip|address|host|server|login|from",
    "card": "card|credit|debit|visa|mastercard|amex|payment|pay",
    "phone": "tel|phone|call|mobile|cell|fax|contact|whatsapp",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|bank|transfer|konto|compte",
    "name": "dear|contact|by|from|patient|signed|attn",
}
AGAINST = "version|release|build|order|invoice|isbn|issn|sku|serial|part|page|section|chapter|figure|ratio|total"
DUMMY = r"(?i)(0{6}|1{6}|9{6}|x{4}|123-?45-?6789|000-00-0000|nobody|noreply)"
LABELERS = ["shape", "check", "gazetteer", "context", "counter_context", "dummy"]
BEFORE = 32  # code points of context before a span


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _located(text: Column, pattern: str, kind: Column | None = None) -> Column:
    """All matches as (start, kind, end, value), ends exclusive; gaps between matches give their places."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(values, F.slice(gaps, 1, F.size(gaps) - 1), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(at: Column, m: Column) -> Column:
        start = at["pos"] + m["g"]
        end = start + F.length(m["v"])
        span = F.struct(start.alias("start"), end.alias("end"), m["v"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(at["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    return F.aggregate(each, first, step, lambda at: at["out"])


def _kind_of(value: Column) -> Column:
    found = F.lit(None).cast("int")
    for name in reversed(WIDE):
        found = F.when(value.rlike(f"^(?:{WIDE[name]})$"), F.lit(KINDS.index(name))).otherwise(found)
    return found


def with_candidates(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``__text``, the base spans and the wider candidates (start, kind, end, value)."""
    text = F.col("__text")
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = lambda guard, pattern: F.when(guard, _located(text, pattern)).otherwise(empty)
    rows = docs.withColumn("__text", F.coalesce(F.col(column), F.lit("")))
    rows = rows.withColumn("__s0", found(text.contains("@"), EMAIL))
    rows = rows.withColumn("__s1", found(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), IP))
    rows = rows.withColumn("__s2", found(text.rlike("[0-9][0-9 -]{12}"), CARD))
    rows = rows.withColumn("__s3", found(text.contains("+"), PHONE))
    rows = rows.withColumn("__s4", found(text.rlike("|".join(WIDE.values())), "|".join(WIDE.values())))
    number = lambda v: F.length(_digits(v))
    valid = [
        lambda s: F.lit(True),
        lambda s: s["value"].rlike(IP_VALID),
        lambda s: number(s["value"]).between(14, 19) & _luhn(s["value"]),
        lambda s: number(s["value"]).between(10, 15),
    ]

    def named(kind: int):
        return lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"], s["value"])

    base = [F.transform(F.filter(f"__s{k}", valid[k]), named(k)) for k in range(BASE_KINDS)]
    rows = rows.withColumn("__base", F.sort_array(F.concat(*base)))
    wide = F.transform(
        F.col("__s4"), lambda s: F.struct(s["start"], _kind_of(s["value"]).alias("kind"), s["end"], s["value"])
    )
    clear = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("__wide", F.filter(wide, lambda s: s["kind"].isNotNull() & clear(s)))
    candidates = F.transform(F.concat("__base", "__wide"), _labelled)
    return rows.withColumn("__cands", candidates).drop("__s0", "__s1", "__s2", "__s3", "__s4", "__wide")


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, 1).when(negative, -1).otherwise(0).cast("byte")


def _labelled(span: Column) -> Column:
    """The span with every labeler's vote (1, -1 or 0 for none) and its feature buckets."""
    value, kind = span["value"], span["kind"]
    lower = F.lower(value)
    before = F.lower(F.substring(F.col("__text"), F.greatest(span["start"] - BEFORE, F.lit(0)) + 1, F.least(span["start"], F.lit(BEFORE))))
    digits = F.length(_digits(value))
    of = lambda cases: F.coalesce(*[F.when(kind == KINDS.index(k), c) for k, c in cases.items()], F.lit(False))
    no = F.lit(False)
    shape = {
        "email": lower.rlike(r"^[a-z0-9][a-z0-9._%+-]*(@|.?[\[({] ?at ?[\])}] ?)[a-z0-9-]+(.*)[a-z]{2,}$"),
        "ip": value.rlike(IP_VALID),
        "card": value.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$"),
        "phone": value.rlike(r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}$"),
        "ssn": value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
        "iban": F.length(F.regexp_replace(value, " ", "")).between(15, 34),
        "name": F.size(F.split(value, " ")) == 3,
    }
    check = {
        "card": _luhn(value),
        "ip": value.rlike(IP_VALID) & ~value.rlike(r"^0\."),
        "phone": digits.between(10, 15),
        "email": lower.rlike(r"[a-z]{2,}$"),
    }
    gazetteer = {
        "email": lower.rlike(rf"(\.|\bdot[\])}}]? ?)({TLDS.replace(' ', '|')})$"),
        "card": value.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": value.rlike(rf"^\+({COUNTRY_CODES})"),
        "iban": value.rlike("^(AT|BE|CH|DE|ES|FR|GB|IT|LU|NL|PL|PT|SE)"),
        "name": lower.rlike(rf"\b({NAMES.replace(' ', '|')})\b"),
    }
    context = {k: before.rlike(rf"(?<![a-z])({words})(?![a-z])") for k, words in FOR.items()}
    votes = {
        "shape": _vote(of(shape), ~of(shape)),
        "check": _vote(of(check), ~of(check) & kind.isin([KINDS.index(k) for k in check])),
        "gazetteer": _vote(of(gazetteer), no),
        "context": _vote(of(context), no),
        "counter_context": _vote(no, before.rlike(rf"(?<![a-z])({AGAINST})(?![a-z])")),
        "dummy": _vote(no, value.rlike(DUMMY)),
    }
    share = F.floor(F.lit(3) * digits / F.greatest(F.length(value), F.lit(1))).cast("byte")
    length = F.least(F.floor(F.log2(F.length(value).cast("double") + 1)), F.lit(6)).cast("byte")
    return F.struct(
        span["start"],
        kind.alias("kind"),
        span["end"],
        *[v.alias(name) for name, v in votes.items()],
        share.alias("digit_share"),
        length.alias("length_bucket"),
    )


FEATURES = ["kind", *LABELERS, "digit_share", "length_bucket"]


def reliabilities(votes: np.ndarray, kinds: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern being personal data, and P(vote | class) as [labeler, class, vote + 1].

    Expectation-maximisation of the model in which labelers vote independently given the class; each kind has a prior of
    its own. It starts from the majority, and smoothing keeps every probability above zero.
    """
    posterior = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        both = np.stack([1 - posterior, posterior])
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = (both * weight * (votes[:, j] == v)).sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        log_odds = np.zeros(len(weight))
        for k in np.unique(kinds):
            of = kinds == k
            yes = (posterior * weight)[of].sum() + 1
            log_odds[of] = np.log(yes / (weight[of].sum() - yes + 2))
        for j in range(votes.shape[1]):
            log_odds += np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1])
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior, table


def fit_classifier(patterns: list[tuple]) -> dict[str, dict[int, float]]:
    """Log-odds for each value of each feature, fitted to the posteriors of (features..., count) patterns."""
    weights: dict[str, dict[int, float]] = {f: {} for f in FEATURES} | {"": {0: 0.0}}
    if not patterns:
        return weights
    data = np.array(patterns, dtype=np.int64)
    values, count = data[:, :-1], data[:, -1].astype(float)
    target, _ = reliabilities(values[:, 1 : 1 + len(LABELERS)], values[:, 0], count)
    columns = [(f, int(v)) for j, f in enumerate(FEATURES) for v in np.unique(values[:, j])]
    x = np.stack([values[:, FEATURES.index(f)] == v for f, v in columns] + [np.ones(len(values), bool)], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, 1.0), 1e-6]
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (p - target)) + ridge * w
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    for (f, v), value in zip(columns, w, strict=False):
        weights[f][v] = float(value)
    weights[""][0] = float(w[-1])
    return weights


def classify(span: Column, weights: dict[str, dict[int, float]]) -> Column:
    """Probability that a candidate is personal data."""
    total = F.lit(weights[""][0])
    for feature in FEATURES:
        for value, weight in weights[feature].items():
            total = total + F.when(span[feature] == value, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def _short(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))


def tag(docs: DataFrame, least: float = 0.5, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (start, kind, end) by start, then kind.

    Base spans always stay; a wider candidate is added from probability ``least`` on. The candidates are written once,
    counted, and scored from what was written.
    """
    rows = with_candidates(docs, text).withColumn("__base", _short(F.col("__base"))).drop("__text")
    rows = rows if keep_text else rows.drop(text)
    rows = save_table(rows, "pii-candidates")
    counted = rows.select(F.explode("__cands").alias("c")).select("c.*").groupBy(*FEATURES).count()
    weights = fit_classifier([tuple(r) for r in counted.collect()])  # at most values of FEATURES, whatever the corpus
    added = F.slice("__cands", F.size("__base") + 1, F.size("__cands"))
    added = F.filter(added, lambda s: classify(s, weights) >= least)
    return rows.withColumn("__spans", F.sort_array(F.concat("__base", _short(added)))).drop("__cands")


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans of personal data in every text, null ones being empty; one row for each row of ``docs``.

    n_email, n_ip, n_card, n_phone and base_sha256 are of the base patterns; spans has the classifier's as well. A table
    without candidates adds none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__raw"))
    rows = tag(texts, least, "__raw")
    number = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)],
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("__spans")).alias("spans"),
    )


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, overlapping spans by the first one's.

    Null texts stay null, and texts without a span stay as they are. A column ``n_chars`` gets the new length.
    """
    rows = tag(docs, least, keep_text=True)

    def merge(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        longer = F.struct(last["start"], last["kind"], F.greatest(last["end"], s["end"]).alias("end"))
        overlaps = F.coalesce(last["end"] > s["start"], F.lit(False))
        front = F.when(overlaps, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.concat(front, F.array(F.when(overlaps, longer).otherwise(s)))

    rows = rows.withColumn("__merged", F.aggregate("__spans", F.slice("__spans", 1, 0), merge))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(F.col("__merged"), i - 1)["end"], F.lit(0))
        return F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.get(names, s["kind"]))

    end = F.get(F.col("__merged"), F.size("__merged") - 1)["end"]
    rest = F.substring(F.col("text"), end + 1, F.greatest(F.length("text") - end, F.lit(0)))
    clean = F.concat(F.array_join(F.transform("__merged", piece), ""), rest)
    rows = rows.withColumn("text", F.when(F.size("__merged") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
