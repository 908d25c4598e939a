"""Secret scan: patterns propose candidates, a random forest removes the false ones.

A candidate is a value assigned to a name or a long run of letters and digits. The forest looks at its
length, the transitions between its characters, how much of it dictionary words cover, the path it
was found under, and the words around it. Its trees are fitted in tasks, each to a part of the labelled
findings, all of which are in some part, and flattened into arrays, so that candidates are found, judged
and, if asked for, masked in one pass over the texts.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import as_text, slices
from sitegraph.llm.trees import Bins, Trees
from sitegraph.session import cut

#: Labelled findings that a tree is fitted to, trees and the seed of their random numbers, words of the dictionary.
SAMPLE_FINDINGS = 20_000
TREES = 60
SEED = 7
DICTIONARY_WORDS = 20_000

# Names that secrets are assigned to, words beside values that are not secrets, and
# parts of paths under which values are made up.
SECRET_NAMES = "api apikey auth bearer credential key passphrase passwd password private pwd secret token".split()
OTHER_NAMES = (
    "account build card checksum commit crc digest hash iban id isbn md5 number order phone ref revision sha sha1 sha256 "
    "tel uuid version"
).split()
MADE_UP_PATHS = "doc docs example examples fixture fixtures lock mock sample samples spec test tests".split()

_ASSIGN = re.compile(r"[=:]")
_NAME = re.compile(r"([A-Za-z][\w.-]{0,63})[\"']?\s{0,3}\Z")
_QUOTE = re.compile(r"[=>]?\s{0,3}([\"'`])")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*(?={q})") for q in "\"'`"}
#: Up to white space or a comma, or to the next name of a query or connection string.
_UNQUOTED = re.compile(r"[=>]?\s{0,3}[\"'`]?((?:[^\s,?&;|]|[?&;|](?![A-Za-z][\w.-]{0,63}[=:]))+)")
_OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}
#: Characters of a value inside another one without quotes.
INNER = 512
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_SIMPLE = re.compile(r"[A-Za-z0-9+/=_.~!@^-]+")
_PART = re.compile(r"[A-Za-z]+|[0-9]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[a-z]{2,}")

#: Shapes that are secrets under any name: prefixes of issued tokens, JSON web tokens, blocks of private keys.
SHAPES = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", r"\bgh[opsur]_[A-Za-z0-9]{30,}", r"\bgithub_pat_[A-Za-z0-9_]{30,}", r"\bglpat-[A-Za-z0-9_-]{20,}",
    r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", r"\b[prs]k_(?:live|test)_[A-Za-z0-9]{16,}", r"\bAIza[A-Za-z0-9_-]{35}", r"\bnpm_[A-Za-z0-9]{30,}",
    r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"\bhf_[A-Za-z0-9]{30,}", r"\bsk-[A-Za-z0-9_-]{32,}",
)
_KEY_BLOCK = (
    r"(?:(?:(?!-----)[\s\S])*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|(?:\s|\\[nr]|[A-Za-z0-9+/=]{16,})*(?<!\s))"
)
_SHAPE = re.compile("|".join([SHAPES[0] + _KEY_BLOCK, *SHAPES[1:]]))
#: What a shape begins with; these are looked for first, as that is much faster than the pattern at each place.
_HEADS = (
    "-----BEGIN ", "eyJ", "AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxe-",
    "xoxo-", "xoxp-", "xoxr-", "xoxs-", "pk_live_", "pk_test_", "rk_live_", "rk_test_", "sk_live_", "sk_test_", "AIza", "npm_",
    "SG.", "hf_", "sk-",
)

MASK = "[SECRET]"

FEATURES = (
    "length", "lower", "upper", "digits", "signs", "switches", "letter_digit", "case_switches", "vowel_switches", "entropy",
    "distinct", "hexadecimal", "longest_letters", "dictionary", "made_up_path", "path_parts", "named_secret", "named_other",
    "near_secret", "near_other", "assigned", "quoted", "name_parts",
    "known_shape",
)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    name: str
    value: str
    quoted: bool
    near: tuple[str, ...]


def shapes_of(text: str) -> dict[int, int]:
    """Start and end of each known shape, without overlaps."""
    places = []
    for head in _HEADS:
        at = text.find(head)
        while at >= 0:
            places.append(at)
            at = text.find(head, at + 1)
    found, last = {}, 0
    for at in sorted(places):
        shape = _SHAPE.match(text, at) if at >= last else None
        if shape:
            found[at] = last = shape.end()
    return found


def _trimmed(value: str) -> str:
    """Without the full stop, colon, quote or closing bracket that ends the text around a value rather than the value."""
    end, counts = len(value), Counter(value)
    while end and (value[end - 1] in ".;:\"'`" or value[end - 1] in _OPENS):
        sign = value[end - 1]
        if sign in _OPENS and counts[_OPENS[sign]] >= counts[sign]:
            break
        counts[sign] -= 1
        end -= 1
    return value[:end]


def candidates_of(text: str) -> list[Candidate]:
    """Candidates in order: known shapes, assigned values, and long runs with a digit or of 20 characters.

    A quoted value goes to its closing quote in the line, another one to white space or a comma. Values assigned
    inside a value, shapes in it, and runs in it if it has signs that runs and words have not, are candidates too, so
    spans may lie in each other or overlap.
    """
    shapes = shapes_of(text)
    found: dict[tuple[int, int], tuple[str, bool]] = {}
    whole = bytearray(len(text))  # 1 where runs are part of a candidate already
    reach = 0
    for sign in _ASSIGN.finditer(text):
        name = _NAME.search(text, max(0, sign.start() - 70), sign.start())
        if not name:
            continue
        quote = _QUOTE.match(text, sign.end())
        value = _QUOTED[quote[1]].match(text, quote.end()) if quote else None
        if value:
            start, kept = value.start(), value[0]
        else:
            # a value that goes on to the end of a longer one is taken for secrets' names only, and so far
            inside = sign.start() < reach
            if inside and not any(p.lower() in SECRET_NAMES for p in _NAME_PART.findall(name[1])):
                continue
            plain = _UNQUOTED.match(text, sign.end(), min(len(text), sign.end() + INNER) if inside else len(text))
            if not plain:
                continue
            start, kept = plain.start(1), _trimmed(plain[1])
            reach = max(reach, plain.end(1))
        if len(kept) >= 8 and not kept.startswith("//"):
            end = max(start + len(kept), shapes.get(start, 0))
            found.setdefault((start, end), (name[1], bool(value)))
            if _SIMPLE.fullmatch(kept):
                whole[start : start + len(kept)] = b"\1" * len(kept)
    for start, end in shapes.items():
        found.setdefault((start, end), ("", False))
        whole[start:end] = b"\1" * (end - start)
    for run in _RUN.finditer(text):
        value = run[0]
        if any(c.isdigit() for c in value) or (len(value) >= 20 and any(c.isalpha() for c in value)):
            if not whole[run.start()] and not whole[run.end() - 1]:
                found.setdefault(run.span(), ("", False))
    out = []
    for (start, end), (name, quoted) in sorted(found.items(), key=lambda f: (f[0][0], -f[0][1])):
        before = _WORD.findall(text[max(0, start - 60) : start].lower())[-3:]
        after = _WORD.findall(text[end : end + 40].lower())[:2]
        out.append(Candidate(start, end, name, text[start:end], quoted, (*before, *after)))
    return out


def mask_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with each stretch that the spans cover replaced by one mask."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _share(value: str, test) -> float:
    return sum(map(test, value)) / len(value)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that lie in dictionary words of three letters or more, longest first."""
    covered, low = 0, value.lower()
    for m in _LETTERS.finditer(low):
        run, k = m[0], 0
        while k < len(run):
            size = next((n for n in range(min(len(run) - k, 16), 2, -1) if run[k : k + n] in dictionary), 0)
            covered += size
            k += size or 1
    return covered / len(value)


def features_of(c: Candidate, path: str, dictionary: frozenset[str]) -> list[float]:
    v = c.value
    pairs = list(zip(v, v[1:]))
    n = max(1, len(pairs))
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.isalpha() else "s" for x in v]
    steps = list(zip(kinds, kinds[1:]))
    counts = np.array(list(Counter(v).values())) / len(v)
    parts = [p.lower() for p in _PART.findall(path)]
    name = [p.lower() for p in _NAME_PART.findall(c.name)]
    near = set(c.near)
    return [
        len(v), kinds.count("l") / len(v), kinds.count("u") / len(v), kinds.count("d") / len(v), kinds.count("s") / len(v),
        sum(a != b for a, b in steps) / n,
        sum({a, b} <= {"d", "l", "u"} and (a == "d") != (b == "d") for a, b in steps) / n,
        sum({a, b} == {"l", "u"} for a, b in steps) / n,
        sum((a.lower() in "aeiou") != (b.lower() in "aeiou") for a, b in pairs) / n,
        float(-(counts * np.log2(counts)).sum()), len(counts) / len(v),
        _share(v, "0123456789abcdefABCDEF".__contains__), max(map(len, _PART.findall(v)), default=0) / len(v),
        coverage(v, dictionary), float(any(p in MADE_UP_PATHS for p in parts)), len(parts),
        float(any(p in SECRET_NAMES for p in name)), float(any(p in OTHER_NAMES for p in name)),
        float(any(p in SECRET_NAMES for p in near)), float(any(p in OTHER_NAMES for p in near)),
        float(bool(c.name)), float(c.quoted), len(name),
        float(_SHAPE.match(v) is not None),
    ]


def grow_forest(
    x: np.ndarray, y: np.ndarray, trees: int, depth: int = 7, features: int = 6, bins: int = 32, seed: int = SEED
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, limits and leaves of each tree: bootstrap rows per tree, a random choice of features per node."""
    rng = np.random.default_rng(seed)
    binned = Bins(x, bins)
    grown = []
    for _ in range(trees):
        weight = rng.poisson(1.0, len(y)).astype(float)
        choice = rng.random((2**depth - 1, x.shape[1])).argsort(axis=1) < features
        grown.append(binned.grow(weight * y, weight, depth, ridge=1e-3, least=2, allowed=choice)[:3])
    return grown


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """A forest of rows that fit into memory; `total` is the mean share of label 1 in the leaves."""
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, 1))
        return Trees(float(y.mean()) if len(y) else 1.0, none, none, none)
    feature, limit, leaf = (np.array(part) for part in zip(*grow_forest(x, y, trees)))
    return Trees(0.0, feature, limit, leaf / trees)


@dataclass(frozen=True)
class SecretModel:
    dictionary: frozenset[str]
    forest: Trees
    threshold: float = 0.5

    def judge(self, found: list[Candidate], path: str) -> list[tuple[float, bool]]:
        if not found:
            return []
        scores = self.forest.total(np.array([features_of(c, path, self.dictionary) for c in found], np.float32))
        return [(float(min(1.0, max(0.0, s))), bool(s >= self.threshold)) for s in scores]


_FOUND = (
    "doc_id long, start_char int, end_char int, name string, value string, quoted boolean, near array<string>, path string"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = "doc_id start_char end_char name value quoted near path".split()
    kinds = [
        pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()
    ]
    for part in slices(batches):
        rows = [
            (doc, c.start, c.end, c.name, c.value, c.quoted, list(c.near), path or "")
            for doc, path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_text(part.column(2)))
            for c in candidates_of(text)
        ]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names)


def _texts(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), F.col("text").alias("text")
    )


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """All candidates: doc_id, span, name, value, whether quoted, the words around it, and the path."""
    return _texts(docs, path).mapInArrow(_find, _FOUND)


def made_up_findings(count: int = 400, seed: int = 11) -> list[tuple]:
    """Secrets of the known shapes, of random characters without a name, and under names joined in camel case.

    They stand in for kinds that a corpus may hold too few of to learn from.
    """
    rng = random.Random(seed)
    mixed = string.ascii_letters + string.digits
    names = [a + b for a in ("access", "client", "db", "user", "api", "refresh") for b in ("Token", "Secret", "Password", "Key")]

    def some(n: int, of: str = mixed) -> str:
        return "".join(rng.choice(of) for _ in range(n))

    bare = (
        lambda: rng.choice(("AKIA", "ASIA")) + some(16, string.ascii_uppercase + string.digits),
        lambda: "gh" + rng.choice("opsur") + "_" + some(36),
        lambda: f"eyJ{some(rng.randrange(17, 60))}.eyJ{some(rng.randrange(20, 150))}.{some(43)}",
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n"
        + "".join(some(64, mixed + "+/") + "\n" for _ in range(rng.randrange(4, 26)))
        + "-----END RSA PRIVATE KEY-----",
        lambda: f"xoxb-{some(12, string.digits)}-{some(12, string.digits)}-{some(24)}",
        lambda: "sk_live_" + some(24),
        lambda: some(rng.randrange(24, 49), mixed + "+/"),
        lambda: some(rng.randrange(24, 49)),
    )
    signs = mixed + "#$%&*()!?@"
    named = (
        lambda: some(rng.randrange(12, 48)),
        lambda: some(2 * rng.randrange(8, 25), "0123456789abcdef"),
        lambda: some(rng.randrange(8, 24), signs),
    )
    rows = []
    for k in range(count):
        quoted = rng.random() < 0.5
        is_named = k % 2 == 1
        value = rng.choice(named if is_named else bare)()
        name = rng.choice(names) if is_named else rng.choice(("", "", "value", "x", "config"))
        rows.append((None, k, k + len(value), name, value, bool(name) and quoted, [name.lower()] if name else [], "", 1))
    return rows


def _linear_count(kind: str, least: int) -> str:
    return f"(?=(?:[^{kind}]*[{kind}]){{{least}}})"


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings with a label, where none was given by people: 1 for known shapes, for random-looking values assigned to
    a secret's name, and for random runs of both cases and digits; 0 for values under another name or under none that
    are of digits, of words, or under or beside a word for a number or digest. Random-looking values under unknown names
    have no label and are left to the model, as are all others. Names are split where the case changes.
    `made_up_findings` are added, with a NULL doc_id.
    """
    parts = F.lower(
        F.regexp_replace(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    )

    def named(words: list[str]) -> Column:
        return parts.rlike(r"(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")

    value, secret = F.col("value"), named(SECRET_NAMES)
    digit_and_letter = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"\s")
    mixed = digit_and_letter & ((F.length("value") >= 12) | value.rlike("[#$%&*()!?@^~]"))
    other = F.arrays_overlap("near", F.array(*map(F.lit, OTHER_NAMES))) | named(OTHER_NAMES)
    random_run = value.rlike(
        "^" + _linear_count("0-9", 3) + _linear_count("a-z", 3) + _linear_count("A-Z", 3) + "[A-Za-z0-9+/_=-]{24,60}$"
    )
    looks_random = value.rlike("^[^0-9]*[0-9][^A-Za-z]*[A-Za-z][^0-9]*[0-9]")
    shape = value.rlike("^(?:" + "|".join(SHAPES) + ")")
    label = F.when(shape | (secret & mixed) | (random_run & ~other), 1).when(~secret & (other | ~looks_random), 0)
    labelled = found.withColumn("label", label).where("label IS NOT NULL")
    more = found.sparkSession.createDataFrame(made_up_findings(), _FOUND + ", label int")
    return labelled.unionByName(more)


def read_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The words of three letters or more that all texts together hold most often."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    top = docs.select(word.alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    # gathered by Spark: partitions send their own most frequent words to one task, not to the driver
    return frozenset(top.agg(F.collect_list("w").alias("words")).first()["words"])


_GROWN = "feature array<int>, limit array<float>, leaf array<double>"


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE_FINDINGS, threshold: float = 0.5) -> SecretModel:
    """A model from all labelled findings (the columns of `findings` and `label`).

    Each tree is fitted in a task to a part of about `sample` findings, as trees differ in their rows anyway;
    each finding is in a part. Each label has half of a part, or what the other leaves over, so that
    rare secrets are in it however many other findings there are: a label with more findings is cut into
    chunks, and parts beyond its chunks take them again. Labels are not weighed back: a leaf that holds
    secrets would then be judged by the number of other findings. Parts grow beyond `sample` only when there
    is one for each tree. If a label is absent every candidate is kept.
    """
    spark = docs.sparkSession
    dictionary = read_dictionary(docs)
    labelled = cut(labelled)
    counts = {r["label"]: r["count"] for r in labelled.where("label IN (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return SecretModel(dictionary, fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0)), threshold)
    total = sum(counts.values())
    chunks = {y: min(TREES, -(-n // max(sample // 2, sample - (total - n)))) for y, n in counts.items()}
    parts, first = max(chunks.values()), list(counts)[0]
    shared = spark.sparkContext.broadcast(dictionary)  # bounded by its number of words
    rows = labelled.where("label IN (0, 1)").select(
        F.xxhash64("value", "doc_id", "start_char").alias("_order"), *_FEATURE_COLUMNS, F.col("label").cast("int").alias("label")
    )
    numbers = rows.mapInArrow(_featured(shared), "_order long, label int, x array<float>")
    grown = in_parts(numbers, chunks).groupBy("_part").applyInPandas(
        lambda key, rows: _grown(key[0], rows, parts, first), _GROWN + ", tree int"
    )
    trees = sorted(grown.collect(), key=lambda r: r["tree"])  # at most TREES rows of fixed size
    return SecretModel(
        dictionary,
        Trees(
            0.0,
            np.array([r["feature"] for r in trees], np.int32),
            np.array([r["limit"] for r in trees], np.float32),
            np.array([r["leaf"] for r in trees]) / len(trees),
        ),
        threshold,
    )


def in_parts(rows: DataFrame, chunks: dict[int, int]) -> DataFrame:
    """`rows` with `_part`, below the largest number of chunks: a label's chunk k is in parts k, k + chunks and so on."""
    own = F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair])[F.col("label")]
    placed = F.sequence(F.pmod("_order", own).cast("int"), F.lit(max(chunks.values()) - 1), own)
    return rows.withColumn("_part", F.explode(placed))


_FEATURE_COLUMNS = "start_char end_char name value quoted near path".split()


def _featured(dictionary):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = {name: k for k, name in enumerate(part.schema.names)}
            found = zip(*(part.column(at[c]).to_pylist() for c in _FEATURE_COLUMNS))
            x = [features_of(Candidate(*c[:5], tuple(c[5])), c[6], dictionary.value) for c in found]
            kept = [part.column(at["_order"]), part.column(at["label"]), pa.array(x, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(kept, ["_order", "label", "x"])

    return featured


def _grown(part: int, rows, parts: int, first: int):
    """The trees of a part: every `parts`-th of all, from its own random numbers."""
    import pandas as pd

    rows = rows.assign(_second=rows["label"] != first).sort_values(["_second", "_order"], kind="stable")
    x = np.array(rows["x"].tolist(), np.float32)
    own = range(part, TREES, parts)
    grown = grow_forest(x, rows["label"].to_numpy(float), len(own), seed=SEED + part)
    columns = [[tree[k].tolist() for tree in grown] for k in range(3)]
    return pd.DataFrame(dict(zip(("feature", "limit", "leaf"), columns)) | {"tree": list(own)})


_JUDGED = "doc_id long, start_char int, end_char int, name string, value_sha256 string, score double, secret boolean"


def _judge(model):
    names = [c.split()[0] for c in _JUDGED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_text(part.column(2))):
                found = candidates_of(text)
                for c, (score, secret) in zip(found, model.value.judge(found, path or "")):
                    digest = hashlib.sha256(c.value.encode()).hexdigest()
                    rows.append((doc, c.start, c.end, c.name, digest, score, secret))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return judge


def judged_findings(docs: DataFrame, model: SecretModel, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, span in characters, the name it is assigned to, digest, score, and the verdict.

    NULL, empty and clean texts have no rows; a NULL path is empty. Repeated rows give their findings
    each; other columns are not read. A model without labelled findings, or with labels of one kind,
    keeps every candidate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's own limits
    return _texts(docs, path).mapInArrow(_judge(shared), _JUDGED)


def _masker(model):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            for k, (path, text) in enumerate(zip(part.column(0).to_pylist(), texts)):
                found = candidates_of(text) if text else []
                verdicts = model.value.judge(found, path or "")
                spans = [(c.start, c.end) for c, (_, secret) in zip(found, verdicts) if secret]
                if spans:
                    texts[k] = mask_spans(text, spans)
            kept = [part.column(k) for k in range(2, part.num_columns)]
            names = [part.schema.names[k] for k in range(2, part.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, "_text"])

    return mask


def masked(docs: DataFrame, model: SecretModel, path: str = "source") -> DataFrame:
    """`docs` with secrets in `text` replaced by a mask, `n_chars` (if there) counted again; other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select(
        F.col(path).cast("string").alias("_path"),
        F.col("text").alias("_old"),
        *[F.col(c).alias(n) for c, n in named.items()],
    )
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:]], "_text string"])
    out = rows.mapInArrow(_masker(shared), schema)
    back = {c: F.col(n).alias(c) for c, n in named.items()}
    back["text"] = F.col("_text").alias("text")
    if "n_chars" in back:
        kind = docs.schema["n_chars"].dataType
        back["n_chars"] = F.char_length("_text").cast(kind).alias("n_chars")
    return out.select([back[c] for c in docs.columns])
