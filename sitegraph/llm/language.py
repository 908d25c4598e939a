"""Language identification by words first, backing off to character n-grams.

A word that the model knows scores by its log frequency in each language. An unseen word scores by
its n-grams: of five characters if the model knows any of them, else of four, and so on down to one.
A text's score is the sum over its words; words that a worker has met before are looked up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import ENTRY_BYTES, TABLE_BYTES, as_text, crc_of_id, hash_bound, slices

#: Bounds of the model: training documents per language, words and n-grams of each length kept per
#: language (the most frequent), and languages (those with the most labelled documents).
SAMPLE_DOCS = 1_000
KEPT_WORDS = 20_000
KEPT_GRAMS = 5_000
MAX_LANGUAGES = 128
LONGEST = 5
UNKNOWN = "und"

#: log10 frequency of a word or n-gram in a language that does not have it.
PENALTY = -7.0
#: Chunks a worker remembers; the table is emptied when it is full.
MAX_CHUNKS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word with a blank at either end; shorter words have none."""
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass(frozen=True)
class Model:
    """Log10 frequencies per language: rows of two matrices, by word and by n-gram (of all lengths)."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def known_grams(self, word: str) -> list[int]:
        """Rows of the longest n-grams of the word of which the model knows any."""
        for n in range(LONGEST, 0, -1):
            found = [g for g in map(self.grams.get, grams_of(word, n)) if g is not None]
            if found:
                return found
        return []


class Scorer:
    """Scores texts; keeps the scores of chunks between white space in a growing matrix."""

    def __init__(self, model: Model, limit: int = MAX_CHUNKS):
        self.model = model
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.model.languages) + 1))

    def _add(self, chunks: list[str]) -> None:
        """Scores and numbers of words of chunks not met yet, all at once."""
        model, first = self.model, len(self.rows)
        known_at, known, unseen_at, starts, grams, n_words = [], [], [], [], [], []
        for k, chunk in enumerate(chunks):
            words = words_of(chunk)
            n_words.append(len(words))
            for w in words:
                row = model.words.get(w)
                if row is not None:
                    known_at.append(k)
                    known.append(row)
                elif found := model.known_grams(w):
                    unseen_at.append(k)
                    starts.append(len(grams))
                    grams.extend(found)
        scores = np.zeros((len(chunks), len(model.languages) + 1))
        scores[:, -1] = n_words
        if known:
            np.add.at(scores[:, :-1], known_at, model.word_logs[known])
        if grams:
            sizes = np.diff([*starts, len(grams)])[:, None]
            np.add.at(scores[:, :-1], unseen_at, np.add.reduceat(model.gram_logs[grams], starts) / sizes)
        while first + len(chunks) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[first : first + len(chunks)] = scores
        self.rows.update(zip(chunks, range(first, first + len(chunks))))

    def _room(self) -> int:
        """Chunks the table may hold: by count, and by bytes (matrix rows, twice while it grows, and entries)."""
        per_row = 2 * 8 * (len(self.model.languages) + 1) + ENTRY_BYTES + 16
        return max(1024, min(self.limit, TABLE_BYTES // per_row))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Per text the language and its posterior with equal priors; (und, 0) for a text without letters."""
        split = [text.split() for text in texts]
        new = dict.fromkeys(c for chunks in split for c in chunks if c not in self.rows)
        if new and len(self.rows) + len(new) > self._room():
            self._reset()
            new = dict.fromkeys(c for chunks in split for c in chunks)
        get = self.rows.get
        if new:
            self._add(list(new))
        totals = [self.matrix[list(map(get, c))].sum(axis=0) if c else np.zeros(1) for c in split]
        return [self._best(t) for t in totals]

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.model.languages:
            return UNKNOWN, 0.0
        scores = total[:-1] * np.log(10)
        best = int(scores.argmax())
        return self.model.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def training_part(held_out: tuple[int, int] = (3, 1), doc_id: str = "doc_id") -> Column:
    """Whether a document may be learnt from: crc32(doc_id as text) mod 3 is not 1; a NULL id never is."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(held_out[0])) != held_out[1], F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n): words have size 0."""
    counts: dict[tuple[str, int], Counter] = {}
    for part in slices(batches):
        for lang, text in zip(part.column(0).to_pylist(), as_text(part.column(1))):
            words = Counter(words_of(text))
            counts.setdefault((lang, 0), Counter()).update(words)
            for n in range(1, LONGEST + 1):
                own = counts.setdefault((lang, n), Counter())
                for w, times in words.items():
                    for g in grams_of(w, n):
                        own[g] += times
    for (lang, n), own in counts.items():
        k = len(own)
        columns = [[lang] * k, pa.array([n] * k, pa.int32()), list(own), pa.array(own.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "size", "gram", "n"])


def fit(
    docs: DataFrame, part: Column, sample_docs: int = SAMPLE_DOCS, words: int = KEPT_WORDS, grams: int = KEPT_GRAMS
) -> Model:
    """Counts over a sample of the labelled documents: per language those with the smallest hashes of their ids.

    `docs` has doc_id, text, lang. Only rows where `part` holds, with a text and a label, are used. The
    sample is found on narrow rows and read in a second scan, so texts are not shuffled.
    """
    order = F.xxhash64("doc_id")
    able = docs.where(part & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("_hash", order)
    names = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in names)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    near = F.create_map(*[F.lit(x) for r in names for x in (r["lang"], hash_bound(r["count"], sample_docs))])
    ranked = able.select("lang", "_hash").where(F.col("_hash") <= F.try_element_at(near, F.col("lang"))).withColumn(
        "_k", F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    )
    bounds = ranked.where(F.col("_k") <= sample_docs).groupBy("lang").agg(F.max("_hash").alias("most"))
    most = {r["lang"]: r["most"] for r in bounds.collect()}
    table = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    sample = able.where(F.col("_hash") <= F.try_element_at(table, F.col("lang"))).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, size int, gram string, n long")
    summed = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    total = F.sum("n").over(Window.partitionBy("lang", "size"))
    top = summed.select("*", F.row_number().over(place).alias("k"), total.alias("total"))
    kept = top.where(F.col("k") <= F.when(F.col("size") == 0, words).otherwise(grams)).toPandas()
    number = {lang: k for k, lang in enumerate(languages)}
    logs = np.log10(kept["n"].to_numpy(np.float64) / kept["total"].to_numpy(np.float64))

    def table(rows: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        names = kept["gram"][rows]
        places = {g: k for k, g in enumerate(dict.fromkeys(names))}
        matrix = np.full((len(places), len(languages)), PENALTY)
        matrix[[places[g] for g in names], [number[x] for x in kept["lang"][rows]]] = logs[rows]
        return places, matrix

    is_word = kept["size"].to_numpy() == 0
    return Model(languages, *table(is_word), *table(~is_word))


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for part in slices(batches):
            found = scorer.predict(as_text(part.column(part.num_columns - 1)))
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            kept = [part.column(k) for k in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, langs, scores], [*part.schema.names[:-1], "lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text.

    A NULL text, one without letters, and any text under a model without languages is `und` with
    score 0. The score is the posterior of the language with equal priors. Repeated rows and NULL
    ids give a row each (a NULL id is not held out); other columns are not read.
    """
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's own limits
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the part that may be learnt from, predict for every text."""
    return predict_languages(docs, fit(docs, training_part()))


def _keeper(model, least: float, text_at: int, lang_at: int | None):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for part in slices(batches):
            texts = as_text(part.column(text_at))
            found = scorer.predict(texts)
            if model.value.languages:
                mask = [lang != UNKNOWN and score >= least for lang, score in found]
            else:
                mask = [bool(_WORD.search(text)) for text in texts]
            columns = list(part.columns)
            if lang_at is not None:
                given = columns[lang_at].to_pylist()
                filled = [f[0] if g is None else g for g, f in zip(given, found)]
                columns[lang_at] = pa.array(filled, part.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(mask, pa.bool_()))

    return keep


def known_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs` in a language the model knows, with their columns; a NULL `lang` becomes the prediction.

    Rejected are texts without letters (NULL and empty ones too) and those whose score is below
    `least`. A model without languages rejects only the former.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else None
    return docs.mapInArrow(_keeper(shared, least, docs.columns.index("text"), lang_at), docs.schema)
