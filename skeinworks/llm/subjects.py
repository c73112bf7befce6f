"""Problem 10: subject mixtures from an anchored non-negative factorisation of the document-term matrix."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, small, table

#: Free components for phrases of no subject.
FREE = 3
#: Most paragraphs of labelled documents that the anchors are fitted on (those of the documents with the smallest hash).
LABELLED = 60_000
#: Anchor rounds on the labelled sample, and updates of W in a pass over the corpus and in the last one.
ANCHOR_ROUNDS, INNER, LAST_INNER = 5, 8, 18
#: Passes over the corpus end when no component's term shares move by more than this in all (of 2), or after so many.
MOVED, MOST_PASSES = 0.05, 12
#: Weight a label leaves to subjects it doesn't name, as labels may be wrong or incomplete.
DOUBT = 0.02
#: Pseudo counts of W for subjects and free components; weight of the anchors in corpus passes.
PRIOR, PRIOR_FREE, ANCHOR = 0.02, 0.03, 2.0
#: A term in this share of the paragraphs of some language says nothing, under the lower one all it can.
COMMON, RARE = 0.15, 0.05
#: A subject fills a paragraph with this share of its subject mass, of its whole mass, and so much of it.
SHARE, FILL, MASS = 0.5, 0.3, 2.0
SEED = 10
#: Characters tokenised, and entries factored, at a time, so that memory doesn't grow with an Arrow batch.
CHARACTERS, ENTRIES = 1 << 21, 1 << 15

#: Longer language codes.
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "ita": "it"}

_TAG = re.compile(r"</?[A-Za-z][^>\n]*>")
_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
_AT_END = re.compile(r"-[ \t]*\r?\n")
_LINES = re.compile(r"[\r\n\u2028\u2029]+")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _format_characters() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]+")


def paragraphs(text: str) -> list[str]:
    """Paragraphs of a text: lines, with markup and format characters removed and broken words joined."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = _format_characters().sub("", text)
    text = _TAG.sub("\n", text)
    if _AT_END.search(text):
        text = _HYPHEN.sub("", text)
    return [p for p in _LINES.split(text) if p.strip()]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose i-th value has the bytes of ``values[ends[i]:ends[i + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(text, paragraph, cols, n) of the paragraphs with words of some texts."""
    words, at, para, sizes = [], [], [], []
    for i, text in enumerate(texts):
        for k, p in enumerate(paragraphs(text)):
            if own := _WORD.findall(p.lower()):
                words += own
                at.append(i)
                para.append(k)
                sizes.append(len(own))
    coded = pa.array(words, pa.string()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
    keys = np.repeat(np.arange(len(at)), sizes) * max(1, len(hashes)) + coded.indices.to_numpy()
    keys, n = np.unique(keys, return_counts=True)
    many = -(-n // 255)  # a count beyond a byte takes several entries
    last = np.cumsum(many) - 1
    small_n = np.full(many.sum(), 255)
    small_n[last] = n - 255 * (many - 1)
    keys = np.repeat(keys, many)
    ends = np.searchsorted(keys // max(1, len(hashes)), np.arange(len(at) + 1))
    return np.array(at, np.int64), np.array(para, np.int32), _binary(hashes[keys % max(1, len(hashes))], ends), _binary(small_n.astype(np.uint8), ends)


def term_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, para, cols, n``: one row of the sparse document-term matrix per paragraph of each whole text.

    A column is the 64-bit hash of a word: no two words share one below some
    hundreds of millions of them, and no list of the words is needed to name
    it. ``cols`` and ``n`` are packed: eight bytes and one per entry.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, begin = b.column("text").to_pylist(), 0
            sizes = np.cumsum([len(t) for t in texts])
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CHARACTERS)))
                at, para, cols, n = _counted(texts[begin:end])
                rows = b.select(["doc_id", "lang"]).take(pa.array(at + begin))
                yield pa.record_batch([*rows.columns, pa.array(para), cols, n], ["doc_id", "lang", "para", "cols", "n"])
                begin = end

    first = F.split(S.key("lang"), "_")[0]
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[first], first)
    full = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", code.alias("lang"), "text")
    return full.mapInArrow(run, f"doc_id {kind}, lang string, para int, cols binary, n binary")


def _entries(cols: pa.Array, n: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(where each row begins and the last ends, columns, counts) of packed rows."""
    unpack = lambda x: (np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1], x.buffers()[2])
    ends, data = unpack(cols.cast(pa.binary()))
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64) if len(ends) and ends[-1] > ends[0] else np.zeros(0, np.int64)
    if n is None:
        return (ends - ends[0]) // 8, values, None
    at, raw = unpack(n.cast(pa.binary()))
    return (ends - ends[0]) // 8, values, np.frombuffer(raw, np.uint8)[at[0] : at[-1]]


def column_weights(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(columns in order, weight of each) from a word's paragraph frequency in the language where it is most common.

    Counted over all paragraphs, combined map-side. Two numbers per distinct
    word reach the driver and the tasks, like H, whose size also grows with
    the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").dictionary_encode(null_encoding="encode")
            codes, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            ends, cols, _ = _entries(b.column("cols"))
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            fresh = np.r_[True, (row[1:] != row[:-1]) | (cols[1:] != cols[:-1])] if len(row) else np.zeros(0, bool)
            for k, name in enumerate(names):
                found, n = np.unique(cols[fresh & (codes[row] == k)], return_counts=True)
                size = int((codes == k).sum())
                yield pa.record_batch([pa.array([name] * (len(found) + 1), pa.string()), pa.array([*found.tolist(), None], pa.int64()), pa.array([*n.tolist(), size], pa.int64())], ["lang", "col", "n"])

    counts = checkpointed(terms.select("lang", "cols").mapInArrow(run, "lang string, col long, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")))
    sizes = counts.where("col IS NULL").select(F.col("lang").alias("l"), F.col("n").alias("size"))
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    share = counts.where("col IS NOT NULL").join(small(sizes), F.col("lang").eqNullSafe(F.col("l")))
    own = F.when(F.col("lang").isNotNull(), F.col("n") / F.greatest("size", F.lit(200)))
    rows = share.groupBy("col").agg(F.greatest(F.sum("n") / F.lit(max(200, whole)), F.max(own)).alias("f")).toPandas().sort_values("col")
    f = np.maximum(rows["f"].to_numpy(float), 1e-9)
    return rows["col"].to_numpy(np.int64), np.clip(np.log(COMMON / f) / np.log(COMMON / RARE), 0.02, 1.0).astype(np.float32)


class Paragraphs:
    """Rows of the matrix, laid out in blocks of about equal length (entry by row) for vectorised updates."""

    def __init__(self, ends: np.ndarray, j: np.ndarray, v: np.ndarray):
        sizes = np.diff(ends)
        room = np.where(sizes <= 64, -(-sizes // 4) * 4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        order = np.argsort(room, kind="stable")
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(order):
            length = int(room[order[begin]])
            end = min(int(np.searchsorted(room[order], length, "right")), begin + max(1, ENTRIES // max(1, length)))
            rows = order[begin:end]
            place = ends[rows][:, None] + np.arange(length)
            inside = place < ends[rows + 1][:, None]
            place = np.where(inside, place, 0)
            self.blocks.append((rows, j[place].T, np.where(inside, v[place], 0).astype(np.float32).T.copy()))
            begin = end
        self.count = len(sizes)


def factor_rows(rows: Paragraphs, w: np.ndarray, h: np.ndarray, prior: np.ndarray, rounds: int, mask: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
    """Multiplicative updates (Kullback-Leibler) of the rows ``w``, in place, with H fixed; the mass of each component in each row.

    With ``sums`` the component-term masses are added to it.
    """
    h32, masses = h.astype(np.float32), np.zeros(w.shape, np.float32)
    for at, j, v in rows.blocks:
        terms, own = h32[:, j], w[at].T.copy()
        allowed = mask[at].T if mask is not None else None
        for _ in range(rounds):
            used = own
            ratio = v / (np.einsum("klp,kp->lp", terms, used) + np.float32(1e-12))
            mass = used * np.einsum("klp,lp->kp", terms, ratio)
            own = mass + prior[:, None]
            if allowed is not None:
                own = own * allowed
            own = own / own.sum(0)
        w[at], masses[at] = own.T, mass.T
        if sums is not None:
            for k in range(len(h)):
                sums[k] += np.bincount(j.ravel(), (used[k] * ratio).ravel(), sums.shape[1]) * h[k]
    return masses


def filled(mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mass, share of the subjects' mass, whether it fills the paragraph) of the ``k`` subjects."""
    own = mass[:, :k].astype(float)
    share = own / np.maximum(own.sum(1, keepdims=True), 1e-9)
    return own, share, (share >= SHARE) & (own >= MASS) & (own >= FILL * mass.sum(1, keepdims=True))


def _normal(x: np.ndarray) -> np.ndarray:
    return ((x + 1e-4) / (x + 1e-4).sum(1, keepdims=True)).astype(np.float32)


def _prior(subjects: list[str]) -> np.ndarray:
    return np.r_[np.full(len(subjects), PRIOR), np.full(FREE, PRIOR_FREE)].astype(np.float32)


def anchors(ends: np.ndarray, j: np.ndarray, v: np.ndarray, labels: list[list[str]], subjects: list[str], columns: int) -> np.ndarray:
    """Component-term sums of the labelled sample: alternating updates with W masked by the labels.

    Few rounds are best: with many, a free component may take all terms of a
    subject in some language, depending on its random start.
    """
    k, m = len(subjects), len(subjects) + FREE
    rows, sizes = Paragraphs(ends, j, v), np.diff(ends)
    mask = np.full((len(sizes), m), DOUBT, np.float32)
    mask[:, k:] = 1.0
    where = {s: i for i, s in enumerate(subjects)}
    for r, names in enumerate(labels):
        mask[r, [where[s] for s in names if s in where]] = 1.0
    base = np.bincount(j, v, columns) + 1e-3
    h = np.empty((m, columns))
    for i in range(k):  # seeds: what the label's paragraphs have more often than all
        of = np.repeat(mask[:, i] == 1.0, sizes)
        own = np.bincount(j[of], v[of], columns) + 1e-3
        h[i] = own * (own / own.sum()) / (base / base.sum())
    h[k:] = base * np.random.default_rng(SEED).uniform(0.5, 1.5, (FREE, columns))
    h /= h.sum(1, keepdims=True)
    w, sums = mask / mask.sum(1, keepdims=True), h
    for _ in range(ANCHOR_ROUNDS):
        sums = np.zeros((m, columns))
        factor_rows(rows, w, h, _prior(subjects), 2, mask, sums)
        h = _normal(sums)
    return sums


class Model(NamedTuple):
    """Fitted subjects: names, columns in order with their weights, and H, a row of term shares per subject, then the free components."""

    subjects: list[str]
    columns: np.ndarray
    weights: np.ndarray
    h: np.ndarray

    def rows(self, b: pa.RecordBatch) -> Paragraphs:
        ends, cols, n = _entries(b.column("cols"), b.column("n"))
        j = np.searchsorted(self.columns, cols)
        return Paragraphs(ends, j, n * self.weights[j])

    def even(self, rows: Paragraphs) -> np.ndarray:
        return np.full((rows.count, len(self.h)), 1 / len(self.h), np.float32)


def fit_subjects(terms: DataFrame, labels: DataFrame, subjects: list[str], columns: np.ndarray, weights: np.ndarray) -> Model:
    """The model of the corpus ``terms`` (``term_rows``) with ``labels`` (``doc_id, subject``).

    The anchors come from at most LABELLED paragraphs of labelled documents,
    in one task. Then W and H are updated in turn over every paragraph of the
    corpus: each partition sums its share of H, the sums are added per term,
    and the anchors stay in as prior counts, until H stands still. Only H
    (components x vocabulary) reaches the driver and the tasks.
    """
    m, size = len(subjects) + FREE, len(columns)
    known = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    sample = terms.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "para").limit(LABELLED).select("cols", "n", "labels")

    def fit(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        ends, cols, n = _entries(b.column("cols"), b.column("n"))
        j = np.searchsorted(columns, cols)
        sums = anchors(ends, j, n * weights[j], b.column("labels").to_pylist(), subjects, size)
        return pa.table({"k": pa.array(range(m), pa.int32()), "h": pa.array(list(sums), pa.list_(pa.float64()))})

    anchored = np.zeros((m, size))
    for r in sample.groupBy(F.lit(1).alias("one")).applyInArrow(lambda t: fit(t), "k int, h array<double>").collect():
        anchored[r["k"]] = r["h"]
    h, names = _normal(anchored), [f"c{i}" for i in range(m)]
    for _ in range(MOST_PASSES):
        now = Model(subjects, columns, weights, h)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, size))
            for b in batches:
                if len(b):
                    rows = now.rows(b)  # noqa: B023
                    factor_rows(rows, now.even(rows), now.h, _prior(subjects), INNER, None, total)  # noqa: B023
            used = np.flatnonzero(total.sum(0) > 0)
            yield pa.record_batch([pa.array(used, pa.int32()), *[pa.array(total[i, used]) for i in range(m)]], ["col", *names])

        sums = terms.select("cols", "n").mapInArrow(step, "col int, " + ", ".join(f"{c} double" for c in names))
        got = sums.groupBy("col").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row per word at most
        fresh = np.zeros((m, size))
        fresh[:, got["col"].to_numpy(int)] = got[names].to_numpy(float).T
        h, before = _normal(fresh + ANCHOR * anchored), h
        if np.abs(h - before).sum(1).max() <= MOVED:
            break
    return Model(subjects, columns, weights, h)


def paragraph_subjects(terms: DataFrame, model: Model) -> DataFrame:
    """``doc_id, para, subject, share, mass, fills``: the subject mixture of every paragraph."""
    k, kind = len(model.subjects), terms.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.subjects, pa.string())
        for b in batches:
            if not len(b):
                continue
            rows = model.rows(b)
            mass = factor_rows(rows, model.even(rows), model.h, _prior(model.subjects), LAST_INNER)
            own, share, fills = filled(mass, k)
            r, c = np.nonzero((own > 1e-3) & ((share >= 0.05) | fills))
            out = b.select(["doc_id", "para"]).take(pa.array(r))
            yield pa.record_batch([*out.columns, names.take(pa.array(c)), pa.array(share[r, c]), pa.array(own[r, c]), pa.array(fills[r, c])], ["doc_id", "para", "subject", "share", "mass", "fills"])

    return terms.select("doc_id", "para", "cols", "n").mapInArrow(run, f"doc_id {kind}, para int, subject string, share double, mass double, fills boolean")


def subject_masses(terms: DataFrame, model: Model) -> DataFrame:
    """``subject, mass``: the term mass of each subject in all paragraphs, small shares too; each partition sends one row per subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.subjects))
        for b in batches:
            if len(b):
                rows = model.rows(b)
                total += factor_rows(rows, model.even(rows), model.h, _prior(model.subjects), LAST_INNER)[:, : len(total)].sum(0, float)
        yield pa.record_batch([pa.array(model.subjects, pa.string()), pa.array(total)], ["subject", "mass"])

    return terms.select("cols", "n").mapInArrow(run, "subject string, mass double").groupBy("subject").agg(F.sum("mass").alias("mass"))


def _fitted(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[DataFrame, Model] | None:
    """Matrix and model; None without areas, labels or words. The areas, a component each, are held by the driver."""
    areas = areas.select(S.word("subject").alias("subject")).where("subject IS NOT NULL").distinct()
    subjects = sorted(r["subject"] for r in areas.collect())
    labels = labels.select("doc_id", S.word("subject").alias("subject")).where("doc_id IS NOT NULL AND subject IS NOT NULL")
    if not subjects or not labels.limit(1).count():
        return None
    terms = checkpointed(term_rows(docs))
    columns, weights = column_weights(terms)
    return (terms, fit_subjects(terms, labels, subjects, columns, weights)) if len(columns) else None


def subject_mixtures(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Subject mixture of every paragraph of ``docs`` (``doc_id, text, lang``), without shares under 0.05.

    labels: ``doc_id, subject``; areas: ``subject`` (a fixed table of ten rows).

    Defined cases: null, empty and wordless texts have no subject; labels of
    unknown subjects or documents are ignored; repeated rows of a document
    count as often as they occur; without labels or areas nothing is assigned.
    """
    fitted = _fitted(docs, labels, areas)
    if fitted is None:
        return docs.select("doc_id", F.lit(0).alias("para"), F.lit("").alias("subject"), F.lit(0.0).alias("share"), F.lit(0.0).alias("mass"), F.lit(False).alias("fills")).limit(0)
    return paragraph_subjects(*fitted)


def subject_composition(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``subject, n_documents, share``: documents that a subject fills a paragraph of, and its share of the whole subject mass.

    Defined cases as of ``subject_mixtures``; a subject without mass has share 0.
    """
    fitted = _fitted(docs, labels, areas)
    if fitted is None:
        return docs.select(F.lit("").alias("subject"), F.lit(0).cast("long").alias("n_documents"), F.lit(0.0).alias("share")).limit(0)
    per = checkpointed(subject_masses(*fitted))
    filled = paragraph_subjects(*fitted).where("fills").groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))
    total = F.broadcast(per.agg(F.sum("mass").alias("total")))
    share = F.coalesce(F.try_divide("mass", "total"), F.lit(0.0))
    return per.join(F.broadcast(filled), "subject", "left").crossJoin(total).select("subject", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), share.alias("share"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)
    return t("documents").select("doc_id", "text", "lang"), t("subject_labels"), t("subject_areas")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the subjects that fill a paragraph of them."""
    return subject_mixtures(*_tables(spark, sf_dir)).where("fills").select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each subject in the corpus, by term mass, and its documents."""
    return subject_composition(*_tables(spark, sf_dir))
