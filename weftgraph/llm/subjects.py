"""Subject area of each document (problem 10), by anchored non-negative factorisation.

1. Texts become prose sentences (code, log lines, headings, greetings and signatures are
   left out) and sentences become terms: words and pairs of neighbouring words (runs of
   characters where a script has no spaces).
2. The document-term matrix X is factored as X ~ W H under the Kullback-Leibler
   divergence by alternating multiplicative updates.  Each language (of the seeds) has a
   component for each subject and one for what all its documents share, and a document
   uses the components of the language that explains its terms best.  Terms that the seed
   texts give to one subject anchor its component: they start H, and go on weighing in
   each update with a share of the component's mass; a term that keeps their company
   moves to their component.  H is renewed after each batch of documents, from the latest
   sums of all batches, so that two passes over all documents do the work of many more.
   W is solved inside the tasks; what leaves a task is its sums for H, at most one row a
   term and language.
3. Then each sentence is a row: its W, solved with H fixed, is its mixture.  A sentence deals
   with its main subject if that has at least `sure` of the mixture, and a document has the
   subjects that reach `share` of its sentences.

Everything covers all documents: term counts, the fit, and the assignment.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, discard, spread, store

_END = re.compile(r"(?<=[.?!])[\"')\]]*(?:\s+|$)|(?<=[。？！])|(?<=[?!])(?=[぀-ヿ㐀-鿿豈-﫿])")
_ENDED = re.compile(r"[.?!。？！][\"')\]]*$")
_MARKS = frozenset("=_{}[]<>|")  # of code
_CALL = re.compile(r"\w\(")
_KEYWORDS = frozenset(("def", "class", "import", "from", "return", "pip"))
_LOG = re.compile(r"\W*(?:\d{1,2}:\d\d(?::\d\d)?\b|\w+=[-+.\d]+)")  # a value inside a line is code of its sentence
_TRACE = re.compile(r"\s*(?:traceback\b|file \"|\w*(?:error|exception)\s*:)", re.I)
_LEAD = re.compile(r"(?:[\s>#*+\-•]+|\d+[.)]\s+|r?\"{3}|r?'{3}|@\w+[\s:>]*)+")
_SPEAKER = re.compile(r"[^\W\d]{2,20}\s?[:：]\s*")
_OPENINGS = frozenset("hi hello hey dear hallo danke hola gracias saludos regards cheers".split())  # words a greeting starts with
_GREETING = re.compile(r"\bthanks\b|\bthank you\b|^vielen dank\b", re.I)
_GREETING_WIDE = ("谢谢", "你好", "大家好")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]+")
_FIRST = re.compile(r"\w+")


def _bare(s: str) -> str:
    """Without leading markers, numbering and a speaker's name."""
    if s and not s[0].isalpha() or s.startswith(("r'", 'r"')):
        m = _LEAD.match(s)
        s = s[m.end() :] if m else s
    if ":" in s[:23] or "：" in s[:23]:
        m = _SPEAKER.match(s)
        s = s[m.end() :] if m else s
    return s


def _is_code(s: str) -> bool:
    if not _MARKS.isdisjoint(s) or s.rstrip().endswith(";") or "(" in s and _CALL.search(s):
        return True
    first = s.split(None, 1)
    return len(first) == 2 and first[0].lower() in _KEYWORDS


def _is_greeting(s: str) -> bool:
    first = _FIRST.match(s)
    low = s.lower()
    return bool(first) and first[0].lower() in _OPENINGS or ("thank" in low or "dank" in low) and bool(_GREETING.search(s)) or not s.isascii() and any(w in s for w in _GREETING_WIDE)


def prose(text: str | None) -> list[str]:
    """The prose sentences of a text, without markers, numbering and speakers' names."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n")).replace("​", "").replace("﻿", "")
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    out, fenced, trace = [], False, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if not bare:
            trace = False
            continue
        if (":" in bare or bare[:9].lower() == "traceback" or bare[:4].lower() == "file") and _TRACE.match(bare):
            trace = True
        if fenced or trace or ("=" in bare or ":" in bare) and _LOG.match(bare):
            continue
        for s in _END.split(_bare(bare)):
            s = _bare(s.strip())
            if not s or _is_greeting(s) or _is_code(s):
                continue
            words = min(len(_WORD.findall(s)), len(s.split()))  # letters within one long code are no words
            wide = 0 if s.isascii() else sum(map(len, _CJK.findall(s)))
            if wide >= 4 or words >= (3 if _ENDED.search(s) else 6):
                out.append(s)
    return out


WORD, PAIR = 0, 1  # kinds of terms, in the last two bits of their keys


def _key(term: str, kind: int) -> int:
    return (xxhash.xxh64_intdigest(term.encode()) >> 3 << 2) | kind


_DIGITS = re.compile(r"\d+")


@lru_cache(50_000)  # forms recur
def _word(w: str) -> int:
    return _key(w, WORD)


@lru_cache(50_000)
def _pair(a: str, b: str) -> int:
    return _key(f"{a} {b}", PAIR)


def terms(sentence: str) -> np.ndarray:
    """Keys of a sentence's terms: words and pairs of neighbouring words.  Numbers are all alike."""
    return _terms(_DIGITS.sub("9", sentence.lower()))


@lru_cache(50_000)
def _terms(flat: str) -> np.ndarray:
    if not flat.isascii():
        flat = "".join(c for c in unicodedata.normalize("NFKD", flat) if not unicodedata.combining(c))
        words = _WORD.findall(_CJK.sub(" ", flat))
    else:
        words = _WORD.findall(flat)
    out = [_word(w) for w in words if len(w) > 1]
    out += map(_pair, words, words[1:])
    if not flat.isascii():
        for run in _CJK.findall(flat):
            for n in (2, 3):
                out += [_word(run[i : i + n]) for i in range(len(run) - n + 1)]
    return np.array(out, np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _numbers(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the lists' lengths."""
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, t: keys of all sentences, n: how many each sentence has)."""
    none = np.zeros(0, np.int64)
    for batch in parts:
        keys, sizes, many = [none], [none], []
        for text in batch.column(1).to_pylist():
            each = [terms(s) for s in prose(text)]
            keys += each
            sizes.append(np.array([len(t) for t in each], np.int64))
            many.append(len(each))
        n = np.concatenate(sizes)
        of_doc = np.add.reduceat(np.append(n, 0), np.cumsum([0, *many])[:-1]) * (np.array(many) > 0) if many else none
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _lists(np.concatenate(keys), of_doc, pa.int64()), _lists(n, np.array(many, np.int64), pa.int32())], ["doc_id", "t", "n"]
        )


@dataclass
class Model:
    """keys: sorted term keys; h: languages x (subjects + 1) x terms, each component summing to 1."""

    keys: np.ndarray
    idf: np.ndarray
    subjects: list[str]
    languages: np.ndarray  # languages x terms: log of a language's term rates in the seeds
    h: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def solve_block(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, counts: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """W of n documents given H, and what each entry adds to H's numerators.

    h: components x terms.  Entries are sorted by document; every document has some.
    """
    own = np.ascontiguousarray(h.T[ids])  # entries x components
    starts = np.searchsorted(doc, np.arange(n))
    w = np.repeat((np.add.reduceat(counts, starts) / len(h))[:, None], len(h), 1)
    for _ in range(rounds):
        rate = counts / np.maximum(np.einsum("ek,ek->e", own, w[doc]), 1e-30)
        w = w * np.add.reduceat(own * rate[:, None], starts, axis=0)
    part = own * w[doc]
    return w, part * (counts / np.maximum(part.sum(1), 1e-30))[:, None]


def _code(model_cast, understood: float):
    """(doc_id, t, n, b) -> (doc_id, lang, ids: known terms of all sentences, n: how many each sentence has, b).

    A sentence of which less than `understood` of its terms are known counts as having none.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_cast.value
        for batch in parts:
            (t, of_doc), (n, many) = _numbers(batch.column(1)), _numbers(batch.column(2))
            doc, sentence = np.repeat(np.arange(len(of_doc)), of_doc), np.repeat(np.arange(len(n)), n)
            at = model.find(t)
            known = at >= 0
            known &= (np.bincount(sentence[known], minlength=len(n)) >= understood * n)[sentence]
            at, doc, sentence = at[known], doc[known], sentence[known]
            spoken = [np.bincount(doc, weights=rates[at], minlength=len(of_doc)) for rates in model.languages]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.argmax(spoken, axis=0).astype(np.int32)), _lists(at, np.bincount(doc, minlength=len(of_doc)), pa.int32()),
                 _lists(np.bincount(sentence, minlength=len(n)), many, pa.int32()), batch.column(3)],
                ["doc_id", "lang", "ids", "n", "b"],
            )

    return run


def _sums(h_cast, idf_cast, rounds: int):
    """One pass of W updates: (lang, term, one sum a component)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, idf = h_cast.value, idf_cast.value  # single precision: half the memory traffic
        languages, k, v = h.shape
        total = np.zeros((languages, k, v))
        for batch in parts:
            lang = batch.column(0).to_numpy()
            ids, sizes = _numbers(batch.column(1))
            ends = np.cumsum(sizes)
            for a in range(0, len(lang), 512):  # fits the processor's cache
                part = slice(a, a + 512)
                own = ids[ends[a] - sizes[a] : ends[part][-1]].astype(np.int64)
                doc = np.repeat(np.arange(len(sizes[part])), sizes[part])
                entry, count = np.unique(doc * v + own, return_counts=True)
                doc, own = entry // v, entry % v
                count = (count * idf[own]).astype(np.float32)
                of = lang[part][doc]
                for tongue in np.unique(of):
                    pick = of == tongue
                    there, row = np.unique(doc[pick], return_inverse=True)
                    _, share = solve_block(h[tongue], row, own[pick], count[pick], len(there), rounds)
                    for c in range(k):
                        total[tongue, c] += np.bincount(own[pick], weights=share[:, c], minlength=v)
        lang, term = np.nonzero(total.sum(1))
        out = {"lang": lang.astype(np.int32), "term": term.astype(np.int32)}
        yield pa.RecordBatch.from_pydict(out | {f"c{c}": total[lang, c, term] for c in range(k)})

    return run


def _gather(df: DataFrame, h: np.ndarray, idf_cast, rounds: int) -> np.ndarray:
    languages, k, v = h.shape
    # Bounded by the vocabulary: languages x subjects x terms.
    h_cast = df.sparkSession.sparkContext.broadcast(h.astype(np.float32))
    columns = [f"c{c}" for c in range(k)]
    rows = (
        df.select("lang", "ids").mapInArrow(_sums(h_cast, idf_cast, rounds), "lang int, term int, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("lang", "term").agg(*[F.sum(c).alias(c) for c in columns]).limit(languages * v + 1).toArrow()
    )
    out = np.zeros(h.shape, np.float32)
    at = rows["lang"].to_numpy(), rows["term"].to_numpy()
    for c in range(k):
        out[at[0], c, at[1]] = rows[f"c{c}"].to_numpy()
    h_cast.destroy()
    return out


def _vocabulary(split: DataFrame, least: int, max_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their document counts) of the terms in at least `least` documents."""
    counted = (
        split.select(F.explode(F.array_distinct("t")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") >= least).limit(max_terms + 1).toArrow()
    )
    keys, df = counted["t"].to_numpy(), counted["df"].to_numpy()
    if len(keys) > max_terms:
        raise ValueError(f"vocabulary: more than {max_terms} terms; raise term_share")
    order = np.argsort(keys)
    return keys[order], df[order]


def seed_model(
    keys: np.ndarray, df: np.ndarray, n_docs: int, seeds: list[tuple[str, str, str]], subjects: list[str], pure: float = 0.8, broad: float = 0.2
) -> tuple[Model, np.ndarray]:
    """(model without h, anchors: languages x subjects x terms).

    A term that the seeds of a language give to one subject (at least `pure` of its rate), in two of
    the subject's seeds and a share `broad` of them at least, is its anchor.
    """
    tongues = sorted({lang for _, lang, _ in seeds})
    counts = np.zeros((len(tongues), len(subjects), len(keys)))
    within, given = np.zeros(counts.shape), np.zeros(counts.shape[:2])  # seeds with a term, and all
    model = Model(keys, np.log(1 + n_docs / np.maximum(df, 1)), subjects, np.zeros((len(tongues), len(keys))), np.zeros(0))
    for subject, lang, text in seeds:
        at = model.find(np.concatenate([np.zeros(0, np.int64), *[terms(s) for s in prose(text)]]))
        to = tongues.index(lang), subjects.index(subject)
        np.add.at(counts[to], at[at >= 0], 1)
        within[to][np.unique(at[at >= 0])] += 1
        given[to] += 1
    spoken = counts.sum(1)
    model.languages = np.log(spoken / np.maximum(spoken.sum(1, keepdims=True), 1) + 1e-6)
    rate = counts / np.maximum(counts.sum(2, keepdims=True), 1)
    purity = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
    anchors = np.where((purity >= pure) & (within >= np.maximum(2, broad * given)[:, :, None]), counts, 0) * model.idf
    return model, anchors / np.maximum(anchors.sum(2, keepdims=True), 1e-9)


def fit_topics(
    coded: DataFrame, model: Model, anchors: np.ndarray, batches: int, passes: int = 2, anchor: float = 0.1, decay: float = 0.3, rounds: int = 5
) -> None:
    """Set model.h.  `coded` has the batch of each document in column b, 0 to batches - 1."""
    languages, k, v = anchors.shape
    idf_cast = coded.sparkSession.sparkContext.broadcast(model.idf.astype(np.float32))
    flat = np.full((languages, 1, v), 1 / v)
    corpus = _gather(coded, flat, idf_cast, 0) + 1e-9
    base = corpus / corpus.sum(2, keepdims=True)
    h = np.concatenate([0.95 * anchors + 0.05 * base, base], axis=1)
    h /= h.sum(2, keepdims=True)
    held, total = [0.0] * batches, 0.0
    for turn in range(passes):
        # Anchors found by chance lose their hold pass by pass; true ones keep their company.
        weight = anchor * decay**turn
        for b in range(batches):
            # The batch's sums take the place of those of the pass before.
            sums = _gather(coded.filter(F.col("b") == b), h, idf_cast, rounds)
            total = total + sums - held[b]
            held[b] = sums
            mass = total.sum(2, keepdims=True) + 1e-9
            new = np.maximum(total, 0) + 1e-9 + 0.002 * mass * base
            new[:, :k] += weight * mass[:, :k] * anchors
            h = new / new.sum(2, keepdims=True)
    model.h = h


def _assign(model_cast, share: float, sure: float, rounds: int):
    """(doc_id, lang, ids, n) -> (doc_id, subject, part)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_cast.value
        h, idf = model.h.astype(np.float32), model.idf.astype(np.float32)
        k = len(model.subjects)
        for batch in parts:
            lang = batch.column(1).to_numpy()
            (ids, _), (n, many) = _numbers(batch.column(2)), _numbers(batch.column(3))
            doc, ends = np.repeat(np.arange(len(many)), many), np.cumsum(n)
            of = np.zeros((len(many), k))
            for a in range(0, len(n), 4096):
                part = slice(a, a + 4096)
                own = ids[ends[a] - n[a] : ends[part][-1]]
                row = np.repeat(np.arange(len(n[part])), n[part])
                tongue = lang[doc[part]][row]
                for t in np.unique(tongue):
                    pick = tongue == t
                    there, of_row = np.unique(row[pick], return_inverse=True)
                    w, _ = solve_block(h[t], of_row, own[pick], idf[own[pick]], len(there), rounds)
                    best = w[:, :k].argmax(1)
                    clear = w[np.arange(len(w)), best] >= sure * w.sum(1)
                    np.add.at(of, (doc[part][there[clear]], best[clear]), 1)
            of /= np.maximum(many, 1)[:, None]
            at, subject = np.nonzero(of >= share - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([model.subjects[s] for s in subject], pa.string()), pa.array(of[at, subject])],
                ["doc_id", "subject", "part"],
            )

    return run


def subject_areas(
    docs: DataFrame,
    seeds: DataFrame,
    subjects: DataFrame,
    share: float = 0.2,
    sure: float = 0.15,
    understood: float = 0.1,
    min_docs: int = 5,
    term_share: float = 2e-5,
    batches: int = 8,
    max_terms: int = 1_000_000,
    max_seeds: int = 100_000,
) -> DataFrame:
    """(doc_id, subject, part): each subject with at least `share` of a document's prose sentences.

    part is that share.  Null, empty and blank texts and texts without prose have no rows, as
    have texts of which no subject reaches `share`; null doc_ids are left out; repeated rows of
    a document give one row a subject.  Seeds with a null field or a subject outside `subjects`
    are ignored; without usable seeds, or without documents, there are no rows.

    `min_docs`, `term_share`: a term is known if it is in `min_docs` documents and in this share
    of them.  As a document has so many terms, the share bounds the vocabulary (what is broadcast
    and what the driver holds) whatever the corpus; more than `max_terms` raise an error.
    `sure`: part of a sentence's mixture from which it deals with its main subject.
    `understood`: part of a sentence's terms that must be known; else it is prose without subject.
    `batches`: parts of the corpus after each of which the components are renewed.
    """
    spark = docs.sparkSession
    names = sorted({r[0] for r in collect_bounded(subjects.select("subject").filter("subject is not null"), max_seeds, "subjects")})
    given = collect_bounded(seeds.select("subject", "lang", "text").na.drop(), max_seeds, "subject_seeds")
    given = [(r[0], r[1], r[2]) for r in given if r[0] in names]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = spread(own.filter("doc_id is not null and text is not null"))
    split, keys_at = store(own.mapInArrow(_split, "doc_id bigint, t array<bigint>, n array<int>").filter(F.size("n") > 0))
    n_docs = split.count()
    keys, df = _vocabulary(split, max(min_docs, math.ceil(term_share * n_docs)), max_terms)
    if not len(keys) or not given:
        discard(spark, keys_at)
        return spark.createDataFrame([], "doc_id bigint, subject string, part double")
    model, anchors = seed_model(keys, df, n_docs, given, names)
    cast = spark.sparkContext.broadcast(model)
    numbered = split.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    coded, _ = store(numbered.mapInArrow(_code(cast, understood), "doc_id bigint, lang int, ids array<int>, n array<int>, b int"), "b")
    discard(spark, keys_at)
    fit_topics(coded, model, anchors, batches)
    fitted = spark.sparkContext.broadcast(model)
    found = coded.select("doc_id", "lang", "ids", "n").mapInArrow(_assign(fitted, share, sure, 5), "doc_id bigint, subject string, part double")
    return found.dropDuplicates(["doc_id", "subject"])
