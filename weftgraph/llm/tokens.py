"""Encoding of the whole corpus with a public byte-level BPE (problem 8).

The frequent words of the corpus - counted over all documents - are encoded once, on the
driver, and compiled into a minimal acyclic automaton: words with a common end share its
states, and the number of a word (the words before it in order, summed along its path)
leads to its ids.  The automaton, its ids and the merge ranks are one file of plain
arrays, which Spark hands to every executor and every Python worker memory-maps, so the
workers of a machine share one copy.

A task splits a batch of texts into words, walks all different words through the
automaton together, one byte position a step, and merges the words that are not in it
exactly (heap over the merge ranks, O(n log n), so a text without any break is no
problem).  The lexicon is a cache: its size and content never change a result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded
from weftgraph.core.shipping import put_shared

DEFAULT_DIR = "/opt/tokenizers"
#: Unicode White_Space, spelled out: libraries differ in what \s holds.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The public word pattern of the byte-level BPE vocabularies.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+"
)
#: The same for the JVM, whose \x85 and friends are written alike; it only picks the words to compile.
_JVM_WORDS = WORDS


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> id (its merge rank) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    if n > 1:
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            a = parts[i]
            if a is None or nxt[i] >= n:
                continue
            j = nxt[i]
            b = parts[j]
            if len(a) + len(b) != size or ranks.get(a + b) != r:
                continue
            parts[i], parts[j] = a + b, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                r = ranks.get(parts[i] + parts[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[k])))
            h = prv[i]
            if h >= 0:
                r = ranks.get(parts[h] + parts[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, len(parts[h]) + size))
    return [ranks[p] for p in parts if p is not None]


class Automaton:
    """Minimal acyclic automaton over sorted byte strings, with word numbers.

    Built incrementally: the part of the last word that a new one does not share can no
    longer change, so each of its states is replaced by an equal registered one.
    """

    def __init__(self, words: list[bytes]) -> None:
        self.final, self.edges = [False], [{}]
        self._register: dict[tuple, int] = {}
        self._open: list[tuple[int, int, int]] = []  # (state, byte, child) along the last word
        last = b""
        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            self._close(common)
            state = self._open[-1][2] if self._open else 0
            for byte in w[common:]:
                child = len(self.final)
                self.final.append(False)
                self.edges.append({})
                self.edges[state][byte] = child
                self._open.append((state, byte, child))
                state = child
            self.final[state] = True
            last = w
        self._close(0)

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            state, byte, child = self._open.pop()
            sign = (self.final[child], tuple(self.edges[child].items()))
            known = self._register.get(sign)
            if known is None:
                self._register[sign] = child
            else:
                self.edges[state][byte] = known

    def tables(self) -> dict[str, np.ndarray]:
        """Sorted transition keys (state * 256 + byte), their targets and the words they skip."""
        order, number = [], {}
        stack = [(0, iter(sorted(self.edges[0].items())))]
        seen = {0}
        while stack:  # children before parents
            state, it = stack[-1]
            child = next((c for _, c in it if c not in seen), None)
            if child is None:
                number[state] = len(order)
                order.append(state)
                stack.pop()
            else:
                seen.add(child)
                stack.append((child, iter(sorted(self.edges[child].items()))))
        size = len(order)
        words = np.zeros(size, np.int64)
        keys, targets, skips = [], [], []
        for state in order:
            i = number[state]
            total = int(self.final[state])
            for byte, child in sorted(self.edges[state].items()):
                keys.append(i * 256 + byte)
                targets.append(number[child])
                skips.append(total)
                total += int(words[number[child]])
            words[i] = total
        at = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
        pick = lambda x: np.array(x, np.int32)[at] if keys else np.zeros(0, np.int32)
        return {
            "key": np.array(keys, np.int64)[at] if keys else np.zeros(0, np.int64),
            "target": pick(targets), "skip": pick(skips),
            "final": np.array([self.final[s] for s in order], np.uint8), "root": np.array([number[0]], np.int32),
        }


def compile_lexicon(words: list[str], ranks: dict[bytes, int]) -> bytes:
    """One block of bytes: a JSON directory of arrays, then the arrays, 64-byte aligned."""
    encoded = sorted({w.encode() for w in words})
    arrays = Automaton(encoded).tables()
    ids = [merge(w, ranks) for w in encoded]
    arrays["ids"] = np.fromiter(chain.from_iterable(ids), np.int32)
    arrays["id_at"] = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int64)
    tokens = sorted(ranks, key=ranks.get)
    arrays["tok"] = np.frombuffer(b"".join(tokens), np.uint8)
    arrays["tok_at"] = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    arrays["tok_id"] = np.array([ranks[t] for t in tokens], np.int32)
    at, listed, parts = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 64)
        listed[name] = [str(a.dtype), at, len(a)]
        at += len(raw)
        parts.append(raw)
    head = json.dumps(listed).encode()
    head = len(head).to_bytes(8, "little") + head
    return head + b"\0" * (-len(head) % 64) + b"".join(parts)


class Encoder:
    """Encodes batches of texts by a memory-mapped lexicon."""

    LONGEST = 32  # bytes; longer words are merged
    CACHE = 200_000  # merged words a worker remembers

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        head = int.from_bytes(raw[:8].tobytes(), "little")
        base = 8 + head + (-(8 + head) % 64)
        self.a = {
            name: raw[base + at :][: n * np.dtype(kind).itemsize].view(kind)
            for name, (kind, at, n) in json.loads(raw[8 : 8 + head].tobytes()).items()
        }
        tok, at = self.a["tok"].tobytes(), self.a["tok_at"]
        self.ranks = {tok[at[i] : at[i + 1]]: int(r) for i, r in enumerate(self.a["tok_id"])}
        self.words = regex.compile(WORDS)
        self.cache: dict[bytes, np.ndarray] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The lexicon number of each word, -1 for words that are not in it."""
        a, n = self.a, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= self.LONGEST))
        if not len(live) or not len(a["key"]):
            return out
        width = int(size[live].max())
        chars = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in live), np.uint8).reshape(len(live), width)
        size, state, number = size[live], np.full(len(live), int(a["root"][0]), np.int64), np.zeros(len(live), np.int64)
        todo = np.arange(len(live))
        for p in range(width):
            todo = todo[size[todo] > p]
            key = state[todo] * 256 + chars[todo, p]
            hit = np.minimum(np.searchsorted(a["key"], key), len(a["key"]) - 1)
            found = a["key"][hit] == key
            todo, hit = todo[found], hit[found]
            state[todo] = a["target"][hit]
            number[todo] += a["skip"][hit]
            done = todo[size[todo] == p + 1]
            good = done[a["final"][state[done]] == 1]
            out[live[good]] = number[good]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids of each text); null and empty texts have none."""
        split = [self.words.findall(t) if t else [] for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        different = dict.fromkeys(flat)
        raw = [w.encode() for w in different]
        place = dict(zip(different, range(len(different))))
        codes = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        number = self.numbers(raw)
        start, size = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        known = number >= 0
        start[known] = self.a["id_at"][number[known]]
        size[known] = self.a["id_at"][number[known] + 1] - start[known]
        pool, at = [np.asarray(self.a["ids"])], len(self.a["ids"])
        for i in np.flatnonzero(~known):
            ids = self.cache.get(raw[i])
            if ids is None:
                ids = np.array(merge(raw[i], self.ranks), np.int32)
                if len(raw[i]) <= 64:
                    if len(self.cache) >= self.CACHE:
                        self.cache.clear()
                    self.cache[raw[i]] = ids
            start[i], size[i] = at, len(ids)
            pool.append(ids)
            at += len(ids)
        pool = np.concatenate(pool)
        lens = size[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(start[codes] - (ends - lens), lens)
        of_text = np.repeat(np.arange(len(texts)), n_words)
        per_text = np.bincount(of_text, weights=lens, minlength=len(texts)).astype(np.int64)
        return pool[where].astype(np.int32), per_text


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(SparkFiles.get(name))
    return _encoders[name]


def frequent_words(texts: DataFrame, text_col: str, size: int, least: int = 3) -> list[str]:
    """The `size` most frequent words of all texts (bounded: it is a parameter)."""
    words = (
        texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(_JVM_WORDS), 0)).alias("w"))
        .filter(F.octet_length("w") <= Encoder.LONGEST)
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        .orderBy(F.desc("n"), "w").limit(size)
    )
    return [r[0] for r in collect_bounded(words.select("w"), size, "lexicon")]


def ship_lexicon(spark: SparkSession, words: list[str], ranks: dict[bytes, int]) -> str:
    """Write the lexicon to the shared folder, hand it to all executors; returns its name there."""
    blob = compile_lexicon(words, ranks)
    name, path = put_shared(spark, "weft-lexicon", ".bin", blob)
    spark.sparkContext.addFile(path)
    return name


def prepare(docs: DataFrame, text_col: str = "text", tokenizer_dir: str = DEFAULT_DIR, tokenizer: str = "byte_bpe_50k", lexicon_size: int = 50_000) -> str:
    """Compile and ship the lexicon of a corpus; its name is what `encode` and `count_tokens` take."""
    ranks = read_ranks(f"{tokenizer_dir}/{tokenizer}.tiktoken")
    return ship_lexicon(docs.sparkSession, frequent_words(docs, text_col, lexicon_size), ranks)


def _batches(name: str, with_ids: bool, most_chars: int = 2_000_000):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(name)
        for part in parts:
            texts = part.column(part.num_columns - 1)
            size = np.array([len(t) if t else 0 for t in texts.to_pylist()], np.int64)
            # Very long texts: smaller slices, so memory follows characters, not rows.
            piece = np.cumsum(size) // most_chars
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), part.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                own = part.slice(a, b - a)
                ids, per_text = enc.encode(own.column(own.num_columns - 1).to_pylist())
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                else:
                    last = pa.array(per_text)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], last], names=[*own.schema.names[:-1], "ids" if with_ids else "n_tokens"])

    return run


def _run(docs: DataFrame, keep: list[str], text_col: str, name: str, with_ids: bool) -> DataFrame:
    own = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = dict(own.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return own.mapInArrow(_batches(name, with_ids), schema + (", ids array<int>" if with_ids else ", n_tokens bigint"))


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", lexicon: str | None = None, **options) -> DataFrame:
    """(keep..., ids ARRAY<INT>): one row for each row of `docs`.

    Null and empty texts have an empty list; blank texts are encoded as they are; strings
    that look like special tokens are ordinary text.  Repeated rows are encoded alike.
    `lexicon`: what `prepare` returned, else it is prepared from `docs` (`options`).
    Columns outside `keep` are left out, whatever their names.
    """
    return _run(docs, keep, text_col, lexicon or prepare(docs, text_col, **options), True)


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", lexicon: str | None = None, **options) -> DataFrame:
    """(keep..., n_tokens): as `encode`, but only the number of ids (0 for null and empty texts)."""
    return _run(docs, keep, text_col, lexicon or prepare(docs, text_col, **options), False)
