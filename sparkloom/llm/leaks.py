"""Evaluation texts leaking into a corpus: latent semantic retrieval, then exact checks.

1. Texts are normalised to words and cut into passages of 2 * STEP words, STEP apart, so that any run of STEP + 1
   words or fewer lies within one passage.
2. Passages are weighted by TF-IDF (the inverse frequency squared) over the vocabulary of the test items; document frequencies are counted over
   every document of the corpus.
3. A randomised SVD of the test passages' matrix, with its products computed over partitions, gives the latent space.
4. Every passage of every document is folded in and compared with every test passage (a stated query set, in blocks
   of items); pairs with a cosine of at least ``near`` are candidates, and so are passages that hold
   a run of the item, looked up among all runs whatever their cosine.
5. A candidate counts as verbatim if it holds ``run`` consecutive words of the item, else as a paraphrase if the
   longest common subsequence covers ``share`` of the test passage and the document holds the item's answer.

Test items are the query side: they are read to the driver in blocks of BLOCK items, which bounds what is shipped to
the executors; the corpus is scanned once per block.

Defined results: null or wordless documents and items give no pair, nor do items shorter than ``run`` words (as
verbatim); repeated rows count once; an item without an answer can leak only verbatim; empty tables give no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import parallelism
from sparkloom.llm.normalise import words

STEP, BLOCK, RANK, SEED = 15, 2000, 256, 7

_TIME = r"\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
_TIMECODE = re.compile(rf"[<\[({{]?(?<![\w:]){_TIME}(?![\w:])(?:\s*-->\s*{_TIME})?[>\])}}]?|[<\[(]\d{{1,6}}(?:\.\d+)?\s?s[>\])]")


def text_words(text: str) -> list[str]:
    """Folded words; markup, entities, timecodes, invisible characters and layout do not count."""
    if "&" in text:
        text = html.unescape(text)
    if ":" in text or "s]" in text or "s)" in text:
        text = _TIMECODE.sub(" ", text)
    return words(text)


class Space:
    """Vocabulary with weights, latent basis, and the test passages in it. Shipped to the executors."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], run: int):
        self.items, self.run = items, run
        vocabulary = sorted({w for _, t, _ in items for w in t})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.weight = np.ones(len(vocabulary), np.float32)
        self.basis: np.ndarray | None = None
        self.passages: list[tuple[int, int, int]] = []  # (item index, first word, end)
        for n, (_, t, _) in enumerate(items):
            for a in range(0, max(1, len(t) - STEP), STEP):
                self.passages.append((n, a, min(a + 2 * STEP, len(t))))
        self.runs = [frozenset(tuple(t[k : k + run]) for k in range(len(t) - run + 1)) for _, t, _ in items]
        self.latent: np.ndarray | None = None

    def rows(self, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and TF-IDF weights of unit length."""
        i, n = np.unique(np.array([t for t in tokens if t >= 0], np.int64), return_counts=True)
        w = n * self.weight[i]
        size = np.sqrt((w * w).sum())
        return i, (w / size if size else w).astype(np.float32)

    def fold(self, table: np.ndarray, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Latent unit vectors of all passages of the texts, with text number and first word."""
        none = len(table)  # stands for a word outside the vocabulary, and fills up blocks
        owner, first, rows, base = [], [], [], 0
        for n, t in enumerate(texts):
            count = max(1, -(-len(t) // STEP))
            last = max(1, count - 1)
            owner += [n] * last
            first += range(base, base + last)
            rows += [self.ids.get(w, none) for w in t]
            rows += [none] * ((count + 1) * STEP - len(t))  # an empty block ends each text, so that the last passage may reach over it
            base += count + 1
        words_ = np.array(rows, np.int64).reshape(-1, STEP)
        table = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
        sums = np.zeros((base + 1, table.shape[1]), np.float32)
        for a in range(0, base, 512):  # a word of each block at a time, blocks few enough for the cache
            part = words_[a : a + 512]
            for k in range(STEP):
                held = np.flatnonzero(part[:, k] < none)
                sums[a + held] += table[part[held, k]]
        at = np.array(first, np.int64)
        z = sums[at] + sums[at + 1]
        size = np.sqrt((z * z).sum(1))
        z /= np.maximum(size, 1e-9)[:, None]
        start = np.zeros(len(at), np.int64)
        if len(at):
            own = np.array(owner)
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            start = (np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))) * STEP
        return z, np.array(owner, np.int64), start


def frequencies(docs: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary occurs, and the number of documents."""
    size, sent = len(space.ids), docs.sparkSession.sparkContext.broadcast(space.ids)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = sent.value
        total, n = np.zeros(size, np.int64), 0
        for f in frames:
            for body in f["body"]:
                seen = {ids[w] for w in set(text_words(body)) if w in ids}
                total[list(seen)] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": np.append(at, -1), "n": np.append(total[at], n)})

    out, n = np.zeros(size, np.int64), 0
    for r in docs.mapInPandas(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        if r["id"] < 0:
            n = r["n"]
        else:
            out[r["id"]] = r["n"]
    return out, n


def randomised_svd(rows: DataFrame, dim: int, rank: int, rounds: int = 3, seed: int = SEED) -> np.ndarray:
    """The leading right singular vectors (dim x rank) of a sparse matrix given as rows (ids, weights).

    Subspace iteration on a random start: each round every partition multiplies its rows by the current basis and back,
    the partial products are summed per block of features, and the sum is orthonormalised.
    """
    width = min(dim, rank + 16)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0].astype(np.float32)
    step = max(1, (1 << 20) // (4 * width))
    for _ in range(rounds + 1):

        def product(frames: Iterator[pd.DataFrame], q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            part = np.zeros((dim, width), np.float32)
            for f in frames:
                for i, w in zip(f["ids"], f["weights"]):
                    i, w = np.asarray(i, np.int64), np.asarray(w, np.float32)
                    part[i] += np.outer(w, w @ q[i])
            yield pd.DataFrame([(a, part[a : a + step].tobytes()) for a in range(0, dim, step) if part[a : a + step].any()], columns=["at", "part"])

        def add(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": f["at"][:1], "part": [sum(np.frombuffer(x, np.float32) for x in f["part"]).tobytes()]})

        y = np.zeros((dim, width), np.float32)
        # One dense block of features a row: together the basis, dim x width numbers.
        for r in rows.mapInPandas(product, "at int, part binary").groupBy("at").applyInPandas(add, "at int, part binary").toLocalIterator():
            block = np.frombuffer(r["part"], np.float32).reshape(-1, width)
            y[r["at"] : r["at"] + len(block)] = block
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        top = q @ turn[:, ::-1][:, :rank]
        q = np.linalg.qr(y)[0].astype(np.float32)
    keep = values[::-1][:rank] > 1e-6 * max(values.max(initial=0), 1e-12)
    return np.ascontiguousarray(top[:, keep], np.float32)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


PAIR = "doc_id bigint, item_id bigint, cosine double, kind string, first_word bigint"


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, run: int = 15, near: float = 0.6, share: float = 0.6, rank: int = RANK, every: bool = False) -> DataFrame:
    """Pairs doc_id, item_id with the best cosine, kind (verbatim, paraphrase; with ``every`` also candidate) and the
    first word of the best passage. ``items``: item_id, text, answer."""
    if run > STEP + 1:
        raise ValueError(f"passages hold runs of up to {STEP + 1} words")
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("body")).where("doc_id is not null and body <> ''")
    src = src.repartition(parallelism(spark))
    listed = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min(F.struct("text", "answer")).alias("s")).orderBy("item_id")
    out = None
    block: list = []
    for r in listed.toLocalIterator():  # the stated query set, a block at a time
        t = text_words(r["s"]["text"])
        if t:
            block.append((r["item_id"], t, text_words(r["s"]["answer"] or "")))
        if len(block) == BLOCK:
            part = _leaks_of(src, block, run, near, share, rank, every)
            out, block = part if out is None else out.unionByName(part), []
    if block:
        part = _leaks_of(src, block, run, near, share, rank, every)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], PAIR) if out is None else out


def _leaks_of(src: DataFrame, items: list, run: int, near: float, share: float, rank: int, every: bool) -> DataFrame:
    spark = src.sparkSession
    space = Space(items, run)
    count, total = frequencies(src, space)
    # Squared: what tells passages apart are the rare words, not the frame of the sentence.
    space.weight = (np.log((total + 1) / (count + 0.5)).clip(0.01) ** 2).astype(np.float32)
    matrix = [space.rows([space.ids[w] for w in items[n][1][a:b]]) for n, a, b in space.passages]
    rows = spark.createDataFrame([(i.tolist(), w.tolist()) for i, w in matrix], "ids array<int>, weights array<float>")
    space.basis = randomised_svd(rows, len(space.ids), rank)
    table = space.weight[:, None] * space.basis
    e = np.stack([w @ space.basis[i] for i, w in matrix])
    e /= np.maximum(np.linalg.norm(e, axis=1), 1e-9)[:, None]
    item_of = np.array([n for n, _, _ in space.passages])

    grams: dict[tuple[str, ...], list[int]] = {}
    for n, held in enumerate(space.runs):
        for g in held:
            grams.setdefault(g, []).append(n)

    # Sent once to each executor, not with each task.
    sent = spark.sparkContext.broadcast((space, table, e, item_of, grams))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, table, e, item_of, grams = sent.value
        items = space.items
        for f in frames:
            keys, bodies = f["doc_id"].tolist(), f["body"].tolist()
            found = []
            for a in range(0, len(keys), 256):
                texts = [text_words(b) for b in bodies[a : a + 256]]
                z, owner, start = space.fold(table, texts)
                for d, t in enumerate(texts):
                    # A run of an item is a run of words that all occur in items.
                    strange = np.cumsum([0, *(w not in space.ids for w in t)])
                    within = np.flatnonzero(strange[run:] == strange[:-run]) if len(t) >= run else ()
                    held = {(k // STEP, n) for k in within for n in grams.get(tuple(t[k : k + run]), ())}
                    if held:
                        lo, hi = np.searchsorted(owner, [d, d + 1])
                        for x, n in held:
                            x = min(lo + x, hi - 1)
                            found.append((keys[a + d], items[n][0], float((e[item_of == n] @ z[x]).max()), "verbatim", int(start[x])))
                for c in range(0, len(z), 2048):
                    sim = z[c : c + 2048] @ e.T
                    p, q = np.nonzero(sim >= near)
                    best: dict[tuple[int, int], list] = {}
                    for x, y, s in zip(p + c, q, sim[p, q]):
                        best.setdefault((x, item_of[y]), []).append((float(s), int(y)))
                    for (x, n), hits in best.items():
                        n = int(n)
                        t, at = texts[owner[x]], int(start[x])
                        window = t[at : at + 2 * STEP]
                        s, y = max(hits)
                        kind = "candidate"
                        if any(tuple(window[k : k + run]) in space.runs[n] for k in range(len(window) - run + 1)):
                            kind = "verbatim"
                        elif items[n][2]:
                            _, b0, b1 = space.passages[y]
                            test = items[n][1][b0:b1]
                            if len(test) >= STEP and lcs(window, test) >= share * len(test) and f" {' '.join(items[n][2])} " in f" {' '.join(t)} ":
                                kind = "paraphrase"
                        if every or kind != "candidate":
                            found.append((keys[a + owner[x]], items[n][0], s, kind, at))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "kind", "first_word"])

    pairs = src.mapInPandas(search, PAIR)
    best = F.max(F.struct((F.col("kind") == "verbatim").alias("v"), (F.col("kind") == "paraphrase").alias("p"), "cosine", "kind", (-F.col("first_word")).alias("w"))).alias("b")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.kind").alias("kind"), (-F.col("b.w")).alias("first_word"))
