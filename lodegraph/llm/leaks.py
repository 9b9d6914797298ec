"""Evaluation texts leaking into a corpus, by the q-gram lemma.

Two stretches of length L within k edits share at least L - q + 1 - k q
character q-grams, all on neighbouring diagonals.  Texts are reduced to their
words, lower-cased and joined by one space.  The q-grams of a block of items
are an index of bounded size; every document, read whole, looks its q-grams up,
counts hits in overlapping diagonal bands and keeps the stretches that reach
the bound.  A banded alignment verifies what is left: from each run of hits on
one diagonal it goes on to both sides, over the 2 k + 1 diagonals around it, as
far as the edits reach.  For k = 0 the whole words inside the aligned stretch
are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import ship

#: Fixed value: a word is a maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: Characters of items that one block's index may hold; more items make more blocks, each a pass over the corpus.
BLOCK_CHARS = 4_000_000
#: Characters of documents that are looked up at once.
CHUNK_CHARS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text without regard to letter case."""
    return [w.casefold() for w in WORD.findall(text)] if text else []


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    for j in range(q):
        h = (h ^ wide[j : j + n]) * _PRIME
        h ^= h >> np.uint64(29)
    return h


class Index:
    """The q-grams of some items, sorted by hash, with their item and place."""

    def __init__(self, items: list[tuple[object, str]], q: int, least_words: int = 12):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.texts = [" ".join(w) for w in self.words]
        parts = [_grams(_codes(w), q) for w in self.words]
        self.gram = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.item = np.concatenate([np.full(len(p), i, np.int64) for i, p in enumerate(parts)]) if parts else np.empty(0, np.int64)
        self.place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.starts = [_starts(w) for w in self.words]
        self.length = np.array([shortest(w, least_words) for w in self.words] or [0], np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = np.searchsorted(self.gram, grams, "left")
        at = np.flatnonzero((lo < len(self.gram)) & (self.gram[np.minimum(lo, len(self.gram) - 1)] == grams)) if len(self.gram) else np.empty(0, np.int64)
        if not len(at):
            z = np.empty(0, np.int64)
            return z, z, z
        lo = lo[at]
        n = np.searchsorted(self.gram, grams[at], "right") - lo
        rep = np.repeat(np.arange(len(at)), n)
        post = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        return at[rep], self.item[post], self.place[post]


def _starts(words: list[str]) -> np.ndarray:
    return np.cumsum([0, *[len(w) + 1 for w in words]])[:-1] if words else np.empty(0, np.int64)


def shortest(words: list[str], least_words: int) -> int:
    """Characters of the shortest run of so many words; 0 if there is none."""
    if len(words) < least_words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    from_ = np.concatenate([[0], ends])[: len(ends) - least_words + 1]
    return int((ends[least_words - 1 :] - from_).min()) - 1


def bands(doc: np.ndarray, pos: np.ndarray, item: np.ndarray, place: np.ndarray, length: np.ndarray, q: int, k: int) -> list[tuple[int, int, int, int]]:
    """(document, item, position in the document, in the item) of one hit of each run of hits in stretches whose band reaches the lemma's bound.

    ``length`` is the least length of a passage, by item (0: too short an item).
    A run is hits on one diagonal at consecutive positions: an alignment through
    any of them goes through all.
    """
    step = k + 1
    out = []
    diag = pos - place
    for shift in range(2 if k else 1):  # bands of 2 (k + 1) diagonals, half overlapping; single diagonals for k = 0
        band = (diag + shift * step) // (2 * step) if k else diag
        order = np.lexsort((pos, band, item, doc))
        d, i, b, p, g = doc[order], item[order], band[order], pos[order], diag[order]
        need = np.maximum(1, length[i] - q + 1 - k * q)
        a = np.arange(len(p))
        z = a + need - 1
        # a window of `need` hits in one band must lie within the stretch and its edits
        inside = np.minimum(z, len(p) - 1)
        ok = (z < len(p)) & (length[i] > 0) & (d == d[inside]) & (i == i[inside]) & (b == b[inside]) & (p[inside] - p <= length[i] - q + k)
        first = np.flatnonzero(ok)
        if not len(first):
            continue
        # hits covered by some window that reaches the bound
        edge = np.zeros(len(p) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, z[first] + 1, -1)
        live = np.cumsum(edge[:-1]) > 0
        d, i, p, g = d[live], i[live], p[live], g[live]
        order = np.lexsort((p, g, i, d))
        d, i, p, g = d[order], i[order], p[order], g[order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
        out += zip(d[new].tolist(), i[new].tolist(), p[new].tolist(), (p[new] - g[new]).tolist())
    return sorted(set(out))


def same_ahead(a: str, i: int, b: str, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal: by growing pieces, then by halves of the one that differs."""
    n = min(len(a) - i, len(b) - j)
    if n <= 0 or a[i] != b[j]:
        return 0
    done, step = 0, 8
    while done < n:
        m = min(step, n - done)
        if a[i + done : i + done + m] == b[j + done : j + done + m]:
            done, step = done + m, step * 2
            continue
        low, high = 0, m
        while high - low > 1:
            mid = (low + high) // 2
            if a[i + done + low : i + done + mid] == b[j + done + low : j + done + mid]:
                low = mid
            else:
                high = mid
        return done + low
    return n


def reach(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """For 0 to ``k`` edits how far ``a`` and ``b`` go together from their beginnings: (characters of a, of b), the most of both.

    A banded alignment: per number of edits the furthest point on each of the
    2 k + 1 diagonals, each from those of one edit less.
    """
    best: list[tuple[int, int]] = []
    far: dict[int, int] = {}
    for e in range(k + 1):
        nxt: dict[int, int] = {}
        for d in range(-e, e + 1):
            if not e:
                i = 0
            else:
                i = max(far.get(d, -1) + 1 if d in far else -1, far[d - 1] if d - 1 in far else -1, far[d + 1] + 1 if d + 1 in far else -1)
            if i < 0:
                continue
            i = min(i, len(a))
            j = i + d
            if j < 0:
                continue
            if j > len(b):
                i, j = len(b) - d, len(b)
                if i < 0:
                    continue
            nxt[d] = i + same_ahead(a, i, b, j)
        far = nxt
        top = max(((i, i + d) for d, i in far.items()), key=sum)
        best.append(max(top, best[-1], key=sum) if best else top)
    return best


def stretch(text: str, pos: int, item: str, place: int, q: int, k: int, size: int) -> tuple[int, int, int, int, int] | None:
    """(start, end, item start, item end, edits) of the stretch through a hit that is as long as ``size`` in the item, with the fewest edits.

    Of stretches with equally few edits the longest; None if ``k`` don't do.
    """
    most = len(item) + k  # no stretch is longer
    left = reach(item[:place][::-1], text[max(0, pos - most) : pos][::-1], k)
    if left[k][0] + len(item) - place < size:
        return None
    right = reach(item[place + q :], text[pos + q : pos + q + most], k)
    for e in range(k + 1):
        found = max((left[x][0] + right[e - x][0], x) for x in range(e + 1))
        if found[0] + q >= size:
            x = found[1]
            return pos - left[x][1], pos + q + right[e - x][1], place - left[x][0], place + q + right[e - x][0], e
    return None


def whole_words(starts: np.ndarray, size: int, a: int, b: int) -> tuple[int, int]:
    """(first, behind last) of the words that lie inside characters a to b of a text of ``size`` characters."""
    ends = np.append(starts[1:] - 1, size)
    return int(np.searchsorted(starts, a, "left")), int(np.searchsorted(ends, b, "right"))


def _scan(index: Index, texts: list[str], least_words: int, q: int, k: int) -> list[tuple[int, object, int, int, int]]:
    """(text number, item id, first word, words or characters, edits) for one chunk of documents."""
    words = [words_of(t) for t in texts]
    joined = [" ".join(w) for w in words]
    at, flat = [], []
    total = 0
    for j in joined:
        at.append(total)
        flat.append(j)
        total += len(j) + 1
    codes = np.frombuffer("\n".join(flat).encode("utf-32-le"), np.uint32)
    pos, item, place = index.hits(_grams(codes, q))
    if not len(pos):
        return []
    starts = np.array(at)
    doc = np.searchsorted(starts, pos, "right") - 1
    out, seen, word_starts = [], set(), {}
    for d, it, p, place in bands(doc, pos, item, place, index.length, q, k):
        base, size = int(starts[d]), len(joined[d])
        if p + q > base + size:
            continue  # a gram across two texts
        text, other = joined[d], index.texts[it]
        found = stretch(text, p - base, other, place, q, k, int(index.length[it]))
        if not found:
            continue
        a, z, ia, iz, edits = found
        if d not in word_starts:
            word_starts[d] = _starts(words[d])
        ws = word_starts[d]
        if k:
            first, run = int(np.searchsorted(ws, a, "right")) - 1, z - a
        else:
            # words whole in both texts: the same characters, so their bounds differ at the stretch's ends only
            first, behind = whole_words(ws, size, a, z)
            i_first, i_behind = whole_words(index.starts[it], len(other), ia, iz)
            shift = place - (p - base)
            while first < behind and (i_first >= i_behind or index.starts[it][i_first] != ws[first] + shift):
                if i_first < i_behind and index.starts[it][i_first] < ws[first] + shift:
                    i_first += 1
                else:
                    first += 1
            run = min(behind - first, i_behind - i_first)
            if run < least_words:
                continue
        if (d, it, first) not in seen:
            seen.add((d, it, first))
            out.append((d, index.ids[it], first, run, edits))
    return out


def leaked_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least_words: int = 12, max_edits: int = 0, q: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key, first_word, run_length, edits): passages of items inside documents.

    With ``max_edits`` 0 a passage is a run of at least ``least_words`` equal
    words and ``run_length`` counts words.  Otherwise it is a stretch of the
    document within so many edits (characters put in, left out or replaced) of a
    stretch of the item that is at least as long as the item's shortest run of
    so many words; ``run_length`` counts its characters.  Null and empty texts hold and leak
    nothing; an item given twice counts once; items of more than
    ``block_chars`` characters in all are taken in blocks, every document
    against every block.  ``q`` follows from the shortest passage that counts,
    so that the lemma's bound stays well above 0.
    """
    spark = documents.sparkSession
    ship(spark)
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    listed = items.where(F.col(item_text).isNotNull()).select(item_key, item_text).distinct()
    size = listed.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_chars))
    docs = documents.where(F.col(text) != "").select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = None
    for n in range(blocks):
        held = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == n)
        texts_held = [tuple(r) for r in held.collect()]  # at most about block_chars characters
        block = spark.sparkContext.broadcast(texts_held)
        least = min((n for _, t in texts_held if (n := shortest(words_of(t), least_words))), default=2 * least_words)
        gram = q or max(3, min(20, 3 * least // 4 // (max_edits + 1)))

        def scan(batches: Iterator[pd.DataFrame], block=block, q=gram) -> Iterator[pd.DataFrame]:
            index = Index(block.value, q, least_words)
            for b in batches:
                keys, texts, rows = list(b["k"]), list(b["t"]), []
                lo = held_chars = 0
                for i in range(len(texts) + 1):
                    if i == len(texts) or (held_chars and held_chars + len(texts[i]) > CHUNK_CHARS):
                        if i > lo:
                            rows += [(keys[lo + d], it, w, r, e) for d, it, w, r, e in _scan(index, texts[lo:i], least_words, q, max_edits)]
                        lo, held_chars = i, 0
                    if i < len(texts):
                        held_chars += len(texts[i])
                yield pd.DataFrame(rows, columns=["k", "i", "first_word", "run_length", "edits"])

        part = docs.mapInPandas(scan, f"k {kinds[0]}, i {kinds[1]}, first_word bigint, run_length bigint, edits bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("k", key).withColumnRenamed("i", item_key)


def leaked_items(documents: DataFrame, items: DataFrame, **how: object) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaked_passages(documents, items, **how).select("doc_id", "item_id").distinct()


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item the number of documents that leak it, 0 included."""
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "suite").distinct().join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("document_count"))
