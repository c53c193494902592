"""Finding evaluation texts that stand in a corpus.

Method: a BM25 inverted index of the evaluation items with block-max pruning.  Every passage of every
document is a query; all items above their threshold are retrieved, then verified word by word.

A passage is two neighbouring segments of ``run`` words, so every run of ``run`` words lies in one.
The threshold of an item is the least BM25 score that any of its own runs gives, so a passage that
holds a run of an item always reaches it: retrieval loses nothing, at any size of the corpus.  A run's
rarest word is a key of its item, and a passage is scored only if it has a key at all.

The index is built in parts of bounded size by the executors and kept in files; the corpus is read
once, whatever the number of parts, and neither items nor index pass through the driver's memory.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tokens import text_slices
from strandlake.session import new_path, stage

RUN = 20
K1, B = 1.2, 0.75
#: Items in a block of the index, and items and bytes of items in a part of it (a file).
BLOCK_ITEMS = 32
PASS_ITEMS = 1024
PASS_BYTES = 8 << 20
#: Bytes of index files that a Python worker keeps loaded, and bytes of text that it searches at a time.
LOADED_BYTES = 256 << 20
RUN_BYTES = 16 << 20
#: Sums of 20 doubles differ by the order of adding by far less than this share.
MARGIN = 1e-9
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_ODD = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    """Runs of the letters a-z and digits, case set aside."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


class ItemIndex:
    """BM25 impacts of items in blocks, with the largest impact of each word in each block.

    ``seen`` (word to number of items, of all parts), ``n_all`` and ``mean`` are the statistics of
    all items, by default those of ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, seen: dict[bytes, int] | None = None, n_all: int | None = None, mean: float | None = None):
        self.run = run
        listed = [(i, words_of(t)) for i, t in items]
        listed = [(i, w) for i, w in listed if len(w) >= run]
        self.ids = np.array([i for i, _ in listed], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        coded = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64) for _, w in listed]
        self.n_words, n = len(self.vocabulary), len(listed)
        if seen is None:
            counts = np.zeros(self.n_words)
            for c in coded:
                counts[np.unique(c)] += 1
            n_all, mean = n, np.mean([len(c) for c in coded]) if coded else 1.0
        else:
            counts = np.array([seen[w] for w in self.vocabulary], np.float64)
        idf, mean = np.log1p((n_all - counts + 0.5) / (counts + 0.5)), max(1.0, mean)
        # words by rarity, the code of a word deciding between equals
        rarity = np.empty(self.n_words, np.int64)
        rarity[np.lexsort((np.arange(self.n_words), counts))] = np.arange(self.n_words)
        impacts, floor = [], np.zeros(n)
        keys: list[np.ndarray] = []
        for k, c in enumerate(coded):
            words, times = np.unique(c, return_counts=True)
            impact = idf[words] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(c) / mean))
            impacts.append((words, impact))
            own = np.zeros(self.n_words)
            own[words] = impact
            runs = np.lib.stride_tricks.sliding_window_view(c, run)
            floor[k] = own[runs].sum(axis=1).min()
            keys.append(np.unique(runs[np.arange(len(runs)), rarity[runs].argmin(axis=1)]))
        # items with like thresholds share a block, so its least threshold says much
        order = np.argsort(floor, kind="stable")
        self.ids, floor = self.ids[order], floor[order] * (1 - MARGIN)
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        n_blocks = -(-n // BLOCK_ITEMS)
        self.block_max = np.zeros((n_blocks, self.n_words + 1))
        # bit b of a word: it is a key of an item of block b
        self.key_bits = np.zeros((-(-n_blocks // 64), self.n_words + 1), np.uint64)
        self.block_floor = np.full(n_blocks, np.inf)
        self.floor = floor
        for b in range(n_blocks):
            members = order[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS]
            words = np.unique(np.concatenate([impacts[m][0] for m in members]))
            row = np.zeros(self.n_words + 1, np.int32)  # row 0: words that no item of the block has
            row[words] = np.arange(1, len(words) + 1)
            dense = np.zeros((len(words) + 1, len(members)))
            for j, m in enumerate(members):
                dense[row[impacts[m][0]], j] = impacts[m][1]
            self.blocks.append((row, dense))
            self.block_max[b, words] = dense[1:].max(axis=1)
            self.key_bits[b // 64, np.concatenate([keys[m] for m in members])] |= np.uint64(1 << b % 64)
            self.block_floor[b] = floor[b * BLOCK_ITEMS]
        # every run of every item, by hash, for verification
        self.grams: dict[int, list[tuple[int, bytes]]] = {}
        for k, m in enumerate(order):
            for p, h in enumerate(self.run_hashes(coded[m])):
                self.grams.setdefault(int(h), []).append((k, coded[m][p : p + run].astype(np.int32).tobytes()))
        self.gram_hashes = np.array(sorted(self.grams), np.uint64)

    def run_hashes(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(codes) - self.run + 1), np.uint64)
        x = codes.astype(np.uint64) + np.uint64(1)
        for j in range(self.run):
            h = h * np.uint64(_ODD) + x[j : j + len(h)]
        return h

    def retrieve(self, passages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, item) pairs at or above the item's threshold.

        A block is looked at only for passages with a key of its items, and scored only for those
        whose upper bound in it reaches its least threshold.
        """
        for b, (row, dense) in enumerate(self.blocks):
            if b % 64 == 0:
                bits = np.bitwise_or.reduce(self.key_bits[b // 64][passages], axis=1)
            open_ = np.flatnonzero(bits & np.uint64(1 << b % 64))
            if len(open_):
                open_ = open_[self.block_max[b][passages[open_]].sum(axis=1) * (1 + MARGIN) >= self.block_floor[b]]
            for at in range(0, len(open_), 1024):
                part = open_[at : at + 1024]
                score = dense[row[passages[part]]].sum(axis=1)
                p, k = np.nonzero(score >= self.floor[b * BLOCK_ITEMS : b * BLOCK_ITEMS + dense.shape[1]])
                if len(p):
                    yield part[p], k + b * BLOCK_ITEMS

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place in ``texts``, item id) of every text that holds a run of an item."""
        return self.search_segments(Segments(texts, self.run))

    def search_segments(self, texts: Segments) -> list[tuple[int, int]]:
        run, other = self.run, self.n_words
        if not len(texts.owner) or not len(self.ids):
            return []
        get = self.vocabulary.get
        code = np.array([get(w, other) for w in texts.words] + [other], np.int32)
        segments = code[texts.segments]
        # a passage without a key of any item holds no run of one
        has_key = self.key_bits.any(axis=0)[segments].any(axis=1)
        follows = texts.follows
        live = np.flatnonzero(has_key | (follows & np.r_[has_key[1:], False]))
        if not len(live):
            return []
        nothing = np.full(run, other, np.int32)
        passages = np.concatenate([segments[live], np.where(follows[live, None], segments[np.minimum(live + 1, len(segments) - 1)], nothing)], axis=1)
        found: set[tuple[int, int]] = set()
        for at in range(0, len(live), 8192):
            self._verify(passages[at : at + 8192], texts.owner[live[at : at + 8192]], found)
        return sorted(found)

    def _verify(self, passages: np.ndarray, owner: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Adds the (owner, item id) of passages that reach an item's threshold and hold a run of it."""
        run, wanted = self.run, {}
        for p, k in self.retrieve(passages):
            for a, c in zip(p.tolist(), k.tolist(), strict=True):
                wanted.setdefault(a, set()).add(c)
        if not wanted:
            return
        rows = np.array(sorted(wanted))
        words = passages[rows]
        width = words.shape[1] - run + 1
        codes, flat = words.astype(np.uint64) + np.uint64(1), np.zeros((len(rows), width), np.uint64)
        for j in range(run):
            flat = flat * np.uint64(_ODD) + codes[:, j : j + width]
        at = np.minimum(np.searchsorted(self.gram_hashes, flat), len(self.gram_hashes) - 1)
        for r, s in zip(*np.nonzero(self.gram_hashes[at] == flat), strict=True):
            items, exact = wanted[int(rows[r])], words[r, s : s + run].tobytes()
            for item, gram in self.grams[int(flat[r, s])]:
                if item in items and gram == exact:
                    found.add((int(owner[rows[r]]), int(self.ids[item])))


class Segments:
    """Texts as segments of ``run`` words, coded by a vocabulary of their own, ready for any index."""

    def __init__(self, texts: list[str | None], run: int = RUN):
        known: dict[bytes, int] = {}
        codes, owner = [], []
        for t, text in enumerate(texts):
            words = words_of(text) if text else []
            if len(words) >= run:
                short = -len(words) % run
                codes += [known.setdefault(w, len(known)) for w in words] + [-1] * short
                owner += [t] * ((len(words) + short) // run)
        self.words = list(known)
        # -1 (no word) is the last code of whatever an index makes of the words
        self.segments, self.owner = np.array(codes, np.int32).reshape(-1, run), np.array(owner, np.int32)
        self.follows = np.r_[self.owner[1:] == self.owner[:-1], False] if len(owner) else np.zeros(0, bool)


_LOADED: OrderedDict[str, tuple[ItemIndex, int]] = OrderedDict()


def _loaded(name: str) -> Iterator[ItemIndex]:
    """The indexes of a file, kept by the worker while there is room."""
    if name in _LOADED:
        _LOADED.move_to_end(name)
    else:
        blobs = pq.read_table(SparkFiles.get(name))["index"].to_pylist()
        _LOADED[name] = ([pickle.loads(b) for b in blobs], sum(map(len, blobs)))
        while len(_LOADED) > 1 and sum(n for _, n in _LOADED.values()) > LOADED_BYTES:
            _LOADED.popitem(last=False)
    yield from _LOADED[name][0]


def _index_files(items: DataFrame, run: int, pass_items: int, pass_bytes: int) -> list[str]:
    """Builds the index of ``items`` (i, t) in parts and hands its files to the executors; returns their names."""
    spark = items.sparkSession
    items = stage(items, "items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not n:
        return []
    parts = max(1, -(-n // pass_items), -(-size // pass_bytes))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(p), w.decode(), len(ws)) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for ws in [words_of(t)] if len(ws) >= run for w in {*ws, b""}]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["part", "word", "n"])

    parted = items.select(F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("part"), "i", "t")
    told = parted.select("part", "t").mapInArrow(tell, "part int, word string, n long").groupBy("part", "word").agg(F.count(F.lit(1)).alias("seen"), F.sum("n").alias("n"))
    told = stage(told, "words")  # the empty word counts the items and their words
    n_all, n_words = told.where("word = ''").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_all:
        return []
    # a word's number over all parts goes back to the parts that have it: at most one row each
    total = told.groupBy("word").agg(F.sum("seen").alias("total"))
    wanted = told.select("part", "word").join(total, "word").where("word <> ''")
    mean = n_words / n_all

    def build(own: pa.Table, words: pa.Table) -> pa.Table:
        seen = dict(zip((w.encode() for w in words["word"].to_pylist()), words["total"].to_pylist(), strict=True))
        listed = sorted(zip(own["i"].to_pylist(), own["t"].to_pylist(), strict=True))
        index = ItemIndex([x for x in listed if len(words_of(x[1])) >= run], run, seen, n_all, mean)
        return pa.table({"index": pa.array([pickle.dumps(index, protocol=5)], pa.binary())})

    built = parted.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(build, "index binary")
    path = new_path(spark, "index")
    built.write.parquet(path)
    files = [r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()]  # one name per file
    for f in files:
        spark.sparkContext.addFile(f)
    return sorted(f.rsplit("/", 1)[1] for f in files)


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, pass_items: int = PASS_ITEMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id, item_id``: each document with each item of which it holds ``run`` consecutive words.

    Words are runs of the letters a-z and digits; case and everything between words are set aside.
    An item is a text without parts, so its run of words stands for question and answer alike.  The
    corpus is read once and not shuffled but for the pairs found; tasks search it for one part of the
    index (``pass_items`` items and ``pass_bytes`` bytes of them, on average) after the other.

    Defined cases: null or empty texts and texts with fewer than ``run`` words hold nothing; items
    with fewer words leak nowhere; items with a passage in common are each found; items with a null
    id are not searched, documents with a null id come out with it; repeated rows give one pair; an
    empty table on either side gives no rows; further columns are not read, whatever their names.
    """
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{doc_text}`").alias("text"))
    files = _index_files(items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null"), run, pass_items, pass_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if files else ():
            for first, end in text_slices(batch.column(1), RUN_BYTES):
                texts = Segments(batch.column(1).slice(first, end - first).to_pylist(), run)
                hits = [h for name in files for index in _loaded(name) for h in index.search_segments(texts)]
                if hits:
                    ids = batch.column(0).take(pa.array([first + h[0] for h in hits]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(scan, "doc_id long, item_id long").distinct()
