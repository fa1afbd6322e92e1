"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by an item when one of its item-sized windows (as many words as
the item has) is within ``floor((1 - similarity) * n)`` word edits of it. The CGK random walk
turns a window into a string of 3n symbols: at each step the current word is written and a
random bit of (step, word) says whether to move on; edit distance becomes Hamming distance.
Windows and items that agree on a few sampled steps in one of many repeats are candidates,
and the exact edit distance decides. How many walks and tables an item gets, and how many steps
are sampled, follows from its length and ``target_recall``, by trials at exactly the allowed
edits. ``LEVELS`` reach 0.98 for items of 1,000 words; items that none of them brings to the
target are compared directly wherever the next filter lets them.

Windows that cannot qualify are never embedded: k edits destroy at most 2k of an item's
n - 1 word pairs, so a window needs n - 1 - 2k pairs of that item, and some seven
neighbouring pairs must hold their share of them. This loses nothing.

With ``any_length`` a window may have any number of words: within k edits that is n - k to
n + k. A window of n + j words needs j pairs more. Windows of the item's size, cut at the
document's end, are embedded as before; candidates and direct comparisons look for the best
stretch of any length in the words around.

Items are the query set: they are read in blocks of bounded size and each block goes to the
tasks with the function; documents stay where they are and nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import spare

SIMILARITY = 0.8
MIN_WORDS = 5
BLOCK_ITEMS = 2_000
TARGET_RECALL = 0.98
#: (walks, tables of each, sampled steps of a table), cheapest first; the longer an item, the
#: fewer steps it shares with its edits, and the fewer may be asked to agree at once
LEVELS = ((8, 6, 3), (8, 12, 3), (8, 24, 2), (8, 24, 1), (16, 24, 1), (32, 24, 1), (32, 48, 1))
DIRECT = (0, 0, 0)
TRIALS = 200
SPAN = 7
SEED = 7
_MIX, _MIX2, _MIX3 = (np.uint64(x) for x in (  # odd constants that spread bits
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PUNCTUATION = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def _distances(a: list[int] | np.ndarray, b: list[int] | np.ndarray, anywhere: bool) -> list[int]:
    """Word edits between ``a`` and each beginning of ``b`` from one word on (bit-parallel).

    ``anywhere``: between ``a`` and the nearest stretch of ``b`` that ends there.
    """
    where: dict[int, int] = defaultdict(int)
    for k, x in enumerate(a):
        where[int(x)] |= 1 << k
    full, last, first = (1 << len(a)) - 1, 1 << (len(a) - 1), 0 if anywhere else 1
    plus, minus, score, out = full, 0, len(a), []
    for y in b:
        equal = where.get(int(y), 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & last) - bool(down & last)
        up, down = ((up << 1) | first) & full, (down << 1) & full
        plus, minus = down | (full & ~((equal | minus) | up)), up & (equal | minus)
        out.append(score)
    return out


def edit_distance(a: list[int] | np.ndarray, b: list[int] | np.ndarray, most: int) -> int:
    """Word edits between two sequences, or ``most + 1`` if there are more."""
    if not len(a) or not len(b):
        return min(max(len(a), len(b)), most + 1)
    return min(_distances(a, b, False)[-1], most + 1)


def ends_near(a: list[int] | np.ndarray, b: list[int] | np.ndarray, most: int
              ) -> list[tuple[int, int]]:
    """(edits, end): places in ``b`` where some stretch within ``most`` edits of ``a`` ends."""
    return [(score, end) for end, score in enumerate(_distances(a, b, True), 1) if score <= most]


def nearest(a: list[int], b: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, words) of the stretch of ``b`` nearest to ``a``, if within ``most`` edits.

    Of equals the first to end, then the one nearest to the length of ``a``.
    """
    best, end = min(ends_near(a, b, most), default=(most + 1, 0))
    if best > most:
        return None
    back = _distances(a[::-1], b[max(0, end - len(a) - best):end][::-1], False)
    size = min((abs(size - len(a)), size) for size, edits in enumerate(back, 1) if edits == best)[1]
    return best, end - size, size


def _moves(walks: np.ndarray, step: int, symbols: np.ndarray) -> np.ndarray:
    """A random bit of (walk, step, symbol)."""
    with np.errstate(over="ignore"):
        x = (symbols + 2).astype(np.uint64) * _MIX
        x += (walks * 1_000_003 + step).astype(np.uint64)[:, None] * _MIX2
        x ^= x >> np.uint64(31)
        x *= _MIX3
        x ^= x >> np.uint64(29)
        x *= _MIX2
    return (x >> np.uint64(63)).astype(np.int64)


def cgk(windows: np.ndarray, walks: int, steps: int | None = None) -> np.ndarray:
    """CGK strings (walks, rows, 3m) of rows of up to m word numbers, -1 past their end.

    ``steps`` gives the first few symbols only.
    """
    rows, m = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -1, dtype=windows.dtype)], axis=1)
    at, every = np.zeros((walks, rows), dtype=np.int64), np.arange(rows)
    walk = np.arange(walks)
    steps = 3 * m if steps is None else steps
    out = np.empty((walks, rows, steps), dtype=np.int64)
    for step in range(steps):
        symbols = padded[every, at]
        out[:, :, step] = symbols
        at = np.minimum(at + _moves(walk, step, symbols), m)
    return out


def _edited(rng: np.random.Generator, n: int, k: int, kind: int, any_length: bool) -> np.ndarray:
    """Words 1 .. n after k edits (substitutions, deletions, insertions or all), n words long.

    A deletion and the word that fills the window up again are two edits, as are an insertion
    and the word it pushes out, unless windows may have any length.
    """
    words, fresh = list(range(1, n + 1)), n
    k = k // 2 if kind in (1, 2) and not any_length else k
    for step, at in enumerate(sorted(rng.choice(n, k, replace=False).tolist(), reverse=True)):
        fresh += 1
        how = step % 3 if kind == 3 else kind
        words[at:at + (how < 2)] = [] if how == 1 else [fresh]
    return np.array((words + list(range(fresh + 1, fresh + n)))[:n])


@lru_cache(maxsize=None)
def _level(n: int, similarity: float, target: float, any_length: bool) -> tuple[int, int, int]:
    if n > 100 and _level(-(-n // 20) * 10, similarity, target, any_length) == DIRECT:
        return DIRECT  # longer items are reached less often
    rng, k = np.random.default_rng(SEED), allowed(n, similarity)
    own = np.arange(1, n + 1)[None, :]
    texts = [np.stack([_edited(rng, n, k, kind, any_length) for _ in range(TRIALS)])
             for kind in range(4)]
    most = max(walks for walks, *_ in LEVELS)
    item = cgk(own, most)[:, :, :2 * n]
    shares = [(cgk(t, most)[:, :, :2 * n] == item).mean(axis=2) for t in texts]
    for walks, tables, sampled in LEVELS:
        if all(1 - ((1 - p[:walks] ** sampled) ** tables).prod(axis=0).mean() >= target
               for p in shares):
            return walks, tables, sampled
    return DIRECT


def level(n: int, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL,
          any_length: bool = False) -> tuple[int, int, int]:
    """Walks, tables and sampled steps that find a passage with all allowed edits of an n-word item with
    probability ``target_recall`` even if nothing but its own window could, or DIRECT."""
    return _level(-(-n // 10) * 10, similarity, target_recall, any_length)


class Index:
    """The items of one block, and the search of many windows among them."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY,
                 target_recall: float = TARGET_RECALL,
                 levels: dict[int, tuple[int, int, int]] | None = None, any_length: bool = False):
        self.similarity, self.any_length = similarity, any_length
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            words = words_of(text)
            if len(words) >= MIN_WORDS:
                self.items.append((item, np.array(
                    [self.number.setdefault(w, len(self.number) + 1) for w in words])))
        self.base = len(self.number) + 1
        self.length = np.array([len(w) for _, w in self.items], dtype=np.int64)
        edits = np.array([allowed(n, similarity) for n in self.length.tolist()], dtype=np.int64)
        #: pairs that a window within the allowed edits of the item must hold
        self.need = self.length - 1 - 2 * edits
        #: words that a window may have more than the item
        self.slack = edits if any_length else edits * 0
        self.share = min((-(-(need + j) // -(-(n - 1 + j) // SPAN)) for n, need, slack in zip(
            self.length.tolist(), self.need.tolist(), self.slack.tolist(), strict=True)
            for j in range(slack + 1)), default=1)
        own = [np.unique(w[:-1] * self.base + w[1:]) for _, w in self.items]
        code = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(code, kind="stable")
        self.pairs, first, self.count = np.unique(code[order], return_index=True,
                                                  return_counts=True)
        self.first, self.holder = first, item[order]
        #: walks, tables and sampled steps by item length
        self.levels = levels or {n: level(n, similarity, target_recall, any_length)
                                 for n in set(self.length.tolist())}
        self.direct = np.array([self.levels[n] == DIRECT for n in self.length.tolist()],
                               dtype=bool)
        self._signed: dict[tuple[int, int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def _signatures(self, windows: np.ndarray, n: np.ndarray, walks: int, tables: int,
                    sampled: int) -> np.ndarray:
        """(walks x tables, rows): a number for a window's length and sampled symbols."""
        strings, rows = cgk(windows, walks, 2 * windows.shape[1]), np.arange(len(windows))
        #: where the sampled steps of each walk and table are, as shares of 2n steps
        at = np.random.default_rng(SEED).random((walks, tables, sampled))
        out = np.empty((walks * tables, len(windows)), dtype=np.int64)
        for walk in range(walks):
            for table in range(tables):
                key = n.copy()
                for share in at[walk, table]:
                    # a walk leaves its window after about 2n steps
                    symbol = strings[walk, rows, (share * 2 * n).astype(np.int64)]
                    key = key * (self.base + 1) + symbol + 1
                out[walk * tables + table] = key
        return out

    def signed(self, of: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per walk and table: sorted signatures of a level's items, and the items so ordered."""
        if of not in self._signed:
            own = np.array([k for k, n in enumerate(self.length.tolist()) if self.levels[n] == of])
            rows = np.full((len(own), int(self.length[own].max())), -1, dtype=np.int64)
            for row, k in zip(rows, own.tolist(), strict=True):
                row[:self.length[k]] = self.items[k][1]
            self._signed[of] = []
            for key in self._signatures(rows, self.length[own], *of):
                order = np.argsort(key, kind="stable")
                self._signed[of].append((key[order], own[order]))
        return self._signed[of]

    def _starts(self, tokens: np.ndarray
                ) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, int, int]]]:
        """Windows with enough pairs of one item: starts by window length where tables decide,
        and (item, first start, last start) where the item is compared directly."""
        marks = np.zeros(len(tokens), dtype=np.int64)
        both = np.nonzero((tokens[:-1] > 0) & (tokens[1:] > 0))[0]
        code = tokens[both] * self.base + tokens[both + 1]
        place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        real = self.pairs[place] == code
        both, place = both[real], place[real]
        marks[both] = 1
        upto = np.concatenate([[0], np.cumsum(marks)])
        at = np.arange(len(tokens))
        dense = np.nonzero(upto[np.minimum(at + SPAN, len(tokens))] - upto[:-1] >= self.share)[0]
        if not len(dense):
            return [], []
        # pairs farther from such a place than the longest item is long are in no window
        reach, most = np.zeros(len(tokens) + 1, dtype=np.int64), int((self.length + self.slack).max())
        np.add.at(reach, np.maximum(dense - most, 0), 1)
        np.add.at(reach, np.minimum(dense + most + SPAN, len(tokens)), -1)
        near = np.cumsum(reach[:-1])[both] > 0
        both, place = both[near], place[near]
        # one row per (item, position of one of its pairs), by item and position
        times = self.count[place]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.holder[np.repeat(self.first[place], times) + offset]
        spot = np.repeat(both, times)
        order = np.argsort(item * len(tokens) + spot)
        item, spot = item[order], spot[order]
        # the need-th next pair of the same item must still be in the window
        last = np.arange(len(item)) + self.need[item] - 1
        inside = last < len(item)
        head, tail = np.nonzero(inside)[0], last[inside]
        longest = self.length[item[head]] + self.slack[item[head]]
        good = (item[head] == item[tail]) & (spot[tail] - spot[head] <= longest - 2)
        item, head, tail, longest = item[head[good]], spot[head[good]], spot[tail[good]], longest[good]
        n, first, last = self.length[item], np.maximum(tail - longest + 2, 0), head
        direct, out = self.direct[item], []
        for size in np.unique(n[~direct]).tolist():
            own = ~direct & (n == size)
            cover = np.zeros(len(tokens) + 1, dtype=np.int64)
            np.add.at(cover, first[own], 1)
            np.add.at(cover, last[own] + 1, -1)
            out.append((size, np.nonzero(np.cumsum(cover[:-1]) > 0)[0]))
        # both ends rise within an item, so runs that touch are neighbours
        item, first, last = item[direct], first[direct], last[direct]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1)
        begin = np.nonzero(new)[0]
        end = np.append(begin[1:], len(item)) - 1 if len(begin) else begin
        return out, list(zip(item[begin].tolist(), first[begin].tolist(), last[end].tolist(),
                             strict=True))

    def _compared(self, tokens: np.ndarray, ends: np.ndarray, k: int, first: int, last: int
                  ) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(document, (edits, start, words)): the best windows of item k that start in a run."""
        words = self.items[k][1]
        n, most = len(words), allowed(len(words), self.similarity)
        slack = int(self.slack[k])
        for doc in range(int(np.searchsorted(ends, first, side="right")),
                         int(np.searchsorted(ends, last, side="right")) + 1):
            low = max(first, int(ends[doc - 1]) if doc else 0)
            if self.any_length:
                part = tokens[low:min(last + n + slack, int(ends[doc]))].tolist()
                hit = nearest(words.tolist(), part, most) if len(part) >= n - slack else None
                if hit:
                    yield doc, (hit[0], low + hit[1], hit[2])
                continue
            high = min(last, int(ends[doc]) - n)
            best = (most + 1, 0, n)
            # a window has no fewer edits than the best stretch that ends where it does
            for least, end in sorted(ends_near(words, tokens[low:high + n].tolist(), most)
                                     if high >= low else []):
                if least > best[0]:
                    break
                at = low + end - n
                if at >= low:
                    edits = edit_distance(words, tokens[at:at + n].tolist(), most)
                    best = min(best, (edits, at, n))
            if best[0] <= most:
                yield doc, best

    def search(self, tokens: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, edits): the best window per document and item.

        ``tokens`` are the word numbers of documents one after another, ``ends`` where each
        document ends.
        """
        if not self.items or len(tokens) < MIN_WORDS:
            return []
        found, runs = self._starts(tokens)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def better(doc: int, k: int, hit: tuple[int, int, int]) -> None:
            key = (doc, self.items[k][0])
            best[key] = min(best.get(key, hit), hit)

        for k, first, last in runs:
            for doc, hit in self._compared(tokens, ends, k, first, last):
                better(doc, k, hit)
        for of in sorted({self.levels[size] for size, _ in found}):
            some = [(size, x) for size, x in found if self.levels[size] == of]
            starts = np.concatenate([x for _, x in some])
            sizes = np.repeat(np.array([size for size, _ in some], dtype=np.int64),
                              [len(x) for _, x in some])
            docs = np.searchsorted(ends, starts, side="right")
            # no window crosses a document's end
            least = sizes - (np.array([allowed(n, self.similarity) for n in sizes.tolist()],
                                      dtype=np.int64) if self.any_length else 0)
            fits = starts + least <= ends[docs]
            starts, sizes, docs = starts[fits], sizes[fits], docs[fits]
            near: dict[int, list[int]] = defaultdict(list)
            for cut in range(0, len(starts), 1024):
                start, n, doc = (x[cut:cut + 1024] for x in (starts, sizes, docs))
                span = np.arange(int(n.max()))
                rows = np.where(span < np.minimum(n, ends[doc] - start)[:, None],
                                tokens[np.minimum(start[:, None] + span, len(tokens) - 1)], -1)
                tried = [np.zeros(0, dtype=np.int64)]  # window x items + item
                for key, (theirs, order) in zip(self._signatures(rows, n, *of), self.signed(of),
                                                strict=True):
                    low = np.searchsorted(theirs, key, side="left")
                    many = np.searchsorted(theirs, key, side="right") - low
                    held = np.flatnonzero(many)
                    many = many[held]
                    place = np.repeat(low[held] - np.cumsum(many) + many, many)
                    tried.append(np.repeat(held, many) * len(self.items)
                                 + order[place + np.arange(len(place))])
                window, item = np.divmod(np.unique(np.concatenate(tried)), len(self.items))
                alike = self.length[item] == n[window]
                for w, k in zip(window[alike].tolist(), item[alike].tolist(), strict=True):
                    if self.any_length:
                        near[k].append(int(start[w]))
                        continue
                    words = self.items[k][1]
                    most = allowed(len(words), self.similarity)
                    edits = edit_distance(words, rows[w, :len(words)], most)
                    if edits <= most:
                        better(int(doc[w]), k, (edits, int(start[w]), len(words)))
            for k, places in near.items():
                # candidates close to each other are compared at once
                slack, run = int(self.slack[k]), []
                for at in sorted(places):
                    if run and at - slack <= run[1] + 1:
                        run[1] = at + slack
                        continue
                    if run:
                        for doc, hit in self._compared(tokens, ends, k, *run):
                            better(doc, k, hit)
                    run = [max(at - slack, 0), at + slack]
                for doc, hit in self._compared(tokens, ends, k, *run):
                    better(doc, k, hit)
        begins = np.concatenate([[0], ends[:-1]])
        return [(d, item, at - int(begins[d]), n, edits)
                for (d, item), (edits, at, n) in sorted(best.items())]


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()),
                           ("n_words", pa.int64()), ("edits", pa.int64()),
                           ("item_words", pa.int64())]))
HIT_TYPE = ("array<struct<item_id:bigint,first_word:bigint,n_words:bigint,edits:bigint,"
            "item_words:bigint>>")


def _search_block(texts: list[str | None], index: Index) -> list[list[dict]]:
    get, chunks = index.number.get, []
    for text in texts:
        words = words_of(text)
        chunks.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
    out: list[list[dict]] = [[] for _ in texts]
    ends = np.cumsum([len(c) for c in chunks])
    sizes = {item: len(words) for item, words in index.items}
    for doc, item, at, n, edits in index.search(np.concatenate(chunks), ends):
        out[doc].append({"item_id": item, "first_word": at, "n_words": n, "edits": edits,
                         "item_words": sizes[item]})
    return out


def _finder(items: list[tuple[int, str]], similarity: float, target_recall: float,
            any_length: bool):
    levels = Index(items, similarity, target_recall, None, any_length).levels  # once, not in every task

    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(items, similarity, target_recall, levels, any_length)
        for array in texts:
            found = []
            for at in range(0, len(array), 2000):
                found += _search_block(array.slice(at, 2000).to_pylist(), index)
            yield pa.array(found, type=HITS)

    return find


def with_hits(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str,
              name: str, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS,
              target_recall: float = TARGET_RECALL, any_length: bool = False) -> DataFrame:
    """``docs`` with a column ``name``: every item that contaminates the row's text."""
    rows = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    blocks = max(1, -(-rows.count() // block_items))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    columns = []
    for block in range(blocks):
        own = [(r["id"], r["text"]) for r in rows.where(part == block).collect()]

        columns.append(F.arrow_udf(_finder(own, similarity, target_recall, any_length),
                                   HIT_TYPE)(F.col(text_col)))
    return docs.withColumn(name, F.concat(*columns) if len(columns) > 1 else columns[0])


def decontamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                    similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS,
                    target_recall: float = TARGET_RECALL, any_length: bool = False
                    ) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids, similarity, hits.

    item_ids are distinct and sorted; similarity is the largest 1 - edits / item words over the
    hits, 0 without one; hits has the best window per item, the first of equals; windows have
    the item's words, with ``any_length`` any number of words. Null and
    empty texts have no hits. Items that are null or have fewer than MIN_WORDS words match
    nothing. Repeated rows are judged each on their own; without items nothing is hit; an
    empty table gives no rows.
    """
    found = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                      items, "text", item_id, item_text, "_hits", similarity, block_items,
                      target_recall, any_length)
    best = F.array_max(F.transform("_hits", lambda h: 1 - h["edits"] / h["item_words"]))
    return found.select("doc_id", "_hits").select(
        "doc_id", (F.size("_hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item_id"])))
        .alias("item_ids"),
        F.coalesce(best, F.lit(0.0)).alias("similarity"), F.col("_hits").alias("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text",
                      target_recall: float = TARGET_RECALL, any_length: bool = False
                      ) -> DataFrame:
    """The rows without a hit, with all their columns."""
    name = spare(docs, "_hits")
    return (with_hits(docs, items, text_col, item_id, item_text, name,
                      target_recall=target_recall, any_length=any_length)
            .where(F.size(name) == 0).select(*docs.columns))


def op4_decontaminate(spark, sf_dir):
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                           any_length=True)
