"""Best documents of all queries in one bucket of a segmented index, by bounds of its blocks.

Postings of a bucket are flat arrays, and scores are sums in one array of queries by
documents, of bounded size; there is no row for a pair of query and document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strata.operators.blocks import _ranked, pieces
from strata.operators.scoring import ADDED, CELLS, Posed, Slice, half_up

# More than rounded scores and sums in another order can differ.
SLACK = 1e-5

# The first pass scores blocks with so many times k documents.
SEEDS = 4


@dataclass
class Rules:
    k: int
    k1: float
    b: float
    tiers: int
    digits: int

    def part(self, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
        """Share of a posting in a score before it is weighed; it grows with ``tf`` and falls with ``dl``."""
        return tf / (tf + self.k1 * ((1 - self.b) + self.b * dl / avgdl))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and elements of the lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


class Bucket:
    """Documents of a bucket in order of their blocks, and the rows of posed terms."""

    def __init__(self, docs: pa.RecordBatch, rows: pa.RecordBatch, asked: Slice, rules: Rules):
        # Blocks without a living document have nothing to score.
        of_doc, at, dl = (docs.column(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "dl"))
        row_block = rows.column("block").to_numpy(zero_copy_only=False)
        blocks = np.unique(of_doc)
        self.n_blocks = len(blocks)
        code, self.names = _ranked(docs.column("docid"))
        # A docid that comes twice in a block is one document.
        size = len(self.names) + 1
        found, number, times = np.unique(np.searchsorted(blocks, of_doc) * size + code, return_inverse=True, return_counts=True)
        self.block, self.code = found // size, found % size
        self.first = np.searchsorted(self.block, np.arange(self.n_blocks))
        width = 1 + int(at.max())
        doc_at = np.full(self.n_blocks * width, -1)
        length_at = np.zeros(len(doc_at))
        places = np.searchsorted(blocks, of_doc) * width + at
        doc_at[places], length_at[places] = number, dl

        place = np.searchsorted(blocks, row_block)
        alive = (place < self.n_blocks) & (blocks[np.minimum(place, self.n_blocks - 1)] == row_block)
        rows = rows.filter(pa.array(alive))
        self.row_block = place[alive]
        self.row_term = rows.column("number").to_numpy(zero_copy_only=False)
        # Peaks are the largest parts of a row's documents, whatever the mean length.
        lengths, tf = _flat(rows.column("peak_tfs"))
        part = rules.part(tf, _flat(rows.column("peak_dls"))[1], asked.avgdl)
        most = np.maximum.reduceat(part, np.cumsum(lengths) - lengths) if len(part) else part
        copies = np.maximum.reduceat(times, self.first)
        self.bound = most * asked.idf[self.row_term] * copies[self.row_block]

        lengths, ats = _flat(rows.column("ats"))
        self.n = lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        # Dead documents have a place, too, but none of the array's.
        known = ats < width
        doc = np.where(known, doc_at[np.where(known, self.row_block[row] * width + ats, 0)], -1)
        living = doc >= 0
        row, self.entry_doc = row[living], doc[living]
        tf = _flat(rows.column("tfs"))[1][living]
        dl = length_at[self.row_block[row] * width + ats[living]]
        self.entry = rules.part(tf, dl, asked.avgdl) * asked.idf[self.row_term[row]]
        self.entries = np.bincount(row, minlength=len(lengths))
        self.entry_starts = np.cumsum(self.entries) - self.entries


def _chunks(posed: Posed, n_docs: int) -> Iterator[tuple[int, Posed]]:
    """Queries in groups whose sums take bounded room, and the number of the first."""
    term = np.repeat(np.arange(len(posed.starts) - 1), np.diff(posed.starts))
    order = np.argsort(posed.queries, kind="stable")  # terms of a query stay in order
    term, query, times = term[order], posed.queries[order], posed.times[order]
    step = max(1, CELLS // max(1, n_docs))
    for first in range(0, posed.n_queries, step):
        own = slice(*np.searchsorted(query, [first, first + step]))
        by_term = np.argsort(term[own], kind="stable")
        starts = np.searchsorted(term[own][by_term], np.arange(len(posed.starts)))
        yield first, Posed(min(step, posed.n_queries - first), posed.terms, starts, query[own][by_term] - first, times[own][by_term])


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th score of every row; -1 if fewer are found."""
    if scores.shape[1] < k:
        return np.full(len(scores), -1.0)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.where(least > 0, least, -1.0)


def _tiers(posed: Posed, most: np.ndarray, least: np.ndarray, tiers: int) -> np.ndarray:
    """Tier of every term of every query: terms by falling bound, first all without which the rest cannot reach the least score."""
    order = np.lexsort((-most, posed.queries))
    query, bound = posed.queries[order], most[order]
    starts = np.searchsorted(query, np.arange(posed.n_queries + 1))
    sums = np.concatenate([[0.0], np.cumsum(bound)])
    rest = sums[starts[1:]][query] - sums[:-1]
    count = np.diff(starts)
    first = np.bincount(query, rest + SLACK >= least[query], posed.n_queries)
    place = np.arange(len(query)) - starts[query] + 1
    left = np.maximum(count - first, 1)[query]
    later = np.ceil((place - first[query]) * (tiers - 1) / left).astype(np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.where((place <= first[query]) | (tiers == 1), 0, later)
    return out


def _searched(bucket: Bucket, posed: Posed, rules: Rules) -> tuple[np.ndarray, int, int]:
    """Scores of queries (rows) for documents (columns), 0 where one is not among the best; postings of the queries' terms, and scored ones."""
    n_docs, n_blocks = len(bucket.block), bucket.n_blocks
    scores = np.zeros((posed.n_queries, n_docs))
    # A pair is a query and a row of one of its terms.
    had = np.diff(posed.starts)[bucket.row_term]
    row = np.repeat(np.arange(len(had)), had)
    asked = pieces(posed.starts[bucket.row_term], had)
    query, times = posed.queries[asked], posed.times[asked]
    spot = query * n_blocks + bucket.row_block[row]
    bound = bucket.bound[row] * times
    scored = 0

    def add(chosen: np.ndarray, among: np.ndarray | None = None) -> None:
        nonlocal scored
        work = np.cumsum(bucket.entries[row[chosen]])
        cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1] if len(work) else 0, ADDED), "left"))
        for first, last in zip(cuts, [*cuts[1:], len(chosen)]):
            part = chosen[first:last]
            n = bucket.entries[row[part]]
            entry = pieces(bucket.entry_starts[row[part]], n)
            cell = np.repeat(query[part] * n_docs, n) + bucket.entry_doc[entry]
            added = np.repeat(times[part], n) * bucket.entry[entry]
            if among is not None:
                held = among.ravel()[cell]
                cell, added = cell[held], added[held]
            scored += len(cell)
            scores.ravel()[:] += np.bincount(cell, added, scores.size)

    # The most promising blocks give a lower bound of the k-th score.
    shape = (posed.n_queries, n_blocks)
    promise = np.bincount(spot, bound, posed.n_queries * n_blocks).reshape(shape)
    held = np.zeros(promise.size, np.int64)
    np.maximum.at(held, spot, bucket.n[row])
    falling = np.argsort(-promise, axis=1, kind="stable")
    held = np.take_along_axis(held.reshape(shape), falling, 1)
    before = np.cumsum(held, axis=1) - held
    seeds = np.zeros(shape, bool)
    np.put_along_axis(seeds, falling, (before < SEEDS * rules.k) & (held > 0), 1)
    add(np.flatnonzero(seeds.ravel()[spot]))
    least = _kth(scores, rules.k)

    # Other blocks that can reach it, term by term in tiers.
    alive = (promise + SLACK >= least[:, None]) & (promise > 0) & ~seeds
    most = np.zeros(len(posed.queries))
    np.maximum.at(most, asked, bound)
    tier = _tiers(posed, most, least, rules.tiers)[asked]
    among = alive[:, bucket.block]
    for i in range(rules.tiers):
        now = np.flatnonzero(alive.ravel()[spot] & (tier == i))
        add(now, among if i else None)
        later = tier > i
        rest = np.bincount(spot[later], bound[later], posed.n_queries * n_blocks).reshape(shape)
        among &= (scores > 0) & (scores + rest[:, bucket.block] + SLACK >= least[:, None])
        alive &= np.logical_or.reduceat(among, bucket.first, axis=1)
    scores[~(among | seeds[:, bucket.block])] = 0.0
    return scores, int(bucket.n[row].sum()), scored


def _best(bucket: Bucket, scores: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document and rounded score of the best ``k``, ties by docid."""
    query, doc = np.nonzero((scores > 0) & (scores >= _kth(scores, rules.k)[:, None] - 2 * 10.0**-rules.digits))
    rounded = half_up(scores[query, doc], rules.digits)
    order = np.lexsort((bucket.code[doc], -rounded, query))
    query, doc, rounded = query[order], doc[order], rounded[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < rules.k
    return query[kept], doc[kept], rounded[kept]


def best_of_bucket(slices: dict, rules: Rules, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of the batches of a bucket: living documents (``docid`` is not null) and rows of posed terms.

    It returns ``date, __query, docid, score, all, scored``: the best of the bucket, and one
    row without a query that counts its postings and the scored ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        whole = pa.concat_batches(held)
        date = whole.column("date")[0].as_py()
        if date not in slices:
            return
        is_doc = whole.column("docid").is_valid()
        docs, rows = whole.filter(is_doc), whole.filter(pa.array(~is_doc.to_numpy(zero_copy_only=False)))
        if not len(docs) or not len(rows):
            return
        asked = slices[date]
        bucket = Bucket(docs, rows, asked, rules)
        every = scored = 0
        for first, posed in _chunks(asked.posed, len(bucket.block)):
            scores, n, some = _searched(bucket, posed, rules)
            every, scored = every + n, scored + some
            query, doc, best = _best(bucket, scores, rules)
            names = bucket.names.take(pa.array(bucket.code[doc]))
            yield told(date, len(query), query + first, names, best)
        yield told(date, 1, [-1], pa.nulls(1, pa.string()), [None], [every], [scored])

    def told(date, n: int, *columns) -> pa.RecordBatch:
        columns = [[date] * n, *columns]
        arrays = [pa.nulls(n, f.type) if i >= len(columns) else pa.array(columns[i], f.type) for i, f in enumerate(schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run
