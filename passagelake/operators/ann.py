"""Inverted-list index: items belong to the nearest of some centres; a query probes only the lists of a few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import _unit, block_topk, usable

SAMPLE = 16384  # vectors the centres and the number of probes are fitted on at most
ASKED = 256  # of these, those whose nearest are sought to fit the number of probes


def sample_vectors(items: DataFrame, vector: str, dim: int, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """At most `sample` unit vectors, chosen by the hash of their numbers, and the number of items."""
    n = items.count()
    h = F.pmod(F.xxhash64(vector), F.lit(1 << 30))
    got = items.where(usable(vector, dim)).where(h < int(min(1.0, 1.3 * sample / max(n, 1)) * (1 << 30)) + 1).select(vector).limit(2 * sample).toArrow()
    return (_unit(got[vector].combine_chunks(), dim)[:sample] if got.num_rows else np.zeros((0, dim))), n


def fit_centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of `lists` inverted lists (fewer if there are few vectors) from sampled unit vectors."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), max(1, min(lists, len(x) // 4)), replace=False)]
    for _ in range(rounds):
        a = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        norm = np.linalg.norm(s, axis=1)
        c = np.where(norm[:, None] > 0, s / np.maximum(norm, 1e-12)[:, None], c)
    return c


def fit_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = ASKED) -> int:
    """The least number of lists that hold, for `asked` of the sampled vectors, at least `recall` of their k nearest in the sample.

    In the whole table the nearest are nearer than in the sample, so that no fewer of them are found there.
    """
    if len(x) < 2:
        return len(centres)
    own = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[own] @ centres.T), axis=1, kind="stable"), axis=1)
    lists = (x @ centres.T).argmax(1)
    need = np.sort(np.take_along_axis(place, lists[top], 1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def ivf_topk(queries: DataFrame, items: DataFrame, k: int, dim: int, lists: int | None = None, probes: int | None = None, recall: float = 0.95) -> DataFrame:
    """query_id, item_id, score, rank: the k nearest among the items in the query's `probes` nearest lists.

    queries: query_id, query_vector; items: item_id, item_vector. Lists are as many as the root of the items, as far as
    the sample gives each 16 vectors; probes as many as `recall` takes in the sample. Both can be given. Item vectors are
    not shuffled: each is compared, by matrix products, with the queries that probe its list.
    """
    x, n = sample_vectors(items, "item_vector", dim)
    centres = fit_centres(x, lists or max(1, min(round(n**0.5), len(x) // 16)))
    probes = probes or fit_probes(x, centres, k, recall)
    return block_topk(queries, items, k, dim, ("query_id", "item_id"), ("query_vector", "item_vector"), 6, centres, min(probes, len(centres)))
