"""Sparse matrices in compressed rows, multiplied row by row (Gustavson, numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Entry products that are expanded at a time.
EXPANDED = 1 << 18


class Csr:
    """Row i has the columns ``indices[indptr[i]:indptr[i + 1]]`` with their ``values`` (default: 1)."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, n_cols: int, values: np.ndarray | None = None):
        self.indptr, self.indices, self.n_cols = indptr.astype(np.int64), indices.astype(np.int64), n_cols
        self.values = np.ones(len(indices), np.int64) if values is None else values

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def row_of_entries(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transpose(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        ends = np.cumsum(np.bincount(self.indices, minlength=self.n_cols))
        return Csr(np.concatenate([[0], ends]), self.row_of_entries()[order], self.n_rows, self.values[order])

    def products(self, other: Csr, most: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (row, column, value) of ``self @ other``, for some rows at a time, in order.

        Row i of the product is the sum of the rows k of ``other`` over the entries
        (i, k); rows whose products number about ``most`` are expanded and added up
        together.
        """
        fan = np.diff(other.indptr)[self.indices]  # products that each entry makes
        made = np.concatenate([[0], np.cumsum(fan)])[self.indptr]
        low = 0
        while low < self.n_rows:
            high = max(low + 1, int(np.searchsorted(made, made[low] + most, "right")) - 1)
            i, j = self.indptr[low], self.indptr[high]
            k, n = self.indices[i:j], fan[i:j]
            at = np.repeat(other.indptr[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(np.repeat(np.arange(low, high), np.diff(self.indptr[low:high + 1])), n)
            key = row * other.n_cols + other.indices[at]
            value = np.repeat(self.values[i:j], n) * other.values[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if len(first):
                yield key[first] // other.n_cols, key[first] % other.n_cols, np.add.reduceat(value[order], first)
            low = high

    def product(self, other: Csr, most: int = EXPANDED) -> Csr:
        found = list(self.products(other, most))
        row, column, value = (np.concatenate([*[f[k] for f in found], np.empty(0, np.int64)]) for k in range(3))
        ends = np.cumsum(np.bincount(row.astype(np.int64), minlength=self.n_rows))
        return Csr(np.concatenate([[0], ends]), column, other.n_cols, value)
