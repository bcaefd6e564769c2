"""Sums of very many mixtures that differ little, from sums over the rows at one of them.

The log density of a component is a weighted sum of a row's terms (its form), so
with w_k, how the differences between the forms of component k and of the last
one change, a row's shares are derivatives of log sum exp, whose Taylor series
in w has polynomials of the shares as coefficients, and w is a polynomial of the
row.  Sums over the rows of shares' products times products of columns, made
once at a centre, thus give the sums of every mixture near it as a polynomial of
its distance, without a look at the rows.

What the series leaves out is bounded for each mixture.  With R the greatest
difference of two w in a row (one of them the last component's 0), the shares
are analytic along the way from the centre, up to 2 / R times its length in any
complex direction, and change there by at most 2 exp(2) / cos(1) = 27.4 of
share * (1 - share).  So the terms from ``order`` + 1 on are in sum at most 27.4 *
share * (1 - share) * (R / 2) ** (order + 1), times 2 where no row has R > 1, and
times exp(2 R) anywhere (Lagrange's remainder, with the most that share * (1 -
share) grows on the way).  For odd orders the sum of that over all rows, times
1 + |row|² (no term is greater), is such a polynomial again; R in the last factor
is bounded by the greatest terms of any row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement
from math import comb, factorial

import numpy as np

#: Orders of series (odd), the most sums of a centre, and rows and mixtures that are made into products at once.
ORDERS, MOST_SUMS, ROWS, MIXTURES = (7, 5, 3), 1 << 16, 2048, 512


class Products:
    """Products of at most ``degree`` variables, those of fewer before those of more."""

    def __init__(self, variables: int, degree: int):
        self.of = [c for g in range(degree + 1) for c in combinations_with_replacement(range(variables), g)]
        self.index = {c: i for i, c in enumerate(self.of)}
        self.up_to = [sum(len(c) <= g for c in self.of) for g in range(degree + 1)]

    def __len__(self) -> int:
        return len(self.of)

    def values(self, columns: np.ndarray) -> np.ndarray:
        """Of columns (variables x rows) all products (products x rows)."""
        out = np.ones((len(self), columns.shape[1]))
        for i, c in enumerate(self.of[1:], 1):
            np.multiply(out[self.index[c[:-1]]], columns[c[-1]], out=out[i])
        return out

    def times(self, other: tuple, degree: int) -> np.ndarray:
        """Where the products of up to ``degree`` variables are after one more product."""
        return np.array([self.index[tuple(sorted((*c, *other)))] for c in self.of[: self.up_to[degree]]])


@dataclass
class Centre:
    """What the rows tell of mixtures near one: differences of its forms, coefficients, and the greatest terms of a row."""

    forms: np.ndarray
    terms: np.ndarray
    coefficients: np.ndarray
    bound: np.ndarray
    greatest: np.ndarray


def order_of(d: int, components: int) -> int | None:
    """The highest order whose sums over d columns are few enough, if one is."""
    over = lambda v, g: comb(v + g, g)
    return next((order for order in ORDERS if components > 1 and over(d, 2 * order + 4) * over(components - 1, order + 1) <= MOST_SUMS), None)


class Series:
    """Of mixtures of ``components`` over d columns."""

    def __init__(self, d: int, components: int, order: int):
        self.components, self.order = components, order
        self.rows, self.shares = Products(d, 2 * order + 4), Products(components - 1, order + 1)
        self.width = self.rows.up_to[2]
        self.changes = Products(components - 1, order)
        self._times = [self.rows.times(c, 2 * order + 4 - len(c)) for c in self.rows.of[: self.rows.up_to[4]]]
        self._derivatives = self._derived()

    def _derived(self) -> np.ndarray:
        """Derivatives of log sum exp by the products of ``shares``, as polynomials of the shares."""
        out = np.zeros((len(self.shares), len(self.shares)))
        for i, c in enumerate(self.shares.of[1:], 1):
            if len(c) == 1:
                out[i, i] = 1
                continue
            by, before = c[-1], out[self.shares.index[c[:-1]]]
            for j in np.flatnonzero(before):
                power = self.shares.of[j]
                out[i, j] += before[j] * power.count(by)
                out[i, self.shares.index[tuple(sorted((*power, by)))]] -= before[j] * len(power)
        return out

    def sums(self, rows: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Of scaled rows, under mixtures' forms (components x terms x mixtures): all sums of each, its log-likelihood at their end."""
        out, likelihood = np.zeros((forms.shape[2], len(self.shares), len(self.rows))), np.zeros(forms.shape[2])
        for a in range(0, len(rows), ROWS):
            products = self.rows.values(np.ascontiguousarray(rows[a : a + ROWS].T))
            for m in range(forms.shape[2]):
                share, level = shares(forms[:, :, m] @ products[: self.width])
                likelihood[m] += level.sum()
                out[m] += self.shares.values(share[:-1]) @ products.T
        return np.column_stack([out.reshape(len(out), -1), likelihood])

    def centre(self, sums: np.ndarray, forms: np.ndarray, greatest: np.ndarray) -> Centre:
        likelihood, sums = sums[-1], sums[:-1].reshape(len(self.shares), -1)
        by = self._derivatives @ sums  # sums of each derivative times each product of columns
        coefficients = []
        for c in self.changes.of:
            at, n = self.rows.up_to[2 * len(c)], np.prod([factorial(c.count(k)) for k in set(c)])
            level = by[self.shares.index[c], :at] if c else np.array([likelihood - forms[-1] @ sums[0, : self.width]])
            more = [by[self.shares.index[tuple(sorted((*c, k)))]][self._times[t][:at]] for k in range(self.components - 1) for t in range(self.width)]
            coefficients.append(np.stack([*more, level], axis=1) / n)
        # one less the squares of all shares, the last being one less the others
        uneven, last = np.zeros(len(self.shares)), {(): 1.0, **{(k,): -1.0 for k in range(self.components - 1)}}
        uneven[0] = 1
        for k in range(self.components - 1):
            uneven[self.shares.index[(k, k)]] -= 1
        for a, x in last.items():
            for b, y in last.items():
                uneven[self.shares.index[tuple(sorted((*a, *b)))]] -= x * y
        spread, at = uneven @ sums, self.rows.up_to[2 * self.order + 2]
        squares = [t for t, c in enumerate(self.rows.of[: self.width]) if not c or len(c) == 2 and c[0] == c[1]]
        bound = 27.4 / 2 ** (self.order + 1) * sum(spread[self._times[t][:at]] for t in squares)
        return Centre(forms[:-1] - forms[-1], sums[0, : self.width], np.concatenate(coefficients), bound, greatest)

    def _product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two polynomials of a row, for each mixture (products x mixtures), multiplied; b has at most the fourth degree."""
        degree = self.rows.up_to.index
        out = np.zeros((self.rows.up_to[degree(len(a)) + degree(len(b))], a.shape[1]))
        for j, y in enumerate(b):
            out[self._times[j][: len(a)]] += a * y
        return out

    def near(self, centres: list[Centre], forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of mixtures' forms (components x terms x mixtures) their sums alike, log-likelihoods and what these may be off by, from the centre that is nearest to each."""
        out = np.empty(forms.shape), np.empty(forms.shape[2]), np.empty(forms.shape[2])
        with np.errstate(over="ignore", invalid="ignore"):  # of mixtures that are far away
            apart = forms[:-1] - forms[-1]
            which = np.argmin([self._widest(c, apart - c.forms[:, :, None]) for c in centres], axis=0) if len(centres) > 1 else np.zeros(forms.shape[2], int)
            for c, centre in enumerate(centres):
                mine = np.flatnonzero(which == c)
                for some in np.split(mine, range(MIXTURES, len(mine), MIXTURES)):
                    for kept, found in zip(out, self._near(centre, forms[:, :, some])):
                        kept[..., some] = found
        return out

    def _widest(self, centre: Centre, change: np.ndarray) -> np.ndarray:
        """What no row's greatest difference of two changes exceeds."""
        pairs = combinations([*change, np.zeros_like(change[0])], 2)
        return np.max([centre.greatest @ np.abs(a - b) for a, b in pairs], axis=0)

    def _near(self, centre: Centre, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        change = forms[:-1] - forms[-1] - centre.forms[:, :, None]
        powers = [np.ones((1, forms.shape[2]))]
        for c in self.changes.of[1:]:
            powers.append(self._product(powers[self.changes.index[c[:-1]]], change[c[-1]]))
        found = centre.coefficients.T @ np.concatenate(powers)
        sums = found[:-1].reshape(self.components - 1, self.width, -1)
        sums = np.concatenate([sums, centre.terms[:, None] - sums.sum(axis=0, keepdims=True)])
        likelihood = found[-1] + centre.terms @ forms[-1]
        off = np.zeros(forms.shape[2])
        for a, b in combinations([*change, np.zeros_like(change[0])], 2):
            power = square = self._product(a - b, a - b)
            for _ in range(self.order // 2):
                power = self._product(power, square)
            off += centre.bound @ power
        widest = self._widest(centre, change)
        return sums, likelihood, off * np.where(widest <= 1, 2, np.exp(2 * widest))


def shares(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of log densities (components x rows) the shares of the components, and the log of their sum."""
    top = level.max(axis=0)
    share = np.exp(level - top)
    whole = share.sum(axis=0)
    return share / whole, top + np.log(whole)
