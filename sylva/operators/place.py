"""Maximum-likelihood and Bayesian placement of aligned queries onto a fixed tree.

The reference side (model, partial likelihoods of every edge from below and from above) is made
once from the tree and its alignment and broadcast: its size is that of the reference.  Queries are
placed one by one in Arrow batches; they need nothing of each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.tree import Node

#: Nucleotide codes as sets of A, C, G, T.
NUCLEOTIDES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "-": 15, "?": 15, ".": 15}
AMINO = "ARNDCQEGHILKMFPSTWYV"


def gamma_rates(alpha: float, n: int) -> np.ndarray:
    """Mean rates of n equally likely classes of a gamma distribution of mean 1, by numerical integration of its density."""
    if n == 1:
        return np.ones(1)
    # in y = log x the density is smooth whatever alpha
    y = np.linspace(-60.0 / max(min(alpha, 1.0), 0.05), np.log(200.0 + 20.0 / alpha), 400_001)
    log_f = alpha * np.log(alpha) + alpha * y - alpha * np.exp(y)
    f = np.exp(log_f - log_f.max())
    mass = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2)])
    mass /= mass[-1]
    weighted = f * np.exp(y)
    first = np.concatenate([[0.0], np.cumsum((weighted[1:] + weighted[:-1]) / 2)])
    first /= first[-1]
    return np.diff(np.interp(np.linspace(0, 1, n + 1), mass, first)) * n


@dataclass
class Model:
    """A reversible model: exchange rates (symmetric), frequencies, rate classes.

    All classes are averaged over at every site, or ``site_class`` gives each site its own.
    """

    exchange: np.ndarray
    frequencies: np.ndarray
    rates: np.ndarray = field(default_factory=lambda: np.ones(1))
    site_class: np.ndarray | None = None

    def __post_init__(self):
        pi = self.frequencies / self.frequencies.sum()
        q = self.exchange * pi
        np.fill_diagonal(q, 0)
        np.fill_diagonal(q, -q.sum(1))
        q /= -(pi * np.diag(q)).sum()
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh(q * root[:, None] / root)
        self.frequencies, self.values = pi, values
        self.left, self.right = vectors / root[:, None], vectors.T * root

    @classmethod
    def gtr(cls, rates: dict[str, float], frequencies, alpha: float | None = None, n_cat: int = 4) -> Model:
        m = np.zeros((4, 4))
        for pair, value in rates.items():
            i, j = ("acgt".index(x) for x in pair.lower())
            m[i, j] = m[j, i] = value
        return cls(m, np.asarray(frequencies, float), gamma_rates(alpha, n_cat) if alpha else np.ones(1))

    @classmethod
    def from_table(cls, text: str, frequencies=None, alpha: float | None = None, n_cat: int = 4) -> Model:
        """A protein model from the usual text: the lower triangle of exchange rates in the order of AMINO, then 20 frequencies.

        ``frequencies`` (of the alignment, say) take the place of the table's.
        """
        numbers = [float(x) for x in text.split()[:210]]
        if len(numbers) < 210:
            raise ValueError("190 rates and 20 frequencies are needed")
        m = np.zeros((20, 20))
        m[np.tril_indices(20, -1)] = numbers[:190]
        return cls(m + m.T, np.asarray(frequencies if frequencies is not None else numbers[190:], float), gamma_rates(alpha, n_cat) if alpha else np.ones(1))

    @classmethod
    def from_description(cls, about: dict, *, table: str | None = None, frequencies=None) -> Model:
        """The model that a package's JSON names: GTR rates, or a protein table given as text, with gamma classes or a rate for each site.

        ``frequencies``: those of the alignment, where the description has none of its own.
        """
        kind = about.get("ras_model")
        if kind not in ("gamma", "Price-CAT"):
            raise ValueError(f"unknown model of rates: {kind}")
        if about.get("datatype", "DNA") == "DNA":
            if about.get("subs_model") != "GTR":
                raise ValueError(f"unknown substitution model: {about.get('subs_model')}")
            model = cls.gtr(about["subs_rates"], frequencies if frequencies is not None else [0.25] * 4)
        elif table is None:
            raise ValueError(f"the table of {about.get('subs_model')} must be given")
        else:
            model = cls.from_table(table, frequencies if about.get("empirical_frequencies") else None)
        if kind == "gamma":
            own = about["gamma"]
            return cls(model.exchange, model.frequencies, gamma_rates(float(own["alpha"]), int(own["n_cats"])) if int(own["n_cats"]) > 1 else np.ones(1))
        own = about["Price-CAT"]  # its categories count from 1
        return cls(model.exchange, model.frequencies, np.asarray(own["Rates"], float), np.asarray(own["SiteCategories"], int) - 1)

    @property
    def classes(self) -> int:
        """Vectors that are kept for each site."""
        return 1 if self.site_class is not None else len(self.rates)

    def carry(self, t: float, v: np.ndarray, sites: np.ndarray | None = None) -> np.ndarray:
        """(classes, sites, states) vectors moved along a branch of length t."""
        p = self.transition(t)
        if self.site_class is None:
            return np.einsum("cij,csj->csi", p, v)
        own = self.site_class if sites is None else self.site_class[sites]
        return np.einsum("sij,csj->csi", p[own], v)

    def transition(self, t: float) -> np.ndarray:
        """(classes, states, states)"""
        return np.maximum((self.left * np.exp(self.values * max(t, 0.0) * self.rates[:, None])[:, None, :]) @ self.right, 0.0)


def tips(seq: str, states: int = 4) -> np.ndarray:
    """(sites, states) indicator vectors of an aligned sequence; gaps and unknown letters allow all."""
    if states == 4:
        codes = np.array([NUCLEOTIDES.get(c, 15) for c in seq.upper()])
        return ((codes[:, None] >> np.arange(4)) & 1).astype(float)
    out = np.ones((len(seq), 20))
    for k, c in enumerate(seq.upper()):
        if c in AMINO:
            out[k] = 0
            out[k, AMINO.index(c)] = 1
    return out


class Reference:
    """Partial likelihoods of every edge: ``down`` at its distal end, ``up`` at its proximal end, (classes, sites, states), with log scales by site."""

    def __init__(self, tree: Node, sequences: dict[str, str], model: Model):
        self.tree, self.model = tree, model
        self.nodes = {n.id: n for n in tree.walk()}
        self.length = {n.id: n.length or 0.0 for n in tree.walk()}
        self.states = len(model.frequencies)
        missing = [n.label for n in tree.leaves() if n.label not in sequences]
        if missing:
            raise ValueError(f"leaves without sequence: {missing[:5]}")
        classes = model.classes
        self.down, self.down_scale, self.up, self.up_scale = {}, {}, {}, {}
        moved: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in tree.walk():
            if n.is_leaf:
                v = np.repeat(tips(sequences[n.label], self.states)[None], classes, 0)
                self.down[n.id], self.down_scale[n.id] = v, np.zeros(v.shape[1])
            else:
                self.down[n.id], self.down_scale[n.id] = self._product([moved[c.id] for c in n.children])
            moved[n.id] = self._along(self.down[n.id], self.down_scale[n.id], self.length[n.id])
        for n in reversed(list(tree.walk())):
            for c in n.children:
                parts = [moved[x.id] for x in n.children if x is not c]
                if n.parent is not None:
                    parts.append(self._along(self.up[n.id], self.up_scale[n.id], self.length[n.id]))
                self.up[c.id], self.up_scale[c.id] = self._product(parts) if parts else (np.ones_like(self.down[c.id]), np.zeros(self.down[c.id].shape[1]))

    def _along(self, v, scale, t):
        return self.model.carry(t, v), scale

    @staticmethod
    def _product(parts):
        v, scale = parts[0][0].copy(), parts[0][1].copy()
        for x, s in parts[1:]:
            v *= x
            scale = scale + s
        top = v.max(axis=(0, 2))
        top[top <= 0] = 1e-300
        return v / top[None, :, None], scale + np.log(top)

    def log_likelihood(self, edge: int | None = None) -> float:
        """Of the reference tree, taken at any edge (the same everywhere)."""
        edge = self.tree.children[0].id if edge is None else edge
        below, scale = self._along(self.down[edge], self.down_scale[edge], self.length[edge])
        site = (below * self.up[edge] * self.model.frequencies).sum(2).mean(0)
        return float((np.log(site) + scale + self.up_scale[edge]).sum())

    def edges(self) -> list[int]:
        return [n.id for n in self.tree.walk() if n.parent is not None]

    #: Bytes of midpoint vectors that are worked on at once, and kept if all of them fit.
    MIDDLES = 256 << 20

    def middles(self):
        """(edges, vectors (edges, classes, sites, states), log scales (edges, sites)) at the edges' midpoints, in parts."""
        kept = self.__dict__.get("_middles")
        if kept is not None:
            yield from kept
            return
        edges, one = self.edges(), self.down[self.tree.children[0].id].nbytes
        step = max(1, self.MIDDLES // max(1, one))
        parts = []
        for k in range(0, len(edges), step):
            own = edges[k : k + step]
            v = np.stack([self.model.carry(self.length[e] / 2, self.down[e]) * self.model.carry(self.length[e] / 2, self.up[e]) * self.model.frequencies for e in own])
            part = (own, v, np.stack([self.down_scale[e] + self.up_scale[e] for e in own]))
            if step >= len(edges):
                parts.append(part)
            yield part
        if parts:
            self._middles = parts

    def rank(self, leaf: np.ndarray, sites: np.ndarray, pendant: float) -> dict[int, float]:
        """Log likelihood of a query hung at the midpoint of every edge: one product over all edges."""
        hang = self.model.carry(pendant, leaf, sites)
        out = {}
        for own, v, scale in self.middles():
            site = np.einsum("ecxs,cxs->ex", v[:, :, sites], hang) / len(hang)
            out |= zip(own, (np.log(np.maximum(site, 1e-300)) + scale[:, sites]).sum(1).tolist(), strict=True)
        return out

    def prior_means(self) -> dict[int, float]:
        from .placing import prior_means

        if "_means" not in self.__dict__:
            self._means = prior_means(self.tree)
        return self._means

    def join(self, edge: int, distal: float, sites: np.ndarray):
        """(vector, log scale) at a place on an edge, of all the reference, over some sites."""
        below = self.model.carry(distal, self.down[edge][:, sites], sites)
        above = self.model.carry(self.length[edge] - distal, self.up[edge][:, sites], sites)
        return below * above * self.model.frequencies, self.down_scale[edge][sites] + self.up_scale[edge][sites]


def _line_search(f, low: float, high: float, tolerance: float) -> tuple[float, float]:
    """(place, value) of a maximum by golden sections and parabolas."""
    golden = 0.3819660112501051
    a, b = low, high
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    e = d = 0.0
    for _ in range(100):
        middle, small = (a + b) / 2, tolerance * abs(x) + 1e-10
        if abs(x - middle) <= 2 * small - (b - a) / 2:
            break
        use = False
        if abs(e) > small:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(q * e / 2) and q * (a - x) < p < q * (b - x):
                e, d, use = d, p / q, True
        if not use:
            e = (b if x < middle else a) - x
            d = golden * e
        u = x + (d if abs(d) >= small else np.copysign(small, d))
        fu = f(u)
        if fu >= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu >= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu >= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


@dataclass(frozen=True)
class Settings:
    keep_at_most: int = 7
    keep_factor: float = 0.01
    max_strikes: int = 6
    strike_box: float = 3.0
    max_pitches: int = 40
    start_pendant: float = 0.1
    max_pendant: float = 2.0
    first_tolerance: float = 0.01
    tolerance: float = 1e-5
    posterior: bool = False
    prior_mean: float = 0.1  # of the exponential prior of pendant lengths; 0: a uniform prior
    informative: bool = False  # the prior's mean is each edge's own, by the leaves below it
    cluster_cutoff: float = 0.0  # edges are tried by clusters of leaves no farther apart; 0: one by one


def place_query(ref: Reference, seq: str, s: Settings = Settings()) -> list[dict]:
    """Placements of one aligned query, best first: edges ranked at their midpoints, then optimised until they strike out."""
    sites = np.flatnonzero([c not in "-?." for c in seq])
    if not len(sites):
        return []
    own = tips("".join(seq[k] for k in sites), ref.states)
    leaf = np.repeat(own[None], ref.model.classes, 0)

    def value(edge: int, distal: float, pendant: float) -> float:
        v, scale = ref.join(edge, distal, sites)
        hang = ref.model.carry(pendant, leaf, sites)
        return float((np.log(np.maximum((v * hang).sum(2).mean(0), 1e-300)) + scale).sum())

    guess = ref.rank(leaf, sites, s.start_pendant)
    if s.cluster_cutoff > 0:
        from .placing import by_cluster, edge_clusters

        ranked = list(by_cluster(edge_clusters(ref.tree, s.cluster_cutoff), guess.__getitem__, s.strike_box))
    else:
        ranked = sorted(((v, e) for e, v in guess.items()), key=lambda x: (-x[0], x[1]))
    found, best, strikes = [], -np.inf, 0

    def optimise(edge: int, distal: float, pendant: float, tolerance: float):
        length, now = ref.length[edge], -np.inf
        for _ in range(30):
            v, scale = ref.join(edge, distal, sites)
            hang = lambda t: float((np.log(np.maximum((v * ref.model.carry(t, leaf, sites)).sum(2).mean(0), 1e-300)) + scale).sum())  # noqa: B023, E731
            pendant, _ = _line_search(hang, 0.0, s.max_pendant, tolerance)
            new = hang(pendant)
            if length > 0:
                distal, new = _line_search(lambda d: value(edge, d, pendant), 0.0, length, tolerance)  # noqa: B023
            if new - now < tolerance:
                return new, distal, pendant
            now = new
        return now, distal, pendant

    for pitch, (_, edge) in enumerate(ranked):
        if s.max_strikes and (strikes >= s.max_strikes or pitch >= s.max_pitches):
            break
        score, distal, pendant = optimise(edge, ref.length[edge] / 2, s.start_pendant, s.first_tolerance)
        if score < best - s.strike_box:
            strikes += 1
        best = max(best, score)
        found.append([score, edge, distal, pendant])
    found.sort(key=lambda x: (-x[0], x[1]))
    found = [f for f in found[: s.keep_at_most] if f[0] >= found[0][0] + np.log(s.keep_factor)]
    refined = sorted(([*optimise(e, d, p, s.tolerance), e] for _, e, d, p in found), key=lambda x: (-x[0], x[3]))
    weights = np.exp([f[0] - refined[0][0] for f in refined])
    weights /= weights.sum()
    out = [{"edge": e, "log_like": score, "ml_ratio": float(w), "distal_bl": d, "pendant_bl": p} for (score, d, p, e), w in zip(refined, weights, strict=True)]
    if s.posterior:
        means = ref.prior_means() if s.informative else {}
        marginals = [_marginal(value, o["edge"], ref.length[o["edge"]], s, refined[0][0], means.get(o["edge"], s.prior_mean)) for o in out]
        total = np.logaddexp.reduce(marginals)
        for o, m in zip(out, marginals, strict=True):
            o["marginal_like"], o["post_prob"] = float(m), float(np.exp(m - total))
    return out


def _marginal(value, edge: int, length: float, s: Settings, base: float, mean: float) -> float:
    """Log of the likelihood averaged over places on an edge and over the prior of pendant lengths, by Gauss-Legendre quadrature."""
    x, wx = np.polynomial.legendre.leggauss(8)
    y, wy = np.polynomial.legendre.leggauss(16)
    pend, wp = (y + 1) / 2 * s.max_pendant, wy / 2 * s.max_pendant
    prior = np.exp(-pend / mean) / mean if mean > 0 else np.full(len(pend), 1 / s.max_pendant)
    total = sum(a / 2 * b * f * np.exp(value(edge, (u + 1) / 2 * length, t) - base) for u, a in zip(x, wx, strict=True) for t, b, f in zip(pend, wp, prior, strict=True))
    return float(np.log(max(total, 1e-300)) + base)


def premask(references: DataFrame, queries: DataFrame) -> list[int]:
    """Sites (from 0) with a letter in some reference and some query: one grouped aggregate over each; none at all is an error."""

    def informative(df: DataFrame) -> DataFrame:
        letters = df.select(F.posexplode(F.split("seq", "")).alias("k", "c")).where(~F.col("c").isin("-", "?", ".", ""))
        return letters.select("k").distinct()

    found = sorted(r[0] for r in informative(references).join(informative(queries), "k").collect())
    if not found:
        raise ValueError("queries and references share no site")
    return found


def place(queries: DataFrame, ref: Reference, settings: Settings = Settings()) -> DataFrame:
    """(name, line, loc, log_like, ml_ratio, distal_bl, pendant_bl, post_prob, marginal_like) of (name, seq) queries.

    Equal sequences are placed once.  A query of gaps only has no row.  Works on a stream too.
    """
    shared = queries.sparkSession.sparkContext.broadcast((ref, settings))
    schema = "name string, line int, loc int, log_like double, ml_ratio double, distal_bl double, pendant_bl double, post_prob double, marginal_like double"

    def work(batches):
        own, how = shared.value
        for pdf in batches:
            rows = []
            for seq, names in pdf.groupby("seq")["name"]:
                found = place_query(own, seq, how)
                rows += [(n, k, p["edge"], p["log_like"], p["ml_ratio"], p["distal_bl"], p["pendant_bl"], p.get("post_prob"), p.get("marginal_like")) for n in names for k, p in enumerate(found)]
            yield pd.DataFrame(rows, columns=["name", "line", "loc", "log_like", "ml_ratio", "distal_bl", "pendant_bl", "post_prob", "marginal_like"]).astype({"post_prob": float, "marginal_like": float, "line": "int32", "loc": "int32"})

    return queries.select("name", "seq").mapInPandas(work, schema)
