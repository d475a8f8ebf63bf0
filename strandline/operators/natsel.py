"""Tests of selection on codon alignments: neutrality, branches, sites, and branches with sites.

A hypothesis is a set of site classes, each with a weight and with the ratio of amino-acid to silent changes on
foreground and on background edges. Edge lengths keep the proportions that a nucleotide fit gives them, so a codon fit
has a scale, the parameters of the model and the ratios and weights that the hypothesis leaves free. A family is one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.likelihood import LikelihoodFunction, expm, get_model, nelder_mead
from ..functions.special import chi2_sf
from ..functions.tree import Node, nj, parse_newick
from ..session import ship

#: A class: (weight, ratio on foreground edges, ratio on background edges).
Classes = list[tuple[float, float, float]]


def class_lnl(lf: LikelihoodFunction, scale: float, params: dict[str, float], classes: Classes, foreground: set[str]) -> float:
    """The log-likelihood of a mixture of site classes; `params`: the model's besides omega."""
    each = []
    tree = lf.tree
    for weight, fg, bg in classes:
        qs = {w: lf.model.q(lf.pi, params | {"omega": w}) for w in {fg, bg}}
        held: dict[int, np.ndarray] = {}
        logs = np.zeros(len(lf.columns))
        for n in tree.postorder():
            if n.is_tip:
                held[id(n)] = lf.tips[n.name]
                continue
            v = np.ones((len(lf.columns), len(lf.model.states)))
            for c in n.children:
                v = v * (held.pop(id(c)) @ expm(qs[fg if c.name in foreground else bg] * max(c.length or 0.0, 0.0) * scale).T)
            top = np.maximum(v.max(axis=1), 1e-300)
            held[id(n)], logs = v / top[:, None], logs + np.log(top)
        each.append(math.log(max(weight, 1e-300)) + np.log(np.maximum(held[id(tree)] @ lf.pi, 1e-300)) + logs)
    top = np.max(each, axis=0)
    return float(lf.counts @ (top + np.log(np.exp(np.array(each) - top).sum(axis=0))))


def _logit(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


# hypotheses: number of free values, and the classes that they give
HYPOTHESES: dict[str, tuple[tuple[int, Callable[[Sequence[float]], Classes]], tuple[int, Callable[[Sequence[float]], Classes]]]] = {
    "neutral": ((0, lambda v: [(1.0, 1.0, 1.0)]), (1, lambda v: [(1.0, math.exp(v[0]), math.exp(v[0]))])),
    "timehet": ((1, lambda v: [(1.0, math.exp(v[0]), math.exp(v[0]))]), (2, lambda v: [(1.0, math.exp(v[0]), math.exp(v[1]))])),
    "sitehet": (
        (2, lambda v: [(_logit(v[0]), _logit(v[1]), _logit(v[1])), (1 - _logit(v[0]), 1.0, 1.0)]),
        (4, lambda v: (lambda p, w, q, a: [(p * (1 - q), w, w), ((1 - p) * (1 - q), 1.0, 1.0), (q, a, a)])(_logit(v[0]), _logit(v[1]), _logit(v[2] - 2), 1 + math.exp(min(v[3], 4)))),
    ),
    "zhang": (
        (3, lambda v: _branch_site(v[0], v[1], v[2], 1.0)),
        (4, lambda v: _branch_site(v[0], v[1], v[2], 1 + math.exp(min(v[3], 4)))),
    ),
}


def _branch_site(a: float, b: float, c: float, fg: float) -> Classes:
    p, w, q = _logit(a), _logit(b), _logit(c - 2)
    return [(p * (1 - q), w, w), ((1 - p) * (1 - q), 1.0, 1.0), (p * q, fg, w), ((1 - p) * q, fg, 1.0)]


def fit_classes(lf: LikelihoodFunction, free: int, classes: Callable[[Sequence[float]], Classes], foreground: set[str], steps: int) -> tuple[float, int, Classes]:
    """(log-likelihood, free values, classes) of the best fit."""
    clip = lambda x: float(np.clip(x, -6, 6))
    names = [p for p in lf.model.parameters if p != "omega"]
    k = 1 + len(names)

    def cost(x: np.ndarray) -> float:
        return -class_lnl(lf, math.exp(clip(x[0])), {p: math.exp(clip(v)) for p, v in zip(names, x[1:k])}, classes([clip(v) for v in x[k:]]), foreground)

    best = nelder_mead(cost, np.zeros(k + free), steps)
    return -cost(best), k + free, classes([clip(v) for v in best[k:]])


def natsel(seqs: DataFrame, test: str = "neutral", trees: DataFrame | None = None, foreground: Sequence[str] = (), model: str = "MG94HKY", steps: int = 15) -> DataFrame:
    """(family, lnl_null, lnl_alt, LR, df, pvalue, omega) of rows (family, name, seq): the test by name, see HYPOTHESES.

    `foreground` names edges (tips or named inner nodes); timehet and zhang need some. omega is the last class's ratio
    on foreground edges. Families of fewer than three sequences, or without a whole codon, have nulls.
    """
    ship(seqs.sparkSession)
    rows = seqs if trees is None else seqs.join(trees, "family")
    named = set(foreground)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        data = {n: s[: len(s) // 3 * 3] for n, s in zip(g["name"], g["seq"])}
        names = sorted(data)
        out = [None] * 6
        if len(names) >= 3 and min(map(len, data.values())) >= 3:
            if "newick" in g:
                tree: Node = parse_newick(g["newick"].iloc[0])
            else:
                d = lambda x, y: sum(p != q for p, q in zip(x, y)) / max(1, min(len(x), len(y)))
                tree = nj(names, np.array([[d(data[a], data[b]) for b in names] for a in names]))
            LikelihoodFunction(get_model("F81"), tree, data).fit(steps)
            for n in tree.preorder():
                n.length = None if n.parent is None else 3 * (n.length or 0.0)
            lf = LikelihoodFunction(get_model(model), tree, data)
            (f0, c0), (f1, c1) = HYPOTHESES[test]
            (l0, n0, _), (l1, n1, made) = fit_classes(lf, f0, c0, named, steps), fit_classes(lf, f1, c1, named, steps)
            lr = 2 * (l1 - l0)
            out = [l0, l1, lr, n1 - n0, chi2_sf(lr, n1 - n0) if lr > 0 else 1.0, made[-1][1]]
        return pd.DataFrame([[g["family"].iloc[0], *out]], columns=["family", "lnl_null", "lnl_alt", "LR", "df", "pvalue", "omega"]).astype({"df": "Int64"})

    return rows.groupBy("family").applyInPandas(run, f"family {dict(seqs.dtypes)['family']}, lnl_null double, lnl_alt double, LR double, df long, pvalue double, omega double")
